"""Snapshots: differences, merges, drift and state as of a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """change, keys: what only ``b`` has is added, what only ``a`` has is removed. One full outer join on distinct keys."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(1)), b.select(*keys).distinct().withColumn("_b", F.lit(1))
    return x.join(y, keys, "full_outer").filter("_a is null or _b is null").select(F.when(F.col("_a").isNull(), "added").otherwise("removed").alias("change"), *keys)


def keyed_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """key, change: ADDED, REMOVED or MODIFIED (same key, other value). Repeated keys are taken at their largest value."""
    x, y = a.groupBy(key).agg(F.max(value).alias("_x")), b.groupBy(key).agg(F.max(value).alias("_y"))
    j = x.withColumn("_a", F.lit(1)).join(y.withColumn("_b", F.lit(1)), key, "full_outer")
    change = F.when(F.col("_a").isNull(), "ADDED").when(F.col("_b").isNull(), "REMOVED").when(~F.col("_x").eqNullSafe(F.col("_y")), "MODIFIED")
    return j.select(key, change.alias("change")).filter("change is not null")


def merge_union(source: DataFrame, target: DataFrame, key: str, value: str) -> DataFrame:
    """key, value of both; on a clash the source's value wins. Nothing is ever removed."""
    both = source.select(key, value, F.lit(1).alias("_p")).unionByName(target.select(key, value, F.lit(0).alias("_p")))
    return both.groupBy(key).agg(F.max_by(value, F.struct("_p", value)).alias(value))


def merge_branches(source: DataFrame, target: DataFrame, key: str, value: str, strategy: str = "union") -> DataFrame:
    """merge_union, or the source alone for a fast forward (either spelling)."""
    if strategy in ("fast-forward", "fast_forward"):
        return source.select(key, value)
    return merge_union(source, target, key, value)


def latest_by(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """The row with the largest order columns per key, by one combined aggregate."""
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in cols if c not in order])).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in cols])


def concurrent_changes(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys both sides hold with other content."""
    x, y = a.select(key, F.col(value).alias("value_a")), b.select(key, F.col(value).alias("value_b"))
    return x.join(y, key).filter(~F.col("value_a").eqNullSafe(F.col("value_b")))


def savings(total: Column, kept: Column) -> Column:
    """Percent saved; 0 where there is nothing, or more kept than there was."""
    return F.when((total <= 0) | (kept > total), 0.0).otherwise((1 - kept / total) * 100)


def sparse_pull(components: DataFrame, symbols: DataFrame, keep: Column) -> DataFrame:
    """total_components, kept_components, total_symbols, kept_symbols, saved_pct of pulling the components that ``keep`` selects."""
    c = components.select("component_id", F.coalesce(keep, F.lit(False)).alias("_k"))
    n = symbols.groupBy("component_id").agg(F.count("*").alias("n"))
    j = c.join(n, "component_id", "left").agg(F.count("*").alias("total_components"), F.count_if("_k").alias("kept_components"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_symbols"),
                                              F.coalesce(F.sum(F.when(F.col("_k"), F.col("n"))), F.lit(0)).alias("kept_symbols"))
    return j.withColumn("saved_pct", savings(F.col("total_symbols"), F.col("kept_symbols")))
