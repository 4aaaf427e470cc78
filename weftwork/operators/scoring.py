"""Scores and ladders as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftwork.functions.common import carried, in_order


def composite_score(test_rate: Column, security: Column, latency_ms: Column, tokens: Column) -> Column:
    return 0.5 * test_rate + 0.3 * security + 0.1 * F.greatest(F.lit(0.0), 1 - latency_ms / 1000) + 0.1 * F.greatest(F.lit(0.0), 1 - tokens / 10000)


def token_estimate(text: Column) -> Column:
    """max(sum over words of 1 + punctuation + (length - 8) / 4 where longer, ceil(bytes / 4))."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    per = F.aggregate(words, F.lit(0), lambda s, w: (s + 1 + F.char_length(F.regexp_replace(w, r"[^\p{Punct}]", "")) + F.greatest(F.lit(0), F.floor((F.char_length(w) - 8) / 4).cast("int"))).cast("int"))
    return F.greatest(per, F.ceil(F.octet_length(text) / 4).cast("int"))


#: Penalties of findings, weights of dimensions and floors of grades.
PENALTY = {"CRITICAL": 40, "HIGH": 20, "MEDIUM": 10, "LOW": 4}
GRADES = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))


def scorecard(findings: DataFrame, weights: dict[str, float]) -> DataFrame:
    """score, grade over findings (dimension, severity): each dimension starts at 100, loses its penalties, floor 0; a critical finding caps the grade at F."""
    pen = F.create_map(*[F.lit(x) for kv in PENALTY.items() for x in kv])
    d = findings.groupBy("dimension").agg(F.sum(F.coalesce(pen[F.col("severity")], F.lit(0))).alias("p"), F.count_if(F.col("severity") == "CRITICAL").alias("c"))
    w = findings.sparkSession.createDataFrame(list(weights.items()), "dimension string, weight double")
    n = w.join(d, "dimension", "left").agg(F.sum(F.col("weight") * F.greatest(F.lit(0), 100 - F.coalesce("p", F.lit(0)))).alias("score"), F.coalesce(F.sum("c"), F.lit(0)).alias("critical"))
    g = F.when(F.col("critical") > 0, "F")
    for floor, name in GRADES:
        g = g.when(F.col("score") >= floor, name)
    return n.select("score", "critical", g.otherwise("F").alias("grade"))


def running_context(steps: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """key, order, prompt_size, total: what stood before each step of its conversation, and all up to it."""
    both = carried(in_order(steps.select(key, order, size), [key, order]), [key], [order], {"prompt_size": ("sum", size, False), "total": ("sum", size, True)})
    return both.select(key, order, F.coalesce("prompt_size", F.lit(0)).alias("prompt_size"), "total")


def last_n(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The n newest rows of each key."""
    first = F.row_number().over(W.partitionBy("_t", key).orderBy(*order))  # the best of each task's own rows, then the best of those
    few = df.withColumn("_t", F.pmod(F.xxhash64(*df.columns), F.lit(64))).withColumn("_r", first).filter(F.col("_r") <= n).drop("_r", "_t")
    return few.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")
