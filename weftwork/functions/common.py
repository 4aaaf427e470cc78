"""Small helpers shared by every operator: sessions, lineage cuts, string cleaning."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHITE = r"[\s   ﻿]+"


def trim_white(c: Column | str) -> Column:
    """Strip every kind of white space on both ends (Spark's trim strips blanks only)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_replace(c, "^" + _WHITE, ""), _WHITE + "$", "")


def norm_key(c: Column | str) -> Column:
    """Change ids and git hashes compare trimmed and in lower case."""
    return F.lower(trim_white(c))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir. Where it is unset a local master gets a temporary one; any other master raises, as its executors would not see it."""
    jsc = spark.sparkContext._jsc.sc()
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have and jsc.getCheckpointDir().isDefined():
        have = jsc.getCheckpointDir().get()
    if not have:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        have = "file://" + tempfile.mkdtemp(prefix="weftwork-ckpt-")
        atexit.register(shutil.rmtree, have[len("file://"):], True)
        spark.conf.set("spark.checkpoint.dir", have)
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(have)
    return have


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder, so a lost executor costs a re-read only."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the session's process ends: plans made from it may be read until then."""
    path = f"{shared_dir(spark)}/weftwork-{uuid.uuid4().hex}"
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc

    def remove() -> None:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            if path.startswith("file:"):
                shutil.rmtree(path.split("file://")[-1], ignore_errors=True)

    atexit.register(remove)
    return path


def staged(df: DataFrame) -> DataFrame:
    """Like cut, as a written Parquet table in the shared folder: smaller, and later reads prune columns."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dropped(*tables: DataFrame) -> None:
    """Remove the files of staged tables that nothing reads any more."""
    for df in tables:
        jvm, jsc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles() if "/weftwork-" in x}:
            p = jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def latest_row(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """One row per key, the one with the largest order columns; map-side combined, no sort, no window.

    Ties are broken by the remaining columns, so the result does not depend on the input's order.
    """
    rest = [c for c in cols if c not in order]
    pick = F.max(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])).alias("_r")
    return df.groupBy(*keys).agg(pick).select(*keys, *[F.col("_r")[c].alias(c) for c in cols])


def in_order(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` range-partitioned and sorted by ``by``, with the partition as _p; checkpointed, so a row never moves to another partition later."""
    return cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_p", F.spark_partition_id()))


def carried(ordered: DataFrame, group: list[str], order: list[str], folds: dict[str, tuple[str, str, bool]]) -> DataFrame:
    """Columns that run along each group's order, without a group ever meeting in one task.

    ``ordered`` comes from in_order(df, [*group, *order]). ``folds`` gives for every new column (kind, source column, whether the
    row itself counts), kind being "last" (of the values that are not null), "max" or "sum". Every partition folds its own rows; what a group
    brings from earlier partitions is one row a partition, which the driver adds up: the partitions' number bounds it.
    """
    spark = ordered.sparkSession
    key, at = F.struct(*group) if group else F.struct(F.lit(0).alias("g")), F.struct(*order)
    fold = {"last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)), "max": F.max, "sum": F.sum}
    edge = ordered.groupBy("_p").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    edges = edge.collect()  # a row a partition
    tail = F.broadcast(spark.createDataFrame([(r["_p"], r["_hi"]) for r in edges], edge.select(F.col("_p").alias("_tp"), "_hi").schema))
    ends = (ordered.join(tail, (F.col("_p") == F.col("_tp")) & (key == F.col("_hi"))).groupBy("_p")
            .agg(*[fold[kind](c).alias(name) for name, (kind, c, _) in folds.items()]))
    last = {r["_p"]: r for r in ends.collect()}
    add = {"last": lambda a, b: b, "max": max, "sum": lambda a, b: a + b}
    held, owner, brought = {}, None, []
    for r in sorted(edges, key=lambda r: r["_p"]):
        if owner != r["_lo"]:
            held = {}
        brought.append((r["_p"], r["_lo"], *[held.get(n) for n in folds]))
        if r["_lo"] != r["_hi"]:
            held = {}
        for n, (kind, _, _) in folds.items():
            x = last[r["_p"]][n]
            if x is not None:
                held[n] = x if held.get(n) is None else add[kind](held[n], x)
        owner = r["_hi"]
    schema = T.StructType([T.StructField("_cp", T.IntegerType()), T.StructField("_lo", edge.schema["_lo"].dataType), *[T.StructField(f"_c_{n}", ends.schema[n].dataType) for n in folds]])
    carry = F.broadcast(spark.createDataFrame(brought, schema))
    both = ordered.join(carry, (F.col("_p") == F.col("_cp")) & (key == F.col("_lo")), "left")
    here = W.partitionBy("_p", *group).orderBy(*order)
    out = []
    for n, (kind, c, own) in folds.items():
        span = here.rowsBetween(W.unboundedPreceding, 0 if own else -1)
        mine, before = {"last": F.last(c, True), "max": F.max(c), "sum": F.sum(c)}[kind].over(span), F.col(f"_c_{n}")
        if kind == "last":
            mine = F.coalesce(mine, before)
        elif kind == "max":
            mine = F.greatest(mine, before)
        else:
            mine = F.when(mine.isNull() & before.isNull(), None).otherwise(F.coalesce(mine, F.lit(0)) + F.coalesce(before, F.lit(0)))
        out.append(mine.alias(n))
    return both.select(*[F.col(c) for c in ordered.columns], *out)


def ranked(df: DataFrame, group: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """``df`` with each row's 0-based position in its group by ``order``, without a group ever meeting in one task."""
    one = in_order(df.withColumn("_one", F.lit(1).cast("bigint")), [*group, *order])
    out = carried(one, group, order, {name: ("sum", "_one", False)})
    return out.select(*[F.col(c) for c in df.columns], F.coalesce(name, F.lit(0)).cast("bigint").alias(name))
