"""Streams: change feeds folded to state, windowed counts with late data, leases with state, fan-out, directory watching."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """New files of a directory as a stream, under an explicit schema."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def latest_state(stream: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Per key the row with the largest order columns so far (update mode): one struct of state per key."""
    return stream.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in cols if c not in order])).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in cols])


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts by window and keys; rows later than ``late`` behind the newest are dropped, and their state with them."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def _lease(ttl_ms: int) -> Callable:
    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts_ms", "event_id"], kind="stable")  # one domain's rows of one micro-batch
        holder, until = state.get if state.exists else (None, -1)
        granted, owners = [], []
        for who, t in zip(rows["agent"], rows["ts_ms"], strict=True):
            ok = holder is None or holder == who or until <= t
            if ok:
                holder, until = who, int(t) + ttl_ms
            granted.append(ok)
            owners.append(holder)
        state.update((holder, until))
        yield rows.assign(domain=key[0], granted=granted, owner=owners)[["domain", "agent", "ts_ms", "event_id", "granted", "owner"]]

    return fold


def lease_stream(stream: DataFrame, ttl_ms: int = 600_000) -> DataFrame:
    """Lease decisions on a stream of requests (domain, agent, ts_ms, event_id): one holder and an end per domain is the state."""
    return stream.select("domain", "agent", "ts_ms", "event_id").groupBy("domain").applyInPandasWithState(
        _lease(ttl_ms), "domain string, agent string, ts_ms bigint, event_id bigint, granted boolean, owner string", "holder string, until bigint", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all there is and return what it wrote: a Parquet table with the batch's number, each batch written once."""
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_no", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:09d}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(_with_batch(stream)).parquet(f"{path}/batch=*")


def _with_batch(stream: DataFrame):
    from pyspark.sql import types as T

    return T.StructType([*stream.schema.fields, T.StructField("batch_no", T.IntegerType())])


def fan_out(stream: DataFrame, topics: dict[str, Callable[[DataFrame, int], None]], checkpoint: str):
    """Each micro-batch to every subscriber of its topic, and to those of "*"; a failed batch is given again."""
    def give(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for topic, f in topics.items():
                f(batch if topic == "*" else batch.filter(F.col("topic") == topic), number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(give).option("checkpointLocation", checkpoint)


def directory_delta(now: DataFrame, before: DataFrame) -> DataFrame:
    """path, change between two listings (path, size, modified, sha256): modified only if size or time and the hash differ."""
    a, b = now.select("path", "size", "modified", "sha256"), before.select("path", F.col("size").alias("_s"), F.col("modified").alias("_m"), F.col("sha256").alias("_h"))
    j = a.join(b, "path", "full_outer")
    change = F.when(F.col("_h").isNull(), "added").when(F.col("sha256").isNull(), "deleted").when(((F.col("size") != F.col("_s")) | (F.col("modified") != F.col("_m"))) & (F.col("sha256") != F.col("_h")), "modified")
    return j.select("path", change.alias("change")).filter("change is not null")
