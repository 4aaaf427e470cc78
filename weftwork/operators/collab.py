"""Replicated collaboration state: merging proposals and boards, claims, leases, interval conflicts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_replicas(mine: DataFrame, other: DataFrame, key: list[str], cols: list[str], *, prefer: str = "other") -> DataFrame:
    """Union by key; where both sides hold a key, the preferred side's row wins, within a side the largest row."""
    a, b = (1, 0) if prefer == "mine" else (0, 1)
    both = mine.select(*key, *cols, F.lit(a).alias("_p")).unionByName(other.select(*key, *cols, F.lit(b).alias("_p")))
    return both.groupBy(*key).agg(F.max(F.struct("_p", *cols)).alias("_r")).select(*key, *[F.col("_r")[c].alias(c) for c in cols])


def merged_clock(mine: DataFrame, other: DataFrame) -> DataFrame:
    return mine.select("clock").unionByName(other.select("clock")).agg((F.max("clock") + 1).alias("clock"))


def merged_status(mine: str, other: str) -> str:
    """MERGED wins; an approval of the other side counts; asked changes only against an open proposal."""
    if "MERGED" in (mine, other):
        return "MERGED"
    if other == "APPROVED" or other == "CHANGES_REQUESTED" and mine == "OPEN":
        return other
    return mine


def claims(log: DataFrame, domain: str, agent: str, order: list[str]) -> DataFrame:
    """domain, agent: the first to claim a domain owns it."""
    return log.groupBy(domain).agg(F.min_by(agent, F.struct(*order)).alias("owner"))


def _lease_fold(ttl_ms: int):
    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        holder: dict[str, tuple[str, int]] = {}
        for f in frames:
            granted, owners = [], []
            for dom, who, t in zip(f["domain"], f["agent"], f["ts_ms"], strict=True):
                held = holder.get(dom)
                ok = held is None or held[0] == who or held[1] <= t
                if ok:
                    holder[dom] = (who, int(t) + ttl_ms)
                granted.append(ok)
                owners.append(holder[dom][0])
            yield f.assign(granted=granted, owner=owners)[["domain", "agent", "ts_ms", "event_id", "granted", "owner"]]

    return fold


def lease_requests(log: DataFrame, ttl_ms: int = 600_000) -> DataFrame:
    """domain, agent, ts_ms, event_id, granted, owner: each request in order of time.

    A lease is granted if none is held, the holder asks again (which renews it) or it has run out. The
    fold keeps one holder per domain; a task streams its sorted domains and never holds a domain's log.
    """
    one = log.select("domain", "agent", "ts_ms", "event_id").repartition("domain").sortWithinPartitions("domain", "ts_ms", "event_id")
    return one.mapInPandas(_lease_fold(ttl_ms), "domain string, agent string, ts_ms bigint, event_id bigint, granted boolean, owner string")


def overlaps(a: DataFrame, b: DataFrame, key: str, bucket_ms: int) -> DataFrame:
    """Pairs of intervals [start_ms, end_ms) of the same key that overlap, a.id < b.id.

    Intervals are laid into buckets of time and joined on key and bucket, so a key with many intervals is split by
    time; a pair is kept in the bucket where the later one starts, so it appears once.
    """
    cut = lambda d, p: d.select(F.col(key), F.col("id").alias(f"id_{p}"), F.col("start_ms").alias(f"s_{p}"), F.col("end_ms").alias(f"e_{p}")).filter(f"s_{p} < e_{p}").withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col(f"s_{p}") / bucket_ms), F.floor((F.col(f"e_{p}") - 1) / bucket_ms))))
    x, y = cut(a, "a"), cut(b, "b")
    j = x.join(y, [key, "_b"]).filter("id_a < id_b and s_a < e_b and e_a > s_b").filter(F.col("_b") == F.floor(F.greatest("s_a", "s_b") / bucket_ms))
    return j.select(key, "id_a", "id_b")


def active_leases(leases: DataFrame, as_of_ms: int) -> DataFrame:
    """Leases without an end or with one after the given time."""
    return leases.filter(F.col("expires_ms").isNull() | (F.col("expires_ms") > as_of_ms))
