"""Provenance: which records meet an audit's criteria, what they reach, and summaries of agents and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.functions.common import carried, in_order
from weftwork.operators.graph import traverse


def audit_records(lineage: DataFrame, *, agent: str = "", orchestrator: str = "", model: str = "", session: str = "", keyword: str = "", prompt_sha256: str = "", since: str = "", until: str = "") -> DataFrame:
    """Records that meet all criteria given; blank ones are ignored, times are inclusive, the keyword is sought in any case."""
    tests: list[Column] = [F.col(c) == v for c, v in (("agent", agent), ("orchestrator", orchestrator), ("model", model), ("session", session)) if v]
    if keyword:
        tests.append(F.contains(F.lower("prompt"), F.lit(keyword.lower())))
    if prompt_sha256:
        tests.append(F.sha2("prompt", 256) == prompt_sha256)
    if since:
        tests.append(F.col("ts") >= F.lit(since).cast(lineage.schema["ts"].dataType))
    if until:
        tests.append(F.col("ts") <= F.lit(until).cast(lineage.schema["ts"].dataType))
    for t in tests:
        lineage = lineage.filter(t)
    return lineage


def audit_filter(nodes: DataFrame, lineage: DataFrame, **criteria: str) -> DataFrame:
    """Nodes with at least one record that meets all criteria at once; nodes without records never match."""
    return nodes.join(audit_records(lineage, **criteria).select("node_id"), "node_id", "left_semi")


def summary(nodes: DataFrame, lineage: DataFrame, by: str, other: str) -> DataFrame:
    """Per agent or model: nodes, languages, sessions and counterparts, first and last time; lists sorted."""
    r = lineage.join(nodes.select("node_id", "language"), "node_id")
    return r.groupBy(by).agg(F.countDistinct("node_id").alias("n_nodes"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"), F.countDistinct("session").alias("n_sessions"),
                             F.array_join(F.array_sort(F.collect_set(other)), ",").alias(f"{other}s"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def blast_report(nodes: DataFrame, edges: DataFrame, lineage: DataFrame, *, max_depth: int = 0, **criteria: str) -> DataFrame:
    """direct, downstream, total, n_languages, risk = direct + 1.5 downstream + 2 languages, over the forward reach of the matching nodes."""
    hit = audit_filter(nodes, lineage, **criteria).select("node_id")
    reach = traverse(edges, hit, max_depth=max_depth, with_path=False).join(nodes.select("node_id", "language"), "node_id", "left")
    n = reach.agg(F.count_if(F.col("depth") == 0).alias("direct"), F.count_if(F.col("depth") > 0).alias("downstream"), F.count("*").alias("total"),
                  F.countDistinct(F.when(F.col("language") != "", F.col("language"))).alias("n_languages"))
    return n.select("direct", "downstream", "total", "n_languages", (F.col("direct") * 1.0 + F.col("downstream") * 1.5 + F.col("n_languages") * 2.0).alias("risk"))


def node_blast(edges: DataFrame, node_id: str) -> DataFrame:
    """visited and risk = min(1, 0.1 visited) for one start node."""
    start = edges.sparkSession.createDataFrame([(node_id,)], "node_id string")
    return traverse(edges, start, with_path=False).agg(F.count("*").alias("visited")).select("visited", F.least(F.lit(1.0), F.col("visited") * 0.1).alias("risk"))


def ancestry_hops(lineage: DataFrame) -> DataFrame:
    """node_id, hop, record_id, root_agent, final_model: each node's records numbered in time; first and last name its origin and its end."""
    order = ["ts", "record_id"]
    r = in_order(lineage.select("node_id", *order, F.lit(1).cast("bigint").alias("_one")), ["node_id", *order])
    hops = carried(r, ["node_id"], order, {"_n": ("sum", "_one", False)})
    ends = lineage.groupBy("node_id").agg(F.min_by("agent", F.struct(*order)).alias("root_agent"), F.max_by("model", F.struct(*order)).alias("final_model"))
    return hops.join(ends, "node_id").select("node_id", F.coalesce("_n", F.lit(0)).cast("int").alias("hop"), "record_id", "root_agent", "final_model")


def lineage_coverage(nodes: DataFrame, lineage: DataFrame) -> DataFrame:
    """Nodes with and without records."""
    have = lineage.select("node_id").distinct().withColumn("_h", F.lit(True))
    return nodes.join(have, "node_id", "left").agg(F.count_if(F.col("_h").isNotNull()).alias("with_lineage"), F.count_if(F.col("_h").isNull()).alias("without_lineage"))


def latest_record(lineage: DataFrame) -> DataFrame:
    """node_id, record_id, agent of each node's last record; one partial aggregate, no sort."""
    return lineage.groupBy("node_id").agg(F.max_by(F.struct("record_id", "agent"), F.struct("ts", "record_id")).alias("r")).select("node_id", "r.record_id", "r.agent")
