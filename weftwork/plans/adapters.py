"""What the test tables stand for: nodes, edges, provenance, event log and so on, as DataFrames and as SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions.common import norm_key, table


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nodes(s: SparkSession, d: str) -> DataFrame:
    """node_id, language, node_type, identifier."""
    spec = [("region", "R:", "r_regionkey", "'region'", "r_name"), ("nation", "N:", "n_nationkey", "'nation'", "n_name"), ("customer", "C:", "c_custkey", "c_mktsegment", "c_name"),
            ("supplier", "S:", "s_suppkey", "'supplier'", "s_name"), ("part", "P:", "p_partkey", "p_brand", "p_name"), ("orders", "O:", "o_orderkey", "o_orderstatus", "o_orderpriority")]
    return _union([table(s, d, t).selectExpr(f"concat('{p}', {k}) AS node_id", f"'{t}' AS language", f"{ty} AS node_type", f"{i} AS identifier") for t, p, k, ty, i in spec])


def edges(s: SparkSession, d: str, loops: bool = False) -> DataFrame:
    """source_id, target_id, edge_type; with ``loops`` regions point back to their first nation."""
    n = table(s, d, "nation")
    parts = [
        table(s, d, "orders").selectExpr("concat('O:', o_orderkey) AS source_id", "concat('C:', o_custkey) AS target_id", "'CALLS' AS edge_type"),
        table(s, d, "customer").selectExpr("concat('C:', c_custkey) AS source_id", "concat('N:', c_nationkey) AS target_id", "'DEPLOYS_TO' AS edge_type"),
        table(s, d, "supplier").selectExpr("concat('S:', s_suppkey) AS source_id", "concat('N:', s_nationkey) AS target_id", "'DEPLOYS_TO' AS edge_type"),
        n.selectExpr("concat('N:', n_nationkey) AS source_id", "concat('R:', n_regionkey) AS target_id", "'DEPENDS_ON' AS edge_type"),
        table(s, d, "lineitem").select("l_orderkey", "l_partkey").distinct().selectExpr("concat('O:', l_orderkey) AS source_id", "concat('P:', l_partkey) AS target_id", "'CONSUMES_API' AS edge_type"),
    ]
    if loops:
        parts.append(n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("k")).selectExpr("concat('R:', n_regionkey) AS source_id", "concat('N:', k) AS target_id", "'BINDS_ENV' AS edge_type"))
    return _union(parts)


def lineage(s: SparkSession, d: str) -> DataFrame:
    """record_id, node_id, agent, orchestrator, model, session, prompt, ts: orders as provenance of customers."""
    return table(s, d, "orders").selectExpr("o_orderkey AS record_id", "concat('C:', o_custkey) AS node_id", "o_orderpriority AS agent", "concat('orc-', o_custkey % 5) AS orchestrator",
                                            "o_orderstatus AS model", "concat('s-', o_custkey % 97) AS session", "concat('Price of order ', o_orderkey) AS prompt", "o_orderdate AS ts")


def oplog(s: SparkSession, d: str) -> DataFrame:
    """event_id, ts_ms, universe_id, action, entity_id, payload: the events as a log of node and head changes."""
    return table(s, d, "events").selectExpr(
        "event_id", "unix_millis(cast(ts AS timestamp)) AS ts_ms", "concat('u', user_id % 8) AS universe_id",
        "CASE event_type WHEN 'signup' THEN 'CREATE_NODE' WHEN 'view' THEN 'UPDATE_NODE' WHEN 'error' THEN 'DELETE_NODE' WHEN 'purchase' THEN 'SET_UNIVERSE_HEAD' ELSE 'COMMIT' END AS action",
        "CASE WHEN event_type IN ('purchase', 'click') THEN concat('u', user_id % 8) ELSE concat('n', user_id) END AS entity_id", "props AS payload")


def wide_oplog(s: SparkSession, d: str) -> DataFrame:
    """event_id, universe_id, action, entity_id, payload: the events as a log of nodes, edges, heads and provenance."""
    return table(s, d, "events").selectExpr(
        "event_id", "concat('u', user_id % 8) AS universe_id",
        "CASE event_type WHEN 'signup' THEN 'CREATE_NODE' WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'UPDATE_NODE' ELSE 'ADD_EDGE' END WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'DELETE_NODE' ELSE 'REMOVE_EDGE' END WHEN 'purchase' THEN 'SET_UNIVERSE_HEAD' ELSE 'RECORD_LINEAGE' END AS action",
        "CASE WHEN event_type = 'purchase' THEN concat('u', user_id % 8) WHEN event_type IN ('view', 'error') AND event_id % 2 = 1 THEN concat('n', user_id, '|n', user_id % 41, '|CALLS') WHEN event_type IN ('signup', 'view', 'error') THEN concat('n', user_id) ELSE concat('r', user_id % 97) END AS entity_id", "props AS payload")


def commit_table(s: SparkSession, d: str) -> DataFrame:
    """universe_id, at, entity_id, payload: git commits as manifests of universes."""
    c = table(s, d, "git_commits").filter("universe_id is not null").select("universe_id", F.col("committed_at").alias("at"), norm_key("commit_hash").alias("entity_id"), F.coalesce(norm_key("tree_hash"), F.lit("")).alias("t")).filter("entity_id <> ''").distinct()
    return c.select("universe_id", "at", "entity_id", F.concat(F.lit('{"commit":"'), "entity_id", F.lit('","tree":"'), "t", F.lit('"}')).alias("payload"))


def manifests(s: SparkSession, d: str) -> DataFrame:
    """universe_id, component_id, component_name: two snapshots of the parts, b being a later branch of a."""
    p = table(s, d, "part")
    a = p.filter("p_partkey % 3 <> 0").selectExpr("'a' AS universe_id", "concat('comp-', p_partkey) AS component_id", "concat(p_name, '-', p_partkey % 50) AS component_name")
    return a.unionByName(p.filter("p_partkey % 5 <> 0").selectExpr("'b' AS universe_id", "concat('comp-', p_partkey) AS component_id", "concat(p_name, '-', p_partkey % 50) AS component_name"))


def deployed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(desired, active): name, content_hash of suppliers, the active side behind by a few."""
    x = table(s, d, "supplier")
    want = x.filter("s_suppkey % 7 <> 0").selectExpr("s_name AS name", "sha2(s_name, 256) AS content_hash")
    have = x.filter("s_suppkey % 5 <> 0").selectExpr("s_name AS name", "sha2(CASE WHEN s_suppkey % 11 = 0 THEN concat(s_name, '~') ELSE s_name END, 256) AS content_hash")
    return want, have


def vectors(s: SparkSession, d: str) -> DataFrame:
    """vec_id, node_type, vector."""
    return table(s, d, "embeddings").selectExpr("vec_id", "concat('t', label) AS node_type", "embedding AS vector")


NODES = """SELECT 'R:' || r_regionkey AS node_id, 'region' AS language, 'region' AS node_type, r_name AS identifier FROM region
UNION ALL SELECT 'N:' || n_nationkey, 'nation', 'nation', n_name FROM nation UNION ALL SELECT 'C:' || c_custkey, 'customer', c_mktsegment, c_name FROM customer
UNION ALL SELECT 'S:' || s_suppkey, 'supplier', 'supplier', s_name FROM supplier UNION ALL SELECT 'P:' || p_partkey, 'part', p_brand, p_name FROM part
UNION ALL SELECT 'O:' || o_orderkey, 'orders', o_orderstatus, o_orderpriority FROM orders"""
EDGES = """SELECT 'O:' || o_orderkey AS source_id, 'C:' || o_custkey AS target_id, 'CALLS' AS edge_type FROM orders
UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey, 'DEPLOYS_TO' FROM customer UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey, 'DEPLOYS_TO' FROM supplier
UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey, 'DEPENDS_ON' FROM nation
UNION ALL SELECT DISTINCT 'O:' || l_orderkey, 'P:' || l_partkey, 'CONSUMES_API' FROM lineitem"""
LOOPS = EDGES + " UNION ALL SELECT 'R:' || n_regionkey, 'N:' || min(n_nationkey), 'BINDS_ENV' FROM nation GROUP BY n_regionkey"
LINEAGE = """SELECT o_orderkey AS record_id, 'C:' || o_custkey AS node_id, o_orderpriority AS agent, 'orc-' || (o_custkey % 5) AS orchestrator, o_orderstatus AS model,
's-' || (o_custkey % 97) AS session, 'Price of order ' || o_orderkey AS prompt, o_orderdate AS ts FROM orders"""
OPLOG = """SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, 'u' || (user_id % 8) AS universe_id,
CASE event_type WHEN 'signup' THEN 'CREATE_NODE' WHEN 'view' THEN 'UPDATE_NODE' WHEN 'error' THEN 'DELETE_NODE' WHEN 'purchase' THEN 'SET_UNIVERSE_HEAD' ELSE 'COMMIT' END AS action,
CASE WHEN event_type IN ('purchase', 'click') THEN 'u' || (user_id % 8) ELSE 'n' || user_id END AS entity_id, props AS payload FROM events"""
WIDE_OPLOG = """SELECT event_id, 'u' || (user_id % 8) AS universe_id,
CASE event_type WHEN 'signup' THEN 'CREATE_NODE' WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'UPDATE_NODE' ELSE 'ADD_EDGE' END WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'DELETE_NODE' ELSE 'REMOVE_EDGE' END WHEN 'purchase' THEN 'SET_UNIVERSE_HEAD' ELSE 'RECORD_LINEAGE' END AS action,
CASE WHEN event_type = 'purchase' THEN 'u' || (user_id % 8) WHEN event_type IN ('view', 'error') AND event_id % 2 = 1 THEN 'n' || user_id || '|n' || (user_id % 41) || '|CALLS' WHEN event_type IN ('signup', 'view', 'error') THEN 'n' || user_id ELSE 'r' || (user_id % 97) END AS entity_id, props AS payload FROM events"""
_N = "lower(regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', ''))"
COMMITS = f"""SELECT universe_id, t0, entity_id, '{{"commit":"' || entity_id || '","tree":"' || t || '"}}' AS payload FROM (SELECT DISTINCT universe_id, committed_at AS t0, {_N.format('commit_hash')} AS entity_id, coalesce({_N.format('tree_hash')}, '') AS t FROM git_commits WHERE universe_id IS NOT NULL) WHERE entity_id <> ''"""
MANIFESTS = """SELECT 'a' AS universe_id, 'comp-' || p_partkey AS component_id, p_name || '-' || (p_partkey % 50) AS component_name FROM part WHERE p_partkey % 3 <> 0
UNION ALL SELECT 'b', 'comp-' || p_partkey, p_name || '-' || (p_partkey % 50) FROM part WHERE p_partkey % 5 <> 0"""
DESIRED = "SELECT s_name AS name, sha256(s_name) AS content_hash FROM supplier WHERE s_suppkey % 7 <> 0"
ACTIVE = "SELECT s_name AS name, sha256(CASE WHEN s_suppkey % 11 = 0 THEN s_name || '~' ELSE s_name END) AS content_hash FROM supplier WHERE s_suppkey % 5 <> 0"
