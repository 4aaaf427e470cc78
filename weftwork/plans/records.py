"""Queries p3, p4 and p5: hierarchies, nested records and orphan references, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions.common import table
from weftwork.operators import hierarchy as H
from weftwork.operators import nested as N
from weftwork.operators import orphans as O


def _trees(s: SparkSession, d: str, with_path: bool) -> DataFrame:
    """Both tables in one pass: keys carry their table's name in front, which keeps the order of keys within a table."""
    mark = "\u0001"
    both = None
    for name, links in (("stacked_proposals", H.proposal_links), ("git_commits", H.commit_links)):
        one = links(table(s, d, name)).select(*[F.concat(F.lit(name + mark), c).alias(c) for c in ("node_key", "parent_key")])
        both = one if both is None else both.unionByName(one)
    h = H.hierarchy(both, with_path=with_path)
    return h.select(F.substring_index("node_key", mark, 1).alias("record_table"), *[F.substring_index(c, mark, -1).alias(c) for c in ("node_key", "parent_key", "root_key")],
                    "depth", F.transform("path", lambda x: F.substring_index(x, mark, -1)).alias("path"), "on_loop", "back_edge")


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return _trees(s, d, False).select("record_table", "node_key", "root_key", F.col("depth").cast("int").alias("depth"))


def p3_paths(s: SparkSession, d: str) -> DataFrame:
    return _trees(s, d, True).select("record_table", "node_key", F.array_join("path", "/").alias("path"), "on_loop")


def p3_descendants(s: SparkSession, d: str) -> DataFrame:
    out = H.descendants(_trees(s, d, True), "record_table")
    return out.select("record_table", "ancestor_key", "descendant_key", F.col("distance").cast("int").alias("distance"))


def p3_loops(s: SparkSession, d: str) -> DataFrame:
    return _trees(s, d, False).filter("on_loop").select("record_table", F.col("root_key").alias("loop_key"), "node_key", F.col("parent_key").alias("next_key"))


def p3_back_edges(s: SparkSession, d: str) -> DataFrame:
    """The link that closes each loop: that of its smallest key, to a parent that is its own descendant."""
    return _trees(s, d, False).filter("back_edge").select("record_table", "node_key", "parent_key")


P4_SOURCES = {
    "java_classes": ("class_id", "methods", ["v", "*", "params"], None),
    "graphql_types": ("type_id", "fields", ["v", "*", "arguments"], None),
    "publish_payloads": ("payload_id", None, ["symbols", "*", "ast_payload", "params"], "node_id"),
}


def _elements(s: SparkSession, d: str, name: str, parents: bool = False) -> DataFrame:
    key, col, path, key_field = P4_SOURCES[name]
    df = table(s, d, name)
    text = N.as_json(F.col(col)) if col else F.col("payload_json")
    got = N.nested_elements(df, F.col(key), text, path[:path.index("*") + 1] if parents else path, key_field, valid=bool(col))
    # a row delivered twice gives the same elements twice; the last value text settles differing ones
    return got.groupBy("row_id", "parent_key", "child_pos").agg(F.max("child_value").alias("child_value"), F.min("parent_pos").alias("parent_pos"))


def p4_found(s: SparkSession, d: str) -> DataFrame:
    parts = [_elements(s, d, n).select(F.lit(n).alias("record_table"), F.col("row_id").alias("record_id"), "parent_key", "child_pos") for n in P4_SOURCES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _flat(df: DataFrame, fields: list[str]) -> list:
    return [F.get_json_object("child_value", f"$.{f}").alias(f) for f in fields]


def p4_methods(s: SparkSession, d: str) -> DataFrame:
    """Methods of java_classes as a flat table; p4_params joins it on (class_id, method_pos)."""
    e = _elements(s, d, "java_classes", parents=True)
    return e.select(F.col("row_id").alias("class_id"), F.col("child_pos").alias("method_pos"), *_flat(e, ["name", "visibility", "return_type", "route_path"]))


def p4_params(s: SparkSession, d: str) -> DataFrame:
    e = _elements(s, d, "java_classes")
    return e.select(F.col("row_id").alias("class_id"), F.col("parent_key").cast("int").alias("method_pos"), F.col("child_pos").alias("param_pos"), *_flat(e, ["name", "type"]))


def p4_arguments(s: SparkSession, d: str) -> DataFrame:
    e = _elements(s, d, "graphql_types")
    return e.select(F.col("row_id").alias("type_id"), F.col("parent_key").cast("int").alias("field_pos"), F.col("child_pos").alias("arg_pos"), *_flat(e, ["name", "type", "default_value"]))


def p4_symbols(s: SparkSession, d: str) -> DataFrame:
    e = _elements(s, d, "publish_payloads", parents=True)
    return e.select(F.col("row_id").alias("payload_id"), F.col("parent_key").alias("node_id"), *_flat(e, ["language", "node_type", "identifier"]))


def p4_symbol_params(s: SparkSession, d: str) -> DataFrame:
    e = _elements(s, d, "publish_payloads")
    return e.select(F.col("row_id").alias("payload_id"), F.col("parent_key").alias("node_id"), "child_pos", *_flat(e, ["name", "type"]))


def _orphans(s: SparkSession, d: str) -> DataFrame:
    t = {n: table(s, d, n) for n in ("code_functions", "library_methods", "stacked_proposals", "heads", "git_commits", "git_trees")}
    refs = O.domain_references(t["code_functions"], t["stacked_proposals"], t["git_commits"])
    return O.orphan_references(refs, O.domain_targets(t["code_functions"], t["library_methods"], t["stacked_proposals"], t["heads"], t["git_trees"]))


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return _orphans(s, d).select("record_table", "record_key", "ref_field", "ref_key")


def p5_report(s: SparkSession, d: str) -> DataFrame:
    return O.orphan_report(_orphans(s, d))


QUERIES = {f.__name__: f for f in (p3_found, p3_paths, p3_descendants, p3_loops, p3_back_edges, p4_found, p4_methods, p4_params, p4_arguments, p4_symbols, p4_symbol_params, p5_found, p5_report)}

_NORM = "lower(regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', ''))"
_NONE = "('', 'root', 'universe-main', '0000000000000000000000000000000000000000')"

_P3 = f"""
WITH RECURSIVE raw AS (
  SELECT 'stacked_proposals' AS record_table, {_NORM.format('change_id')} AS k, {_NORM.format('parent_change_id')} AS p,
         row_number() OVER (PARTITION BY {_NORM.format('change_id')} ORDER BY updated_at DESC NULLS LAST, ingested_at DESC NULLS LAST, {_NORM.format('parent_change_id')} DESC NULLS LAST) AS rn
  FROM stacked_proposals
  UNION ALL
  SELECT 'git_commits', {_NORM.format('commit_hash')}, {_NORM.format('parent_hash')},
         row_number() OVER (PARTITION BY {_NORM.format('commit_hash')} ORDER BY committed_at DESC NULLS LAST, ingested_at DESC NULLS LAST, {_NORM.format('parent_hash')} DESC NULLS LAST)
  FROM git_commits
), one AS (SELECT record_table, k, CASE WHEN p IN {_NONE} THEN NULL ELSE p END AS p FROM raw WHERE rn = 1 AND k IS NOT NULL AND k <> ''),
links AS (SELECT a.record_table, a.k, b.k AS p FROM one a LEFT JOIN one b ON a.record_table = b.record_table AND a.p = b.k),
walk AS (
  SELECT record_table, k, p AS a FROM links WHERE p IS NOT NULL
  UNION
  SELECT w.record_table, w.k, l.p FROM walk w JOIN links l ON l.record_table = w.record_table AND l.k = w.a WHERE l.p IS NOT NULL
), loops AS (SELECT record_table, k FROM walk WHERE k = a),
info AS (
  SELECT l.record_table, l.k, l.p, count(w.a) AS n, min(CASE WHEN lo.k IS NOT NULL THEN w.a END) AS low,
         max(CASE WHEN r.p IS NULL THEN w.a END) AS top
  FROM links l LEFT JOIN walk w ON w.record_table = l.record_table AND w.k = l.k
  LEFT JOIN loops lo ON lo.record_table = w.record_table AND lo.k = w.a
  LEFT JOIN links r ON r.record_table = w.record_table AND r.k = w.a
  GROUP BY ALL
)
"""

_DOMAIN = f"""
WITH refs0 AS (
  SELECT 'code_functions' AS record_table, CAST(function_id AS VARCHAR) AS record_key, 'called_methods' AS ref_field, 'method' AS domain,
         trim(regexp_replace(trim(c), '\\(\\)$', '')) AS ref_key, ingested_at AS arr
  FROM (SELECT function_id, ingested_at, unnest(called_methods) AS c FROM code_functions WHERE language = 'java')
  UNION ALL SELECT 'stacked_proposals', {_NORM.format('change_id')}, 'parent_change_id', 'change', {_NORM.format('parent_change_id')}, ingested_at FROM stacked_proposals
  UNION ALL SELECT 'stacked_proposals', {_NORM.format('change_id')}, 'universe_id', 'universe', universe_id, ingested_at FROM stacked_proposals
  UNION ALL SELECT 'git_commits', {_NORM.format('commit_hash')}, 'tree_hash', 'tree', {_NORM.format('tree_hash')}, ingested_at FROM git_commits
), refs AS (
  SELECT record_table, record_key, ref_field, domain, ref_key, min(arr) AS arr FROM refs0
  WHERE ref_key IS NOT NULL AND lower(trim(ref_key)) NOT IN {_NONE} GROUP BY ALL
), targets AS (
  SELECT 'method' AS domain, identifier AS key, ingested_at AS since, deleted_at AS until FROM code_functions WHERE language = 'java'
  UNION ALL SELECT 'method', identifier, TIMESTAMPTZ '1000-01-01 00:00:00+00', NULL FROM library_methods
  UNION ALL SELECT 'change', {_NORM.format('change_id')}, ingested_at, deleted_at FROM stacked_proposals
  UNION ALL SELECT 'universe', universe_id, ingested_at, deleted_at FROM heads
  UNION ALL SELECT 'tree', {_NORM.format('tree_hash')}, ingested_at, deleted_at FROM git_trees
), judged AS (
  SELECT r.record_table, r.record_key, r.ref_field, r.ref_key, r.arr, count(t.key) AS n_any,
         count(*) FILTER (WHERE t.since <= r.arr) AS n_before, count(*) FILTER (WHERE t.since <= r.arr AND (t.until IS NULL OR t.until > r.arr)) AS n_there
  FROM refs r LEFT JOIN targets t ON t.domain = r.domain AND t.key = r.ref_key GROUP BY ALL
)
"""

_PARAMS = "SELECT class_id, m_pos, unnest(m.params) AS p, generate_subscripts(m.params, 1) - 1 AS p_pos FROM (SELECT class_id, unnest(methods) AS m, generate_subscripts(methods, 1) - 1 AS m_pos FROM java_classes)"
_ARGS = "SELECT type_id, f_pos, unnest(f.arguments) AS a, generate_subscripts(f.arguments, 1) - 1 AS a_pos FROM (SELECT type_id, unnest(fields) AS f, generate_subscripts(fields, 1) - 1 AS f_pos FROM graphql_types)"
_SYMBOLS = """
SELECT payload_id, CASE WHEN json_type(s) = 'OBJECT' THEN k ELSE coalesce(json_extract_string(v, '$.node_id'), k) END AS node_id, v FROM (
  SELECT payload_id, s, unnest(CASE WHEN json_type(s) = 'OBJECT' THEN json_keys(s) ELSE CAST(range(CAST(json_array_length(s) AS BIGINT)) AS VARCHAR[]) END) AS k,
         unnest(json_extract(s, '$.*') || json_extract(s, '$[*]')) AS v
  FROM (SELECT payload_id, json_extract(payload_json, '$.symbols') AS s FROM publish_payloads WHERE json_valid(payload_json)) WHERE json_type(s) IN ('OBJECT', 'ARRAY'))
WHERE json_type(v) = 'OBJECT'"""
_SYMBOL_PARAMS = f"""
SELECT payload_id, node_id, unnest(CASE WHEN json_type(p) = 'ARRAY' THEN json_extract(p, '$[*]') ELSE [p] END) AS e,
       unnest(CASE WHEN json_type(p) = 'ARRAY' THEN range(CAST(json_array_length(p) AS BIGINT)) ELSE [0] END) AS pos
FROM (SELECT payload_id, node_id, json_extract(a, '$.params') AS p FROM (
  SELECT payload_id, node_id, CASE WHEN json_type(a) = 'OBJECT' THEN CAST(a AS VARCHAR)
      WHEN json_valid(a ->> '$') THEN a ->> '$' WHEN json_type(a) = 'VARCHAR' THEN decode(from_base64(a ->> '$')) END AS a
  FROM (SELECT payload_id, node_id, json_extract(v, '$.ast_payload') AS a FROM ({_SYMBOLS}))))
WHERE json_type(p) IN ('ARRAY', 'OBJECT')"""

SQL = {
    "p3_found": _P3 + "SELECT record_table, k AS node_key, CASE WHEN low IS NOT NULL THEN low ELSE coalesce(top, k) END AS root_key, CAST(CASE WHEN low IS NOT NULL THEN -1 ELSE n END AS INTEGER) AS depth FROM info",
    "p3_descendants": _P3 + ", n AS (SELECT record_table, k, n FROM info WHERE low IS NULL) SELECT w.record_table, w.a AS ancestor_key, w.k AS descendant_key, CAST(x.n - y.n AS INTEGER) AS distance FROM walk w JOIN n x ON x.record_table = w.record_table AND x.k = w.k JOIN n y ON y.record_table = w.record_table AND y.k = w.a",
    "p3_loops": _P3 + "SELECT i.record_table, i.low AS loop_key, i.k AS node_key, i.p AS next_key FROM info i JOIN loops l ON l.record_table = i.record_table AND l.k = i.k",
    "p3_back_edges": _P3 + "SELECT i.record_table, i.k AS node_key, i.p AS parent_key FROM info i WHERE i.low = i.k",
    "p3_paths": _P3 + ", n AS (SELECT record_table, k, n, low FROM info), up AS (SELECT w.record_table, w.k, string_agg(w.a, '/' ORDER BY y.n) AS path FROM walk w JOIN n y ON y.record_table = w.record_table AND y.k = w.a GROUP BY ALL) SELECT x.record_table, x.k AS node_key, CASE WHEN x.low IS NULL THEN coalesce(u.path || '/', '') || x.k END AS path, l.k IS NOT NULL AS on_loop FROM n x LEFT JOIN up u ON u.record_table = x.record_table AND u.k = x.k LEFT JOIN loops l ON l.record_table = x.record_table AND l.k = x.k",
    "p4_found": f"SELECT DISTINCT 'java_classes' AS record_table, class_id AS record_id, CAST(m_pos AS VARCHAR) AS parent_key, CAST(p_pos AS INTEGER) AS child_pos FROM ({_PARAMS}) WHERE p IS NOT NULL UNION ALL SELECT DISTINCT 'graphql_types', type_id, CAST(f_pos AS VARCHAR), CAST(a_pos AS INTEGER) FROM ({_ARGS}) WHERE a IS NOT NULL UNION ALL SELECT DISTINCT 'publish_payloads', payload_id, node_id, CAST(pos AS INTEGER) FROM ({_SYMBOL_PARAMS}) WHERE json_type(e) <> 'NULL'",
    "p4_methods": "SELECT DISTINCT class_id, CAST(m_pos AS INTEGER) AS method_pos, m.name AS name, m.visibility AS visibility, m.return_type AS return_type, m.route_path AS route_path FROM (SELECT class_id, unnest(methods) AS m, generate_subscripts(methods, 1) - 1 AS m_pos FROM java_classes) WHERE m IS NOT NULL",
    "p4_params": f"SELECT DISTINCT class_id, CAST(m_pos AS INTEGER) AS method_pos, CAST(p_pos AS INTEGER) AS param_pos, p.name AS name, p.type AS type FROM ({_PARAMS}) WHERE p IS NOT NULL",
    "p4_arguments": f"SELECT DISTINCT type_id, CAST(f_pos AS INTEGER) AS field_pos, CAST(a_pos AS INTEGER) AS arg_pos, a.name AS name, a.type AS type, a.default_value AS default_value FROM ({_ARGS}) WHERE a IS NOT NULL",
    "p4_symbols": f"SELECT DISTINCT payload_id, node_id, v ->> '$.language' AS language, v ->> '$.node_type' AS node_type, v ->> '$.identifier' AS identifier FROM ({_SYMBOLS})",
    "p4_symbol_params": f"SELECT DISTINCT payload_id, node_id, CAST(pos AS INTEGER) AS child_pos, e ->> '$.name' AS name, e ->> '$.type' AS type FROM ({_SYMBOL_PARAMS}) WHERE json_type(e) <> 'NULL'",
    "p5_found": _DOMAIN + "SELECT record_table, record_key, ref_field, ref_key FROM judged WHERE n_there = 0",
    "p5_report": _DOMAIN + "SELECT record_table, ref_field, strftime(arr AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n_orphans, count(*) FILTER (WHERE n_any = 0) AS n_never_came, count(*) FILTER (WHERE n_any > 0 AND n_before = 0) AS n_came_later, count(*) FILTER (WHERE n_before > 0) AS n_deleted FROM judged WHERE n_there = 0 GROUP BY ALL",
}
