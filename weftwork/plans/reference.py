"""Queries over graphs, provenance, snapshots, event logs, vectors, rules and scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.functions.common import scratch, table
from weftwork.operators import codecs as CD
from weftwork.operators import collab as CO
from weftwork.operators import eventlog as EL
from weftwork.operators import graph as G
from weftwork.operators import hierarchy as H
from weftwork.operators import identity as ID
from weftwork.operators import linker as L
from weftwork.operators import provenance as P
from weftwork.operators import rules as R
from weftwork.operators import scoring as S
from weftwork.operators import vectors as V
from weftwork.operators import versions as VS
from weftwork.plans import adapters as A
from weftwork.sources import blobs as B
from weftwork.streaming import jobs as ST

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _with(*names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{n.lower()} AS ({getattr(A, n)})" for n in names) + " "


# ---- scans -------------------------------------------------------------------------------------------------------

@query(_with("NODES") + "SELECT node_id, identifier FROM nodes WHERE language = 'customer' AND node_type = 'BUILDING'")
def scan_nodes(s, d):
    return G.scan_nodes(A.nodes(s, d), "customer", "BUILDING").select("node_id", "identifier")


@query(_with("NODES") + "SELECT node_id, language, node_type, identifier FROM nodes WHERE node_id = 'C:42'")
def point_lookup(s, d):
    return A.nodes(s, d).filter("node_id = 'C:42'")


@query(_with("EDGES") + "SELECT source_id, target_id, edge_type FROM edges WHERE target_id = 'N:7' AND edge_type = 'DEPLOYS_TO'")
def scan_edges(s, d):
    return G.scan_edges(A.edges(s, d), target="N:7", edge_type="DEPLOYS_TO")


@query(_with("LINEAGE") + "SELECT record_id, agent, model FROM lineage WHERE node_id = 'C:77'")
def lineage_by_node(s, d):
    return A.lineage(s, d).filter("node_id = 'C:77'").select("record_id", "agent", "model")


_HEADS = "SELECT universe_id, max({'u': updated_at, 'i': ingested_at, 'h': head_manifest_hash, 'p': parent_universe_id}) AS r FROM heads WHERE deleted_at IS NULL GROUP BY 1"


@query(f"SELECT universe_id, r.h AS head_manifest_hash, r.p AS parent_universe_id FROM ({_HEADS})")
def list_heads(s, d):
    h = table(s, d, "heads").filter("deleted_at is null")
    return VS.latest_by(h, ["universe_id"], ["updated_at", "ingested_at"], ["head_manifest_hash", "parent_universe_id"])


@query(f"SELECT universe_id, r.h AS head_manifest_hash, r.p AS parent_universe_id FROM ({_HEADS}) WHERE universe_id = 'main'")
def get_head(s, d):
    return list_heads(s, d).filter("universe_id = 'main'")


_CHANGES = "SELECT 'n' || (user_id % 500) AS k, max({'e': event_id, 't': event_type, 'v': value}) AS r FROM events GROUP BY 1"


@query(f"SELECT k AS node_id, r.e AS event_id, r.v AS value FROM ({_CHANGES}) WHERE r.t <> 'error'")
def upsert_delete_node(s, d):
    """Last write per key; a deletion as last write removes it."""
    log = table(s, d, "events").selectExpr("concat('n', user_id % 500) AS node_id", "event_id", "event_type", "value")
    return VS.latest_by(log, ["node_id"], ["event_id"], ["event_id", "event_type", "value"]).filter("event_type <> 'error'").select("node_id", "event_id", "value")


# ---- blobs -------------------------------------------------------------------------------------------------------

def _blobs(s, d):
    return B.put(table(s, d, "documents"), "text")


@query("SELECT sha256(text) AS hash, max(octet_length(encode(text))) AS size FROM documents WHERE text IS NOT NULL GROUP BY 1")
def blob_put(s, d):
    return _blobs(s, d).select("hash", F.col("size").cast("bigint").alias("size"))


@query("SELECT count(DISTINCT sha256(text)) AS n_blobs, CAST(sum(n) AS BIGINT) AS n_bytes FROM (SELECT DISTINCT text, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL)")
def blob_size(s, d):
    return _blobs(s, d).agg(F.count("*").alias("n_blobs"), F.sum("size").cast("bigint").alias("n_bytes"))


@query("SELECT sha256(text) AS hash FROM documents WHERE text IS NOT NULL AND component = 'hub-core' GROUP BY 1")
def blob_get(s, d):
    b, want = _blobs(s, d), table(s, d, "documents").filter("component = 'hub-core' and text is not null").select(F.sha2("text", 256).alias("hash"))
    return b.join(want, "hash", "left_semi").filter(F.sha2("content", 256) == F.col("hash")).select("hash")


@query("SELECT sha256(text) AS hash FROM documents WHERE text LIKE '%```%' GROUP BY 1")
def blob_verify(s, d):
    """A store whose texts with code blocks were cut short: their hashes no longer agree."""
    bad = _blobs(s, d).withColumn("content", F.when(F.contains("content", F.lit("```")), F.expr("substr(content, 2)")).otherwise(F.col("content")))
    return B.corrupt(bad)


@query("SELECT count(DISTINCT sha256(text)) FILTER (WHERE k) AS kept, count(DISTINCT sha256(text)) FILTER (WHERE NOT k) AS removed FROM (SELECT text, bool_or(component = 'hub-core') IS NOT DISTINCT FROM true AS k FROM documents WHERE text IS NOT NULL GROUP BY text)")
def blob_prune(s, d):
    keep = table(s, d, "documents").filter("component = 'hub-core' and text is not null").select(F.sha2("text", 256).alias("hash"))
    kept, gone = B.prune(_blobs(s, d), keep)
    both = kept.select(F.lit(1).alias("k")).unionByName(gone.select(F.lit(0).alias("k")))
    return both.agg(F.count_if(F.col("k") == 1).alias("kept"), F.count_if(F.col("k") == 0).alias("removed"))


# ---- filters -----------------------------------------------------------------------------------------------------

@query(_with("NODES", "LINEAGE") + "SELECT DISTINCT n.node_id, n.node_type FROM nodes n JOIN lineage l USING (node_id) WHERE l.agent = '1-URGENT' AND l.model = 'F' AND l.ts >= TIMESTAMP '1995-01-01' AND l.ts <= TIMESTAMP '1997-12-31' AND contains(lower(l.prompt), 'order 1')")
def audit_filter(s, d):
    return P.audit_filter(A.nodes(s, d), A.lineage(s, d), agent="1-URGENT", model="F", since="1995-01-01", until="1997-12-31", keyword="Order 1").select("node_id", "node_type")


@query("""WITH p AS (SELECT DISTINCT entry_path AS path FROM git_trees WHERE entry_path IS NOT NULL)
SELECT path FROM p WHERE CASE WHEN regexp_full_match(path, 'vector/[^/]*\\.kt') THEN false WHEN regexp_full_match(split_part(path, '/', -1), '[^/]*\\.kt') THEN true
WHEN list_contains(string_split(path, '/'), 'edge') THEN true WHEN path LIKE 'queue%' AND path LIKE '%.zig' THEN true ELSE false END""")
def ignore_path(s, d):
    p = table(s, d, "git_trees").filter("entry_path is not null").select(F.col("entry_path").alias("path")).distinct()
    return p.filter(R.ignored(F.col("path"), F.lit(False), ["# sources", "queue/**.zig", "edge", "*.kt", "!/vector/*.kt"]))


@query(r"""WITH l AS (SELECT command_id AS record_id, unnest(string_split(stdout, chr(10))) AS line, generate_subscripts(string_split(stdout, chr(10)), 1) AS line_no FROM (SELECT DISTINCT command_id, stdout FROM command_results)),
k AS (SELECT record_id, line_no, line, unnest(['Google AI / GCP API Key', 'AWS Access Key ID', 'GitHub Token', 'Slack Token', 'Private Key', 'Credential Assignment']) AS type,
unnest(['AIza[0-9A-Za-z_-]{35}', 'AKIA[0-9A-Z]{16}', 'gh[pousr]_[0-9a-zA-Z]{36}', 'xox[baprs]-[0-9a-zA-Z]{10,48}', '-----BEGIN ([A-Z ]+ )?PRIVATE KEY-----', '(?i)(api_key|apikey|secret_key|auth_token|client_secret|password)\s*[:=]\s*["''][^"'']{8,}["'']']) AS p FROM l WHERE NOT contains(line, 'allow-secret'))
SELECT record_id, CAST(line_no AS INTEGER) AS line_no, type FROM k WHERE regexp_matches(line, p) AND (type <> 'Credential Assignment' OR NOT regexp_matches(line, '["''](\$\{|var\.)|dummy|secret-token'))""")
def secret_scan(s, d):
    return R.secret_lines(table(s, d, "command_results").select("command_id", "stdout").distinct(), "command_id", "stdout")


@query("SELECT DISTINCT component FROM documents WHERE contains(component, 'hub') OR lang = 'de' AND component IS NOT NULL")
def component_filter(s, d):
    return table(s, d, "documents").filter((F.contains("component", F.lit("hub")) | (F.col("lang") == "de")) & F.col("component").isNotNull()).select("component").distinct()


@query("SELECT DISTINCT file_id, lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) AS ext FROM source_files WHERE lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) IN ('java', 'kt', 'rs', 'swift', 'zig')")
def supports_ext(s, d):
    from weftwork.sources.files import classify

    f = table(s, d, "source_files")
    return f.filter(classify(F.col("file_path"))).select("file_id", F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1)).alias("ext")).distinct()


# ---- links -------------------------------------------------------------------------------------------------------

def _symbols(df, node_id, language, node_type, identifier, metadata="map()", payload="'{}'"):
    m = "cast(map() AS map<string,string>)" if metadata == "map()" else metadata
    return df.selectExpr(f"{node_id} AS node_id", f"'{language}' AS language", f"'{node_type}' AS node_type", f"{identifier} AS identifier", f"{m} AS metadata", f"{payload} AS payload").dropDuplicates(["node_id"])


def _routes(s, d):
    m = table(s, d, "java_classes").select("class_id", F.posexplode("methods").alias("pos", "m")).filter("m.route_path is not null")
    return _symbols(m, "concat('route-', class_id, '-', pos)", "java", "RouteBinding", "concat('c', class_id, ':GET ', m.route_path)")


def _callers(s, d):
    f = table(s, d, "php_fields").filter("class_name is not null")
    return _symbols(f, "concat('call-', field_id)", "typescript", "ApiClientCall", "concat(class_name, ':GET /v1/', lower(regexp_extract(class_name, '^[A-Z][a-z]+', 0)), '/:id')")


_ROUTES = "SELECT DISTINCT 'route-' || class_id || '-' || pos AS target_id, m.route_path AS rp FROM (SELECT class_id, unnest(methods) AS m, generate_subscripts(methods, 1) - 1 AS pos FROM java_classes) WHERE m.route_path IS NOT NULL"
_CALLERS = "SELECT DISTINCT 'call-' || field_id AS source_id, '/v1/' || lower(regexp_extract(class_name, '^[A-Z][a-z]+')) || '/:id' AS cp FROM php_fields WHERE class_name IS NOT NULL"
_NORMP = "regexp_replace(trim({0}, '/'), '\\{{[a-zA-Z0-9_]+\\}}|:[a-zA-Z0-9_]+', '{{param}}', 'g')"


@query(f"SELECT c.source_id, r.target_id, c.cp AS consumer_endpoint, r.rp AS backend_endpoint FROM ({_CALLERS}) c JOIN ({_ROUTES}) r ON {_NORMP.format('c.cp')} = {_NORMP.format('r.rp')}")
def link_consumes_api(s, d):
    e = L.consumes_api(_callers(s, d), _routes(s, d))
    return e.select("source_id", "target_id", e.metadata["consumer_endpoint"].alias("consumer_endpoint"), e.metadata["backend_endpoint"].alias("backend_endpoint"))


def _accessors(s, d):
    t = table(s, d, "git_trees").filter("entry_path is not null")
    return _symbols(t, "concat('acc-', tree_hash)", "java", "FunctionDecl", "entry_path", payload="concat('{\"sql_tables\": [\"', replace(regexp_extract(entry_path, '^([^.]*)', 1), '/', '_'), '\"]}')")


def _tables(s, d):
    return _symbols(table(s, d, "sql_tables").filter("table_name is not null"), "concat('tbl-', table_id)", "sql", "CreateTableStatement", "concat('table:', table_name)", "map('table_name', concat(coalesce(schema_name, 'public'), '.', table_name))")


@query("SELECT DISTINCT 'acc-' || tree_hash AS source_id, 'tbl-' || table_id AS target_id FROM (SELECT tree_hash, any_value(entry_path) AS entry_path FROM git_trees WHERE entry_path IS NOT NULL GROUP BY 1) g JOIN sql_tables t ON lower(replace(regexp_extract(entry_path, '^([^.]*)', 1), '/', '_')) = lower(table_name)")
def link_queries_table(s, d):
    return L.queries_table(_accessors(s, d), _tables(s, d)).select("source_id", "target_id")


def _impls(s, d):
    return _symbols(table(s, d, "java_classes").filter("class_name is not null"), "concat('cls-', class_id)", "java", "ClassDecl", "class_name")


def _protos(s, d):
    return _symbols(table(s, d, "php_fields").filter("class_name is not null").select("class_name").distinct(), "concat('rpc-', class_name)", "protobuf", "RPCMethod", "concat('rpc:lane.', class_name)")


@query("SELECT DISTINCT 'cls-' || class_id AS source_id, 'rpc-' || p.class_name AS target_id FROM (SELECT DISTINCT class_id, class_name FROM java_classes WHERE class_name IS NOT NULL) j JOIN (SELECT DISTINCT class_name FROM php_fields WHERE class_name IS NOT NULL) p ON contains(lower(j.class_name), lower(p.class_name))")
def link_implements_rpc(s, d):
    return L.implements_rpc(_impls(s, d), _protos(s, d)).select("source_id", "target_id")


def _components(s, d):
    return table(s, d, "graphql_types").filter("component is not null").selectExpr("concat('cmp-', component) AS component_id", "component AS name", "'service' AS type").distinct()


def _resources(s, d):
    return _symbols(table(s, d, "source_files").filter("file_path is not null"), "concat('res-', file_id)", "hcl", "ResourceBlock", "file_path")


@query("SELECT DISTINCT 'cmp-' || component AS source_id, 'res-' || file_id AS target_id FROM (SELECT DISTINCT component FROM graphql_types WHERE component IS NOT NULL) c JOIN (SELECT DISTINCT file_id, file_path FROM source_files WHERE file_path IS NOT NULL) f ON contains(lower(replace(file_path, '-', '_')), lower(replace(component, '-', '_')))")
def link_deploys_to(s, d):
    return L.deploys_to(_components(s, d), _resources(s, d)).select("source_id", "target_id")


def _env_sources(s, d):
    f = table(s, d, "php_fields").filter("field_name is not null")
    pay = "concat('{\"block_type\": \"resource\", \"nested_blocks\": [{\"block_type\": \"env\", \"attributes\": {\"name\": {\"value\": \"', upper(field_name), '\"}, \"value\": {\"value\": \"', class_name, '\"}}, \"nested_blocks\": []}]}')"
    return _symbols(f, "concat('env-', field_id)", "hcl", "ResourceBlock", "class_name", payload=pay)


def _env_readers(s, d):
    f = table(s, d, "php_fields").filter("field_name is not null")
    return _symbols(f, "concat('use-', field_id)", "php", "FunctionDecl", "field_name", payload="concat('{\"env_vars_accessed\": [\"', upper(field_name), '\"]}')")


@query("SELECT DISTINCT 'env-' || a.field_id AS source_id, 'use-' || b.field_id AS target_id, upper(a.field_name) AS env_var FROM php_fields a JOIN php_fields b ON upper(a.field_name) = upper(b.field_name)")
def link_binds_env(s, d):
    e = L.binds_env(_env_sources(s, d), _env_readers(s, d))
    return e.select("source_id", "target_id", e.metadata["env_var"].alias("env_var")).distinct()


def _workspace(s, d):
    parts = [_routes(s, d), _callers(s, d), _accessors(s, d), _tables(s, d), _protos(s, d), _resources(s, d), _env_sources(s, d), _env_readers(s, d)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return L.link(out, _components(s, d))


@query()
def link_workspace(s, d):
    return _workspace(s, d).select("source_id", "target_id", "edge_type", "edge_hash")


_API_EDGES = f"""SELECT source_id, target_id, sha256('cross_boundary_edge:v1' || chr(10) || 'source:' || source_id || chr(10) || 'target:' || target_id || chr(10) || 'type:CONSUMES_API' || chr(10) || 'contract_schema_id:' || chr(10) ||
'metadata:backend_endpoint=' || rp || ';consumer_endpoint=' || cp || ';http_method=GET' || chr(10)) AS edge_hash, rp FROM ({_CALLERS}) c JOIN ({_ROUTES}) r ON {_NORMP.format('c.cp')} = {_NORMP.format('r.rp')}"""


@query(f"SELECT source_id, target_id, edge_hash FROM ({_API_EDGES})")
def edge_hashes(s, d):
    return L.with_hash(L.consumes_api(_callers(s, d), _routes(s, d))).select("source_id", "target_id", "edge_hash")


@query(f"""WITH e AS ({_API_EDGES}), keep AS (SELECT DISTINCT 'c' || split_part(target_id, '-', 2) || ':GET ' || rp AS identifier FROM (SELECT target_id, rp FROM ({_ROUTES})) WHERE length(target_id) % 2 = 0)
SELECT source_id, target_id, 'CONSUMES_API' AS edge_type, 'ROUTE_REMOVED' AS breakage, 'BREAKING' AS severity FROM e
WHERE NOT (length(target_id) % 2 = 0) AND 'c' || split_part(target_id, '-', 2) || ':GET ' || rp NOT IN (SELECT identifier FROM keep)""")
def contract_breakage(s, d):
    """The routes with an id of odd length are withdrawn; calls to them break unless a route of the same name stays."""
    routes, calls = _routes(s, d), _callers(s, d)
    left = routes.filter("length(node_id) % 2 = 0")
    old, new = L.with_hash(L.consumes_api(calls, routes)), L.with_hash(L.consumes_api(calls, left))
    return L.breakages(old, new, routes, left)


@query(f"SELECT source_id, target_id FROM ({_API_EDGES}) WHERE NOT (cp LIKE '/v1/blob/%' OR source_id LIKE 'call-1%')".replace("AS edge_hash, rp FROM", "AS edge_hash, rp, cp FROM"))
def edge_filter(s, d):
    e = L.consumes_api(_callers(s, d), _routes(s, d))
    e = e.selectExpr("*", "source_id AS source_path", "target_id AS target_path", "source_id AS source_identifier", "target_id AS target_identifier")
    rules = [R.parse_edge_rule(x) for x in ("edge: ignore CONSUMES_API where endpoint=\"/v1/blob/**\"", "ignore * where source_symbol=call-1*")]
    return R.filter_edges(e, rules).select("source_id", "target_id")


# ---- snapshots ---------------------------------------------------------------------------------------------------

def _ab(s, d):
    m = A.manifests(s, d)
    return m.filter("universe_id = 'a'"), m.filter("universe_id = 'b'")


_M = _with("MANIFESTS")


@query(_M + ", a AS (SELECT * FROM manifests WHERE universe_id = 'a'), b AS (SELECT * FROM manifests WHERE universe_id = 'b') SELECT 'added' AS change, component_id FROM b WHERE component_id NOT IN (SELECT component_id FROM a) UNION ALL SELECT 'removed', component_id FROM a WHERE component_id NOT IN (SELECT component_id FROM b)")
def universe_diff(s, d):
    return VS.set_diff(*_ab(s, d), ["component_id"])


@query(_with("EDGES") + """, a AS (SELECT DISTINCT source_id, target_id, edge_type, CAST(split_part(source_id, ':', 2) AS BIGINT) AS n FROM edges),
b AS (SELECT source_id, CASE WHEN n % 5 = 0 THEN target_id || '~' ELSE target_id END AS target_id, edge_type FROM a WHERE n % 7 <> 0)
SELECT 'added' AS change, * FROM (SELECT * FROM b EXCEPT SELECT source_id, target_id, edge_type FROM a) UNION ALL SELECT 'removed', * FROM (SELECT source_id, target_id, edge_type FROM a EXCEPT SELECT * FROM b)""")
def edge_diff(s, d):
    """All edges of all types against a later version: every seventh source has lost its edges, every fifth points elsewhere."""
    a, n = A.edges(s, d), F.split("source_id", ":")[1].cast("bigint")
    b = a.filter(n % 7 != 0).withColumn("target_id", F.when(n % 5 == 0, F.concat("target_id", F.lit("~"))).otherwise(F.col("target_id")))
    return VS.set_diff(a, b, ["source_id", "target_id", "edge_type"])


@query(_M + ", a AS (SELECT component_name AS k, max(component_id) AS v FROM manifests WHERE universe_id = 'a' GROUP BY 1), b AS (SELECT component_name AS k, max(component_id) AS v FROM manifests WHERE universe_id = 'b' GROUP BY 1) SELECT coalesce(a.k, b.k) AS component_name, CASE WHEN a.k IS NULL THEN 'ADDED' WHEN b.k IS NULL THEN 'REMOVED' ELSE 'MODIFIED' END AS change FROM a FULL OUTER JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def symbol_diff(s, d):
    return VS.keyed_diff(*_ab(s, d), "component_name", "component_id")


@query(f"SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'ADDED' WHEN b.name IS NULL THEN 'REMOVED' ELSE 'MODIFIED' END AS change FROM ({A.ACTIVE}) a FULL OUTER JOIN ({A.DESIRED}) b ON a.name = b.name WHERE a.content_hash IS DISTINCT FROM b.content_hash")
def target_drift(s, d):
    want, have = A.deployed(s, d)
    return VS.keyed_diff(have, want, "name", "content_hash")


@query(f"SELECT name, content_hash FROM ({A.DESIRED}) UNION ALL SELECT name, content_hash FROM ({A.ACTIVE}) WHERE name NOT IN (SELECT name FROM ({A.DESIRED}))")
def merge_union(s, d):
    want, have = A.deployed(s, d)
    return VS.merge_branches(want, have, "name", "content_hash")


@query(f"SELECT name, a.content_hash AS value_a, b.content_hash AS value_b FROM ({A.DESIRED}) a JOIN ({A.ACTIVE}) b USING (name) WHERE a.content_hash <> b.content_hash")
def concurrent_mutation(s, d):
    return VS.concurrent_changes(*A.deployed(s, d), "name", "content_hash")


@query("SELECT file_path, max({'t': committed_at, 'i': ingested_at, 'f': file_id}).f AS file_id FROM source_files WHERE file_path IS NOT NULL GROUP BY 1")
def latest_component(s, d):
    return VS.latest_by(table(s, d, "source_files").filter("file_path is not null"), ["file_path"], ["committed_at", "ingested_at"], ["file_id"])


@query("""WITH c AS (SELECT c_custkey, c_mktsegment = 'BUILDING' AND c_name LIKE '%1%' AS k FROM customer), n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT count(*) AS total_components, count(*) FILTER (WHERE k) AS kept_components, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_symbols, CAST(coalesce(sum(n) FILTER (WHERE k), 0) AS BIGINT) AS kept_symbols,
(1 - coalesce(sum(n) FILTER (WHERE k), 0) / sum(n)) * 100 AS saved_pct FROM c LEFT JOIN n ON c_custkey = o_custkey""")
def sparse_pull(s, d):
    c = table(s, d, "customer").selectExpr("c_custkey AS component_id", "c_mktsegment", "c_name")
    return VS.sparse_pull(c, table(s, d, "orders").selectExpr("o_custkey AS component_id"), (F.col("c_mktsegment") == "BUILDING") & F.col("c_name").like("%1%"))


@query("""SELECT class_id, count(*) AS n_methods, string_agg(DISTINCT m.name, ',' ORDER BY m.name) AS methods FROM (SELECT DISTINCT class_id, m, pos FROM (SELECT class_id, unnest(methods) AS m, generate_subscripts(methods, 1) AS pos FROM java_classes)) WHERE m.name IS NOT NULL GROUP BY 1""")
def ast_tree(s, d):
    m = table(s, d, "java_classes").dropDuplicates(["class_id"]).select("class_id", F.explode("methods").alias("m")).filter("m.name is not null")
    return m.groupBy("class_id").agg(F.count("*").alias("n_methods"), F.array_join(F.array_sort(F.collect_set("m.name")), ",").alias("methods"))


# ---- aggregates --------------------------------------------------------------------------------------------------

def _summary_sql(by: str, other: str) -> str:
    return _with("NODES", "LINEAGE") + f"SELECT {by}, count(DISTINCT node_id) AS n_nodes, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, count(DISTINCT session) AS n_sessions, string_agg(DISTINCT {other}, ',' ORDER BY {other}) AS {other}s, min(ts) AS first_ts, max(ts) AS last_ts FROM lineage JOIN nodes USING (node_id) GROUP BY {by}"


@query(_summary_sql("agent", "model"))
def agent_summary(s, d):
    return P.summary(A.nodes(s, d), A.lineage(s, d), "agent", "model")


@query(_summary_sql("model", "agent"))
def model_summary(s, d):
    return P.summary(A.nodes(s, d), A.lineage(s, d), "model", "agent")


_REACH = """, hit AS (SELECT DISTINCT node_id FROM lineage JOIN nodes USING (node_id) WHERE agent = '1-URGENT' AND session = 's-5'),
reach AS (SELECT node_id, 0 AS depth FROM hit UNION SELECT e.target_id, r.depth + 1 FROM reach r JOIN edges e ON e.source_id = r.node_id WHERE r.depth < 6),
best AS (SELECT node_id, min(depth) AS depth FROM reach GROUP BY 1) """


@query(_with("NODES", "EDGES", "LINEAGE") + _REACH + "SELECT count(*) FILTER (WHERE depth = 0) AS direct, count(*) FILTER (WHERE depth > 0) AS downstream, count(*) AS total, count(DISTINCT language) AS n_languages, CAST(count(*) FILTER (WHERE depth = 0) + 1.5 * count(*) FILTER (WHERE depth > 0) + 2.0 * count(DISTINCT language) AS DOUBLE) AS risk FROM best LEFT JOIN nodes USING (node_id)")
def blast_report(s, d):
    """The flagship: what one agent's session produced and what that reaches downstream."""
    r = P.blast_report(A.nodes(s, d), A.edges(s, d), A.lineage(s, d), agent="1-URGENT", session="s-5")
    return r.withColumn("risk", F.col("risk").cast("double"))


@query("WITH RECURSIVE edges AS (" + A.LOOPS + "), r AS (SELECT 'O:7' AS n UNION SELECT e.target_id FROM r JOIN edges e ON e.source_id = r.n) SELECT count(*) AS visited, CAST(least(1.0, 0.1 * count(*)) AS DOUBLE) AS risk FROM r")
def node_blast(s, d):
    return P.node_blast(A.edges(s, d, loops=True), "O:7").withColumn("risk", F.col("risk").cast("double"))


@query("SELECT (SELECT count(DISTINCT universe_id) FROM heads) AS n_universes, (SELECT count(DISTINCT sha256(text)) FROM documents WHERE text IS NOT NULL) AS n_blobs, (SELECT count(DISTINCT lower(trim(change_id))) FROM stacked_proposals) AS n_proposals, (SELECT count(DISTINCT author_did) FROM stacked_proposals) AS n_agents")
def hub_stats(s, d):
    p = table(s, d, "stacked_proposals")
    parts = [("n_universes", table(s, d, "heads").select(F.col("universe_id").alias("x"))), ("n_blobs", table(s, d, "documents").filter("text is not null").select(F.sha2("text", 256).alias("x"))),
             ("n_proposals", p.select(H.norm_key("change_id").alias("x"))), ("n_agents", p.select(F.col("author_did").alias("x")))]
    rows = None
    for name, df in parts:
        one = df.filter("x is not null").distinct().select(F.lit(name).alias("name"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(*[F.count_if(F.col("name") == n).alias(n) for n, _ in parts])


@query(_with("NODES", "LINEAGE") + "SELECT count(*) FILTER (WHERE h) AS with_lineage, count(*) FILTER (WHERE NOT h) AS without_lineage FROM (SELECT node_id, node_id IN (SELECT node_id FROM lineage) AS h FROM nodes)")
def lineage_report(s, d):
    return P.lineage_coverage(A.nodes(s, d), A.lineage(s, d))


@query("SELECT CAST(count(*) AS BIGINT) AS checked, count(*) FILTER (WHERE NOT contains(text, '```')) AS valid, count(*) FILTER (WHERE contains(text, '```')) AS corrupt FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)")
def integrity_report(s, d):
    bad = _blobs(s, d).withColumn("content", F.when(F.contains("content", F.lit("```")), F.expr("substr(content, 2)")).otherwise(F.col("content")))
    ok = F.sha2("content", 256) == F.col("hash")
    return bad.agg(F.count("*").alias("checked"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("corrupt"))


_WEIGHTS = {"SECURITY": .25, "CONTRACT": .20, "PROVENANCE": .15, "INTEGRITY": .15, "QUALITY": .15, "COST": .10}


@query("""WITH f AS (SELECT ['SECURITY','CONTRACT','PROVENANCE','INTEGRITY','QUALITY','COST'][CAST(command_id % 6 AS INT) + 1] AS dimension, CASE WHEN exit_code = 137 THEN 4 WHEN exit_code <> 0 THEN 10 ELSE 0 END AS p FROM (SELECT DISTINCT command_id, exit_code FROM command_results)),
w AS (SELECT unnest(['SECURITY','CONTRACT','PROVENANCE','INTEGRITY','QUALITY','COST']) AS dimension, unnest([.25,.20,.15,.15,.15,.10]) AS weight), g AS (SELECT dimension, sum(p) AS p FROM f GROUP BY 1)
SELECT CAST(sum(weight * greatest(0, 100 - coalesce(p, 0))) AS DOUBLE) AS score, CAST(0 AS BIGINT) AS critical, CASE WHEN sum(weight * greatest(0, 100 - coalesce(p, 0))) >= 90 THEN 'A' WHEN sum(weight * greatest(0, 100 - coalesce(p, 0))) >= 80 THEN 'B' WHEN sum(weight * greatest(0, 100 - coalesce(p, 0))) >= 70 THEN 'C' WHEN sum(weight * greatest(0, 100 - coalesce(p, 0))) >= 60 THEN 'D' ELSE 'F' END AS grade FROM w LEFT JOIN g USING (dimension)""")
def scorecard(s, d):
    c = table(s, d, "command_results").select("command_id", "exit_code").distinct()
    dims = F.array(*[F.lit(k) for k in _WEIGHTS])
    f = c.select(F.get(dims, (F.col("command_id") % 6).cast("int")).alias("dimension"), F.when(F.col("exit_code") == 137, "LOW").when(F.col("exit_code") != 0, "MEDIUM").alias("severity"))
    return S.scorecard(f, _WEIGHTS)


@query("SELECT p_partkey, 0.5 * (p_size / 50.0) + 0.3 * (p_retailprice / 2000) + 0.1 * greatest(0, 1 - (p_size * 30) / 1000.0) + 0.1 * greatest(0, 1 - p_retailprice / 10000) AS score FROM part ORDER BY score DESC, p_partkey LIMIT 20")
def rank_candidates(s, d):
    x = S.composite_score(F.col("p_size") / 50.0, F.col("p_retailprice") / 2000, F.col("p_size") * 30, F.col("p_retailprice"))
    return table(s, d, "part").select("p_partkey", x.alias("score")).orderBy(F.desc("score"), "p_partkey").limit(20)


@query()
def merkle_root(s, d):
    t = table(s, d, "git_trees").select(H.norm_key("tree_hash").alias("h"), F.regexp_extract("entry_path", "^([^/]+)/", 1).alias("dir")).distinct()
    return ID.merkle_roots(t, "dir", "h")


@query(f"SELECT sha256(string_agg(name || ':' || content_hash, ',' ORDER BY name || ':' || content_hash)) AS fingerprint FROM ({A.DESIRED})")
def state_fingerprint(s, d):
    return ID.state_fingerprint(A.deployed(s, d)[0], "name", "content_hash")


@query("SELECT doc_id, sha1('blob ' || octet_length(encode(text)) || chr(0) || text) AS git_hash FROM documents WHERE text IS NOT NULL")
def git_blob_hash(s, d):
    return table(s, d, "documents").filter("text is not null").select("doc_id", ID.git_blob_hash(F.col("text")).alias("git_hash"))


@query("SELECT function_id, sha256('lineage_content:v1' || chr(10) || 'user_id:' || coalesce(owner_name, '') || chr(10) || 'user_prompt:' || coalesce(doc, '') || chr(10) || 'orchestrator_agent_id:' || chr(10) || 'executing_agent_id:' || coalesce(language, '') || chr(10) || 'llm_version:' || chr(10) || 'generation_params:' || chr(10) || 'intent:' || coalesce(identifier, '') || chr(10)) AS h FROM code_functions")
def lineage_hash(s, d):
    e = F.lit("")
    return table(s, d, "code_functions").select("function_id", ID.lineage_content_hash(F.col("owner_name"), F.col("doc"), e, F.col("language"), e, e, F.col("identifier")).alias("h"))


@query("""SELECT function_id, sha256('ast_symbol_node:v1' || chr(10) || 'language:' || coalesce(language, '') || chr(10) || 'node_type:' || coalesce(node_type, '') || chr(10) || 'identifier:' || coalesce(identifier, '') || chr(10)
|| CASE WHEN coalesce(signature, '') <> '' THEN 'signature:' || signature || chr(10) ELSE '' END || CASE WHEN coalesce(doc, '') <> '' THEN 'docstring:' || doc || chr(10) ELSE '' END || CASE WHEN coalesce(visibility, '') <> '' THEN 'visibility:' || visibility || chr(10) ELSE '' END
|| 'payload_sha256:' || sha256(coalesce(body_source, '')) || chr(10) || 'local_dependencies:' || coalesce(array_to_string(list_sort(list_distinct(list_filter(called_methods, lambda x: x <> ''))), ','), '') || chr(10) || 'lineage_hash:' || chr(10)) AS h FROM code_functions""")
def symbol_hash(s, d):
    f = table(s, d, "code_functions")
    deps = ID.dependency_list(F.col("called_methods"), F.lit(None).cast("array<string>"))
    return f.select("function_id", ID.symbol_hash(*[F.col(c) for c in ("language", "node_type", "identifier", "signature", "doc", "visibility")], F.lit(""), F.col("body_source"), deps, F.lit("")).alias("h"))


@query("SELECT doc_id, CAST(greatest(coalesce(list_sum([1 + length(regexp_replace(w, '[^!-/:-@\\[-`{-~]', '', 'g')) + greatest(0, CAST(floor((length(w) - 8) / 4.0) AS INT)) for w in string_split_regex(text, '\\s+') if w <> '']), 0), ceil(octet_length(encode(text)) / 4.0)) AS INTEGER) AS tokens FROM documents WHERE text IS NOT NULL")
def token_estimate(s, d):
    return table(s, d, "documents").filter("text is not null").select("doc_id", S.token_estimate(F.col("text")).alias("tokens"))


# ---- windows and limits ------------------------------------------------------------------------------------------

@query(_with("LINEAGE") + "SELECT node_id, row_number() OVER w - 1 AS hop, record_id, first_value(agent) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS root_agent, last_value(model) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final_model FROM lineage WINDOW w AS (PARTITION BY node_id ORDER BY ts, record_id)")
def ancestry_hops(s, d):
    return P.ancestry_hops(A.lineage(s, d))


@query(_with("LINEAGE") + "SELECT node_id, r.i AS record_id, r.a AS agent FROM (SELECT node_id, max({'t': ts, 'i': record_id, 'a': agent}) AS r FROM lineage GROUP BY 1)")
def lsp_codelens(s, d):
    return P.latest_record(A.lineage(s, d))


@query("SELECT user_id, event_id, CAST(coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prompt_size, CAST(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM (SELECT user_id, event_id, length(props) AS n FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def context_accumulation(s, d):
    return S.running_context(table(s, d, "events").select("user_id", "event_id", F.char_length("props").cast("bigint").alias("n")), "user_id", "event_id", "n")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3")
def last_n_logs(s, d):
    return S.last_n(table(s, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", "event_type")


@query(_with("OPLOG") + "SELECT event_id, universe_id, lag(event_id) OVER (PARTITION BY universe_id ORDER BY event_id) AS parent_event FROM oplog WHERE action = 'COMMIT'")
def commit_parent(s, d):
    return EL.commit_parents(A.oplog(s, d))


@query("SELECT event_type, count(*) AS n, CAST(sum(length(props)) AS BIGINT) AS args_bytes FROM events GROUP BY 1")
def tool_breakdown(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.char_length("props")).cast("bigint").alias("args_bytes"))


# ---- graph -------------------------------------------------------------------------------------------------------

_STARTS = "SELECT 'O:' || o_orderkey AS node_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'"


def _starts(s, d):
    return table(s, d, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").selectExpr("concat('O:', o_orderkey) AS node_id")


@query("WITH RECURSIVE edges AS (" + A.LOOPS + f"), t AS (SELECT node_id, 0 AS depth FROM ({_STARTS}) UNION SELECT e.target_id, t.depth + 1 FROM t JOIN edges e ON e.source_id = t.node_id WHERE t.depth < 8) SELECT node_id, min(depth) AS depth FROM t GROUP BY 1")
def traverse_forward(s, d):
    return G.traverse(A.edges(s, d, loops=True), _starts(s, d), with_path=False).select("node_id", "depth")


@query("WITH RECURSIVE edges AS (" + A.LOOPS + "), t AS (SELECT 'R:1' AS node_id, 0 AS depth UNION SELECT e.source_id, t.depth + 1 FROM t JOIN edges e ON e.target_id = t.node_id WHERE t.depth < 2) SELECT node_id, min(depth) AS depth FROM t GROUP BY 1")
def traverse_backward(s, d):
    start = s.createDataFrame([("R:1",)], "node_id string")
    return G.traverse(A.edges(s, d, loops=True), start, backward=True, max_depth=2, with_path=False).select("node_id", "depth")


@query("WITH RECURSIVE edges AS (" + A.LOOPS + f"), t AS (SELECT node_id, 0 AS depth FROM ({_STARTS}) UNION SELECT e.target_id, t.depth + 1 FROM t JOIN edges e ON e.source_id = t.node_id WHERE t.depth < 2 AND e.edge_type IN ('CALLS', 'DEPLOYS_TO')), b AS (SELECT node_id, min(depth) AS depth FROM t GROUP BY 1) SELECT DISTINCT e.source_id, e.target_id, e.edge_type FROM edges e JOIN b ON b.node_id = e.source_id AND b.depth < 2 WHERE e.edge_type IN ('CALLS', 'DEPLOYS_TO')")
def visited_edges(s, d):
    e, kw = A.edges(s, d, loops=True), {"max_depth": 2, "edge_types": ["CALLS", "DEPLOYS_TO"]}
    return G.visited_edges(e, G.traverse(e, _starts(s, d), **kw), **kw).select("source_id", "target_id", "edge_type")


@query("""WITH o AS (SELECT * FROM orders WHERE o_orderkey = 11), p AS (SELECT 'O:11' AS a, 'C:' || o_custkey AS b, 'N:' || c_nationkey AS c, 'R:' || n_regionkey AS e FROM o JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT unnest([0, 1, 2, 3]) AS step, unnest([a, b, c, e]) AS node_id, unnest([NULL, 'CALLS', 'DEPLOYS_TO', 'DEPENDS_ON']) AS edge_type FROM p""")
def shortest_path(s, d):
    e = A.edges(s, d)
    start = s.createDataFrame([("O:11",)], "node_id string")
    ends = table(s, d, "orders").filter("o_orderkey = 11").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return G.shortest_path(e, start, f"R:{ends.first().n_regionkey}")


@query(_with("EDGES") + "SELECT DISTINCT 'out' AS direction, target_id AS neighbour, edge_type FROM edges WHERE source_id = 'C:5' UNION SELECT 'in', source_id, edge_type FROM edges WHERE target_id = 'C:5'")
def impact(s, d):
    return G.impact(A.edges(s, d), "C:5")


_STACK = "SELECT k, max({'u': updated_at, 'i': ingested_at, 'p': p}).p AS p FROM (SELECT lower(trim(change_id)) AS k, lower(trim(parent_change_id)) AS p, updated_at, ingested_at FROM stacked_proposals) WHERE k <> '' GROUP BY 1"


@query(f"WITH RECURSIVE s AS ({_STACK}), l AS (SELECT k, p FROM s WHERE p IN (SELECT k FROM s) AND p NOT IN ('root', 'universe-main', repeat('0', 40))), t AS (SELECT p AS root, k FROM l UNION SELECT t.root, l.k FROM t JOIN l ON l.p = t.k) SELECT root, k AS change_id FROM t")
def stack_descendants(s, d):
    """The descendants of every change that has any; on a loop a change is its own."""
    below = H.all_descendants(H.proposal_links(table(s, d, "stacked_proposals")))
    return below.select(F.col("ancestor_key").alias("root"), F.col("descendant_key").alias("change_id"))


# ---- event log ---------------------------------------------------------------------------------------------------

@query(_with("OPLOG") + "SELECT event_id, action, entity_id FROM oplog WHERE event_id >= 500 AND universe_id = 'u3' ORDER BY event_id LIMIT 50")
def oplog_events(s, d):
    return EL.events_from(A.oplog(s, d), 500, "u3", 50).select("event_id", "action", "entity_id")


@query(_with("OPLOG") + "SELECT event_id, action, ts_ms FROM oplog WHERE entity_id = 'n42'")
def oplog_history(s, d):
    return EL.history(A.oplog(s, d), "n42").select("event_id", "action", "ts_ms")


_STATE = _with("OPLOG") + ", l AS (SELECT entity_id, max({{'e': event_id, 'a': action, 'p': payload}}) AS r FROM oplog WHERE action IN ('CREATE_NODE', 'UPDATE_NODE', 'DELETE_NODE') {0} GROUP BY 1) SELECT entity_id, r.e AS event_id, r.p AS payload FROM l WHERE r.a <> 'DELETE_NODE'"


@query(_STATE.format(""))
def oplog_replay(s, d):
    return EL.state_at(A.oplog(s, d))


@query(_STATE.format("AND event_id <= 600"))
def oplog_undo_to(s, d):
    return EL.state_at(A.oplog(s, d), 600)


@query(_STATE.format("AND event_id <= (SELECT event_id FROM oplog ORDER BY event_id DESC OFFSET 100 LIMIT 1)"))
def oplog_undo(s, d):
    return EL.undo(A.oplog(s, d), 100)


@query(_with("OPLOG") + "SELECT universe_id, arg_max(payload, event_id) AS head FROM oplog WHERE action = 'SET_UNIVERSE_HEAD' GROUP BY 1")
def heads_replay(s, d):
    return EL.heads_at(A.oplog(s, d))


@query(_with("OPLOG") + "SELECT event_id, payload FROM oplog WHERE action = 'COMMIT' AND universe_id = 'u2' ORDER BY event_id DESC LIMIT 20")
def git_log(s, d):
    return EL.commits(A.oplog(s, d), "u2").select("event_id", "payload")


# ---- vectors -----------------------------------------------------------------------------------------------------

@query("WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS score FROM embeddings, q WHERE label % 2 = 0 ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) DESC, vec_id LIMIT 10")
def vector_search(s, d):
    """One vector's nearest of the even labels."""
    v = A.vectors(s, d)
    q = v.filter("vec_id = 0").first()
    return V.search(v, list(q.vector), where=F.substring("node_type", 2, 9).cast("int") % 2 == 0).select("vec_id", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT q.vec_id AS query, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)
SELECT query, vec_id, round(score, 6) AS score, pos FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS pos FROM s) WHERE pos <= 10""")
def vector_topk(s, d):
    """Every row with an id divisible by 20 as a query against all rows."""
    v = A.vectors(s, d)
    return V.search_many(v, v.filter("vec_id % 20 = 0")).withColumn("score", F.round("score", 6))


_EMBED = """WITH w AS (SELECT doc_id, w FROM (SELECT doc_id, unnest(string_split_regex(lower(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')), '\\s+')) AS w FROM documents) WHERE w <> ''),
b AS (SELECT doc_id, w AS t, 2 AS n FROM w UNION ALL SELECT doc_id, substr(w, i, 3), 1 FROM (SELECT doc_id, w, unnest(range(1, length(w) - 1)) AS i FROM w WHERE length(w) >= 3)),
h AS (SELECT doc_id, CAST(CAST('0x' || substr(sha256(t), 1, 8) AS BIGINT) % 128 AS INTEGER) AS bucket, sum(n) AS n FROM b GROUP BY ALL)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM h"""


@query(_EMBED)
def embed_text(s, d):
    v = V.embed(table(s, d, "documents"), "doc_id", "text")
    return v.select("doc_id", F.posexplode("vector").alias("bucket", "w")).filter("w > 0").select("doc_id", "bucket", F.round("w", 6).alias("weight"))


# ---- collaboration -----------------------------------------------------------------------------------------------

@query("SELECT k AS domain, arg_min(user_id, {'t': ts, 'e': event_id}) AS owner FROM (SELECT 'd' || (user_id % 20) AS k, user_id, ts, event_id FROM events) GROUP BY 1")
def claim_domain(s, d):
    e = table(s, d, "events").selectExpr("concat('d', user_id % 20) AS domain", "user_id", "ts", "event_id")
    return CO.claims(e, "domain", "user_id", ["ts", "event_id"])


@query()
def lease_acquire(s, d):
    e = table(s, d, "events").selectExpr("concat('d', user_id % 20) AS domain", "concat('a', user_id) AS agent", "unix_millis(cast(ts AS timestamp)) AS ts_ms", "event_id")
    return CO.lease_requests(e, 3_600_000)


@query("SELECT user_id, arg_max(event_type, {'s': s, 'e': event_id}) AS event_type FROM (SELECT user_id, event_id, event_type, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS s FROM events) GROUP BY 1")
def crdt_merge_proposal(s, d):
    e = table(s, d, "events")
    m = CO.merge_replicas(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id"], ["event_id", "event_type"], prefer="other")
    return m.select("user_id", "event_type")


@query("SELECT user_id, arg_max(event_type, {'s': s, 'e': event_id}) AS event_type FROM (SELECT user_id, event_id, event_type, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS s FROM events) GROUP BY 1")
def crdt_merge_blackboard(s, d):
    e = table(s, d, "events")
    m = CO.merge_replicas(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id"], ["event_id", "event_type"], prefer="mine")
    return m.select("user_id", "event_type")


@query("SELECT a.o_custkey, a.o_orderkey AS id_a, b.o_orderkey AS id_b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderdate < b.o_orderdate + INTERVAL 7 DAY AND b.o_orderdate < a.o_orderdate + INTERVAL 7 DAY")
def interval_overlap(s, d):
    o = table(s, d, "orders").selectExpr("o_custkey", "o_orderkey AS id", "unix_millis(cast(o_orderdate AS timestamp)) AS start_ms", "unix_millis(cast(o_orderdate AS timestamp)) + 604800000 AS end_ms")
    return CO.overlaps(o, o, "o_custkey", 30 * 86_400_000)


@query("SELECT event_id FROM events WHERE event_type = 'signup' AND (value IS NULL OR epoch_ms(ts) + 600000 > epoch_ms(TIMESTAMP '2024-01-15 00:00:00'))")
def active_leases(s, d):
    e = table(s, d, "events").filter("event_type = 'signup'").selectExpr("event_id", "CASE WHEN value IS NOT NULL THEN unix_millis(cast(ts AS timestamp)) + 600000 END AS expires_ms")
    return CO.active_leases(e, 1_705_276_800_000).select("event_id")


# ---- codecs ------------------------------------------------------------------------------------------------------

@query()
def source_parse(s, d):
    f = table(s, d, "source_files").select("file_id", "file_path", "language", "content").dropDuplicates(["file_id"])
    return CD.parse_sources(f, F.col("file_id"), F.col("file_path"), F.col("language"), F.col("content")).select("record_id", "language", "node_type", "identifier", "line_no")


@query(r"""WITH t AS (SELECT DISTINCT table_id, regexp_replace(raw_ddl, '--[^\n]*', '', 'g') AS raw_ddl FROM sql_tables), b AS (SELECT table_id, regexp_extract(raw_ddl, 'CREATE TABLE (\w+) \(', 1) AS table_name, regexp_extract(raw_ddl, 'CREATE TABLE \w+ \(\n(.*?)\n\);', 1, 's') AS body FROM t),
c AS (SELECT table_id, table_name, unnest(string_split_regex(body, ',\s*\n')) AS col, generate_subscripts(string_split_regex(body, ',\s*\n'), 1) - 1 AS pos FROM b WHERE body <> '')
SELECT table_id AS record_id, table_name, CAST(pos AS INTEGER) AS pos, regexp_extract(col, '^\s*(\w+)', 1) AS column_name, regexp_extract(col, '^\s*\w+ (\w+(\([^)]*\))?)', 1) AS data_type, contains(col, 'PRIMARY KEY') AS is_key,
contains(col, 'PRIMARY KEY') OR contains(col, 'NOT NULL') AS not_null, nullif(regexp_extract(col, 'DEFAULT (\S+)', 1), '') AS default_value FROM c""")
def sql_ddl_columns(s, d):
    return CD.ddl_columns(table(s, d, "sql_tables").select("table_id", "raw_ddl").distinct(), F.col("table_id"), F.col("raw_ddl")).select("record_id", "table_name", "pos", "column_name", "data_type", "is_key", "not_null", "default_value")


# ---- streams -----------------------------------------------------------------------------------------------------

def _events_stream(s, d):
    # a pattern, as a stream's plain path must be a directory and this may be one file
    return ST.file_stream(s, f"{d}/events.parque[t]", s.read.parquet(f"{d}/events.parquet").schema)


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def stream_latest(s, d):
    at = scratch(s)
    out = ST.run_to_table(ST.latest_state(_events_stream(s, d), ["user_id"], ["event_id"], ["event_id"]), f"{at}/out", f"{at}/ckpt", "update")
    return out.groupBy("user_id").agg(F.max("event_id").alias("event_id"))


@query()
def stream_windows(s, d):
    at = scratch(s)
    e = _events_stream(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = ST.run_to_table(ST.windowed_counts(e, "ts", ["event_type"], "1 day", "2 days"), f"{at}/out", f"{at}/ckpt")
    return out.select("start", "event_type", "n")


@query()
def stream_leases(s, d):
    at = scratch(s)
    e = _events_stream(s, d).selectExpr("concat('d', user_id % 20) AS domain", "concat('a', user_id) AS agent", "unix_millis(cast(ts AS timestamp)) AS ts_ms", "event_id")
    return ST.run_to_table(ST.lease_stream(e, 3_600_000), f"{at}/out", f"{at}/ckpt").select("domain", "agent", "ts_ms", "event_id", "granted", "owner")


@query("SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM (SELECT file_path AS path, max(content) AS c FROM source_files WHERE file_path IS NOT NULL AND language <> 'zig' GROUP BY 1) a FULL OUTER JOIN (SELECT file_path AS path, max(CASE WHEN language = 'java' THEN content || ' ' ELSE content END) AS c FROM source_files WHERE file_path IS NOT NULL AND language <> 'swift' GROUP BY 1) b USING (path) WHERE a.c IS DISTINCT FROM b.c")
def watch_delta(s, d):
    """A listing without the Zig files against an earlier one without the Swift files, the Java files of which have changed."""
    def listing(where, content):
        f = table(s, d, "source_files").filter(f"file_path is not null and {where}").selectExpr("file_path AS path", f"{content} AS c").groupBy("path").agg(F.max("c").alias("c"))
        return f.select("path", F.octet_length("c").alias("size"), F.lit(0).alias("modified"), F.sha2("c", 256).alias("sha256"))
    return ST.directory_delta(listing("language <> 'zig'", "content"), listing("language <> 'swift'", "CASE WHEN language = 'java' THEN concat(content, ' ') ELSE content END"))
