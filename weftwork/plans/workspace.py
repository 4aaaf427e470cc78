"""Queries over workspaces: topology, resolution, edits, conflicts, working trees, branches, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.functions.common import table
from weftwork.operators import eventlog as EL
from weftwork.operators import graph as G
from weftwork.operators import hierarchy as H
from weftwork.operators import identity as ID
from weftwork.operators import linker as LK
from weftwork.operators import nested as N
from weftwork.operators import proposals as PR
from weftwork.operators import rules as R
from weftwork.operators import scoring as S
from weftwork.operators import symbols as SY
from weftwork.operators import vectors as V
from weftwork.operators import versions as VS
from weftwork.plans import adapters as A
from weftwork.sources import files as FS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- topology ----------------------------------------------------------------------------------------------------

def _functions(s, d):
    f = table(s, d, "code_functions")
    return f.groupBy("function_id").agg(F.max(F.struct("ingested_at", "language", "node_type", "identifier", "file_path", "owner_name")).alias("r")).select("function_id", "r.*")


def _symbols(s, d):
    return _functions(s, d).selectExpr("cast(function_id AS string) AS node_id", "language", "node_type", "identifier")


def _components(s, d):
    """One component per file and universe kind; several of a name differ in pos, the newest wins."""
    f = _functions(s, d).filter("owner_name is not null")
    return f.groupBy("owner_name", "file_path").agg(F.max("function_id").alias("pos"), F.array_sort(F.collect_list(F.col("function_id").cast("string"))).alias("symbol_ids")).withColumnRenamed("owner_name", "name")


_F = "SELECT function_id, max({'t': ingested_at, 'l': language, 'n': node_type, 'i': identifier, 'p': file_path, 'o': owner_name}) AS r FROM code_functions GROUP BY 1"
_FN = f"SELECT function_id, r.l AS language, r.n AS node_type, r.i AS identifier, r.p AS file_path, r.o AS owner_name FROM ({_F})"
_TIER = """CASE WHEN language IN ('typescript', 'javascript', 'html', 'css', 'vue', 'svelte') OR contains(lower(identifier), 'template') OR contains(identifier, 'HX-') OR regexp_matches(lower(coalesce(path, '')), 'web|frontend|static|templates') THEN 'Frontend'
WHEN language IN ('hcl', 'dockerfile', 'terraform') THEN 'Cloud Infra' WHEN language IN ('go', 'python', 'rust', 'sql') THEN 'API/Backend' ELSE 'Backend' END"""
_TOPOLOGY = f"""WITH f AS ({_FN}), c AS (SELECT owner_name AS name, file_path, max(function_id) AS pos FROM f WHERE owner_name IS NOT NULL GROUP BY ALL),
newest AS (SELECT name, max({{'pos': pos, 'p': file_path}}) AS r FROM c GROUP BY 1)
SELECT CAST(function_id AS VARCHAR) AS node_id, identifier AS symbol, {_TIER} AS tier, name AS component FROM (SELECT f.*, n.name, coalesce(n.r.p, n.name) AS path FROM f JOIN newest n ON f.owner_name = n.name AND f.file_path IS NOT DISTINCT FROM n.r.p)"""


@query(_TOPOLOGY)
def topology(s, d):
    return SY.topology(_components(s, d), _symbols(s, d))


@query(f"SELECT tier, count(*) AS n FROM ({_TOPOLOGY}) WHERE contains(lower(symbol), 'ledger') GROUP BY 1")
def topology_filter(s, d):
    return topology(s, d).filter(F.contains(F.lower("symbol"), F.lit("ledger"))).groupBy("tier").agg(F.count("*").alias("n"))


@query(f"""WITH t AS ({_TOPOLOGY}), f AS ({_FN}), e AS (SELECT DISTINCT function_id, trim(regexp_replace(trim(c), '\\(\\)$', '')) AS callee FROM (SELECT function_id, unnest(called_methods) AS c FROM code_functions WHERE language = 'java')),
x AS (SELECT DISTINCT CAST(e.function_id AS VARCHAR) AS source_id, CAST(f.function_id AS VARCHAR) AS target_id FROM e JOIN f ON f.identifier = e.callee)
SELECT source_id, target_id, 'CALLS' AS edge_type, 'CALLS' AS label FROM x WHERE source_id IN (SELECT node_id FROM t) AND target_id IN (SELECT node_id FROM t)""")
def topology_edges(s, d):
    calls = table(s, d, "code_functions").filter("language = 'java'").select("function_id", F.explode("called_methods").alias("c"))
    callee = calls.select(F.col("function_id").cast("string").alias("source_id"), F.trim(F.regexp_replace(F.trim("c"), r"\(\)$", "")).alias("identifier")).distinct()
    e = callee.join(_symbols(s, d).select("identifier", F.col("node_id").alias("target_id")), "identifier").select("source_id", "target_id").distinct().select("*", F.lit("CALLS").alias("edge_type"), F.expr("cast(map() AS map<string,string>)").alias("metadata"))
    return SY.topology_edges(e, topology(s, d))


@query(f"WITH f AS ({_FN}) SELECT identifier FROM f WHERE contains(identifier, 'flushSignal') OR contains('flushSignal', identifier) ORDER BY CASE WHEN identifier = 'flushSignal' OR suffix(identifier, '.flushSignal') THEN 0 WHEN contains(identifier, 'flushSignal') THEN 1 ELSE 2 END, function_id LIMIT 1")
def resolve_symbol(s, d):
    return SY.resolve_symbol(_functions(s, d).withColumn("node_id", F.sha2(F.col("function_id").cast("string"), 256)), "flushSignal", ["function_id"]).select("identifier")


@query("""WITH c AS (SELECT class_id, any_value(methods) AS methods FROM java_classes GROUP BY 1), u AS (SELECT class_id, m.name AS n, pos FROM (SELECT class_id, unnest(methods) AS m, generate_subscripts(methods, 1) AS pos FROM c) WHERE m.name IS NOT NULL), f AS (SELECT min(n) AS n FROM u)
SELECT class_id AS component_id, string_agg(CASE WHEN n = (SELECT n FROM f) THEN 'renamed' ELSE n END, ',' ORDER BY pos) AS symbols FROM u WHERE class_id IN (SELECT class_id FROM u WHERE n = (SELECT n FROM f)) GROUP BY 1""")
def mutate_symbol(s, d):
    """The first method name of all in string order is renamed wherever it stands."""
    c = table(s, d, "java_classes").groupBy("class_id").agg(F.any_value("methods", True).alias("methods")).select(F.col("class_id").alias("component_id"), F.filter(F.transform("methods", lambda m: m["name"]), lambda x: x.isNotNull()).alias("symbol_ids"))
    first = c.select(F.explode("symbol_ids").alias("n")).agg(F.min("n")).first()[0]
    return SY.replace_symbol(c, first, "renamed").select("component_id", F.array_join("symbol_ids", ",").alias("symbols"))


@query("WITH c AS (SELECT DISTINCT class_id, list_filter(list_transform(methods, lambda m: m.name), lambda x: x IS NOT NULL) AS ids FROM java_classes WHERE methods IS NOT NULL), f AS (SELECT class_id, ids, ids[1] AS a FROM c WHERE len(ids) > 0) SELECT class_id, array_to_string([a, 'added'] || ids[2:], ',') AS after_verb, array_to_string(ids[2:], ',') AS delete_verb FROM f")
def edit_batch(s, d):
    """A method is added after each class's first one; in another edit the first one is deleted."""
    c = table(s, d, "java_classes").filter("methods is not null").select("class_id", F.filter(F.transform("methods", lambda m: m["name"]), lambda x: x.isNotNull()).alias("ids")).distinct().filter(F.size("ids") > 0)
    first = F.get("ids", F.lit(0))
    # the anchor differs by row, so the verbs are spelt with its position
    return c.select("class_id", F.array_join(F.concat(F.array(first, F.lit("added")), F.slice("ids", F.lit(2), F.size("ids"))), ",").alias("after_verb"), F.array_join(F.slice("ids", F.lit(2), F.size("ids")), ",").alias("delete_verb"))


@query("""WITH v AS (SELECT lower(trim(change_id)) AS symbol_id, manifest_hash || ':' || coalesce(lower(trim(parent_change_id)), '') AS h, min(epoch_us(updated_at)) AS seq FROM stacked_proposals WHERE manifest_hash IS NOT NULL GROUP BY 1, 2),
g AS (SELECT symbol_id, string_agg(h, '' ORDER BY seq, h) AS t, count(*) AS n FROM v GROUP BY 1 HAVING count(*) > 1) SELECT 'conflict-' || substr(sha256(symbol_id || t), 1, 12) AS conflict_id, symbol_id, CAST(n AS INTEGER) AS n_versions FROM g""")
def conflict_node(s, d):
    p = table(s, d, "stacked_proposals").filter("manifest_hash is not null").select(H.norm_key("change_id").alias("symbol_id"), F.concat("manifest_hash", F.lit(":"), F.coalesce(H.norm_key("parent_change_id"), F.lit(""))).alias("ast_hash"), F.unix_micros("updated_at").alias("seq"))
    return SY.conflicts(p)


@query("""WITH f AS (SELECT DISTINCT file_id, content AS a, replace(content, 'return', 'yield') AS b FROM source_files WHERE content IS NOT NULL), l AS (SELECT file_id, unnest(string_split(a, chr(10))) AS x, unnest(string_split(b, chr(10))) AS y, generate_subscripts(string_split(a, chr(10)), 1) AS line_no FROM f)
SELECT file_id, CAST(line_no AS INTEGER) AS line_no, '-' AS sign, x AS line FROM l WHERE x <> y AND x <> '' UNION ALL SELECT file_id, CAST(line_no AS INTEGER), '+', y FROM l WHERE x <> y AND y <> ''""")
def line_diff(s, d):
    f = table(s, d, "source_files").filter("content is not null").select("file_id", F.col("content").alias("a"), F.replace("content", F.lit("return"), F.lit("yield")).alias("b")).distinct()
    return SY.line_diff(f, "file_id", "a", "b")


@query("SELECT DISTINCT class_id, contains(class_name, 'Server') OR contains(class_name, 'Service') AS is_rpc, contains(lower(coalesce(class_name, '')), 'ledger') AS reads_table FROM java_classes WHERE class_name IS NOT NULL")
def classify_symbols(s, d):
    c = table(s, d, "java_classes").filter("class_name is not null").select("class_id", "class_name").distinct()
    meta = F.when(F.contains(F.lower("class_name"), F.lit("ledger")), F.create_map(F.lit("table_name"), F.lit("ledger"))).otherwise(F.expr("cast(map() AS map<string,string>)"))
    return c.select("class_id", SY.implements_procedure(F.expr("cast(map() AS map<string,string>)"), F.col("class_name"), F.lit("ClassDecl")).alias("is_rpc"), SY.reads_tables(meta, F.lit("{}")).alias("reads_table"))


@query("SELECT DISTINCT table_id, contains(raw_ddl, '0.0.0.0/0') AND contains(raw_ddl, 'ingress') AS open_ingress, contains(raw_ddl, 'roles/owner') OR contains(raw_ddl, 'roles/editor') AS primitive_role FROM sql_tables WHERE raw_ddl IS NOT NULL")
def iam_security(s, d):
    t = table(s, d, "sql_tables").filter("raw_ddl is not null").select("table_id", SY.open_access(F.col("raw_ddl")).alias("f")).distinct()
    return t.select("table_id", F.array_contains("f", "OPEN_INGRESS").alias("open_ingress"), F.array_contains("f", "PRIMITIVE_ROLE").alias("primitive_role"))


# ---- working trees -----------------------------------------------------------------------------------------------

_TREES = "wt AS (SELECT file_path AS path, max(content) AS c FROM source_files WHERE file_path IS NOT NULL AND coalesce(language, '') <> 'zig' GROUP BY 1), head AS (SELECT file_path AS path, max(CASE WHEN language = 'rust' THEN content || '//' ELSE content || ' ' END) AS c FROM source_files WHERE file_path IS NOT NULL AND coalesce(language, '') <> 'swift' GROUP BY 1)"


def _trees(s, d):
    f = table(s, d, "source_files").filter("file_path is not null").selectExpr("file_path AS path", "coalesce(language, '') AS l", "content")
    wt = f.filter("l <> 'zig'").groupBy("path").agg(F.max("content").alias("c"))
    head = f.filter("l <> 'swift'").groupBy("path").agg(F.max(F.expr("CASE WHEN l = 'rust' THEN concat(content, '//') ELSE concat(content, ' ') END")).alias("h"))
    return wt, head


@query(f"WITH {_TREES} SELECT wt.path, CASE WHEN head.path IS NULL THEN 'untracked' ELSE 'modified' END AS status FROM wt LEFT JOIN head USING (path) WHERE head.path IS NULL OR head.c <> wt.c")
def git_status(s, d):
    """Deleted files are not reported."""
    wt, head = _trees(s, d)
    return wt.join(head, "path", "left").select("path", F.when(F.col("h").isNull(), "untracked").when(F.col("h") != F.col("c"), "modified").alias("status")).filter("status is not null")


@query(f"WITH {_TREES} SELECT head.path, CASE WHEN wt.path IS NULL THEN 'missing' ELSE 'modified' END AS status FROM head LEFT JOIN wt USING (path) WHERE wt.path IS NULL OR trim(head.c, chr(10) || chr(13) || chr(9) || ' ') <> trim(wt.c, chr(10) || chr(13) || chr(9) || ' ')")
def worktree_drift(s, d):
    """White space around a file does not count."""
    wt, head = _trees(s, d)
    t = lambda c: F.regexp_replace(F.regexp_replace(c, r"^[ \t\r\n]+", ""), r"[ \t\r\n]+$", "")
    return head.join(wt, "path", "left").select("path", F.when(F.col("c").isNull(), "missing").when(t("h") != t("c"), "modified").alias("status")).filter("status is not null")


@query("SELECT dir, max(r).k AS kind FROM (SELECT regexp_extract(entry_path, '^(.*?)/?[^/]*$', 1) AS dir, CASE WHEN suffix(entry_path, '.java') THEN {'n': 1, 'k': 'java'} WHEN suffix(entry_path, '.rs') THEN {'n': 2, 'k': 'rust'} END AS r FROM git_trees) WHERE r IS NOT NULL GROUP BY 1")
def detect_manifests(s, d):
    """Java and Rust files stand for those languages' marker files; the later marker decides."""
    t = table(s, d, "git_trees").select(F.regexp_replace(F.regexp_replace("entry_path", r"[^/]*\.java$", "pom.xml"), r"[^/]*\.rs$", "Cargo.toml").alias("path"))
    k = FS.project_kinds(t.filter(F.endswith("path", F.lit("pom.xml")) | F.endswith("path", F.lit("Cargo.toml"))))
    both = t.filter(F.endswith("path", F.lit("Cargo.toml"))).select(F.regexp_extract("path", "^(.*?)/?[^/]*$", 1).alias("dir")).distinct().withColumn("r", F.lit("rust"))
    return k.join(both, "dir", "left").select("dir", F.coalesce("r", "kind").alias("kind"))


@query("SELECT split_part(file_path, '/', 1) AS top, split_part(file_path, '/', 2) AS name FROM source_files WHERE file_path IS NOT NULL GROUP BY ALL")
def vfs_readdir(s, d):
    p = F.split("file_path", "/")
    return table(s, d, "source_files").filter("file_path is not null").select(F.get(p, F.lit(0)).alias("top"), F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("name")).distinct()


@query("SELECT count(DISTINCT file_id) AS n_files, count(DISTINCT file_path) AS n_paths, CAST(sum(n) AS BIGINT) AS n_bytes FROM (SELECT file_id, any_value(file_path) AS file_path, max(octet_length(encode(content))) AS n FROM source_files GROUP BY 1)")
def onboard_report(s, d):
    f = table(s, d, "source_files").groupBy("file_id").agg(F.any_value("file_path", True).alias("file_path"), F.max(F.octet_length("content")).alias("n"))
    return f.agg(F.count("*").alias("n_files"), F.countDistinct("file_path").alias("n_paths"), F.sum("n").cast("bigint").alias("n_bytes"))


# ---- branches ----------------------------------------------------------------------------------------------------

_LIVE = "SELECT universe_id, max({'u': updated_at, 'i': ingested_at, 'h': head_manifest_hash, 'p': parent_universe_id}) AS r FROM heads WHERE deleted_at IS NULL GROUP BY 1"


def _heads(s, d):
    h = table(s, d, "heads").filter("deleted_at is null")
    return VS.latest_by(h, ["universe_id"], ["updated_at", "ingested_at"], ["updated_at", "ingested_at", "head_manifest_hash", "parent_universe_id"]).withColumnRenamed("head_manifest_hash", "head")


@query(f"SELECT 'feature/new' AS universe_id, r.h AS head, 'main' AS parent_universe_id FROM ({_LIVE}) WHERE universe_id = 'main'")
def create_universe(s, d):
    return EL.create_universe(_heads(s, d), "feature/new", "main")


@query(f"SELECT universe_id, CASE WHEN universe_id = 'main' THEN 'moved' ELSE r.h END AS head FROM ({_LIVE})")
def set_head(s, d):
    return EL.move_head(_heads(s, d), "main", "moved").select("universe_id", "head")


@query(f"""WITH RECURSIVE h AS (SELECT universe_id, r.p AS p FROM ({_LIVE})), c AS (SELECT DISTINCT universe_id FROM stacked_proposals WHERE universe_id IS NOT NULL),
w AS (SELECT universe_id, universe_id AS u, 0 AS n FROM h UNION ALL SELECT w.universe_id, h.p, w.n + 1 FROM w JOIN h ON h.universe_id = w.u WHERE w.u NOT IN (SELECT universe_id FROM c) AND h.p IS NOT NULL AND h.p <> w.u AND w.n < 60),
b AS (SELECT universe_id, arg_min(u, n) AS source_id FROM w WHERE u IN (SELECT universe_id FROM c) GROUP BY 1) SELECT h.universe_id, b.source_id FROM h LEFT JOIN b USING (universe_id)""")
def log_ancestry(s, d):
    return EL.climb(_heads(s, d), table(s, d, "stacked_proposals").filter("universe_id is not null"))


@query("WITH RECURSIVE " + f"oplog AS ({A.OPLOG}), c AS (SELECT event_id, universe_id, sha256(payload) AS h, lag(event_id) OVER (PARTITION BY universe_id ORDER BY event_id) AS parent_event FROM oplog WHERE action = 'COMMIT') SELECT event_id, universe_id, parent_event FROM c WHERE prefix(h, 'a') ORDER BY event_id DESC LIMIT 1")
def revert_commit(s, d):
    return EL.revert_target(A.oplog(s, d), "a")


@query(f"WITH oplog AS ({A.OPLOG}), n AS (SELECT ts_ms + 1 AS ts_ms, universe_id, entity_id FROM oplog WHERE action = 'DELETE_NODE') SELECT CAST((SELECT max(event_id) FROM oplog) + row_number() OVER (ORDER BY ts_ms, entity_id, 'RESTORE_NODE') AS BIGINT) AS event_id, ts_ms FROM n")
def oplog_append(s, d):
    log = A.oplog(s, d)
    new = log.filter("action = 'DELETE_NODE'").selectExpr("ts_ms + 1 AS ts_ms", "universe_id", "'RESTORE_NODE' AS action", "entity_id", "entity_id AS node")
    return EL.append(log, new, ["node"]).select("event_id", "ts_ms")


@query(f"WITH oplog AS ({A.OPLOG}) SELECT event_id, universe_id, action FROM oplog WHERE sha256(CAST(event_id AS VARCHAR)) = sha256('77')")
def oplog_by_uuid(s, d):
    return A.oplog(s, d).filter(F.sha2(F.col("event_id").cast("string"), 256) == F.sha2(F.lit("77"), 256)).select("event_id", "universe_id", "action")


@query("SELECT k AS change_id, r.o AS order_index, row_number() OVER (ORDER BY r.o NULLS FIRST, r.c NULLS FIRST, k) - 1 AS pos FROM (SELECT lower(trim(change_id)) AS k, max({'u': updated_at, 'i': ingested_at, 'o': order_index, 'p': lower(trim(parent_change_id)), 'c': created_at}) AS r FROM stacked_proposals GROUP BY 1) WHERE k <> ''")
def stack_order(s, d):
    """Every change with its place in the whole list; changes without an id are none."""
    return PR.stack_order(table(s, d, "stacked_proposals"))


@query("SELECT DISTINCT component_id FROM (SELECT 'comp-' || p_partkey AS component_id FROM part WHERE p_partkey % 3 <> 0) INTERSECT SELECT 'comp-' || p_partkey FROM part WHERE p_partkey % 5 <> 0")
def intersect(s, d):
    m = A.manifests(s, d)
    return m.filter("universe_id = 'a'").select("component_id").intersect(m.filter("universe_id = 'b'").select("component_id"))


@query("SELECT function_id, array_to_string(list_sort(list_distinct(list_filter(called_methods, lambda x: x <> ''))), ',') AS deps FROM (SELECT function_id, any_value(called_methods) AS called_methods FROM code_functions WHERE called_methods IS NOT NULL GROUP BY 1)")
def dedupe_deps(s, d):
    f = table(s, d, "code_functions").filter("called_methods is not null").groupBy("function_id").agg(F.any_value("called_methods").alias("c"))
    return f.select("function_id", F.array_join(ID.dependency_list(F.col("c"), F.lit(None).cast("array<string>")), ",").alias("deps"))


# ---- other -------------------------------------------------------------------------------------------------------

@query("SELECT user_id, count(*) AS steps, count(*) FILTER (WHERE event_type = 'view') AS llm_calls, CAST(sum(length(props)) AS BIGINT) AS chars, CAST(sum((length(props) + 3) // 4) AS BIGINT) AS tokens FROM events GROUP BY 1")
def transcript_stats(s, d):
    n = F.char_length("props")
    return table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("steps"), F.count_if(F.col("event_type") == "view").alias("llm_calls"), F.sum(n).cast("bigint").alias("chars"), F.sum(F.floor((n + 3) / 4)).cast("bigint").alias("tokens"))


@query("SELECT command_name, count(DISTINCT command_id) AS n_ops, CAST(sum(duration_ns) AS BIGINT) AS total_ns, count(*) FILTER (WHERE NOT successful) AS n_failed FROM (SELECT command_id, any_value(command_name) AS command_name, any_value(duration_ns) AS duration_ns, any_value(successful) AS successful FROM command_results GROUP BY 1) GROUP BY 1")
def swarm_metrics(s, d):
    c = table(s, d, "command_results").groupBy("command_id").agg(F.any_value("command_name", True).alias("command_name"), F.any_value("duration_ns", True).alias("duration_ns"), F.any_value("successful", True).alias("successful"))
    return c.groupBy("command_name").agg(F.count("*").alias("n_ops"), F.sum("duration_ns").cast("bigint").alias("total_ns"), F.count_if(~F.col("successful")).alias("n_failed"))


@query("SELECT s_nationkey, array_to_string(list_sort(list(s_name || '=' || sha256(s_name))), ';') AS components FROM supplier GROUP BY 1")
def target_state(s, d):
    t = table(s, d, "supplier").groupBy("s_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("s_name", F.sha2("s_name", 256)))).alias("m"))
    return t.select("s_nationkey", ID.sorted_pairs(F.col("m")).alias("components"))


@query("WITH r AS (SELECT DISTINCT lower(m.name) AS k FROM (SELECT unnest(methods) AS m FROM java_classes) WHERE m.name IS NOT NULL) SELECT function_id, CASE WHEN lower(function_name) IN (SELECT k FROM r) THEN 'VALID' ELSE 'BROKEN' END AS status FROM (SELECT function_id, any_value(function_name) AS function_name FROM code_functions WHERE language = 'kotlin' GROUP BY 1) WHERE function_name IS NOT NULL")
def contract_audit(s, d):
    r = table(s, d, "java_classes").select(F.explode("methods").alias("m")).filter("m.name is not null").select(F.lower("m.name").alias("route"))
    c = table(s, d, "code_functions").filter("language = 'kotlin'").groupBy("function_id").agg(F.any_value("function_name", True).alias("n")).filter("n is not null").select("function_id", F.lower("n").alias("call"))
    return SY.contract_audit(c, r, "call", "route").select("function_id", "status")


@query("SELECT vec_id, substr(sha256('v' || vec_id || ':' || label || ':'), 1, 16) AS entry_id FROM embeddings WHERE label <> 3")
def vector_crud(s, d):
    """Entries with their keys, those of one label deleted."""
    v = table(s, d, "embeddings").filter("label <> 3")
    return v.select("vec_id", V.vector_key(F.concat(F.lit("v"), F.col("vec_id").cast("string")), F.col("label").cast("string"), F.lit("")).alias("entry_id"))


@query()
def search_text(s, d):
    """The documents nearest to a question by the deterministic embedding."""
    docs = V.embed(table(s, d, "documents"), "doc_id", "text")
    q = V.embed(s.createDataFrame([(0, "which agent holds the lease of the parent branch")], "i int, t string"), "i", "t").first().vector
    return V.search(docs, list(q), k=10, key="doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH edges AS ({A.EDGES}), n AS (SELECT DISTINCT target_id AS m FROM edges WHERE source_id = 'C:5' UNION SELECT source_id FROM edges WHERE target_id = 'C:5') SELECT count(*) AS n_neighbours, CAST(CASE WHEN count(*) = 0 THEN 0.1 WHEN count(*) <= 2 THEN 0.5 ELSE 0.9 END AS DOUBLE) AS risk FROM n")
def impact_risk(s, d):
    return G.impact_risk(A.edges(s, d), "C:5").withColumn("risk", F.col("risk").cast("double"))


@query("SELECT o_custkey, o_orderkey, CAST(sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM (SELECT *, length(o_orderpriority) AS n FROM orders)")
def cumulative_tokens(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.struct("o_orderdate", "o_orderkey").alias("at"), F.char_length("o_orderpriority").cast("bigint").alias("n"))
    return S.running_context(o.withColumnRenamed("at", "step"), "o_custkey", "step", "n").select("o_custkey", F.col("step.o_orderkey").alias("o_orderkey"), F.col("total").alias("running"))


_WALK = """WITH RECURSIVE s AS (SELECT k, max({'u': updated_at, 'i': ingested_at, 'p': p, 'v': v}) AS r FROM (SELECT lower(trim(change_id)) AS k, lower(trim(parent_change_id)) AS p, universe_id AS v, updated_at, ingested_at FROM stacked_proposals) WHERE k <> '' GROUP BY 1),
l AS (SELECT k, r.p AS p FROM s), t AS (SELECT p AS root, k FROM l WHERE p IN (SELECT k FROM s) UNION SELECT t.root, l.k FROM t JOIN l ON l.p = t.k), o1 AS (SELECT k FROM t WHERE root = k), z AS (SELECT root, k FROM t WHERE k NOT IN (SELECT k FROM o1) AND k NOT IN (SELECT k FROM t WHERE root IN (SELECT k FROM o1))),
v AS (SELECT k, r.v AS v FROM s WHERE r.v IS NOT NULL), """


@query(_WALK + """pr AS (SELECT DISTINCT a.v AS f, b.v AS t FROM z JOIN v a ON a.k = z.root JOIN v b ON b.k = z.k WHERE a.v <> b.v), c AS (SELECT DISTINCT universe_id, file_path FROM code_functions WHERE universe_id IS NOT NULL AND file_path IS NOT NULL),
o AS (SELECT universe_id, file_path FROM c WHERE universe_id IN (SELECT t FROM pr) UNION SELECT pr.t, c.file_path FROM pr JOIN c ON c.universe_id = pr.f) SELECT universe_id, count(*) AS n_components FROM o GROUP BY 1""")
def evolve_stack(s, d):
    """Every stack is rebased: each change's components go into the universes of all its descendants; changes below a loop have no place in a stack."""
    p = table(s, d, "stacked_proposals")
    links = H.proposal_links(p)
    below = H.descendants(H.hierarchy(links)).select(F.col("ancestor_key").alias("root"), F.col("descendant_key").alias("change_id"))
    own = VS.latest_by(p.select(H.norm_key("change_id").alias("change_id"), "updated_at", "ingested_at", H.norm_key("parent_change_id").alias("p"), "universe_id"), ["change_id"], ["updated_at", "ingested_at", "p"], ["universe_id"]).filter("universe_id is not null")
    comps = table(s, d, "code_functions").filter("universe_id is not null and file_path is not null").select("universe_id", F.col("file_path").alias("component_id")).distinct()
    return PR.evolve(below, own, comps).groupBy("universe_id").agg(F.count("*").alias("n_components"))


@query("SELECT k AS change_id, count(*) AS n_revisions, count(DISTINCT a) AS n_authors, arg_max(t, {'u': u, 'h': h}) AS title FROM (SELECT lower(trim(change_id)) AS k, author_did AS a, title AS t, epoch_us(updated_at) AS u, manifest_hash AS h FROM stacked_proposals) WHERE t IS NOT NULL GROUP BY 1")
def proposal_fold(s, d):
    p = table(s, d, "stacked_proposals").filter("title is not null").select(H.norm_key("change_id").alias("change_id"), F.col("author_did").alias("author"), "title", F.unix_micros("updated_at").alias("u"), F.col("manifest_hash").alias("h"))
    return PR.fold(p, "change_id", ["u", "h"], "title").drop("first_at")


@query("""WITH l AS (SELECT user_id, event_id % 2 AS side, max({'e': event_id, 't': event_type}) AS r FROM events GROUP BY ALL), x AS (SELECT user_id, r FROM l WHERE side = 0), y AS (SELECT user_id, r FROM l WHERE side = 1)
SELECT user_id, greatest(x.r, y.r).t AS event_type, x.r IS NOT NULL AND y.r IS NOT NULL AND x.r.t <> y.r.t AS conflict FROM x FULL OUTER JOIN y USING (user_id)""")
def offline_wal(s, d):
    e = table(s, d, "events")
    return PR.reconcile(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "user_id", ["event_id"], "event_type")


@query("SELECT source_id, target_id, r.e AS event_id FROM (SELECT 'n' || (user_id % 60) AS source_id, 'n' || (user_id % 41) AS target_id, max({'e': event_id, 't': event_type}) AS r FROM events GROUP BY 1, 2) WHERE r.t <> 'error'")
def upsert_delete_edge(s, d):
    e = table(s, d, "events").selectExpr("concat('n', user_id % 60) AS source_id", "concat('n', user_id % 41) AS target_id", "event_id", "event_type")
    return VS.latest_by(e, ["source_id", "target_id"], ["event_id"], ["event_id", "event_type"]).filter("event_type <> 'error'").select("source_id", "target_id", "event_id")


@query("WITH b AS (SELECT DISTINCT sha256(text) AS hash FROM documents WHERE text IS NOT NULL), x AS (SELECT DISTINCT sha256(body_source) AS hash FROM code_functions WHERE body_source IS NOT NULL UNION SELECT DISTINCT sha256(text) FROM documents WHERE lang = 'de' AND text IS NOT NULL) SELECT hash, hash IN (SELECT hash FROM b) AS has FROM x")
def blob_has(s, d):
    docs = table(s, d, "documents").filter("text is not null")
    b = docs.select(F.sha2("text", 256).alias("hash")).distinct().withColumn("h", F.lit(True))
    x = table(s, d, "code_functions").filter("body_source is not null").select(F.sha2("body_source", 256).alias("hash")).unionByName(docs.filter("lang = 'de'").select(F.sha2("text", 256).alias("hash"))).distinct()
    return x.join(b, "hash", "left").select("hash", F.coalesce("h", F.lit(False)).alias("has"))


@query("SELECT DISTINCT sha256(text) AS hash FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en' AND text IS NOT NULL)")
def blob_delete(s, d):
    docs = table(s, d, "documents").filter("text is not null").select("lang", F.sha2("text", 256).alias("hash"))
    return docs.select("hash").distinct().join(docs.filter("lang = 'en'").select("hash").distinct(), "hash", "left_anti")


@query("""WITH c AS (SELECT payload_id, unnest(json_extract(json_extract(payload_json, '$.components'), '$.*')) AS comp FROM publish_payloads WHERE json_valid(payload_json)),
n AS (SELECT DISTINCT payload_id, unnest(json_extract_string(comp, '$.symbol_nodes[*]')) AS node_id FROM c), y AS (SELECT DISTINCT payload_id, node_id FROM (SELECT payload_id, unnest(json_keys(payload_json, '$.symbols')) AS node_id FROM publish_payloads WHERE json_valid(payload_json) AND json_type(payload_json, '$.symbols') = 'OBJECT'
UNION ALL SELECT payload_id, unnest(json_extract_string(payload_json, '$.symbols[*].node_id')) FROM publish_payloads WHERE json_valid(payload_json) AND json_type(payload_json, '$.symbols') = 'ARRAY'))
SELECT payload_id, count(*) AS n_symbols FROM n JOIN y USING (payload_id, node_id) GROUP BY 1""")
def snapshot_state(s, d):
    """Components to their symbols; ids without a symbol are passed over."""
    p = table(s, d, "publish_payloads")
    listed = N.nested_elements(p, F.col("payload_id"), F.col("payload_json"), ["components", "*", "symbol_nodes"]).select("row_id", F.from_json(F.concat(F.lit("["), "child_value", F.lit("]")), "array<string>")[0].alias("node_id")).distinct()
    there = N.nested_elements(p, F.col("payload_id"), F.col("payload_json"), ["symbols", "*"], "node_id").select("row_id", F.col("parent_key").alias("node_id")).distinct()
    return listed.join(there, ["row_id", "node_id"]).groupBy(F.col("row_id").alias("payload_id")).agg(F.count("*").alias("n_symbols"))


@query(f"""WITH f AS ({_FN}), e AS (SELECT DISTINCT function_id, trim(regexp_replace(trim(c), '\\(\\)$', '')) AS callee FROM (SELECT function_id, unnest(called_methods) AS c FROM code_functions WHERE language = 'java'))
SELECT a.file_path, min({{'s': a.function_id, 't': b.function_id}}).t AS target_id FROM e JOIN f a USING (function_id) JOIN f b ON b.identifier = e.callee WHERE a.file_path IS NOT NULL GROUP BY 1""")
def lsp_definition(s, d):
    """Per file the target of its first call that resolves."""
    f = _functions(s, d)
    calls = table(s, d, "code_functions").filter("language = 'java'").select("function_id", F.explode("called_methods").alias("c"))
    callee = calls.select("function_id", F.trim(F.regexp_replace(F.trim("c"), r"\(\)$", "")).alias("identifier")).distinct()
    j = callee.join(f.select("identifier", F.col("function_id").alias("t")), "identifier").join(f.filter("file_path is not null").select("function_id", "file_path"), "function_id")
    return j.groupBy("file_path").agg(F.min(F.struct("function_id", "t")).alias("m")).select("file_path", F.col("m.t").alias("target_id"))


@query("WITH c AS (SELECT universe_id, count(DISTINCT file_path) AS n_files, count(DISTINCT function_id) AS n_symbols FROM code_functions WHERE universe_id IS NOT NULL GROUP BY 1), h AS (SELECT DISTINCT universe_id FROM heads WHERE deleted_at IS NULL) SELECT universe_id, coalesce(n_files, 0) AS n_files, coalesce(n_symbols, 0) AS n_symbols FROM h LEFT JOIN c USING (universe_id)")
def status_report(s, d):
    c = table(s, d, "code_functions").filter("universe_id is not null").groupBy("universe_id").agg(F.countDistinct("file_path").alias("n_files"), F.countDistinct("function_id").alias("n_symbols"))
    h = table(s, d, "heads").filter("deleted_at is null").select("universe_id").distinct()
    return h.join(c, "universe_id", "left").select("universe_id", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"))


@query("SELECT DISTINCT field_id, upper(field_name) AS env_var, class_name AS env_value FROM php_fields WHERE field_name IS NOT NULL AND class_name IS NOT NULL")
def hcl_env_collect(s, d):
    """Environment blocks two levels deep in resources made of the fields."""
    pay = F.expr("concat('{\"block_type\": \"resource\", \"nested_blocks\": [{\"block_type\": \"container\", \"nested_blocks\": [{\"block_type\": \"env\", \"attributes\": {\"name\": {\"value\": \"', upper(field_name), '\"}, \"value\": {\"value\": \"', class_name, '\"}}, \"nested_blocks\": []}]}]}')")
    f = table(s, d, "php_fields").filter("field_name is not null and class_name is not null")
    return LK.env_bindings(f, F.col("field_id"), pay).select(F.col("key").cast("bigint").alias("field_id"), F.col("name").alias("env_var"), F.col("value").alias("env_value")).distinct()


@query("SELECT DISTINCT field_id, CASE WHEN field_id % 3 = 0 THEN true WHEN field_id % 3 = 1 THEN field_name = 'apiKey' ELSE false END AS suppressed FROM php_fields WHERE field_name IS NOT NULL")
def inline_directive(s, d):
    f = table(s, d, "php_fields").filter("field_name is not null")
    text = F.when(F.col("field_id") % 3 == 0, "CALLS, all").when(F.col("field_id") % 3 == 1, "BINDS_ENV:apiKey").otherwise(None)
    return f.select("field_id", R.directive_hits(text, F.lit("BINDS_ENV"), F.col("field_name")).alias("suppressed")).distinct()
