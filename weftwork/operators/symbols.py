"""Symbols of a workspace: finding, classing by tier, editing, conflicts and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages and node types of the tiers, and marks of front-end paths.
FRONTEND_LANGUAGES = ("typescript", "javascript", "html", "css", "vue", "svelte")
FRONTEND_PATHS = ("web", "frontend", "static", "templates")
INFRA_LANGUAGES = ("hcl", "dockerfile", "terraform")
INFRA_TYPES = ("ResourceBlock", "HCLBlock", "VariableBlock", "OutputBlock", "ProviderBlock", "BaseImage", "CopyInstruction", "WorkdirInstruction", "PortExpose", "EntryPoint", "EnvBinding")
BACKEND_LANGUAGES = ("go", "python", "rust", "sql")


def tier(language: Column, node_type: Column, identifier: Column, path: Column) -> Column:
    """Frontend before Cloud Infra before API/Backend, else Backend; a path with "web" anywhere is front end."""
    p = F.lower(F.coalesce(path, F.lit("")))
    front = language.isin(*FRONTEND_LANGUAGES) | F.contains(F.lower(identifier), F.lit("template")) | F.contains(identifier, F.lit("HX-"))
    for mark in FRONTEND_PATHS:
        front = front | F.contains(p, F.lit(mark))
    infra = language.isin(*INFRA_LANGUAGES) | node_type.isin(*INFRA_TYPES)
    no = F.lit(False)
    return F.when(F.coalesce(front, no), "Frontend").when(F.coalesce(infra, no), "Cloud Infra").when(language.isin(*BACKEND_LANGUAGES), "API/Backend").otherwise("Backend")


def topology(components: DataFrame, symbols: DataFrame) -> DataFrame:
    """node_id, name, tier, component of a manifest: the newest component of each name (by pos) counts, a symbol goes to its first component.

    components: name, pos, file_path, symbol_ids; symbols: node_id, language, node_type, identifier.
    """
    newest = components.groupBy("name").agg(F.max(F.struct("pos", "file_path", "symbol_ids")).alias("c"))
    held = newest.select("name", F.col("c.pos").alias("pos"), F.coalesce("c.file_path", "name").alias("path"), F.explode("c.symbol_ids").alias("node_id"))
    first = held.groupBy("node_id").agg(F.max(F.struct("pos", "name", "path")).alias("h")).select("node_id", "h.name", "h.path")
    j = first.join(symbols, "node_id")
    return j.select("node_id", F.col("identifier").alias("symbol"), tier(F.col("language"), F.col("node_type"), F.col("identifier"), F.col("path")).alias("tier"), F.col("name").alias("component"))


def topology_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are in the topology, with their label by metadata."""
    ends = nodes.select("node_id")
    e = edges.join(ends.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(ends.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")
    m = lambda k: F.try_element_at("metadata", F.lit(k))
    label = F.coalesce(F.concat(F.lit("CALLS "), m("backend_endpoint")), F.concat(F.lit("BINDS "), m("env_var")), F.concat(F.lit("DEPLOYS TO "), m("resource_id")), F.col("edge_type"))
    return e.select("source_id", "target_id", "edge_type", label.alias("label"))


def match_rank(node_id: Column, identifier: Column, target: str) -> Column:
    """1 to 3 decide at once (exact id or name, dotted suffix), 4 to 7 compete, null is no match."""
    base = target.replace(")", ".").rsplit(".", 1)[-1]
    t = F.lit(target)
    return (F.when(node_id == target, 1).when(identifier == target, 2).when(F.endswith(identifier, F.lit("." + target)) | F.endswith(identifier, F.lit("::" + target)), 3)
            .when(F.lit(len(target) >= 6) & F.startswith(node_id, t), 4).when(F.lower(identifier) == target.lower(), 5).when(F.contains(identifier, t) | F.contains(t, identifier), 6)
            .when(F.contains(identifier, F.lit(base)) if base else F.lit(False), 7))


def resolve_symbol(symbols: DataFrame, target: str, order: list[str]) -> DataFrame:
    """The symbol a target names: the first deciding match in manifest order, else among the weak ones the first that contains it, else the first."""
    r = symbols.withColumn("rank", match_rank(F.col("node_id"), F.col("identifier"), target)).filter("rank is not null")
    strong = F.when(F.col("rank") <= 3, 0).when(F.contains("identifier", F.lit(target)), 1).otherwise(2)
    return r.orderBy(strong, *order).limit(1)


def replace_symbol(components: DataFrame, old: str, new: str) -> DataFrame:
    """component_id, symbol_ids with one symbol replaced in place, and how many siblings stay; components without it are not returned."""
    hit = components.filter(F.array_contains("symbol_ids", old))
    return hit.select("component_id", F.transform("symbol_ids", lambda x: F.when(x == old, F.lit(new)).otherwise(x)).alias("symbol_ids"), (F.size("symbol_ids") - 1).alias("unchanged"))


def edit_list(items: Column, verb: str, anchor: str = "", value: str = "") -> Column:
    """One verb on a list: replace, delete, append, before or after an anchor; an absent anchor leaves the list as it is."""
    at = F.array_position(items, anchor).cast("int")
    head, tail = F.slice(items, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(items, at + 1, F.greatest(F.size(items) - at, F.lit(0)))
    v = F.array(F.lit(value))
    made = {"replace": F.concat(head, v, tail), "delete": F.concat(head, tail), "before": F.concat(head, v, F.array(F.lit(anchor)), tail), "after": F.concat(head, F.array(F.lit(anchor)), v, tail)}
    return F.concat(items, v) if verb == "append" else F.when(at > 0, made[verb]).otherwise(items)


def conflicts(versions: DataFrame) -> DataFrame:
    """conflict_id, symbol_id, n_versions of symbols with several contents: the id hashes the symbol and its versions' hashes in order."""
    v = versions.groupBy("symbol_id", "ast_hash").agg(F.min("seq").alias("seq"))
    g = v.groupBy("symbol_id").agg(F.array_sort(F.collect_list(F.struct("seq", "ast_hash"))).alias("vs")).filter(F.size("vs") > 1)
    text = F.concat("symbol_id", F.array_join(F.transform("vs", lambda x: x["ast_hash"]), ""))
    return g.select(F.concat(F.lit("conflict-"), F.substring(F.sha2(text, 256), 1, 12)).alias("conflict_id"), "symbol_id", F.size("vs").alias("n_versions"))


def line_diff(df: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """key, line_no, sign, line: lines compared by position, not aligned; blank lines that differ are left out."""
    o, n = F.split(F.col(old), "\n"), F.split(F.col(new), "\n")
    rows = F.zip_with(o, n, lambda a, b: F.struct(a.alias("a"), b.alias("b")))  # the shorter one is filled with nulls
    x = df.select(key, F.posexplode(rows).alias("i", "r")).filter(~F.col("r.a").eqNullSafe(F.col("r.b")))
    sides = F.array(F.struct(F.lit("-").alias("sign"), F.col("r.a").alias("line")), F.struct(F.lit("+").alias("sign"), F.col("r.b").alias("line")))
    return x.select(key, (F.col("i") + 1).alias("line_no"), F.explode(sides).alias("s")).select(key, "line_no", "s.sign", "s.line").filter("line <> ''")


def reads_env(payload: Column) -> Column:
    return F.coalesce(F.size(F.from_json(F.get_json_object(payload, "$.env_vars_accessed"), "array<string>")), F.lit(0)) > 0


def reads_tables(metadata: Column, payload: Column) -> Column:
    keys = [F.coalesce(F.try_element_at(metadata, F.lit(k)), F.lit("")) != "" for k in ("table_name", "jpa_query", "sqlx_query")]
    held = [F.get_json_object(payload, f"$.{k}").isNotNull() for k in ("table_name", "jpa_query", "sql_tables")]
    out = keys[0]
    for k in keys[1:] + held:
        out = out | k
    return out


def implements_procedure(metadata: Column, identifier: Column, node_type: Column) -> Column:
    told = [F.coalesce(F.try_element_at(metadata, F.lit(k)), F.lit("")) != "" for k in ("implements_rpc", "service")]
    return told[0] | told[1] | F.contains(identifier, F.lit("Server")) | F.contains(identifier, F.lit("Service")) | F.contains(node_type, F.lit("RPC"))


def open_access(text: Column) -> Column:
    """Findings of an infrastructure text: world-open ingress, primitive roles."""
    world = F.when(F.contains(text, F.lit("0.0.0.0/0")) & F.contains(text, F.lit("ingress")), "OPEN_INGRESS")
    role = F.when(F.contains(text, F.lit("roles/owner")) | F.contains(text, F.lit("roles/editor")), "PRIMITIVE_ROLE")
    return F.filter(F.array(world, role), lambda x: x.isNotNull())


def contract_audit(calls: DataFrame, routes: DataFrame, call_key: str, route_key: str) -> DataFrame:
    """Every call with VALID or BROKEN, by whether a route has its key."""
    r = routes.select(F.col(route_key).alias("_k")).distinct()
    j = calls.join(r, calls[call_key] == r._k, "left")
    return j.withColumn("status", F.when(F.col("_k").isNull(), "BROKEN").otherwise("VALID")).drop("_k")
