"""Contract edges between symbols of different languages, their filters and their breakages.

Symbols are rows of node_id, language, node_type, identifier, metadata (map of strings), payload (JSON text).
Equality conditions are joins on normalised keys; the two containment conditions are joins on the
character n-grams of the shorter name, verified afterwards, so no pair is made without a common gram.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.functions.common import staged, trim_white
from weftwork.operators.identity import edge_hash, sorted_pairs
from weftwork.operators.nested import Spans, pieces, valid_json

#: Methods of endpoints and parameters of routes.
ENDPOINT = r"\b(GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD|ANY|GRPC)\s+([^\s]+)"
ROUTE_PARAM = r"\{[a-zA-Z0-9_]+\}|:[a-zA-Z0-9_]+"


def norm_path(p: Column) -> Column:
    """A path without outer slashes, every parameter as {param}."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(trim_white(p), "^/", ""), "/$", ""), ROUTE_PARAM, "{param}")


def endpoint(ident: Column) -> tuple[Column, Column]:
    """(method, path) of an identifier such as "UserCard:GET /users/:id"; ANY where no method is told."""
    word = F.split(trim_white(ident), r"\s+")
    m = F.regexp_extract(ident, ENDPOINT, 1)
    two = F.size(word) >= 2
    method = F.when(m != "", m).when(two, F.upper(F.get(word, F.lit(0)))).otherwise("ANY")
    path = F.when(m != "", F.regexp_extract(ident, ENDPOINT, 2)).when(two, F.get(word, F.lit(1))).otherwise(F.get(word, F.lit(0)))
    return method, path


def _meta(key: str) -> Column:
    return F.when(F.coalesce(F.try_element_at("metadata", F.lit(key)), F.lit("")) != "", F.try_element_at("metadata", F.lit(key)))


_EDGE = ["source_id", "target_id", "edge_type", "metadata"]


def _edges(df: DataFrame, kind: str, **meta: Column) -> DataFrame:
    m = F.map_from_arrays(F.array(*[F.lit(k) for k in meta]), F.array(*[F.coalesce(v, F.lit("")) for v in meta.values()]))
    return df.select("source_id", "target_id", F.lit(kind).alias("edge_type"), m.alias("metadata"))


def consumes_api(callers: DataFrame, routes: DataFrame) -> DataFrame:
    """API calls to routes of the same normalised path whose methods are equal or open."""
    cm, cp = endpoint(F.col("identifier"))
    rm, rp = endpoint(F.col("identifier"))
    told = _meta("route_method").isNotNull() & _meta("route_path").isNotNull()
    c = callers.select(F.col("node_id").alias("source_id"), cm.alias("cm"), cp.alias("cp"), norm_path(cp).alias("np"))
    r = routes.select(F.col("node_id").alias("target_id"), F.when(told, F.upper(_meta("route_method"))).otherwise(rm).alias("rm"), F.when(told, _meta("route_path")).otherwise(rp).alias("rp"))
    r = r.withColumn("np", norm_path(F.col("rp")))
    j = c.join(r, "np").filter((F.col("cm") == F.col("rm")) | (F.col("cm") == "ANY") | (F.col("rm") == "ANY"))
    return _edges(j, "CONSUMES_API", consumer_endpoint=F.col("cp"), backend_endpoint=F.col("rp"), http_method=F.col("rm"))


#: Fixed value: the words of a query in front of a table's name.
QUERY_TABLE = r"(?i)(?:FROM|JOIN|INTO|UPDATE)\s+([a-zA-Z0-9_]+)"


def target_tables(metadata_table: Column, payload: Column) -> Column:
    """Tables a symbol names: in metadata, in table_name and sql_tables of its payload, and in its query text."""
    q = F.coalesce(F.get_json_object(payload, "$.jpa_query"), F.lit(""))
    listed = F.coalesce(F.from_json(F.get_json_object(payload, "$.sql_tables"), "array<string>"), F.array().cast("array<string>"))
    found = F.concat(F.array(metadata_table, F.get_json_object(payload, "$.table_name")), F.regexp_extract_all(q, F.lit(QUERY_TABLE), F.lit(1)), listed)
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull() & (x != "")))


def queries_table(accessors: DataFrame, tables: DataFrame) -> DataFrame:
    """Accessors to tables of the same name in any case, or whose schema-qualified name ends in it."""
    a = accessors.select(F.col("node_id").alias("source_id"), "identifier", F.explode(target_tables(_meta("table_name"), F.col("payload"))).alias("t"))
    name = F.coalesce(_meta("table_name"), F.element_at(F.split(F.regexp_replace("identifier", "^table:", ""), r"\."), -1))
    t = tables.select(F.col("node_id").alias("target_id"), name.alias("name"))
    parts = F.split(F.lower("name"), r"\.")
    # a name matches itself and every suffix that begins behind a dot
    keys = t.withColumn("k", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))))
    j = a.withColumn("k", F.lower("t")).join(keys, "k")
    return _edges(j, "QUERIES_TABLE", table_name=F.col("name"), accessor=F.col("identifier")).dropDuplicates(["source_id", "target_id"])


def _grams(c: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c) - (n - 1), F.lit(1))), lambda i: F.substr(c, i, F.lit(n))))


def _contains(big: DataFrame, small: DataFrame, text: str, part: str, key: str) -> DataFrame:
    """Rows of big and small where ``text`` contains ``part``; ``key`` names big's rows.

    Texts are split into grams that carry their key only. Every part is sought by the one of its grams that the fewest texts hold, so a common gram
    joins nothing unless a part consists of common ones; the texts are fetched for the candidates alone and verified.
    """
    n = 3
    parts = small.select(F.col(part).alias("_part")).filter(F.char_length("_part") > 0).distinct()
    own = F.when(F.char_length("_part") >= n, _grams(F.col("_part"), n)).otherwise(F.array("_part"))
    want = staged(parts.select("_part", F.explode(own).alias("_g")))
    sizes = sorted(r[0] for r in want.select(F.char_length("_g")).distinct().collect())  # 1, 2 and 3 at most
    if not sizes:
        return big.join(small, F.col(text) == F.col(part)).filter("false")
    grams = F.explode(F.flatten(F.array(*[_grams(F.col(text), k) for k in sizes])))
    held = staged(big.select(key, text).distinct().select(key, grams.alias("_g")).join(want.select("_g").distinct(), "_g", "left_semi"))
    often = want.join(held.groupBy("_g").agg(F.count("*").alias("_n")), "_g", "left")
    rare = often.groupBy("_part").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_g").alias("g"))).alias("r")).select("_part", F.col("r.g").alias("_g"))
    found = rare.join(held, "_g").select(F.col(key).alias("_key"), "_part").distinct()
    return big.join(found, big[key] == found._key).filter(F.contains(text, F.col("_part"))).drop("_key").join(small.withColumnRenamed(part, "_part2"), F.col("_part") == F.col("_part2")).drop("_part2").withColumnRenamed("_part", part)


def implements_rpc(impls: DataFrame, protos: DataFrame) -> DataFrame:
    """Implementors to remote procedures: the same name in any case, or an identifier that contains the procedure's name."""
    own = F.coalesce(_meta("implements_rpc"), F.element_at(F.split("identifier", r"\."), -1))
    i = impls.select(F.col("node_id").alias("source_id"), "identifier", own.alias("own"), F.lower("identifier").alias("_text"))
    p = protos.select(F.col("node_id").alias("target_id"), F.element_at(F.split(F.regexp_replace("identifier", "^(rpc:)?(service:)?", ""), r"\."), -1).alias("rpc")).withColumn("_part", F.lower("rpc"))
    same = i.withColumn("_part", F.lower("own")).join(p, "_part").select("source_id", "target_id", "identifier", "rpc")
    within = _contains(i, p, "_text", "_part", "source_id").select("source_id", "target_id", "identifier", "rpc")
    return _edges(same.unionByName(within).dropDuplicates(["source_id", "target_id"]), "IMPLEMENTS_RPC", rpc_name=F.col("rpc"), implementor=F.col("identifier"))


def deploys_to(components: DataFrame, resources: DataFrame) -> DataFrame:
    """Services and databases to resources whose identifier or payload contains their name (case and hyphens aside)."""
    clean = lambda c: F.lower(F.regexp_replace(c, "-", "_"))
    c = components.filter(F.col("type").isin("service", "database")).select(F.col("component_id").alias("source_id"), F.col("name"), clean(F.col("name")).alias("_part"))
    r = resources.select(F.col("node_id").alias("target_id"), "identifier", F.concat_ws("\n", clean(F.col("identifier")), clean(F.col("payload"))).alias("_text"))
    return _edges(_contains(r, c, "_text", "_part", "target_id").dropDuplicates(["source_id", "target_id"]), "DEPLOYS_TO", service_name=F.col("name"), resource_id=F.col("identifier"))


def _env(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(k, t) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t and '"env"' in t and valid_json(t)]
        out: list[tuple[str, str, str | None]] = []
        for lo, hi in pieces([t for _, t in rows]):
            s = Spans([t for _, t in rows[lo:hi]])
            kinds = np.flatnonzero((s.key_end - s.key_start == 12) & (s.end - s.start == 5))
            at = np.array([s.parent[i] for i in kinds if s.key(i) == "block_type" and s.text(i) == '"env"'], np.int64)
            block, attrs = s.member(at, "attributes")

            def told(name: str, s: Spans = s, attrs: np.ndarray = attrs) -> dict[int, str]:
                r, v = s.member(attrs, name)
                q, v = s.member(v, "value")
                return {int(r[i]): json.loads(s.text(k)).strip('"') for i, k in zip(q, v, strict=True) if s.kind[k] == 34}

            names, values = told("name"), told("value")
            out += [(rows[lo + int(s.doc[attrs[i]])][0], x, values.get(i, "")) for i, x in sorted(names.items()) if x]
        cols = list(zip(*out, strict=True)) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in cols], names=["key", "name", "value"])


def env_bindings(df: DataFrame, key: Column, payload: Column) -> DataFrame:
    """key, name, value of the env blocks at any depth of resources' JSON, walked by its structure, so values may hold braces. Invalid JSON gives none."""
    return df.select(key.cast("string").alias("key"), payload.alias("payload")).mapInArrow(_env, "key string, name string, value string")


def binds_env(resources: DataFrame, readers: DataFrame) -> DataFrame:
    """Resources that set a variable to symbols that read it."""
    b = env_bindings(resources, F.col("node_id"), F.col("payload")).select(F.col("key").alias("source_id"), F.col("name").alias("env"), "value")
    r = readers.select(F.col("node_id").alias("target_id"), F.explode(F.array_distinct(F.from_json(F.get_json_object("payload", "$.env_vars_accessed"), "array<string>"))).alias("env"))
    j = b.groupBy("source_id", "env").agg(F.max("value").alias("value")).join(r, "env")
    return _edges(j, "BINDS_ENV", env_var=F.col("env"), env_value=F.col("value"))


def with_hash(edges: DataFrame) -> DataFrame:
    return edges.withColumn("edge_hash", edge_hash(F.col("source_id"), F.col("target_id"), F.col("edge_type"), F.lit(""), sorted_pairs(F.col("metadata"))))


def link(symbols: DataFrame, components: DataFrame) -> DataFrame:
    """All five kinds of edges of a workspace, one row per edge identity."""
    of = lambda *types: symbols.filter(F.col("node_type").isin(*types))
    routes, callers = of("RouteBinding", "FieldDefinition", "ObjectType", "Operation"), of("ApiClientCall")
    accessors = symbols.filter(F.size(target_tables(_meta("table_name"), F.col("payload"))) > 0).filter("language <> 'sql'")
    impls = symbols.filter((F.col("language") != "protobuf") & (_meta("implements_rpc").isNotNull() | _meta("service").isNotNull() | F.contains("identifier", F.lit("Server")) | F.contains("identifier", F.lit("Service")) | F.contains("node_type", F.lit("RPC"))))
    protos = symbols.filter("language = 'protobuf' and node_type in ('RPCMethod', 'Service')")
    resources = of("ResourceBlock", "BaseImage", "PortExpose")
    readers = symbols.filter(F.coalesce(F.size(F.from_json(F.get_json_object("payload", "$.env_vars_accessed"), "array<string>")), F.lit(0)) > 0)
    parts = [consumes_api(callers, routes), queries_table(accessors, of("CreateTableStatement")), implements_rpc(impls, protos), deploys_to(components, resources), binds_env(resources, readers)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return with_hash(out).dropDuplicates(["edge_hash"])


#: What the loss of an edge of each type is called.
BREAKAGE = {"CONSUMES_API": "ROUTE_REMOVED", "QUERIES_TABLE": "TABLE_REMOVED", "IMPLEMENTS_RPC": "RPC_REMOVED", "BINDS_ENV": "ENV_VAR_MISSING", "DEPLOYS_TO": "DEPLOY_TARGET_MISSING"}


def breakages(old: DataFrame, new: DataFrame, old_nodes: DataFrame, new_nodes: DataFrame) -> DataFrame:
    """source_id, target_id, edge_type, breakage, severity of old edges that are gone.

    An API edge breaks only if no new node has the old target's identifier and type. Plain call and
    dependency edges never break; a lost deployment is a warning, all else breaks.
    """
    gone = old.join(new.select("edge_hash"), "edge_hash", "left_anti").filter(F.col("edge_type").isin(*BREAKAGE))
    t = old_nodes.select(F.col("node_id").alias("target_id"), F.col("identifier").alias("_i"), F.col("node_type").alias("_n")).dropDuplicates(["target_id"])
    still = new_nodes.select(F.col("identifier").alias("_i"), F.col("node_type").alias("_n")).distinct().withColumn("_still", F.lit(True))
    j = gone.join(t, "target_id", "left").join(still, ["_i", "_n"], "left").filter("not (edge_type = 'CONSUMES_API' and coalesce(_still, false))")
    names = F.create_map(*[F.lit(x) for kv in BREAKAGE.items() for x in kv])
    return j.select("source_id", "target_id", "edge_type", names[F.col("edge_type")].alias("breakage"), F.when(F.col("edge_type") == "DEPLOYS_TO", "WARNING").otherwise("BREAKING").alias("severity"))
