"""Content identities: canonical texts hashed with SHA-256, Merkle roots, synthetic git hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.functions.common import cut, ranked


def sorted_pairs(m: Column) -> Column:
    """A map as k=v pairs in key order, joined by ;"""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def dependency_list(a: Column, b: Column) -> Column:
    """Sorted distinct union of two lists without empty strings."""
    both = F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))
    return F.array_sort(F.filter(F.array_distinct(both), lambda x: x.isNotNull() & (x != "")))


def _lines(*parts: tuple[str, Column]) -> Column:
    return F.concat(*[F.concat(F.lit(k + ":"), F.coalesce(v, F.lit("")), F.lit("\n")) for k, v in parts])


def edge_hash(source: Column, target: Column, kind: Column, schema_id: Column, pairs: Column) -> Column:
    """Fixed value: the line format of an edge's identity."""
    return F.sha2(F.concat(F.lit("cross_boundary_edge:v1\n"), _lines(("source", source), ("target", target), ("type", kind), ("contract_schema_id", schema_id), ("metadata", pairs))), 256)


def lineage_content_hash(user: Column, prompt: Column, orchestrator: Column, agent: Column, model: Column, params: Column, intent: Column) -> Column:
    """Fixed value: the line format of provenance without session, time and signature."""
    return F.sha2(F.concat(F.lit("lineage_content:v1\n"), _lines(("user_id", user), ("user_prompt", prompt), ("orchestrator_agent_id", orchestrator), ("executing_agent_id", agent), ("llm_version", model),
                                                               ("generation_params", params), ("intent", intent))), 256)


def symbol_hash(language: Column, node_type: Column, identifier: Column, signature: Column, docstring: Column, visibility: Column, pairs: Column, payload: Column, deps: Column, lineage_hash: Column) -> Column:
    """Fixed value: the line format of a symbol's identity; empty optional lines are left out."""
    def opt(k: str, v: Column) -> Column:
        return F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(k + ":"), v, F.lit("\n"))).otherwise("")
    head = F.concat(F.lit("ast_symbol_node:v1\n"), _lines(("language", language), ("node_type", node_type), ("identifier", identifier)))
    return F.sha2(F.concat(head, opt("signature", signature), opt("docstring", docstring), opt("visibility", visibility), opt("metadata", pairs),
                           _lines(("payload_sha256", F.sha2(F.coalesce(payload, F.lit("")), 256)), ("local_dependencies", F.array_join(deps, ",")), ("lineage_hash", lineage_hash))), 256)


def merkle_roots(leaves: DataFrame, group: str, leaf: str) -> DataFrame:
    """group, root: pairwise tree over each group's sorted leaves, one aggregate per level.

    Leaves are ranked once; every further level halves the rows by their position, so no group is ever
    gathered in one row. The last of an odd level is paired with itself; a single leaf is hashed as such.
    """
    n = leaves.groupBy(group).agg(F.count("*").alias("n"))
    level = cut(ranked(leaves.select(group, F.col(leaf).alias("h")), [group], ["h"]).join(n, group))
    out = level.filter("n = 1").select(group, F.sha2(F.concat(F.lit("merkle_leaf:"), F.col("h")), 256).alias("root"))
    level = level.filter("n > 1")
    while not level.isEmpty():
        pair = level.groupBy(group, "n", F.floor(F.col("pos") / 2).alias("p")).agg(F.min(F.struct("pos", "h")).alias("a"), F.max(F.struct("pos", "h")).alias("b"))
        level = cut(pair.select(group, F.ceil(F.col("n") / 2).alias("n"), F.sha2(F.concat(F.lit("merkle_node:"), F.col("a.h"), F.lit(":"), F.col("b.h")), 256).alias("h"), F.col("p").alias("pos")))
        out = out.unionByName(level.filter("n = 1").select(group, F.col("h").alias("root")))
        level = level.filter("n > 1")
    return out


def state_fingerprint(df: DataFrame, name: str, content: str) -> DataFrame:
    """fingerprint: SHA-256 of the name:hash pairs in order, joined by commas; they pass as a sorted stream, never gathered in one row."""
    from weftwork.operators.history import ordered_digest

    pair = F.concat(F.col(name), F.lit(":"), F.col(content))
    return ordered_digest(df, F.lit("all"), [pair], pair, "sha256", separator=",").select(F.col("digest").alias("fingerprint"))


def git_blob_hash(text: Column) -> Column:
    """SHA-1 of a git blob."""
    return F.sha1(F.concat(F.lit("blob "), F.octet_length(text).cast("string"), F.lit("\0"), text))
