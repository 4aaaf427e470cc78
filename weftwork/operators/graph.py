"""Traversal of typed property graphs as iterated frontier joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions.common import cut, staged


def scan_nodes(nodes: DataFrame, language: str = "", node_type: str = "") -> DataFrame:
    """Nodes by optional equality; an empty argument is no predicate, and both reach the scan."""
    if language:
        nodes = nodes.filter(F.col("language") == language)
    return nodes.filter(F.col("node_type") == node_type) if node_type else nodes


def scan_edges(edges: DataFrame, source: str = "", target: str = "", edge_type: str = "") -> DataFrame:
    for col, v in (("source_id", source), ("target_id", target), ("edge_type", edge_type)):
        if v:
            edges = edges.filter(F.col(col) == v)
    return edges


def traverse(edges: DataFrame, starts: DataFrame, *, backward: bool = False, max_depth: int = 0, edge_types: list[str] | None = None, with_path: bool = True) -> DataFrame:
    """node_id, depth, path of every node reached from ``starts`` (node_id), the starts included at depth 0.

    One join per level: the frontier meets the edges on its node, and what was seen before is dropped, so a
    level costs its own edges and one shuffle of the visited keys. depth is the shortest distance, path the least
    shortest path in array order (so ties do not depend on row order). ``max_depth`` of 0 is no limit. Loops end
    by themselves; starts need not be nodes. Null ids are dropped; repeated edges and starts count once.
    Without ``with_path`` all paths are null and a level carries keys only.
    """
    frm, to = ("target_id", "source_id") if backward else ("source_id", "target_id")
    e = edges.filter(F.col("edge_type").isin(edge_types)) if edge_types else edges
    e = e.filter(F.col(frm).isNotNull() & F.col(to).isNotNull()).select(F.col(frm).alias("_f"), F.col(to).alias("_t"))
    if max_depth != 1:
        e = staged(e)  # every level reads it again: two columns, whatever the edges are made from
    frontier = cut(starts.select("node_id").filter("node_id is not null").distinct().select("node_id", (F.array("node_id") if with_path else F.lit(None).cast("array<string>")).alias("path")))
    levels = [frontier.withColumn("depth", F.lit(0))]
    seen = frontier.select("node_id")
    depth = 0
    while not max_depth or depth < max_depth:
        depth += 1
        met = frontier.join(e, frontier.node_id == e._f)
        if with_path:
            step = met.groupBy("_t").agg(F.min(F.concat("path", F.array("_t"))).alias("path")).withColumnRenamed("_t", "node_id")
        else:
            step = met.select(F.col("_t").alias("node_id")).distinct().withColumn("path", F.lit(None).cast("array<string>"))
        frontier = cut(step.join(seen, "node_id", "left_anti").select("node_id", "path"))
        if frontier.isEmpty():
            break
        levels.append(frontier.withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier.select("node_id"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.select("node_id", "depth", "path")


def visited_edges(edges: DataFrame, reached: DataFrame, *, backward: bool = False, max_depth: int = 0, edge_types: list[str] | None = None) -> DataFrame:
    """Every matching edge of every expanded node, loop-closing ones included; nodes at the depth limit are not expanded."""
    e = edges.filter(F.col("edge_type").isin(edge_types)) if edge_types else edges
    r = reached.filter(F.col("depth") < max_depth) if max_depth else reached
    return e.join(r.select(F.col("node_id").alias("target_id" if backward else "source_id")), "target_id" if backward else "source_id", "left_semi")


def shortest_path(edges: DataFrame, starts: DataFrame, target: str, **kw) -> DataFrame:
    """step, node_id, edge_type of the least shortest path to ``target``; edge_type leads into the node, null at the start. Empty if unreachable."""
    p = traverse(edges, starts, **kw).filter(F.col("node_id") == target).select(F.posexplode("path").alias("step", "node_id"), "path")
    p = p.withColumn("prev", F.when(F.col("step") > 0, F.get("path", F.col("step") - 1)))
    e = edges.groupBy(F.col("source_id").alias("prev"), F.col("target_id").alias("node_id")).agg(F.min("edge_type").alias("edge_type"))
    return p.join(e, ["prev", "node_id"], "left").select("step", "node_id", "edge_type")


def impact(edges: DataFrame, node_id: str) -> DataFrame:
    """direction, neighbour, edge_type of one node's edges."""
    out = edges.filter(F.col("source_id") == node_id).select(F.lit("out").alias("direction"), F.col("target_id").alias("neighbour"), "edge_type")
    return out.unionByName(edges.filter(F.col("target_id") == node_id).select(F.lit("in").alias("direction"), F.col("source_id").alias("neighbour"), "edge_type")).distinct()


def impact_risk(edges: DataFrame, node_id: str) -> DataFrame:
    """n_neighbours and risk: 0.1 without neighbours, 0.5 up to two, else 0.9."""
    n = impact(edges, node_id).agg(F.countDistinct("neighbour").alias("n_neighbours"))
    return n.select("n_neighbours", F.when(F.col("n_neighbours") == 0, 0.1).when(F.col("n_neighbours") <= 2, 0.5).otherwise(0.9).alias("risk"))
