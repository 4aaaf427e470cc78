"""Parent-child rows to full hierarchies.

Plan: components by pointer jumping (a row has one parent, so a component has exactly one root or
one loop), small components co-located and walked depth first with node colours, components above
``max_component`` finished by the jumps alone, which carry the same figures by the same rules. A round
triples the reach in one job; rows that have reached their root leave the iterated side.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.functions.common import dropped, latest_row, norm_key, staged

#: The spellings of "no parent", after trimming and lower-casing.
NO_PARENT = ("", "root", "universe-main", "0" * 40)

#: A component above this many nodes is never brought into one task.
MAX_COMPONENT = 100_000

HIERARCHY = T.StructType([
    T.StructField("node_key", T.StringType()),
    T.StructField("parent_key", T.StringType()),
    T.StructField("root_key", T.StringType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("path", T.ArrayType(T.StringType())),
    T.StructField("on_loop", T.BooleanType()),
    T.StructField("back_edge", T.BooleanType()),
])


def parent_links(df: DataFrame, key: Column, parent: Column, order: list[str] | None = None) -> DataFrame:
    """(node_key, parent_key) with one row per key; a parent that is a "no parent" value or has no row becomes null.

    Null and empty keys are no nodes. Of repeated keys the row with the largest ``order`` columns counts;
    ties fall to the larger parent. Other columns of ``df`` are ignored, so their names cannot clash.
    """
    order = order or []
    raw = df.select(
        key.alias("node_key"),
        F.when(parent.isin(*NO_PARENT), None).otherwise(parent).alias("parent_key"),
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
    ).filter(F.col("node_key").isNotNull() & (F.col("node_key") != ""))
    one = latest_row(raw, ["node_key"], [f"_o{i}" for i in range(len(order))], [*[f"_o{i}" for i in range(len(order))], "parent_key"]).select("node_key", "parent_key")
    one = staged(one)
    have = one.select(F.col("node_key").alias("_p"))
    return one.join(have, one.parent_key == have._p, "left").select("node_key", F.col("_p").alias("parent_key"))


def _jumped(side: DataFrame, to: DataFrame, extra: str | None = None) -> DataFrame:
    """``side`` with every pointer moved on by three of the pointers of ``to`` in one job: ptr, d and, where told, the least key on the way."""
    a = to.select(F.col("node_key").alias("_k"), F.col("ptr").alias("_ptr"), F.col("d").alias("_d"), F.col("done").alias("_done"), *([F.col(extra).alias("_x")] if extra else []))
    for _ in range(2):
        x = [F.least(extra, "_x").alias(extra)] if extra else []
        # a pointer that rests on a root stays there: the root points to itself over no distance
        side = side.join(a, side.ptr == a._k).select("node_key", "parent_key", F.col("_ptr").alias("ptr"), (F.col("d") + F.col("_d")).alias("d"), F.col("_done").alias("done"), *x)
    return side


def components(links: DataFrame) -> DataFrame:
    """node_key, parent_key, comp, depth, on_loop: the component's root (or the smallest key of its loop).

    ``depth`` is the distance to the root, or -1 where the ancestors lead into a loop. A round triples the reach of all rows whose
    pointer does not rest on a root yet, in one job that writes the state anew; the old state is removed. When a round
    leaves as many rows as the one before, no row's depth lies between the two reaches, so every row left leads into a loop.
    Those rows start again with the least key on their way, until their pointers only meet nodes of loops (the set of nodes pointed
    at no longer shrinks) and no loop's least key changes, which is when the reach has gone round every loop.
    """
    root = F.col("parent_key").isNull()
    state = staged(links.select("node_key", "parent_key", F.coalesce("parent_key", "node_key").alias("ptr"), F.when(root, 0).otherwise(1).cast("bigint").alias("d"), root.alias("done")))
    before, n = -1, state.filter("not done").count()
    while n and n != before:
        new = staged(state.filter("done").unionByName(_jumped(state.filter("not done"), state)))
        dropped(state)
        state, before, n = new, n, new.filter("not done").count()
    trees = state.filter("done").select("node_key", "parent_key", F.col("ptr").alias("comp"), F.col("d").cast("int").alias("depth"), F.lit(False).alias("on_loop"))
    if not n:
        return trees
    loops = staged(state.filter("not done").select("node_key", "parent_key", F.col("parent_key").alias("ptr"), F.lit(1).cast("bigint").alias("d"), F.lit(False).alias("done"), F.col("node_key").alias("low")))
    was = None
    while True:
        met = loops.select(F.col("ptr").alias("_l")).distinct()
        ring = loops.join(met, loops.node_key == met._l, "left_semi").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node_key", "low").cast("decimal(38,0)")).alias("s")).first()
        if was is not None and was == (ring.n, ring.s):
            break
        was = (ring.n, ring.s)
        new = staged(_jumped(loops, loops, "low"))
        dropped(loops)
        loops = new
    met = loops.select(F.col("ptr").alias("_l")).distinct()
    to = loops.join(met, loops.node_key == met._l, "left_semi").select(F.col("node_key").alias("_k"), F.col("low").alias("comp"))
    looped = loops.join(to, loops.ptr == to._k).join(met, loops.node_key == met._l, "left").select("node_key", "parent_key", "comp", F.lit(-1).alias("depth"), F.col("_l").isNotNull().alias("on_loop"))
    return trees.unionByName(looped)


_WHITE, _GREY, _BLACK = 0, 1, 2


def _walk(nodes: list[str], parents: list[str | None], with_path: bool) -> Iterator[tuple]:
    """Iterative depth-first walk of one component with node colours. Yields HIERARCHY rows, paths only if asked for.

    A tree is walked down from its root; a component without one from the smallest key of its loop, which a climb finds. A node is
    grey while its branch is open; a step down to a grey node closes a loop and is the back edge.
    """
    up = dict(zip(nodes, parents, strict=True))
    children: dict[str | None, list[str]] = {}
    for k, p in up.items():
        children.setdefault(p, []).append(k)
    for v in children.values():
        v.sort()
    loop: set[str] = set()
    if None not in children:
        k, trail = min(up), {}
        while k not in trail:
            trail[k] = len(trail)
            k = up[k]
        loop = set(list(trail)[trail[k]:])
    colour = dict.fromkeys(up, _WHITE)
    back: set[str] = set()
    for root in children.get(None, []) or [min(loop)]:
        stack, path = [(root, iter(children.get(root, ())))], [root]
        colour[root] = _GREY
        while stack:
            k, rest = stack[-1]
            for c in rest:
                if colour[c] == _GREY:
                    back.add(c)
                elif colour[c] == _WHITE:
                    colour[c] = _GREY
                    stack.append((c, iter(children.get(c, ()))))
                    path.append(c)
                    break
            else:
                stack.pop()
                yield k, up[k], root, -1 if loop else len(path) - 1, list(path) if with_path and not loop else None, k in loop, k in back
                path.pop()
                colour[k] = _BLACK


#: Rows and path elements a walked batch holds at most.
_ROWS, _CELLS = 20_000, 1_000_000


def _walk_batches(with_path: bool):
    schema = pa.schema([("node_key", pa.string()), ("parent_key", pa.string()), ("root_key", pa.string()), ("depth", pa.int32()),
                        ("path", pa.list_(pa.string())), ("on_loop", pa.bool_()), ("back_edge", pa.bool_())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
        """The sorted rows, one component at a time."""
        nodes, parents, comp = [], [], None
        for b in batches:
            for c, k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if c != comp and nodes:
                    yield nodes, parents
                    nodes, parents = [], []
                comp = c
                nodes.append(k)
                parents.append(p)
        if nodes:
            yield nodes, parents

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, cells = [], 0
        for nodes, parents in members(batches):
            for row in _walk(nodes, parents, with_path):
                rows.append(row)
                cells += len(row[4]) if row[4] else 0
                if len(rows) >= _ROWS or cells >= _CELLS:
                    yield batch(rows)
                    rows, cells = [], 0
        yield batch(rows)

    return go


def hierarchy(links: DataFrame, *, max_component: int = MAX_COMPONENT, with_path: bool = True) -> DataFrame:
    """Per node: node_key, parent_key, root_key, depth, path, on_loop, back_edge.

    ``links`` has one row per node_key and a parent_key that is null or a node (see ``parent_links``).
    Nodes on a loop, or below one, get depth -1, the loop's smallest key as root and a null path. A loop's back edge is the
    link of its smallest key, at any size: what a walk down from that key meets last. An empty table gives an empty result.
    Components of up to ``max_component`` nodes are co-located and walked depth first, several to a task; larger ones, which may
    hold any share of the rows, never meet in one task: their depth, root and loop are the pointers', and their
    paths are joined from segments. Without ``with_path`` all paths are null, and no row is longer for being deep.
    """
    found = staged(components(links))
    giants = found.groupBy("comp").agg(F.count("*").alias("_n")).filter(F.col("_n") > max_component).select("comp")
    some = not giants.isEmpty()
    small = found.join(giants, "comp", "left_anti") if some else found
    walked = (small.select("comp", "node_key", "parent_key").repartition("comp").sortWithinPartitions("comp", "node_key")
              .mapInArrow(_walk_batches(with_path), HIERARCHY))
    if not some:
        return walked
    big = staged(found.join(giants, "comp", "left_semi"))
    rows = big.select("node_key", "parent_key", F.col("comp").alias("root_key"), "depth", "on_loop")
    if with_path:
        rows = rows.join(_doubled_paths(big.filter("depth >= 0")), "node_key", "left")
    else:
        rows = rows.withColumn("path", F.lit(None).cast("array<string>"))
    rows = rows.select("node_key", "parent_key", "root_key", "depth", "path", "on_loop", (F.col("on_loop") & (F.col("node_key") == F.col("root_key"))).alias("back_edge"))
    return walked.unionByName(rows)


def _doubled_paths(trees: DataFrame) -> DataFrame:
    """node_key, path for tree nodes: segments (ancestors above, self last) doubled until the root heads them."""
    seg = staged(trees.select("node_key", F.col("parent_key").alias("ptr"), F.array("node_key").alias("path")))
    while not (live := seg.filter("ptr is not null")).isEmpty():
        to = seg.select(F.col("node_key").alias("_k"), F.col("ptr").alias("_ptr"), F.col("path").alias("_path"))
        step = live.join(to, live.ptr == to._k).select("node_key", F.col("_ptr").alias("ptr"), F.concat("_path", "path").alias("path"))
        new = staged(seg.filter("ptr is null").unionByName(step))
        dropped(seg)
        seg = new
    return seg.select("node_key", "path")


def descendants(h: DataFrame, *also: str) -> DataFrame:
    """(ancestor_key, descendant_key, distance) of every proper ancestor pair: the paths unnested, so no join is needed.

    ``also`` names columns of ``h`` to carry along.
    """
    return (h.filter("depth > 0").select(*also, "node_key", "depth", F.posexplode(F.slice("path", F.lit(1), F.col("depth"))).alias("_p", "ancestor_key"))
            .select(*also, "ancestor_key", F.col("node_key").alias("descendant_key"), (F.col("depth") - F.col("_p")).alias("distance")))


def all_descendants(links: DataFrame) -> DataFrame:
    """(ancestor_key, descendant_key) of every pair, loops included: all nodes of a loop are above each other, themselves and all below the loop.

    What hangs below a loop is taken as trees, whose roots are the children of the loop's nodes; their paths are doubled.
    """
    h = staged(hierarchy(links))
    pairs = descendants(h).select("ancestor_key", "descendant_key")
    looped = h.filter("depth < 0").select("node_key", "parent_key", "root_key", "on_loop")
    if looped.isEmpty():
        return pairs
    ring = looped.filter("on_loop").select(F.col("root_key").alias("_r"), F.col("node_key").alias("ancestor_key"))
    around = looped.join(ring, looped.root_key == ring._r).select("ancestor_key", F.col("node_key").alias("descendant_key"))
    tails = looped.filter("not on_loop").join(ring, F.col("parent_key") == F.col("ancestor_key"), "left")
    tails = _doubled_paths(tails.select("node_key", F.when(F.col("ancestor_key").isNull(), F.col("parent_key")).alias("parent_key")))
    return pairs.unionByName(around).unionByName(descendants(tails.withColumn("depth", F.size("path") - 1)).select("ancestor_key", "descendant_key"))


def proposal_links(df: DataFrame) -> DataFrame:
    return parent_links(df, norm_key("change_id"), norm_key("parent_change_id"), ["updated_at", "ingested_at"])


def commit_links(df: DataFrame) -> DataFrame:
    return parent_links(df, norm_key("commit_hash"), norm_key("parent_hash"), ["committed_at", "ingested_at"])
