"""Filling containers of fixed capacity.

Items are dealt to partitions of bounded size by a hash and packed there by best-fit decreasing. Dual
feasible functions bound from below how many containers each partition needs; a partition that meets
its bound is certified and rests. The others send the items of their containers that are not full to one another:
those are dealt anew by another hash and packed again, as long as that saves containers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions.common import staged
from weftwork.llm.tokens import VOCABULARY, token_counts

#: Items a task packs at once, and capacities whose items are made in one step.
PER_PARTITION = 100_000
SPECS = 1_000


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The least number of containers, by dual feasible functions: the trivial sum, the threshold family and the staircase family."""
    x = np.sort(np.asarray(sizes, np.int64))
    x = x[x > 0]
    if not len(x):
        return 0
    best = math.ceil(int(x.sum()) / capacity)
    # threshold family: above capacity - e counts as whole, below e as nothing
    total = np.concatenate([[0], np.cumsum(x)])
    e = np.unique(np.minimum(x, capacity - x))
    e = e[(e >= 0) & (2 * e <= capacity)]
    lo, hi = np.searchsorted(x, e, "left"), np.searchsorted(x, capacity - e, "right")
    mid = np.where(hi > lo, total[np.maximum(hi, lo)] - total[lo], 0)
    whole = (len(x) - np.maximum(hi, lo)) * capacity + mid
    best = max(best, int(-(-whole.max(initial=0) // capacity)))
    # staircase family: sizes rounded to k-ths of the capacity
    size, n = np.unique(x, return_counts=True)
    for k in range(1, 21):
        y = size * (k + 1)
        exact = y % capacity == 0
        # in units of 1 / (k * capacity)
        f = np.where(exact, size * k, (y // capacity) * capacity)
        best = max(best, int(-(-int((f * n).sum()) // (k * capacity))))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(container of each item, number of containers). Open containers are kept by free space in a bit set, so a step costs one lowest-bit search."""
    order = np.argsort(-np.asarray(sizes), kind="stable")
    into = np.empty(len(order), np.int64)
    free: dict[int, list[int]] = {}
    have, n = 0, 0
    for i in order.tolist():
        s = int(sizes[i])
        m = have >> s
        if m:
            r = s + (m & -m).bit_length() - 1
            held = free[r]
            b = held.pop()
            if not held:
                have &= ~(1 << r)
        else:
            r, b, n = capacity, n, n + 1
        into[i] = b
        left = r - s
        if left:
            free.setdefault(left, []).append(b)
            have |= 1 << left
    return into, n


def _pack(prefix: str):
    """Batches of (spec_name, capacity_tokens, part, doc_id, piece_no, first_token, size), sorted by (spec_name, part)."""
    names = ["spec_name", "capacity_tokens", "part", "doc_id", "piece_no", "first_token", "size", "container_id", "fill", "gap"]
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def finish(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(tables).combine_chunks()
        spec, cap, part = t.column(0)[0].as_py(), t.column(1)[0].as_py(), t.column(2)[0].as_py()
        size = t.column(6).to_numpy()
        into, n = best_fit_decreasing(size, cap)
        fill = np.bincount(into, size, minlength=n).astype(np.int64)
        label = np.array([f"{prefix}-{spec}-{part}-{b}" for b in range(n)], object)
        cols = [c.combine_chunks() for c in t.columns] + [pa.array(label[into], pa.string()), pa.array(fill[into]), pa.array(np.full(len(size), n - lower_bound(size, cap)))]
        return pa.RecordBatch.from_arrays([c.cast(ty) for c, ty in zip(cols, types, strict=True)], names=names)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = list(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True))
            start = 0
            for i in range(1, len(keys) + 1):
                if i < len(keys) and keys[i] == keys[start]:
                    continue
                if keys[start] != key and held:
                    yield finish(held)
                    held = []
                key = keys[start]
                held.append(b.slice(start, i - start))
                start = i
        if held:
            yield finish(held)

    return go


_ITEM = ["spec_name", "capacity_tokens", "part", "doc_id", "piece_no", "first_token", "size"]
_PACKED = "spec_name string, capacity_tokens int, part bigint, doc_id bigint, piece_no int, first_token bigint, size bigint, container_id string, fill bigint, gap bigint"


def _deal(items: DataFrame, n: int, salt: int, prefix: str) -> DataFrame:
    dealt = items.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(salt)), F.lit(n)))
    by = ["spec_name", "part"]
    return dealt.select(*_ITEM).repartition(*by).sortWithinPartitions(*by, F.col("size").desc(), "doc_id", "piece_no").mapInArrow(_pack(prefix), _PACKED)


def pieces(counts: DataFrame, specs: list[tuple[str, int]]) -> DataFrame:
    """spec_name, capacity_tokens, doc_id, piece_no, first_token, size: documents whole, larger ones in runs of a full capacity and a rest."""
    cap = F.col("capacity_tokens").cast("bigint")
    both = counts.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(a).alias("spec_name"), F.lit(b).alias("capacity_tokens")) for a, b in specs]))).select("doc_id", "n_tokens", "_s.*")
    return (both.withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / cap) - 1, F.lit(0)).cast("int"))))
            .select("spec_name", F.col("capacity_tokens").cast("int").alias("capacity_tokens"), "doc_id", "piece_no", (F.col("piece_no") * cap).alias("first_token"),
                    F.least(F.col("n_tokens") - F.col("piece_no") * cap, cap).alias("size")))


def pack(docs: DataFrame, specs: DataFrame, *, vocabulary: str = VOCABULARY, per_partition: int = PER_PARTITION) -> DataFrame:
    """spec_name, capacity_tokens, doc_id, piece_no, first_token, size, container_id, fill, gap.

    ``docs`` has unique doc_id and text, ``specs`` spec_name and capacity_tokens; capacities that are null or not above 0 do not count.
    Documents of null or empty text have size 0 and lie in containers like others. gap is how many containers the partition
    that packed the item used beyond its certified lower bound. Partitions exchange items until a round saves no container.
    """
    counts, items, some = staged(token_counts(docs, vocabulary=vocabulary)), None, []
    for r in specs.select("spec_name", "capacity_tokens").filter("capacity_tokens > 0").distinct().toLocalIterator():
        some.append((r[0], int(r[1])))
        if len(some) == SPECS:
            items = pieces(counts, some) if items is None else items.unionByName(pieces(counts, some))
            some = []
    if some or items is None:
        rest = pieces(counts, some) if some else pieces(counts, [("", 1)]).limit(0)
        items = rest if items is None else items.unionByName(rest)
    n_docs = counts.count()
    parts = max(1, math.ceil(n_docs / per_partition))
    done = staged(_deal(items, parts, 0, "r0"))
    kept = [done]
    r = 0
    while True:
        r += 1
        last = kept.pop()
        loose = (F.col("gap") > 0) & (F.col("fill") < F.col("capacity_tokens"))
        pool = last.filter(loose)
        was = pool.agg(F.count("*").alias("n"), F.countDistinct("container_id").alias("c")).first()
        if not was.n:
            kept.append(last)
            break
        again = staged(_deal(pool.select(*_ITEM), max(1, math.ceil(was.n / per_partition)), r, f"r{r}"))
        now = again.agg(F.countDistinct("container_id").alias("c")).first()
        if now.c >= was.c:
            kept.append(last)
            break
        kept += [last.filter(~loose), again]
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out.drop("part")


def containers(packed: DataFrame) -> DataFrame:
    """spec_name, container_id, n_items, fill_tokens, free_tokens."""
    return packed.groupBy("spec_name", "capacity_tokens", "container_id").agg(F.count("*").alias("n_items"), F.sum("size").alias("fill_tokens")).select(
        "spec_name", "container_id", "n_items", "fill_tokens", (F.col("capacity_tokens") - F.col("fill_tokens")).alias("free_tokens"))


def _bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One group of (spec_name, capacity_tokens, size, n) at a time; a spec has at most capacity + 1 distinct sizes."""
    rows: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for b in batches:
        for s, c, z, n in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            rows.setdefault((s, c), []).append((z, n))
    out = [(s, _weighted_bound(np.array(v, np.int64), c)) for (s, c), v in rows.items()]
    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64())], names=["spec_name", "least_containers"])


def _weighted_bound(v: np.ndarray, cap: int) -> int:
    v = v[v[:, 0] > 0]
    if not len(v):
        return 0
    v = v[np.argsort(v[:, 0])]
    x, n = v[:, 0], v[:, 1]
    best = -(-int((x * n).sum()) // cap)
    total, count = np.concatenate([[0], np.cumsum(x * n)]), np.concatenate([[0], np.cumsum(n)])
    e = np.unique(np.minimum(x, cap - x))
    e = e[(e >= 0) & (2 * e <= cap)]
    lo, hi = np.searchsorted(x, e, "left"), np.searchsorted(x, cap - e, "right")
    hi = np.maximum(hi, lo)
    best = max(best, int((-(-((count[-1] - count[hi]) * cap + total[hi] - total[lo]) // cap)).max(initial=0)))
    for k in range(1, 21):
        y = x * (k + 1)
        f = np.where(y % cap == 0, x * k, (y // cap) * cap)
        best = max(best, -(-int((f * n).sum()) // (k * cap)))
    return best


def bounds(packed: DataFrame) -> DataFrame:
    """spec_name, n_containers, least_containers (certified over all items), waste (unused share of the containers)."""
    hist = packed.groupBy("spec_name", "capacity_tokens", "size").agg(F.count("*").alias("n"))
    least = hist.repartition("spec_name").mapInArrow(_bound, "spec_name string, least_containers bigint")
    used = packed.groupBy("spec_name", "capacity_tokens").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("size").alias("t"))
    return used.join(least, "spec_name").select("spec_name", "n_containers", "least_containers", (1 - F.col("t") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("waste"))
