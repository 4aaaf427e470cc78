"""Dense vectors: deterministic text embedding, cosine, top-k search of one query with a filter and of many in blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Numbers a block of vectors holds at most, and scores computed at a time.
_BLOCK, _CELLS = 1 << 20, 1 << 20


def bucket(w: Column, dim: int) -> Column:
    """First four bytes of SHA-256, modulo the dimension."""
    return (F.conv(F.substring(F.sha2(w, 256), 1, 8), 16, 10).cast("bigint") % dim).cast("int")


@lru_cache(200_000)
def _slots(word: str, dim: int) -> tuple[int, ...]:
    """A word's buckets, its own twice: words repeat, so their hashes are kept."""
    at = lambda s: int.from_bytes(hashlib.sha256(s.encode()).digest()[:4], "big") % dim
    return (at(word), at(word), *[at(word[i:i + 3]) for i in range(len(word) - 2)])


def _embedder(dim: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((b.num_rows, dim))
            for i, t in enumerate(b.column(1).to_pylist()):
                slots = [x for w in (t or "").lower().split() for x in _slots(w, dim)]
                if slots:
                    v = np.bincount(slots, minlength=dim)
                    out[i] = v / np.sqrt((v * v).sum())
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, (b.num_rows + 1) * dim, dim), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), vectors], names=["k", "vector"])

    return go


def embed(df: DataFrame, key: str, text: str, dim: int = 128) -> DataFrame:
    """key, vector: words count 2, their character trigrams 1, by bucket; L2-normalised, zero for empty and null texts.

    In Arrow batches, without a shuffle: hashing every trigram of every text in the JVM took ten times as long
    as hashing each distinct word once per worker.
    """
    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(_embedder(dim), f"k {kind}, vector array<double>").withColumnRenamed("k", key)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, vectors of other lengths and zero norms."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def search(vectors: DataFrame, query: list[float], *, k: int = 10, min_score: float = 0.0, where: Column | None = None, key: str = "vec_id") -> DataFrame:
    """The k nearest by cosine, ties by key; a filter and a least score (if above 0) first. Sorted per partition, so only k rows a task move."""
    if where is not None:
        vectors = vectors.filter(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    s = vectors.select(key, cosine(F.col("vector"), q).alias("score"))
    if min_score > 0:
        s = s.filter(F.col("score") >= min_score)
    return s.orderBy(F.desc("score"), key).limit(k)


def _ragged(col: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of vector; nulls and empty vectors are left out."""
    col = col.combine_chunks()
    n = np.asarray(col.value_lengths().fill_null(0))
    out = []
    for size in set(n.tolist()) - {0}:
        at = np.flatnonzero(n == size)
        out.append((at, np.asarray(col.take(pa.array(at)).flatten(), dtype=np.float64).reshape(-1, size)))
    return out


def _serial(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row products summed from the first number to the last, as ``dot`` sums them, so equal vectors score alike wherever they lie."""
    s = np.zeros(len(a))
    for j in range(a.shape[1]):
        s += a[:, j] * b[:, j]
    return s


def _scores(qs: list[tuple[np.ndarray, np.ndarray]], lo: int, hi: int, vs: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Cosines of the queries lo to hi with n vectors, right to about 1e-12: 0 for other lengths and zero norms."""
    out = np.zeros((hi - lo, n))
    for qa, q in qs:
        mine = (qa >= lo) & (qa < hi)
        for va, v in vs:
            if mine.any() and q.shape[1] == v.shape[1]:
                norm = np.sqrt((q[mine] ** 2).sum(1))[:, None] * np.sqrt((v ** 2).sum(1))[None, :]
                out[np.ix_(qa[mine] - lo, va)] = np.divide(q[mine] @ v.T, norm, out=np.zeros(norm.shape), where=norm > 0)
    return out


def _exact(q: dict[int, np.ndarray], v: dict[int, np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """The cosines of some (query, vector) pairs, summed as ``cosine`` sums them."""
    out = np.zeros(len(pairs))
    size = np.array([len(q[a]) if a in q and b in v and len(q[a]) == len(v[b]) else 0 for a, b in pairs.tolist()], dtype=int)
    for d in set(size.tolist()) - {0}:
        at = np.flatnonzero(size == d)
        x, y = np.stack([q[a] for a in pairs[at, 0].tolist()]), np.stack([v[b] for b in pairs[at, 1].tolist()])
        norm = np.sqrt(_serial(x, x)) * np.sqrt(_serial(y, y))
        out[at] = np.divide(_serial(x, y), norm, out=np.zeros(len(at)), where=norm > 0)
    return out


def _block_search(k: int, min_score: float):
    """The k best of a block of vectors for each of a block of queries: a product finds all that may be among them, their scores are then summed exactly."""
    def go(_, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        keys, n = vectors["key"], vectors.num_rows
        order = np.empty(n, dtype=np.int64)
        order[np.asarray(pa.compute.sort_indices(keys))] = np.arange(n)  # ties fall to the lesser key
        qs, vs = _ragged(queries["vector"]), _ragged(vectors["vector"])
        q = {i: r for at, m in qs for i, r in zip(at.tolist(), m, strict=True)}
        v = {i: r for at, m in vs for i, r in zip(at.tolist(), m, strict=True)}
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(1, _CELLS // max(1, n))
        for lo in range(0, queries.num_rows if n else 0, step):
            hi = min(lo + step, queries.num_rows)
            s = _scores(qs, lo, hi, vs, n)
            least = np.partition(s, n - k, axis=1)[:, n - k] if n > k else np.full(hi - lo, -np.inf)
            for i in range(hi - lo):
                may = np.flatnonzero(s[i] >= least[i] - 1e-9)
                pairs = np.column_stack([np.full(len(may), lo + i), may])
                score = _exact(q, v, pairs)
                best = np.lexsort((order[may], -score))[:k]
                if min_score > 0:
                    best = best[score[best] >= min_score]
                found.append((pairs[best, 0], may[best], score[best]))
        a, b, c = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))
        return pa.table({"query": queries["query"].take(pa.array(a, pa.int64())), "key": keys.take(pa.array(b, pa.int64())), "score": pa.array(c, pa.float64())})

    return go


def search_many(vectors: DataFrame, queries: DataFrame, *, k: int = 10, min_score: float = 0.0, key: str = "vec_id", block: int | None = None) -> DataFrame:
    """query, key, score, pos of each query's k nearest by cosine, ties by key; ``queries`` has the columns of ``vectors``.

    Both sides are dealt into blocks of ``block`` rows (by default of about a million numbers), and each pair of blocks is one
    group, so no task holds more than two blocks whatever either side's size. A pair gives k rows a query, of which the k
    best are kept before and after they meet. All pairs are compared: the work grows with the product of both sides.
    """
    kind = vectors.select(key).schema[0].dataType.simpleString()
    size = lambda df: df.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    (nv, dv), (nq, dq) = size(vectors), size(queries)
    per = block or max(1, _BLOCK // max(1, dv, dq))
    bv, bq = -(-nv // per) or 1, -(-nq // per) or 1
    deal = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    v = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(bq - 1))).alias("_q"), deal(bv).alias("_v"), F.col(key).alias("key"), "vector")
    q = queries.select(deal(bq).alias("_q"), F.explode(F.sequence(F.lit(0), F.lit(bv - 1))).alias("_v"), F.col(key).alias("query"), "vector")
    near = q.groupBy("_q", "_v").cogroup(v.groupBy("_q", "_v")).applyInArrow(_block_search(k, min_score), f"query {kind}, key {kind}, score double")
    by = W.partitionBy("query").orderBy(F.desc("score"), "key")
    return near.withColumn("pos", F.row_number().over(by)).filter(F.col("pos") <= k).select("query", F.col("key").alias(key), "score", "pos")


def vector_key(node: Column, intent: Column, prompt: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", node, intent, prompt), 256), 1, 16)
