"""Long exact spans shared between records.

Texts are cut into sentences by content alone: a cut stands where the hash of the preceding eight
characters is the least within a window of WIDTH positions, statement ends being preferred, so two
texts have the same cuts inside a span they share, and no sentence is longer than WIDTH. Every run of
consecutive sentences of at least RUN characters is hashed; with 4 * WIDTH + RUN + 6 <= min_chars, any shared
span of min_chars holds at least one such run whole. Runs whose hash occurs twice mark the places where
all windows of exactly min_chars are hashed and joined globally, which settles the question exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions.common import cut, staged

#: Characters that end a statement or sentence.
ENDS = "\n;{}.!?。！？"

_GRAM = 8
_CHUNK = 400_000
_B = 0x9E3779B97F4A7C15 | 1
_BASE, _BASE_INV = np.uint64(_B), np.uint64(pow(_B, -1, 1 << 64))


def widths(min_chars: int) -> tuple[int, int]:
    """(WIDTH, RUN) for a span length."""
    width = max(1, (min_chars - 6) // 6)
    return width, max(1, min_chars - 6 - 4 * width)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunks(texts: list[str | None], least: int) -> Iterator[list[int]]:
    rows, n = [], 0
    for i, t in enumerate(texts):
        if t is None or len(t) < least:
            continue
        rows.append(i)
        n += len(t)
        if n >= _CHUNK:
            yield rows
            rows, n = [], 0
    if rows:
        yield rows


class Prints:
    """Position-independent hashes of any span of a chunk of texts laid end to end."""

    def __init__(self, texts: list[str]) -> None:
        self.code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.size = np.array([len(t) for t in texts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        n = len(self.code) + 1
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE, np.uint64)]))
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE_INV, np.uint64)]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(self.code.astype(np.uint64) + np.uint64(1)) * power[:-1])])

    def span(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mix((self.sums[hi] - self.sums[lo]) * self.back[lo] + (hi - lo).astype(np.uint64))

    def runs(self, width: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, end) of every run of consecutive sentences that first reaches ``run`` characters."""
        n = len(self.code)
        at = np.arange(_GRAM - 1, n)
        value = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        value[at] = self.span(at - _GRAM + 1, at + 1) | np.uint64(1 << 63)
        ends = np.isin(self.code, [ord(c) for c in ENDS])
        value[ends] &= np.uint64((1 << 63) - 1)
        doc = np.repeat(np.arange(len(self.size)), self.size)
        off = np.arange(n) - self.first[doc]
        value[off < _GRAM - 1] = np.iinfo(np.uint64).max
        low = _sliding(value, width, np.minimum)  # over [i, i + width)
        whole = (off >= _GRAM - 1) & (off + width <= self.size[doc])
        low[~whole] = 0
        # the least of some whole window: the greatest window minimum over the windows that hold i equals its value
        high = _sliding(low[::-1], width, np.maximum)[::-1]
        cuts = np.flatnonzero(high == value) + 1
        of = doc[cuts - 1]
        j = np.searchsorted(cuts, cuts + run)
        ok = j < len(cuts)
        ok[ok] = of[j[ok]] == of[ok]
        lo, hi = cuts[ok], cuts[j[ok]]
        return self.span(lo, hi), lo, hi


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width], shorter at the end; by doubling."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        nxt = out.copy()
        nxt[: len(x) - step] = op(out[: len(x) - step], out[step:])
        out, have = nxt, have + step
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _run_hashes(min_chars: int):
    width, run = widths(min_chars)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for rows in _chunks(texts, min_chars):
                p = Prints([texts[i] for i in rows])
                h, lo, _ = p.runs(width, run)
                owner = np.searchsorted(p.first, lo, "right") - 1
                pairs = np.unique(np.stack([owner, _signed(h)]), axis=1)  # once per text
                yield pa.RecordBatch.from_arrays([pa.array(pairs[1]), pa.array(np.array([ids[i] for i in rows], np.int64)[pairs[0]])], names=["h", "rid"])

    return go


def _windows(min_chars: int):
    width, run = widths(min_chars)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, marks = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            for rows in _chunks(texts, min_chars):
                p = Prints([texts[i] for i in rows])
                h, lo, hi = p.runs(width, run)
                owner = np.searchsorted(p.first, lo, "right") - 1
                keep = np.zeros(len(h), bool)
                edges = np.searchsorted(owner, np.arange(len(rows) + 1))
                for k, i in enumerate(rows):
                    a, z = edges[k], edges[k + 1]
                    keep[a:z] = np.isin(_signed(h[a:z]), np.array(marks[i], np.int64))
                owner, lo, hi = owner[keep], lo[keep], hi[keep]
                # starts of the windows that hold a marked run
                s0 = np.maximum(hi - min_chars, p.first[owner])
                s1 = np.minimum(lo, p.first[owner] + p.size[owner] - min_chars)
                fits = s1 >= s0
                mark = np.zeros(len(p.code) + 1, np.int32)
                np.add.at(mark, s0[fits], 1)
                np.add.at(mark, s1[fits] + 1, -1)
                start = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
                own = np.searchsorted(p.first, start, "right") - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.array([ids[i] for i in rows], np.int64)[own] if len(own) else np.zeros(0, np.int64)),
                    pa.array((start - p.first[own]).astype(np.int32)), pa.array(_signed(p.span(start, start + min_chars)))], names=["rid", "pos", "w"])

    return go


def _marked(docs: DataFrame, min_chars: int) -> DataFrame:
    """rid, text, marks: the records that hold a run whose hash occurs twice, with those hashes."""
    hashed = docs.select("rid", "text").mapInArrow(_run_hashes(min_chars), "h bigint, rid bigint")
    # a re-delivered row may let a hash through that is not shared; the windows settle it
    often = hashed.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    marks = hashed.join(often, "h").groupBy("rid").agg(F.collect_set("h").alias("marks"))  # a text's own runs: bounded by the text
    return docs.select("rid", "text").join(marks, "rid")


def _repeated(marked: DataFrame, min_chars: int) -> DataFrame:
    found = staged(marked.mapInArrow(_windows(min_chars), "rid bigint, pos int, w bigint"))
    groups = found.groupBy("w").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).filter("lo <> hi").select("w", F.col("lo").alias("first_rid"))
    return found.join(groups, "w").select("rid", "pos", "w", "first_rid").distinct()


def shared_windows(docs: DataFrame, *, min_chars: int = 150) -> DataFrame:
    """rid, pos, w: every window of ``min_chars`` characters that occurs in more than one record.

    ``docs`` has rid (bigint) and text. A row delivered again counts as the same record. Null texts and texts
    shorter than ``min_chars`` share nothing. Characters are Unicode code points; nothing is normalised. Windows are equal where their 64-bit
    hashes are; see span_classes for a comparison of the texts.
    """
    return _repeated(_marked(docs, min_chars), min_chars)


def span_classes(docs: DataFrame, *, min_chars: int = 150) -> DataFrame:
    """class_id, rid, start, n_records: one row for each class of shared spans and record in it, so a text in n records takes n rows.

    Windows with the same set of records (all windows of one long run, as a rule) are one class: a set is known by its size and two sums of
    hashes. The window of least hash stands for its class; ``start`` is where it first stands in the record. The members' texts at that
    window are compared, so what only shares a hash falls into classes of its own, and those of one record are dropped.
    """
    marked = staged(_marked(docs, min_chars))
    member = staged(_repeated(marked, min_chars).groupBy("w", "rid").agg(F.min("pos").alias("pos")))
    sets = member.groupBy("w").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rid").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("x"))
    one = cut(sets.groupBy("n", "s", "x").agg(F.min("w").alias("w")).select("w"))
    held = member.join(one, "w").join(marked.select("rid", "text").dropDuplicates(["rid"]), "rid")
    text = held.select("w", "rid", F.col("pos").alias("start"), F.substr("text", F.col("pos") + 1, F.lit(min_chars)).alias("t"))
    m = staged(text.select("rid", "start", F.sha2(F.concat(F.col("w").cast("string"), F.lit(":"), F.col("t")), 256).alias("class_id")))
    n = m.groupBy("class_id").agg(F.count("*").alias("n_records")).filter("n_records > 1")
    return m.join(n, "class_id").select("class_id", "rid", "start", "n_records")


def shared_pairs(docs: DataFrame, *, min_chars: int = 150) -> DataFrame:
    """rid_a < rid_b: pairs of records that share a run of at least ``min_chars`` characters: the pairs within span_classes, as many as are asked for."""
    m = staged(span_classes(docs, min_chars=min_chars).select("class_id", "rid"))
    a, b = m.withColumnRenamed("rid", "rid_a"), m.withColumnRenamed("rid", "rid_b")
    return a.join(b, "class_id").filter("rid_a < rid_b").select("rid_a", "rid_b").distinct()


def _merge(windows: DataFrame, min_chars: int) -> DataFrame:
    """rid, start, stop of the maximal runs covered by windows; per record, bounded by its text."""
    from pyspark.sql import Window as W

    by = W.partitionBy("rid").orderBy("pos")
    new = F.coalesce((F.col("pos") > F.lag("pos").over(by) + min_chars).cast("int"), F.lit(1))
    run = windows.select("rid", "pos").distinct().withColumn("new", new).withColumn("k", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return run.groupBy("rid", "k").agg(F.min("pos").alias("start"), (F.max("pos") + min_chars).alias("stop")).drop("k")


def shared_runs(docs: DataFrame, *, min_chars: int = 150) -> DataFrame:
    """rid, start, stop: the maximal runs of each record all of whose windows occur in another record."""
    return _merge(shared_windows(docs, min_chars=min_chars), min_chars)


def shared_share(docs: DataFrame, *, min_chars: int = 150) -> DataFrame:
    """rid, n_chars, shared_chars, share: how much of each record stands elsewhere too; 0 for empty and null texts."""
    runs = shared_runs(docs, min_chars=min_chars).groupBy("rid").agg(F.sum(F.col("stop") - F.col("start")).alias("shared_chars"))
    size = docs.groupBy("rid").agg(F.max(F.coalesce(F.char_length("text"), F.lit(0))).alias("n_chars"))
    n = F.coalesce("shared_chars", F.lit(0))
    return size.join(runs, "rid", "left").select("rid", F.col("n_chars").cast("bigint").alias("n_chars"), n.cast("bigint").alias("shared_chars"),
                                                 F.when(F.col("n_chars") > 0, n / F.col("n_chars")).otherwise(0.0).alias("share"))


def without_repeats(docs: DataFrame, *, min_chars: int = 150) -> DataFrame:
    """rid, text: each record without the spans that stand in a record with a smaller id already.

    The first occurrence of every span stays whole, so the corpus keeps each shared span once.
    """
    again = shared_windows(docs, min_chars=min_chars).filter("rid <> first_rid")
    spans = _merge(again, min_chars).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cutout"))
    one = docs.groupBy("rid").agg(F.max("text").alias("text")).join(spans, "rid", "left")
    # pieces between the cut-outs; positions are code points, as Spark's substring counts
    starts = F.concat(F.array(F.lit(0)), F.transform("cutout", lambda x: x.stop))
    stops = F.concat(F.transform("cutout", lambda x: x.start), F.array(F.char_length("text")))
    kept = F.array_join(F.zip_with(starts, stops, lambda a, b: F.substr(F.col("text"), a + 1, b - a)), "")
    return one.select("rid", F.when(F.col("cutout").isNull(), F.col("text")).otherwise(kept).alias("text"))
