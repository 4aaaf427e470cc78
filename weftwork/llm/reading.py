"""Reading level of documents.

Sentences are classified by two regularised multinomial models, one on character 4-grams and one on words
(with length features), whose log probabilities are averaged. The labels are those of whole documents, so a
sentence's own level is estimated by expectation maximisation: a document's sentences share a mixture that
leans to its label. A document's level comes from its sentences' distribution, weighted by words and
calibrated on the labelled documents by monotone regression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.language import STATES, codes, fold, model
from weftwork.llm.seed_texts import PROSE

LEVELS = 4
#: Bounds of the training sample: labelled documents, and sentences used of each document. Everything else covers all data.
MAX_DOCUMENTS = 2_000
MAX_SENTENCES = 12
_BITS = 16
_DENSE = 4

_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)", re.S | re.M)
_DROP = re.compile(r"`[^`\n]*`|https?://\S+|</?[A-Za-z!][^<>\n]*>|(?<!\S)[^\s/_]*[/_][^\s/]*/\S*|\b[0-9a-f]{7,}\b")
_BLOCK = re.compile(r"\n[ \t]*\n|\n(?=[ \t]*(?:[-*+]|\d+[.)])[ \t])|(?:^|(?<=\n))[ \t]*#{1,6}[^\n]*\n?|(?:^|(?<=\n))[ \t]*(?:={3,}|-{3,}|\*{3,})[ \t]*(?:\n|$)")
_MARK = re.compile(r"^[ \t>]*(?:(?:[-*+]|\d+[.)])[ \t]+)?")
_END = re.compile(r"(?<=[.!?。！？])[\"')\]]*\s+(?=[^\Wa-z_]|[\"'(\[])|(?<=[。！？])")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def sentences(text: str) -> list[str]:
    """The sentences of a text's prose: code blocks, inline code, links and headings are left out, hard wraps joined, list items kept apart."""
    t = text.replace("\r\n", "\n").replace("\r", "\n")
    t = _FENCE.sub("\n\n", t)
    out = []
    for block in _BLOCK.split(t):
        if not block or not block.strip():
            continue
        line = " ".join(_DROP.sub(" ", _MARK.sub("", block)).split())
        for s in _END.split(line):
            if s and sum(1 for _ in islice(_WORD.finditer(s), 3)) == 3 or s and any(ord(c) > 0x3000 for c in s) and len(s) >= 8:
                out.append(s)
    return out


def _h(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - _BITS)).astype(np.int64)


@dataclass
class Features:
    """Hashed features of sentences laid end to end: slots and where each sentence's begin."""

    chars: np.ndarray
    char_at: np.ndarray
    words: np.ndarray
    word_at: np.ndarray
    dense: np.ndarray
    n_words: np.ndarray
    langs: np.ndarray


def _word_slots(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, start, stop) of the words in one array of codes."""
    u = c.astype(np.uint64)
    letter = ((c >= 97) & (c <= 122)) | (c >= 0xC0) & (c != 0xD7) & (c != 0xF7) | (c == 39)
    edge = np.diff(np.concatenate([[0], letter.astype(np.int8), [0]]))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power = np.cumprod(np.full(len(u), np.uint64(0x100000001B3)))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(u * power)])
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(u), np.uint64(pow(0x100000001B3, -1, 1 << 64)))]))
    return _h((sums[hi] - sums[lo]) * back[lo] + (hi - lo).astype(np.uint64)), lo, hi


@lru_cache(1)
def _vocabulary() -> np.ndarray:
    """[slots, languages]: which languages' seeds hold a word."""
    out = np.zeros((1 << _BITS, len(STATES) - 1), np.int8)
    for k, name in enumerate(STATES[1:]):
        for t in (PROSE[name], fold(PROSE[name])) if name in PROSE else ():
            out[_word_slots(codes(t))[0], k] = 1
    return out


def features(sents: list[str]) -> Features:
    text = " " + "  ".join(sents) + " "
    size = np.array([len(s) for s in sents], np.int64)
    c = codes(text)
    start = 1 + np.concatenate([[0], np.cumsum(size + 2)[:-1]])
    u = c.astype(np.uint64)
    g = u.copy()
    for k in (1, 2, 3):  # 4-grams that begin at each position
        g[:-k] = g[:-k] * np.uint64(1_000_003) + u[k:]
    own = np.repeat(np.arange(len(sents)), size)
    pos = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + start[own]
    chars = _h(g[pos - 1])
    words, lo, hi = _word_slots(c)
    of = np.searchsorted(start, lo, "right") - 1
    n_words = np.bincount(of, minlength=len(sents))
    length = hi - lo
    letters = np.bincount(of, length, minlength=len(sents))
    long = np.bincount(of, length >= 9, minlength=len(sents))
    n = np.maximum(n_words, 1)
    dense = np.stack([np.log1p(n_words) / 4, letters / n / 10, long / n, np.minimum(n_words, 60) / 60], axis=1)
    word_at = np.searchsorted(of, np.arange(len(sents)))
    # a sentence without words borrows a neutral slot
    if (n_words == 0).any():
        words = np.insert(words, word_at[n_words == 0], 0)
        of = np.insert(of, word_at[n_words == 0], np.flatnonzero(n_words == 0))
        word_at = np.searchsorted(of, np.arange(len(sents)))
    # a sentence's natural language: by the words its seeds hold where they settle it, else by characters
    hits = np.add.reduceat(_vocabulary()[words], word_at, axis=0)
    langs = hits.argmax(1) + 1
    top = np.sort(hits, axis=1)
    open_ = np.flatnonzero((top[:, -1] < 3) | (top[:, -1] - top[:, -2] < 2))
    if len(open_):
        pick = np.concatenate([c[start[i]:start[i] + max(size[i], 1)] for i in open_])
        n = np.maximum(size[open_], 1)
        langs[open_] = model().sentence_scores(pick, np.cumsum(n) - n)[:, 1:].argmax(1) + 1
    return Features(chars, np.cumsum(size) - size, words, word_at, dense, n_words, langs)


def _means(w: np.ndarray, slots: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = np.diff(np.concatenate([at, [len(slots)]]))[:, None]
    return np.add.reduceat(w[slots], at, axis=0) / np.maximum(n, 1)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(1, keepdims=True)


@dataclass
class Classifier:
    char_w: np.ndarray
    word_w: np.ndarray
    dense_w: np.ndarray
    bias: np.ndarray
    knots: np.ndarray  # expected level -> calibrated level, monotone

    def proba(self, f: Features) -> np.ndarray:
        a = _means(self.char_w, f.chars, f.char_at) + self.bias[0]
        b = _means(self.word_w, f.words, f.word_at) + f.dense @ self.dense_w + self.bias[1]
        log = lambda z: z - z.max(1, keepdims=True) - np.log(np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True))
        return _softmax((log(a) + log(b)) / 2)


def _fit_linear(slots: np.ndarray, at: np.ndarray, dense: np.ndarray, y: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multinomial regression on mean hashed features by Adam on the full sample."""
    n = np.maximum(np.diff(np.concatenate([at, [len(slots)]])), 1)
    own = np.repeat(np.arange(len(at)), n)
    w, d, b = np.zeros((1 << _BITS, LEVELS), np.float32), np.zeros((dense.shape[1], LEVELS)), np.zeros(LEVELS)
    m = [np.zeros_like(x) for x in (w, d, b)]
    v = [np.zeros_like(x) for x in (w, d, b)]
    for t in range(1, steps + 1):
        p = _softmax(_means(w, slots, at) + dense @ d + b)
        r = (p - y) / len(y)
        per = (r / n[:, None])[own]
        grads = (np.stack([np.bincount(slots, per[:, k], minlength=1 << _BITS) for k in range(LEVELS)], axis=1).astype(np.float32) + l2 * w, dense.T @ r + l2 * d, r.sum(0))
        for x, g, mm, vv, rate in zip((w, d, b), grads, m, v, (2.0, 0.3, 0.3), strict=True):
            mm += 0.1 * (g - mm)
            vv += 0.02 * (g * g - vv)
            x -= (rate * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.98**t)) + 1e-7)).astype(x.dtype)
    return w, d, b


def _isotonic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Knots (x, fitted y) of the monotone least-squares fit, by pooling adjacent violators."""
    o = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[o], y[o], strict=True):
        pools.append([a, b, 1.0])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            q = pools.pop()
            p = pools[-1]
            n = p[2] + q[2]
            pools[-1] = [(p[0] * p[2] + q[0] * q[2]) / n, (p[1] * p[2] + q[1] * q[2]) / n, n]
    return np.array([[p[0], p[1]] for p in pools])


def fit(labelled: list[tuple[str, list[float]]], *, rounds: int = 2, steps: int = 30, l2: float = 1e-6, max_sentences: int = MAX_SENTENCES) -> Classifier:
    """``labelled``: texts with a distribution over levels each. At least two levels must occur."""
    docs = [(s, y) for t, y in labelled if (s := sentences(t))]
    sents, owner = [], []
    for i, (s, _) in enumerate(docs):
        step = max(1, -(-len(s) // max_sentences))
        for x in s[::step]:
            sents.append(x)
            owner.append(i)
    own, doc_y = np.array(owner), np.array([y for _, y in docs], float)
    f = features(sents)
    y = doc_y[own]
    none = np.zeros((len(sents), 0))
    for _ in range(rounds):
        cw, _, cb = _fit_linear(f.chars, f.char_at, none, y, l2, steps)
        ww, wd, wb = _fit_linear(f.words, f.word_at, f.dense, y, l2, steps)
        c = Classifier(cw, ww, wd, np.stack([cb, wb]), np.array([[1.0, 1.0], [LEVELS, LEVELS]]))
        p = c.proba(f)
        # a document's mixture leans to its label; sentences of another level get their own
        mix = np.zeros_like(doc_y)
        np.add.at(mix, own, p)
        n = np.bincount(own, minlength=len(docs))[:, None]
        mix = 0.5 * doc_y + 0.5 * mix / np.maximum(n, 1) + 1e-3
        y = p * mix[own]
        y /= y.sum(1, keepdims=True)
    p = c.proba(f)
    share = np.zeros_like(doc_y)
    np.add.at(share, own, p * f.n_words[:, None])
    share /= np.maximum(share.sum(1, keepdims=True), 1e-9)
    level = np.arange(1, LEVELS + 1)
    c.knots = _isotonic(share @ level, doc_y @ level)
    return c


def training_sample(docs: DataFrame, labels: DataFrame, *, max_documents: int = MAX_DOCUMENTS) -> list[tuple[str, list[float]]]:
    """At most ``max_documents`` labelled documents, drawn by hash; annotators that disagree give a shared label."""
    votes = labels.filter(F.col("reading_level").between(1, LEVELS)).groupBy("doc_id").agg(*[F.count_if(F.col("reading_level") == k).alias(f"v{k}") for k in range(1, LEVELS + 1)])
    drawn = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(drawn), "doc_id").collect()  # bounded by max_documents
    out = []
    for r in sorted(rows, key=lambda r: r.doc_id):
        v = np.array([r[f"v{k}"] for k in range(1, LEVELS + 1)], float)
        out.append((r.text, (v / v.sum()).tolist()))
    return out


_OUT = "doc_id bigint, n_sentences int, n_words bigint, english_share double, share_1 double, share_2 double, share_3 double, share_4 double, difficulty double"


def _pieces(texts: list[str | None], chars: int = 400_000) -> Iterator[tuple[list[str], list[int]]]:
    """(sentences, rows they belong to) in pieces of bounded length; a long text spans several, a long sentence is cut."""
    sents, own, n = [], [], 0
    for i, t in enumerate(texts):
        for s in sentences(t) if t else []:
            for a in range(0, len(s), chars):
                sents.append(s[a:a + chars])
                own.append(i)
                n += len(sents[-1])
                if n >= chars:
                    yield sents, own
                    sents, own, n = [], [], 0
    if sents:
        yield sents, own


def _levels(c: Classifier):
    english = STATES.index("en")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.arange(1, LEVELS + 1)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            n = len(ids)
            share, eng, words, count = np.zeros((n, LEVELS)), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
            for sents, own in _pieces(texts):
                f, o = features(sents), np.array(own)
                en = (f.langs == english).astype(float)
                np.add.at(share, o, c.proba(f) * (f.n_words * en)[:, None])
                eng += np.bincount(o, f.n_words * en, minlength=n)
                # scripts without blanks: a character is about half a word
                size = np.array([len(s) for s in sents])
                w = np.where(np.isin(f.langs, [STATES.index("ja"), STATES.index("zh")]), np.maximum(f.n_words, size // 2), f.n_words)
                words += np.bincount(o, w, minlength=n)
                count += np.bincount(o, minlength=n)
            total = share.sum(1, keepdims=True)
            share = np.divide(share, total, out=np.zeros_like(share), where=total > 0)
            hard = np.interp(share @ level, c.knots[:, 0], c.knots[:, 1])
            hard[total[:, 0] == 0] = np.nan
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(count.astype(np.int32)), pa.array(words.astype(np.int64)),
                pa.array(np.divide(eng, words, out=np.zeros(n), where=words > 0)), *[pa.array(share[:, k]) for k in range(LEVELS)],
                pa.array(hard, mask=np.isnan(hard))], names=[x.split()[0] for x in _OUT.split(", ")])

    return go


def reading_levels(docs: DataFrame, labels: DataFrame, *, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """Per document: n_sentences, n_words, english_share (of words), share_1 to share_4 of its English words by sentence level, difficulty.

    difficulty runs from 1 to 4 and is null where a text has no English sentence (null, empty, code only, other languages).
    ``docs`` needs doc_id and text, ``labels`` doc_id and reading_level; other columns are ignored. Whole texts are classified.
    Without a labelled document of two levels the call raises ValueError.
    """
    sample = training_sample(docs, labels, max_documents=max_documents)
    if len({tuple(y) for _, y in sample}) < 2:
        raise ValueError("labels of at least two levels are needed")
    c = fit(sample)
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(_levels(c), _OUT)


def demanding(levels: DataFrame) -> DataFrame:
    """doc_id of English documents most of whose prose is at level 4."""
    return levels.filter("english_share > 0.5 and share_4 > 0.5").select("doc_id").distinct()


def profile(levels: DataFrame) -> DataFrame:
    """Documents and words by rounded level; null where there is no English prose."""
    return levels.groupBy(F.round("difficulty").cast("int").alias("reading_level")).agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"), F.avg("difficulty").alias("mean_difficulty"))
