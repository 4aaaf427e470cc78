"""Deeply nested records to flat tables that keep parent-child links.

A batch of JSON texts is laid end to end in one byte array. Quote, bracket and delimiter bitmaps, the
parity of quotes and the nesting depth come from prefix sums over that array; sorting the structural
bytes by (text, depth, position) puts each container's delimiters next to one another, so every key
and value span falls out of neighbouring pairs. No byte is visited by a Python loop.
"""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_QUOTE, _BACK, _COMMA, _COLON = 34, 92, 44, 58
_OPEN = np.zeros(256, bool)
_OPEN[[123, 91]] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[[125, 93]] = True
_DELIM = np.zeros(256, bool)
_DELIM[[_COMMA, _COLON]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 13]] = True


def _refuse(x: str) -> None:
    raise ValueError(x)


#: Characters of text indexed at once; the index takes about eighty bytes a character. A longer text is indexed alone.
CHUNK = 400_000


def pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK characters together."""
    at, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > CHUNK:
            yield at, i
            at, n = i, 0
        n += len(t)
    if at < len(texts):
        yield at, len(texts)


def valid_json(text: str) -> bool:
    try:
        json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return False
    return True


class Spans:
    """Every value of a batch of valid JSON texts, as parallel arrays.

    doc, parent (the value that holds it, -1 for the root), start and end (bytes in ``buf``), key_start and key_end
    (-1 in arrays and for roots), pos (position in its container), kind (first byte of the value).
    """

    def __init__(self, texts: list[str]) -> None:
        raw = [t.encode() for t in texts]
        self.buf = b"\n".join(raw)
        b = np.frombuffer(self.buf, np.uint8)
        size = np.array([len(r) for r in raw], np.int64)
        first = np.concatenate([[0], np.cumsum(size + 1)[:-1]]) if len(raw) else np.zeros(0, np.int64)
        at = np.arange(len(b))
        plain = np.maximum.accumulate(np.where(b != _BACK, at, -1)) if len(b) else at
        before = np.concatenate([[-1], plain[:-1]])
        quote = (b == _QUOTE) & ((at - 1 - before) % 2 == 0)
        inside = (np.cumsum(quote) % 2).astype(bool)  # true from an opening quote up to before its closing one
        out = ~inside & ~quote
        opens, closes = _OPEN[b] & out, _CLOSE[b] & out
        depth = np.cumsum(opens.astype(np.int32) - closes)
        tok = np.flatnonzero(opens | closes | (_DELIM[b] & out))
        level = depth[tok] + closes[tok]
        doc = np.searchsorted(first, tok, "right") - 1
        order = np.lexsort((tok, level, doc))
        tok, doc = tok[order], doc[order]
        is_open = opens[tok]
        box = np.cumsum(is_open) - 1  # the container each structural byte belongs to
        solid = ~_SPACE[b]
        nxt = np.minimum.accumulate(np.where(solid, at, len(b))[::-1])[::-1] if len(b) else at
        prv = np.maximum.accumulate(np.where(solid, at, -1)) if len(b) else at
        pair = np.flatnonzero(box[:-1] == box[1:]) if len(tok) else np.zeros(0, np.int64)
        lo, hi = nxt[np.minimum(tok[pair] + 1, len(b) - 1)] if len(pair) else pair, prv[tok[pair + 1] - 1] + 1 if len(pair) else pair
        in_object = b[tok[is_open]][box[pair]] == 123 if len(pair) else np.zeros(0, bool)
        is_key = in_object & (b[tok[pair + 1]] == _COLON) if len(pair) else in_object
        value = ~is_key & (hi > lo)
        v = np.flatnonzero(value)
        keyed = in_object[v]
        # roots: whole texts
        r_lo = nxt[first] if len(raw) else first
        r_hi = prv[first + size - 1] + 1 if len(raw) else first
        self.doc = np.concatenate([np.arange(len(raw)), doc[pair[v]] if len(v) else v])
        self.start = np.concatenate([r_lo, lo[v]]).astype(np.int64)
        self.end = np.concatenate([r_hi, hi[v]]).astype(np.int64)
        none = np.full(len(raw), -1)
        self.key_start = np.concatenate([none, np.where(keyed, lo[v - 1] if len(v) else v, -1)]).astype(np.int64)
        self.key_end = np.concatenate([none, np.where(keyed, hi[v - 1] if len(v) else v, -1)]).astype(np.int64)
        in_box = box[pair[v]] if len(v) else v
        new = np.concatenate([[True], in_box[1:] != in_box[:-1]]) if len(v) else np.zeros(0, bool)
        n = np.arange(len(v))
        self.pos = np.concatenate([np.zeros(len(raw), np.int64), n - np.maximum.accumulate(np.where(new, n, 0)) if len(v) else n])
        self.kind = b[self.start] if len(self.start) else self.start
        # a container's value is the one that starts at its opening bracket
        by_start = np.argsort(self.start, kind="stable")
        own = by_start[np.searchsorted(self.start[by_start], tok[is_open])] if len(tok) else np.zeros(0, np.int64)
        self.parent = np.concatenate([none, own[in_box] if len(v) else v])
        self.kids_at = np.concatenate([[0], np.cumsum(np.bincount(self.parent[self.parent >= 0], minlength=len(self.doc)))])
        self.kids = np.argsort(self.parent, kind="stable")[int((self.parent < 0).sum()):]

    def text(self, i: int) -> str:
        return self.buf[self.start[i]:self.end[i]].decode()

    def key(self, i: int) -> str | None:
        return None if self.key_start[i] < 0 else json.loads(self.buf[self.key_start[i]:self.key_end[i]])

    def children(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``at``, child) of all children of the values ``at``, in order."""
        n = self.kids_at[at + 1] - self.kids_at[at]
        row = np.repeat(np.arange(len(at)), n)
        off = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return row, self.kids[np.repeat(self.kids_at[at], n) + off]

    def member(self, at: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``at``, value) of the member called ``name``; the last of repeated ones."""
        row, kid = self.children(at)
        plain = json.dumps(name).encode()
        keep = np.array([self.key_start[k] >= 0 and ((s := self.buf[self.key_start[k]:self.key_end[k]]) == plain or _BACK in s and json.loads(s) == name) for k in kid], bool)
        row, kid = row[keep], kid[keep]
        last = np.concatenate([row[1:] != row[:-1], [True]]) if len(row) else np.zeros(0, bool)
        return row[last], kid[last]


def _decoded(text: str) -> str | None:
    """JSON text within a JSON string, plain or in base64; None where it is neither."""
    inner = json.loads(text)
    if valid_json(inner):
        return inner
    try:
        inner = base64.b64decode(inner, validate=True).decode()
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return None
    return inner if valid_json(inner) else None


ELEMENTS = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("parent_key", T.StringType()),
    T.StructField("parent_pos", T.IntegerType()),
    T.StructField("child_pos", T.IntegerType()),
    T.StructField("child_value", T.StringType()),
])


def _elements(path: list[str], key_field: str | None, valid: bool):
    """path: member names from the root; "*" opens the parents, every element after it the way to the children."""
    star = path.index("*")
    head, tail = path[:star], path[star + 1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            ok = [i for i, t in enumerate(texts) if t is not None and (valid or valid_json(t))]
            for lo, hi in pieces([texts[i] for i in ok]):
                out: list[list] = [[] for _ in range(5)]
                _rows(Spans([texts[i] for i in ok[lo:hi]]), [ids[i] for i in ok[lo:hi]], out)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()], strict=True)],
                                                 names=[f.name for f in ELEMENTS])

    def _rows(s: Spans, ids: list, out: list[list]) -> None:
        at = np.flatnonzero(s.parent < 0)
        for name in head:
            _, at = s.member(at, name)
        _, parents = s.children(at)
        parents = parents[(s.kind[parents] == 123)]
        keys: list[str] = []
        by_key = dict(zip(*(x.tolist() for x in s.member(parents, key_field)), strict=True)) if key_field else {}
        for n, p in enumerate(parents.tolist()):
            if s.key_start[p] >= 0:
                keys.append(s.key(p))
            elif n in by_key and s.kind[by_key[n]] == _QUOTE:
                keys.append(json.loads(s.text(by_key[n])))
            elif n in by_key:
                keys.append(s.text(by_key[n]))
            else:
                keys.append(str(int(s.pos[p])))
        if not tail:
            _emit(s, s, ids, parents, keys, np.arange(len(parents)), parents, s.pos[parents], out)
            return
        # walk the way down; a string on the way holds a document of its own
        todo = [(s, parents, np.arange(len(parents)), list(tail))]
        while todo:
            sp, cur, owner, names = todo.pop()
            while names:
                r, nxt = sp.member(cur, names[0])
                owner, cur, names = owner[r], nxt, names[1:]
                text = sp.kind[cur] == _QUOTE
                if text.any():
                    inner = [(o, d) for o, c in zip(owner[text], cur[text], strict=True) if (d := _decoded(sp.text(c))) is not None]
                    if inner:
                        deep = Spans([d for _, d in inner])
                        todo.append((deep, np.flatnonzero(deep.parent < 0), np.array([o for o, _ in inner]), list(names)))
                    cur, owner = cur[~text], owner[~text]
            lists = sp.kind[cur] == 91
            r, kid = sp.children(cur[lists])
            _emit(s, sp, ids, parents, keys, owner[lists][r], kid, sp.pos[kid], out)
            single = sp.kind[cur] == 123
            _emit(s, sp, ids, parents, keys, owner[single], cur[single], np.zeros(int(single.sum()), int), out)

    def _emit(s, sp, ids, parents, keys, owner, kid, pos, out) -> None:
        full = sp.kind[kid] != 110  # null
        for o, k, q in zip(owner[full].tolist(), kid[full].tolist(), pos[full].tolist(), strict=True):
            p = int(parents[o])
            for col, x in zip(out, (ids[s.doc[p]], keys[o], int(s.pos[p]), int(q), sp.text(k)), strict=True):
                col.append(x)

    return run


def nested_elements(df: DataFrame, row_id: Column, text: Column, path: list[str], key_field: str | None = None, *, valid: bool = False) -> DataFrame:
    """row_id, parent_key, parent_pos, child_pos, child_value: one row per innermost non-null element.

    ``path`` leads from the root to an array or object of parents, "*", then to the children: an array (positions
    count nulls) or a single object (position 0). parent_key is the parent's member name, else its ``key_field``,
    else its position. Members on the way may hold JSON as text or base64 of text. Null, empty, truncated or otherwise
    invalid texts, absent members and null parents give no rows; ``valid`` says that every text is known to be valid JSON, as
    rendered columns are, and spares the check. A path that ends with "*" gives the parents themselves,
    child_pos then being their position. child_value is the exact source text. Texts are indexed CHUNK characters
    at a time, so memory does not grow with a batch.
    """
    return df.select(row_id.cast("bigint").alias("row_id"), text.cast("string").alias("text")).mapInArrow(_elements(path, key_field, valid), ELEMENTS)


def as_json(c: Column) -> Column:
    """A typed nested column as JSON text in which null elements keep their places."""
    return F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
