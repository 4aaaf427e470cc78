"""Natural language in comments, literals and documentation.

Whole texts are segmented by the character-level hidden Markov model of ``language``; of its Viterbi
spans only those inside comments and literals count, and they tell prose from code. The prose words of a sentence are
decoded once more, word by word, by a Viterbi path over the languages (and none of them) whose emissions are those of the words' characters
and in which a change costs MARGIN. A language counts from five words, or ten characters of Japanese or Chinese.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.llm.docpairs import _language, guess_language
from weftwork.llm.language import CODE_STATE, OTHER_STATE, STATES, codes, viterbi, words_model
from weftwork.llm.prose import needs_repair, repaired
from weftwork.llm.seed_texts import PROSE
from weftwork.llm.syntax import spans

LEAST_WORDS = 5
LEAST_CHARS = 10
#: Nats for a change of language within a sentence, for a further language in place of a main one, and a character's log probability in no known language.
MARGIN = 30.0
FURTHER_COST = 12.0
NONE = -3.3
_CHUNK = 400_000
#: Characters whose scores are held at once.
_SCORED = 60_000
#: Languages told by their script.
_SCRIPTS = (("el", 0x370, 0x400), ("he", 0x590, 0x600), ("ar", 0x600, 0x780), ("hi", 0x900, 0x980), ("th", 0xE00, 0xE80), ("ko", 0x1100, 0x1200), ("ko", 0xAC00, 0xD7B0))

#: Parts that are no prose, blanked in place: inline tags and code, markup, links, paths, references, hashes, tags with their names.
_NO_PROSE = re.compile(r"""(?x) \{@\w+[^{}\n]*\} | `[^`\n]*` | </?\w[^<>\n]*> | https?://\S+ | \b\w+\#\w+(?:\([^()\n]*\))?
 | (?<![\w/])(?:/[\w.{}?=&-]+){2,}/? | @(?:param|throws|exception|see|since|author|version|tparam|property|arg)\b[ \t]*[\w.\#<>()]*(?:[ \t]+\d[\d.]*)? | @[A-Za-z]\w*(?:\.\w+)*
 | :\w+(?:[ ]\w+)?:(?=\s) | \b[0-9a-fA-F]{7,}\b | \[v[\d.]+\] | \(\#\d+\)""")
_CODE_TAG = re.compile(r"<(/?)(?:code|pre|tt)>")
_MARKS = re.compile(r"(?m)^[ \t]*(?:/\*+!?|\*+/|/{2,}!?|\*(?!\*)|--(?=[ \t]))|\*+/")
_LETTERS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_SPLIT = re.compile(r"(?<=[.!?])[\"')\]]*\s+|(?<=[。！？])|\n\s*\n|\n(?=[ \t]*(?:[-*+•]|\d+[.)])[ \t])|[ \t]+[/|][ \t]+|\n(?=\S*[=;{}(\[]\S*)|(?<=[;{}])\s*\n")
_IDENT = re.compile(r"[a-z][A-Z]|[A-Z]{2}[a-z]|_|\d")
_CJ_STATES = [STATES.index("ja"), STATES.index("zh")]
_CJ = re.compile(r"[぀-ヿ㐀-鿿]")


def _blank(m: re.Match) -> str:
    return "".join("\n" if c == "\n" else " " for c in m[0])


def _sentences(text: str) -> Iterator[tuple[int, int]]:
    """Spans of sentences; single line ends join, so hard-wrapped sentences stay whole."""
    at = 0
    for m in _SPLIT.finditer(text):
        if text[at:m.start()].strip():
            yield at, m.start()
        at = max(at, m.end())
    if text[at:].strip():
        yield at, len(text)


@dataclass
class _Sentence:
    """A sentence of five words or more: where it stands, its words, which of them look like prose, and their states (CODE_STATE or not)."""

    lo: int
    text: str
    words: list[re.Match]
    plain: list[bool]
    prose: list[bool]
    languages: list[int] = field(default_factory=list)  # indices into Words.names, -1 for none


def _script(s: str) -> tuple[str, int] | None:
    """(language, words) of a sentence mostly in one of _SCRIPTS."""
    n: dict[str, int] = {}
    for w in s.split():
        for name, lo, hi in _SCRIPTS:
            k = sum(lo <= ord(c) < hi for c in w)
            if k:
                n[name] = n.get(name, 0) + (k // 2 if name == "th" else 1)
                break
    best = max(n, key=lambda k: n[k], default=None)
    return (best, n[best]) if best else None


def _candidates(text: str, states: np.ndarray, out: dict[str, list[tuple[int, int, int]]]) -> list[_Sentence]:
    """The sentences to name a language for. Those of scripts that tell it go to ``out`` at once."""
    found = []
    for lo, hi in _sentences(text):
        s = text[lo:hi]
        other = int((states[lo:hi] == OTHER_STATE).sum())
        if other >= LEAST_CHARS and (x := _script(s)) and x[1] >= LEAST_WORDS:
            out.setdefault(x[0], []).append((lo, hi, other))
        words = list(_LETTERS.finditer(s))
        chars = len(_CJ.findall(s))
        if chars >= LEAST_CHARS and np.isin(states[lo:hi], _CJ_STATES).sum() >= 0.5 * chars:
            mine = [m for m in words if _CJ.search(m[0])]
            found.append(_Sentence(lo, s, mine, [], []))  # no words are told apart: all of it counts
        words = [m for m in words if not _CJ.search(m[0])]
        if len(words) < LEAST_WORDS:
            continue
        plain = [not _IDENT.search(s[max(m.start() - 1, 0):m.end() + 1]) for m in words]
        prose = [p and int(np.bincount(states[lo + m.start():lo + m.end()], minlength=len(STATES)).argmax()) not in (CODE_STATE, OTHER_STATE) for m, p in zip(words, plain, strict=True)]
        if sum(prose) >= 3:
            found.append(_Sentence(lo, s, words, plain, prose))
    return found


def _weigh(sentences: list[_Sentence]) -> None:
    """Names the languages of all words: one pass over the characters of many sentences, then a Viterbi path for each."""
    m, at = words_model(), 0
    n, cj = len(m.names), [m.names.index("ja"), m.names.index("zh")]
    while at < len(sentences):
        to, size = at, 0
        while to < len(sentences) and size < _SCORED:
            size += len(sentences[to].text) + 1
            to += 1
        some = sentences[at:to]
        total = np.concatenate([np.zeros((1, n)), np.cumsum(m.scores(codes(" " + " ".join(x.text for x in some))), axis=0, dtype=float)])
        start = 1
        for x in some:
            lo = np.array([start + w.start() - 1 for w in x.words])  # a word's blank or mark before it belongs to it
            hi = np.array([start + w.end() for w in x.words])
            e = total[hi] - total[lo]
            if not x.plain:
                x.languages = [cj[int(e[:, cj].sum(0).argmax())]]
            else:
                e[:, cj] = -1e3
                e[:, len(PROSE):] -= FURTHER_COST / len(x.words)
                x.languages = _path(np.concatenate([e, NONE * (hi - lo)[:, None]], axis=1)[np.array(x.prose)], n)
            start += len(x.text) + 1
        at = to


def _path(e: np.ndarray, none: int) -> list[int]:
    """The best language of every word: a change costs MARGIN. ``none`` becomes -1."""
    whole = e.sum(0)
    best = int(whole.argmax())
    if e.max(1).sum() - MARGIN <= whole[best]:  # no path with a change can do better
        return [best if best != none else -1] * len(e)
    v, back = e[0], []
    for x in e[1:]:
        top = int(v.argmax())
        stay = v >= v[top] - MARGIN
        back.append((stay, top))
        v = np.where(stay, v, v[top] - MARGIN) + x
    y = [int(v.argmax())]
    for stay, top in reversed(back):
        y.append(y[-1] if stay[y[-1]] else top)
    return [k if k != none else -1 for k in reversed(y)]


def _named(sentences: list[_Sentence], out: dict[str, list[tuple[int, int, int]]]) -> None:
    """Adds language -> spans (start, stop, letters) of the sentences whose words were weighed."""
    names = words_model().names
    for x in sentences:
        s, words = x.text, x.words
        if not x.plain:
            out.setdefault(names[x.languages[0]], []).append((x.lo, x.lo + len(s), len(_CJ.findall(s))))
            continue
        rest = iter(x.languages)
        langs = [next(rest) if p else None for p in x.prose]
        # a change of state costs several characters: plain words between or next to a language's own belong to it
        for order in (range(1, len(words)), range(len(words) - 2, -1, -1)):
            for i in order:
                k = i - 1 if order.step > 0 else i + 1
                a, z = sorted((words[i], words[k]), key=lambda m: m.start())
                if x.plain[i] and langs[i] is None and langs[k] is not None and not re.search(r"[^\s\d,:\-–'’\"()]", s[a.end():z.start()]):
                    langs[i] = langs[k]
        for lang in set(langs) - {None, -1}:
            mine = [m for m, k in zip(words, langs, strict=True) if k == lang]
            if len(mine) >= LEAST_WORDS:
                out.setdefault(names[lang], []).append((x.lo + mine[0].start(), x.lo + mine[-1].end(), sum(m.end() - m.start() for m in mine)))


def _phrases_of(texts: list[tuple[str, np.ndarray]]) -> list[dict[str, list[tuple[int, int, int]]]]:
    """For each (text, states of its characters): language -> spans (start, stop, letters) of its sentences."""
    out: list[dict] = [{} for _ in texts]
    found = [_candidates(t, st, o) for (t, st), o in zip(texts, out, strict=True)]
    _weigh([x for f in found for x in f])
    for f, o in zip(found, out, strict=True):
        _named(f, o)
    return out


def _phrases(text: str, states: np.ndarray) -> dict[str, list[tuple[int, int, int]]]:
    return _phrases_of([(text, states)])[0]


def _without_code(text: str) -> str:
    """Marked-up code blanked, whatever it holds; a tag that is never closed is left to the other patterns."""
    if "<" not in text:
        return text
    out, at, opened = [], 0, -1
    for m in _CODE_TAG.finditer(text):
        if not m[1] and opened < 0:
            opened = m.start()
        elif m[1] and opened >= 0:
            out += [text[at:opened], re.sub(r"[^\n]", " ", text[opened:m.end()])]
            at, opened = m.end(), -1
    return "".join([*out, text[at:]])


def _no_prose(text: str) -> str:
    return _NO_PROSE.sub(_blank, _without_code(_MARKS.sub(_blank, text)))


def _doc_text(text: str) -> str:
    return _no_prose(repaired(text))


_OUT = "record_id bigint, nat_lang string, n_phrases int, n_chars int, share double"


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64()], strict=True)], names=[x.split()[0] for x in _OUT.split(", ")])


def _summary(rid: int, found: dict[str, list[tuple[int, int, int]]], size: int) -> Iterator[tuple]:
    for lang, ss in found.items():
        chars = sum(b - a for a, b, _ in ss)
        yield rid, lang, len(ss), chars, min(1.0, chars / max(1, size))


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    at, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= _CHUNK:
            yield at, i + 1
            at, n = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _from_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = [], []
        for rid, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if t and t.strip():
                ids.append(rid)
                texts.append(_doc_text(t))
        for lo, hi in _groups(texts):
            out = []
            for rid, t, found in zip(ids[lo:hi], texts[lo:hi], _phrases_of(list(zip(texts[lo:hi], viterbi(texts[lo:hi]), strict=True))), strict=True):
                out += _summary(rid, found, len(t))
            yield _emit(out)


def _regions(text: str, language: str) -> list[list[tuple[int, int]]]:
    """Comments and literals as lists of pieces; line comments on neighbouring lines belong together."""
    out: list[list[tuple[int, int]]] = []
    last = -1
    for s in spans(text, language):
        lo, hi = s.start, s.stop
        if not s.comment:
            if hi - lo > LEAST_CHARS:
                out.append([(lo + 1, hi - 1)])
            last = -1
        elif last >= 0 and text[last:lo].strip() == "" and text.count("\n", last, lo) <= 1 and text.startswith("//", lo):
            out[-1].append((lo, hi))
            last = hi
        else:
            out.append([(lo, hi)])
            last = hi if text.startswith("//", lo) else -1
    return out


def _from_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(rid, _language(lang, path), t) for rid, lang, path, t in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True) if t]
        texts = [r[2] for r in rows]
        for lo, hi in _groups(texts):
            out = []
            extra: list[tuple[int, str]] = []
            whose: list[int] = []
            parts: list[tuple[str, np.ndarray]] = []
            for k, ((_, lang, t), st) in enumerate(zip(rows[lo:hi], viterbi(texts[lo:hi]), strict=True)):
                for pieces in _regions(t, lang or guess_language(t)):
                    joined = "\n".join(t[a:z] for a, z in pieces)
                    if not joined.strip():
                        continue
                    if needs_repair(joined):
                        extra.append((k, joined))  # the text changes with its repair, so it is segmented anew
                        continue
                    parts.append((_no_prose(joined), np.concatenate([np.concatenate([st[a:z], [0]]) for a, z in pieces])[:-1]))
                    whose.append(k)
            clean = [_doc_text(j) for _, j in extra]
            parts += zip(clean, viterbi(clean), strict=True)
            found: list[dict] = [{} for _ in rows[lo:hi]]
            for k, mine in zip([*whose, *(k for k, _ in extra)], _phrases_of(parts), strict=True):
                for x, v in mine.items():
                    found[k].setdefault(x, []).extend(v)
            for (rid, _, t), mine in zip(rows[lo:hi], found, strict=True):
                out += _summary(rid, mine, len(t))
            yield _emit(out)


def prose_of_docs(df: DataFrame, record_id: Column, text: Column) -> DataFrame:
    """record_id, nat_lang, n_phrases, n_chars, share: per record and language the phrases found and their share of the text.

    Texts are documentation: escapes and wrong encodings are repaired, tags, code, links and hashes left out. Null, blank and
    prose-free texts give no rows. Several rows of a record give a row each.
    """
    return df.select(record_id.cast("bigint").alias("record_id"), text.alias("t")).mapInArrow(_from_docs, _OUT)


def prose_of_files(df: DataFrame, record_id: Column, language: Column, path: Column, text: Column) -> DataFrame:
    """The same for whole source files: segmented whole, counted inside comments and literals; shares are of the file."""
    return df.select(record_id.cast("bigint").alias("record_id"), language.alias("l"), path.alias("p"), text.alias("t")).mapInArrow(_from_files, _OUT)
