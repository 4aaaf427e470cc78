"""Functions paired with their documentation.

Sources are parsed into block trees; function nodes give name, exact source range and the comments in
front of them. A description is kept if at least one of its statements says something that the
function's own names, tags and stock phrases do not.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.prose import bare, repaired
from weftwork.llm.syntax import LANGUAGES, functions

#: Words that add nothing to a description, by purpose. English function words; words of documentation;
#: words that say in several languages that there is no description yet; directives of tools.
_EMPTY_WORDS = frozenset("""
a an the this that these those it its of to in on at by for from with and or as is are was be been being do does will can may which if then so
function method procedure routine class object instance type interface struct field member value values parameter parameters param params argument arguments
arg args return returns returned returning result results given specified provided supplied passed default implementation implements implemented gets get
sets set see also used use uses using call calls called here there new one auto autogenerated generated
inheritdoc todo fixme xxx tbd wip hack note nolint noinspection nosonar suppress formatter off on eslint disable pragma
description descriptions documentation documented comment comments doc docs docstring placeholder missing none yet no not available added add later n na null_description
noch keine kein beschreibung fehlt folgt pas encore de aucune aucun sin ninguna descripcion descripción todavia todavía nessuna descrizione ancora sem nenhuma
descricao descrição ainda nog geen beschrijving brak opisu jeszcze opis описание описания отсутствует нет пока
à compléter completer ergänzen erganzen completar completare da preencher por te vullen aanvullen do uzupełnienia uzupelnienia дополнить будет добавлено
""".split())
_CJK_EMPTY = re.compile(r"説明なし|説明はまだありません|未記入|暂无(?:说明|描述)|无(?:说明|描述)|待补充")
#: Notices of licences and generators; a statement that matches is one.
_NOTICE = re.compile(r"""(?ix) \b(?:licen[sc]ed?|copyright|\(c\)|all\ rights\ reserved|spdx|warrant(?:y|ies)|in\ compliance\ with|redistribut\w+
 | (?:auto[-\ ]?)?generated\ (?:by|from|code|method|file|documentation|stub|block)|@generated|auto-?generated|do\ not\ (?:edit|modify|change)|not\ edit\ this|by\ hand|will\ be\ (?:overwritten|lost|regenerated)
 | under\ (?:its|their)\ own\ terms|this\ file\ is\ part\ of)""")
_TODO = re.compile(r"(?i)^\W*(?:todo|fixme|xxx|tbd|wip|hack)\b\s*(?:\([^)]*\))?\s*[:\-]?\s*")
#: Fixed value: tags whose text repeats the signature or points elsewhere.
_BLOCK_TAG = re.compile(r"(?i)^[@:\\](?:param|parameter|return|returns|throws|throw|exception|see|since|author|version|type|rtype|raises|arg|argument|tparam|property|receiver|sample|serial\w*|link|date|category|override|inheritdoc)\b.*$|^-?\s*(?:parameters?|returns?|throws|args|raises|see also)\s*:.*$")
_OTHER_TAG = re.compile(r"^[@\\][A-Za-z]+\b")
_INLINE = re.compile(r"\{@\w+[^{}]*\}|<[^<>\n]+>|https?://\S+|`[^`\n]*`|(?<![\w.#])[\w.]+#\w+(?:\([^)]*\))?|\b[\w]+(?:/[\w{}.?=&-]+)+|\b[0-9a-f]{12,}\b")
_CODE = re.compile(r"[;{}]\s*$|^\s*[{}]|^\s*[\w.]+\((?:[^()]|\([^()]*\))*\)\s*$|^\s*(?:return|int|long|var|let|const|val|final|public|private|if|for|while)\b.*[;({=]|[=!<>]=|&&|\|\||->|=>|^\s*[\w.\[\]]+\s*=\s*\S|^\s*(?:import|package|use|SELECT|INSERT|UPDATE|DELETE)\b.*")
_STOP = re.compile(r"(?<=[.!?。！？])(?:\s+|(?<=[。！？]))|\n\s*\n|(?<=[.!?]\*/)")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*", re.U)
_IDENT = re.compile(r"[a-z][A-Z]|_|\d")
_OWNER = re.compile(r"\b(?:class|struct|impl|enum|interface|object|const)\s+(\w+)")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]{2,}")
_HEADER = re.compile(r"(?i)^\s*(?:parameters?|params|args|arguments|returns?|throws|raises|yields)\s*:\s*$")


def _stem(w: str) -> str:
    for end in ("ing", "ies", "ed", "es", "s", "e"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            return w[: -len(end)]
    return w


def name_words(*names: str | None) -> set[str]:
    """The stems of the words in identifiers and types."""
    return {_stem(w.lower()) for n in names if n for w in _CAMEL.findall(n)}


def _statements(doc: str) -> Iterator[str]:
    """Statements of a cleaned description: tags out, wrapped lines joined, code lines apart."""
    held: list[str] = []
    section = False
    for line in doc.split("\n") + [""]:
        t = line.strip()
        if _HEADER.match(t):
            section, t = True, ""
        elif section and line[:1] in " \t" and t:
            t = ""  # an indented entry of that section
        elif t:
            section = False
        tag = bool(_BLOCK_TAG.match(t))
        code = bool(t) and bool(_CODE.search(_INLINE.sub(" ", t)))
        if not t or tag or code or t[:1] in "@\\" or _TODO.match(t) or re.fullmatch(r"[\W_]+", t):
            if held:
                yield from _STOP.split(" ".join(held))
                held = []
            if t and not tag and not code and not re.fullmatch(r"[\W_]+", t):
                held.append(t)
                if _TODO.match(t):
                    first, *more = _STOP.split(t)
                    yield first
                    held = [" ".join(more)] if more else []
        else:
            held.append(t)


def says_something(doc: str | None, own: set[str]) -> bool:
    """Whether a description has a statement that adds to the names ``own`` (stems)."""
    if not doc:
        return False
    text = bare(repaired(doc))
    notice = False
    for s in _statements(text):
        s = s.strip()
        if not s:
            continue
        if _NOTICE.search(s):
            notice = True
            continue
        if _TODO.match(s) and not _declares(_TODO.sub("", s)):
            continue
        s = _OTHER_TAG.sub("", s)
        s = _INLINE.sub(" ", s)
        if _CODE.search(s):
            continue
        s = _CJK_EMPTY.sub(" ", s)
        if _CJK.search(s):
            return True
        new = [w for x in _WORD.findall(s) if not _IDENT.search(x) and (w := x.lower()) not in _EMPTY_WORDS and _stem(w) not in own and len(w) > 1]
        if new and not (notice and len(new) < 3):
            return True
    return False


def _declares(note: str) -> bool:
    """Whether the text behind a to-do mark is a full statement on its own, not a task: five words or more, not in the imperative."""
    words = _WORD.findall(note)
    if _CJK.search(note):
        return len(note) >= 10
    task = re.search(r"(?i)\b(?:please|describe|document|write|add|fix|remove|implement|complete|completed|clean|check this|refactor|later|someone|explain|fill|update this|rename)\b", note)
    return len(words) >= 5 and not task


_OUT = "record_id bigint, function_name string, code string, description string, start int, stop int"


def _language(x: str | None, path: str | None) -> str | None:
    x = (x or "").strip().lower()
    if x in LANGUAGES:
        return x
    end = (path or "").rsplit(".", 1)[-1].strip().lower()
    return {"java": "java", "kt": "kotlin", "kts": "kotlin", "rs": "rust", "swift": "swift", "zig": "zig"}.get(end)


def guess_language(text: str) -> str:
    """By the most frequent of each language's telling words; Java where none occurs."""
    signs = {"kotlin": r"\b(?:fun|val)\s", "rust": r"\b(?:fn|let mut|impl|use crate|pub\(crate\))\b|&self|->\s*\w+.*\{$", "swift": r"\b(?:func|guard|fileprivate)\s", "zig": r"@import\(|\bconst\s+\w+\s*=\s*(?:try|struct|@)|!\w*\s*\{|\[\]const u8|self: \*", "java": r"\b(?:package|import)\s[\w.]+;|\b(?:public|private|protected)\s+[\w<>\[\], ]+\("}
    n = {k: len(re.findall(v, text, re.M)) for k, v in signs.items()}
    best = max(n, key=lambda k: (n[k], k == "java"))
    return best if n[best] else "java"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
    cols = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in _OUT.split(", ")])


def _from_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for rid, lang, path, name, owner, params, kind, doc, text in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
            if not text or not text.strip():
                continue
            lang = _language(lang, path) or guess_language(text)
            found = functions(text, lang)
            if not found or found[0].empty:
                continue
            f = found[0]
            own = name_words(name, owner, f.name, kind, *(params or []))
            for d in (doc, f.docs):
                if says_something(d, own):
                    out.append((rid, name or f.name, text[f.start:f.stop], bare(repaired(d)), f.start, f.stop))
                    break
        yield _batch(out)


def _from_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for rid, lang, path, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if not text:
                continue
            owners = [(m.start(), m[1]) for m in _OWNER.finditer(text)]
            places = [a for a, _ in owners]
            for f in functions(text, _language(lang, path) or guess_language(text)):
                if f.empty or not f.docs:
                    continue
                head = text[f.start:f.stop - len(f.body)]
                k = bisect_left(places, f.start)
                own = name_words(f.name, *re.findall(r"\w+", head[head.find("(") + 1:]), owners[k - 1][1] if k else None)
                if says_something(f.docs, own):
                    out.append((rid, f.name, text[f.start:f.stop], bare(repaired(f.docs)), f.start, f.stop))
        yield _batch(out)


def pairs_of_functions(df: DataFrame) -> DataFrame:
    """record_id, function_name, code, description, start, stop for rows that hold one function each (code_functions).

    The description is ``doc`` or, where that says nothing, the comment in front of the function in body_source. Rows with null, blank or
    commented-out sources, and functions without any code in their body, give nothing. A null name is taken from the source.
    """
    return df.select(F.col("function_id").cast("bigint"), "language", "file_path", "function_name", "owner_name", F.transform("params", lambda p: F.concat_ws(" ", p["name"], p["type"])).alias("params"), "return_type", "doc", "body_source").mapInArrow(_from_functions, _OUT)


def pairs_of_files(df: DataFrame) -> DataFrame:
    """The same for whole files (source_files): one row per function with telling comments directly in front. A null language is told from the path, then the text."""
    return df.select(F.col("file_id").cast("bigint"), "language", "file_path", "content").mapInArrow(_from_files, _OUT)
