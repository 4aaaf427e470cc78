"""Lexing and block-level syntax trees of Java, Kotlin, Rust, Swift and Zig sources."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

from weftwork.functions.lexing import Span, masked, spans

LANGUAGES = ("java", "kotlin", "rust", "swift", "zig")

@dataclass
class Node:
    """A block: its header reaches from ``start`` to the opening brace ``open``; ``close`` is the closing brace."""

    kind: str
    name: str | None
    start: int
    open: int
    close: int = -1
    children: list[Node] = field(default_factory=list)


_WORD_FN = {
    "rust": re.compile(r"\bfn\s+(?:r#)?(\w+)\s*(?:<|\()"),
    "swift": re.compile(r"\bfunc\s+`?(\w+|[^\w\s(<]+)`?\s*(?:<|\()"),
    "zig": re.compile(r"\bfn\s+(?:@\"[^\"]*\"|(\w+))\s*\("),
}
_FUN = re.compile(r"\bfun\b\s*")
_FUN_NAME = re.compile(r"(?:[\w.<>?, ]+\.)?`?(\w+)`?\s*")
_ANGLES = re.compile(r"[<>]")
_PARENS = re.compile(r"[()]")
_AFTER_PARAMS = re.compile(r"\s*(?:\[\]\s*)*(?:throws\s[\w.,\s<>@]+)?")
_ANNOTATION = re.compile(r"@\w[\w.]*\s*(?:\([^)]*\))?")
_NEW = re.compile(r"\bnew\s+[\w.<>]*\Z")
#: Words before a parenthesis that open a statement, not a method.
_JAVA_NOT = frozenset("if for while switch catch synchronized try return new else do throw assert super this yield case".split())
_TYPE = re.compile(r"\b(?:class|interface|enum|record|struct|trait|impl|object|protocol|extension|actor|union|mod|namespace)\b")
_BRACES = re.compile(r"[{};]")


def _called(header: str) -> tuple[str, int] | None:
    """(name, its position) where a header ends in "name(...)" and what may follow a parameter list; one pass over the parentheses, whatever their length."""
    last = header.rfind(")")
    if last < 0 or not _AFTER_PARAMS.fullmatch(header, last + 1):
        return None
    open_, held = -1, []
    for m in _PARENS.finditer(header, 0, last + 1):
        if m[0] == "(":
            held.append(m.start())
        elif held:
            open_ = held.pop()
    if open_ < 0 or header[last] != ")":
        return None
    end = len(header[:open_].rstrip())
    at = end
    while at and (header[at - 1].isalnum() or header[at - 1] == "_"):
        at -= 1
    return (header[at:end], at) if at < end and (not at or header[at - 1] != ".") else None


def _fun(header: str) -> tuple[str, int] | None:
    """(name, where "fun" stands) of a header's last Kotlin function: type parameters are passed over by their brackets."""
    found = None
    for m in _FUN.finditer(header):
        at = m.end()
        if header.startswith("<", at):
            depth = 0
            for x in _ANGLES.finditer(header, at):
                if x[0] == "<":
                    depth += 1
                elif header[x.start() - 1] != "-":  # not an arrow
                    depth -= 1
                if not depth:
                    at = x.end()
                    break
            while header[at:at + 1].isspace():
                at += 1
        stop = header.find("(", at)
        n = _FUN_NAME.fullmatch(header, at, stop) if stop >= 0 else None
        if n:
            found = n[1], m.start()
    return found


def _classify(header: str, language: str, in_code: bool) -> tuple[str, str | None, int]:
    """(kind, name, where the declaring word stands in the header)."""
    if language == "java":
        m = _called(header)
        if m and m[0] not in _JAVA_NOT and not in_code:
            before = header[:m[1]].rstrip()
            first = before.split()
            if first and first[0].strip("(") not in _JAVA_NOT and "=" not in _ANNOTATION.sub("", before) and (before[-1].isalnum() or before[-1] in "_>]") and not _NEW.search(before, max(0, before.rfind("new"))):
                return "function", m[0], m[1]
            if not first or all(w.startswith("@") or w in ("public", "protected", "private") for w in first):
                return "function", m[0], m[1]  # a constructor
    elif language == "kotlin":
        if m := _fun(header):
            return "function", m[0], m[1]
    else:
        last = None
        for m in _WORD_FN[language].finditer(header):
            last = m
        if last:
            return "function", last[1], last.start()
    m = _TYPE.search(header)
    return ("type" if m else "block"), None, m.start() if m else 0


def parse(text: str, language: str, found: list[Span] | None = None, plain: str | None = None) -> list[Node]:
    """The tree of blocks. Braces in comments and literals do not count; a missing closing brace closes at the end."""
    found = spans(text, language) if found is None else found
    plain = masked(text, found) if plain is None else plain
    roots: list[Node] = []
    stack: list[Node] = []
    edge = 0
    for m in _BRACES.finditer(plain):
        c, at = m[0], m.start()
        if c == "{":
            header = plain[edge:at]
            in_code = bool(stack) and stack[-1].kind != "type"
            kind, name, word = _classify(header, language, in_code)
            node = Node(kind, name, edge + word, at)
            (stack[-1].children if stack else roots).append(node)
            stack.append(node)
        elif c == "}" and stack:
            stack.pop().close = at
        edge = at + 1
    for n in stack:
        n.close = len(text)
    return roots


_ONLY_MARKS = re.compile(r"\s*(?:@[\w.]+(?:\([^()]*\))?|#!?\[[^\]\n]*\]|\b(?:public|private|protected|internal|fileprivate|open|override|static|final|abstract|synchronized|suspend|inline|export|pub|unsafe|async|const|mutating|default)\b|\s)+\s*\Z")


def declaration_start(plain: str, word: int, edge: int) -> int:
    """Where the declaration that holds position ``word`` begins: its line, and the lines of annotations and modifiers above it."""
    start = max(plain.rfind("\n", 0, word) + 1, edge)
    while start > edge:
        up = max(plain.rfind("\n", 0, start - 1) + 1, edge)
        line = plain[up:start]
        if line.strip() and _ONLY_MARKS.match(line):
            start = up
        else:
            break
    return start + len(plain[start:word]) - len(plain[start:word].lstrip())


@dataclass
class Function:
    name: str
    start: int  # of the declaration, without its comments
    stop: int
    body: str
    docs: str  # the comments directly in front, with their marks
    empty: bool


def functions(text: str, language: str) -> list[Function]:
    """Every function with a body, in order of appearance, with the comments that stand directly in front of it."""
    found = spans(text, language)
    plain = masked(text, found)
    comments = [s for s in found if s.comment]
    places = [s.start for s in comments]
    out: list[Function] = []
    todo = parse(text, language, found, plain)[::-1]
    while todo:
        n = todo.pop()
        todo += n.children[::-1]
        if n.kind != "function" or not n.name:
            continue
        # the nearest statement boundary before the name bounds the declaration
        edge = max(plain.rfind(c, 0, n.start) for c in "{};") + 1
        start = declaration_start(plain, n.start, edge)
        docs, at = [], start
        for s in reversed(comments[bisect_left(places, edge):bisect_left(places, start)]):
            gap = text[s.stop:at]
            line = plain[plain.rfind("\n", 0, s.start) + 1:s.start]
            if gap.strip() or gap.count("\n") > 1 or line.strip():  # apart, or behind other code on its line
                break
            docs.append(text[s.start:s.stop])
            at = s.start
        body = plain[n.open + 1:n.close]
        out.append(Function(n.name, start, min(n.close + 1, len(text)), text[n.open + 1:n.close], "\n".join(reversed(docs)), not body.strip()))
    return out
