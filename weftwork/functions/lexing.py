"""Comments and literals of many languages by position, and texts with both blanked."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

_LINE = r"//[^\n]*"
_HASH = r"\#[^\n]*"
_BLOCK = r"/\*.*?(?:\*/|\Z)"
_STR = r'"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)'
_APOS = r"'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z)"
_CHAR = r"'(?:[^'\\\n]|\\[^\n]{1,8}?)'"
_LONG = r'"""(?:[^\\]|\\.)*?(?:"""|\Z)'
_LONG1 = r"'''(?:[^\\]|\\.)*?(?:'''|\Z)"
#: Fixed values: (comments, literals) by language. Zig has no block comments, but files headed by one are met.
FORMS = {
    "java": (rf"{_LINE}|{_BLOCK}", rf"{_LONG}|{_STR}|{_CHAR}"),
    "csharp": (rf"{_LINE}|{_BLOCK}", rf'{_LONG}|[$@]+"(?:[^"]|"")*"|{_STR}|{_CHAR}'),
    "cpp": (rf"{_LINE}|{_BLOCK}", rf'R"(?P<h>\w*)\(.*?\)(?P=h)"|{_STR}|{_CHAR}'),
    "kotlin": (rf"{_LINE}|/\*", rf'""".*?(?:"""+|\Z)|{_STR}|{_CHAR}'),
    "rust": (rf"{_LINE}|/\*", r'b?r(?P<h>#*)".*?(?:"(?P=h)|\Z)|b?"(?:[^"\\]|\\.)*(?:"|\Z)' + rf"|b?{_CHAR}"),
    "swift": (rf"{_LINE}|/\*", rf'(?P<h>#+)"{{3}}.*?(?:"{{3}}(?P=h)|\Z)|{_LONG}|(?P<g>#+)"[^\n]*?(?:"(?P=g)|(?=\n)|\Z)|{_STR}'),
    "zig": (rf"{_LINE}|{_BLOCK}", rf"\\\\[^\n]*|{_STR}|{_CHAR}"),
    "go": (rf"{_LINE}|{_BLOCK}", rf"`[^`]*(?:`|\Z)|{_STR}|{_CHAR}"),
    "typescript": (rf"{_LINE}|{_BLOCK}", rf"`(?:[^`\\]|\\.)*(?:`|\Z)|{_STR}|{_APOS}"),
    "php": (rf"{_LINE}|#(?!\[)[^\n]*|{_BLOCK}", rf"{_STR}|{_APOS}"),
    "python": (_HASH, rf"{_LONG}|{_LONG1}|{_STR}|{_APOS}"),
    "ruby": (_HASH, rf"{_STR}|{_APOS}"),
    "elixir": (_HASH, rf"{_LONG}|{_STR}"),
    "hcl": (rf"{_HASH}|{_LINE}|{_BLOCK}", _STR),
    "protobuf": (rf"{_LINE}|{_BLOCK}", rf"{_STR}|{_APOS}"),
    "graphql": (_HASH, rf"{_LONG}|{_STR}"),
    "sql": (rf"--[^\n]*|{_BLOCK}", r"'(?:[^']|'')*(?:'|\Z)"),
    "wasm": (r";;[^\n]*|\(;.*?(?:;\)|\Z)", _STR),
    "dockerfile": (r"(?m:^)[ \t]*\#[^\n]*", _STR),
}
_NESTING = frozenset(("kotlin", "rust", "swift"))
_NEST = re.compile(r"/\*|\*/")


@lru_cache(32)
def _lexer(language: str) -> re.Pattern:
    comment, literal = FORMS[language]
    return re.compile(f"({comment})|({literal})", re.S)


@dataclass
class Span:
    start: int
    stop: int
    comment: bool


def spans(text: str, language: str) -> list[Span]:
    """Comments and literals in order. Block comments nest where the language nests them; an unclosed one runs to the end."""
    out: list[Span] = []
    lex, at = _lexer(language), 0
    while m := lex.search(text, at):
        start, stop = m.span()
        if m[1] == "/*" and language in _NESTING:
            depth, stop = 1, len(text)
            for n in _NEST.finditer(text, start + 2):
                depth += 1 if n[0] == "/*" else -1
                if not depth:
                    stop = n.end()
                    break
        out.append(Span(start, stop, m[1] is not None))
        at = max(stop, start + 1)
    return out


def masked(text: str, found: list[Span], literals: bool = True) -> str:
    """The text with comments (and ``literals``) blanked, positions and line ends kept; a literal leaves a quote at each end."""
    out, at = [], 0
    for s in found:
        if not s.comment and not literals:
            continue
        out.append(text[at:s.start])
        piece = text[s.start:s.stop]
        blank = "".join(c if c == "\n" else " " for c in piece) if "\n" in piece else " " * len(piece)
        out.append(blank if s.comment or len(blank) < 2 else '"' + blank[1:-1] + '"')
        at = s.stop
    out.append(text[at:])
    return "".join(out)
