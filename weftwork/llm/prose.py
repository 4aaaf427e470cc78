"""Cleaning of documentation text: comment marks, escapes, wrong encodings, tags."""

from __future__ import annotations

import html
import re

_ESCAPE = re.compile(r"(?:\\u[0-9a-fA-F]{4})+")
_ESCAPED_BREAK = re.compile(r"\\[nrt]")
_MOJI = re.compile("[\u00c2-\u00f4][\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122]{1,3}")
_MARKS = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|/{2,}!?|\*(?!\*)|#+(?=[ \t-]|$)|--(?=[ \t]))?[ \t]*", re.M)
_TAIL = re.compile(r"[ \t]*\*+/[ \t]*$", re.M)


def _unescape(m: re.Match) -> str:
    try:
        return m[0].encode("ascii").decode("unicode_escape").encode("utf-16", "surrogatepass").decode("utf-16")
    except UnicodeError:
        return m[0]


def _refit(m: re.Match) -> str:
    for enc in ("latin-1", "cp1252"):
        try:
            return m[0].encode(enc).decode("utf-8")
        except UnicodeError:
            continue
    return m[0]


def needs_repair(text: str) -> bool:
    return "\\" in text or "&" in text or bool(_MOJI.search(text))


def repaired(text: str) -> str:
    """Escaped characters and UTF-8 read as Latin-1 turned back; HTML entities resolved; line ends unified."""
    if "\\" in text:
        text = _ESCAPED_BREAK.sub("\n", _ESCAPE.sub(_unescape, text))
    if _MOJI.search(text):
        text = _MOJI.sub(_refit, text)
    if "&" in text:
        text = html.unescape(text)
    return text.replace("\r\n", "\n").replace("\r", "\n")


def bare(text: str) -> str:
    """Comment marks taken off, line by line."""
    return _TAIL.sub("", _MARKS.sub("", text)).strip()
