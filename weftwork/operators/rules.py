"""Rules over paths, edges and lines: ignore patterns, edge filters, inline directives, secret signatures."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression: * and ? stop at slashes; a single ** keeps only the text before and behind it."""
    if pattern in ("*", "**"):
        return "(?s).*"
    if pattern.count("**") == 1:
        head, tail = pattern.split("**")
        return "(?s)" + re.escape(head.rstrip("/")) + ".*" + re.escape(tail.lstrip("/"))
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[i + 2:]:
            j = pattern.index("]", i + 2)
            out += "[" + pattern[i + 1:j].replace("\\", "\\\\") + "]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return out


def _whole(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(r"\A(?:" + glob_regex(pattern) + r")\z"))


def _any_part(parts: Column, pattern: str) -> Column:
    return F.exists(parts, lambda x: _whole(x, pattern))


def ignored(path: Column, is_dir: Column, rules: list[str]) -> Column:
    """Whether a path is ignored: gitignore-style rules in order, the last that matches decides, ! turns it round."""
    p = F.regexp_replace(path, r"^(?:\./)+", "")
    base, parts = F.element_at(F.split(p, "/"), -1), F.split(p, "/")
    out = F.lit(False)
    for raw in rules:
        r = raw.strip()
        if not r or r.startswith("#"):
            continue
        keep = r.startswith("!")
        r = r.removeprefix("!")
        only_dir = r.endswith("/")
        r = r.removesuffix("/")
        anchored = r.startswith("/") or "/" in r.removeprefix("/")
        r = r.removeprefix("/")
        if anchored:
            hit = _whole(p, r) | (is_dir & F.startswith(p, F.lit(r + "/")))
        else:
            hit = _whole(base, r) | _any_part(parts, r) | _whole(p, r)
        if only_dir:
            hit = hit & is_dir
        out = F.when(hit, F.lit(not keep)).otherwise(out)
    return out & ~p.isin("", ".")


@dataclass
class EdgeRule:
    """Fields are combined by and; a rule without fields matches every edge of its type."""

    edge_type: str = ""
    source: str = ""
    target: str = ""
    source_symbol: str = ""
    target_symbol: str = ""
    env: str = ""
    endpoint: str = ""
    table: str = ""


_CLAUSE = re.compile(r"""(\w+)\s*=\s*("[^"]*"|'[^']*'|\S+)""")
_ALIAS = {"source_path": "source", "target_path": "target", "env_var": "env", "route": "endpoint"}


def parse_edge_rule(line: str) -> EdgeRule | None:
    """A rule of the form: [edge:] ignore TYPE [where] key=glob ...; the word ignore may be left out."""
    s = line.strip().removeprefix("edge:").strip()
    if not s or s.startswith("#"):
        return None
    s = s.removeprefix("ignore").strip()
    if not s:
        return None
    kind = s.split()[0]
    rule = EdgeRule("" if kind in ("*", "all") else kind)
    for k, v in _CLAUSE.findall(s[len(kind):]):
        k = _ALIAS.get(k.lower(), k.lower())
        if hasattr(rule, k) and k != "edge_type":
            setattr(rule, k, v.strip("\"'"))
    return rule


def suppressed(rules: list[EdgeRule]) -> Column:
    """Whether a rule matches an edge with columns edge_type, source_path, target_path, source_identifier, target_identifier, metadata."""
    meta = lambda k: F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit(""))
    out = F.lit(False)
    for r in rules:
        hit = F.lit(True)
        if r.edge_type:
            hit = hit & (F.col("edge_type") == r.edge_type)
        for col, pattern in ((F.col("source_path"), r.source), (F.col("target_path"), r.target), (F.col("source_identifier"), r.source_symbol), (F.col("target_identifier"), r.target_symbol)):
            if pattern:
                hit = hit & F.coalesce(_whole(col, pattern), F.lit(False))
        for value, pattern in ((meta("env_var"), r.env), (F.when(meta("consumer_endpoint") != "", meta("consumer_endpoint")).otherwise(meta("backend_endpoint")), r.endpoint), (meta("table_name"), r.table)):
            if pattern:
                hit = hit & (value != "") & _whole(value, pattern)
        out = out | hit
    return out


def filter_edges(edges: DataFrame, rules: list[EdgeRule]) -> DataFrame:
    """Edges no rule matches. Rules are constants, so this is one predicate in the scan, not a join."""
    return edges.filter(~suppressed(rules))


def directive_hits(directive: Column, edge_type: Column, spec: Column) -> Column:
    """Inline directives: ALL or *, a type, or TYPE:spec, separated by commas."""
    items = F.transform(F.split(F.coalesce(directive, F.lit("")), ","), lambda x: F.trim(x))
    return F.exists(items, lambda x: (F.upper(x) == "ALL") | (x == "*") | (x == edge_type) | (x == F.concat(edge_type, F.lit(":"), F.coalesce(spec, F.lit("")))))


#: Signatures of secrets by name.
SIGNATURES = {
    "Google AI / GCP API Key": r"AIza[0-9A-Za-z_-]{35}", "AWS Access Key ID": r"AKIA[0-9A-Z]{16}", "GitHub Token": r"gh[pousr]_[0-9a-zA-Z]{36}",
    "Slack Token": r"xox[baprs]-[0-9a-zA-Z]{10,48}", "Private Key": r"-----BEGIN (?:[A-Z ]+ )?PRIVATE KEY-----",
    "Credential Assignment": r"""(?i)(?:api_key|apikey|secret_key|auth_token|client_secret|password)\s*[:=]\s*["']([^"']{8,})["']""",
}
_PLACE = r"""["'](?:\$\{|var\.)|dummy|secret-token"""


def secret_lines(df: DataFrame, record_id: str, text: str, allow: str = "allow-secret") -> DataFrame:
    """record_id, line_no, type: every signature on every line; lines with the allow mark and placeholder values are passed over."""
    lines = df.select(F.col(record_id).alias("record_id"), F.posexplode(F.split(text, "\n")).alias("n", "line"))
    lines = lines.filter(F.rlike("line", F.lit("|".join(SIGNATURES.values()))) & ~F.contains("line", F.lit(allow)))
    kinds = F.filter(F.array(*[F.when(F.rlike("line", F.lit(p)) & (~F.rlike("line", F.lit(_PLACE)) if k == "Credential Assignment" else F.lit(True)), F.lit(k)) for k, p in SIGNATURES.items()]), lambda x: x.isNotNull())
    return lines.select("record_id", (F.col("n") + 1).alias("line_no"), F.explode(kinds).alias("type"))
