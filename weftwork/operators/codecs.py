"""Source files to symbol rows, by extension: nineteen languages under one declarative scanner, SQL DDL in detail."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.functions.lexing import masked, spans

#: Extensions by language.
EXTENSIONS = {"go": "go", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "tf": "hcl", "hcl": "hcl", "sql": "sql", "proto": "protobuf", "graphql": "graphql", "gql": "graphql",
              "rs": "rust", "java": "java", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "h": "cpp", "hpp": "cpp", "cs": "csharp", "swift": "swift", "kt": "kotlin", "kts": "kotlin", "zig": "zig", "wat": "wasm", "wit": "wasm",
              "rb": "ruby", "php": "php", "ex": "elixir", "exs": "elixir"}


def language_of(path: str | None) -> str | None:
    base = (path or "").rsplit("/", 1)[-1]
    if re.fullmatch(r"(?i)Dockerfile(?:\.\w+)?|\w+\.dockerfile", base):
        return "dockerfile"
    return EXTENSIONS.get(base.rsplit(".", 1)[-1].lower()) if "." in base else None


_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|async|virtual|readonly|partial|export|default|declare|data|inline|suspend|pub(?:\([^)]*\))?|unsafe|const|extern|fileprivate|mutating|indirect)\s+)*"
_TYPED = r"(?:[\w.<>\[\]?,&*:]+\s+)+"
#: Declarations by language as (node type, pattern; group "n" is the name). Names in literals are read where the pattern is marked raw.
DECLARATIONS: dict[str, list[tuple[str, str]]] = {
    "go": [("StructDecl", r"^type\s+(?P<n>\w+)(?:\[[^\]]*\])?\s+struct\b"), ("InterfaceDecl", r"^type\s+(?P<n>\w+)(?:\[[^\]]*\])?\s+interface\b"), ("FunctionDecl", r"^func\s+(?:\([^)]*\)\s*)?(?P<n>\w+)\s*[\[(]"), ("VarDecl", r"^(?:var|const)\s+(?P<n>\w+)\b"),
           ("raw RouteBinding", r"\.(?:HandleFunc|Handle|Get|Post|Put|Delete|Patch|GET|POST|PUT|DELETE|PATCH)\(\s*\"(?P<n>[^\"]*)\"")],
    "python": [("ClassDecl", r"^[ \t]*class\s+(?P<n>\w+)"), ("FunctionDecl", r"^[ \t]*(?:async\s+)?def\s+(?P<n>\w+)\s*\("), ("raw RouteBinding", r"^[ \t]*@\w+\.(?:get|post|put|delete|patch|route)\(\s*[\"'](?P<n>[^\"']*)[\"']")],
    "typescript": [("ReactComponent", rf"^{_MODS}(?:function\s+(?P<n>[A-Z]\w*)\s*\(|const\s+(?P<m>[A-Z]\w*)\s*(?::[^=]+)?=\s*(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>)"), ("InterfaceDecl", rf"^{_MODS}interface\s+(?P<n>\w+)"),
                   ("raw ApiClientCall", r"\b(?:fetch|axios(?:\.\w+)?)\(\s*[\"'`](?P<n>[^\"'`]*)[\"'`]")],
    "hcl": [("raw ResourceBlock", r"^resource\s+\"(?P<n>[^\"]+\"\s+\"[^\"]+)\"\s*\{"), ("raw DataBlock", r"^data\s+\"(?P<n>[^\"]+\"\s+\"[^\"]+)\"\s*\{"), ("raw VariableBlock", r"^variable\s+\"(?P<n>[^\"]+)\"\s*\{"), ("raw OutputBlock", r"^output\s+\"(?P<n>[^\"]+)\"\s*\{"),
            ("raw ProviderBlock", r"^provider\s+\"(?P<n>[^\"]+)\"\s*\{"), ("raw ModuleBlock", r"^module\s+\"(?P<n>[^\"]+)\"\s*\{"), ("HCLBlock", r"^(?P<n>terraform|locals)\s*\{")],
    "sql": [("CreateTableStatement", r"(?i)\bCREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?P<n>[\w.]+)"), ("CreateIndexStatement", r"(?i)\bCREATE\s+(?:UNIQUE\s+)?INDEX\s+(?:IF\s+NOT\s+EXISTS\s+)?(?P<n>[\w.]+)"), ("ViewDefinition", r"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:MATERIALIZED\s+)?VIEW\s+(?P<n>[\w.]+)")],
    "protobuf": [("Service", r"^\s*service\s+(?P<n>\w+)"), ("RPCMethod", r"^\s*rpc\s+(?P<n>\w+)\s*\("), ("Message", r"^\s*message\s+(?P<n>\w+)"), ("Enum", r"^\s*enum\s+(?P<n>\w+)")],
    "graphql": [("ObjectType", r"^\s*(?:extend\s+)?type\s+(?P<n>\w+)"), ("InterfaceType", r"^\s*interface\s+(?P<n>\w+)"), ("InputType", r"^\s*input\s+(?P<n>\w+)"), ("EnumType", r"^\s*enum\s+(?P<n>\w+)"), ("UnionType", r"^\s*union\s+(?P<n>\w+)"), ("ScalarType", r"^\s*scalar\s+(?P<n>\w+)"),
                ("DirectiveDefinition", r"^\s*directive\s+@(?P<n>\w+)"), ("Operation", r"^\s*(?:query|mutation|subscription)\s+(?P<n>\w+)"), ("FieldDefinition", r"^\s+(?P<n>\w+)\s*(?:\([^)]*\))?\s*:\s*[\[\w]")],
    "dockerfile": [("BaseImage", r"(?i)^FROM\s+(?P<n>\S+)"), ("EnvBinding", r"(?i)^(?:ENV|ARG)\s+(?P<n>\w+)"), ("PortExpose", r"(?i)^EXPOSE\s+(?P<n>\S+)"), ("CopyInstruction", r"(?i)^(?:COPY|ADD)\s+(?P<n>.+)$"), ("WorkdirInstruction", r"(?i)^WORKDIR\s+(?P<n>\S+)"),
                   ("raw EntryPoint", r"(?i)^(?:ENTRYPOINT|CMD)\s+(?P<n>.+)$"), ("Instruction", r"(?i)^(?P<n>RUN|USER|LABEL|VOLUME|HEALTHCHECK|SHELL|STOPSIGNAL|ONBUILD)\b")],
    "rust": [("StructDef", rf"^\s*{_MODS}struct\s+(?P<n>\w+)"), ("EnumDef", rf"^\s*{_MODS}enum\s+(?P<n>\w+)"), ("TraitDef", rf"^\s*{_MODS}trait\s+(?P<n>\w+)"), ("ImplBlock", r"^\s*impl(?:<[^>]*>)?\s+(?P<n>[\w:<>, ]+?)\s*(?:where\b[^{]*)?\{"), ("FnDef", rf"^\s*{_MODS}fn\s+(?P<n>\w+)"),
             ("MacroDef", r"^\s*macro_rules!\s*(?P<n>\w+)"), ("raw RouteBinding", r"\.route\(\s*\"(?P<n>[^\"]*)\"|#\[(?:get|post|put|delete|patch)\(\"(?P<m>[^\"]*)\"")],
    "java": [("ClassOrInterfaceDeclaration", rf"^\s*{_MODS}(?:class|interface|enum|record)\s+(?P<n>\w+)"), ("MethodDeclaration", rf"^\s*{_MODS}(?:<[^>]+>\s+)?(?!return|new|else|throw|case){_TYPED}(?P<n>\w+)\s*\((?:[^(){{}}]|\([^()]*\))*\)\s*(?:throws\s+[\w.,\s]+)?\{{"),
             ("raw RouteBinding", r"@(?:Get|Post|Put|Delete|Patch|Request)Mapping\(\s*(?:value\s*=\s*|path\s*=\s*)?\"(?P<n>[^\"]*)\"")],
    "cpp": [("ClassDeclaration", r"^\s*(?:template\s*<[^>]*>\s*)?(?:class|struct)\s+(?P<n>\w+)[^;{]*\{"), ("EnumDeclaration", r"^\s*enum\s+(?:class\s+)?(?P<n>\w+)"), ("FunctionDeclaration", r"^(?:[\w:<>&*~]+\s+)+[&*]?(?P<n>[\w:~]+)\s*\([^;{}]*\)\s*(?:const\s*)?(?:noexcept\s*)?\{")],
    "csharp": [("ClassDeclaration", rf"^\s*{_MODS}class\s+(?P<n>\w+)"), ("StructDeclaration", rf"^\s*{_MODS}struct\s+(?P<n>\w+)"), ("InterfaceDeclaration", rf"^\s*{_MODS}interface\s+(?P<n>\w+)"), ("RecordDeclaration", rf"^\s*{_MODS}record\s+(?P<n>\w+)"), ("EnumDeclaration", rf"^\s*{_MODS}enum\s+(?P<n>\w+)"),
               ("PropertyDeclaration", rf"^\s*{_MODS}{_TYPED}(?P<n>\w+)\s*\{{\s*get\b"), ("raw RouteBinding", r"\[Http(?:Get|Post|Put|Delete|Patch)\(\"(?P<n>[^\"]*)\"")],
    "swift": [("StructDecl", rf"^\s*{_MODS}struct\s+(?P<n>\w+)"), ("ClassDecl", rf"^\s*{_MODS}class\s+(?P<n>(?!func|var|let)\w+)"), ("ActorDecl", rf"^\s*{_MODS}actor\s+(?P<n>\w+)"), ("EnumDecl", rf"^\s*{_MODS}enum\s+(?P<n>\w+)"), ("ProtocolDecl", rf"^\s*{_MODS}protocol\s+(?P<n>\w+)"),
              ("ExtensionDecl", rf"^\s*{_MODS}extension\s+(?P<n>[\w.]+)"), ("FunctionDecl", rf"^\s*{_MODS}func\s+(?P<n>\w+)")],
    "kotlin": [("ClassDecl", rf"^\s*{_MODS}(?:enum\s+|annotation\s+|value\s+)?(?:class|interface|object)\s+(?P<n>\w+)"), ("FunctionDecl", rf"^\s*{_MODS}fun\s+(?:<[^>]+>\s+)?(?:[\w.<>?]+\.)?(?P<n>\w+)\s*\("), ("raw RouteBinding", r"\b(?:get|post|put|delete|patch)\(\s*\"(?P<n>/[^\"]*)\"\s*\)\s*\{")],
    "zig": [("StructDef", r"\bconst\s+(?P<n>\w+)\s*=\s*(?:extern\s+|packed\s+)?struct\b"), ("EnumDef", r"\bconst\s+(?P<n>\w+)\s*=\s*enum\b"), ("UnionDef", r"\bconst\s+(?P<n>\w+)\s*=\s*union\b"), ("ErrorSetDef", r"\bconst\s+(?P<n>\w+)\s*=\s*error\s*\{"), ("FnDef", rf"^\s*{_MODS}fn\s+(?P<n>\w+)\s*\("), ("raw TestDef", r"^\s*test\s+\"(?P<n>[^\"]*)\"")],
    "wasm": [("WasmFunc", r"\(func\s+\$(?P<n>[\w.$-]+)"), ("raw WasmImport", r"\(import\s+\"(?P<n>[^\"]+\"\s+\"[^\"]+)\""), ("raw WasmExport", r"\(export\s+\"(?P<n>[^\"]+)\""), ("WasmMemory", r"\(memory\s+(?P<n>\$?[\w.-]+)"), ("WasmTable", r"\(table\s+(?P<n>\$?[\w.-]+)"), ("WasmGlobal", r"\(global\s+\$(?P<n>[\w.$-]+)"),
             ("WasmTypeDef", r"\(type\s+\$(?P<n>[\w.$-]+)"), ("WitInterface", r"^\s*interface\s+(?P<n>[\w-]+)"), ("WitWorld", r"^\s*world\s+(?P<n>[\w-]+)")],
    "ruby": [("ClassDef", r"^\s*class\s+(?P<n>[\w:]+)"), ("ModuleDef", r"^\s*module\s+(?P<n>[\w:]+)"), ("MethodDef", r"^\s*def\s+(?P<n>[\w.?!=]+)"), ("raw RouteBinding", r"^\s*(?:get|post|put|delete|patch)\s+[\"'](?P<n>/[^\"']*)[\"']")],
    "php": [("ClassDef", rf"^\s*{_MODS}class\s+(?P<n>\w+)"), ("InterfaceDef", r"^\s*interface\s+(?P<n>\w+)"), ("TraitDef", r"^\s*trait\s+(?P<n>\w+)"), ("EnumDef", r"^\s*enum\s+(?P<n>\w+)"), ("FunctionDef", rf"^\s*{_MODS}function\s+&?(?P<n>\w+)\s*\("), ("raw RouteBinding", r"Route::(?:get|post|put|delete|patch)\(\s*[\"'](?P<n>[^\"']*)[\"']")],
    "elixir": [("ModuleDef", r"^\s*defmodule\s+(?P<n>[\w.]+)"), ("FunctionDef", r"^\s*defp?\s+(?P<n>[\w?!]+)"), ("MacroDef", r"^\s*defmacrop?\s+(?P<n>[\w?!]+)"), ("raw RouteBinding", r"^\s*(?:get|post|put|delete|patch)\s+\"(?P<n>/[^\"]*)\"")],
}
_COMPILED = {lang: [(t.removeprefix("raw "), t.startswith("raw "), re.compile(p, re.M)) for t, p in rows] for lang, rows in DECLARATIONS.items()}


@dataclass
class Symbol:
    node_type: str
    identifier: str
    line_no: int
    signature: str
    doc: str


def symbols(text: str, language: str) -> list[Symbol]:
    """Declarations in order of position. Those in comments and literals do not count; the doc is the comment directly above."""
    found = spans(text, language)
    plain, code = masked(text, found), masked(text, found, literals=False)
    comments = {text.count("\n", 0, s.stop): s for s in found if s.comment}
    taken: set[tuple[int, str]] = set()
    out: list[tuple[int, Symbol]] = []
    for kind, raw, pattern in _COMPILED.get(language, []):
        for m in pattern.finditer(code if raw else plain):
            g = m.groupdict()
            name = " ".join((g.get("n") or g.get("m") or "").replace('"', " ").split())
            if not name or (m.start(), name) in taken:
                continue
            taken.add((m.start(), name))
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            line = text.count("\n", 0, start)
            end = text.find("\n", start)
            docs, at = [], line - 1
            while at in comments and text[comments[at].start:comments[at].stop].strip():
                s = comments[at]
                if text[text.rfind("\n", 0, s.start) + 1:s.start].strip():
                    break
                docs.append(text[s.start:s.stop])
                at = text.count("\n", 0, s.start) - 1
            out.append((start, Symbol(kind, name, line + 1, text[start:end if end >= 0 else len(text)].rstrip("{ \r"), "\n".join(reversed(docs)))))
    return [s for _, s in sorted(out, key=lambda x: (x[0], x[1].node_type))]


_OUT = "record_id bigint, language string, node_type string, identifier string, line_no int, signature string, doc string"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for rid, path, lang, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            lang = (lang or "").strip().lower()
            lang = lang if lang in DECLARATIONS else language_of(path)
            if text and lang:
                rows += [(rid, lang, s.node_type, s.identifier, s.line_no, s.signature, s.doc) for s in symbols(text, lang)]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in _OUT.split(", ")])


def parse_sources(df: DataFrame, record_id: Column, path: Column, language: Column, text: Column) -> DataFrame:
    """Symbol rows of source files; the language is the column's or told by the path, files of no known language give none."""
    return df.select(record_id.cast("bigint").alias("i"), path.alias("p"), language.alias("l"), text.alias("t")).mapInArrow(_parse, _OUT)


# ---- SQL DDL -----------------------------------------------------------------------------------------------------

_CREATE = re.compile(r"(?is)\bCREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.\"]+)\s*\(")
_TABLE_KEY = re.compile(r"(?is)^(?:CONSTRAINT\s+\S+\s+)?(PRIMARY\s+KEY|FOREIGN\s+KEY|UNIQUE|CHECK|KEY|INDEX)\b\s*(?:\(([^)]*)\))?(?:\s*REFERENCES\s+([\w.\"]+)\s*(?:\(([^)]*)\))?)?")
_COLUMN = re.compile(r"(?is)^\"?(\w+)\"?\s+(\w+(?:\s+(?:PRECISION|VARYING))?(?:\s*\([^)]*\))?)(.*)$")
_DDL = "record_id bigint, table_name string, pos int, column_name string, data_type string, is_key boolean, not_null boolean, is_unique boolean, default_value string, ref_table string, ref_column string"


def split_outside(body: str, plain: str) -> list[tuple[int, int]]:
    """Spans between commas outside parentheses; ``plain`` is the body with literals blanked."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(plain):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append((at, i))
            at = i + 1
    return [*out, (at, len(body))]


def columns_of(ddl: str) -> Iterator[tuple]:
    """(table, pos, column, type, key, not null, unique, default, referenced table and column) of every CREATE TABLE."""
    found = spans(ddl, "sql")
    code, plain = masked(ddl, found, literals=False), masked(ddl, found)
    for m in _CREATE.finditer(plain):
        depth, end = 1, m.end()
        while end < len(plain) and depth:
            depth += (plain[end] == "(") - (plain[end] == ")")
            end += 1
        stop = end - 1 if not depth else end
        body = code[m.end():stop]
        cols: list[list] = []
        later: list[tuple[str, list[str], str | None, list[str]]] = []
        for a, z in split_outside(body, plain[m.end():stop]):
            part = body[a:z].strip()
            names = lambda s: [x.strip().strip('"') for x in (s or "").split(",") if x.strip()]
            if k := _TABLE_KEY.match(part):
                later.append((" ".join(k[1].upper().split()), names(k[2]), (k[3] or "").strip('"') or None, names(k[4])))
            elif c := _COLUMN.match(part):
                rest = c[3]
                d = re.search(r"(?is)\bDEFAULT\s+('(?:[^']|'')*'|[^\s,]+(?:\([^)]*\))?)", rest)
                ref = re.search(r"(?is)\bREFERENCES\s+([\w.\"]+)\s*(?:\(\s*(\w+)\s*\))?", rest)
                pk = bool(re.search(r"(?i)\bPRIMARY\s+KEY\b", rest))
                cols.append([c[1], re.sub(r"\s+", " ", c[2]).upper(), pk, pk or bool(re.search(r"(?i)\bNOT\s+NULL\b", rest)), bool(re.search(r"(?i)\bUNIQUE\b", rest)), d[1] if d else None, ref[1].strip('"') if ref else None, ref[2] if ref else None])
        by = {c[0].lower(): c for c in cols}
        for kind, names_, target, there in later:
            for i, n in enumerate(names_):
                if c := by.get(n.lower()):
                    if kind == "PRIMARY KEY":
                        c[2] = c[3] = True
                    elif kind == "UNIQUE":
                        c[4] = c[4] or len(names_) == 1
                    elif kind == "FOREIGN KEY":
                        c[6], c[7] = target, there[i] if i < len(there) else None
        for i, c in enumerate(cols):
            yield (m[1].strip('"'), i, *c)


def _ddl(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.string()]
    for b in batches:
        rows = [(rid, *r) for rid, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for r in columns_of(t)]
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in _DDL.split(", ")])


def ddl_columns(df: DataFrame, record_id: Column, ddl: Column) -> DataFrame:
    """The columns of all CREATE TABLE statements in DDL texts, table constraints folded into them."""
    return df.select(record_id.cast("bigint").alias("i"), ddl.alias("t")).mapInArrow(_ddl, _DDL)


def view_sources(df: DataFrame, record_id: str, ddl: str) -> DataFrame:
    """record_id, table_name: tables that views read, by FROM and JOIN."""
    t = F.regexp_extract_all(F.col(ddl), F.lit(r"(?is)CREATE\s+(?:OR\s+REPLACE\s+)?(?:MATERIALIZED\s+)?VIEW\b[^;]*"), F.lit(0))
    names = F.flatten(F.transform(t, lambda v: F.regexp_extract_all(v, F.lit(r"(?i)\b(?:FROM|JOIN)\s+([\w.]+)"), F.lit(1))))
    return df.select(F.col(record_id).alias("record_id"), F.explode(F.array_distinct(names)).alias("table_name"))
