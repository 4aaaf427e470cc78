from pyspark.sql import functions as F

from weftwork.operators import codecs as C

SAMPLES = {
    "go": ('// Serves all.\nfunc (s *Server) Serve(a int) error {\n  mux.HandleFunc("/users/{id}", h)\n}\ntype Box struct {\n}\n// func gone() {}\n', {("FunctionDecl", "Serve"), ("RouteBinding", "/users/{id}"), ("StructDecl", "Box")}),
    "python": ('@app.get("/a")\ndef read(x):\n    """def no(): pass"""\n    return x\n\nclass A:\n    async def b(self): ...\n', {("RouteBinding", "/a"), ("FunctionDecl", "read"), ("ClassDecl", "A"), ("FunctionDecl", "b")}),
    "typescript": ("export const Card = (p: P) => {\n  fetch('/api/users');\n}\ninterface P {}\nfunction Panel() {}", {("ReactComponent", "Card"), ("ApiClientCall", "/api/users"), ("InterfaceDecl", "P"), ("ReactComponent", "Panel")}),
    "hcl": ('resource "google_run" "auth" {\n}\nvariable "x" {}\n# variable "no" {}\n', {("ResourceBlock", "google_run auth"), ("VariableBlock", "x")}),
    "dockerfile": ("FROM golang:1.22\nENV PORT=80\nEXPOSE 80\nRUN make\nCMD [\"x\"]\n", {("BaseImage", "golang:1.22"), ("EnvBinding", "PORT"), ("PortExpose", "80"), ("Instruction", "RUN"), ("EntryPoint", "[ x ]")}),
    "protobuf": ("service S {\n  rpc Get(A) returns (B);\n}\nmessage A {}\nenum E {}", {("Service", "S"), ("RPCMethod", "Get"), ("Message", "A"), ("Enum", "E")}),
    "graphql": ("type User {\n  name(a: Int): String!\n}\ninput I { x: Int }\nquery Q { a }", {("ObjectType", "User"), ("FieldDefinition", "name"), ("InputType", "I"), ("Operation", "Q")}),
    "rust": ("pub struct A;\nimpl A {\n  pub(crate) fn go(&self) {}\n}\nmacro_rules! m { }", {("StructDef", "A"), ("ImplBlock", "A"), ("FnDef", "go"), ("MacroDef", "m")}),
    "java": ('public class A {\n  @GetMapping("/x")\n  public List<String> go(int a) throws E {\n    return b(a);\n  }\n}', {("ClassOrInterfaceDeclaration", "A"), ("RouteBinding", "/x"), ("MethodDeclaration", "go")}),
    "cpp": ("class A {\n};\nint A::go(int x) const {\n return f(x);\n}\nenum class E { X };", {("ClassDeclaration", "A"), ("FunctionDeclaration", "A::go"), ("EnumDeclaration", "E")}),
    "csharp": ('public record R(int X);\npublic class A {\n  public int N { get; set; }\n  [HttpGet("/x")]\n}', {("RecordDeclaration", "R"), ("ClassDeclaration", "A"), ("PropertyDeclaration", "N"), ("RouteBinding", "/x")}),
    "swift": ("public struct S {\n  func go() {}\n}\nextension S {}\nactor A {}", {("StructDecl", "S"), ("FunctionDecl", "go"), ("ExtensionDecl", "S"), ("ActorDecl", "A")}),
    "kotlin": ('data class D(val a: Int)\nsuspend fun String.go() {}\nget("/x") {', {("ClassDecl", "D"), ("FunctionDecl", "go"), ("RouteBinding", "/x")}),
    "zig": ('const S = struct {};\npub fn go() void {}\ntest "adds" {}', {("StructDef", "S"), ("FnDef", "go"), ("TestDef", "adds")}),
    "wasm": ('(module (func $add (param i32)) (export "add" (func $add)) (memory 1)) ;; (func $no)', {("WasmFunc", "add"), ("WasmExport", "add"), ("WasmMemory", "1")}),
    "ruby": ("module M\n  class A\n    def go?(x)\n# def no\n", {("ModuleDef", "M"), ("ClassDef", "A"), ("MethodDef", "go?")}),
    "php": ("<?php\nfinal class A {\n  public function go() {}\n}\nRoute::get('/x', f);", {("ClassDef", "A"), ("FunctionDef", "go"), ("RouteBinding", "/x")}),
    "elixir": ('defmodule A.B do\n  def go(x), do: x\n  defmacro m(x) do\n  get "/x", C', {("ModuleDef", "A.B"), ("FunctionDef", "go"), ("MacroDef", "m"), ("RouteBinding", "/x")}),
    "sql": ("CREATE TABLE a.t (x INT);\nCREATE UNIQUE INDEX i ON t(x);\nCREATE VIEW v AS SELECT 1;\n-- CREATE TABLE no (x INT);", {("CreateTableStatement", "a.t"), ("CreateIndexStatement", "i"), ("ViewDefinition", "v")}),
}


def test_every_language():
    assert set(SAMPLES) == set(C.DECLARATIONS)
    for lang, (text, want) in SAMPLES.items():
        assert {(s.node_type, s.identifier) for s in C.symbols(text, lang)} == want, lang
        assert C.symbols("", lang) == []


def test_docs_and_lines():
    s = C.symbols(SAMPLES["go"][0], "go")[0]
    assert s.doc == "// Serves all." and s.line_no == 2 and s.signature.startswith("func (s *Server)")


def test_table(spark):
    rows = [(1, "a/Dockerfile", None, "FROM x\n"), (2, "b.unknown", None, "FROM x"), (3, "c.py", "Rust", "fn go() {}"), (4, "d.go", None, None), (5, None, None, "x")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "i int, p string, l string, t string, node_type string")
    got = {(r.record_id, r.language, r.identifier) for r in C.parse_sources(df, F.col("i"), F.col("p"), F.col("l"), F.col("t")).collect()}
    assert got == {(1, "dockerfile", "x"), (3, "rust", "go")}
    assert C.parse_sources(df.limit(0), F.col("i"), F.col("p"), F.col("l"), F.col("t")).count() == 0


def test_ddl(spark):
    ddl = """-- users, all of them
CREATE TABLE IF NOT EXISTS app.users (
  id BIGINT PRIMARY KEY, name VARCHAR(80) NOT NULL DEFAULT 'a, (b)', price NUMERIC(12,2) DEFAULT 0, org_id INT REFERENCES orgs(id),
  note TEXT, CONSTRAINT fk FOREIGN KEY (note, price) REFERENCES notes (a, b), UNIQUE (name)
);
CREATE VIEW v AS SELECT * FROM users u JOIN app.orgs o ON o.id = u.org_id;"""
    df = spark.createDataFrame([(1, ddl), (2, None), (3, "CREATE TABLE cut (a INT, b")], "i int, t string")
    got = {(r.record_id, r.column_name): r for r in C.ddl_columns(df, F.col("i"), F.col("t")).collect()}
    assert {k for k in got} == {(1, "id"), (1, "name"), (1, "price"), (1, "org_id"), (1, "note"), (3, "a")}
    assert got[1, "id"].is_key and got[1, "id"].not_null and got[1, "name"].default_value == "'a, (b)'" and got[1, "name"].is_unique
    assert got[1, "price"].data_type == "NUMERIC(12,2)" and (got[1, "price"].ref_table, got[1, "price"].ref_column) == ("notes", "b") and got[1, "org_id"].ref_table == "orgs"
    assert {r.table_name for r in C.view_sources(df, "i", "t").collect()} == {"users", "app.orgs"}
