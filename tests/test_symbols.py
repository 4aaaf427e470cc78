from pyspark.sql import functions as F

from weftwork.operators import eventlog as EL
from weftwork.operators import symbols as SY


def test_tiers(spark):
    rows = [("go", "FunctionDecl", "a", "services/x.go", "API/Backend"), ("hcl", "ResourceBlock", "r", "infra/x.tf", "Cloud Infra"), ("hcl", "ResourceBlock", "r", "web/x.tf", "Frontend"), ("typescript", "X", "a", None, "Frontend"),
            ("java", "X", "a", None, "Backend"), ("dockerfile", "BaseImage", "b", "", "Cloud Infra"), (None, None, "pageTemplate", None, "Frontend"), (None, None, None, None, "Backend")]
    df = spark.createDataFrame(rows, "l string, n string, i string, p string, want string")
    assert df.filter(SY.tier(F.col("l"), F.col("n"), F.col("i"), F.col("p")) != F.col("want")).count() == 0


def test_topology_takes_the_newest_component(spark):
    c = spark.createDataFrame([("a", 1, "old.go", ["s1"]), ("a", 2, "new.go", ["s1", "s2", "gone"]), ("b", 3, None, ["s2"])], "name string, pos int, file_path string, symbol_ids array<string>")
    s = spark.createDataFrame([("s1", "go", "F", "x"), ("s2", "go", "F", "y")], "node_id string, language string, node_type string, identifier string")
    got = {(r.node_id, r.component) for r in SY.topology(c, s).collect()}
    assert got == {("s1", "a"), ("s2", "b")}


def test_resolution(spark):
    s = spark.createDataFrame([(1, "aa11bb22", "main.Get"), (2, "cc", "GetAll"), (3, "dd", "get"), (4, "ee", "x.get")], "pos int, node_id string, identifier string")
    one = lambda t: [r.pos for r in SY.resolve_symbol(s, t, ["pos"]).collect()]
    assert one("get") == [3] and one("aa11bb") == [1] and one("GETALL") == [2] and one("Get") == [1] and one("zzz") == []


def test_edits_and_conflicts(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["x"],), ([],)], "v array<string>")
    run = lambda verb: [r[0] for r in df.select(SY.edit_list(F.col("v"), verb, "b", "n")).collect()]
    assert run("replace") == [["a", "n", "c"], ["x"], []] and run("delete") == [["a", "c"], ["x"], []] and run("before") == [["a", "n", "b", "c"], ["x"], []]
    assert run("after") == [["a", "b", "n", "c"], ["x"], []] and run("append") == [["a", "b", "c", "n"], ["x", "n"], ["n"]]
    v = spark.createDataFrame([("s", "h2", 2), ("s", "h1", 1), ("s", "h1", 5), ("t", "h", 1)], "symbol_id string, ast_hash string, seq int")
    import hashlib
    got = SY.conflicts(v).collect()
    assert [(r.symbol_id, r.n_versions, r.conflict_id) for r in got] == [("s", 2, "conflict-" + hashlib.sha256(b"sh1h2").hexdigest()[:12])]


def test_line_diff(spark):
    df = spark.createDataFrame([(1, "a\nb\n\nd", "a\nx"), (2, None, "q"), (3, "s", "s")], "k int, o string, n string")
    assert {tuple(r) for r in SY.line_diff(df, "k", "o", "n").collect()} >= {(1, 2, "-", "b"), (1, 2, "+", "x"), (1, 4, "-", "d")}


def test_branches(spark):
    h = spark.createDataFrame([("main", "h0", None), ("a", "h1", "main"), ("b", "h2", "a"), ("lost", "h3", "gone"), ("self", "h4", "self")], "universe_id string, head string, parent_universe_id string")
    assert EL.create_universe(h, "new", "a").first().head == "h1" and EL.create_universe(h, "a", "main").count() == 0 and EL.create_universe(h, "n", "none").count() == 0
    c = spark.createDataFrame([("main",)], "universe_id string")
    assert {r.universe_id: r.source_id for r in EL.climb(h, c).collect()} == {"main": "main", "a": "main", "b": "main", "lost": None, "self": None}


def test_climb_has_no_limit_and_ends_in_loops(spark):
    rows = [("n0", None)] + [(f"n{i}", f"n{i - 1}") for i in range(1, 71)] + [("x", "y"), ("y", "z"), ("z", "x"), ("t", "x")]
    h = spark.createDataFrame(rows, "universe_id string, parent_universe_id string").coalesce(1)
    got = {r.universe_id: r.source_id for r in EL.climb(h, spark.createDataFrame([("n0",)], "universe_id string")).collect()}
    assert got == {k: "n0" if k[0] == "n" else None for k, _ in rows}
