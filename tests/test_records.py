import random
import struct

from pyspark.sql import functions as F

from weftwork.operators import collab as CO
from weftwork.operators import eventlog as EL
from weftwork.operators import identity as ID
from weftwork.operators import linker as L
from weftwork.operators import rules as R
from weftwork.operators import scoring as S
from weftwork.operators import vectors as V
from weftwork.operators import versions as VS
from weftwork.sources import blobs as B
from weftwork.sources import files as FS


def test_diff_merge_drift(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None)], "k string, v string")
    b = spark.createDataFrame([("x", "1"), ("y", "3"), ("w", "4")], "k string, v string")
    assert {tuple(r) for r in VS.keyed_diff(a, b, "k", "v").collect()} == {("y", "MODIFIED"), ("z", "REMOVED"), ("w", "ADDED")}
    assert {tuple(r) for r in VS.merge_union(a, b, "k", "v").collect()} == {("x", "1"), ("y", "2"), ("z", None), ("w", "4")}
    assert {tuple(r) for r in VS.set_diff(a, b, ["k"]).collect()} == {("removed", "z"), ("added", "w")}
    assert VS.keyed_diff(a.limit(0), b.limit(0), "k", "v").count() == 0


def test_log_state_and_undo(spark):
    log = spark.createDataFrame([(1, "u", "CREATE_NODE", "n", "a"), (2, "u", "UPDATE_NODE", "n", "b"), (3, "u", "COMMIT", "u", None), (4, "u", "DELETE_NODE", "n", None)], "event_id bigint, universe_id string, action string, entity_id string, payload string")
    assert EL.state_at(log).count() == 0
    assert EL.state_at(log, 3).first().payload == "b"
    assert EL.undo(log, 1).first().payload == "b" and EL.undo(log, 9).count() == 0


def test_merkle(spark):
    import hashlib

    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [("one", "a"), *[("five", c) for c in "edcba"]]
    got = {r[0]: r[1] for r in ID.merkle_roots(spark.createDataFrame(rows, "g string, l string"), "g", "l").collect()}
    n = lambda a, b: h(f"merkle_node:{a}:{b}")
    ab, cd, ee = n("a", "b"), n("c", "d"), n("e", "e")
    assert got == {"one": h("merkle_leaf:a"), "five": n(n(ab, cd), n(ee, ee))}


def test_ignore_rules(spark):
    df = spark.createDataFrame([("a/b.log",), ("keep.log",), ("node_modules/x.js",), ("src/gen/x.go",), ("build",), (".",)], "p string")
    got = {r.p for r in df.filter(R.ignored(F.col("p"), F.col("p") == "build", ["*.log", "!keep.log", "node_modules", "src/**.go", "build/"])).collect()}
    assert got == {"a/b.log", "node_modules/x.js", "src/gen/x.go", "build"}


def test_edge_rules(spark):
    e = spark.createDataFrame([("BINDS_ENV", {"env_var": "TEST_DB"}), ("BINDS_ENV", {"env_var": "PROD_DB"}), ("CONSUMES_API", {"consumer_endpoint": "/mock/users"})], "edge_type string, metadata map<string,string>")
    e = e.selectExpr("*", "'test/a.go' AS source_path", "'x' AS target_path", "'s' AS source_identifier", "'t' AS target_identifier")
    left = R.filter_edges(e, [R.parse_edge_rule("ignore BINDS_ENV where env=TEST_*"), R.parse_edge_rule("CONSUMES_API endpoint=/mock/*")])
    assert [r.metadata["env_var"] for r in left.collect()] == ["PROD_DB"]
    assert R.filter_edges(e, [R.parse_edge_rule("edge: ignore * source=test/**")]).count() == 0
    assert R.parse_edge_rule("# note") is None


def test_secret_signatures(spark):
    key = "AIza" + "x" * 35
    df = spark.createDataFrame([(1, f"a\nkey {key}\nb"), (2, 'password = "${var.x}"'), (3, "-----BEGIN RSA PRIVATE KEY-----"), (4, f"{key} // allow-secret"), (5, None)], "i int, t string")
    assert {(r.record_id, r.line_no, r.type) for r in R.secret_lines(df, "i", "t").collect()} == {(1, 2, "Google AI / GCP API Key"), (3, 1, "Private Key")}


def test_vectors(spark):
    df = spark.createDataFrame([(1, "implement user authentication jwt handler"), (2, "user login and jwt token authorization"), (3, "provision kubernetes cluster"), (4, ""), (5, None)], "i int, t string")
    v = {r.i: r.vector for r in V.embed(df, "i", "t").collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    assert abs(dot(v[1], v[1]) - 1) < 1e-9 and dot(v[1], v[2]) > dot(v[1], v[3]) and not any(v[4]) and not any(v[5]) and len(v[5]) == 128


def test_leases_and_overlaps(spark):
    log = spark.createDataFrame([("d", "a", 0, 1), ("d", "b", 5, 2), ("d", "a", 8, 3), ("d", "b", 17, 4), ("d", "b", 18, 5), ("e", "b", 1, 6)], "domain string, agent string, ts_ms bigint, event_id bigint")
    assert {r.event_id: (r.granted, r.owner) for r in CO.lease_requests(log, 10).collect()} == {1: (True, "a"), 2: (False, "a"), 3: (True, "a"), 4: (False, "a"), 5: (True, "b"), 6: (True, "b")}
    iv = spark.createDataFrame([("k", 1, 0, 10), ("k", 2, 9, 30), ("k", 3, 10, 11), ("k", 4, 5, 5), ("z", 5, 0, 99)], "k string, id int, start_ms bigint, end_ms bigint")
    assert {(r.id_a, r.id_b) for r in CO.overlaps(iv, iv, "k", 4).collect()} == {(1, 2), (2, 3)}


def test_linker(spark):
    sym = "node_id string, language string, node_type string, identifier string, metadata map<string,string>, payload string"
    env = '{"block_type": "resource", "attributes": {}, "nested_blocks": [{"block_type": "env", "attributes": {"name": {"value": "PORT"}, "value": {"value": "80"}}}, {"block_type": "env", "attributes": {"name": {"value": "\\"DATABASE_URL\\""}, "value": {"value": "x"}}}]}'
    s = spark.createDataFrame([
        ("r", "go", "RouteBinding", "service:GET /api/v1/users/{id}", {}, "{}"), ("f", "go", "FunctionDecl", "New", {}, '{"env_vars_accessed": ["PORT", "DATABASE_URL"]}'),
        ("c", "typescript", "ApiClientCall", "UserCard.tsx:GET /api/v1/users/:id", {}, "{}"), ("h", "hcl", "ResourceBlock", "resource.run.auth_service", {}, env),
        ("t", "sql", "CreateTableStatement", "table:users", {}, "{}"), ("j", "java", "Entity", "User", {"table_name": "Users"}, '{"table_name": "users"}'),
        ("p", "protobuf", "RPCMethod", "rpc:user.v1.UserService.GetUser", {}, "{}"), ("i", "rust", "FnDef", "get", {"implements_rpc": "getuser"}, "{}")], sym)
    comp = spark.createDataFrame([("auth", "auth-service", "service"), ("lib", "run", "library")], "component_id string, name string, type string")
    got = L.link(s, comp)
    n = {r.edge_type: r["count"] for r in got.groupBy("edge_type").count().collect()}
    assert n == {"CONSUMES_API": 1, "DEPLOYS_TO": 1, "BINDS_ENV": 2, "QUERIES_TABLE": 1, "IMPLEMENTS_RPC": 1}
    b = L.breakages(got, got.limit(0), s, s.filter("node_id <> 'r'"))
    assert {(r.edge_type, r.severity) for r in b.collect()} == {("CONSUMES_API", "BREAKING"), ("DEPLOYS_TO", "WARNING"), ("BINDS_ENV", "BREAKING"), ("QUERIES_TABLE", "BREAKING"), ("IMPLEMENTS_RPC", "BREAKING")}


def test_blobs(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("",)], "t string")
    b = B.put(df, "t")
    assert b.count() == 3 and B.corrupt(b).count() == 0
    B.write_store(b, str(tmp_path / "s"))
    h = b.filter("content = 'b'").first().hash
    assert B.read_store(spark, str(tmp_path / "s"), h).first().content == "b"


def test_frame_log(spark, tmp_path):
    f = FS.frame
    good = f(FS.BEGIN, b"1") + f(FS.PUT, b"x") + f(FS.COMMIT, b"1") + f(FS.BEGIN, b"2") + f(FS.PUT, b"lost")
    bad = f(FS.BEGIN, b"1") + f(FS.PUT, b"y") + f(FS.COMMIT, b"") + b"WFL1" + struct.pack(">BII", 2, 3, 0) + b"zzz" + f(FS.COMMIT, b"")
    df = spark.createDataFrame([("g", bytearray(good)), ("b", bytearray(bad)), ("e", bytearray(b""))], "path string, content binary")
    assert {(r.path, r.payload) for r in FS.committed_frames(df).collect()} == {("g", "x"), ("b", "y")}


def test_scan_and_kinds(spark, tmp_path):
    for p in ("a/go.mod", "a/package.json", "b/main.py", "a/x.log"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x")
    got = FS.scan_directory(spark, str(tmp_path), ["*.log"])
    assert {(r.path, r.is_code) for r in got.select("path", "is_code").collect()} == {("a/go.mod", False), ("a/package.json", False), ("b/main.py", True)}
    assert {(r.dir, r.kind) for r in FS.project_kinds(got).collect()} == {("a", "node")}


def test_scores(spark):
    df = spark.createDataFrame([(0.8, 0.7, 250.0, 1200.0), (1.0, 0.98, 50.0, 450.0)], "a double, b double, c double, d double")
    got = [round(r[0], 4) for r in df.select(S.composite_score(*[F.col(c) for c in "abcd"])).collect()]
    assert got == [0.773, 0.9845]


def test_ranks_across_partitions(spark):
    from weftwork.functions.common import ranked

    rows = [("g", i * 37 % 101) for i in range(101)] + [("h", 5), ("h", 5), (None, 1), (None, 0)]
    got = [tuple(r) for r in ranked(spark.createDataFrame(rows, "g string, v int"), ["g"], ["v"]).collect()]
    assert sorted((v, p) for g, v, p in got if g == "g") == [(i, i) for i in range(101)]
    assert sorted(p for g, v, p in got if g == "h") == [0, 1] and sorted((v, p) for g, v, p in got if g is None) == [(0, 0), (1, 1)]


def test_many_queries_in_blocks_match_single_searches(spark):
    r = random.Random(3)
    rows = [(i, [float(r.randrange(-2, 3)) for _ in range(4)]) for i in range(117)] + [(117, [0.0] * 4), (118, []), (119, None), (120, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, vector array<float>").repartition(3)
    q = v.filter("vec_id % 20 = 0")
    for block, kw in ((None, {}), (13, {}), (13, {"min_score": 0.6})):
        got = {}
        for x in V.search_many(v, q, k=6, block=block, **kw).orderBy("query", "pos").collect():
            got.setdefault(x.query, []).append((x.vec_id, x.score))
        for i in range(0, 121, 20):
            assert got.get(i, []) == [(x.vec_id, x.score) for x in V.search(v, rows[i][1], k=6, **kw).collect()]
    assert V.search_many(v, q.limit(0)).count() == V.search_many(v.limit(0), q).count() == 0


def test_edge_diff_compares_every_edge_of_every_type(spark, tmp_path):
    from weftwork.plans import reference as RF

    tables = {"orders": ("o_orderkey, o_custkey", [(i, i % 4) for i in range(40)]), "customer": ("c_custkey, c_nationkey", [(i, i % 3) for i in range(40)]),
              "supplier": ("s_suppkey, s_nationkey", [(i, i % 3) for i in range(40)]), "nation": ("n_nationkey, n_regionkey", [(i, i % 2) for i in range(40)]),
              "lineitem": ("l_orderkey, l_partkey", [(i, j) for i in range(40) for j in (1, 2, 2)])}
    edges = []
    for (name, (cols, rows)), (x, y, kind) in zip(tables.items(), (("O", "C", "CALLS"), ("C", "N", "DEPLOYS_TO"), ("S", "N", "DEPLOYS_TO"), ("N", "R", "DEPENDS_ON"), ("O", "P", "CONSUMES_API")), strict=True):
        spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in cols.split(", "))).write.parquet(f"{tmp_path}/{name}.parquet")
        edges += [(f"{x}:{i}", f"{y}:{j}", kind, i) for i, j in set(rows)]
    want = {("removed", a, b, k) for a, b, k, n in edges if n % 7 == 0 or n % 5 == 0} | {("added", a, b + "~", k) for a, b, k, n in edges if n % 7 and n % 5 == 0}
    got = [tuple(r) for r in RF.edge_diff(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {r[3] for r in got} == {"CALLS", "DEPLOYS_TO", "DEPENDS_ON", "CONSUMES_API"}
