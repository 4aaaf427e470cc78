import tarfile

from pyspark.sql import functions as F

from weftwork.functions import ed25519 as ED
from weftwork.operators import proposals as PR
from weftwork.sources import files as FS


def test_signatures(spark):
    # RFC 8032, test 2
    seed = bytes.fromhex("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb")
    pub = ED.public_key(seed)
    assert pub.hex() == "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c"
    sig = ED.sign(seed, b"\x72")
    assert sig.hex().startswith("92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da")
    rows = [(1, pub, b"\x72", sig), (2, pub, b"\x73", sig), (3, pub, b"\x72", sig[:-1] + b"\xff"), (4, None, b"x", sig), (5, pub, b"x", b"short"), (6, b"\xff" * 32, b"\x72", sig)]
    df = spark.createDataFrame([(i, None if p is None else bytearray(p), bytearray(m), bytearray(s)) for i, p, m, s in rows], "i int, p binary, m binary, s binary")
    assert {r.i for r in df.filter(ED.signed(F.col("p"), F.col("m"), F.col("s"))).collect()} == {1}


def test_evolve(spark):
    below = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "root string, change_id string")
    own = spark.createDataFrame([("a", "ua"), ("b", "ub"), ("c", "uc")], "change_id string, universe_id string")
    comp = spark.createDataFrame([("ua", "x"), ("ub", "y"), ("uc", "z"), ("ud", "w")], "universe_id string, component_id string")
    got = sorted((r.universe_id, r.component_id) for r in PR.evolve(below, own, comp).collect())
    assert got == [("ub", "x"), ("ub", "y"), ("uc", "x"), ("uc", "y"), ("uc", "z")]


def test_reconcile_and_status(spark):
    a = spark.createDataFrame([("k", 1, "x"), ("k", 5, "y"), ("m", 1, "q")], "k string, t int, v string")
    b = spark.createDataFrame([("k", 3, "z"), ("n", 1, "r"), ("m", 2, "q")], "k string, t int, v string")
    assert {tuple(r) for r in PR.reconcile(a, b, "k", ["t"], "v").collect()} == {("k", "y", True), ("n", "r", False), ("m", "q", False)}
    assert PR.next_status("OPEN", "approve") == "APPROVED" and PR.next_status("MERGED", "close") == "MERGED"


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("b/x.txt", "two"), ("a.txt", "one"), (None, "no"), ("e", None)], "path string, content string")
    assert FS.export_tar(df, str(tmp_path / "o.tgz")) == 3
    with tarfile.open(tmp_path / "o.tgz") as t:
        assert t.getnames() == ["a.txt", "b/x.txt", "e"] and t.extractfile("a.txt").read() == b"one"
    old = df.limit(0).selectExpr("path", "content AS sha256").unionByName(spark.createDataFrame([("a.txt", "other")], "path string, sha256 string"))
    got = {r.path: (r.is_new, r.modified) for r in FS.export_flags(df, old).collect()}
    assert got["a.txt"] == (False, True) and got["b/x.txt"] == (True, False)


def test_stack_order_holds_every_change(spark):
    rows = [(f" C{i} ", i, 0, None if i == 7 else i % 5, "universe-main" if i % 3 else f"c{i - 1}", i % 4) for i in range(90)]
    rows += [("c5", 900, 0, 77, "c1", 1), ("", 1, 0, 0, None, 0), (None, 1, 0, 0, None, 0)]
    df = spark.createDataFrame(rows, "change_id string, updated_at int, ingested_at int, order_index int, parent_change_id string, created_at int")
    want = [(None, 3, "c7"), *sorted([(i % 5, i % 4, f"c{i}") for i in range(90) if i not in (5, 7)] + [(77, 1, "c5")])]
    got = PR.stack_order(df.repartition(5)).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(90)) and [(r.order_index, r.change_id) for r in got] == [(o, k) for o, _, k in want]
