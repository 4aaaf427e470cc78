import datetime as dt
import random

import pytest

from weftwork.functions.common import carried, in_order, ranked
from weftwork.operators import orphans as O

REF = "record_table string, record_key string, ref_field string, domain string, key string, at timestamp, missing boolean"
TGT = "domain string, key string, since timestamp, until timestamp, at timestamp"


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Small range partitions would be put together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def day(n):
    return None if n is None else dt.datetime(2026, 1, 1) + dt.timedelta(hours=7 * n)


def run(spark, refs, targets):
    r = spark.createDataFrame([(a, b, c, d, e, day(f), True) for a, b, c, d, e, f in refs], REF)
    t = spark.createDataFrame([(a, b, day(c), day(d), None) for a, b, c, d in targets], TGT)
    return sorted((x.record_table, x.record_key, x.ref_field, x.ref_key, x.reason) for x in O.orphan_references(r, t).collect())


def brute(refs, targets):
    first = {}
    for *k, at in refs:
        if k[4] is not None:
            k = tuple(k)
            old = first.get(k, "none")
            first[k] = at if old in ("none", None) or at is not None and at < old else old
    out = []
    for (tab, rec, field, dom, key), at in first.items():
        mine = [(s, u) for d, k, s, u in targets if d == dom and k == key]
        came = [(s, u) for s, u in mine if s is not None and at is not None and s <= at]
        if not any(u is None or u > at for s, u in came):
            out.append((tab, rec, field, key, "never_came" if not mine else "deleted" if came else "came_later"))
    return sorted(out)


def test_against_brute_force(spark):
    r = random.Random(3)
    key = lambda: "hot" if r.random() < 0.34 else r.choice(["a", "b", "", "zz", None, *[f"k{i}" for i in range(25)]])
    refs = [("t", f"r{r.randrange(80)}", r.choice("fg"), r.choice("xy"), key(), r.choice([None, *range(60)])) for _ in range(500)]
    targets = [(r.choice("xy"), key(), s := r.choice([None, *range(60)]), r.choice([None, (s or 0) + r.randrange(20)])) for _ in range(150)]
    refs += refs[:30]
    assert run(spark, refs, targets) == brute(refs, targets)


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    assert run(spark, [], [("x", "a", 1, None)]) == []
    assert run(spark, [("t", "r", "f", "x", "a", 1)], []) == [("t", "r", "f", "a", "never_came")]


def test_one_row_a_run_and_runs_decide(spark):
    names = [f"k{i:03d}" for i in range(200) if i % 7] + ["k7", "k8", "k10", "plain", None, "x" * 30 + "9" * 25]
    p = spark.createDataFrame([("x", k) for k in names + names[:9]], "domain string, key string")
    runs = sorted((r.stem, r.run_start, r.run_end, r.n_keys) for r in O.key_runs(p).collect())
    assert [x[1:] for x in runs if x[0] == "k#3"] == [(i + 1, min(i + 6, 199), min(i + 6, 199) - i) for i in range(0, 200, 7)]
    assert [x[1:] for x in runs if x[0] == "k#1"] == [(7, 8, 2)] and [x[1:] for x in runs if x[0] == "k#2"] == [(10, 10, 1)] and len(runs) == 29 + 4
    q = spark.createDataFrame([("x", k, i) for i, k in enumerate([f"k{i:03d}" for i in range(205)] + ["k07", "k10", "plain", "k", "plain1"])], "domain string, key string, missing int")
    want = {f"k{i:03d}" for i in (*range(0, 200, 7), *range(200, 205))} | {"k07", "k", "plain1"}
    q = q.drop("missing")
    assert {r.key for r in O.outside_runs(q, O.key_runs(p)).filter("missing").collect()} == want
    assert O.outside_runs(q, O.key_runs(p).limit(0)).filter("missing").count() == 210  # without the runs every reference is an orphan


def test_a_third_of_all_references_on_one_key_and_day(spark):
    refs = [("t", f"r{i}", "f", "x", "hot" if i % 3 == 0 else f"k{i}", 10) for i in range(3000)]
    targets = [("x", "hot", 5, 10), ("x", "hot", 9, 20)] + [("x", f"k{i}", 0, None) for i in range(0, 3000, 2)]
    assert run(spark, refs, targets) == brute(refs, targets)
    lines = spark.createDataFrame([("x", "hot", i) for i in range(3000)], "domain string, key string, n int")
    parts = {r._p for r in in_order(lines, ["domain", "key", "n"]).select("_p").distinct().collect()}
    assert len(parts) > 1  # the key is split


def test_call_names(spark):
    df = spark.createDataFrame([(" A.b() ",), ("A.b",), ("A.b ()",), (None,)], "c string")
    assert [r[0] for r in df.select(O.call_name("c")).collect()] == ["A.b", "A.b", "A.b", None]


def test_folds_cross_partitions(spark):
    r = random.Random(1)
    rows = [(r.choice("aabcdd"), i, r.choice([None, *range(50)])) for i in range(300)]
    got = carried(in_order(spark.createDataFrame(rows, "g string, i int, v int"), ["g", "i"]), ["g"], ["i"], {"l": ("last", "v", True), "p": ("last", "v", False), "m": ("max", "v", True), "s": ("sum", "v", False)}).collect()
    assert len({x._p for x in got}) > 2 and len(got) == 300
    for x in got:
        upto = [v for g, i, v in rows if g == x.g and i <= x.i and v is not None]
        ahead = [v for g, i, v in rows if g == x.g and i < x.i and v is not None]
        assert (x.l, x.p, x.m, x.s) == (upto[-1] if upto else None, ahead[-1] if ahead else None, max(upto, default=None), sum(ahead) if ahead else None)
    pos = ranked(spark.createDataFrame(rows, "g string, i int, v int"), ["g"], ["i"])
    assert all(x.pos == sum(1 for g, i, _ in rows if g == x.g and i < x.i) for x in pos.collect())
