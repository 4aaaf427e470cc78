import random

import pytest
from pyspark.sql import functions as F

from weftwork.operators import hierarchy as H

SCHEMA = "k string, p string, t int, node_key string, depth int"  # clashing extra columns


def links(spark, rows):
    df = spark.createDataFrame([(k, p, t, "x", 9) for k, p, t in rows], SCHEMA)
    return H.parent_links(df, H.norm_key("k"), H.norm_key("p"), ["t"])


def brute(rows):
    one = {}
    for k, p, t in rows:
        k, p = (k or "").strip().lower(), (p or "").strip().lower()
        if k and (k not in one or (t, p) > one[k]):
            one[k] = (t, p)
    up = {k: p if p in one and p not in H.NO_PARENT else None for k, (_, p) in one.items()}
    out = {}
    for k in up:
        trail, x = [], k
        while x is not None and x not in trail:
            trail.append(x)
            x = up[x]
        out[k] = (trail[-1], len(trail) - 1) if x is None else (min(trail[trail.index(x):]), -1)
    return out


def run(spark, rows, **kw):
    return {r.node_key: r for r in H.hierarchy(links(spark, rows), **kw).collect()}


@pytest.mark.parametrize("bound", [100_000, 2])
def test_random_forests_with_loops_and_repeats(spark, bound):
    r = random.Random(5)
    rows = []
    for i in range(150):
        p = r.choice([None, "", "root", "universe-main", "0" * 40, f" K{r.randrange(150)} ", f"k{r.randrange(max(1, i))}", f"k{max(0, i - 1)}", "gone"])
        rows.append((f"k{i}", p, 0))
    rows += [("k3", "k9", 1), ("k9", "k3", 1), ("k20", "k20", 2), (" K7 ", "k6", 5), (None, "k1", 1), ("", "k1", 1)] + rows[:20]
    got, want = run(spark, rows, max_component=bound), brute(rows)
    assert {k: (v.root_key, v.depth) for k, v in got.items()} == want
    for v in got.values():
        if v.depth >= 0:
            assert v.path[0] == v.root_key and v.path[-1] == v.node_key and len(v.path) == v.depth + 1
        else:
            assert v.path is None
    assert {k for k, v in got.items() if v.on_loop} == {k for k, (_, d) in want.items() if d == -1 and _loops(want, rows, k)}


def _loops(want, rows, k):
    one = {}
    for a, p, t in rows:
        a, p = (a or "").strip().lower(), (p or "").strip().lower()
        if a and (a not in one or (t, p) > one[a]):
            one[a] = (t, p)
    x = one[k][1]
    for _ in range(len(one)):
        if x == k:
            return True
        x = one[x][1]
    return False


def test_deep_chain_in_both_ways(spark):
    rows = [(f"n{i:05d}", f"n{i - 1:05d}" if i else None, 0) for i in range(700)]
    a, b = run(spark, rows), run(spark, rows, max_component=10)
    assert a["n00699"].depth == b["n00699"].depth == 699 and a["n00699"].path == b["n00699"].path


def test_descendants_and_empty(spark):
    h = H.hierarchy(links(spark, [("a", None, 0), ("b", "a", 0), ("c", "b", 0), ("d", "a", 0)]))
    got = {tuple(r) for r in H.descendants(h).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 1)}
    assert H.hierarchy(links(spark, [])).count() == 0
    assert H.hierarchy(links(spark, [(None, None, 0)])).count() == 0


def test_hub_with_a_third_of_all_rows(spark):
    rows = [("hub", None, 0)] + [(f"x{i}", "hub" if i % 3 == 0 else None, 0) for i in range(600)]
    got = H.hierarchy(links(spark, rows), max_component=50).groupBy("root_key").count().filter("count > 1").collect()
    assert [(r.root_key, r["count"]) for r in got] == [("hub", 201)]


def test_each_loop_has_one_back_edge(spark):
    got = H.hierarchy(links(spark, [("a", "c", 0), ("b", "a", 0), ("c", "b", 0), ("t", "a", 0)]))
    assert got.filter("back_edge").count() == 1 and got.filter("on_loop").count() == 3
    assert {r.root_key for r in got.collect()} == {"a"}
    assert got.agg(F.max("depth")).first()[0] == -1


@pytest.mark.parametrize("seed", [1, 2])
def test_small_and_large_components_give_the_same_rows(spark, seed):
    r = random.Random(seed)
    rows = [(f"k{i}", r.choice([None, f"k{r.randrange(90)}", f"k{r.randrange(90)}", f"k{max(0, i - 1)}"]), 0) for i in range(90)]
    rows += [("a", "c", 0), ("b", "c", 0), ("c", "d", 0), ("d", "b", 0)]
    one = lambda bound: sorted((v.node_key, v.parent_key, v.root_key, v.depth, tuple(v.path or ()), v.on_loop, v.back_edge) for v in run(spark, rows, max_component=bound).values())
    small = one(100_000)
    assert small == one(1) and ("b", "c", "b", -1, (), True, True) in small
    assert {x[0] for x in small if x[6]} == {x[2] for x in small if x[3] == -1}


def test_all_descendants_of_every_node_with_loops(spark):
    r = random.Random(8)
    rows = [(f"k{i}", r.choice([None, "root", f"k{r.randrange(120)}", f"k{max(0, i - 1)}"]), 0) for i in range(120)] + [("s", "s", 0), ("s1", "s", 0), ("s2", "s1", 0), ("s3", "s2", 0)]
    up = dict((k, p) for k, p, _ in rows)
    want = set()
    for k in up:
        x, seen = up[k], set()
        while x in up and x not in seen:
            seen.add(x)
            x = up[x]
        want |= {(a, k) for a in seen}
    got = [tuple(x) for x in H.all_descendants(links(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and ("s", "s") in want and len({a for a, _ in want}) > 5
    assert H.all_descendants(links(spark, [])).count() == 0
