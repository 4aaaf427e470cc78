import random

import numpy as np
import pytest

from weftwork.llm import mixing as MX
from weftwork.llm import packing as PK
from weftwork.llm.tokens import encoder, token_counts, VOCABULARY


def test_tokens_round_trip(spark):
    rows = [(1, "The tree is full.\r\n"), (2, ""), (3, None), (4, "各レプリカ <|endoftext|> é" * 200), (5, "a" * 20000)]
    enc = encoder(VOCABULARY)
    got = {r.doc_id: r.n_tokens for r in token_counts(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        assert enc.decode(ids) == (t or "") and got[i] == len(ids)


def test_bound_holds_against_optimum():
    r = random.Random(4)
    for _ in range(60):
        cap = r.choice([10, 17, 30])
        x = [r.randint(1, cap) for _ in range(r.randint(1, 8))]
        best = _optimum(sorted(x, reverse=True), cap)
        into, n = PK.best_fit_decreasing(np.array(x), cap)
        assert PK.lower_bound(np.array(x), cap) <= best <= n
        fill = np.bincount(into, x)
        assert fill.max() <= cap and len(fill) == n
        v = np.array([[s, x.count(s)] for s in set(x)])
        assert PK._weighted_bound(v, cap) == PK.lower_bound(np.array(x), cap)


def _optimum(x, cap):
    best = [len(x)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(x):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + x[i] <= cap:
                bins[k] += x[i]
                go(i + 1, bins)
                bins[k] -= x[i]
        bins.append(x[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


@pytest.mark.parametrize("per", [100_000, 40])
def test_pack_whole(spark, per):
    r = random.Random(1)
    rows = [(i, " ".join(["word"] * r.choice([0, 1, 5, 30, 70, 100, 260]))) for i in range(200)] + [(900, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS size", "'x' AS part")
    specs = spark.createDataFrame([("s", 100), ("w", 300), ("bad", None), ("s", 100)], "spec_name string, capacity_tokens int")
    got = PK.pack(docs, specs, per_partition=per).collect()
    size = {x.doc_id: x.n_tokens for x in token_counts(docs).collect()}
    for spec, cap in (("s", 100), ("w", 300)):
        mine = [x for x in got if x.spec_name == spec]
        assert {x.doc_id for x in mine} == {i for i, _ in rows}
        fill, total = {}, {}
        for x in mine:
            fill[x.container_id] = fill.get(x.container_id, 0) + x["size"]
            total[x.doc_id] = total.get(x.doc_id, 0) + x["size"]
        assert max(fill.values()) <= cap and total == size
        assert all(len([x for x in mine if x.doc_id == i]) == max(1, -(-n // cap)) for i, n in size.items())
    b = {x.spec_name: x for x in PK.bounds(spark.createDataFrame(got)).collect()}
    assert all(v.n_containers >= v.least_containers for v in b.values()) and b["w"].n_containers - b["w"].least_containers <= (1 if per > 100 else 6)


def test_pack_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    specs = spark.createDataFrame([("s", 100)], "spec_name string, capacity_tokens int")
    assert PK.pack(docs, specs).count() == 0


def test_mix_meets_targets_and_caps(spark):
    r = random.Random(2)
    rows, k = [], 0
    for src, n in (("Big", 1500), ("mid-dle", 300), ("tiny ", 20), (None, 10), ("other", 10)):
        for _ in range(n):
            rows.append((k, " ".join(["token"] * r.randint(1, 20)), src))
            k += 1
    rows.append((k, None, "big"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS n_tokens", "'z' AS source_name")
    goals = spark.createDataFrame([("big", 0.6, 2), ("MID_DLE", 0.35, 3), ("tiny", 0.05, 4), ("absent", 0.0, 9)], "source_name string, target_share double, max_repeats int")
    chosen, shares = MX.mix(docs, goals)
    got = {x.source_name: x for x in shares.collect()}
    assert abs(got["big"].actual_share - 0.6) < 0.01 and abs(got["mid_dle"].actual_share - 0.35) < 0.01 and abs(got["tiny"].actual_share - 0.05) < 0.01
    assert got["absent"].tokens == 0
    rep = {x.doc_id: x.repeats for x in chosen.collect()}
    tiny = [rep.get(i, 0) for i, _, s in rows if s == "tiny "]
    assert max(tiny) <= 4 and max(tiny) - min(tiny) <= 1  # complete epochs come first
    assert not any(i in rep for i, _, s in rows if s in (None, "other"))
    assert MX.mix(docs, goals)[0].count() == len(rep)  # the draw repeats


def test_mix_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    goals = spark.createDataFrame([("a", 1.0, 2)], "source_name string, target_share double, max_repeats int")
    chosen, shares = MX.mix(docs, goals)
    assert chosen.count() == 0 and shares.first().tokens == 0


@pytest.mark.parametrize("total", [100, 487])
def test_budgets_are_filled_until_nothing_fits(spark, total):
    from pyspark.sql import functions as F

    r = random.Random(total)
    docs = spark.createDataFrame([(i, " ".join(["token"] * r.choice([1, 2, 7, 30, 45])), "a") for i in range(300)], "doc_id bigint, text string, source string")
    goals = spark.createDataFrame([("a", 1.0, 1)], "source_name string, target_share double, max_repeats int")
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(17)), 11).cast("double") + 0.5) / float(1 << 53)
    order = [x.doc_id for x in docs.orderBy(-F.log(u), "doc_id").collect()]
    size = {x.doc_id: x.n_tokens for x in token_counts(docs).collect()}
    want, left = set(), total
    for i in order:
        if size[i] <= left:
            want.add(i)
            left -= size[i]
    chosen, shares = MX.mix(docs, goals, total_tokens=total, weight=F.lit(1.0))
    assert {x.doc_id for x in chosen.collect()} == want and shares.first().tokens == total - left


def test_mix_keeps_documents_without_weight_and_takes_many_sources(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "one two three", f"s{i % 3}", [None, 0.0, -1.0, float("nan"), 2.0][i % 5]) for i in range(30)], "doc_id bigint, text string, source string, w double")
    goals = spark.createDataFrame([(f"s{i}", 1.0 / 3 if i < 3 else 0.0, 1) for i in range(10_005)], "source_name string, target_share double, max_repeats int")
    chosen, shares = MX.mix(docs, goals, weight=F.col("w"))
    assert chosen.count() == 30 and shares.count() == 10_005


def test_pack_many_capacities(spark, monkeypatch):
    monkeypatch.setattr(PK, "SPECS", 2)
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a")], "doc_id bigint, text string")
    specs = spark.createDataFrame([(f"s{i}", i + 1) for i in range(5)], "spec_name string, capacity_tokens int")
    got = PK.pack(docs, specs).groupBy("spec_name").sum("size").collect()
    assert len(got) == 5 and len({x[1] for x in got}) == 1
