import random
import string

import pytest

from weftwork.llm import shared_spans as SS


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "rid bigint, text string, w string, pos int")


def brute(rows, n):
    one = {}
    for i, t in rows:
        if t is not None:
            one.setdefault(i, t)
    grams = {i: {t[p:p + n] for p in range(len(t) - n + 1)} for i, t in one.items()}
    return {(a, b) for a in grams for b in grams if a < b and grams[a] & grams[b]}


@pytest.mark.parametrize("n", [40, 150])
def test_against_brute_force(spark, n):
    r = random.Random(n)
    alphabet = string.ascii_lowercase[:6] + " ;\n{}.é漢😀"
    text = lambda k: "".join(r.choice(alphabet) for _ in range(k))
    rows = []
    for i in range(60):
        rows.append((i, text(r.randint(0, 3 * n))))
    for i in range(60, 110):  # exact, one too short, with repeats inside
        src = rows[r.randrange(60)][1]
        k = r.choice([n - 1, n, n + 1, 2 * n])
        p = r.randint(0, max(0, len(src) - k))
        rows.append((i, text(r.randint(0, 50)) + src[p:p + k] + text(r.randint(0, 50))))
    rows += [(200, None), (201, ""), (202, "a" * 5 * n), (203, "b" + "a" * 2 * n), (204, rows[0][1]), *rows[:10]]
    got = {(x.rid_a, x.rid_b) for x in SS.shared_pairs(docs(spark, rows), min_chars=n).collect()}
    assert got == brute(rows, n)


def test_runs_shares_and_kept_text(spark):
    r = random.Random(1)
    s = "".join(r.choice(string.ascii_letters + ";\n") for _ in range(120))
    rows = [(1, "head one " + s + " tail"), (2, "other " + s), (3, "nothing in common here at all " * 5), (4, None), (5, "")]
    df = docs(spark, rows)
    runs = {x.rid: (x.start, x.stop) for x in SS.shared_runs(df, min_chars=50).collect()}
    assert runs[1][0] <= 9 and runs[1][1] >= 129 and set(runs) == {1, 2}
    share = {x.rid: x for x in SS.shared_share(df, min_chars=50).collect()}
    assert share[1].shared_chars >= 120 and share[3].share == 0 and share[4].n_chars == 0 and share[5].share == 0
    kept = {x.rid: x.text for x in SS.without_repeats(df, min_chars=50).collect()}
    assert kept[1] == rows[0][1] and s not in kept[2] and kept[2].startswith("other") and kept[4] is None and kept[5] == ""


def test_empty_table_and_hot_group(spark):
    assert SS.shared_pairs(docs(spark, []), min_chars=50).count() == 0
    r = random.Random(2)
    text = lambda: "".join(r.choice(string.ascii_letters) for _ in range(90))
    t = text()
    hot = [(i, t) for i in range(40)] + [(i, text()) for i in range(40, 100)]
    assert SS.shared_pairs(docs(spark, hot), min_chars=50).count() == 40 * 39 // 2


def test_classes_have_a_row_a_record_and_compare_texts(spark, monkeypatch):
    r = random.Random(5)
    text = lambda k: "".join(r.choice(string.ascii_letters) for _ in range(k))
    licence = text(120)
    rows = [(i, licence + text(60)) for i in range(50)] + [(i, text(200)) for i in range(50, 80)]
    got = SS.span_classes(docs(spark, rows), min_chars=50).collect()
    size = {c: sum(x.class_id == c for x in got) for c in {x.class_id for x in got}}
    assert {x.rid for x in got} == set(range(50)) and sorted(size.values())[-1] == 50 and len(got) < 200  # chance may lengthen a few spans by a letter
    assert all(x.n_records == size[x.class_id] for x in got)
    assert all(len({rows[x.rid][1][x.start:x.start + 50] for x in got if x.class_id == c}) == 1 for c in size)
    # windows that share a hash but no text: a class of their own each, so no pair
    clash = spark.createDataFrame([(1, 0, 7, 1), (2, 3, 7, 1)], "rid bigint, pos int, w bigint, first_rid bigint")
    monkeypatch.setattr(SS, "_repeated", lambda marked, n: clash)
    monkeypatch.setattr(SS, "_marked", lambda d, n: d.select("rid", "text"))
    assert SS.shared_pairs(docs(spark, rows[50:52] + [(1, text(60)), (2, text(60))]), min_chars=50).count() == 0
