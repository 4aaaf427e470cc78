import random

import pytest

from weftwork.llm import reading as RL

WORDS = {1: "the cat sat on a red mat and ran to us".split(), 2: "people usually walk through their village after breakfast because weather improves".split(),
         3: "server configuration validates every request before committing results into persistent storage".split(),
         4: "epistemological considerations notwithstanding methodological interpretations presuppose irreducible ontological commitments".split()}


def prose(r, level, n=8):
    size = {1: 5, 2: 11, 3: 15, 4: 24}[level]
    return " ".join(" ".join(r.choice(WORDS[level]) for _ in range(size)).capitalize() + "." for _ in range(n))


def test_sentences_leave_layout_out():
    t = "# Head line here\n\n- One item of the list\n- Another item of it\n\nThis sentence is\r\nwrapped hard. See `x.y()` and https://a.example/b now.\n\n```java\nint x = 1; // not prose at all\n```\n"
    assert RL.sentences(t) == ["One item of the list", "Another item of it", "This sentence is wrapped hard.", "See and now."]
    assert RL.sentences("") == [] and RL.sentences("```\nonly code here\n```") == []


def test_held_out_accuracy(spark):
    r = random.Random(1)
    rows = [(i, prose(r, 1 + i % 4)) for i in range(160)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "各レプリカは葉から上に向かって木をたどります。" * 5), (903, "x" * 100_000)], "doc_id bigint, text string").selectExpr("*", "3 AS reading_level", "0 AS n_words")
    labels = spark.createDataFrame([(i, 1 + i % 4, "a") for i in range(80)] + [(3, 3, "b"), (5, None, "b")], "doc_id bigint, reading_level int, annotator string")
    got = {x.doc_id: x for x in RL.reading_levels(docs, labels).collect()}
    right = sum(round(got[i].difficulty) == 1 + i % 4 for i in range(80, 160))
    assert right >= 76
    assert all(got[i].difficulty is None for i in (900, 901, 902))
    found = {x.doc_id for x in RL.demanding(RL.reading_levels(docs, labels)).collect()}
    assert found >= {i for i in range(80, 160) if i % 4 == 3} and not any(i % 4 != 3 for i in found if i < 160)


def test_needs_labels(spark):
    docs = spark.createDataFrame([(1, "A short text.")], "doc_id bigint, text string")
    with pytest.raises(ValueError):
        RL.reading_levels(docs, spark.createDataFrame([], "doc_id bigint, reading_level int"))
