import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from weftwork.functions import common as CM
from weftwork.operators import history as HI
from weftwork.operators import linker as L
from weftwork.operators import nested as N


def test_proposal_states_against_a_fold(spark):
    r = random.Random(2)
    rows = [(f"p{r.randrange(5)}", i, r.choice(["approve", "approve", "reject", "revise", "comment", "merge" if i > 150 else "approve"]), f"a{r.randrange(3)}") for i in range(200)]
    got = {(x.proposal_id, x.seq): (x.status, x.clock, x.n_revisions) for x in HI.proposal_states(spark.createDataFrame(rows, "proposal_id string, seq bigint, verb string, author string")).collect()}
    state = {}
    for p, i, verb, who in rows:
        s = state.setdefault(p, {"st": "OPEN", "votes": {}, "clock": 1, "n": 1})
        if s["st"] != "MERGED":
            s["clock"] += 1
            if verb == "merge":
                s["st"] = "MERGED"
            elif verb == "revise":
                s["n"] += 1
                s["st"] = "UNDER_REVIEW" if s["st"] == "CHANGES_REQUESTED" else s["st"]
            elif verb in ("approve", "reject"):
                s["votes"][who] = verb == "approve"
                s["st"] = "CHANGES_REQUESTED" if verb == "reject" else "APPROVED" if all(s["votes"].values()) else s["st"]
        assert got[p, i] == (s["st"], s["clock"], s["n"])
    assert HI.proposal_states(spark.createDataFrame([], "proposal_id string, seq bigint, verb string, author string")).count() == 0


def test_digests_are_those_of_the_joined_text(spark):
    rows = [("a", i, f"é{i % 7}") for i in range(50)] + [("b", 1, "only"), ("c", 1, None)]
    df = spark.createDataFrame(rows, "g string, i int, t string")
    got = {x.k: x.digest for x in HI.ordered_digest(df, F.col("g"), [F.col("i")], F.col("t"), "sha1", header="n {}:", separator=",").collect()}
    for g in "ab":
        text = ",".join(t for k, _, t in rows if k == g).encode()
        assert got[g] == hashlib.sha1(b"n %d:" % len(text) + text).hexdigest()
    assert set(got) == {"a", "b"}


def test_env_values_may_hold_braces(spark):
    def block(*env, kind="env"):
        return [{"block_type": kind, "attributes": {"name": {"value": f'"{k}"'}, "value": {"value": v}}, "nested_blocks": []} for k, v in env]
    payload = {"block_type": "resource", "nested_blocks": [{"block_type": "template", "nested_blocks": [{"block_type": "containers", "nested_blocks": block(("PORT", '"8080"'), ("DB", "${var.x}"), ("J", '{"a": {"b": "}"}}'))}]}, *block(("NO", "x"), kind="other")]}
    rows = [("r1", json.dumps(payload)), ("r2", "{broken env"), ("r3", None), ("r4", json.dumps({"block_type": "env", "attributes": {}})), ("r5", json.dumps({"attributes": {"name": {"value": "Z"}, "value": {"value": 3}}, "block_type": "env"}))]
    df = spark.createDataFrame(rows, "node_id string, payload string")
    got = sorted(tuple(x) for x in L.env_bindings(df, F.col("node_id"), F.col("payload")).collect())
    assert got == [("r1", "DB", "${var.x}"), ("r1", "J", '{"a": {"b": "}"}}'), ("r1", "PORT", "8080"), ("r5", "Z", "")]


def test_containment_against_brute_force(spark):
    r = random.Random(3)
    word = lambda k: "".join(r.choice("abc") for _ in range(k))
    texts, parts = [(f"t{i}", word(r.randrange(0, 40))) for i in range(60)] + [("t60", None)], [(f"p{i}", word(r.randrange(0, 6))) for i in range(40)] + [("p40", None), ("p41", "service")]
    a, b = spark.createDataFrame(texts, "k string, text string"), spark.createDataFrame(parts, "p string, part string")
    got = sorted((x.k, x.p) for x in L._contains(a, b, "text", "part", "k").collect())
    assert got == sorted((k, p) for k, t in texts for p, q in parts if t is not None and q and q in t)
    assert L._contains(a, b.limit(0), "text", "part", "k").count() == 0


def test_large_texts_are_indexed_in_pieces():
    assert list(N.pieces(["x" * 300_000] * 3 + ["y"] * 3 + ["z" * 900_000])) == [(0, 1), (1, 2), (2, 6), (6, 7)] and list(N.pieces([])) == []


def test_no_private_folder_off_a_local_master():
    class Conf:
        def get(self, *_):
            return None

    class Gone:
        def isDefined(self):
            return False

    class Spark:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                @staticmethod
                def sc():
                    return type("X", (), {"getCheckpointDir": staticmethod(Gone)})
    with pytest.raises(RuntimeError):
        CM.shared_dir(Spark())


def test_inverse_events_take_everything_back(spark):
    log = [(1, "CREATE_NODE", "n", "v1"), (2, "UPDATE_NODE", "n", "v2"), (3, "ADD_EDGE", "e", "edge"), (4, "UPDATE_NODE", "n", "v3"), (5, "RECORD_LINEAGE", "r", "x"), (6, "DELETE_NODE", "n", None), (7, "REMOVE_EDGE", "e", "edge")]
    df = spark.createDataFrame([(i, "u", a, e, p) for i, a, e, p in log], "event_id bigint, universe_id string, action string, entity_id string, payload string")
    got = [tuple(x) for x in HI.inverse_events(HI.with_undo(df), 2).orderBy("step").collect()]
    assert got == [(0, "ADD_EDGE", "e", "edge"), (1, "CREATE_NODE", "n", "v3"), (2, "UPDATE_NODE", "n", "v2"), (3, "REMOVE_EDGE", "e", "edge")]
