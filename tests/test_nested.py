import base64
import json
import random

import numpy as np
from pyspark.sql import functions as F

from weftwork.operators import nested as N


def _gen(r, d=0):
    x = r.random()
    if d > 3 or x < 0.3:
        return r.choice([None, 1, 2.5, True, "a", 'q"uo\\te', "[{,:}]", "ü", "", -3])
    if x < 0.65:
        return [_gen(r, d + 1) for _ in range(r.randint(0, 4))]
    return {r.choice(["k", 'a"b', "x,", "é\\"]) + str(i): _gen(r, d + 1) for i in range(r.randint(0, 4))}


def test_index_round_trip():
    r = random.Random(1)
    docs = [_gen(r) for _ in range(800)]
    s = N.Spans([json.dumps(d, indent=r.choice([None, 2]), ensure_ascii=r.random() < 0.5) for d in docs])

    def build(i):
        kids = s.children(np.array([i]))[1]
        if s.kind[i] == 91:
            return [build(c) for c in kids]
        if s.kind[i] == 123:
            return {s.key(c): build(c) for c in kids}
        return json.loads(s.text(i))

    assert [build(i) for i in range(len(docs))] == docs


def run(spark, texts, path, key=None):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "i bigint, t string, parent_key string, child_pos int")
    return sorted(tuple(r)[:2] + (r.child_pos,) for r in N.nested_elements(df, F.col("i"), F.col("t"), path, key).collect())


def test_payload_forms(spark):
    ast = {"kind": "fn", "params": [{"name": "a"}, None, {"name": "b"}]}
    texts = [
        json.dumps({"symbols": {"n1": {"node_id": "n1", "ast_payload": ast}, "n2": {"ast_payload": {"params": {"name": "s"}}}}}),
        json.dumps({"symbols": [{"node_id": "m1", "ast_payload": json.dumps(ast)}, None, {"node_id": 7, "ast_payload": base64.b64encode(json.dumps(ast).encode()).decode()}]}),
        json.dumps({"symbols": None}), json.dumps({"other": 1}), "", None, "  ", '{"symbols": {"n1": {"ast_payload": {"params": [1', "nonsense", '{"symbols": {"z": {"ast_payload": "%%%"}}}', "[1, 2]", "3",
        json.dumps({"symbols": {"e": {"ast_payload": {"params": []}}, "f": {"ast_payload": {"params": None}}, "g": 5}}),
    ]
    assert run(spark, texts, ["symbols", "*", "ast_payload", "params"], "node_id") == [
        (0, "n1", 0), (0, "n1", 2), (0, "n2", 0), (1, "7", 0), (1, "7", 2), (1, "m1", 0), (1, "m1", 2)]


def test_typed_columns_keep_null_positions(spark):
    rows = [(1, [("f", [("a",), None, ("b",)]), None, ("g", None)]), (2, None), (3, [])]
    df = spark.createDataFrame(rows, "i bigint, methods array<struct<name: string, params: array<struct<name: string>>>>")
    got = N.nested_elements(df, F.col("i"), N.as_json(F.col("methods")), ["v", "*", "params"]).collect()
    assert sorted((r.row_id, r.parent_key, r.child_pos) for r in got) == [(1, "0", 0), (1, "0", 2)]


def test_very_long_and_empty(spark):
    big = json.dumps({"v": [{"params": [{"x": "y" * 2000}] * 300}] * 4})
    assert len(run(spark, [big], ["v", "*", "params"])) == 1200
    assert run(spark, [], ["v", "*", "params"]) == []
