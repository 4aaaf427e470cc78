from weftwork.operators import graph as G
from weftwork.operators import provenance as P

NODES = [("ui.App", "typescript"), ("api.Server", "go"), ("db.Store", "go"), ("infra.DB", "hcl"), ("api.Metrics", "go")]
EDGES = [("ui.App", "api.Server", "CONSUMES_API"), ("ui.App", "api.Metrics", "CONSUMES_API"), ("api.Server", "db.Store", "CALLS"), ("db.Store", "infra.DB", "DEPLOYS_TO")]


def graph(spark, extra=()):
    return spark.createDataFrame([*EDGES, *extra], "source_id string, target_id string, edge_type string")


def start(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node_id string")


def reach(df):
    return {r.node_id: r.depth for r in df.collect()}


def test_traversals(spark):
    e = graph(spark)
    assert reach(G.traverse(e, start(spark, "ui.App"))) == {"ui.App": 0, "api.Server": 1, "api.Metrics": 1, "db.Store": 2, "infra.DB": 3}
    assert len(reach(G.traverse(e, start(spark, "ui.App"), max_depth=1))) == 3
    assert len(reach(G.traverse(e, start(spark, "ui.App"), edge_types=["CONSUMES_API"]))) == 3
    back = reach(G.traverse(e, start(spark, "infra.DB"), backward=True))
    assert len(back) == 4 and back["ui.App"] == 3
    assert [r.node_id for r in G.shortest_path(e, start(spark, "ui.App"), "infra.DB").orderBy("step").collect()] == ["ui.App", "api.Server", "db.Store", "infra.DB"]
    assert G.shortest_path(e, start(spark, "infra.DB"), "ui.App").count() == 0


def test_loops_end_and_show_their_edges(spark):
    e = graph(spark, [("db.Store", "ui.App", "CALLS"), ("db.Store", "ui.App", "CALLS"), (None, "x", "CALLS")])
    r = G.traverse(e, start(spark, "ui.App", "ui.App"))
    assert len(reach(r)) == 5
    assert ("db.Store", "ui.App") in {(x.source_id, x.target_id) for x in G.visited_edges(e, r).collect()}
    assert reach(G.traverse(e, start(spark))) == {}
    assert reach(G.traverse(e, start(spark, "unknown"))) == {"unknown": 0}


def test_impact(spark):
    e = graph(spark)
    assert G.impact_risk(e, "api.Server").first().risk == 0.5
    assert G.impact_risk(e, "nowhere").first().risk == 0.1


def test_blast_report(spark):
    nodes = spark.createDataFrame([("h", "go"), ("a", "typescript"), ("u", "typescript")], "node_id string, language string")
    edges = spark.createDataFrame([("h", "a", "CONSUMES_API"), ("a", "u", "CALLS")], "source_id string, target_id string, edge_type string")
    rec = spark.createDataFrame([(1, "h", "back", "o", "m", "s1", "p", "2026-01-01 00:00:00"), (2, "a", "front", "o", "n", "s1", "p", "2026-01-01 00:00:00")],
                                "record_id int, node_id string, agent string, orchestrator string, model string, session string, prompt string, ts string")
    r = P.blast_report(nodes, edges, rec, agent="back").first()
    assert (r.direct, r.downstream, r.total, r.n_languages, float(r.risk)) == (1, 2, 3, 2, 8.0)
    assert P.audit_filter(nodes, rec, agent="back", model="n").count() == 0  # all criteria on one record
