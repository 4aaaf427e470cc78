"""Queries over commits, undo, inverse events, git identities and reviews, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.functions.common import norm_key, table
from weftwork.operators import history as HI
from weftwork.plans import adapters as A
from weftwork.plans import reference as RF

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_UNDO = f"""WITH log AS ({A.WIDE_OPLOG}), u AS (SELECT *, CASE WHEN action IN ('ADD_EDGE', 'REMOVE_EDGE') THEN payload WHEN action = 'CREATE_NODE' THEN '{{"node_id":"' || entity_id || '"}}'
ELSE last_value(payload IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS undo_payload FROM log) """


@query(_UNDO + "SELECT event_id, action, entity_id, undo_payload FROM u")
def oplog_record(s, d):
    return HI.with_undo(A.wide_oplog(s, d)).select("event_id", "action", "entity_id", "undo_payload")


@query(_UNDO + """SELECT row_number() OVER (ORDER BY event_id DESC) - 1 AS step, CASE action WHEN 'CREATE_NODE' THEN 'DELETE_NODE' WHEN 'DELETE_NODE' THEN 'CREATE_NODE' WHEN 'ADD_EDGE' THEN 'REMOVE_EDGE' WHEN 'REMOVE_EDGE' THEN 'ADD_EDGE' ELSE action END AS action, entity_id, undo_payload AS payload
FROM u WHERE event_id > 600 AND action <> 'RECORD_LINEAGE'""")
def oplog_inverse(s, d):
    return HI.inverse_events(HI.with_undo(A.wide_oplog(s, d)), 600)


@query(f"WITH log AS ({A.WIDE_OPLOG}), l AS (SELECT entity_id, max({{'e': event_id, 'a': action, 'p': payload}}) AS r FROM log WHERE action IN ('ADD_EDGE', 'REMOVE_EDGE') GROUP BY 1) SELECT entity_id, r.e AS event_id, r.p AS payload FROM l WHERE r.a = 'ADD_EDGE'")
def oplog_replay_edges(s, d):
    return HI.edges_at(A.wide_oplog(s, d))


@query(f"WITH log AS ({A.WIDE_OPLOG}), l AS (SELECT entity_id, max({{'e': event_id, 'p': payload}}) AS r FROM log WHERE action = 'RECORD_LINEAGE' GROUP BY 1) SELECT entity_id, r.e AS event_id, r.p AS payload FROM l")
def put_lineage(s, d):
    return HI.lineage_at(A.wide_oplog(s, d))


_COMMITS = f"""WITH m AS ({A.COMMITS}), c AS (SELECT row_number() OVER (ORDER BY t0 NULLS FIRST, universe_id, entity_id) AS event_id, universe_id, entity_id, sha256(payload) AS blob_hash, payload FROM m),
k AS (SELECT *, coalesce(lag(blob_hash) OVER (PARTITION BY universe_id ORDER BY event_id), '') AS undo_payload FROM c), h AS (SELECT universe_id, arg_max(blob_hash, event_id) AS head FROM k GROUP BY 1) """


def _commits(s, d):
    return HI.commit_manifests(A.commit_table(s, d))


@query(_COMMITS + "SELECT event_id, universe_id, entity_id, blob_hash, undo_payload FROM k")
def commit_manifest(s, d):
    return _commits(s, d).drop("payload")


@query(_COMMITS + "SELECT h.universe_id, head, payload FROM h JOIN (SELECT blob_hash, any_value(payload) AS payload FROM k GROUP BY 1) ON blob_hash = head")
def get_manifest(s, d):
    c = _commits(s, d)
    return HI.head_manifests(HI.heads_of(c), c)


@query(_COMMITS + "SELECT universe_id, arg_max(undo_payload, event_id) AS head, max(event_id) AS event_id, 'COMMIT_MANIFEST' AS action FROM k GROUP BY 1")
def undo_commit(s, d):
    return HI.undo_commit(_commits(s, d))


@query(_COMMITS + "SELECT universe_id, head, (SELECT max(event_id) FROM k) + row_number() OVER (ORDER BY universe_id) AS event_id, 'REVERT_MANIFEST' AS action FROM (SELECT universe_id, arg_max(undo_payload, event_id) AS head FROM k GROUP BY 1) WHERE head <> ''")
def undo_commit_ledger(s, d):
    return HI.undo_commit(_commits(s, d), ledger=True)


@query(_COMMITS + "SELECT universe_id, (SELECT min(blob_hash) FROM k) AS head, head AS undo_payload FROM h WHERE universe_id = 'main'")
def reset_head(s, d):
    """The main universe is set to the least blob of all."""
    c = _commits(s, d)
    return HI.reset_head(HI.heads_of(c), c, "main", c.agg(F.min("blob_hash")).first()[0][:40])


@query("""WITH e AS (SELECT DISTINCT split_part(entry_path, '/', 1) AS tree, entry_path AS path, entry_mode || ' ' || blob_hash || ' ' || entry_path AS line FROM git_trees WHERE entry_path IS NOT NULL AND entry_mode IS NOT NULL AND blob_hash IS NOT NULL),
t AS (SELECT tree, string_agg(line || chr(10), '' ORDER BY path, line) AS x FROM e GROUP BY 1) SELECT tree, sha1('tree ' || octet_length(encode(x)) || chr(0) || x) AS tree_hash FROM t""")
def git_tree_hash(s, d):
    """The entries of every top directory as one tree."""
    e = table(s, d, "git_trees").filter("entry_path is not null and entry_mode is not null and blob_hash is not null")
    return HI.git_tree_hashes(e.select(F.split("entry_path", "/")[0].alias("tree"), F.col("entry_mode").alias("mode"), "blob_hash", F.col("entry_path").alias("path")).distinct())


_WHO = "coalesce(author, '') || ' ' || CAST(CAST(floor(epoch(committed_at)) AS BIGINT) AS VARCHAR) || ' +0000' || chr(10)"


@query(f"""WITH c AS (SELECT DISTINCT commit_hash, 'tree ' || coalesce(tree_hash, '') || chr(10) || CASE WHEN coalesce(parent_hash, '') <> '' THEN 'parent ' || parent_hash || chr(10) ELSE '' END || 'author ' || {_WHO} || 'committer ' || {_WHO} || chr(10) || coalesce(message, '') || chr(10) AS x FROM git_commits WHERE committed_at IS NOT NULL)
SELECT commit_hash, sha1('commit ' || octet_length(encode(x)) || chr(0) || x) AS git_hash FROM c""")
def git_commit_hash(s, d):
    h = HI.git_commit_hash(*[F.col(c) for c in ("tree_hash", "parent_hash", "author", "message")], F.floor(F.unix_micros(F.col("committed_at").cast("timestamp")) / 1_000_000))
    return table(s, d, "git_commits").filter("committed_at is not null").select("commit_hash", h.alias("git_hash")).distinct()


@query(f"SELECT 'CONCURRENT_SYMBOL_MUTATION' AS conflict_type, 'ERROR' AS severity, name AS source_id, name AS target_id FROM ({RF.SQL['concurrent_mutation']}) UNION ALL SELECT breakage, 'ERROR', source_id, target_id FROM ({RF.SQL['contract_breakage']})")
def check_conflicts(s, d):
    a, b = (x.select(F.col("name").alias("node_id"), F.col("content_hash").alias("payload")) for x in A.deployed(s, d))
    return HI.check_conflicts(a, b, RF.contract_breakage(s, d))


@query(f"""WITH r AS (SELECT {A._N.format('change_id')} AS proposal_id, manifest_hash, author_did, order_index, deleted_at FROM stacked_proposals),
f AS (SELECT proposal_id, 0.40 AS c FROM r WHERE manifest_hash IS NULL UNION ALL SELECT proposal_id, 0.10 FROM r WHERE author_did IS NULL UNION ALL SELECT proposal_id, 0.25 FROM r WHERE order_index IS NULL UNION ALL SELECT proposal_id, 0.30 FROM r WHERE deleted_at IS NOT NULL),
g AS (SELECT proposal_id, count(*) AS n, sum(c) AS c FROM f GROUP BY 1), x AS (SELECT p.proposal_id, coalesce(n, 0) AS n_critiques, CAST(round(greatest(0, 1 - coalesce(c, 0)), 9) AS DOUBLE) AS fitness FROM (SELECT DISTINCT proposal_id FROM r) p LEFT JOIN g USING (proposal_id))
SELECT proposal_id, fitness, n_critiques, CASE WHEN n_critiques = 0 THEN 'APPROVE' WHEN fitness >= 0.5 THEN 'REQUEST_CHANGES' ELSE 'REJECT' END AS verdict FROM x""")
def critic_score(s, d):
    """Missing manifests stand for failed builds, missing authors for signatures, missing places for broken contracts, deletions for open rules."""
    p = table(s, d, "stacked_proposals").withColumn("proposal_id", norm_key("change_id"))
    kinds = F.array(F.when(F.col("manifest_hash").isNull(), "COMPILER_ERROR"), F.when(F.col("author_did").isNull(), "UNVERIFIED_SIGNATURE"), F.when(F.col("order_index").isNull(), "CONTRACT_DRIFT"), F.when(F.col("deleted_at").isNotNull(), "OPEN_INGRESS"))
    return HI.critic_score(p, p.select("proposal_id", F.explode(kinds).alias("kind")).filter("kind is not null"))


@query()
def proposal_states(s, d):
    """Fifty proposals, the events being their votes, revisions, comments and merges; see tests for the brute force."""
    verb = "CASE event_type WHEN 'signup' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'view' THEN 'revise' WHEN 'purchase' THEN CASE WHEN event_id % 97 = 0 THEN 'merge' ELSE 'approve' END ELSE 'comment' END"
    return HI.proposal_states(table(s, d, "events").selectExpr("concat('p', user_id % 50) AS proposal_id", "event_id AS seq", f"{verb} AS verb", "concat('a', user_id % 7) AS author"))
