"""Commits, undo and inverse events over the append-only log, and reviews of what they change.

A commit log has event_id, universe_id, action, entity_id, payload, undo_payload. What an event takes back is the last value its entity
had before; it is carried along the log's order over range partitions, so no entity's log meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.functions.common import carried, in_order

#: Actions of the log, by what they are about.
NODE_ACTIONS = ("CREATE_NODE", "UPDATE_NODE", "DELETE_NODE")
EDGE_ACTIONS = ("ADD_EDGE", "REMOVE_EDGE")
COMMIT_ACTIONS = ("COMMIT_MANIFEST", "REVERT_MANIFEST")


def with_undo(log: DataFrame) -> DataFrame:
    """The log with undo_payload: for edges the edge itself, for a created node its id, else the entity's payload before (null where there was none)."""
    at = carried(in_order(log, ["entity_id", "event_id"]), ["entity_id"], ["event_id"], {"_was": ("last", "payload", False)})
    undo = F.when(F.col("action").isin(*EDGE_ACTIONS), F.col("payload")).when(F.col("action") == "CREATE_NODE", F.to_json(F.struct(F.col("entity_id").alias("node_id")))).otherwise(F.col("_was"))
    return at.select(*log.columns, undo.alias("undo_payload"))


#: What takes an action back.
INVERSE = {"CREATE_NODE": "DELETE_NODE", "DELETE_NODE": "CREATE_NODE", "UPDATE_NODE": "UPDATE_NODE", "ADD_EDGE": "REMOVE_EDGE", "REMOVE_EDGE": "ADD_EDGE", "SET_UNIVERSE_HEAD": "SET_UNIVERSE_HEAD"}


def inverse_events(log: DataFrame, last: int) -> DataFrame:
    """step, action, entity_id, payload: the events that take back all events of ids above ``last``, newest first; actions without an inverse are left out.

    ``log`` has undo_payload (see with_undo); an update or head without a value before is taken back by a null payload.
    """
    names = F.create_map(*[F.lit(x) for kv in INVERSE.items() for x in kv])
    back = log.filter((F.col("event_id") > last) & F.col("action").isin(*INVERSE)).select((-F.col("event_id")).alias("_n"), names[F.col("action")].alias("action"), "entity_id", F.col("undo_payload").alias("payload")).withColumn("_one", F.lit(1).cast("bigint"))
    return carried(in_order(back, ["_n"]), [], ["_n"], {"_pos": ("sum", "_one", False)}).select(F.coalesce("_pos", F.lit(0)).alias("step"), "action", "entity_id", "payload")


def edges_at(log: DataFrame, cutoff: int | None = None) -> DataFrame:
    """entity_id, event_id, payload of the edges that stand after all events up to ``cutoff``."""
    e = log.filter(F.col("action").isin(*EDGE_ACTIONS))
    e = e if cutoff is None else e.filter(F.col("event_id") <= cutoff)
    return e.groupBy("entity_id").agg(F.max(F.struct("event_id", "action", "payload")).alias("r")).filter("r.action = 'ADD_EDGE'").select("entity_id", "r.event_id", "r.payload")


def lineage_at(log: DataFrame, cutoff: int | None = None) -> DataFrame:
    """entity_id, event_id, payload of the provenance recorded up to ``cutoff``; a repeated record's last write counts."""
    e = log.filter("action = 'RECORD_LINEAGE'")
    e = e if cutoff is None else e.filter(F.col("event_id") <= cutoff)
    return e.groupBy("entity_id").agg(F.max(F.struct("event_id", "payload")).alias("r")).select("entity_id", "r.event_id", "r.payload")


# ---- manifests -----------------------------------------------------------------------------------------------------

def commit_manifests(manifests: DataFrame) -> DataFrame:
    """event_id, universe_id, entity_id, blob_hash, payload, undo_payload: a commit event for every manifest, in order of at, universe_id, entity_id.

    ``manifests`` has universe_id, at, entity_id (the manifest's identity) and payload (its JSON). blob_hash is the payload's SHA-256, under which it is
    stored; undo_payload is the universe's head before the commit, empty for its first.
    """
    m = manifests.select("universe_id", "at", "entity_id", "payload", F.sha2("payload", 256).alias("blob_hash")).withColumn("_one", F.lit(1).cast("bigint"))
    order = ["at", "universe_id", "entity_id"]
    ids = carried(in_order(m, order), [], order, {"_pos": ("sum", "_one", False)}).drop("_p").withColumn("event_id", F.coalesce("_pos", F.lit(0)) + 1)
    own = carried(in_order(ids, ["universe_id", "event_id"]), ["universe_id"], ["event_id"], {"_head": ("last", "blob_hash", False)})
    return own.select("event_id", "universe_id", "entity_id", "blob_hash", "payload", F.coalesce("_head", F.lit("")).alias("undo_payload"))


def heads_of(commits: DataFrame) -> DataFrame:
    """universe_id, head: the blob each universe's last commit stored."""
    return commits.groupBy("universe_id").agg(F.max_by("blob_hash", "event_id").alias("head"))


def head_manifests(heads: DataFrame, commits: DataFrame) -> DataFrame:
    """universe_id, head, payload: the manifest each head names; universes whose blob is missing give no row."""
    blobs = commits.groupBy(F.col("blob_hash").alias("head")).agg(F.any_value("payload").alias("payload"))
    return heads.join(blobs, "head").select("universe_id", "head", "payload")


def undo_commit(commits: DataFrame, ledger: bool = False) -> DataFrame:
    """universe_id, head, event_id, action after each universe's last commit is undone.

    The head becomes what the commit's undo payload names, empty behind a first commit. In ledger mode nothing is taken away: a revert event with the next
    id restores the head before, and a first commit cannot be undone, so its universe gives no row.
    """
    last = commits.groupBy("universe_id").agg(F.max(F.struct("event_id", "undo_payload")).alias("r"))
    if not ledger:
        return last.select("universe_id", F.col("r.undo_payload").alias("head"), "r.event_id", F.lit("COMMIT_MANIFEST").alias("action"))
    top = commits.agg(F.max("event_id")).first()[0] or 0
    some = last.filter("r.undo_payload <> ''").select("universe_id", F.col("r.undo_payload").alias("head")).withColumn("_one", F.lit(1).cast("bigint"))
    return carried(in_order(some, ["universe_id"]), [], ["universe_id"], {"_pos": ("sum", "_one", True)}).select("universe_id", "head", (F.lit(top) + F.col("_pos")).alias("event_id"), F.lit("REVERT_MANIFEST").alias("action"))


def reset_head(heads: DataFrame, commits: DataFrame, universe: str, prefix: str) -> DataFrame:
    """universe_id, head, undo_payload of one universe set to the only stored blob whose hash begins with ``prefix``; empty where none or several do."""
    lo, hi = commits.filter(F.startswith("blob_hash", F.lit(prefix))).agg(F.min("blob_hash"), F.max("blob_hash")).first()
    one = heads.filter((F.col("universe_id") == universe) & F.lit(lo is not None and lo == hi))
    return one.select("universe_id", F.lit(lo).cast("string").alias("head"), F.col("head").alias("undo_payload"))


# ---- reviews -------------------------------------------------------------------------------------------------------

def check_conflicts(symbols_a: DataFrame, symbols_b: DataFrame, breakages: DataFrame) -> DataFrame:
    """conflict_type, severity, source_id, target_id: symbols both branches hold with other payloads, and broken contracts of either branch.

    Symbols have node_id and payload; breakages source_id, target_id and breakage. Every conflict is an error.
    """
    both = symbols_a.select("node_id", F.col("payload").alias("_a")).join(symbols_b.select("node_id", F.col("payload").alias("_b")), "node_id").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    one = both.select(F.lit("CONCURRENT_SYMBOL_MUTATION").alias("conflict_type"), F.col("node_id").alias("source_id"), F.col("node_id").alias("target_id"))
    return one.unionByName(breakages.select(F.col("breakage").alias("conflict_type"), "source_id", "target_id")).select("conflict_type", F.lit("ERROR").alias("severity"), "source_id", "target_id")


#: What each kind of finding takes off a proposal's fitness.
CRITIQUES = {"CONTRACT_DRIFT": 0.25, "OPEN_INGRESS": 0.30, "PRIMITIVE_ROLE": 0.25, "COMPILER_ERROR": 0.40, "UNVERIFIED_SIGNATURE": 0.10}


def critic_score(proposals: DataFrame, findings: DataFrame) -> DataFrame:
    """proposal_id, fitness, n_critiques, verdict of every proposal; ``findings`` has proposal_id and kind (CRITIQUES), one row each.

    fitness is 1 less the findings' weights, 0 at least. APPROVE needs no finding, REQUEST_CHANGES a fitness of 0.5.
    """
    cost = F.create_map(*[F.lit(x) for kv in CRITIQUES.items() for x in kv])
    f = findings.filter(F.col("kind").isin(*CRITIQUES)).groupBy("proposal_id").agg(F.count("*").alias("n"), F.sum(cost[F.col("kind")]).alias("c"))
    n, fit = F.coalesce("n", F.lit(0)), F.round(F.greatest(F.lit(0.0), 1 - F.coalesce("c", F.lit(0.0))), 9)
    return proposals.select("proposal_id").distinct().join(f, "proposal_id", "left").select("proposal_id", fit.alias("fitness"), n.alias("n_critiques"), F.when(n == 0, "APPROVE").when(fit >= 0.5, "REQUEST_CHANGES").otherwise("REJECT").alias("verdict"))


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, status, votes, clock, n = None, "OPEN", {}, 0, 0
    for b in batches:
        out: list[tuple] = []
        for k, at, verb, who in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if k != key:
                key, status, votes, clock, n = k, "OPEN", {}, 1, 1
            if status != "MERGED":
                clock += 1
                if verb in ("approve", "reject"):
                    votes[who] = verb == "approve"
                    if verb == "reject":
                        status = "CHANGES_REQUESTED"
                    elif all(votes.values()):
                        status = "APPROVED"
                elif verb == "revise":
                    n += 1
                    status = "UNDER_REVIEW" if status == "CHANGES_REQUESTED" else status
                elif verb == "merge":
                    status = "MERGED"
            out.append((k, at, status, clock, n))
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32()), strict=True)], names=["proposal_id", "seq", "status", "clock", "n_revisions"])


def proposal_states(log: DataFrame) -> DataFrame:
    """proposal_id, seq, status, clock, n_revisions after every event of ``log`` (proposal_id, seq, verb, author): approve, reject, revise, comment, merge.

    A rejection asks for changes until every reviewer's last vote approves; a revision puts such a proposal under review again. Every event moves the clock on,
    which a new proposal starts at 1; a merged proposal takes no more events. A task streams its sorted proposals and holds one vote a reviewer.
    """
    one = log.select("proposal_id", F.col("seq").cast("bigint").alias("seq"), "verb", "author").repartition("proposal_id").sortWithinPartitions("proposal_id", "seq", "author", "verb")
    return one.mapInArrow(_states, "proposal_id string, seq bigint, status string, clock bigint, n_revisions int")


# ---- digests over sorted rows ----------------------------------------------------------------------------------------

def _digest(algorithm: str, separator: bytes):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h, first, done = None, None, True, []
        for b in batches:
            for k, head, piece in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if h is None or k != key:
                    if h is not None:
                        done.append((key, h.hexdigest()))
                    key, h, first = k, hashlib.new(algorithm, usedforsecurity=False), True
                    h.update(head)
                h.update(piece if first else separator + piece)
                first = False
            if len(done) > 10_000:
                yield _digests(done)
                done = []
        if h is not None:
            done.append((key, h.hexdigest()))
        yield _digests(done)

    return go


def _digests(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["k", "digest"])


def ordered_digest(df: DataFrame, group: Column, order: list[Column], piece: Column, algorithm: str, *, header: str | None = None, separator: str = "") -> DataFrame:
    """k, digest of each group's pieces in order, with ``header`` (its {} filled with their bytes) in front.

    The bytes are hashed as a sorted stream, so a group of any size costs a task time but no memory. A hash of a sequence can't be made in parallel.
    """
    rows = df.select(group.cast("string").alias("k"), *[c.alias(f"o{i}") for i, c in enumerate(order)], F.encode(piece, "utf-8").alias("piece")).filter("piece is not null")
    head = F.lit("")
    if header is not None:
        size = rows.groupBy("k").agg(F.sum(F.length("piece")).alias("_n"), F.count("*").alias("_c"))
        a, z = header.split("{}")
        rows = rows.join(size, "k")
        head = F.concat(F.lit(a), (F.col("_n") + (F.col("_c") - 1) * len(separator.encode())).cast("string"), F.lit(z))
    by = ["k", *[f"o{i}" for i in range(len(order))]]
    return rows.withColumn("head", F.encode(head, "utf-8")).repartition("k").sortWithinPartitions(*by, "piece").select("k", "head", "piece").mapInArrow(_digest(algorithm, separator.encode()), "k string, digest string")


def git_tree_hashes(entries: DataFrame) -> DataFrame:
    """tree, tree_hash of synthetic git trees: ``entries`` has tree, mode, blob_hash, path; lines "mode hash path" in path order, hashed as a git object."""
    line = F.concat_ws(" ", "mode", "blob_hash", "path")
    return ordered_digest(entries, F.col("tree"), [F.col("path")], F.concat(line, F.lit("\n")), "sha1", header="tree {}\0").select(F.col("k").alias("tree"), F.col("digest").alias("tree_hash"))


def git_commit_hash(tree: Column, parent: Column, author: Column, message: Column, seconds: Column) -> Column:
    """SHA-1 of a synthetic git commit; an empty or null parent has no line."""
    e = lambda c: F.coalesce(c, F.lit(""))
    who = F.concat(e(author), F.lit(" "), seconds.cast("bigint").cast("string"), F.lit(" +0000\n"))
    text = F.concat(F.lit("tree "), e(tree), F.lit("\n"), F.when(e(parent) != "", F.concat(F.lit("parent "), parent, F.lit("\n"))).otherwise(""), F.lit("author "), who, F.lit("committer "), who, F.lit("\n"), e(message), F.lit("\n"))
    return F.sha1(F.concat(F.lit("commit "), F.octet_length(text).cast("string"), F.lit("\0"), text))
