"""The append-only event log: history, replay and state as of an event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions.common import carried, cut, in_order, ranked


def events_from(log: DataFrame, start: int = 0, universe: str = "", limit: int = 0) -> DataFrame:
    """Events from an id on, optionally of one universe, the first ``limit`` in id order."""
    out = log.filter(F.col("event_id") >= start)
    if universe:
        out = out.filter(F.col("universe_id") == universe)
    return out.orderBy("event_id").limit(limit) if limit else out


def history(log: DataFrame, entity: str) -> DataFrame:
    return log.filter(F.col("entity_id") == entity)


def state_at(log: DataFrame, cutoff: int | None = None) -> DataFrame:
    """entity_id, event_id, payload of the nodes alive after all events up to ``cutoff``.

    Node events are folded by their last one per entity, which a single combined aggregate finds; commit
    and revert events carry no state. Undoing the last n events is this with a smaller cutoff.
    """
    nodes = log.filter(F.col("action").isin("CREATE_NODE", "UPDATE_NODE", "DELETE_NODE"))
    if cutoff is not None:
        nodes = nodes.filter(F.col("event_id") <= cutoff)
    last = nodes.groupBy("entity_id").agg(F.max(F.struct("event_id", "action", "payload")).alias("r"))
    return last.filter("r.action <> 'DELETE_NODE'").select("entity_id", "r.event_id", "r.payload")


def heads_at(log: DataFrame, cutoff: int | None = None) -> DataFrame:
    """universe_id, head: each universe's last head event."""
    h = log.filter("action in ('SET_UNIVERSE_HEAD', 'CREATE_UNIVERSE')")
    if cutoff is not None:
        h = h.filter(F.col("event_id") <= cutoff)
    return h.groupBy("universe_id").agg(F.max_by("payload", "event_id").alias("head"))


def undo(log: DataFrame, n: int) -> DataFrame:
    """The state after taking back the last n events of all universes together."""
    cut_at = log.select("event_id").orderBy(F.desc("event_id")).offset(n).limit(1).first()
    return state_at(log, cut_at[0] if cut_at else -1)


def commits(log: DataFrame, universe: str, limit: int = 20) -> DataFrame:
    """A universe's commits, newest first."""
    return log.filter(F.col("action").isin("COMMIT", "REVERT") & (F.col("universe_id") == universe)).orderBy(F.desc("event_id")).limit(limit)


def commit_parents(log: DataFrame) -> DataFrame:
    """event_id, universe_id, parent_event: each commit's predecessor in its universe."""
    c = in_order(log.filter("action = 'COMMIT'").select("event_id", "universe_id"), ["universe_id", "event_id"])
    return carried(c, ["universe_id"], ["event_id"], {"parent_event": ("last", "event_id", False)}).select("event_id", "universe_id", "parent_event")


def append(log: DataFrame, new: DataFrame, payload: list[str]) -> DataFrame:
    """New events with the next ids; ``new`` has ts_ms, universe_id, action, entity_id and the payload's columns. Order: ts_ms, entity_id."""
    last = log.agg(F.coalesce(F.max("event_id"), F.lit(-1))).first()[0]
    rows = ranked(new.withColumn("_g", F.lit(0)), ["_g"], ["ts_ms", "entity_id", "action"])
    return rows.select((F.lit(last + 1) + F.col("pos")).alias("event_id"), "ts_ms", "universe_id", "action", "entity_id", F.to_json(F.struct(*payload)).alias("payload"))


def create_universe(heads: DataFrame, new: str, parent: str) -> DataFrame:
    """The row of a new branch with its parent's head; empty if the parent is missing or the branch exists."""
    p = heads.filter(F.col("universe_id") == parent).select(F.lit(new).alias("universe_id"), "head", F.lit(parent).alias("parent_universe_id"))
    return p.join(heads.filter(F.col("universe_id") == new).select("universe_id"), "universe_id", "left_anti")


def move_head(heads: DataFrame, universe: str, head: str) -> DataFrame:
    return heads.withColumn("head", F.when(F.col("universe_id") == universe, F.lit(head)).otherwise(F.col("head")))


def revert_target(log: DataFrame, prefix: str) -> DataFrame:
    """event_id, parent_event of the newest commit whose payload hash begins with ``prefix``: what a revert would restore."""
    c = commit_parents(log).join(log.select("event_id", F.sha2("payload", 256).alias("h")), "event_id")
    return c.filter(F.startswith("h", F.lit(prefix))).orderBy(F.desc("event_id")).limit(1).select("event_id", "universe_id", "parent_event")


def climb(universes: DataFrame, commits: DataFrame) -> DataFrame:
    """universe_id, source_id: the nearest branch up the parents that has commits; null where none has. One join per level, finished branches rest.

    Chains may have any length. A branch met at the last round that was a power of two is remembered; a climb that returns to it runs in a loop and ends.
    """
    own = commits.select(F.col("universe_id").alias("_u")).distinct()
    parents = universes.select(F.col("universe_id").alias("_k"), F.col("parent_universe_id").alias("_p"))
    live = cut(universes.select("universe_id", F.col("universe_id").alias("at"), F.lit(None).cast("string").alias("mark")))
    done, n = None, 0
    while done is None or not live.isEmpty():
        n += 1
        tagged = cut(live.join(own, live.at == own._u, "left"))
        hit = tagged.filter("_u is not null").select("universe_id", F.col("at").alias("source_id"))
        done = hit if done is None else done.unionByName(hit)
        rest = tagged.filter("_u is null").drop("_u")
        mark = F.col("at") if n & (n - 1) == 0 else F.col("mark")
        live = cut(rest.join(parents, rest["at"] == parents._k).select("universe_id", F.col("_p").alias("at"), mark.alias("mark")).filter("at is not null and at <> mark"))
    return universes.select("universe_id").join(done, "universe_id", "left")
