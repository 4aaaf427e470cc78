"""Proposals, stacks and offline logs: folds of their events, rebasing, reconciling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions.common import latest_row, norm_key, ranked


def fold(events: DataFrame, key: str, at: list[str], title: str) -> DataFrame:
    """key, n_revisions, n_authors, first_at, title: each proposal's events folded, the newest title counting."""
    return events.groupBy(key).agg(F.count("*").alias("n_revisions"), F.countDistinct("author").alias("n_authors"), F.min(at[0]).alias("first_at"), F.max_by(title, F.struct(*at)).alias("title"))


def evolve(descendants: DataFrame, universe_of: DataFrame, components: DataFrame) -> DataFrame:
    """universe_id, component_id of every changed branch: a trigger's components merged into each of its descendants' universes.

    descendants: root, change_id; universe_of: change_id, universe_id; components: universe_id, component_id. As in the source's rebasing, every
    level takes the trigger's universe, not its direct parent's. Merging is a union, so repeated ones change nothing.
    """
    own = universe_of.select("change_id", F.col("universe_id").alias("to"))
    pairs = descendants.join(own, "change_id").join(universe_of.select(F.col("change_id").alias("root"), F.col("universe_id").alias("from")), "root").select("from", "to").distinct().filter("from <> to")
    given = pairs.join(components.withColumnRenamed("universe_id", "from"), "from").select(F.col("to").alias("universe_id"), "component_id")
    kept = components.join(pairs.select(F.col("to").alias("universe_id")).distinct(), "universe_id", "left_semi")
    return kept.select("universe_id", "component_id").unionByName(given).distinct()


def stack_order(proposals: DataFrame) -> DataFrame:
    """change_id, order_index, pos: every change, its latest row counting, with its 0-based place by order_index, created_at, change_id (nulls first)."""
    p = proposals.select(norm_key("change_id").alias("change_id"), "updated_at", "ingested_at", "order_index", norm_key("parent_change_id").alias("p"), "created_at").filter("change_id <> ''")
    one = latest_row(p, ["change_id"], ["updated_at", "ingested_at"], ["updated_at", "ingested_at", "order_index", "p", "created_at"]).withColumn("_g", F.lit(0))
    return ranked(one, ["_g"], ["order_index", "created_at", "change_id"]).select("change_id", "order_index", "pos")


def reconcile(a: DataFrame, b: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """key, value, conflict: two offline logs, the last write of both wins; a key that both wrote with other last values is a conflict."""
    last = lambda d, p: d.groupBy(key).agg(F.max(F.struct(*order, value)).alias(p))
    j = last(a, "x").join(last(b, "y"), key, "full_outer")
    won = F.greatest("x", "y")
    return j.select(key, won[value].alias(value), (F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.col(f"x.{value}").eqNullSafe(F.col(f"y.{value}"))).alias("conflict"))


def next_status(status: str, verb: str) -> str:
    """A proposal's status after a verb; MERGED and CLOSED are final."""
    if status in ("MERGED", "CLOSED"):
        return status
    return {"approve": "APPROVED", "request_changes": "CHANGES_REQUESTED", "merge": "MERGED", "close": "CLOSED", "revise": "OPEN"}.get(verb, status)
