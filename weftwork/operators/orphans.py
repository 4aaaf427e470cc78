"""References to records that do not exist, or did not when the reference arrived.

A key is read as a stem and an integer: the number its final digits spell. Sorted integers of the parents' keys are compressed
to contiguous runs, one row a run. A reference is matched as of its integer to the last run that starts at or
before it, and is an orphan where there is none or where it lies beyond that run's end. References inside a run are
matched once more, as of their arrival, to what their target's rows say about that time.

Both matches sort rows over range partitions and carry the last value over partition borders, so all references to one key,
whatever their share and however they crowd in time, are spread over as many tasks as they fill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.functions.common import carried, in_order, norm_key, ranked, staged, trim_white
from weftwork.operators.hierarchy import NO_PARENT

FOREVER = "9999-12-31 00:00:00"
ALWAYS = "0001-01-01 00:00:00"


#: Final digits read as the integer: what a bigint surely holds. Digits before them belong to the stem.
DIGITS = 18


def integer_key(key: Column) -> tuple[Column, Column]:
    """(stem, n) of a key, in both directions one to one: the stem holds what stands before the final digits and how many they are, so 07 is not 7."""
    digits = F.regexp_extract(key, rf"([0-9]{{0,{DIGITS}}})$", 1)
    n = F.char_length(digits)
    return F.concat(F.substr(key, F.lit(1), F.char_length(key) - n), F.lit("#"), n.cast("string")), F.coalesce(digits.try_cast("bigint"), F.lit(-1).cast("bigint"))


def key_runs(parents: DataFrame) -> DataFrame:
    """domain, stem, run_start, run_end, n_keys: the contiguous runs of the parents' integer keys, one row a run.

    ``parents`` has domain and key; repeated keys count once, null keys not at all. Within a run an integer and its rank rise together, so
    their difference names the run, also across the borders of range partitions.
    """
    stem, n = integer_key(F.col("key"))
    keys = parents.filter("key is not null").select("domain", stem.alias("stem"), n.alias("n")).distinct()
    return ranked(keys, ["domain", "stem"], ["n"], "rank").groupBy("domain", "stem", F.col("n") - F.col("rank")).agg(
        F.min("n").alias("run_start"), F.max("n").alias("run_end"), F.count("*").alias("n_keys")).select("domain", "stem", "run_start", "run_end", "n_keys")


def outside_runs(refs: DataFrame, runs: DataFrame) -> DataFrame:
    """``refs`` (domain, key and any other columns but _ ones) with ``missing``: no run starts at or before the key, or the last that does ends before it."""
    stem, n = integer_key(F.col("key"))
    held = [c for c in refs.columns if c != "domain"]
    rows = (refs.select("domain", stem.alias("_stem"), n.alias("_n"), F.lit(1).alias("_o"), F.xxhash64(*held).alias("_salt"), F.lit(None).cast("bigint").alias("_end"), *held)
            .unionByName(runs.select("domain", F.col("stem").alias("_stem"), F.col("run_start").alias("_n"), F.lit(0).alias("_o"), F.lit(0).cast("bigint").alias("_salt"), F.col("run_end").alias("_end")), allowMissingColumns=True))
    order = ["_n", "_o", "_salt"]
    at = carried(in_order(rows, ["domain", "_stem", *order]), ["domain", "_stem"], order, {"_run_end": ("last", "_end", True)})
    return at.filter("_o = 1").select(*refs.columns, (F.col("_run_end").isNull() | (F.col("_n") > F.col("_run_end"))).alias("missing"))


def orphan_references(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows of ``refs`` whose target was not there at ``at``.

    refs: record_table, record_key, ref_field, domain, key, at; targets: domain, key, since, until (null: never deleted).
    A repeated reference counts once, at its earliest arrival. Null keys are no references. A null ``at`` never
    finds a target. ``reason`` is never_came, came_later or deleted. Empty tables give their natural results.
    """
    one = refs.filter(F.col("key").isNotNull()).groupBy("record_table", "record_key", "ref_field", "domain", "key").agg(F.min("at").alias("at"))
    there = targets.filter(F.col("key").isNotNull()).select("domain", "key", "since", F.coalesce("until", F.to_timestamp(F.lit(FOREVER))).alias("until"))
    tagged = staged(outside_runs(one, key_runs(there)))
    held = ["record_table", "record_key", "ref_field", "key", "at"]
    never = tagged.filter("missing").select(*held, F.lit("never_came").alias("reason"))
    check = tagged.filter("not missing")
    # what a target's rows say from a time on: until when it is there
    spans = there.filter("since is not null").groupBy("domain", "key", "since").agg(F.max("until").alias("_until"))
    lines = (check.select("domain", *held, F.lit(1).alias("_o"), F.xxhash64("record_table", "record_key", "ref_field").alias("_salt"))
             .unionByName(spans.select("domain", "key", F.col("since").alias("at"), F.lit(0).alias("_o"), F.lit(0).cast("bigint").alias("_salt"), "_until"), allowMissingColumns=True))
    order = ["at", "_o", "_salt"]  # a null arrival sorts before every row of its key, and so finds none
    got = carried(in_order(lines, ["domain", "key", *order]), ["domain", "key"], order, {"_last": ("max", "_until", True)}).filter("_o = 1")
    late = got.filter(F.col("_last").isNull() | (F.col("_last") <= F.col("at"))).select(*held, F.when(F.col("_last").isNull(), "came_later").otherwise("deleted").alias("reason"))
    return never.unionByName(late).withColumnRenamed("key", "ref_key")


def call_name(c):
    """A called method's name: trimmed, without a final ()."""
    return trim_white(F.regexp_replace(trim_white(c), r"\(\)$", ""))


def domain_references(functions: DataFrame, proposals: DataFrame, commits: DataFrame) -> DataFrame:
    """Every reference of the three tables in the form orphan_references takes."""
    calls = (functions.filter("language = 'java'").select(F.col("function_id").cast("string").alias("record_key"), "ingested_at", F.explode("called_methods").alias("_c"))
             .select(F.lit("code_functions").alias("record_table"), "record_key", F.lit("called_methods").alias("ref_field"), F.lit("method").alias("domain"), call_name("_c").alias("key"), F.col("ingested_at").alias("at"))
             .filter(~F.lower("key").isin(*NO_PARENT)))
    def ref(df, tab, key, field, col, domain):
        k = norm_key(col) if domain != "universe" else F.col(col)
        return df.filter(~norm_key(col).isin(*NO_PARENT)).select(F.lit(tab).alias("record_table"), norm_key(key).alias("record_key"), F.lit(field).alias("ref_field"), F.lit(domain).alias("domain"), k.alias("key"), F.col("ingested_at").alias("at"))

    return (calls.unionByName(ref(proposals, "stacked_proposals", "change_id", "parent_change_id", "parent_change_id", "change"))
            .unionByName(ref(proposals, "stacked_proposals", "change_id", "universe_id", "universe_id", "universe"))
            .unionByName(ref(commits, "git_commits", "commit_hash", "tree_hash", "tree_hash", "tree")))


def domain_targets(functions: DataFrame, library: DataFrame, proposals: DataFrame, heads: DataFrame, trees: DataFrame) -> DataFrame:
    def tgt(df, domain, key):
        return df.select(F.lit(domain).alias("domain"), key.alias("key"), F.col("ingested_at").alias("since"), F.col("deleted_at").alias("until"))
    always = library.select(F.lit("method").alias("domain"), F.col("identifier").alias("key"), F.to_timestamp(F.lit(ALWAYS)).alias("since"), F.lit(None).cast("timestamp").alias("until"))
    return (tgt(functions.filter("language = 'java'"), "method", F.col("identifier")).unionByName(always)
            .unionByName(tgt(proposals, "change", norm_key("change_id"))).unionByName(tgt(heads, "universe", F.col("universe_id")))
            .unionByName(tgt(trees, "tree", norm_key("tree_hash"))))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field and month of arrival."""
    return orphans.groupBy("record_table", "ref_field", F.date_format("at", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n_orphans"), F.count_if(F.col("reason") == "never_came").alias("n_never_came"),
        F.count_if(F.col("reason") == "came_later").alias("n_came_later"), F.count_if(F.col("reason") == "deleted").alias("n_deleted"))
