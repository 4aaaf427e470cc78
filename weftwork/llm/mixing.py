"""Mixing sources to target weights.

Every source's budget is its share of the largest total that no cap forbids. A budget is met by complete
epochs first; the rest is an Efraimidis-Spirakis sample: keys -ln(u) / weight, ascending, until the token budget is
reached. The order within a source is never built in one task: keys fall into buckets that keep their order,
bucket sums are prefix-summed, and only the bucket that holds the budget's end is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftwork.functions.common import staged, trim_white
from weftwork.llm.tokens import VOCABULARY, token_counts

BUCKETS = 65_536


def source_name(c: Column | str) -> Column:
    """Sources compare trimmed, in lower case and with underscores for hyphens."""
    return F.regexp_replace(F.lower(trim_white(c)), "-", "_")


def default_weight(text: Column) -> Column:
    """A document's weight where the caller gives none, between 0.1 and 1: the share of letters among its characters that are not blank. No judgement of quality: tables and code weigh least."""
    solid = F.char_length(F.regexp_replace(text, r"\s+", ""))
    letters = F.char_length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.lit(0.1) + F.lit(0.9) * F.when(solid > 0, letters / solid).otherwise(0.0)


def _ranges(keyed: DataFrame, state: DataFrame) -> DataFrame:
    """source_name, lo, lo_doc, hi, hi_doc, most: what each budget takes, as prefixes in key order from lo to hi, one a round, of documents of up to ``most`` tokens.

    ``state`` has source_name, left, lo, lo_doc. A round sums tokens by bucket, finds the bucket in which the sum passes the budget, and in that
    bucket the document that passes it; the next round begins behind it with what is left, until no document behind it fits.
    """
    out = None
    while True:
        state = staged(state)
        cand = keyed.join(state, "source_name").filter((F.col("n_tokens") <= F.col("left")) & (F.struct("key", "doc_id") > F.struct("lo", "lo_doc")))
        sums = cand.groupBy("source_name", "bucket").agg(F.sum("n_tokens").alias("t"), F.first("left").alias("left"))
        by = W.partitionBy("source_name").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # at most BUCKETS rows a source
        edge = sums.withColumn("before", F.coalesce(F.sum("t").over(by), F.lit(0))).filter("before <= left and before + t > left").select("source_name", "bucket", "before")
        run = F.col("before") + F.sum("n_tokens").over(W.partitionBy("source_name").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0))
        over = cand.join(edge, ["source_name", "bucket"]).withColumn("run", run).filter("run > left")
        cuts = over.groupBy("source_name").agg(F.min(F.struct("key", "doc_id", "run", "n_tokens")).alias("c"))
        took = staged(state.join(cuts, "source_name", "left"))
        one = took.select("source_name", "lo", "lo_doc", F.coalesce("c.key", F.lit(float("inf"))).alias("hi"), F.coalesce("c.doc_id", F.lit(0)).alias("hi_doc"), F.col("left").alias("most"))
        out = one if out is None else out.unionByName(one)
        left = F.col("left") - (F.col("c.run") - F.col("c.n_tokens"))
        state = took.filter(F.col("c").isNotNull() & (left >= 1)).select("source_name", left.alias("left"), F.col("c.key").alias("lo"), F.col("c.doc_id").alias("lo_doc"))
        if state.isEmpty():
            return out


def mix(docs: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, seed: int = 17, vocabulary: str = VOCABULARY,
        weight: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares): doc_id, source_name, n_tokens, repeats; and per source what was reached.

    ``docs`` has unique doc_id, text and source, ``targets`` source_name, target_share and max_repeats, one row a source (of several the largest counts).
    The total is ``total_tokens``, or all tokens of the named sources where that is unset, lowered until every
    source can give its share within its cap; targets without any document cannot count and are reported with 0.
    A document that would overrun its budget is passed over; the documents behind it that still fit follow, until none does.
    Documents of unnamed or null source and of no tokens are not chosen. ``weight`` is any column of ``docs``; where it is null, not a number
    or not above 0 a document keeps a weight of 1e-9 and so comes after all others, but is not lost. Ties of keys fall to the lower doc_id.
    """
    goal = staged(targets.select(source_name("source_name").alias("source_name"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
                  .filter("source_name is not null").groupBy("source_name").agg(F.max(F.struct("target_share", "max_repeats")).alias("r")).select("source_name", "r.*"))
    w = default_weight(F.col("text")) if weight is None else weight
    named = docs.withColumn("_s", source_name("source")).join(goal.select(F.col("source_name").alias("_g")), F.col("_s") == F.col("_g"), "left_semi")
    facts = named.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("_s").alias("source_name"), w.cast("double").alias("w"))
    facts = facts.withColumn("w", F.when(F.col("w").isNotNull() & ~F.isnan("w") & (F.col("w") > 0), F.col("w")).otherwise(F.lit(1e-9)))  # of its own, so the weight is worked out once
    # two narrow passes over the texts: tokens in Python, weights in the JVM
    have = staged(facts.join(token_counts(named.select("doc_id", "text"), vocabulary=vocabulary), "doc_id").filter("n_tokens > 0"))
    live = staged(goal.filter("target_share > 0 and max_repeats > 0").join(have.groupBy("source_name").agg(F.sum("n_tokens").cast("double").alias("a")), "source_name"))
    share, everything = live.agg(F.coalesce(F.sum("target_share"), F.lit(1.0)), F.coalesce(F.sum("a"), F.lit(0.0))).first()
    most = live.agg(F.min(F.col("max_repeats") * F.col("a") * F.lit(share) / F.col("target_share"))).first()[0]
    total = min(float(everything if total_tokens is None else total_tokens), most) if most is not None else 0.0
    budget = F.lit(total) * F.col("target_share") / F.lit(share)
    epochs = F.least("max_repeats", F.floor(budget / F.col("a") + 1e-9).cast("int"))
    budgets = live.select("source_name", epochs.alias("epochs"), F.when(epochs < F.col("max_repeats"), F.greatest(F.lit(0.0), budget - epochs * F.col("a"))).otherwise(0.0).alias("rest"))
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = have.join(budgets, "source_name").withColumn("key", -F.log(u) / F.col("w"))
    keyed = staged(keyed.withColumn("bucket", F.floor(F.lit(BUCKETS) * F.col("key") / (1 + F.col("key"))).cast("int")).select("doc_id", "source_name", "n_tokens", "epochs", "key", "bucket"))
    start = budgets.filter("rest > 0").select("source_name", F.col("rest").alias("left"), F.lit(-1.0).alias("lo"), F.lit(-1).cast("bigint").alias("lo_doc"))
    at = F.struct("key", "doc_id")
    inside = keyed.join(_ranges(keyed, start), "source_name").filter((F.col("n_tokens") <= F.col("most")) & (at > F.struct("lo", "lo_doc")) & (at < F.struct("hi", "hi_doc"))).select("doc_id", F.lit(1).alias("extra"))
    chosen = keyed.join(inside, "doc_id", "left").withColumn("repeats", F.col("epochs") + F.coalesce("extra", F.lit(0))).filter("repeats > 0").select("doc_id", "source_name", "n_tokens", "repeats")
    chosen = staged(chosen)
    reached = staged(chosen.groupBy("source_name").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("n_docs"), F.max("repeats").alias("most_repeats")))
    everything = reached.agg(F.sum("tokens")).first()[0] or 1
    shares = (goal.join(reached, "source_name", "left")
              .select("source_name", "target_share", F.coalesce(F.col("tokens") / F.lit(everything), F.lit(0.0)).alias("actual_share"),
                      F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "max_repeats", F.coalesce("most_repeats", F.lit(0)).alias("most_repeats")))
    return chosen, shares
