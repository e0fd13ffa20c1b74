"""Proposals to merge, supersede, rename, archive or split records, and link suggestions from several signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.durable import checkpoint
from ledgerloom.operators.pages import name_key
from ledgerloom.operators.similarity import cosine_pairs, tfidf

#: Qualities and statuses of records to archive; phrases of contrast.
STALE_QUALITIES, STALE_STATUSES = ("stale", "outdated", "deprecated"), ("stale", "archived", "superseded", "retired")
CONTRAST = r"(?i)\b(?:in contrast|unlike|however|whereas|on the other hand|alternatively|but (?:not|unlike|instead)|differs? from|as opposed to|instead of)\b"
#: Fixed value: what contrast adds to friction.
CONTRAST_BONUS = 0.1


def duplicate_proposals(records: DataFrame, least: float) -> DataFrame:
    """``(a, b, kind, dims, similarity)`` of record pairs ``(id, text, scope, years, evidence)`` whose texts are similar enough.

    ``merge`` if scope, years and evidence are the same, ``supersede`` (``a`` the newer) if only the years differ and the
    latest years order the pair, else ``needs-review`` with the dimensions that differ. Null texts are in no pair.
    """
    pairs = cosine_pairs(tfidf(records.where("text IS NOT NULL").select("id", "text")), least)
    side = lambda c: records.select(F.col("id").alias(c), F.struct("scope", "years", "evidence").alias(f"r{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    differ = lambda f: ~F.col(f"ra.{f}").eqNullSafe(F.col(f"rb.{f}"))
    dims = F.array_join(F.filter(F.array(*(F.when(differ(f), F.lit(n)) for f, n in (("scope", "scope"), ("years", "time"), ("evidence", "evidence")))), lambda x: x.isNotNull()), ",")
    ya, yb = F.array_max("ra.years"), F.array_max("rb.years")
    ordered = (dims == "time") & F.coalesce(ya != yb, F.lit(False))
    kind = F.when(dims == "", "merge").when(ordered, "supersede").otherwise("needs-review")
    swap = ordered & (yb > ya)
    return met.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), kind.alias("kind"), dims.alias("dims"), F.col("cosine").alias("similarity"))


def rename_proposals(names: DataFrame) -> DataFrame:
    """``(alias, target)``: names ``(name)`` that differ in case, separators or a plural s only, each with the first of them."""
    n = names.where("name IS NOT NULL AND name <> ''").select("name").distinct().withColumn("k", name_key(F.col("name"))).where("k <> ''")
    return n.join(n.groupBy("k").agg(F.min("name").alias("target")), "k").where("name <> target").select(F.col("name").alias("alias"), "target")


def archive_proposals(records: DataFrame) -> DataFrame:
    """``(id, reasons)`` of records ``(id, quality, status)`` that are stale or superseded."""
    q, s = F.lower("quality"), F.lower("status")
    reasons = F.filter(F.array(F.when(q.isin(*STALE_QUALITIES), F.concat(F.lit("claim_quality="), q)), F.when(s.isin(*STALE_STATUSES), F.concat(F.lit("status="), s))), lambda x: x.isNotNull())
    return records.where("id IS NOT NULL").select("id", F.array_join(reasons, "; ").alias("reasons")).where("reasons <> ''").distinct()


def friction(similar: DataFrame, overlap: DataFrame, linked: DataFrame, contrasts: DataFrame, least: float) -> DataFrame:
    """``(a, b, friction)`` of unlinked pairs: cosine · (1 - overlap of sources), and a bonus where a text sets one against the other; ``least`` or more.

    ``similar`` is ``(a, b, cosine)`` down to ``least`` less the bonus, ``overlap`` ``(a, b, jaccard)``; pairs have the lesser name first.
    """
    met = similar.join(overlap.select("a", "b", "jaccard"), ["a", "b"], "left").join(contrasts.select("a", "b", F.lit(CONTRAST_BONUS).alias("bonus")).distinct(), ["a", "b"], "left").join(linked.select("a", "b"), ["a", "b"], "left_anti")
    total = F.col("cosine") * (1 - F.coalesce("jaccard", F.lit(0.0))) + F.coalesce("bonus", F.lit(0.0))
    return met.select("a", "b", F.round(total, 6).alias("friction")).where(F.col("friction") >= least)


def hub_pairs(scores: DataFrame, linked: DataFrame, share: float = 0.33, limit: int = 50) -> DataFrame:
    """``(a, b, score)``: the ``limit`` unlinked pairs with the greatest product of scores among the ``share`` of nodes ``(node, score)`` that score highest; ties by name.

    Only the first r nodes are paired, in one row; r doubles until no pair with a later node can beat the last
    pair found, so that the pairs of all nodes are never made.
    """
    total = scores.count()
    k, r = max(1, int(total * share)), 2
    while r < limit:
        r *= 2
    while True:
        top = scores.orderBy(F.desc("score"), "node").limit(min(r, k) + 1).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "node"))).alias("t"))
        held = F.slice("t", 1, min(r, k))
        both = F.flatten(F.transform(held, lambda x: F.transform(F.filter(held, lambda y: y["node"] > x["node"]), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b"), F.round(x["s"] * y["s"], 6).alias("score")))))
        found = checkpoint(top.select(F.explode(both).alias("p")).select("p.*").join(linked.select("a", "b"), ["a", "b"], "left_anti").orderBy(F.desc("score"), "a", "b").limit(limit))
        ends = top.select(F.get("t", F.lit(0))["s"].alias("first"), F.get("t", F.lit(r))["s"].alias("next")).first()
        full = found.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
        if r >= k or (full.n == limit and full.least > round(ends.first * (ends.next or 0.0), 6)):
            return found
        r *= 2


def merged_signals(signals: dict[str, DataFrame], limit: int) -> DataFrame:
    """``(a, b, n_signals, best, approaches)``: the best ``limit`` pairs ``(a, b, score)`` of every approach, merged; pairs that several approaches name come first by count."""
    parts = [df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("score").cast("double").alias("score")).orderBy(F.desc("score"), "a", "b").limit(limit).select(F.lit(name).alias("approach"), "a", "b", "score") for name, df in signals.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("a", "b").agg(F.count_distinct("approach").alias("n_signals"), F.max("score").alias("best"), F.array_join(F.array_sort(F.collect_set("approach")), ",").alias("approaches"))


def contrast_pairs(records: DataFrame) -> DataFrame:
    """``(a, b)``: names a record ``(name, text, others)`` is linked with where its text uses a phrase of contrast."""
    said = records.where(F.col("text").rlike(CONTRAST)).select("name", F.explode("others").alias("other")).where("name <> other")
    return said.select(F.least("name", "other").alias("a"), F.greatest("name", "other").alias("b")).distinct()
