"""Quotes against source texts, expected facts in texts, grades of answers and the figures of retrieval set-ups."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerloom.functions.skew import salted_join

#: Least length of a quoted fragment; share of a fact's words that must be found; share of facts an answer must hold.
LEAST, SHARE, COVERAGE = 8, 0.55, 0.5
#: Typographic marks and their plain forms.
SMART, PLAIN = "‘’‚‛“”„–—− ", "''''\"\"\"--- "
#: Words of four letters or more that carry no content.
STOP_WORDS = (
    "that", "this", "with", "from", "have", "been", "they", "when", "where", "about", "should", "because", "after", "before", "their", "which", "would", "could",
    "does", "also", "into", "than", "then", "note", "vault", "answer", "claim", "page", "what", "some", "more", "each", "only", "will", "such", "many", "most",
    "used", "using", "given", "over", "same", "very", "even", "make", "made", "need", "must", "well", "both", "just", "like", "here", "were", "these", "those", "them", "time",
)
#: What a text says that declines to answer, and what one says that is unsure.
ABSTAINS = ("insufficient evidence", "not answerable", "cannot answer", "can't answer", "cannot be answered", "no data", "does not contain", "not in the corpus", "not present in the corpus", "corpus does not", "unable to", "not documented", "not disclosed", "no such data")
UNSURE = ("dispute", "disputed", "unverified", "unresolved", "conflict", "contradic", "not independent", "caution", "however", "but ", "unclear", "not confirmed", "not proven", "cannot be confirmed", "retracted", "revoked", "self-benchmark", "vendor benchmark", "not independently", "weigh", "no firm date", "must be verified")
#: Minutes of review by tier of consequence, and for any other.
REVIEW, REVIEW_OTHER = {"exploratory": 1.0, "recommendation": 3.0, "decision": 8.0, "autonomous": 15.0}, 3.0
#: Tiers at which a leaked source counts as a false acceptance.
HIGH_TIERS = ("recommendation", "decision", "autonomous")


@F.pandas_udf(StringType())
def _composed(x: pd.Series) -> pd.Series:
    return x.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def folded_text(c: Column) -> Column:
    """Composed Unicode form, plain quotes and dashes, runs of blanks as one; case is kept. Only texts beyond ASCII leave the JVM."""
    composed = F.coalesce(_composed(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)
    return F.btrim(F.regexp_replace(F.translate(composed, SMART, PLAIN), r"[ \t\r\n\f\x0b]+", " "))


def quote_match(quote: Column, folded_quote: Column, text: Column, folded: Column) -> Column:
    """3 for a verbatim quote, 2 for one after folding, 1 where all its fragments around an ellipsis stand in order, 0 else.

    A folded quote of fewer than eight characters, or a fragment of as few, proves nothing.
    """
    fragments = F.filter(F.transform(F.split(folded_quote, r"…|\.\.\."), lambda f: F.btrim(f)), lambda f: f != "")
    place = lambda f, at: F.call_function("locate", f, folded, at)
    reached = F.aggregate(fragments, F.lit(1), lambda at, f: F.when((at > 0) & (place(f, at) > 0), place(f, at) + F.length(f)).otherwise(0))
    in_order = (F.size(fragments) >= 2) & F.forall(fragments, lambda f: F.length(f) >= LEAST) & (reached > 0)
    long = F.length(folded_quote) >= LEAST
    return F.when(F.contains(text, quote), 3).when(long & F.contains(folded, folded_quote), 2).when(long & in_order, 1).otherwise(0)


def verify_quotes(anchors: DataFrame, sources: DataFrame) -> DataFrame:
    """``(claim_id, item_no, status, match)`` of anchors ``(claim_id, item_no, source_id, quote)`` against the texts ``(source_id, text)``.

    ``verified`` with the best match among the source's texts (``exact``, ``normalized`` or ``ellipsis``), ``failed`` if none
    holds the quote, ``unverifiable`` if the source has no text. Anchors without a quote give no row; a quote
    is compared once per distinct text; texts of a source that very many have are spread by the salted join.
    """
    a = anchors.where("claim_id IS NOT NULL").select("claim_id", "item_no", "source_id", F.btrim("quote", F.lit(" \t\r\n\f\x0b")).alias("quote")).where("quote <> ''").distinct()
    quotes = a.where("source_id IS NOT NULL").select("source_id", "quote").distinct().withColumn("fq", folded_text(F.col("quote")))
    texts = sources.where("source_id IS NOT NULL AND text IS NOT NULL").select("source_id", "text").distinct().withColumn("ft", folded_text(F.col("text")))
    met = salted_join(texts, quotes, ["source_id"], ["text"])
    best = met.select("source_id", "quote", quote_match(F.col("quote"), F.col("fq"), F.col("text"), F.col("ft")).alias("m")).groupBy("source_id", "quote").agg(F.max("m").alias("m"))
    kind = F.when(F.col("m") == 3, "exact").when(F.col("m") == 2, "normalized").when(F.col("m") == 1, "ellipsis")
    status = F.when(F.col("m").isNull(), "unverifiable").when(F.col("m") == 0, "failed").otherwise("verified")
    return a.join(best, ["source_id", "quote"], "left").select("claim_id", "item_no", status.alias("status"), kind.alias("match")).distinct()


def claim_verdicts(claims: DataFrame, verified: DataFrame) -> DataFrame:
    """``(claim_id, verdict, n_quotes)`` of every claim: failed, unverifiable, verified, or absent without a quoted anchor; the worst anchor decides."""
    worst = verified.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_quotes"), F.max(F.when(F.col("status") == "failed", 3).when(F.col("status") == "unverifiable", 2).otherwise(1)).alias("w"))
    name = F.element_at(F.array(*map(F.lit, ("absent", "verified", "unverifiable", "failed"))), F.coalesce("w", F.lit(0)) + 1)
    return claims.where("claim_id IS NOT NULL").select("claim_id").distinct().join(worst, "claim_id", "left").select("claim_id", name.alias("verdict"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"))


def content_words(c: Column, least: int = 4) -> Column:
    """Runs of ASCII letters, digits, ``_`` and ``-`` of at least so many characters, in lower case, repeats kept, without stop words."""
    words = F.regexp_extract_all(F.lower(c), F.lit(rf"\b[a-z0-9_-]{{{least},}}\b"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def fact_present(fact: Column, text: Column) -> Column:
    """Whether enough of a fact's content words stand in a text, inside words too; a fact without any is present."""
    words, low = content_words(fact), F.lower(F.coalesce(text, F.lit("")))
    return (F.size(words) == 0) | (F.size(F.filter(words, lambda w: F.contains(low, w))) / F.size(words) >= SHARE)


def _says(text: Column, markers: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_contains(F.array(*(F.contains(low, F.lit(m)) for m in markers)), True)


def grades(questions: DataFrame, answers: DataFrame, registered: DataFrame) -> DataFrame:
    """``(id, coverage, failures, result)`` of questions ``(id, facts, forbidden, behavior, unsure)`` with an answer ``(id, text)``.

    Failures: a forbidden conclusion or a citation that is not registered (both catastrophic), declining where an
    answer is expected or the reverse, fewer than half the facts, no word of doubt where one is required. Questions
    without an answer give no row; null lists count as empty.
    """
    empty = F.array().cast("array<string>")
    q = questions.where("id IS NOT NULL").select("id", F.filter(F.coalesce("facts", empty), lambda x: x.isNotNull()).alias("facts"), F.filter(F.coalesce("forbidden", empty), lambda x: x.isNotNull()).alias("forbidden"), F.coalesce("behavior", F.lit("answer")).alias("behavior"), F.coalesce("unsure", F.lit(False)).alias("unsure"))
    met = q.join(answers.select("id", F.coalesce("text", F.lit("")).alias("text")).distinct(), "id")
    cited = met.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("src-[0-9a-f]{10}"), F.lit(0)))).alias("source_id"))
    made_up = cited.join(registered.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_anti").select("id").distinct().withColumn("made_up", F.lit(True))
    low, n = F.lower("text"), F.size("facts")
    coverage = F.when(n == 0, 1.0).otherwise(F.size(F.filter("facts", lambda f: fact_present(f, F.col("text")))) / n)
    declines, silent = _says(F.col("text"), ABSTAINS), F.col("behavior") == "abstain"
    checks = [("forbidden-conclusion", F.exists("forbidden", lambda f: F.contains(low, F.lower(f)))), ("fabricated-citation", F.coalesce("made_up", F.lit(False))), ("missing-abstention", silent & ~declines), ("bad-abstention", ~silent & declines), ("missing-elements", ~silent & (n > 0) & (coverage < COVERAGE)), ("missing-uncertainty", F.col("unsure") & ~_says(F.col("text"), UNSURE))]
    found = F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in checks)), lambda x: x.isNotNull())
    graded = met.join(made_up, "id", "left").select("id", F.round(coverage, 3).alias("coverage"), found.alias("f"))
    result = F.when(F.arrays_overlap("f", F.array(F.lit("forbidden-conclusion"), F.lit("fabricated-citation"))), "catastrophic").when(F.size("f") > 0, "fail").otherwise("pass")
    return graded.select("id", "coverage", F.array_join("f", ",").alias("failures"), result.alias("result"))


def setup_report(asked: DataFrame, retrieved: DataFrame, relevant: DataFrame, states: DataFrame, ungoverned: str) -> DataFrame:
    """One row of figures per retrieval set-up, from membership of sources in what was retrieved.

    ``asked`` is ``(setup, id, tier)`` with every question of every set-up, ``retrieved`` ``(setup, id, source_id)``, ``relevant``
    ``(id, source_id)``, ``states`` ``(source_id, flagged, revoked)``. Recall and the irrelevant rate are means over questions
    with relevant or with retrieved sources; leaks are questions that were given a flagged source; a false
    acceptance is a leak at a high tier, a false rejection a clean relevant source that only the ``ungoverned`` set-up retrieved;
    safe and grounded is a question with a clean relevant source and no leak.
    """
    r = retrieved.where("source_id IS NOT NULL").select("setup", "id", "source_id").distinct().withColumn("got", F.lit(1))
    base = r.where(F.col("setup") == ungoverned).select("id", "source_id", F.lit(1).alias("base"))
    want = asked.select("setup", "id").distinct().join(relevant.where("source_id IS NOT NULL").select("id", "source_id").distinct(), "id").withColumn("rel", F.lit(1))
    both = r.join(want, ["setup", "id", "source_id"], "full").join(states, "source_id", "left").join(base, ["id", "source_id"], "left")
    clean = ~F.coalesce("flagged", F.lit(True))
    got, rel = F.col("got").isNotNull(), F.col("rel").isNotNull()
    per = both.groupBy("setup", "id").agg(F.count("got").alias("got"), F.count("rel").alias("rel"), F.count_if(got & rel).alias("hit"), F.count_if(got & rel & clean).alias("clean_hit"), F.count_if(got & F.coalesce("flagged", F.lit(False))).alias("leaks"), F.count_if(got & F.coalesce("revoked", F.lit(False))).alias("revoked"), F.count_if(rel & clean & F.col("base").isNotNull() & ~got).alias("dropped"))
    n = lambda c: F.coalesce(c, F.lit(0))
    q = asked.join(per, ["setup", "id"], "left")
    minutes = F.coalesce(F.create_map(*(F.lit(x) for kv in REVIEW.items() for x in kv))[F.coalesce("tier", F.lit(""))], F.lit(REVIEW_OTHER))
    return q.groupBy("setup").agg(
        F.count(F.lit(1)).alias("n_questions"), F.round(F.avg(F.when(n("rel") > 0, n("hit") / F.col("rel"))), 4).alias("recall"), F.round(F.avg(F.when(n("hit") > 0, 1.0).otherwise(0.0)), 4).alias("coverage"),
        F.round(F.avg(F.when(n("got") > 0, 1 - n("hit") / F.col("got"))), 4).alias("irrelevant_rate"), F.count_if(n("revoked") > 0).alias("revoked_leaks"), F.count_if(n("leaks") > 0).alias("flagged_leaks"),
        F.count_if((n("leaks") > 0) & F.coalesce(F.col("tier").isin(*HIGH_TIERS), F.lit(False))).alias("false_accepts"), F.count_if(n("dropped") > 0).alias("false_rejects"),
        F.round(F.avg(F.when((n("clean_hit") > 0) & (n("leaks") == 0), 1.0).otherwise(0.0)), 4).alias("safe_grounded_rate"), F.round(F.avg(minutes), 3).alias("review_minutes"),
    )


def grade_rates(graded: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``(…by, n, pass_rate, catastrophic_rate)`` for each column of ``by`` on its own, for all together and for none; null values as ``unknown``."""
    g = graded.select("result", *(F.coalesce(c, F.lit("unknown")).alias(c) for c in by))
    sets = [[c] for c in by] + [list(by), []]
    return g.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, by)).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("result") == "pass").cast("double")), 4).alias("pass_rate"), F.round(F.avg((F.col("result") == "catastrophic").cast("double")), 4).alias("catastrophic_rate"))


def confusion_by(pairs: DataFrame, kind: str, labels: tuple[str, ...]) -> DataFrame:
    """``(kind, gold, verdict, n)``: every combination of the closed set of ``labels`` for every kind, with 0 where none."""
    grid = pairs.select(kind).distinct().select(kind, F.explode(F.array(*map(F.lit, labels))).alias("gold")).select(kind, "gold", F.explode(F.array(*map(F.lit, labels))).alias("verdict"))
    counted = pairs.groupBy(kind, "gold", "verdict").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counted, [kind, "gold", "verdict"], "left").select(kind, "gold", "verdict", F.coalesce("n", F.lit(0)).alias("n"))
