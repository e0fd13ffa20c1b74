"""Queries over the knowledge base: retrieval, notes, identities, profiles, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.keys import day_of, folded, source_key, spelling_key
from ledgerloom.operators import notes, quality, retrieval, similarity
from ledgerloom.sources.tables import table

#: Statuses that keep a source out of governed retrieval.
FLAGGED = ("permission-revoked", "deleted-from-origin", "do-not-use", "revoked")
TOP = 8
AS_OF = "2026-06-30"

_Q = "'[^\\p{L}\\p{N}\\p{M}]+'"


def _titles(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "concepts").select(F.col("stem").alias("query_id"), F.col("title").alias("text"))


def bm25_topk(s, d):
    return retrieval.bm25_best(table(s, d, "documents").select("doc_id", "text"), _titles(s, d), TOP)


def bm25_governed(s, d):
    """Scores come from the whole corpus; documents of flagged sources are left out before the best are taken."""
    docs = table(s, d, "documents")
    clean = retrieval.unflagged(docs.select("doc_id", "source_id"), table(s, d, "registry"), FLAGGED)
    return retrieval.bm25_best(docs.select("doc_id", "text"), _titles(s, d), TOP, clean)


def retrieval_metrics(s, d):
    stems = table(s, d, "concepts").select(F.col("stem").alias("query_id"), spelling_key(F.col("stem")).alias("k"))
    relevant = table(s, d, "documents").select("doc_id", spelling_key(F.col("concept")).alias("k")).join(stems, "k").select("query_id", "doc_id")
    return retrieval.retrieval_metrics(bm25_topk(s, d), relevant)


def exact_lookup(s, d):
    refs = table(s, d, "claims").select(F.explode("source_ids").alias("ref")).where("ref IS NOT NULL").select("ref", source_key(F.col("ref")).alias("source_id")).distinct()
    return retrieval.exact_lookup(refs, table(s, d, "registry"))


def claim_identity(s, d):
    c = table(s, d, "claims").select("claim_id", notes.claim_key(F.col("concept"), F.col("claim_text")).alias("content_id"), notes.stable_id("row", F.col("concept"), F.col("claim_text"), F.col("quote")).alias("row_id"))
    return c.distinct()


def concept_slugs(s, d):
    return table(s, d, "concepts").select("stem", notes.slug(F.col("title")).alias("slug")).distinct()


def note_frontmatter(s, d):
    return notes.frontmatter(table(s, d, "documents"), ("title", "source_id", "source_status"))


def note_outline(s, d):
    return notes.headings(table(s, d, "documents"))


def note_bullets(s, d):
    return notes.bullets(table(s, d, "documents"), "Key Claims")


def open_questions(s, d):
    return notes.bullets(table(s, d, "concepts").select(F.col("stem").alias("doc_id"), F.col("body").alias("text")), "Open Questions")


def speaker_turns(s, d):
    return notes.speaker_turns(table(s, d, "documents"))


def chunk_plan(s, d):
    return notes.chunks(table(s, d, "documents"))


def token_budget(s, d):
    docs = table(s, d, "documents").select(F.coalesce("kind", F.lit("unknown")).alias("kind"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return docs.groupBy("kind").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(notes.tokens_estimate(F.col("n"))).alias("tokens"), F.max(notes.tokens_estimate(F.col("n"))).alias("largest"))


def _texts(s, d):
    docs, claims = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text"), table(s, d, "claims").select(F.col("claim_id").alias("doc_id"), F.col("quote").alias("text"))
    return docs.unionByName(claims)


def injection_scan(s, d):
    """How many texts each of the eight steering patterns is found in, patterns that are not found included."""
    return notes.steering_report(_texts(s, d))


def injection_matches(s, d):
    """First matches of the eight line beginnings that steer a reader model, per text."""
    return notes.steering_matches(_texts(s, d)).distinct()


def url_canonical(s, d):
    r = table(s, d, "registry").where("source IS NOT NULL").select("source").distinct()
    return r.select("source", notes.canonical_url(F.col("source")).alias("url"), F.lower(F.regexp_extract("source", r"(?i)https?://([^/?#\s]+)", 1)).alias("host"))


def anchor_language(s, d):
    return notes.anchor_parts(table(s, d, "claims").select(F.explode("source_anchors.anchor").alias("anchor")))


def term_profile(s, d):
    """Document frequency and idf of the words of all claims, those in at least two."""
    c = table(s, d, "claims").where("claim_text IS NOT NULL").select("claim_id", "claim_text").distinct()
    df = c.select("claim_id", F.explode(F.array_distinct(retrieval.terms(F.col("claim_text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    n = c.agg(F.count(F.lit(1)).alias("n"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), 6).alias("idf"))


def split_disjointness(s, d):
    """Question texts that several evaluation splits hold (empty where splits are disjoint): one row per text with its splits and ids."""
    q = table(s, d, "questions").where("question IS NOT NULL AND split IS NOT NULL").select("split", "id", folded(F.col("question")).alias("t"))
    g = q.groupBy(F.sha2("t", 256).alias("text_hash")).agg(F.count_distinct("split").alias("n_splits"), F.count_distinct("id").alias("n_ids"), F.min("split").alias("first_split"), F.max("split").alias("last_split"))
    return g.where("n_splits > 1")


def fact_presence(s, d):
    """How many expected facts of a question have all their words of four letters or more in a claim that cites a required source."""
    q = table(s, d, "questions").where("id IS NOT NULL").select("id", F.explode("required_source_ids").alias("r"), "expected_answer_facts").select("id", source_key(F.col("r")).alias("source_id"), F.explode("expected_answer_facts").alias("fact")).where("source_id IS NOT NULL AND fact IS NOT NULL").distinct()
    words = q.select("id", "source_id", "fact", F.explode(F.array_distinct(F.filter(retrieval.terms(F.col("fact")), lambda w: F.length(w) > 3))).alias("term"))
    c = table(s, d, "claims").where("claim_text IS NOT NULL").select("claim_id", F.explode(F.array_distinct(F.transform("source_ids", source_key))).alias("source_id"), "claim_text").where("source_id IS NOT NULL")
    held = c.join(words.select("source_id").distinct(), "source_id", "left_semi").select("source_id", F.explode(F.array_distinct(retrieval.terms(F.col("claim_text")))).alias("term")).distinct()
    hit = words.join(held.withColumn("hit", F.lit(1)), ["source_id", "term"], "left").groupBy("id", "fact", "term").agg(F.max("hit").alias("hit"))
    fact = hit.groupBy("id", "fact").agg(F.count(F.lit(1)).alias("terms"), F.count("hit").alias("hits"))
    return fact.groupBy("id").agg(F.count(F.lit(1)).alias("n_facts"), F.count_if(F.col("hits") == F.col("terms")).alias("n_present"))


def probe_coverage(s, d):
    """Probes per concept and review status, concepts without probes included."""
    c = table(s, d, "concepts").select(spelling_key(F.col("stem")).alias("k"), "stem")
    p = table(s, d, "dev_probes").where("id IS NOT NULL").select("id", spelling_key(F.col("concept")).alias("k"), "review_status").distinct()
    return c.join(p, "k", "left").groupBy("stem").agg(F.count_distinct("id").alias("n_probes"), F.count_distinct(F.when(F.col("review_status") == "accepted", F.col("id"))).alias("n_accepted"))


def grader_pairs(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "level_labels").where("level IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id", "grader").agg(F.max("level").alias("level"))
    x, y = g.alias("x"), g.alias("y")
    return x.join(y, F.expr("x.doc_id = y.doc_id AND x.grader < y.grader")).select(F.col("x.level").alias("a"), F.col("y.level").alias("b"))


def grader_confusion(s, d):
    return quality.confusion(grader_pairs(s, d), table(s, d, "level_labels").where("level IS NOT NULL").select(F.col("level").alias("label")))


def grader_kappa(s, d):
    return quality.kappa(grader_pairs(s, d))


def anchor_rate(s, d):
    return quality.rates(table(s, d, "claims"), "extraction_method", F.size(F.coalesce("source_anchors", F.array())) > 0)


def contested_rate(s, d):
    return quality.rates(table(s, d, "claims"), "claim_quality", F.coalesce(F.col("status") == "contested", F.lit(False)))


def latest_registry(s: SparkSession, d: str) -> DataFrame:
    return quality.latest(table(s, d, "registry"), "id", "loaded_at")


def registry_upsert(s, d):
    return latest_registry(s, d).select("id", "content_hash", "source_status", "loaded_at")


def first_written(s, d):
    return quality.first_written(table(s, d, "snapshot_state").select("id", "delivered_at", "content_hash"), "id", "delivered_at")


def delivery_stats(s, d):
    return quality.repeated(table(s, d, "claims"), "claim_id")


def registry_cube(s, d):
    """Counts by kind, by tier and by both, in one pass."""
    r = latest_registry(s, d).select(F.coalesce("source_kind", F.lit("unknown")).alias("kind"), F.coalesce("tier", F.lit("unknown")).alias("tier"))
    return r.groupingSets([["kind"], ["tier"], ["kind", "tier"], []], "kind", "tier").agg(F.count(F.lit(1)).alias("n"))


def index_rollup(s, d):
    """The index by year, kind and strength, with subtotals."""
    r = latest_registry(s, d).select(F.coalesce(F.year(day_of(F.col("ingested_at"))), F.lit(0)).alias("year"), F.coalesce("source_kind", F.lit("unknown")).alias("kind"), F.coalesce("evidence_strength", F.lit("unknown")).alias("strength"))
    return r.rollup("year", "kind", "strength").agg(F.count(F.lit(1)).alias("n"))


def tag_index(s, d):
    c = table(s, d, "concepts").select("stem", F.explode_outer("tags").alias("tag"))
    return c.groupBy(F.coalesce("tag", F.lit("untagged")).alias("tag")).agg(F.count_distinct("stem").alias("n_concepts"), F.array_join(F.array_sort(F.collect_set("stem")), ",").alias("stems"))


def top_concepts(s, d):
    n = table(s, d, "claims").where("concept IS NOT NULL").groupBy(F.coalesce("extraction_method", F.lit("unknown")).alias("method"), spelling_key(F.col("concept")).alias("concept")).agg(F.count_distinct("claim_id").alias("n"))
    return quality.top_per_group(n, "method", "concept", "n", 5)


def registry_issues(s, d):
    status = ("active", "archived", "stale", *FLAGGED)
    rules = {"source-missing": F.col("source").isNotNull(), "title-missing": F.col("title").isNotNull(), "hash-missing": F.col("content_hash").isNotNull(), "tier-missing": F.col("tier").isNotNull(), "date-unknown": day_of(F.col("ingested_at")).isNotNull(), "status-unknown": folded(F.col("source_status")).isin(*status), "id-form": F.col("id").rlike("^src-[0-9a-f]{10}$"), "late-load": F.datediff("loaded_at", day_of(F.col("ingested_at"))) <= 7}
    return quality.issues(table(s, d, "registry"), "registry", "id", rules)


def issue_counts(s, d):
    return registry_issues(s, d).groupBy("table_name", "issue").agg(F.count(F.lit(1)).alias("n"))


def registry_drift(s, d):
    """The registry as first and as last loaded: rows that only one of the two has."""
    r = table(s, d, "registry")
    pick = lambda x: x.select("id", "content_hash", "source_status")
    return quality.drift(pick(quality.first_written(r, "id", "loaded_at")), pick(latest_registry(s, d)))


def retention(s, d):
    """A source's freshness on a fixed day: half-life by strength, tiers from the score."""
    r = latest_registry(s, d).select("id", day_of(F.col("ingested_at")).alias("day"), "evidence_strength").where("day IS NOT NULL")
    life = F.when(F.col("evidence_strength").isin("primary-doc", "strong"), 365).when(F.col("evidence_strength") == "secondary", 180).otherwise(45)
    score = r.select("id", quality.half_life_score(F.datediff(F.lit(AS_OF).cast("date"), F.col("day")), life).alias("score"))
    return score.select("id", "score", F.when(F.col("score") >= 0.7, "fresh").when(F.col("score") >= 0.4, "healthy").when(F.col("score") >= 0.2, "aging").otherwise("stale").alias("tier"))


def snapshot_signals(s, d):
    """Counters of every snapshot with their change against the one before."""
    m = table(s, d, "snapshot_state").where("snapshot IS NOT NULL").groupBy("snapshot").agg(F.count_distinct("id").alias("n_sources"), F.count_distinct(F.when(folded(F.col("source_status")).isin(*FLAGGED), F.col("id"))).alias("n_flagged"), F.count_distinct(F.when(F.col("content_hash").isNull(), F.col("id"))).alias("n_unhashed"))
    return quality.metric_deltas(m, "snapshot", ("n_sources", "n_flagged", "n_unhashed"))


def snapshot_overlay(s, d):
    """The state as of the latest snapshot in which each source appears."""
    st = table(s, d, "snapshot_state").where("id IS NOT NULL AND snapshot IS NOT NULL")
    return st.groupBy("id").agg(F.max(F.struct("snapshot", "delivered_at", "content_hash", "tier")).alias("r")).select("id", "r.snapshot", "r.content_hash", "r.tier")


def concept_cosine(s, d):
    return similarity.cosine_pairs(similarity.tfidf(table(s, d, "concepts").select(F.col("stem").alias("id"), F.col("body").alias("text"))), 0.4)


def embedding_neighbours(s, d):
    v = table(s, d, "embeddings")
    return similarity.nearest(v, v.where("vec_id % 100 = 0"), 5)


def embedding_confusion(s, d):
    v = table(s, d, "embeddings")
    return similarity.label_votes(embedding_neighbours(s, d), v).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_governed, retrieval_metrics, exact_lookup, claim_identity, concept_slugs, note_frontmatter, note_outline, note_bullets, open_questions, speaker_turns, chunk_plan, token_budget, injection_scan, injection_matches, url_canonical, anchor_language, term_profile, split_disjointness, fact_presence, probe_coverage, grader_confusion, grader_kappa, anchor_rate, contested_rate, registry_upsert, first_written, delivery_stats, registry_cube, index_rollup, tag_index, top_concepts, registry_issues, issue_counts, registry_drift, retention, snapshot_signals, snapshot_overlay, concept_cosine, embedding_neighbours, embedding_confusion)}

from ledgerloom.plans.knowledge_sql import SQL  # noqa: E402, F401
