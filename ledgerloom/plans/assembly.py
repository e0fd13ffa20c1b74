"""Queries that combine results: search, drift, trees, packages, scorecard."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.keys import folded, source_key, spelling_key
from ledgerloom.operators import notes, packages, quality
from ledgerloom.plans import knowledge
from ledgerloom.plans.knowledge import FLAGGED, latest_registry
from ledgerloom.sources.tables import table


def combined_search(s, d):
    """Documents filed under the concept first, then ranked ones, eight per concept title."""
    stems = table(s, d, "concepts").select(F.col("stem").alias("query_id"), spelling_key(F.col("stem")).alias("k"))
    exact = table(s, d, "documents").where("kind = 'concept-page'").select("doc_id", spelling_key(F.col("concept")).alias("k")).join(stems, "k").select("query_id", "doc_id", F.lit(1.0).alias("score"))
    return packages.exact_first(exact, knowledge.bm25_topk(s, d), 8)


def unique_slugs(s, d):
    c = latest_registry(s, d).where("title IS NOT NULL").select("id", notes.slug(F.col("title")).alias("slug"))
    return packages.suffixed(c, "slug", "id").select("id", F.col("unique_name").alias("slug"))


def registry_snapshot_drift(s, d):
    """The hash in the registry against the one in the latest snapshot."""
    st = table(s, d, "snapshot_state").where("id IS NOT NULL AND snapshot IS NOT NULL")
    last = st.join(F.broadcast(st.agg(F.max("snapshot").alias("snapshot"))), "snapshot").groupBy("id").agg(F.max(F.struct("delivered_at", folded(F.col("content_hash")).alias("content_hash"))).alias("r")).select("id", "r.content_hash")
    return packages.content_drift(last, latest_registry(s, d).select("id", folded(F.col("content_hash")).alias("content_hash")))


def first_delivered(s, d):
    """The latest registry rows with the time their id was first loaded."""
    return packages.first_seen(table(s, d, "registry"), latest_registry(s, d).select("id", "content_hash", "loaded_at"), "id", "loaded_at")


def lineage_heights(s, d):
    return packages.heights(table(s, d, "registry").select(F.col("derived_from").alias("child"), F.col("id").alias("parent")))


def concept_packages(s, d):
    """The distinct claims of a concept as a content-addressed package."""
    c = table(s, d, "claims").where("concept IS NOT NULL").select(spelling_key(F.col("concept")).alias("concept"), "claim_id", "claim_text", "status")
    return packages.packages(c, "concept", ["claim_id", "claim_text", "status"])


def scorecard(s, d):
    """One row of counters over all tables."""
    c = table(s, d, "claims").where("claim_id IS NOT NULL").groupBy("claim_id").agg(F.max(F.when(F.size(F.coalesce("source_ids", F.array())) > 0, 1).otherwise(0)).alias("sourced"), F.max(F.when(F.col("quote").isNotNull(), 1).otherwise(0)).alias("quoted"))
    claims = c.agg(F.count(F.lit(1)).alias("n_claims"), F.sum("sourced").alias("n_sourced"), F.sum("quoted").alias("n_quoted"))
    reg = latest_registry(s, d).agg(F.count(F.lit(1)).alias("n_sources"), F.count_if(F.coalesce(folded(F.col("source_status")).isin(*FLAGGED), F.lit(False))).alias("n_flagged"), F.count_if(F.coalesce(F.col("tier") == "primary", F.lit(False))).alias("n_primary"))
    return claims.crossJoin(F.broadcast(reg)).select("*", F.round(F.try_divide("n_sourced", "n_claims"), 3).alias("sourced_rate"), F.round(F.try_divide("n_primary", "n_sources"), 3).alias("primary_rate"))


def health_signals(s, d):
    rules = [("few-primary-sources", "warning", (F.col("n_sources") >= 5) & (F.col("primary_rate") < 0.5)), ("flagged-sources", "error", F.col("n_flagged") > 0), ("unsourced-claims", "warning", F.col("sourced_rate") < 1), ("no-claims", "error", F.col("n_claims") == 0)]
    return packages.threshold_signals(scorecard(s, d), rules)


def clean_quotes(s, d):
    """Quotes without citations, in compatible form, where that changes them."""
    c = table(s, d, "claims").where("claim_id IS NOT NULL AND quote IS NOT NULL").select("claim_id", "quote").distinct()
    return c.select("claim_id", "quote", packages.folded_punctuation(packages.without_citations(F.col("quote"))).alias("clean")).where("clean <> quote")


def boilerplate(s, d):
    """Characters that boilerplate lines and runs of empty lines take up, by kind of document."""
    t = table(s, d, "documents").where("text IS NOT NULL").select(F.coalesce("kind", F.lit("unknown")).alias("kind"), F.length("text").alias("n"), F.length(packages.without_boilerplate(F.col("text"))).alias("kept"))
    return t.groupBy("kind").agg(F.sum("n").alias("n_chars"), F.sum(F.col("n") - F.col("kept")).alias("n_dropped"))


def citation_share(s, d):
    """Which sources a concept cites, with the share of its citations; the five greatest per concept."""
    c = table(s, d, "claims").where("concept IS NOT NULL").select(spelling_key(F.col("concept")).alias("concept"), "claim_id", F.explode(F.array_distinct(F.transform("source_ids", source_key))).alias("source_id")).where("source_id IS NOT NULL").distinct()
    n = c.groupBy("concept", "source_id").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("concept").agg(F.sum("n").alias("total"))
    return quality.top_per_group(n, "concept", "source_id", "n", 5).join(total, "concept").select("concept", "source_id", "n", "rank", F.round(F.col("n") / F.col("total"), 4).alias("share"))


QUERIES = {f.__name__: f for f in (combined_search, unique_slugs, registry_snapshot_drift, first_delivered, lineage_heights, concept_packages, scorecard, health_signals, clean_quotes, boilerplate, citation_share)}

from ledgerloom.plans.knowledge_sql import _DAY, _FOLD, _KEY, _LATEST, _SRC, FLAGGED as _F, SQL as _K  # noqa: E402, F401

_SCORE = f"WITH c AS (SELECT claim_id, max((len(coalesce(source_ids, [])) > 0)::INTEGER) AS s, max((quote IS NOT NULL)::INTEGER) AS q FROM claims WHERE claim_id IS NOT NULL GROUP BY 1), card AS (SELECT *, round(n_sourced / n_claims, 3) AS sourced_rate, round(n_primary / n_sources, 3) AS primary_rate FROM (SELECT count(*) AS n_claims, sum(s)::BIGINT AS n_sourced, sum(q)::BIGINT AS n_quoted FROM c), (SELECT count(*) AS n_sources, count(*) FILTER (WHERE {_FOLD.format('source_status')} IN {_F}) AS n_flagged, count(*) FILTER (WHERE tier = 'primary') AS n_primary FROM {_LATEST}))"

SQL = {
    "combined_search": _K["bm25_topk"].replace("SELECT * FROM ranked WHERE rank <= 8", "")
    + f""", exact AS (SELECT stem AS query_id, doc_id, 1.0::DOUBLE AS score, 'exact' AS method, 0 AS p FROM (SELECT doc_id, {_KEY.format('concept')} AS k FROM documents WHERE kind = 'concept-page') JOIN concepts ON k = {_KEY.format('stem')}),
both_ AS (SELECT * FROM exact UNION ALL SELECT query_id, doc_id, score, 'bm25', 1 FROM ranked WHERE rank <= 8),
once AS (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY p, score DESC) = 1)
SELECT query_id, doc_id, score, method, row_number() OVER (PARTITION BY query_id ORDER BY p, score DESC, doc_id) AS rank FROM once QUALIFY rank <= 8""",
    "unique_slugs": f"WITH s AS (SELECT id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM {_LATEST} WHERE title IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY id) AS n FROM s) SELECT id, CASE WHEN n = 1 THEN slug ELSE slug || '-' || (n - 1) END AS slug FROM n",
    "registry_snapshot_drift": f"WITH l AS (SELECT id, {_FOLD.format('content_hash')} AS old FROM snapshot_state WHERE id IS NOT NULL AND snapshot = (SELECT max(snapshot) FROM snapshot_state WHERE id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY delivered_at DESC NULLS LAST, old DESC NULLS LAST) = 1), r AS (SELECT id, {_FOLD.format('content_hash')} AS new FROM {_LATEST}) SELECT coalesce(l.id, r.id) AS id, CASE WHEN l.id IS NULL THEN 'new' WHEN r.id IS NULL THEN 'gone' WHEN old IS NULL OR new IS NULL THEN 'unknown' WHEN old = new THEN 'unchanged' ELSE 'drifted' END AS status FROM l FULL JOIN r ON l.id = r.id",
    "first_delivered": f"SELECT l.id, l.content_hash, f.t AS loaded_at FROM {_LATEST} l JOIN (SELECT id, min(loaded_at) AS t FROM registry GROUP BY id) f USING (id)",
    "lineage_heights": "WITH RECURSIVE e AS (SELECT DISTINCT derived_from AS child, id AS parent FROM registry WHERE derived_from IS NOT NULL AND id IS NOT NULL AND derived_from <> id), nodes AS (SELECT child AS node FROM e UNION SELECT parent FROM e), up(node, h) AS (SELECT node, 0 FROM nodes UNION SELECT e.parent, h + 1 FROM up JOIN e ON e.child = up.node WHERE h < (SELECT count(*) FROM nodes)) SELECT node, max(h)::INTEGER AS height FROM up GROUP BY node HAVING max(h) < (SELECT count(*) FROM nodes)",
    "scorecard": _SCORE + " SELECT * FROM card",
    "health_signals": _SCORE + " SELECT 'few-primary-sources' AS signal, 'warning' AS severity FROM card WHERE n_sources >= 5 AND primary_rate < 0.5 UNION ALL SELECT 'flagged-sources', 'error' FROM card WHERE n_flagged > 0 UNION ALL SELECT 'unsourced-claims', 'warning' FROM card WHERE sourced_rate < 1 UNION ALL SELECT 'no-claims', 'error' FROM card WHERE n_claims = 0",
    "concept_packages": f"WITH c AS (SELECT DISTINCT {_KEY.format('concept')} AS concept, sha256(coalesce(claim_id, chr(0)) || chr(31) || coalesce(claim_text, chr(0)) || chr(31) || coalesce(status, chr(0))) AS d FROM claims WHERE concept IS NOT NULL), g AS (SELECT concept, count(*) AS n_items, " + ", ".join(f"sum(('0x' || substr(d, {1 + 10 * i}, 10))::BIGINT) AS s{i}" for i in range(6)) + " FROM c GROUP BY concept) SELECT concept, n_items, sha256(concat_ws(':', n_items::VARCHAR, " + ", ".join(f"s{i}::VARCHAR" for i in range(6)) + ")) AS package_hash FROM g",
    "boilerplate": r"SELECT kind, sum(n)::BIGINT AS n_chars, sum(n - k)::BIGINT AS n_dropped FROM (SELECT coalesce(kind, 'unknown') AS kind, length(text) AS n, length(trim(regexp_replace(array_to_string(list_filter(list_transform(string_split_regex(text, '\r\n|\r|\n'), lambda l: trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda l: NOT regexp_matches(l, '" + packages.BOILERPLATE + r"')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS k FROM documents WHERE text IS NOT NULL) GROUP BY kind",
    "citation_share": f"WITH c AS (SELECT DISTINCT concept, claim_id, {_SRC.format('u')} AS source_id FROM (SELECT {_KEY.format('concept')} AS concept, claim_id, unnest(source_ids) AS u FROM claims WHERE concept IS NOT NULL) WHERE {_SRC.format('u')} IS NOT NULL), n AS (SELECT concept, source_id, count(*) AS n FROM c GROUP BY ALL) SELECT concept, source_id, n, row_number() OVER (PARTITION BY concept ORDER BY n DESC, source_id) AS rank, round(n / sum(n) OVER (PARTITION BY concept), 4) AS share FROM n QUALIFY rank <= 5",
}
