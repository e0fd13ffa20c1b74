"""The SQL that gives the rows of the knowledge-base queries."""

from __future__ import annotations

from ledgerloom.operators.notes import CHUNK, STEERING, STEP
from ledgerloom.operators.quality import Z
from ledgerloom.operators.retrieval import B, K1

TOP = 8
FLAGGED = "('permission-revoked', 'deleted-from-origin', 'do-not-use', 'revoked')"

_TERMS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}\p{{M}}]+'), lambda x: x <> '')"
_KEY = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g'))"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8199) || chr(8239) || chr(8203) || chr(65279)"
_FOLD = f"lower(trim({{0}}, {_BLANKS}))"
_DAY = r"CASE WHEN regexp_matches(trim({0}), '^\d{{4}}-\d{{2}}-\d{{2}}($|[T ])') THEN try_cast(substr(trim({0}), 1, 10) AS DATE) WHEN regexp_matches(trim({0}), '^\d{{8}}($|-\d)') THEN try_cast(substr(trim({0}), 1, 4) || '-' || substr(trim({0}), 5, 2) || '-' || substr(trim({0}), 7, 2) AS DATE) END"
_SRC = "nullif('src-' || regexp_extract(lower({0}), '(?:^|[^0-9a-z])([0-9a-f]{{10}})(?:$|[^0-9a-z])', 1), 'src-')"


def bm25_sql(docs: str, queries: str) -> str:
    """The CTEs of a BM25 ranking (``scores``, ``ranked``) of ``docs`` for ``queries`` (query_id, text)."""
    return f"""
WITH docs AS ({docs}), asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_TERMS.format('text')}) AS term FROM ({queries})) GROUP BY ALL),
words AS (SELECT doc_id, coalesce({_TERMS.format('text')}, []) AS w FROM docs),
corpus AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM words),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
idf AS (SELECT term, avgdl, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), corpus),
scores AS (SELECT query_id, doc_id, round(sum(times * idf * tf * ({K1} + 1) / (tf + {K1} * (1 - {B} + {B} * dl / avgdl))), 6) AS score FROM asked JOIN idf USING (term) JOIN tf USING (term) GROUP BY query_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores)
"""


def _bm25(docs: str) -> str:
    return bm25_sql(docs, "SELECT stem AS query_id, title AS text FROM concepts")


_ALL = "SELECT doc_id, text, concept FROM documents"
_CLEAN = f"SELECT doc_id, text FROM documents WHERE source_id IS NULL OR source_id NOT IN (SELECT id FROM registry WHERE id IS NOT NULL AND lower(source_status) IN {FLAGGED})"
_LINES = "SELECT doc_id, i AS line_no, regexp_replace(l[i], '\\r$', '') AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)"


def _bullets(rows: str, title: str) -> str:
    return f"""
WITH s AS ({rows}), sec AS (SELECT doc_id, regexp_extract(text, '(?s)(?:\\A|\\n)## {title}[ \\t]*\\r?\\n(.*?)(?:\\n## |\\z)', 1) AS body FROM s WHERE text IS NOT NULL),
b AS (SELECT doc_id, list_filter(list_transform(string_split_regex(body, '\\r?\\n'), lambda l: regexp_extract(l, '^[-*] +(.*)$', 1)), lambda x: x <> '') AS b FROM sec)
SELECT doc_id, i::INTEGER AS place, trim(regexp_replace(b[i], '\\s+', ' ', 'g')) AS bullet FROM (SELECT doc_id, b, unnest(range(1, len(b) + 1)) AS i FROM b)
"""


def _rates(by: str, hit: str) -> str:
    low = f"round(greatest(0.0, (p + {Z * Z} / (2 * n)) / (1 + {Z * Z} / n) - {Z} / (1 + {Z * Z} / n) * sqrt(p * (1 - p) / n + {Z * Z} / (4 * n * n))), 4)"
    high = f"round(least(1.0, (p + {Z * Z} / (2 * n)) / (1 + {Z * Z} / n) + {Z} / (1 + {Z * Z} / n) * sqrt(p * (1 - p) / n + {Z * Z} / (4 * n * n))), 4)"
    return f"SELECT {by}, n, n_hit, round(p, 4) AS rate, {low} AS low, {high} AS high FROM (SELECT coalesce({by}, 'unknown') AS {by}, count(*) AS n, count(*) FILTER (WHERE {hit}) AS n_hit, (count(*) FILTER (WHERE {hit}))::DOUBLE / count(*) AS p FROM claims GROUP BY 1)"


_LATEST = "(SELECT * FROM registry WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, source DESC NULLS LAST, title DESC NULLS LAST, source_kind DESC NULLS LAST, evidence_strength DESC NULLS LAST, source_status DESC NULLS LAST, tier DESC NULLS LAST, ingested_at DESC NULLS LAST, content_hash DESC NULLS LAST, derived_from DESC NULLS LAST) = 1)"
_FIRST = "(SELECT * FROM registry WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at NULLS FIRST, source NULLS FIRST, title NULLS FIRST, source_kind NULLS FIRST, evidence_strength NULLS FIRST, source_status NULLS FIRST, tier NULLS FIRST, ingested_at NULLS FIRST, content_hash NULLS FIRST, derived_from NULLS FIRST) = 1)"

_URL_KEPT = "list_filter(string_split(substr(bare, strpos(bare, '?') + 1), '&'), lambda p: NOT regexp_matches(regexp_extract(p, '^([^=]*)', 1), '^(?:utm_.*|fbclid|gclid|mc_.*)$'))"

_GRADERS = "WITH g AS (SELECT doc_id, grader, max(level) AS level FROM level_labels WHERE level IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL), pairs AS (SELECT x.level AS a, y.level AS b FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.grader < y.grader)"

_ISSUES = f"""
WITH r AS (SELECT *, {_DAY.format('ingested_at')} AS day FROM registry), found AS (
SELECT id, unnest(list_filter([CASE WHEN source IS NULL THEN 'source-missing' END, CASE WHEN title IS NULL THEN 'title-missing' END, CASE WHEN content_hash IS NULL THEN 'hash-missing' END, CASE WHEN tier IS NULL THEN 'tier-missing' END, CASE WHEN day IS NULL THEN 'date-unknown' END,
CASE WHEN NOT coalesce({_FOLD.format('source_status')} IN ('active', 'archived', 'stale', 'permission-revoked', 'deleted-from-origin', 'do-not-use', 'revoked'), false) THEN 'status-unknown' END,
CASE WHEN NOT coalesce(regexp_matches(id, '^src-[0-9a-f]{{10}}$'), false) THEN 'id-form' END, CASE WHEN NOT coalesce(date_diff('day', day, loaded_at::DATE) <= 7, false) THEN 'late-load' END], lambda x: x IS NOT NULL)) AS issue FROM r),
issues AS (SELECT DISTINCT 'registry' AS table_name, coalesce(id, 'unknown') AS record_id, issue FROM found)
"""

_SNAP = f"SELECT snapshot, count(DISTINCT id) AS n_sources, count(DISTINCT id) FILTER (WHERE {_FOLD.format('source_status')} IN {FLAGGED}) AS n_flagged, count(DISTINCT id) FILTER (WHERE content_hash IS NULL) AS n_unhashed FROM snapshot_state WHERE snapshot IS NOT NULL GROUP BY snapshot"

_NEAREST = """
WITH pairs AS (SELECT q.vec_id, v.vec_id AS other_id, v.label AS other_label, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 5) AS cosine FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, other_id) AS rank FROM pairs QUALIFY rank <= 5)
"""

_NORM = r"trim(regexp_replace(translate({0}, '“”„‘’–—', '\"\"\"''''--'), '\s+', ' ', 'g'))".replace('\\"', '"')

SQL = {
    "bm25_topk": _bm25(_ALL) + f"SELECT * FROM ranked WHERE rank <= {TOP}",
    "bm25_governed": _bm25(_ALL) + f", clean AS ({_CLEAN}) SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE doc_id IN (SELECT doc_id FROM clean) QUALIFY rank <= {TOP}",
    "retrieval_metrics": _bm25(_ALL)
    + f""", hits AS (SELECT query_id, doc_id FROM ranked WHERE rank <= {TOP}), rel AS (SELECT DISTINCT stem AS query_id, doc_id FROM docs JOIN concepts ON {_KEY.format('docs.concept')} = {_KEY.format('stem')}),
per AS (SELECT coalesce(hits.query_id, rel.query_id) AS q, count(hits.doc_id) AS hits, count(rel.doc_id) AS rel, count(*) FILTER (WHERE hits.doc_id IS NOT NULL AND rel.doc_id IS NOT NULL) AS good FROM hits FULL JOIN rel ON hits.query_id = rel.query_id AND hits.doc_id = rel.doc_id GROUP BY 1)
SELECT count(*) AS n_queries, round(avg(CASE WHEN rel > 0 THEN good / rel END), 4) AS recall, round(avg(CASE WHEN good > 0 THEN 1.0 ELSE 0.0 END), 4) AS coverage, round(avg(CASE WHEN hits > 0 THEN 1 - good / hits END), 4) AS irrelevant_rate FROM per""",
    "exact_lookup": f"SELECT DISTINCT ref, id, 1.0::DOUBLE AS score FROM (SELECT DISTINCT ref, {_SRC.format('ref')} AS source_id FROM (SELECT unnest(source_ids) AS ref FROM claims) WHERE ref IS NOT NULL) JOIN registry ON id = source_id",
    "claim_identity": "SELECT DISTINCT claim_id, 'clm-' || substr(sha256(concept || ':' || trim(claim_text, ' ' || chr(9) || chr(10) || chr(13))), 1, 10) AS content_id, 'row-' || substr(sha256(coalesce(concept, '') || chr(31) || coalesce(claim_text, '') || chr(31) || coalesce(quote, '')), 1, 10) AS row_id FROM claims",
    "concept_slugs": "SELECT DISTINCT stem, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM concepts",
    "note_frontmatter": r"""WITH h AS (SELECT doc_id, regexp_extract(text, '(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n|\z)', 1) AS head FROM documents)
SELECT doc_id, """
    + ", ".join(rf"nullif(regexp_replace(regexp_extract(head, '(?m)^{f}:[ \t]*(.*?)[ \t]*\r?$', 1), '^[''\x22]|[''\x22]$', '', 'g'), '') AS {f}" for f in ("title", "source_id", "source_status"))
    + " FROM h WHERE head <> ''",
    "note_outline": f"""WITH h AS (SELECT doc_id, line_no, len(regexp_extract(line, '^(#+)', 1)) AS level, rtrim(regexp_extract(line, '^#+ +(.*)$', 1)) AS title FROM ({_LINES}) WHERE regexp_matches(line, '^#{{1,6}} +\\S'))
SELECT h.doc_id, h.line_no::INTEGER AS line_no, h.level::INTEGER AS level, h.title, max(p.line_no)::INTEGER AS parent_line FROM h LEFT JOIN h p ON p.doc_id = h.doc_id AND p.line_no < h.line_no AND p.level < h.level GROUP BY ALL""",
    "note_bullets": _bullets("SELECT doc_id, text FROM documents", "Key Claims"),
    "open_questions": _bullets("SELECT stem AS doc_id, body AS text FROM concepts", "Open Questions"),
    "speaker_turns": f"SELECT doc_id, speaker, count(*) AS n_turns, sum(n)::BIGINT AS n_chars FROM (SELECT doc_id, regexp_extract(line, '^\\[\\d{{2}}:\\d{{2}}\\] ([A-Z]+): ', 1) AS speaker, length(line) AS n FROM ({_LINES})) WHERE speaker <> '' GROUP BY ALL",
    "chunk_plan": f"SELECT doc_id, (s // {STEP} + 1)::INTEGER AS chunk_no, s::INTEGER AS start, least({CHUNK}, n - s)::INTEGER AS n_chars FROM (SELECT doc_id, length(text) AS n, unnest(CASE WHEN length(text) > {CHUNK} THEN range(0, length(text) - {CHUNK - STEP}, {STEP}) ELSE [0] END) AS s FROM documents WHERE length(text) > 0)",
    "token_budget": "SELECT coalesce(kind, 'unknown') AS kind, count(*) AS n_documents, sum(greatest(1, length(coalesce(text, '')) // 4))::BIGINT AS tokens, max(greatest(1, length(coalesce(text, '')) // 4)) AS largest FROM documents GROUP BY 1",
    "injection_scan": "WITH t AS (SELECT DISTINCT doc_id::VARCHAR AS doc_id, text FROM documents WHERE text IS NOT NULL UNION SELECT DISTINCT claim_id, quote FROM claims WHERE quote IS NOT NULL) " + " UNION ALL ".join(f"SELECT {i}::INTEGER AS pattern, count(*) FILTER (WHERE regexp_matches(text, '(?im)^\\s*{p}')) AS n_matches, count(*) AS n_texts FROM t" for i, p in enumerate(STEERING, 1)),
    "url_canonical": rf"""WITH b AS (SELECT DISTINCT source, regexp_replace(trim(source, ' ' || chr(9) || chr(10) || chr(13)), '#.*$', '') AS bare FROM registry WHERE source IS NOT NULL)
SELECT source, CASE WHEN strpos(bare, '?') = 0 THEN bare ELSE substr(bare, 1, strpos(bare, '?') - 1) || CASE WHEN len({_URL_KEPT}) > 0 THEN '?' || array_to_string({_URL_KEPT}, '&') ELSE '' END END AS url, lower(regexp_extract(source, '(?i)https?://([^/?#\s]+)', 1)) AS host FROM b""",
    "anchor_language": r"""SELECT DISTINCT anchor, CASE WHEN regexp_matches(anchor, '^page=\d+$') THEN 'page' WHEN regexp_matches(anchor, '^L\d+(=L\d+)?$') THEN 'lines' WHEN regexp_matches(anchor, '^seg-\d+$') THEN 'segment' WHEN starts_with(anchor, 'section=') THEN 'section' ELSE 'other' END AS kind,
try_cast(nullif(regexp_extract(anchor, '^(?:page=|L|seg-)(\d+)(?:=L\d+)?$', 1), '') AS INTEGER) AS first, try_cast(nullif(regexp_extract(anchor, '^L\d+=L(\d+)$', 1), '') AS INTEGER) AS last FROM (SELECT unnest(source_anchors).anchor AS anchor FROM claims) WHERE anchor IS NOT NULL""",
    "term_profile": f"WITH c AS (SELECT DISTINCT claim_id, claim_text FROM claims WHERE claim_text IS NOT NULL), t AS (SELECT term, count(*) AS df FROM (SELECT claim_id, unnest(list_distinct({_TERMS.format('claim_text')})) AS term FROM c) GROUP BY term HAVING count(*) > 1) SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM t, (SELECT count(*) AS n FROM c)",
    "split_disjointness": f"SELECT sha256({_FOLD.format('question')}) AS text_hash, count(DISTINCT split) AS n_splits, count(DISTINCT id) AS n_ids, min(split) AS first_split, max(split) AS last_split FROM questions WHERE question IS NOT NULL AND split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "fact_presence": f"""WITH q AS (SELECT DISTINCT id, {_SRC.format('r')} AS source_id, fact FROM (SELECT id, r, unnest(expected_answer_facts) AS fact FROM (SELECT id, unnest(required_source_ids) AS r, expected_answer_facts FROM questions WHERE id IS NOT NULL)) WHERE fact IS NOT NULL AND {_SRC.format('r')} IS NOT NULL),
w AS (SELECT id, source_id, fact, unnest(list_distinct(list_filter({_TERMS.format('fact')}, lambda x: length(x) > 3))) AS term FROM q),
c AS (SELECT DISTINCT source_id, unnest({_TERMS.format('claim_text')}) AS term FROM (SELECT {_SRC.format('u')} AS source_id, claim_text FROM (SELECT unnest(source_ids) AS u, claim_text FROM claims WHERE claim_text IS NOT NULL)) WHERE source_id IS NOT NULL),
hit AS (SELECT id, fact, w.term, max(c.term) AS h FROM w LEFT JOIN c ON c.source_id = w.source_id AND c.term = w.term GROUP BY ALL),
f AS (SELECT id, fact, count(*) AS terms, count(h) AS hits FROM hit GROUP BY ALL)
SELECT id, count(*) AS n_facts, count(*) FILTER (WHERE hits = terms) AS n_present FROM f GROUP BY id""",
    "probe_coverage": f"SELECT stem, count(DISTINCT id) AS n_probes, count(DISTINCT id) FILTER (WHERE review_status = 'accepted') AS n_accepted FROM concepts LEFT JOIN (SELECT id, {_KEY.format('concept')} AS k, review_status FROM dev_probes WHERE id IS NOT NULL) ON k = {_KEY.format('stem')} GROUP BY stem",
    "grader_confusion": _GRADERS + ", dom AS (SELECT DISTINCT level AS label FROM level_labels WHERE level IS NOT NULL) SELECT x.label AS a, y.label AS b, (SELECT count(*) FROM pairs WHERE pairs.a = x.label AND pairs.b = y.label) AS n FROM dom x, dom y",
    "grader_kappa": _GRADERS + ", t AS (SELECT count(*) AS n, count(*) FILTER (WHERE a = b) AS same FROM pairs), e AS (SELECT sum(x * y)::DOUBLE AS e FROM (SELECT a AS l, count(*) AS x FROM pairs GROUP BY a) JOIN (SELECT b AS l, count(*) AS y FROM pairs GROUP BY b) USING (l)) SELECT n, round(same / n, 4) AS agreement, round((same / n - e / (n * n)) / (1 - e / (n * n)), 4) AS kappa FROM t, e",
    "anchor_rate": _rates("extraction_method", "len(coalesce(source_anchors, [])) > 0"),
    "contested_rate": _rates("claim_quality", "coalesce(status = 'contested', false)"),
    "registry_upsert": f"SELECT id, content_hash, source_status, loaded_at FROM {_LATEST}",
    "first_written": "SELECT id, delivered_at, content_hash FROM snapshot_state WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY delivered_at NULLS FIRST, content_hash NULLS FIRST) = 1",
    "delivery_stats": "WITH g AS (SELECT claim_id, count(*) AS n FROM claims WHERE claim_id IS NOT NULL GROUP BY 1) SELECT coalesce(sum(n), 0)::BIGINT AS n_rows, count(*) AS n_unique, round(count(*) / sum(n), 4) AS ratio, count(*) FILTER (WHERE n > 1) AS n_repeated_keys FROM g",
    "registry_cube": f"SELECT kind, tier, count(*) AS n FROM (SELECT coalesce(source_kind, 'unknown') AS kind, coalesce(tier, 'unknown') AS tier FROM {_LATEST}) GROUP BY GROUPING SETS ((kind), (tier), (kind, tier), ())",
    "index_rollup": f"SELECT year, kind, strength, count(*) AS n FROM (SELECT coalesce(year({_DAY.format('ingested_at')}), 0)::INTEGER AS year, coalesce(source_kind, 'unknown') AS kind, coalesce(evidence_strength, 'unknown') AS strength FROM {_LATEST}) GROUP BY ROLLUP (year, kind, strength)",
    "tag_index": "SELECT coalesce(tag, 'untagged') AS tag, count(DISTINCT stem) AS n_concepts, string_agg(DISTINCT stem, ',' ORDER BY stem) AS stems FROM (SELECT stem, unnest(CASE WHEN len(coalesce(tags, [])) = 0 THEN [NULL] ELSE tags END) AS tag FROM concepts) GROUP BY 1",
    "top_concepts": f"WITH n AS (SELECT coalesce(extraction_method, 'unknown') AS method, {_KEY.format('concept')} AS concept, count(DISTINCT claim_id) AS n FROM claims WHERE concept IS NOT NULL GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY method ORDER BY n DESC, concept) AS rank FROM n QUALIFY rank <= 5",
    "registry_issues": _ISSUES + "SELECT * FROM issues",
    "issue_counts": _ISSUES + "SELECT table_name, issue, count(*) AS n FROM issues GROUP BY ALL",
    "registry_drift": f"WITH a AS (SELECT id, content_hash, source_status FROM {_FIRST}), b AS (SELECT id, content_hash, source_status FROM {_LATEST}) SELECT 'stored' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'fresh', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)",
    "retention": f"""WITH r AS (SELECT id, {_DAY.format('ingested_at')} AS day, evidence_strength FROM {_LATEST}), s AS (SELECT id, round(pow(0.5, greatest(0, date_diff('day', day, DATE '2026-06-30')) / (CASE WHEN evidence_strength IN ('primary-doc', 'strong') THEN 365 WHEN evidence_strength = 'secondary' THEN 180 ELSE 45 END)), 6) AS score FROM r WHERE day IS NOT NULL)
SELECT id, score, CASE WHEN score >= 0.7 THEN 'fresh' WHEN score >= 0.4 THEN 'healthy' WHEN score >= 0.2 THEN 'aging' ELSE 'stale' END AS tier FROM s""",
    "snapshot_signals": f"SELECT snapshot, n_sources, n_flagged, n_unhashed, " + ", ".join(f"{c} - lag({c}) OVER (ORDER BY snapshot) AS {c}_delta" for c in ("n_sources", "n_flagged", "n_unhashed")) + f" FROM ({_SNAP})",
    "snapshot_overlay": "SELECT id, snapshot, content_hash, tier FROM snapshot_state WHERE id IS NOT NULL AND snapshot IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY snapshot DESC, delivered_at DESC NULLS LAST, content_hash DESC NULLS LAST, tier DESC NULLS LAST) = 1",
    "concept_cosine": """WITH w AS (SELECT stem AS id, regexp_extract_all(lower(coalesce(body, '')), '[a-z]{3,}') AS w FROM concepts), tf AS (SELECT id, term, count(*) / any_value(n) AS tf FROM (SELECT id, len(w) AS n, unnest(w) AS term FROM w) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), raw AS (SELECT id, term, tf * (ln(((SELECT count(*) FROM w) + 1) / (df + 1)) + 1) AS w FROM tf JOIN df USING (term)), norm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY id),
v AS (SELECT id, term, w / norm AS weight FROM raw JOIN norm USING (id))
SELECT x.id AS a, y.id AS b, round(sum(x.weight * y.weight), 6) AS cosine FROM v x JOIN v y ON x.term = y.term AND x.id < y.id GROUP BY ALL HAVING round(sum(x.weight * y.weight), 6) >= 0.4""",
    "embedding_neighbours": _NEAREST + "SELECT * FROM near",
    "embedding_confusion": _NEAREST + "SELECT e.label AS a, won.other_label AS b, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, other_label) AS r FROM (SELECT vec_id, other_label, count(*) AS c FROM near GROUP BY ALL)) won JOIN embeddings e USING (vec_id) WHERE r = 1 GROUP BY ALL",
}
