"""Queries about pages, the node and edge tables of the knowledge base, audits and proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.keys import day_of, folded, source_key, spelling_key
from ledgerloom.operators import graph, notes, pages, proposals, quality, segments, similarity
from ledgerloom.plans import links
from ledgerloom.plans.knowledge import FLAGGED, latest_registry
from ledgerloom.plans.knowledge_sql import _DAY, _FOLD, _KEY, _LATEST, _SRC, FLAGGED as _F
from ledgerloom.plans.links import _BASE
from ledgerloom.sources.tables import table

NOTE_BYTES, PAGE_LINES, LINKS = 61_440, 400, 50


def page_claims(s, d):
    return pages.page_claims(table(s, d, "documents").where("kind = 'concept-page'"), "doc_id", "concept", "text")


def source_links(s, d):
    """Source links written in the claims' lists, with their anchors."""
    c = table(s, d, "claims").where("claim_id IS NOT NULL").select("claim_id", F.explode("source_ids").alias("u")).where("u IS NOT NULL").distinct()
    return pages.source_links(c, "claim_id", "u").groupBy("claim_id", "source_id", "anchor").agg(F.count(F.lit(1)).alias("n"))


def anchor_fields(s, d):
    a = table(s, d, "claims").select(F.explode("source_anchors.anchor").alias("anchor")).where("anchor IS NOT NULL").distinct()
    return a.select("anchor", *(c.alias(n) for n, c in pages.anchor_fields(F.col("anchor")).items()))


def document_titles(s, d):
    t = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", pages.title_of(F.col("text")).alias("title"), F.sha2(pages.summary_of(F.col("text")), 256).alias("summary_hash"))
    return t.where("title IS NOT NULL OR summary_hash IS NOT NULL")


def registry_forms(s, d):
    """Year, kind and fallback author list of the latest registry rows."""
    r = latest_registry(s, d)
    return r.select("id", pages.year_of(F.col("ingested_at")).alias("year"), pages.kind_of(F.col("source_kind")).alias("kind"), F.array_join(pages.authors_of(F.array("tier", "evidence_strength"), F.col("source_kind")), "|").alias("names"))


def concept_tags(s, d):
    return table(s, d, "concepts").select("stem", F.array_join(pages.tags_of(F.col("tags"), F.col("type")), ",").alias("tags"))


def feed_objects(s, d):
    """How many payloads of the feed are, hold or lack a JSON object."""
    f = table(s, d, "claim_feed").select("payload", pages.salvaged_object(F.col("payload")).alias("o"))
    state = F.when(F.col("payload").isNull(), "null").when(F.col("o").isNull(), "none").when(F.col("o") == F.btrim("payload"), "whole").otherwise("salvaged")
    return f.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def _nodes(s, d):
    t = lambda n: table(s, d, n)
    kinds = [
        ("concept", t("concepts"), spelling_key(F.col("stem")), F.col("title")), ("source", t("registry"), F.col("id"), F.col("title")), ("claim", t("claims"), F.col("claim_id"), F.col("claim_text")), ("question", t("questions"), F.col("id"), F.col("question")),
        ("probe", t("dev_probes"), F.col("id"), F.col("question")), ("document", t("documents"), F.col("doc_id").cast("string"), F.col("kind")),
    ]
    out = None
    for kind, rows, key, title in kinds:
        part = rows.where(key.isNotNull()).groupBy(F.concat(F.lit(f"{kind}:"), key).alias("node")).agg(F.lit(kind).alias("kind"), F.max(title).alias("title"))
        out = part if out is None else out.unionByName(part)
    return out


def knowledge_nodes(s, d):
    """All nodes of the knowledge graph; the greatest title counts where rows differ."""
    return _nodes(s, d)


def knowledge_edges(s, d):
    """All edges of the knowledge graph whose two ends are nodes."""
    t = lambda n: table(s, d, n)
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    listed = lambda n, key, field: t(n).select(F.col(key).alias("k"), F.explode(field).alias("u")).select("k", source_key(F.col("u")).alias("u"))
    c = t("claims")
    parts = [
        ("has_claim", c.select(node("concept", spelling_key(F.col("concept"))).alias("a"), node("claim", F.col("claim_id")).alias("b"))),
        ("supported_by", listed("claims", "claim_id", "source_ids").select(node("claim", F.col("k")).alias("a"), node("source", F.col("u")).alias("b"))),
        ("derived_from", t("registry").select(node("source", F.col("id")).alias("a"), node("source", F.col("derived_from")).alias("b"))),
        ("requires", listed("questions", "id", "required_source_ids").select(node("question", F.col("k")).alias("a"), node("source", F.col("u")).alias("b"))),
        ("probes", t("dev_probes").select(node("probe", F.col("id")).alias("a"), node("concept", spelling_key(F.col("concept"))).alias("b"))),
        ("about", t("documents").select(node("document", F.col("doc_id").cast("string")).alias("a"), node("concept", spelling_key(F.col("concept"))).alias("b"))),
        ("documents", t("documents").select(node("document", F.col("doc_id").cast("string")).alias("a"), node("source", F.col("source_id")).alias("b"))),
    ]
    e = links.page_links(s, d).select("relation", node("concept", F.col("a")).alias("a"), node("concept", F.col("b")).alias("b"))
    for relation, rows in parts:
        e = e.unionByName(rows.where("a IS NOT NULL AND b IS NOT NULL").select(F.lit(relation).alias("relation"), "a", "b"))
    n = _nodes(s, d).select("node")
    return e.distinct().join(n.withColumnRenamed("node", "a"), "a", "left_semi").join(n.withColumnRenamed("node", "b"), "b", "left_semi").select("relation", "a", "b")


def lint_findings(s, d):
    """Findings of the audit of source notes, concept pages, answers, claims and the registry's notes."""
    docs = table(s, d, "documents")
    size = F.octet_length(F.col("text"))
    front = notes.frontmatter(docs.where("kind = 'source-note'"), ("title", "source_id", "source_status")).withColumnRenamed("source_id", "named")
    note = docs.where("kind = 'source-note' AND text IS NOT NULL").select(F.col("doc_id"), "source_id", "text").join(front, "doc_id", "left").withColumn("key", F.col("doc_id").cast("string"))
    found = quality.issues(note, "source-note", "key", {"frontmatter-id-missing": F.col("named").isNotNull(), "frontmatter-id-mismatch": F.col("named").isNull() | F.col("source_id").isNull() | (F.col("named") == F.col("source_id")), "missing-source-status": F.col("source_status").isNotNull(), "missing-title": F.col("title").isNotNull(), "missing-source-section": F.contains("text", F.lit("## Summary")), "source-note-too-large": size <= NOTE_BYTES})
    concept = table(s, d, "concepts")
    empty = F.array().cast("array<string>")
    found = found.unionByName(quality.issues(concept, "concepts", "stem", {"missing-type": F.col("type").isNotNull(), "missing-concept-title": F.col("title").isNotNull(), "missing-tags": F.size(F.coalesce("tags", empty)) > 0, "missing-evidence-status": F.col("evidence_status").isNotNull(), "invalid-claim-quality": F.col("claim_quality").isin("supported", "provisional", "conflicting", "weak", "stale"), "missing-updated": F.col("updated").isNotNull(), "conflicting-without-open-questions": (F.col("claim_quality") != "conflicting") | F.contains("body", F.lit("## Open Questions")), "page-too-long": F.size(F.split(F.coalesce("body", F.lit("")), "\n")) <= PAGE_LINES}))
    answer = docs.where("kind = 'answer-memo' AND text IS NOT NULL").withColumn("key", F.col("doc_id").cast("string"))
    found = found.unionByName(quality.issues(answer, "answers", "key", {"missing-answer-section": F.contains("text", F.lit("## Answer")), "missing-vault-updates": F.contains("text", F.lit("## Vault Updates")), "missing-answer-concept": F.col("concept").isNotNull(), "missing-answer-source": F.col("source_id").isNotNull()}))
    claims = table(s, d, "claims").where("claim_id IS NOT NULL")
    anchors = F.coalesce(F.col("source_anchors"), F.array())
    found = found.unionByName(quality.issues(claims, "claims", "claim_id", {"claim-without-text": F.col("claim_text").isNotNull(), "claim-without-source": F.size(F.coalesce("source_ids", empty)) > 0, "supported-claim-without-anchor": F.coalesce(F.col("claim_quality") != "supported", F.lit(True)) | (F.size(anchors) > 0), "bare-anchor": ~F.exists(anchors, lambda a: F.coalesce(a["anchor"], a["quote"], a["section"], a["path"]).isNull() & a["page"].isNull())}))
    flagged = table(s, d, "registry").where(F.coalesce(folded(F.col("source_status")).isin(*FLAGGED), F.lit(False))).select(F.col("id").alias("source_id")).distinct()
    cited = claims.where("claim_quality = 'supported'").select("claim_id", F.explode("source_ids").alias("u")).select("claim_id", source_key(F.col("u")).alias("source_id"))
    found = found.unionByName(cited.join(flagged, "source_id", "left_semi").select(F.lit("claims").alias("table_name"), F.col("claim_id").alias("record_id"), F.lit("flagged-source-backs-supported-claim").alias("issue")).distinct())
    reg = table(s, d, "registry").where("id IS NOT NULL").select("id").distinct()
    noted = docs.where("kind = 'source-note' AND source_id IS NOT NULL").select("source_id").distinct()
    row = lambda df, name, key, issue: df.select(F.lit(name).alias("table_name"), F.col(key).alias("record_id"), F.lit(issue).alias("issue"))
    found = found.unionByName(row(reg.join(noted.withColumnRenamed("source_id", "id"), "id", "left_anti"), "registry", "id", "missing-source-note"))
    found = found.unionByName(row(noted.join(reg.withColumnRenamed("id", "source_id"), "source_id", "left_anti"), "source-note", "source_id", "orphan-source-note"))
    twice = table(s, d, "registry").where("id IS NOT NULL").groupBy("id").agg(F.count_distinct("content_hash").alias("n")).where("n > 1")
    found = found.unionByName(row(twice, "registry", "id", "duplicate-registry-id"))
    concepts = concept.select(spelling_key(F.col("stem")).alias("b")).distinct()
    missing = links.concept_links(s, d).join(concepts, "b", "left_anti").select(F.col("a").alias("record_id")).distinct()
    return found.unionByName(row(missing, "concepts", "record_id", "missing-link-target"))


def lint_counts(s, d):
    return lint_findings(s, d).groupBy("table_name", "issue").agg(F.count(F.lit(1)).alias("n"))


def _one_claim(s, d):
    """One row per claim: the greatest of what was delivered."""
    c = table(s, d, "claims").where("claim_id IS NOT NULL AND claim_text IS NOT NULL AND concept IS NOT NULL")
    sources = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("source_ids", F.array().cast("array<string>")), source_key), lambda x: x.isNotNull())))
    return c.groupBy(F.col("claim_id").alias("id")).agg(F.max(F.struct("claim_text", sources.alias("scope"), F.coalesce("evidence_status", F.lit("")).alias("evidence"))).alias("r")).select("id", F.col("r.claim_text").alias("text"), "r.scope", segments.years(F.col("r.claim_text")).alias("years"), "r.evidence")


def duplicate_proposals(s, d):
    return proposals.duplicate_proposals(_one_claim(s, d), 0.9)


def rename_proposals(s, d):
    return proposals.rename_proposals(table(s, d, "claims").select(F.col("concept").alias("name")))


def archive_proposals(s, d):
    return proposals.archive_proposals(table(s, d, "claims").select(F.col("claim_id").alias("id"), F.col("claim_quality").alias("quality"), "status"))


def _concept_texts(s, d):
    c = table(s, d, "concepts").where("stem IS NOT NULL").groupBy(spelling_key(F.col("stem")).alias("id")).agg(F.max("body").alias("text"))
    return c


def friction_pairs(s, d):
    """Concepts that talk alike and cite different sources."""
    similar = similarity.cosine_pairs(similarity.tfidf(_concept_texts(s, d)), 0.2)
    c = table(s, d, "claims").where("concept IS NOT NULL AND claim_text IS NOT NULL")
    said = c.select(spelling_key(F.col("concept")).alias("name"), F.col("claim_text").alias("text"), F.transform(F.flatten(F.map_values("page_edges")), lambda t: spelling_key(F.regexp_extract(t, r"([^/]+)$", 1))).alias("others"))
    return proposals.friction(similar, graph.jaccard(links.concept_sources(s, d), 0.0), links._pairs(s, d), proposals.contrast_pairs(said), 0.3)


def hub_pairs(s, d):
    return proposals.hub_pairs(links.link_eigenvector(s, d), links._pairs(s, d))


def link_report(s, d):
    """The best fifty pairs of every approach without learned vectors, merged."""
    scored = lambda df, c: df.select("a", "b", F.col(c).alias("score"))
    free = lambda df: df.join(links._pairs(s, d), ["a", "b"], "left_anti")
    named = graph.pairs_by_item(links.concept_links(s, d).select(F.col("b").alias("item"), F.col("a").alias("owner")).where("item <> owner"), "item", "owner")
    signals = {
        "co-citation": scored(free(named).where("shared >= 2"), "shared"), "shared-sources": scored(free(graph.shared_neighbours(links.concept_sources(s, d))).where("shared >= 2"), "shared"), "conceptual-gravity": scored(links.conceptual_gravity(s, d), "gravity"),
        "analogical-mapping": scored(free(graph.jaccard(graph.both_ways(links._pairs(s, d)).select(F.col("node").alias("owner"), F.col("other").alias("item")), 0.25)), "jaccard"), "triadic-closure": scored(links.triadic_closure(s, d), "wedges"), "friction": scored(friction_pairs(s, d), "friction"),
    }
    return proposals.merged_signals(signals, LINKS)


def retention_lowest(s, d):
    """The thirty claims that have faded most on a fixed day, by their half-life."""
    c = table(s, d, "claims").where("claim_id IS NOT NULL").select("claim_id", day_of(F.col("last_updated")).alias("day"), "claim_quality").where("day IS NOT NULL").groupBy("claim_id").agg(F.max(F.struct("day", "claim_quality")).alias("r"))
    life = F.when(F.col("r.claim_quality") == "supported", 365).when(F.col("r.claim_quality").isin("provisional", "conflicting"), 120).when(F.col("r.claim_quality").isin("weak", "stale"), 45).otherwise(180)
    score = quality.half_life_score(F.datediff(F.lit("2026-06-30").cast("date"), F.col("r.day")), life)
    return c.select("claim_id", score.alias("score")).orderBy("score", "claim_id").limit(30)


QUERIES = {f.__name__: f for f in (page_claims, source_links, anchor_fields, document_titles, registry_forms, concept_tags, feed_objects, knowledge_nodes, knowledge_edges, lint_findings, lint_counts, duplicate_proposals, rename_proposals, archive_proposals, friction_pairs, hub_pairs, link_report, retention_lowest)}

_LINK = pages.SOURCE_LINK
_PLAIN = rf"regexp_replace(trim(regexp_replace(regexp_replace({{0}}, '\s*\(?(?:{_LINK.replace('{', '{{').replace('}', '}}')})\)?', '', 'g'), '\s+', ' ', 'g')), '\s+([,.;:!?])', '\1', 'g')"
_PART = lambda p: f"nullif(regexp_extract(x, '^(?:.*&)?{p}(?:&.*)?$', 1), '')"
_NUM = lambda n: f"try_cast({_PART(n + '=([0-9]+)[.,;)]*')} AS INTEGER)"
_NAM = lambda n: _PART(n + "=([^&]*[^&.,;)])[.,;)]*")
_NODE = "concat('{0}:', {1})"
_UNION = " UNION ALL ".join
_NODES = "WITH n AS (" + _UNION([
    f"SELECT {_NODE.format('concept', _KEY.format('stem'))} AS node, 'concept' AS kind, max(title) AS title FROM concepts WHERE stem IS NOT NULL GROUP BY 1", "SELECT concat('source:', id), 'source', max(title) FROM registry WHERE id IS NOT NULL GROUP BY 1", "SELECT concat('claim:', claim_id), 'claim', max(claim_text) FROM claims WHERE claim_id IS NOT NULL GROUP BY 1",
    "SELECT concat('question:', id), 'question', max(question) FROM questions WHERE id IS NOT NULL GROUP BY 1", "SELECT concat('probe:', id), 'probe', max(question) FROM dev_probes WHERE id IS NOT NULL GROUP BY 1", "SELECT concat('document:', doc_id), 'document', max(kind) FROM documents WHERE doc_id IS NOT NULL GROUP BY 1",
]) + ")"
_EDGES = _UNION([
    f"SELECT relation, 'concept:' || a AS a, 'concept:' || {_KEY.format(chr(114) + 'egexp_extract(t, ' + chr(39) + '([^/]+)$' + chr(39) + ', 1)')} AS b FROM (SELECT a, x.key AS relation, unnest(x.value) AS t FROM (SELECT {_KEY.format('concept')} AS a, unnest(map_entries(page_edges)) AS x FROM claims WHERE concept IS NOT NULL)) WHERE t IS NOT NULL",
    f"SELECT 'has_claim', 'concept:' || {_KEY.format('concept')}, 'claim:' || claim_id FROM claims", f"SELECT 'supported_by', 'claim:' || claim_id, 'source:' || {_SRC.format('u')} FROM (SELECT claim_id, unnest(source_ids) AS u FROM claims)", "SELECT 'derived_from', 'source:' || id, 'source:' || derived_from FROM registry",
    f"SELECT 'requires', 'question:' || id, 'source:' || {_SRC.format('u')} FROM (SELECT id, unnest(required_source_ids) AS u FROM questions)", f"SELECT 'probes', 'probe:' || id, 'concept:' || {_KEY.format('concept')} FROM dev_probes", f"SELECT 'about', 'document:' || doc_id, 'concept:' || {_KEY.format('concept')} FROM documents", "SELECT 'documents', 'document:' || doc_id, 'source:' || source_id FROM documents",
])
_CASES = lambda name, key, rows, rules: f"SELECT DISTINCT '{name}' AS table_name, coalesce({key}, 'unknown') AS record_id, issue FROM (SELECT {key}, unnest([" + ", ".join(f"CASE WHEN NOT coalesce({ok}, false) THEN '{i}' END" for i, ok in rules.items()) + f"]) AS issue FROM ({rows})) WHERE issue IS NOT NULL"
_FRONT = r"nullif(regexp_replace(regexp_extract(h, '(?m)^{0}:[ \t]*(.*?)[ \t]*\r?$', 1), '^[''\"]|[''\"]$', '', 'g'), '')"
_LINT = "WITH found AS (" + _UNION([
    _CASES("source-note", "key", f"SELECT key, source_id, text, {_FRONT.format('title')} AS title, {_FRONT.format('source_id')} AS named, {_FRONT.format('source_status')} AS st FROM (SELECT doc_id::VARCHAR AS key, source_id, text, regexp_extract(text, '(?s)\\A---\\r?\\n(.*?)\\r?\\n---(?:\\r?\\n|\\z)', 1) AS h FROM documents WHERE kind = 'source-note' AND text IS NOT NULL)",
        {"frontmatter-id-missing": "named IS NOT NULL", "frontmatter-id-mismatch": "named IS NULL OR source_id IS NULL OR named = source_id", "missing-source-status": "st IS NOT NULL", "missing-title": "title IS NOT NULL", "missing-source-section": "contains(text, '## Summary')", "source-note-too-large": f"strlen(text) <= {NOTE_BYTES}"}),
    _CASES("concepts", "stem", "SELECT * FROM concepts", {"missing-type": "type IS NOT NULL", "missing-concept-title": "title IS NOT NULL", "missing-tags": "len(coalesce(tags, [])) > 0", "missing-evidence-status": "evidence_status IS NOT NULL", "invalid-claim-quality": "claim_quality IN ('supported', 'provisional', 'conflicting', 'weak', 'stale')", "missing-updated": "updated IS NOT NULL", "conflicting-without-open-questions": "claim_quality <> 'conflicting' OR contains(body, '## Open Questions')", "page-too-long": f"len(string_split(coalesce(body, ''), chr(10))) <= {PAGE_LINES}"}),
    _CASES("answers", "key", "SELECT doc_id::VARCHAR AS key, * FROM documents WHERE kind = 'answer-memo' AND text IS NOT NULL", {"missing-answer-section": "contains(text, '## Answer')", "missing-vault-updates": "contains(text, '## Vault Updates')", "missing-answer-concept": "concept IS NOT NULL", "missing-answer-source": "source_id IS NOT NULL"}),
    _CASES("claims", "claim_id", "SELECT * FROM claims WHERE claim_id IS NOT NULL", {"claim-without-text": "claim_text IS NOT NULL", "claim-without-source": "len(coalesce(source_ids, [])) > 0", "supported-claim-without-anchor": "coalesce(claim_quality <> 'supported', true) OR len(coalesce(source_anchors, [])) > 0", "bare-anchor": "len(list_filter(coalesce(source_anchors, []), lambda a: coalesce(a.anchor, a.quote, a.section, a.path) IS NULL AND a.page IS NULL)) = 0"}),
    f"SELECT DISTINCT 'claims', claim_id, 'flagged-source-backs-supported-claim' FROM (SELECT claim_id, {_SRC.format('u')} AS sid FROM (SELECT claim_id, unnest(source_ids) AS u FROM claims WHERE claim_id IS NOT NULL AND claim_quality = 'supported')) WHERE sid IN (SELECT id FROM registry WHERE {_FOLD.format('source_status')} IN {_F})",
    "SELECT DISTINCT 'registry', id, 'missing-source-note' FROM registry WHERE id IS NOT NULL AND id NOT IN (SELECT source_id FROM documents WHERE kind = 'source-note' AND source_id IS NOT NULL)",
    "SELECT DISTINCT 'source-note', source_id, 'orphan-source-note' FROM documents WHERE kind = 'source-note' AND source_id IS NOT NULL AND source_id NOT IN (SELECT id FROM registry WHERE id IS NOT NULL)",
    "SELECT 'registry', id, 'duplicate-registry-id' FROM registry WHERE id IS NOT NULL GROUP BY id HAVING count(DISTINCT content_hash) > 1",
    "SELECT DISTINCT 'concepts', a, 'missing-link-target' FROM links WHERE b NOT IN (SELECT " + _KEY.format("stem") + " FROM concepts WHERE stem IS NOT NULL)",
]) + ")"
_LINT = _BASE.rstrip() + ", " + _LINT.removeprefix("WITH ")
_ONE = f"one AS (SELECT claim_id AS id, max({{{{'t': claim_text, 's': list_sort(list_distinct(list_filter(list_transform(coalesce(source_ids, []), lambda u: {_SRC.format('u')}), lambda x: x IS NOT NULL))), 'e': coalesce(evidence_status, '')}}}}) AS r FROM claims WHERE claim_id IS NOT NULL AND claim_text IS NOT NULL AND concept IS NOT NULL GROUP BY claim_id)".replace("{{", "{").replace("}}", "}")
_VECTORS = """w AS (SELECT id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}') AS w FROM texts), tf AS (SELECT id, term, count(*) / any_value(n) AS tf FROM (SELECT id, len(w) AS n, unnest(w) AS term FROM w) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), raw AS (SELECT id, term, tf * (ln(((SELECT count(*) FROM w) + 1) / (df + 1)) + 1) AS w FROM tf JOIN df USING (term)), norm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY id),
v AS (SELECT id, term, w / norm AS weight FROM raw JOIN norm USING (id)), cosine AS (SELECT x.id AS a, y.id AS b, round(sum(x.weight * y.weight), 6) AS cosine FROM v x JOIN v y ON x.term = y.term AND x.id < y.id GROUP BY ALL)"""
_YEARS = r"list_sort(list_distinct(list_transform(regexp_extract_all(' ' || regexp_replace(r.t, '\D', '\0\0', 'g') || ' ', '[^\d.-]((?:19|20)\d{2})[^\d.]', 1), lambda y: y)))"
_FRICTION = f""", texts AS (SELECT {_KEY.format('stem')} AS id, max(body) AS text FROM concepts WHERE stem IS NOT NULL GROUP BY 1), {_VECTORS},
jall AS (SELECT a, b, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM sh JOIN size x ON x.owner = a JOIN size y ON y.owner = b),
con AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, 0.1::DOUBLE AS bonus FROM (SELECT {_KEY.format('concept')} AS a, {_KEY.format(chr(114) + 'egexp_extract(t, ' + chr(39) + '([^/]+)$' + chr(39) + ', 1)')} AS b FROM (SELECT concept, unnest(flatten(map_values(page_edges))) AS t FROM claims WHERE concept IS NOT NULL AND regexp_matches(claim_text, '{proposals.CONTRAST}'))) WHERE a <> b),
fri AS (SELECT a, b, round(cosine * (1 - coalesce(jaccard, 0)) + coalesce(bonus, 0), 6) AS friction FROM (SELECT * FROM cosine WHERE cosine >= 0.2) LEFT JOIN jall USING (a, b) LEFT JOIN con USING (a, b) ANTI JOIN pairs USING (a, b)), friction AS (SELECT * FROM fri WHERE friction >= 0.3)
"""

SQL = {
    "page_claims": rf"""WITH b AS (SELECT doc_id, concept, list_filter(list_transform(string_split_regex(regexp_extract(text, '(?s)(?:\A|\n)## Key Claims[ \t]*\r?\n(.*?)(?:\n## |\z)', 1), '\r?\n'), lambda l: regexp_replace(trim(regexp_extract(l, '^\s*[-*]\s+(.*\S.*?)\s*$', 1)), '\s+', ' ', 'g')), lambda x: x <> '') AS b FROM documents WHERE kind = 'concept-page' AND doc_id IS NOT NULL AND concept IS NOT NULL AND text IS NOT NULL),
r AS (SELECT doc_id, concept, i, b[i] AS raw FROM (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM b)) SELECT doc_id, (i - 1)::INTEGER AS claim_index, 'clm-' || substr(sha256(concept || ':' || {_PLAIN.format('raw')}), 1, 10) AS claim_id, {_PLAIN.format('raw')} AS claim_text, len(regexp_extract_all(raw, '{_LINK}'))::INTEGER AS n_links FROM r""",
    "source_links": rf"""WITH c AS (SELECT DISTINCT claim_id, unnest(source_ids) AS u FROM claims WHERE claim_id IS NOT NULL), m AS (SELECT claim_id, u, unnest(regexp_extract_all(u, '{_LINK}')) AS m FROM c WHERE u IS NOT NULL),
p AS (SELECT claim_id, regexp_extract(m, 'src-[0-9a-f]{{10}}') AS source_id, nullif(regexp_extract(m, 'src-[0-9a-f]{{10}}(?:\.md)?#([^\]|)]*)', 1), '') AS anchor FROM m) SELECT claim_id, source_id, anchor, 1::BIGINT AS n FROM p GROUP BY ALL""",
    "anchor_fields": "WITH a AS (SELECT DISTINCT anchor FROM (SELECT unnest(source_anchors).anchor AS anchor FROM claims) WHERE anchor IS NOT NULL), s AS (SELECT anchor, regexp_replace(anchor, '^#+|[.,;)]+$', '', 'g') AS x FROM a) SELECT anchor, "
    + f"{_NUM('page')} AS page, {_NUM('paragraph')} AS paragraph, {_NAM('section')} AS section, {_NAM('quote')} AS quote, {_NAM('path')} AS path, {_NAM('commit')} AS commit, coalesce(try_cast({_PART('L([0-9]+)(?:=L[0-9]+)?')} AS INTEGER), {_NUM('(?:line_start|L)')}) AS line_start, coalesce(try_cast({_PART('L[0-9]+=L([0-9]+)')} AS INTEGER), {_NUM('line_end')}) AS line_end, coalesce({_NAM('(?:segment_id|segment)')}, {_PART('(seg-[^&=]*)')}) AS segment_id, try_cast({_NAM('extraction_confidence')} AS DOUBLE) AS extraction_confidence FROM s",
    "document_titles": r"""WITH t AS (SELECT doc_id, nullif(trim(regexp_extract(text, '(?m)^#[ \t]+(.*\S)[ \t]*\r?$', 1)), '') AS title, list_filter(list_transform(string_split_regex(regexp_replace(text, '(?s)\A---\r?\n.*?\r?\n---(?:\r?\n|\z)', ''), '\r?\n[ \t]*\r?\n'), lambda p: trim(regexp_replace(p, '[ \t\r\n]+', ' ', 'g'))), lambda p: regexp_matches(p, '^[^#*|`>\s-]'))[1] AS p FROM documents WHERE text IS NOT NULL)
SELECT doc_id, title, sha256(substr(p, 1, 280)) AS summary_hash FROM t WHERE title IS NOT NULL OR p IS NOT NULL""",
    "registry_forms": rf"SELECT id, coalesce(nullif(regexp_extract(ingested_at, '(?:^|\D)((?:19|20)\d\d)(?:\D|$)', 1), ''), nullif(regexp_extract(ingested_at, '^((?:19|20)\d\d)', 1), ''), 'Unknown') AS year, CASE coalesce(source_kind, '') " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pages.KINDS.items()) + f" WHEN '' THEN coalesce(source_kind, 'local-file') ELSE source_kind END AS kind, array_to_string([x FOR x IN [trim(tier), CASE WHEN trim(evidence_strength) IS DISTINCT FROM trim(tier) THEN trim(evidence_strength) END, CASE WHEN trim(source_kind) IS DISTINCT FROM trim(tier) AND trim(source_kind) IS DISTINCT FROM trim(evidence_strength) THEN trim(source_kind) END] IF x <> '' AND lower(x) NOT IN ('unknown', 'none', 'null')], '|') AS names FROM {_LATEST}",
    "concept_tags": "SELECT stem, array_to_string(list_sort(list_distinct(list_filter(list_concat(list_transform(list_filter(list_transform(coalesce(tags, []), lambda t: trim(t)), lambda t: t <> ''), lambda t: CASE WHEN t = type THEN 'vault/' || type ELSE t END), ['vault/' || type]), lambda t: t IS NOT NULL))), ',') AS tags FROM concepts",
    "feed_objects": r"WITH f AS (SELECT payload, trim(payload) AS w, regexp_extract(payload, '(?s)\{.*\}') AS p FROM claim_feed) SELECT CASE WHEN payload IS NULL THEN 'null' WHEN json_valid(w) AND starts_with(w, '{') THEN 'whole' WHEN p <> '' AND json_valid(p) THEN 'salvaged' ELSE 'none' END AS state, count(*) AS n FROM f GROUP BY 1",
    "knowledge_nodes": _NODES + " SELECT * FROM n",
    "knowledge_edges": _NODES + f", e AS ({_EDGES}) SELECT DISTINCT relation, a, b FROM e WHERE a IN (SELECT node FROM n) AND b IN (SELECT node FROM n)",
    "lint_findings": _LINT + " SELECT * FROM found",
    "lint_counts": _LINT + " SELECT table_name, issue, count(*) AS n FROM found GROUP BY ALL",
    "duplicate_proposals": f"WITH {_ONE}, texts AS (SELECT id, r.t AS text FROM one), {_VECTORS}, m AS (SELECT a, b, cosine, x.r.s IS DISTINCT FROM y.r.s AS ds, x.y IS DISTINCT FROM y.y AS dt, x.r.e IS DISTINCT FROM y.r.e AS de, list_max(x.y) AS ya, list_max(y.y) AS yb FROM cosine JOIN (SELECT id, r, {_YEARS} AS y FROM one) x ON x.id = a JOIN (SELECT id, r, {_YEARS} AS y FROM one) y ON y.id = b WHERE cosine >= 0.9), k AS (SELECT *, array_to_string(list_filter([CASE WHEN ds THEN 'scope' END, CASE WHEN dt THEN 'time' END, CASE WHEN de THEN 'evidence' END], lambda x: x IS NOT NULL), ',') AS dims FROM m), o AS (SELECT *, dims = 'time' AND coalesce(ya <> yb, false) AS ord FROM k) SELECT CASE WHEN ord AND yb > ya THEN b ELSE a END AS a, CASE WHEN ord AND yb > ya THEN a ELSE b END AS b, CASE WHEN dims = '' THEN 'merge' WHEN ord THEN 'supersede' ELSE 'needs-review' END AS kind, dims, cosine AS similarity FROM o",
    "rename_proposals": "WITH n AS (SELECT name, CASE WHEN k LIKE '%s' AND length(k) > 3 THEN left(k, length(k) - 1) ELSE k END AS k FROM (SELECT DISTINCT concept AS name, regexp_replace(lower(concept), '[^a-z0-9]+', '', 'g') AS k FROM claims WHERE concept <> '')) SELECT name AS alias, target FROM (SELECT name, min(name) OVER (PARTITION BY k) AS target FROM n WHERE k <> '') WHERE name <> target",
    "archive_proposals": "SELECT DISTINCT * FROM (SELECT claim_id AS id, array_to_string(list_filter([CASE WHEN lower(claim_quality) IN ('stale', 'outdated', 'deprecated') THEN 'claim_quality=' || lower(claim_quality) END, CASE WHEN lower(status) IN ('stale', 'archived', 'superseded', 'retired') THEN 'status=' || lower(status) END], lambda x: x IS NOT NULL), '; ') AS reasons FROM claims WHERE claim_id IS NOT NULL) WHERE reasons <> ''",
    "friction_pairs": _BASE + _FRICTION + "SELECT * FROM friction",
    "link_report": _BASE + _FRICTION + """, d2 AS (SELECT a, b FROM wedge ANTI JOIN pairs USING (a, b)), d2b AS (SELECT a AS node, b AS other FROM d2 UNION ALL SELECT b, a FROM d2), d3 AS (SELECT DISTINCT x.node AS a, y.other AS b FROM d2b x JOIN two y ON x.other = y.node WHERE x.node < y.other),
far AS (SELECT a, b, 4.0::DOUBLE AS q FROM d2 UNION ALL SELECT a, b, 9.0::DOUBLE FROM (SELECT * FROM d3 ANTI JOIN pairs USING (a, b)) t ANTI JOIN d2 USING (a, b)), grav AS (SELECT a, b, x.d * y.d / q AS score FROM far JOIN deg x ON x.node = a JOIN deg y ON y.node = b WHERE x.d * y.d / q >= 0.5),
named AS (SELECT x.b AS a, y.b AS b, count(*)::DOUBLE AS score FROM links x JOIN links y ON x.a = y.a AND x.b < y.b WHERE x.a <> x.b AND y.a <> y.b GROUP BY ALL HAVING count(*) >= 2), ana AS (SELECT a, b, round(wedges / (x.d + y.d - wedges), 6) AS score FROM wedge JOIN deg x ON x.node = a JOIN deg y ON y.node = b),
s AS (SELECT 'co-citation' AS approach, * FROM named ANTI JOIN pairs USING (a, b) UNION ALL SELECT 'shared-sources', a, b, shared::DOUBLE FROM sh ANTI JOIN pairs USING (a, b) WHERE shared >= 2 UNION ALL SELECT 'conceptual-gravity', * FROM grav UNION ALL SELECT 'analogical-mapping', * FROM ana ANTI JOIN pairs USING (a, b) WHERE score >= 0.25 UNION ALL SELECT 'triadic-closure', a, b, wedges::DOUBLE FROM tri UNION ALL SELECT 'friction', * FROM friction),
top AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY approach ORDER BY score DESC, a, b) <= 50) SELECT a, b, count(DISTINCT approach) AS n_signals, max(score) AS best, array_to_string(list_sort(list_distinct(list(approach))), ',') AS approaches FROM top GROUP BY a, b""",
    "retention_lowest": f"WITH c AS (SELECT claim_id, {_DAY.format('last_updated')} AS day, claim_quality FROM claims WHERE claim_id IS NOT NULL), l AS (SELECT * FROM c WHERE day IS NOT NULL QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY day DESC, claim_quality DESC NULLS LAST) = 1) SELECT claim_id, round(pow(0.5, greatest(0, date_diff('day', day, DATE '2026-06-30')) / (CASE WHEN claim_quality = 'supported' THEN 365 WHEN claim_quality IN ('provisional', 'conflicting') THEN 120 WHEN claim_quality IN ('weak', 'stale') THEN 45 ELSE 180 END)), 6) AS score FROM l ORDER BY score, claim_id LIMIT 30",
}
