"""Queries about stale records, queues, segments, plans and memoised judgements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.keys import folded, source_key, spelling_key
from ledgerloom.operators import clauses, notes, segments, snapshots, upkeep, verification
from ledgerloom.plans import answers
from ledgerloom.plans.general import _P2
from ledgerloom.plans.knowledge import FLAGGED, _texts, latest_registry
from ledgerloom.plans.knowledge_sql import _FOLD, _KEY, _LATEST, _LINES, _SRC, FLAGGED as _F
from ledgerloom.plans.segmentation import _HEAD
from ledgerloom.sources.tables import table

PROBES, QUEUE = 5, 200


def compound_claims(s, d):
    """Why claims are compound and how many statements they split into."""
    c = table(s, d, "claims").where("claim_id IS NOT NULL AND claim_text IS NOT NULL").select("claim_id", "claim_text").distinct()
    return c.select("claim_id", F.array_join(clauses.categories(F.col("claim_text")), ",").alias("categories"), F.size(clauses.statements(F.col("claim_text"))).alias("n_statements")).where("categories <> ''").distinct()


def split_proposals(s, d):
    """Compound claims and the statements they split into."""
    c = table(s, d, "claims").where("claim_id IS NOT NULL AND claim_text IS NOT NULL").select("claim_id", "claim_text").distinct()
    return c.select("claim_id", F.posexplode(clauses.statements(F.col("claim_text"))).alias("i", "piece")).select("claim_id", (F.col("i") + 1).alias("place"), "piece").distinct()


def _changes(s, d):
    return snapshots.snapshot_changes(table(s, d, "snapshot_state"), table(s, d, "snapshot_log")).where("change = 'changed'").select(F.col("snapshot").alias("version"), F.col("id").alias("source_id"))


def _rests(s, d):
    c = table(s, d, "claims").where("claim_id IS NOT NULL")
    edge = lambda df, f, t: df.where("a IS NOT NULL AND b IS NOT NULL").select(F.lit(f).alias("from_type"), "a", F.lit(t).alias("to_type"), "b")
    cited = c.select(F.explode("source_ids").alias("u"), F.col("claim_id").alias("b")).select(source_key(F.col("u")).alias("a"), "b")
    page = c.where("concept IS NOT NULL").select(F.col("claim_id").alias("a"), spelling_key(F.col("concept")).alias("b"))
    memo = table(s, d, "documents").where("kind = 'answer-memo' AND concept IS NOT NULL").select(spelling_key(F.col("concept")).alias("a"), F.col("doc_id").cast("string").alias("b"))
    return edge(cited, "source", "claim").unionByName(edge(page, "claim", "concept")).unionByName(edge(memo, "concept", "answer"))


def invalidation_targets(s, d):
    """What the changed sources of every snapshot make stale, by kind of target."""
    return upkeep.stale_counts(_changes(s, d), _rests(s, d))


def stale_set(s, d):
    """Targets that are stale by the latest change and not yet resolved: those no later snapshot's change covers keep their last version."""
    t = upkeep.stale_targets(_changes(s, d), _rests(s, d))
    return t.groupBy("target_type", "target").agg(F.max("version").alias("version"), F.count_distinct("source_id").alias("n_sources")).where("target_type <> 'answer'")


def pending_events(s, d):
    """Stale events of the last version of each claim that the ledger of earlier versions does not hold."""
    t = upkeep.stale_targets(_changes(s, d), _rests(s, d)).where("target_type = 'claim'").select("target", "version").distinct()
    last = t.agg(F.max("version").alias("v"))
    ledger = t.join(F.broadcast(last), F.col("version") < F.col("v")).select("target").distinct()
    return upkeep.not_yet_emitted(t, ledger, ["target"])


def review_queue(s, d):
    """The first two hundred things to review, worst first."""
    claims, probes = table(s, d, "claims"), table(s, d, "dev_probes")
    quotes = answers.quote_verification(s, d)
    flagged = latest_registry(s, d).where(F.coalesce(folded(F.col("source_status")).isin(*FLAGGED), F.lit(False))).select(F.col("id").alias("source_id"))
    blocked = claims.select(F.col("claim_id").alias("ref"), F.explode("source_ids").alias("u")).select("ref", source_key(F.col("u")).alias("source_id")).join(flagged, "source_id", "left_semi")
    of = lambda df, c: df.select(F.col(c).alias("ref"))
    return upkeep.review_queue({
        "failed-quote-span": ("error", of(quotes.where("status = 'failed'"), "claim_id")), "unverifiable-quote-span": ("warning", of(quotes.where("status = 'unverifiable'"), "claim_id")), "blocked-claim": ("error", of(blocked, "ref")),
        "unsupported-claim": ("warning", of(claims.where(F.size(F.coalesce("source_ids", F.array().cast("array<string>"))) == 0), "claim_id")), "unreviewed-probe": ("info", of(probes.where("coalesce(review_status, 'unreviewed') = 'unreviewed'"), "id")),
    }, QUEUE)


def next_action(s, d):
    """The first thing to review."""
    return review_queue(s, d).where("rank = 1").select("severity", "category", "ref")


def segment_nodes(s, d):
    docs = table(s, d, "documents").select("doc_id", "text")
    return upkeep.segment_nodes(segments.section_spans(docs), docs)


def block_segments(s, d):
    """Tables and figures in documents and quotes."""
    return upkeep.block_segments(notes.lines(_texts(s, d).distinct()).distinct()).distinct()


def compile_budgets(s, d):
    """Documents by what summarising them takes."""
    docs = table(s, d, "documents").select("doc_id", F.coalesce("kind", F.lit("unknown")).alias("kind"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    sections = notes.headings(table(s, d, "documents")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"))
    b = docs.join(sections, "doc_id", "left")
    return b.select("kind", *(c.alias(n) for n, c in upkeep.compile_budget(F.col("n"), F.coalesce("sections", F.lit(0))).items())).groupBy("kind", "budget").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), F.sum("parent_tokens").alias("parent_tokens"))


def compile_plan(s, d):
    """Registered sources to summarise (no note), to review (a note, flagged) or to skip."""
    noted = table(s, d, "documents").where("kind = 'source-note' AND source_id IS NOT NULL").select(F.col("source_id").alias("id"), F.lit(1).alias("noted")).distinct()
    bad = F.coalesce(folded(F.col("source_status")).isin(*FLAGGED), F.lit(False))
    plan = F.when(F.col("noted").isNull() & ~bad, "to_summarize").when(bad, "flag_for_review").otherwise("skip")
    return latest_registry(s, d).join(noted, "id", "left").select("id", plan.alias("plan"))


def judge_misses(s, d):
    """Claim and quote pairs that need judging: those whose fingerprint no earlier, active claim has."""
    c = table(s, d, "claims").where("claim_text IS NOT NULL AND quote IS NOT NULL").select("claim_id", "status", upkeep.fingerprint(F.lit("judge:v1"), F.col("claim_text"), F.col("quote")).alias("fingerprint"))
    return upkeep.misses(c.select("fingerprint"), c.where("status = 'active'").select("fingerprint"))


def grader_drift(s, d):
    """Documents on which the first and the last grading differ."""
    g = table(s, d, "level_labels").where("doc_id IS NOT NULL AND level IS NOT NULL").select(F.col("doc_id").alias("id"), "grader", F.col("level").cast("string").alias("verdict"))
    ends = g.groupBy("id").agg(F.min(F.struct("grader", "verdict")).alias("x"), F.max(F.struct("grader", "verdict")).alias("y"))
    return upkeep.run_drift(ends.select("id", F.col("x.verdict").alias("verdict")), ends.select("id", F.col("y.verdict").alias("verdict")))


def probe_selection(s, d):
    """Five probes of every type, chosen by hash."""
    p = table(s, d, "dev_probes").where("question IS NOT NULL").select(F.coalesce("type", F.lit("unknown")).alias("type"), "id")
    return upkeep.chosen_by_hash(p, "type", "id", PROBES)


def _probe_facts(s, d):
    p = table(s, d, "dev_probes").where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("concept", "source_id", "expected_answer")).alias("r"))
    return p.select("id", spelling_key(F.col("r.concept")).alias("concept"), F.col("r.source_id").alias("source_id"), F.filter(F.coalesce("r.expected_answer", F.array().cast("array<string>")), lambda x: x.isNotNull()).alias("facts")).where(F.size("facts") > 0)


def probe_modes(s, d):
    """How many probes find their facts in the concept page alone and in the documents of their source alone."""
    p = _probe_facts(s, d)
    held = lambda: F.forall("facts", lambda f: verification.fact_present(f, F.col("text")))
    page = table(s, d, "concepts").select(spelling_key(F.col("stem")).alias("concept"), F.col("body").alias("text"))
    docs = table(s, d, "documents").where("text IS NOT NULL").select("source_id", "text").distinct()
    concept = p.join(page, "concept").select("id", held().alias("ok")).groupBy("id").agg(F.max("ok").alias("concept_ok"))
    source = p.join(docs, "source_id").select("id", held().alias("ok")).groupBy("id").agg(F.max("ok").alias("source_ok"))
    both = p.select("id").join(concept, "id", "left").join(source, "id", "left")
    return both.agg(F.count(F.lit(1)).alias("n_probes"), F.count_if(F.coalesce("concept_ok", F.lit(False))).alias("n_concept"), F.count_if(F.coalesce("source_ok", F.lit(False))).alias("n_source"))


def source_mentions(s, d):
    """Source ids that texts mention, whether they are registered, and in how many documents."""
    m = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("src-[0-9a-f]{10}"), F.lit(0)))).alias("source_id"))
    reg = table(s, d, "registry").where("id IS NOT NULL").select(F.col("id").alias("source_id"), F.lit(True).alias("registered")).distinct()
    return m.groupBy("source_id").agg(F.count_distinct("doc_id").alias("n_documents")).join(reg, "source_id", "left").select("source_id", "n_documents", F.coalesce("registered", F.lit(False)).alias("registered"))


def commit_drift(s, d):
    """Anchors pinned to another commit than the latest one cited for their source."""
    a = table(s, d, "claims").where("claim_id IS NOT NULL").select("claim_id", F.explode("source_anchors").alias("a")).select("claim_id", source_key(F.col("a.source_id")).alias("source_id"), F.col("a.commit").alias("commit")).where("source_id IS NOT NULL AND commit IS NOT NULL").distinct()
    heads = a.groupBy("source_id").agg(F.max("commit").alias("head"))
    return a.join(heads, "source_id").select("claim_id", "source_id", "commit", F.when(F.col("commit") == F.col("head"), "current").otherwise("drifted").alias("state"))


def argument_map(s, d):
    """The page edges between claims' concepts as lines of a diagram, numbered by concept."""
    from pyspark.sql import Window

    from ledgerloom.plans.links import page_links

    e = page_links(s, d)
    line = F.concat(F.replace("a", F.lit(" "), F.lit("_")), F.lit(" -->|"), F.col("relation"), F.lit("| "), F.replace("b", F.lit(" "), F.lit("_")))
    return e.select("a", F.row_number().over(Window.partitionBy("a").orderBy("relation", "b")).alias("place"), line.alias("line"))


def index_entries(s, d):
    """The entries of the index pages by title, year, kind and tag, a row each."""
    r = latest_registry(s, d)
    from ledgerloom.operators.pages import year_of

    letter = F.when(F.upper(F.substring("title", 1, 1)).rlike("[A-Z]"), F.upper(F.substring("title", 1, 1))).otherwise("#")
    row = lambda df, page, section, entry: df.select(F.lit(page).alias("page"), section.alias("section"), entry.alias("entry"))
    tags = table(s, d, "concepts").select("stem", F.explode_outer("tags").alias("tag"))
    return row(r.where("title IS NOT NULL AND title <> ''"), "title", letter, F.col("id")).unionByName(row(r, "year", year_of(F.col("ingested_at")), F.col("id"))).unionByName(row(r, "kind", F.coalesce("source_kind", F.lit("unknown")), F.col("id"))).unionByName(row(tags, "tag", F.coalesce("tag", F.lit("untagged")), F.col("stem"))).distinct()


QUERIES = {f.__name__: f for f in (compound_claims, split_proposals, invalidation_targets, stale_set, pending_events, review_queue, next_action, segment_nodes, block_segments, compile_budgets, compile_plan, judge_misses, grader_drift, probe_selection, probe_modes, source_mentions, commit_drift, argument_map, index_entries)}

_VERBS = "[" + ", ".join(f"'{v}'" for v in clauses.VERBS) + "]"
_TOK = r"list_filter(list_transform(string_split_regex({0}, '\s+'), lambda w: lower(regexp_replace(w, '[^\w%$-]', '', 'g'))), lambda w: w <> '')"
_COMPOUND = rf"""
WITH c AS (SELECT DISTINCT claim_id, claim_text AS raw, trim(claim_text) AS t FROM claims WHERE claim_id IS NOT NULL AND claim_text IS NOT NULL),
p AS (SELECT *, list_filter(list_transform(string_split_regex(t, '{clauses.SEPARATOR}'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM c),
k AS (SELECT claim_id, raw, t, CASE WHEN len(ps) >= 2 AND len(list_filter(ps, lambda x: NOT list_has_any(({_TOK.format('x')})[2:], {_VERBS}))) = 0 THEN ps ELSE [] END AS cl,
len(list_distinct(list_concat(regexp_extract_all(t, '\b((?:19|20)\d{{2}})\b', 1), regexp_extract_all(lower(t), '\b({clauses.TIMES})\b', 1)))) >= 2 AS tm,
regexp_matches(t, '{clauses.COMPARES}') OR len(list_filter(regexp_extract_all(t, '{clauses.ER_THAN}', 1), lambda w: lower(w) NOT IN {clauses.NOT_ER})) > 0 AS cmp, regexp_matches(t, '{clauses.CAUSES}') AS cau, regexp_matches(t, '{clauses.ADVICE}') AS adv FROM p),
w AS (SELECT *, list_filter([CASE WHEN len(cl) > 0 THEN 'multi-predicate' END, CASE WHEN tm THEN 'mixed-temporal' END, CASE WHEN cmp AND cau THEN 'comparison-causal' END, CASE WHEN adv AND (cau OR len(cl) > 0) THEN 'recommendation-fact' END], lambda x: x IS NOT NULL) AS why,
regexp_replace(t, '{clauses.CAUSE_SPLIT}', chr(1)) AS cs FROM k),
z AS (SELECT *, list_filter(list_transform(string_split(cs, chr(1)), lambda x: trim(x)), lambda x: x <> '') AS cp FROM w),
b AS (SELECT claim_id, why, list_transform(CASE WHEN len(cl) > 0 THEN cl WHEN list_has_any(why, ['comparison-causal', 'recommendation-fact']) AND len(cp) = 2 THEN cp ELSE [] END, lambda x: trim(regexp_replace(regexp_replace(x, '^[\s,;:]+|[\s,;:]+$', '', 'g'), '{clauses.LEADING}', ''))) AS bare FROM z),
s AS (SELECT claim_id, why, CASE WHEN len(list_filter(bare, lambda x: len({_TOK.format('x')}) < 2 OR NOT list_has_any({_TOK.format('x')}, {_VERBS}))) = 0 THEN list_transform(bare, lambda x: upper(substr(x, 1, 1)) || substr(x, 2) || CASE WHEN regexp_matches(x, '[.!?]$') THEN '' ELSE '.' END) ELSE [] END AS st FROM b)
"""
_STALE = _P2.rstrip() + f""", ch AS (SELECT DISTINCT snapshot AS version, id AS source_id FROM changes WHERE change = 'changed'),
cit AS (SELECT DISTINCT {_SRC.format('u')} AS a, claim_id AS b FROM (SELECT claim_id, unnest(source_ids) AS u FROM claims WHERE claim_id IS NOT NULL)), pag AS (SELECT DISTINCT claim_id AS a, {_KEY.format('concept')} AS b FROM claims WHERE claim_id IS NOT NULL AND concept IS NOT NULL), mem AS (SELECT DISTINCT {_KEY.format('concept')} AS a, doc_id::VARCHAR AS b FROM documents WHERE kind = 'answer-memo' AND concept IS NOT NULL),
t1 AS (SELECT DISTINCT version, source_id, b AS target FROM ch JOIN cit ON a = source_id), t2 AS (SELECT DISTINCT version, source_id, b AS target FROM t1 JOIN pag ON a = target), t3 AS (SELECT DISTINCT version, source_id, b AS target FROM t2 JOIN mem ON a = target),
st AS (SELECT version, source_id, 'claim' AS target_type, target FROM t1 UNION ALL SELECT version, source_id, 'concept', target FROM t2 UNION ALL SELECT version, source_id, 'answer', target FROM t3)
"""
_QUEUE = answers._QUOTES.rstrip() + f""", f AS (SELECT DISTINCT * FROM (SELECT 'error' AS severity, 'failed-quote-span' AS category, claim_id AS ref FROM v WHERE status = 'failed' UNION ALL SELECT 'warning', 'unverifiable-quote-span', claim_id FROM v WHERE status = 'unverifiable'
UNION ALL SELECT 'error', 'blocked-claim', claim_id FROM (SELECT claim_id, {_SRC.format('u')} AS sid FROM (SELECT claim_id, unnest(source_ids) AS u FROM claims)) WHERE sid IN (SELECT id FROM {_LATEST} WHERE {_FOLD.format('source_status')} IN {_F})
UNION ALL SELECT 'warning', 'unsupported-claim', claim_id FROM claims WHERE len(coalesce(source_ids, [])) = 0 UNION ALL SELECT 'info', 'unreviewed-probe', id FROM dev_probes WHERE coalesce(review_status, 'unreviewed') = 'unreviewed') WHERE ref IS NOT NULL),
q AS (SELECT row_number() OVER (ORDER BY list_position(['error', 'warning', 'info'], severity), category, ref) AS rank, * FROM f)
""".replace(", f AS (SELECT DISTINCT", ", fi AS (SELECT DISTINCT", 1).replace("FROM f)", "FROM fi)")
_FACTS = f"p AS (SELECT id, {_KEY.format('concept')} AS concept, source_id, list_filter(coalesce(expected_answer, []), lambda x: x IS NOT NULL) AS facts FROM dev_probes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY concept DESC NULLS LAST, source_id DESC NULLS LAST, expected_answer DESC NULLS LAST) = 1)"
_OK = f"len(list_filter(facts, lambda f: NOT (len({answers._CW.format('f')}) = 0 OR len(list_filter({answers._CW.format('f')}, lambda w: contains(lower(text), w))) / len({answers._CW.format('f')}) >= 0.55))) = 0"
_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(lower(title), '{p}') THEN '{n}'" for n, p in upkeep.SECTION_TYPES) + " ELSE 'heading' END"
_ANCHOR = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(title)), '^[a-z]+:\\s*', ''), '[^a-z0-9 -]', '', 'g'), '[ -]+', '-', 'g'), '^-+|-+$', '', 'g')"

SQL = {
    "compound_claims": _COMPOUND + "SELECT DISTINCT claim_id, array_to_string(why, ',') AS categories, len(st)::INTEGER AS n_statements FROM s WHERE len(why) > 0",
    "split_proposals": _COMPOUND + "SELECT DISTINCT claim_id, i::INTEGER AS place, st[i] AS piece FROM (SELECT claim_id, st, unnest(range(1, len(st) + 1)) AS i FROM s)",
    "invalidation_targets": _STALE + "SELECT version, source_id, target_type, count(*) AS n, min(target) AS first FROM st GROUP BY ALL",
    "stale_set": _STALE + "SELECT target_type, target, max(version) AS version, count(DISTINCT source_id) AS n_sources FROM st WHERE target_type <> 'answer' GROUP BY ALL",
    "pending_events": _STALE + ", e AS (SELECT DISTINCT target, version FROM t1) SELECT target, version FROM e WHERE version = (SELECT max(version) FROM e) AND target NOT IN (SELECT target FROM e WHERE version < (SELECT max(version) FROM e))",
    "review_queue": _QUEUE + f"SELECT * FROM q WHERE rank <= {QUEUE}",
    "next_action": _QUEUE + "SELECT severity, category, ref FROM q WHERE rank = 1",
    "segment_nodes": _HEAD + f""", sp AS (SELECT h.doc_id, h.line_no, h.level, h.title, h.start, coalesce(min(n.start), any_value(length(d.text))) AS e FROM h JOIN documents d USING (doc_id) LEFT JOIN h n ON n.doc_id = h.doc_id AND n.line_no > h.line_no AND n.level <= h.level GROUP BY ALL),
a AS (SELECT doc_id, line_no, level, {_TYPE} AS type, left(CASE WHEN {_ANCHOR} = '' THEN 'node-' ELSE {_ANCHOR} END, 60) AS anchor, start, e FROM sp UNION ALL SELECT doc_id, 0, 0, 'document', 'document', 0, length(text) FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM sp)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, anchor ORDER BY line_no) AS n FROM a) SELECT n.doc_id, CASE WHEN n.n = 1 THEN anchor ELSE anchor || '-' || (n.n - 1) END AS node_id, type, anchor, level::INTEGER AS level, start::INTEGER AS start, e::INTEGER AS "end", substr(sha256(substr(text, (start + 1)::BIGINT, (e - start)::BIGINT)), 1, 10) AS content_hash FROM n JOIN documents d USING (doc_id)""",
    "block_segments": f"WITH docs AS (SELECT DISTINCT * FROM (SELECT doc_id::VARCHAR AS doc_id, text FROM documents UNION ALL SELECT claim_id, quote FROM claims)), l AS (SELECT DISTINCT * FROM ({_LINES.replace(chr(70) + 'ROM documents', chr(70) + 'ROM docs')})), m AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '^\\s*\\||\\|.*\\|') THEN 'table' WHEN regexp_matches(line, '^\\s*!\\[|^(?i:figure|fig\\.)\\s+\\d+') THEN 'figure' END AS kind FROM l), r AS (SELECT *, CASE WHEN kind = 'table' THEN line_no - row_number() OVER (PARTITION BY doc_id, kind ORDER BY line_no) ELSE line_no END AS run FROM m WHERE kind IS NOT NULL) SELECT doc_id, kind, min(line_no)::INTEGER AS first_line, max(line_no)::INTEGER AS last_line FROM r GROUP BY doc_id, kind, run",
    "compile_budgets": _HEAD + ", b AS (SELECT coalesce(kind, 'unknown') AS kind, greatest(1, length(coalesce(text, '')) // 4) AS tokens, 500 * coalesce(n, 0) + 1000 AS parent_tokens FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM h GROUP BY 1) USING (doc_id)) SELECT kind, CASE WHEN tokens + parent_tokens >= 1000000 THEN 'refuse' WHEN tokens + parent_tokens >= 500000 THEN 'warn' ELSE 'ok' END AS budget, count(*) AS n, sum(tokens)::BIGINT AS tokens, sum(parent_tokens)::BIGINT AS parent_tokens FROM b GROUP BY ALL",
    "compile_plan": f"SELECT id, CASE WHEN coalesce({_FOLD.format('source_status')} IN {_F}, false) THEN 'flag_for_review' WHEN id NOT IN (SELECT source_id FROM documents WHERE kind = 'source-note' AND source_id IS NOT NULL) THEN 'to_summarize' ELSE 'skip' END AS plan FROM {_LATEST}",
    "judge_misses": "WITH c AS (SELECT status, sha256('judge:v1' || chr(10) || claim_text || chr(10) || quote) AS fingerprint FROM claims WHERE claim_text IS NOT NULL AND quote IS NOT NULL) SELECT DISTINCT fingerprint FROM c WHERE fingerprint NOT IN (SELECT fingerprint FROM c WHERE status = 'active')",
    "grader_drift": "WITH g AS (SELECT doc_id AS id, grader, level::VARCHAR AS v FROM level_labels WHERE doc_id IS NOT NULL AND level IS NOT NULL), e AS (SELECT id, min({'g': grader, 'v': v}).v AS was, max({'g': grader, 'v': v}).v AS now FROM g GROUP BY id) SELECT id, was, now, 'changed' AS change FROM e WHERE was <> now",
    "probe_selection": f"WITH p AS (SELECT DISTINCT coalesce(type, 'unknown') AS type, id FROM dev_probes WHERE question IS NOT NULL AND id IS NOT NULL) SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY md5(id), id) AS rank FROM p QUALIFY rank <= {PROBES}",
    "probe_modes": f"WITH {_FACTS}, x AS (SELECT * FROM p WHERE len(facts) > 0), c AS (SELECT id, bool_or({_OK}) AS ok FROM x JOIN (SELECT {_KEY.format('stem')} AS concept, body AS text FROM concepts) USING (concept) GROUP BY id), s AS (SELECT id, bool_or({_OK}) AS ok FROM x JOIN (SELECT DISTINCT source_id, text FROM documents WHERE text IS NOT NULL) USING (source_id) GROUP BY id) SELECT count(*) AS n_probes, count(*) FILTER (WHERE c.ok) AS n_concept, count(*) FILTER (WHERE s.ok) AS n_source FROM x LEFT JOIN c USING (id) LEFT JOIN s USING (id)",
    "source_mentions": "WITH m AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, 'src-[0-9a-f]{10}')) AS source_id FROM documents WHERE text IS NOT NULL) SELECT source_id, count(DISTINCT doc_id) AS n_documents, source_id IN (SELECT id FROM registry WHERE id IS NOT NULL) AS registered FROM m GROUP BY source_id",
    "commit_drift": f"WITH a AS (SELECT DISTINCT claim_id, {_SRC.format('a.source_id')} AS source_id, a.commit AS commit FROM (SELECT claim_id, unnest(source_anchors) AS a FROM claims WHERE claim_id IS NOT NULL)), k AS (SELECT * FROM a WHERE source_id IS NOT NULL AND commit IS NOT NULL) SELECT claim_id, source_id, commit, CASE WHEN commit = max(commit) OVER (PARTITION BY source_id) THEN 'current' ELSE 'drifted' END AS state FROM k",
    "argument_map": f"""WITH e AS (SELECT DISTINCT relation, a, {_KEY.format("regexp_extract(t, '([^/]+)$', 1)")} AS b FROM (SELECT a, x.key AS relation, unnest(x.value) AS t FROM (SELECT {_KEY.format('concept')} AS a, unnest(map_entries(page_edges)) AS x FROM claims WHERE concept IS NOT NULL)) WHERE t IS NOT NULL) SELECT a, row_number() OVER (PARTITION BY a ORDER BY relation, b) AS place, replace(a, ' ', '_') || ' -->|' || relation || '| ' || replace(b, ' ', '_') AS line FROM e WHERE a <> '' AND b <> ''""",
    "index_entries": rf"SELECT DISTINCT * FROM (SELECT 'title' AS page, CASE WHEN regexp_matches(upper(substr(title, 1, 1)), '[A-Z]') THEN upper(substr(title, 1, 1)) ELSE '#' END AS section, id AS entry FROM {_LATEST} WHERE title <> '' UNION ALL SELECT 'year', coalesce(nullif(regexp_extract(ingested_at, '(?:^|\D)((?:19|20)\d\d)(?:\D|$)', 1), ''), nullif(regexp_extract(ingested_at, '^((?:19|20)\d\d)', 1), ''), 'Unknown'), id FROM {_LATEST} UNION ALL SELECT 'kind', coalesce(source_kind, 'unknown'), id FROM {_LATEST} UNION ALL SELECT 'tag', coalesce(tag, 'untagged'), stem FROM (SELECT stem, unnest(CASE WHEN len(coalesce(tags, [])) = 0 THEN [NULL] ELSE tags END) AS tag FROM concepts))",
}
