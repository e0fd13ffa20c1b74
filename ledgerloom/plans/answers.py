"""Queries about searching nodes, checking quotes, grading answers and comparing retrieval set-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.durable import checkpoint
from ledgerloom.functions.keys import folded, source_key, spelling_key
from ledgerloom.operators import ranking, retrieval, verification
from ledgerloom.plans.knowledge import FLAGGED, TOP
from ledgerloom.plans.knowledge_sql import _KEY, _SRC, FLAGGED as _F, bm25_sql
from ledgerloom.plans.links import concept_links
from ledgerloom.sources.tables import table

LABELS = ("1", "2", "3", "4", "5")
SETUPS = ("raw", "bm25", "governed", "governed-hook")
WORDS = ["broker", "latency", "checksum"]


def concept_nodes(s: SparkSession, d: str) -> DataFrame:
    """Concept pages as nodes, one per spelling."""
    c = table(s, d, "concepts").where("stem IS NOT NULL").select(spelling_key(F.col("stem")).alias("node"), "title", F.col("body").alias("text"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    # One exchange, spread over all cores: what follows is costly for each page.
    return c.repartition(s.sparkContext.defaultParallelism, "node").groupBy("node").agg(F.max("title").alias("title"), F.max("text").alias("text"), F.max("tags").alias("tags"))


def asked_questions(s: SparkSession, d: str) -> DataFrame:
    """``(query_id, text)``: the questions, one text per id."""
    return table(s, d, "questions").where("id IS NOT NULL AND question IS NOT NULL").groupBy(F.col("id").alias("query_id")).agg(F.max("question").alias("text"))


def _search(s, d, of):
    return ranking.node_search(concept_nodes(s, d), concept_links(s, d), asked_questions(s, d), TOP, of)


def lexical_search(s, d):
    return _search(s, d, "lexical")


def graph_search(s, d):
    return _search(s, d, "graph")


def rrf_fusion(s, d):
    """Lexical and graph ranking of concept pages for every question, fused by reciprocal rank."""
    return _search(s, d, "fused")


def claim_search(s, d):
    return ranking.keyword_search(table(s, d, "claims").select(F.col("claim_id").alias("id"), F.col("claim_text").alias("text")), WORDS, 50)


def _quoted(s, d):
    a = table(s, d, "claims").where("claim_id IS NOT NULL").select("claim_id", F.posexplode("source_anchors").alias("i", "a")).where("a IS NOT NULL")
    return a.select("claim_id", (F.col("i") + 1).alias("item_no"), source_key(F.col("a.source_id")).alias("source_id"), F.col("a.quote").alias("quote"))


def quote_verification(s, d):
    """The quotes in anchors against the documents of the source they name."""
    return verification.verify_quotes(_quoted(s, d), table(s, d, "documents").select("source_id", "text"))


def quote_verdicts(s, d):
    v = verification.claim_verdicts(table(s, d, "claims"), quote_verification(s, d))
    return v.groupBy("verdict").agg(F.count(F.lit(1)).alias("n_claims"), F.sum("n_quotes").alias("n_quotes"))


def _questions(s, d):
    """One row per question: the greatest of what was delivered."""
    q = table(s, d, "questions").where("id IS NOT NULL")
    return q.groupBy("id").agg(F.max(F.struct("class", "consequence_tier", "expected_answer_facts", "required_uncertainty", "required_source_ids")).alias("r")).select("id", "r.*")


def _answers(s, d):
    """What the knowledge base would answer: the first claim, by id, that cites a required source."""
    want = _questions(s, d).select("id", F.explode("required_source_ids").alias("r")).select("id", source_key(F.col("r")).alias("source_id")).where("source_id IS NOT NULL").distinct()
    c = table(s, d, "claims").where("claim_id IS NOT NULL AND claim_text IS NOT NULL").select("claim_id", "claim_text", F.explode("source_ids").alias("u")).select("claim_id", "claim_text", source_key(F.col("u")).alias("source_id")).where("source_id IS NOT NULL")
    first = c.groupBy("source_id").agg(F.min(F.struct("claim_id", "claim_text")).alias("c"))
    return want.join(first, "source_id").groupBy("id").agg(F.min("c").alias("c")).select("id", F.col("c.claim_text").alias("text"))


def golden_grades(s, d):
    """Grades of the first cited claim as the answer to each question."""
    q = _questions(s, d).select("id", F.col("expected_answer_facts").alias("facts"), F.lit(None).cast("array<string>").alias("forbidden"), F.lit("answer").alias("behavior"), F.col("required_uncertainty").alias("unsure"))
    return verification.grades(q, _answers(s, d), table(s, d, "registry"))


def grade_rates(s, d):
    g = golden_grades(s, d).join(_questions(s, d).select("id", "class", F.col("consequence_tier").alias("tier")), "id")
    return verification.grade_rates(g, ("class", "tier"))


def retrieval_setups(s, d):
    """The four ways to retrieve for a question: not at all, by rank, by rank without flagged sources, and the same behind a hook."""
    docs = table(s, d, "documents").select("doc_id", "text", "source_id")
    texts, queries = docs.select("doc_id", "text"), asked_questions(s, d)
    clean = retrieval.unflagged(docs.select("doc_id", "source_id"), table(s, d, "registry"), FLAGGED)
    reg = table(s, d, "registry").where("id IS NOT NULL").select(F.col("id").alias("source_id"), folded(F.col("source_status")).alias("status"))
    states = reg.groupBy("source_id").agg(F.max(F.coalesce(F.col("status").isin(*FLAGGED), F.lit(False))).alias("flagged"), F.max(F.coalesce(F.col("status").isin("permission-revoked", "revoked", "deleted-from-origin"), F.lit(False))).alias("revoked"))
    best = checkpoint(retrieval.bm25_best_both(texts, queries, TOP, clean)).join(docs.select("doc_id", "source_id"), "doc_id")
    given = F.array_compact(F.array(F.when(F.col("rank").isNotNull(), "bm25"), *(F.when(F.col("kept_rank").isNotNull(), setup) for setup in ("governed", "governed-hook"))))
    got = best.select(F.explode(given).alias("setup"), F.col("query_id").alias("id"), "source_id")
    q = _questions(s, d)
    asked = q.select(F.explode(F.array(*map(F.lit, SETUPS))).alias("setup"), "id", F.col("consequence_tier").alias("tier"))
    relevant = q.select("id", F.explode("required_source_ids").alias("r")).select("id", source_key(F.col("r")).alias("source_id"))
    return verification.setup_report(asked, got, relevant, states, "bm25")


def grader_confusion_by_kind(s, d):
    """How two graders of a document judge it, by kind of document."""
    g = table(s, d, "level_labels").where("level IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id", "grader").agg(F.max("level").cast("string").alias("level"))
    x, y = g.alias("x"), g.alias("y")
    pairs = x.join(y, F.expr("x.doc_id = y.doc_id AND x.grader < y.grader")).select(F.col("x.doc_id").alias("doc_id"), F.col("x.level").alias("gold"), F.col("y.level").alias("verdict"))
    kinds = table(s, d, "documents").select("doc_id", F.coalesce("kind", F.lit("unknown")).alias("kind"))
    return verification.confusion_by(pairs.join(kinds, "doc_id"), "kind", LABELS)


def false_support(s, d):
    """Of the pairs in which the second grader says demanding (4 or 5), how many the first one does not."""
    c = grader_confusion_by_kind(s, d).groupBy("kind").agg(F.sum(F.when(F.col("verdict") >= "4", F.col("n")).otherwise(0)).alias("n_support"), F.sum(F.when((F.col("verdict") >= "4") & (F.col("gold") < "4"), F.col("n")).otherwise(0)).alias("n_false"))
    return c.select("kind", "n_support", "n_false", F.round(F.try_divide("n_false", "n_support"), 4).alias("false_rate"))


QUERIES = {f.__name__: f for f in (lexical_search, graph_search, rrf_fusion, claim_search, quote_verification, quote_verdicts, golden_grades, grade_rates, retrieval_setups, grader_confusion_by_kind, false_support)}

_N = "(length({0}) - length(replace({0}, term, ''))) // length(term)"
_SEARCH = f"""
WITH q AS (SELECT id AS query_id, max(question) AS text FROM questions WHERE id IS NOT NULL AND question IS NOT NULL GROUP BY id),
t AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')) AS term FROM q) GROUP BY ALL),
n AS (SELECT node, lower(coalesce(max(title), '')) AS title, lower(coalesce(max(body), '')) AS text, lower(array_to_string(coalesce(max(coalesce(tags, [])), []), ' ')) AS tags FROM (SELECT {_KEY.format('stem')} AS node, * FROM concepts WHERE stem IS NOT NULL) GROUP BY node),
c AS (SELECT node, term, {_N.format('title')} AS in_title, 3 * ({_N.format('title')}) + {_N.format('text')} + {_N.format('tags')} + {_N.format('node')} AS in_all FROM n, (SELECT DISTINCT term FROM t)),
lex AS (SELECT query_id, node AS doc_id, sum(times * in_all)::DOUBLE AS score, sum(times * in_title)::DOUBLE AS th FROM t JOIN c USING (term) WHERE in_all > 0 GROUP BY ALL),
lr AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM lex),
cl AS (SELECT DISTINCT a, {_KEY.format("regexp_extract(t, '([^/]+)$', 1)")} AS b FROM (SELECT {_KEY.format('concept')} AS a, unnest(flatten(map_values(page_edges))) AS t FROM claims WHERE concept IS NOT NULL) WHERE t IS NOT NULL),
e AS (SELECT a, b FROM cl WHERE a <> '' AND b IN (SELECT node FROM n)),
d0 AS (SELECT query_id, doc_id AS node, 0 AS depth FROM lr WHERE rank <= 5), d1 AS (SELECT DISTINCT query_id, b AS node, 1 AS depth FROM d0 JOIN e ON a = node), d2 AS (SELECT DISTINCT query_id, b AS node, 2 AS depth FROM d1 JOIN e ON a = node),
gr AS (SELECT query_id, doc_id, 2.0::DOUBLE / (depth + 1) + coalesce(th, 0) AS score FROM (SELECT query_id, node AS doc_id, min(depth) AS depth FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2) GROUP BY ALL) LEFT JOIN lex USING (query_id, doc_id)),
gk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM gr),
fu AS (SELECT query_id, doc_id, round(sum(1 / (60::DOUBLE + rank)), 6) AS score FROM (SELECT query_id, doc_id, rank FROM lr UNION ALL SELECT query_id, doc_id, rank FROM gk) GROUP BY ALL)
"""
_FOLDED = "trim(regexp_replace(translate(nfc_normalize({0}), '‘’‚‛“”„–—− ', '''''''''\"\"\"--- '), '[ \\t\\r\\n\\f\\v]+', ' ', 'g'))"
_QUOTES = f"""
WITH a AS (SELECT DISTINCT claim_id, i AS item_no, {_SRC.format('l[i].source_id')} AS source_id, trim(l[i].quote, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS quote FROM (SELECT claim_id, source_anchors AS l, unnest(range(1, len(source_anchors) + 1)) AS i FROM claims WHERE claim_id IS NOT NULL)),
k AS (SELECT *, {_FOLDED.format('quote')} AS fq FROM a WHERE quote <> ''),
x AS (SELECT DISTINCT source_id, text, {_FOLDED.format('text')} AS ft FROM documents WHERE source_id IS NOT NULL AND text IS NOT NULL),
f AS (SELECT *, list_filter(list_transform(string_split_regex(fq, '…|\\.\\.\\.'), lambda z: trim(z)), lambda z: z <> '') AS fr FROM k),
m AS (SELECT claim_id, item_no, max(CASE WHEN contains(text, quote) THEN 3 WHEN length(fq) < 8 THEN 0 WHEN contains(ft, fq) THEN 2 WHEN len(fr) >= 2 AND len(list_filter(fr, lambda z: length(z) < 8)) = 0 AND regexp_matches(ft, '(?s)' || array_to_string(list_transform(fr, lambda z: regexp_escape(z)), '.*')) THEN 1 ELSE 0 END) AS m FROM f JOIN x USING (source_id) GROUP BY ALL),
v AS (SELECT claim_id, item_no::INTEGER AS item_no, CASE WHEN m IS NULL THEN 'unverifiable' WHEN m = 0 THEN 'failed' ELSE 'verified' END AS status, CASE m WHEN 3 THEN 'exact' WHEN 2 THEN 'normalized' WHEN 1 THEN 'ellipsis' END AS match FROM k LEFT JOIN m USING (claim_id, item_no))
"""
_QS = "qs AS (SELECT id, class, consequence_tier AS tier, expected_answer_facts AS facts, required_uncertainty AS unsure, required_source_ids AS req FROM questions WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY class DESC NULLS LAST, consequence_tier DESC NULLS LAST, expected_answer_facts DESC NULLS LAST, required_uncertainty DESC NULLS LAST, required_source_ids DESC NULLS LAST) = 1)"
_STOP = "[" + ", ".join(f"'{w}'" for w in verification.STOP_WORDS) + "]"
_CW = rf"list_filter(regexp_extract_all(lower({{0}}), '\b[a-z0-9_-]{{{{4,}}}}\b'), lambda w: NOT list_contains({_STOP}, w))"
_ANY = lambda marks: "(" + " OR ".join("contains(low, '" + m.replace("'", "''") + "')" for m in marks) + ")"
_GRADES = f"""
WITH {_QS}, want AS (SELECT DISTINCT id, {_SRC.format('r')} AS source_id FROM (SELECT id, unnest(req) AS r FROM qs)),
c AS (SELECT source_id, min({{{{'a': claim_id, 'b': claim_text}}}}) AS c FROM (SELECT claim_id, claim_text, {_SRC.format('u')} AS source_id FROM (SELECT claim_id, claim_text, unnest(source_ids) AS u FROM claims WHERE claim_id IS NOT NULL AND claim_text IS NOT NULL)) WHERE source_id IS NOT NULL GROUP BY 1),
ans AS (SELECT id, min(c).b AS text FROM want JOIN c USING (source_id) GROUP BY id),
met AS (SELECT qs.*, text, lower(text) AS low, list_filter(coalesce(facts, []), lambda x: x IS NOT NULL) AS fs, ids FROM qs JOIN ans USING (id), (SELECT list(id) AS ids FROM registry)),
cov AS (SELECT *, CASE WHEN len(fs) = 0 THEN 1.0 ELSE len(list_filter(fs, lambda f: len({_CW.format('f')}) = 0 OR len(list_filter({_CW.format('f')}, lambda w: contains(low, w))) / len({_CW.format('f')}) >= 0.55)) / len(fs) END AS cov FROM met),
g AS (SELECT id, class, tier, round(cov, 3) AS coverage, list_filter([CASE WHEN len(list_filter(regexp_extract_all(text, 'src-[0-9a-f]{{{{10}}}}'), lambda x: NOT list_contains(ids, x))) > 0 THEN 'fabricated-citation' END, CASE WHEN {_ANY(verification.ABSTAINS)} THEN 'bad-abstention' END,
CASE WHEN len(fs) > 0 AND cov < 0.5 THEN 'missing-elements' END, CASE WHEN coalesce(unsure, false) AND NOT {_ANY(verification.UNSURE)} THEN 'missing-uncertainty' END], lambda x: x IS NOT NULL) AS f FROM cov),
graded AS (SELECT id, class, tier, coverage, array_to_string(f, ',') AS failures, CASE WHEN list_contains(f, 'fabricated-citation') THEN 'catastrophic' WHEN len(f) > 0 THEN 'fail' ELSE 'pass' END AS result FROM g)
""".replace("{{", "{").replace("}}", "}")
_CONFUSION = """WITH g AS (SELECT doc_id, grader, max(level)::VARCHAR AS level FROM level_labels WHERE level IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL), p AS (SELECT coalesce(kind, 'unknown') AS kind, x.level AS gold, y.level AS verdict FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.grader < y.grader JOIN documents d ON d.doc_id = x.doc_id),
l AS (SELECT unnest(['1', '2', '3', '4', '5']) AS v), conf AS (SELECT k.kind, a.v AS gold, b.v AS verdict, count(p.kind) AS n FROM (SELECT DISTINCT kind FROM p) k CROSS JOIN l a CROSS JOIN l b LEFT JOIN p ON p.kind = k.kind AND p.gold = a.v AND p.verdict = b.v GROUP BY ALL)
"""

SQL = {
    "lexical_search": _SEARCH + f"SELECT * FROM lr WHERE rank <= {TOP}",
    "graph_search": _SEARCH + f"SELECT * FROM gk WHERE rank <= {TOP}",
    "rrf_fusion": _SEARCH + f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fu QUALIFY rank <= {TOP}",
    "claim_search": "SELECT claim_id AS id, max(" + " + ".join(f"(length(lower(claim_text)) - length(replace(lower(claim_text), '{w}', ''))) // {len(w)}" for w in WORDS) + ") AS hits FROM claims WHERE claim_id IS NOT NULL AND claim_text IS NOT NULL GROUP BY 1 HAVING hits > 0 ORDER BY hits DESC, id LIMIT 50",
    "quote_verification": _QUOTES + "SELECT DISTINCT * FROM v",
    "quote_verdicts": _QUOTES + ", w AS (SELECT claim_id, count(*) AS n, max(CASE status WHEN 'failed' THEN 3 WHEN 'unverifiable' THEN 2 ELSE 1 END) AS w FROM (SELECT DISTINCT * FROM v) GROUP BY 1) SELECT ['absent', 'verified', 'unverifiable', 'failed'][coalesce(w, 0) + 1] AS verdict, count(*) AS n_claims, sum(coalesce(n, 0))::BIGINT AS n_quotes FROM (SELECT DISTINCT claim_id FROM claims WHERE claim_id IS NOT NULL) LEFT JOIN w USING (claim_id) GROUP BY 1",
    "golden_grades": _GRADES + "SELECT id, coverage, failures, result FROM graded",
    "grade_rates": _GRADES + ", k AS (SELECT coalesce(class, 'unknown') AS class, coalesce(tier, 'unknown') AS tier, result FROM graded) SELECT class, tier, count(*) AS n, round(avg((result = 'pass')::INTEGER), 4) AS pass_rate, round(avg((result = 'catastrophic')::INTEGER), 4) AS catastrophic_rate FROM k GROUP BY GROUPING SETS ((class), (tier), (class, tier), ())",
    "retrieval_setups": bm25_sql("SELECT doc_id, text, source_id FROM documents", "SELECT id AS query_id, max(question) AS text FROM questions WHERE id IS NOT NULL AND question IS NOT NULL GROUP BY id")
    + f""", {_QS}, st AS (SELECT id AS source_id, max((coalesce(lower(trim(source_status)), '') IN {_F})::INTEGER) AS flagged, max((coalesce(lower(trim(source_status)), '') IN ('permission-revoked', 'revoked', 'deleted-from-origin'))::INTEGER) AS revoked FROM registry WHERE id IS NOT NULL GROUP BY id),
gov AS (SELECT query_id, doc_id, source_id FROM scores JOIN docs USING (doc_id) WHERE source_id IS NULL OR source_id NOT IN (SELECT id FROM registry WHERE id IS NOT NULL AND lower(source_status) IN {_F}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= {TOP}),
got AS (SELECT DISTINCT setup, id, source_id FROM (SELECT 'bm25' AS setup, query_id AS id, source_id FROM ranked JOIN docs USING (doc_id) WHERE rank <= {TOP} UNION ALL SELECT unnest(['governed', 'governed-hook']), query_id, source_id FROM gov) WHERE source_id IS NOT NULL),
rel AS (SELECT DISTINCT id, {_SRC.format('r')} AS source_id FROM (SELECT id, unnest(req) AS r FROM qs) WHERE {_SRC.format('r')} IS NOT NULL),
ask AS (SELECT unnest(['raw', 'bm25', 'governed', 'governed-hook']) AS setup, id, tier FROM qs), want AS (SELECT setup, id, source_id FROM ask JOIN rel USING (id)),
b AS (SELECT coalesce(got.setup, want.setup) AS setup, coalesce(got.id, want.id) AS id, coalesce(got.source_id, want.source_id) AS source_id, got.id IS NOT NULL AS g, want.id IS NOT NULL AS r FROM got FULL JOIN want ON got.setup = want.setup AND got.id = want.id AND got.source_id = want.source_id),
m AS (SELECT b.*, coalesce(flagged, 1) = 0 AS clean, coalesce(flagged, 0) = 1 AS bad, coalesce(revoked, 0) = 1 AS rev, EXISTS (SELECT 1 FROM got o WHERE o.setup = 'bm25' AND o.id = b.id AND o.source_id = b.source_id) AS base FROM b LEFT JOIN st USING (source_id)),
p AS (SELECT setup, id, count(*) FILTER (WHERE g) AS got, count(*) FILTER (WHERE r) AS rel, count(*) FILTER (WHERE g AND r) AS hit, count(*) FILTER (WHERE g AND r AND clean) AS chit, count(*) FILTER (WHERE g AND bad) AS leaks, count(*) FILTER (WHERE g AND rev) AS revs, count(*) FILTER (WHERE r AND clean AND base AND NOT g) AS dropped FROM m GROUP BY ALL)
SELECT setup, count(*) AS n_questions, round(avg(CASE WHEN rel > 0 THEN hit / rel END), 4) AS recall, round(avg(CASE WHEN hit > 0 THEN 1.0 ELSE 0.0 END), 4) AS coverage, round(avg(CASE WHEN got > 0 THEN 1 - hit / got END), 4) AS irrelevant_rate, count(*) FILTER (WHERE revs > 0) AS revoked_leaks, count(*) FILTER (WHERE leaks > 0) AS flagged_leaks,
count(*) FILTER (WHERE leaks > 0 AND tier IN ('recommendation', 'decision', 'autonomous')) AS false_accepts, count(*) FILTER (WHERE dropped > 0) AS false_rejects, round(avg(CASE WHEN chit > 0 AND coalesce(leaks, 0) = 0 THEN 1.0 ELSE 0.0 END), 4) AS safe_grounded_rate,
round(avg(CASE tier WHEN 'exploratory' THEN 1.0::DOUBLE WHEN 'decision' THEN 8.0 WHEN 'autonomous' THEN 15.0 ELSE 3.0 END), 3) AS review_minutes FROM ask LEFT JOIN p USING (setup, id) GROUP BY setup""",
    "grader_confusion_by_kind": _CONFUSION + "SELECT * FROM conf",
    "false_support": _CONFUSION + "SELECT kind, sum(n) FILTER (WHERE verdict >= '4')::BIGINT AS n_support, sum(n) FILTER (WHERE verdict >= '4' AND gold < '4')::BIGINT AS n_false, round(CASE WHEN n_support > 0 THEN n_false / n_support END, 4) AS false_rate FROM conf GROUP BY kind",
}
