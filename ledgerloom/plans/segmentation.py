"""Queries that segment notes and read signals from sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import segments
from ledgerloom.plans.knowledge import retrieval, spelling_key
from ledgerloom.sources.tables import table


def section_spans(s, d):
    return segments.section_spans(table(s, d, "documents").select("doc_id", "text"))


def outline_paths(s, d):
    return segments.outline_paths(table(s, d, "documents").select("doc_id", "text"))


def claim_groups(s, d):
    """Claims of a concept in groups of 29 by id, as the leaves of a summary tree."""
    c = table(s, d, "claims").where("claim_id IS NOT NULL AND concept IS NOT NULL").select(spelling_key(F.col("concept")).alias("concept"), "claim_id").distinct()
    return segments.sibling_groups(c, "concept", "claim_id").groupBy("concept", "group_no").agg(F.count(F.lit(1)).alias("n"), F.min("claim_id").alias("first"), F.max("claim_id").alias("last"))


def factual_sentences(s, d):
    return segments.factual_sentences(table(s, d, "claims"), "claim_id", "quote")


def best_span(s, d):
    return segments.best_span(table(s, d, "claims").select("claim_id", "claim_text", "quote").distinct(), "claim_id", "claim_text", "quote")


def year_index(s, d):
    return table(s, d, "documents").select("doc_id", F.explode(segments.years(F.col("text"))).alias("year"))


def code_symbols(s, d):
    return segments.symbols(table(s, d, "documents"))


def path_quota(s, d):
    """At most three paths per top folder, shallow ones first, among the paths that anchors name."""
    p = table(s, d, "claims").select(F.explode("source_anchors.path").alias("path")).where("path IS NOT NULL").distinct()
    f = p.select("path", F.substring_index("path", "/", 1).alias("folder"), (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).alias("depth"))
    return segments.quota(f, "folder", [F.col("depth"), F.col("path")], 3)


def keyword_overlap(s, d):
    """Words of four letters or more that the texts of evaluation items and claims share, by item."""
    w = lambda c: F.array_distinct(F.filter(retrieval.terms(c), lambda x: F.length(x) >= 4))
    i = table(s, d, "eval_items").where("text IS NOT NULL").select("item_id", F.explode(w(F.col("text"))).alias("word"))
    held = table(s, d, "claims").where("claim_text IS NOT NULL").select(F.explode(w(F.col("claim_text"))).alias("word")).distinct()
    return i.join(held.withColumn("hit", F.lit(1)), "word", "left").groupBy("item_id").agg(F.count(F.lit(1)).alias("n_words"), F.count("hit").alias("n_known"))


QUERIES = {f.__name__: f for f in (section_spans, outline_paths, claim_groups, factual_sentences, best_span, year_index, code_symbols, path_quota, keyword_overlap)}

_TERMS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}\p{{M}}]+'), lambda x: x <> '')"
_KEY = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g'))"
_L = "(SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"
_HEAD = rf"""WITH raw AS (SELECT doc_id, i AS line_no, l[i] AS raw FROM {_L}),
at_ AS (SELECT doc_id, line_no, regexp_replace(raw, '\r$', '') AS line, sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(raw) - 1 AS start FROM raw),
h AS (SELECT doc_id, line_no, len(regexp_extract(line, '^(#+)', 1)) AS level, rtrim(regexp_extract(line, '^#+ +(.*)$', 1)) AS title, start FROM at_ WHERE regexp_matches(line, '^#{{1,6}} +\S'))
"""
# A blank that follows a sentence's end is marked, as RE2 has no look-behind.
_SENT = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"

SQL = {
    "section_spans": _HEAD + "SELECT h.doc_id, h.line_no::INTEGER AS line_no, h.level::INTEGER AS level, h.title, h.start::INTEGER AS start, coalesce(min(n.start), any_value(length(d.text)))::INTEGER AS end FROM h JOIN documents d USING (doc_id) LEFT JOIN h n ON n.doc_id = h.doc_id AND n.line_no > h.line_no AND n.level <= h.level GROUP BY ALL",
    "outline_paths": _HEAD + ", p AS (SELECT h.doc_id, h.line_no, any_value(h.title) AS title, list({'l': a.line_no, 't': a.title, 'v': a.level} ORDER BY a.line_no) FILTER (WHERE a.line_no IS NOT NULL) AS up FROM h LEFT JOIN h a ON a.doc_id = h.doc_id AND a.line_no < h.line_no AND a.level < h.level AND NOT EXISTS (SELECT 1 FROM h b WHERE b.doc_id = h.doc_id AND b.line_no > a.line_no AND b.line_no < h.line_no AND b.level <= a.level) GROUP BY h.doc_id, h.line_no) SELECT doc_id, line_no::INTEGER AS line_no, array_to_string(list_append(list_transform(coalesce(up, []), lambda x: x.t), title), '/') AS path, (len(coalesce(up, [])) + 1)::INTEGER AS depth FROM p",
    "claim_groups": f"WITH c AS (SELECT DISTINCT {_KEY.format('concept')} AS concept, claim_id FROM claims WHERE claim_id IS NOT NULL AND concept IS NOT NULL), g AS (SELECT *, ((row_number() OVER (PARTITION BY concept ORDER BY claim_id) - 1) // 29 + 1)::INTEGER AS group_no FROM c) SELECT concept, group_no, count(*) AS n, min(claim_id) AS first, max(claim_id) AS last FROM g GROUP BY ALL",
    "factual_sentences": rf"WITH q AS (SELECT claim_id, {_SENT.format('quote')} AS l FROM claims WHERE claim_id IS NOT NULL AND quote IS NOT NULL), s AS (SELECT claim_id, i, l[i] AS sentence FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM q)) SELECT DISTINCT claim_id, i::INTEGER AS place, sentence FROM s WHERE NOT ends_with(sentence, '?') AND len(list_filter(string_split_regex(sentence, '[^\p{{L}}]+'), lambda w: length(w) >= 2)) >= 4 AND NOT regexp_matches(lower(sentence), '\b(?:might|may be|perhaps|possibly|unclear|unknown)\b')",
    "best_span": rf"WITH c AS (SELECT DISTINCT claim_id, claim_text, quote FROM claims WHERE claim_id IS NOT NULL AND claim_text IS NOT NULL AND quote IS NOT NULL), m AS (SELECT claim_id, list_distinct(list_filter({_TERMS.format('claim_text')}, lambda x: length(x) > 3)) AS mine, {_SENT.format('quote')} AS l FROM c), s AS (SELECT claim_id, mine, i, len(list_intersect(mine, list_distinct({_TERMS.format('l[i]')}))) AS o FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM m WHERE len(mine) > 0)) SELECT claim_id, i::INTEGER AS place, o::INTEGER AS overlap, round(o / len(mine), 4) AS coverage FROM s WHERE o > 0 QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY o DESC, round(o / len(mine), 4) DESC, i) = 1",
    "year_index": r"SELECT DISTINCT doc_id, y AS year FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '([^\d.-])', '\1\1', 'g'), '(?:^|[^\d.-])((?:19|20)\d{2})(?:$|[^\d.])', 1)) AS y FROM documents WHERE text IS NOT NULL)",
    "code_symbols": rf"""WITH l AS (SELECT doc_id, i, regexp_replace(l[i], '\r$', '') AS line FROM {_L}), f AS (SELECT *, sum(regexp_matches(line, '^\s*```')::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM l), c AS (SELECT * FROM f WHERE n % 2 = 1 AND NOT regexp_matches(line, '^\s*```'))
SELECT DISTINCT doc_id, kind, symbol FROM ("""
    + " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS kind, regexp_extract(line, '{p}', 1) AS symbol FROM c" for kind, p in segments.SYMBOLS)
    + ") WHERE symbol <> ''",
    "path_quota": "WITH p AS (SELECT DISTINCT path FROM (SELECT unnest(source_anchors).path AS path FROM claims) WHERE path IS NOT NULL), f AS (SELECT path, split_part(path, '/', 1) AS folder, (length(path) - length(replace(path, '/', '')))::INTEGER AS depth FROM p) SELECT *, row_number() OVER (PARTITION BY folder ORDER BY depth, path) AS rank FROM f QUALIFY rank <= 3",
    "keyword_overlap": f"WITH i AS (SELECT DISTINCT item_id, word FROM (SELECT item_id, unnest({_TERMS.format('text')}) AS word FROM eval_items WHERE text IS NOT NULL) WHERE length(word) >= 4), k AS (SELECT DISTINCT word FROM (SELECT unnest({_TERMS.format('claim_text')}) AS word FROM claims WHERE claim_text IS NOT NULL)) SELECT item_id, count(*) AS n_words, count(k.word) AS n_known FROM i LEFT JOIN k ON k.word = i.word GROUP BY item_id",
}
