"""Queries of the general data problems: nested records, snapshot changes, orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import nested, references, snapshots
from ledgerloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.child_elements(nested.typed_shape(table(spark, d, "claims")).unionByName(nested.feed_shape(table(spark, d, "claim_feed"))))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return nested.typed_records(table(spark, d, "claims")).unionByName(nested.feed_records(table(spark, d, "claim_feed")))


def p1_nodes(spark: SparkSession, d: str) -> DataFrame:
    """How many nodes of each kind there are, and the deepest interval numbers."""
    return nested.node_table(_records(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("pre").alias("greatest_pre"), F.max("post").alias("greatest_post"), F.max("place").alias("greatest_place"))


def p1_sources(spark: SparkSession, d: str) -> DataFrame:
    return nested.source_table(_records(spark, d))


def p1_anchors(spark: SparkSession, d: str) -> DataFrame:
    return nested.anchor_table(_records(spark, d))


def p1_spans(spark: SparkSession, d: str) -> DataFrame:
    return nested.span_table(_records(spark, d))


def p1_labels(spark: SparkSession, d: str) -> DataFrame:
    return nested.label_counts(_records(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "snapshot_state"), table(spark, d, "snapshot_log"))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.change_counts(p2_found(spark, d))


def _children(spark: SparkSession, d: str) -> DataFrame:
    claims = references.references(table(spark, d, "claims"), "claims", "claim_id", "source_ids", "last_updated")
    return claims.unionByName(references.references(table(spark, d, "questions"), "questions", "id", "required_source_ids", "asked_on"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_references(_children(spark, d), table(spark, d, "registry")).select("table_name", "record_id", "source_id").distinct()


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_counts(_children(spark, d), table(spark, d, "registry"))


QUERIES = {"p1_found": p1_found, "p1_nodes": p1_nodes, "p1_sources": p1_sources, "p1_anchors": p1_anchors, "p1_spans": p1_spans, "p1_labels": p1_labels, "p2_found": p2_found, "p2_counts": p2_counts, "p7_found": p7_found, "p7_counts": p7_counts}

_LIST = "CASE WHEN {0} IS NULL OR json_type({0}) = 'NULL' THEN []::JSON[] WHEN json_type({0}) = 'ARRAY' THEN json_extract({0}, '$[*]') ELSE [{0}] END"

_P1 = f"""
WITH feed AS (SELECT coalesce(nullif(json_extract(j, '$.record'), 'null'::JSON), j) AS r FROM (SELECT payload::JSON AS j FROM claim_feed WHERE payload IS NOT NULL AND json_valid(payload))),
raw AS (SELECT json_extract_string(r, '$.claim_id') AS claim_id,
    coalesce(json_extract(r, '$.evidence.source_ids'), json_extract(r, '$.source_ids')) AS s,
    coalesce(json_extract(r, '$.evidence.source_anchors'), json_extract(r, '$.source_anchors')) AS a FROM feed),
items AS (SELECT claim_id, {_LIST.format('s')} AS s, {_LIST.format('a')} AS a FROM raw WHERE claim_id IS NOT NULL),
feed_sources AS (SELECT claim_id, i AS item_no FROM (SELECT claim_id, s, unnest(range(1, len(s) + 1)) AS i FROM items) WHERE json_type(s[i]) <> 'NULL'),
feed_anchors AS (SELECT claim_id, i AS item_no, a[i] AS x FROM (SELECT claim_id, a, unnest(range(1, len(a) + 1)) AS i FROM items) WHERE json_type(a[i]) <> 'NULL'),
feed_lists AS (SELECT claim_id, item_no, {_LIST.format("json_extract(x, '$.spans')")} AS p FROM feed_anchors),
feed_spans AS (SELECT claim_id, item_no, k AS span_no FROM (SELECT claim_id, item_no, p, unnest(range(1, len(p) + 1)) AS k FROM feed_lists) WHERE json_type(p[k]) <> 'NULL'),
src AS (SELECT claim_id, i AS item_no FROM (SELECT claim_id, source_ids AS s, unnest(range(1, len(source_ids) + 1)) AS i FROM claims) WHERE s[i] IS NOT NULL),
anc AS (SELECT claim_id, i AS item_no, a[i] AS x FROM (SELECT claim_id, source_anchors AS a, unnest(range(1, len(source_anchors) + 1)) AS i FROM claims) WHERE a[i] IS NOT NULL),
spn AS (SELECT claim_id, item_no, k AS span_no FROM (SELECT claim_id, item_no, x.spans AS p, unnest(range(1, len(x.spans) + 1)) AS k FROM anc) WHERE p[k] IS NOT NULL)
SELECT DISTINCT claim_id, child, item_no::INTEGER AS item_no, span_no::INTEGER AS span_no FROM (
    SELECT claim_id, 'source_id' AS child, item_no, 0 AS span_no FROM src UNION ALL SELECT claim_id, 'source_id', item_no, 0 FROM feed_sources
    UNION ALL SELECT claim_id, 'anchor', item_no, 0 FROM anc UNION ALL SELECT claim_id, 'anchor', item_no, 0 FROM feed_anchors
    UNION ALL SELECT claim_id, 'span', item_no, span_no FROM spn UNION ALL SELECT claim_id, 'span', item_no, span_no FROM feed_spans) WHERE claim_id IS NOT NULL
"""

_FIELDS = ", ".join(f"{{0}}.{f} AS {f}" for f in nested.ANCHOR)
_JSON_TYPES = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE"}
_JSON_FIELDS = ", ".join(f"try_cast(json_extract_string({{0}}, '$.{f}') AS {_JSON_TYPES[t]}) AS {f}" for f, t in nested.ANCHOR.items())

# The children of claims and of feed records with their values.
_CHILDREN = f"""
WITH feed AS (SELECT coalesce(nullif(json_extract(j, '$.record'), 'null'::JSON), j) AS r FROM (SELECT payload::JSON AS j FROM claim_feed WHERE payload IS NOT NULL AND json_valid(payload))),
raw AS (SELECT json_extract_string(r, '$.claim_id') AS claim_id,
    coalesce(json_extract(r, '$.evidence.source_ids'), json_extract(r, '$.source_ids')) AS s,
    coalesce(json_extract(r, '$.evidence.source_anchors'), json_extract(r, '$.source_anchors')) AS a FROM feed),
items AS (SELECT claim_id, {_LIST.format('s')} AS s, {_LIST.format('a')} AS a FROM raw WHERE claim_id IS NOT NULL),
fa AS (SELECT claim_id, i AS item_no, a[i] AS x FROM (SELECT claim_id, a, unnest(range(1, len(a) + 1)) AS i FROM items) WHERE json_type(a[i]) <> 'NULL'),
fp AS (SELECT claim_id, item_no, k AS span_no, p[k] AS y FROM (SELECT claim_id, item_no, p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT claim_id, item_no, {_LIST.format("json_extract(x, '$.spans')")} AS p FROM fa)) WHERE json_type(p[k]) <> 'NULL'),
fl AS (SELECT claim_id, item_no, span_no, n AS label_no, json_extract_string(l[n], '$') AS label FROM (SELECT claim_id, item_no, span_no, l, unnest(range(1, len(l) + 1)) AS n FROM (SELECT claim_id, item_no, span_no, {_LIST.format("json_extract(y, '$.labels')")} AS l FROM fp)) WHERE json_type(l[n]) <> 'NULL'),
fs AS (SELECT claim_id, i AS item_no, json_extract_string(s[i], '$') AS source_id FROM (SELECT claim_id, s, unnest(range(1, len(s) + 1)) AS i FROM items) WHERE json_type(s[i]) <> 'NULL'),
ta AS (SELECT claim_id, i AS item_no, a[i] AS x FROM (SELECT claim_id, source_anchors AS a, unnest(range(1, len(source_anchors) + 1)) AS i FROM claims WHERE claim_id IS NOT NULL) WHERE a[i] IS NOT NULL),
tp AS (SELECT claim_id, item_no, k AS span_no, p[k] AS y FROM (SELECT claim_id, item_no, x.spans AS p, unnest(range(1, len(x.spans) + 1)) AS k FROM ta) WHERE p[k] IS NOT NULL),
tl AS (SELECT claim_id, item_no, span_no, n AS label_no, l[n] AS label FROM (SELECT claim_id, item_no, span_no, y.labels AS l, unnest(range(1, len(y.labels) + 1)) AS n FROM tp) WHERE l[n] IS NOT NULL),
ts AS (SELECT claim_id, i AS item_no, s[i] AS source_id FROM (SELECT claim_id, source_ids AS s, unnest(range(1, len(source_ids) + 1)) AS i FROM claims WHERE claim_id IS NOT NULL) WHERE s[i] IS NOT NULL)
"""

_SOURCES = _CHILDREN + "SELECT DISTINCT claim_id, item_no::INTEGER AS item_no, source_id FROM (SELECT * FROM ts UNION ALL SELECT * FROM fs)"

_ANCHORS = _CHILDREN + f"SELECT DISTINCT * FROM (SELECT claim_id, item_no::INTEGER AS item_no, {_FIELDS.format('x')} FROM ta UNION ALL SELECT claim_id, item_no::INTEGER, {_JSON_FIELDS.format('x')} FROM fa)"

_SPANS = _CHILDREN + f"""SELECT DISTINCT claim_id, item_no::INTEGER AS item_no, span_no::INTEGER AS span_no, start_char, end_char, n_labels FROM (
    SELECT claim_id, item_no, span_no, y.start_char AS start_char, y.end_char AS end_char, len(list_filter(coalesce(y.labels, []), lambda l: l IS NOT NULL))::INTEGER AS n_labels FROM tp
    UNION ALL SELECT claim_id, item_no, span_no, try_cast(json_extract_string(y, '$.start_char') AS BIGINT), try_cast(json_extract_string(y, '$.end_char') AS BIGINT), len(list_filter({_LIST.format("json_extract(y, '$.labels')")}, lambda l: json_type(l) <> 'NULL'))::INTEGER FROM fp)"""

_LABELS = _CHILDREN + """, lab AS (SELECT DISTINCT * FROM (SELECT * FROM tl UNION ALL SELECT * FROM fl))
SELECT label, count(*) AS n_labels, count(DISTINCT (claim_id, item_no, span_no)) AS n_spans FROM lab GROUP BY label"""

_FOLD = r"lower(trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8199) || chr(8239) || chr(8203) || chr(65279)))"

_P2 = f"""
WITH latest AS (SELECT snapshot, id, {_FOLD.format('content_hash')} AS h, {_FOLD.format('source_status')} AS s FROM snapshot_state WHERE snapshot IS NOT NULL AND id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY snapshot, id ORDER BY delivered_at DESC NULLS LAST, h DESC NULLS LAST, s DESC NULLS LAST) = 1),
names AS (SELECT snapshot, lead(snapshot) OVER (ORDER BY snapshot) AS after, row_number() OVER (ORDER BY snapshot) AS n FROM (SELECT snapshot FROM snapshot_state WHERE snapshot IS NOT NULL UNION SELECT snapshot FROM snapshot_log WHERE snapshot IS NOT NULL)),
cur AS (SELECT latest.* FROM latest JOIN names USING (snapshot) WHERE n > 1),
old AS (SELECT after AS snapshot, id, h, s FROM latest JOIN names USING (snapshot) WHERE after IS NOT NULL),
changes AS (SELECT coalesce(cur.snapshot, old.snapshot) AS snapshot, coalesce(cur.id, old.id) AS id, CASE WHEN old.id IS NULL THEN 'added' WHEN cur.id IS NULL THEN 'removed' WHEN cur.h IS DISTINCT FROM old.h OR cur.s IS DISTINCT FROM old.s THEN 'changed' END AS change
    FROM cur FULL JOIN old ON cur.snapshot = old.snapshot AND cur.id = old.id)
"""

_DAY = r"CASE WHEN regexp_matches(trim({0}), '^\d{{4}}-\d{{2}}-\d{{2}}($|[T ])') THEN try_cast(substr(trim({0}), 1, 10) AS DATE) WHEN regexp_matches(trim({0}), '^\d{{8}}($|-\d)') THEN try_cast(substr(trim({0}), 1, 4) || '-' || substr(trim({0}), 5, 2) || '-' || substr(trim({0}), 7, 2) AS DATE) END"

_P7 = f"""
WITH long AS (SELECT 'claims' AS table_name, claim_id AS record_id, unnest(source_ids) AS u, {_DAY.format('last_updated')} AS day FROM claims
    UNION ALL SELECT 'questions', id, unnest(required_source_ids), {_DAY.format('asked_on')} FROM questions),
refs AS (SELECT DISTINCT table_name, record_id, 'src-' || regexp_extract(lower(u), '(?:^|[^0-9a-z])([0-9a-f]{{10}})(?:$|[^0-9a-z])', 1) AS source_id, day FROM long
    WHERE record_id IS NOT NULL AND regexp_extract(lower(u), '(?:^|[^0-9a-z])([0-9a-f]{{10}})(?:$|[^0-9a-z])', 1) <> ''),
reg AS (SELECT id AS source_id, min({_DAY.format('ingested_at')}) AS first_day, arg_max({_FOLD.format('source_status')}, loaded_at) AS status FROM registry WHERE id IS NOT NULL GROUP BY id),
cases AS (SELECT refs.*, CASE WHEN reg.source_id IS NULL THEN 'missing' WHEN status = 'deleted-from-origin' THEN 'deleted' WHEN first_day > day THEN 'late' END AS reason FROM refs LEFT JOIN reg USING (source_id))
"""

SQL = {
    "p1_found": _P1,
    "p1_sources": _SOURCES,
    "p1_anchors": _ANCHORS,
    "p1_spans": _SPANS,
    "p1_labels": _LABELS,
    "p2_found": _P2 + "SELECT * FROM changes WHERE change IS NOT NULL",
    "p2_counts": _P2 + "SELECT snapshot, change, count(*) AS n FROM changes WHERE change IS NOT NULL GROUP BY ALL",
    "p7_found": _P7 + "SELECT DISTINCT table_name, record_id, source_id FROM cases WHERE reason IS NOT NULL",
    "p7_counts": _P7 + "SELECT table_name, coalesce(strftime(day, '%Y-%m'), 'unknown') AS period, reason, count(*) AS n_references, count(DISTINCT source_id) AS n_sources FROM cases WHERE reason IS NOT NULL GROUP BY ALL",
}
