"""Queries of the training-data problems tagged llm, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import crosssplit, leakage, neardup, radix, reading, tokenize, truncation
from ledgerloom.sources.tables import table

#: Where the vocabulary files of public tokenizers lie; the same path on every executor.
TOKENIZERS = os.environ.get("LEDGERLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.overlaps(table(spark, d, "dev_probes"), table(spark, d, "questions"), vocabulary=VOCABULARY)


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.overlap_counts(p3_found(spark, d), table(spark, d, "dev_probes"), table(spark, d, "questions"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return radix.copies(table(spark, d, "registry"))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    return radix.collapse(table(spark, d, "registry"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.group_pairs(table(spark, d, "claims"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(table(spark, d, "claims"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "claims")).select("claim_id")


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, d, "claims"), truncation.truncated(table(spark, d, "claims")))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_corpus(table(spark, d, "documents"), VOCABULARY)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(p9_found(spark, d), table(spark, d, "eval_items"))


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "level_labels"))


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    return reading.level_profile(p10_levels(spark, d), table(spark, d, "documents"))


def p10_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return reading.ranks(reading.vocabulary(table(spark, d, "documents")))


QUERIES = {"p3_found": p3_found, "p3_counts": p3_counts, "p4_found": p4_found, "p4_records": p4_records, "p5_found": p5_found, "p5_groups": p5_groups, "p6_found": p6_found, "p6_rates": p6_rates, "p8_ids": p8_ids, "p9_found": p9_found, "p9_items": p9_items, "p10_levels": p10_levels, "p10_profile": p10_profile, "p10_vocabulary": p10_vocabulary}

_PLAIN = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g')"

_P4 = rf"""
WITH parts AS (SELECT id, {_PLAIN.format("split_part(source, '?', 1)")} AS address, CASE WHEN strpos(source, '?') > 0 THEN substr(source, strpos(source, '?') + 1) ELSE '' END AS query, title FROM registry WHERE id IS NOT NULL AND source IS NOT NULL),
canon AS (SELECT id, address, array_to_string(list_sort(list_filter(list_transform(string_split(query, '&'), lambda x: {_PLAIN.format('x')}), lambda x: x <> '')), chr(31)) AS query,
    array_to_string(list_sort(list_filter(list_transform(string_split(title, '|'), lambda x: {_PLAIN.format('x')}), lambda x: x <> '')), chr(31)) AS title FROM parts),
kept AS (SELECT address, query, title, min(id) AS keep_id, count(DISTINCT id) AS n_ids, count(*) AS n_rows FROM canon GROUP BY ALL)
"""

_P5 = r"""
WITH RECURSIVE c AS (SELECT DISTINCT claim_id, trim(regexp_replace(lower(concept), '[^\p{L}\p{N}\p{M}]+', ' ', 'g')) AS k, list_sort(list_distinct(regexp_extract_all(lower(claim_text), '[\p{L}\p{N}]+'))) AS w FROM claims WHERE claim_id IS NOT NULL),
named AS (SELECT * FROM c WHERE k <> '' AND len(w) > 0),
tok AS (SELECT claim_id, k, len(w) AS n, unnest(w) AS t FROM named),
shared AS (SELECT a.claim_id AS a, b.claim_id AS b, any_value(a.n) AS x, any_value(b.n) AS y, count(*) AS o FROM tok a JOIN tok b ON a.k = b.k AND a.t = b.t AND a.claim_id <> b.claim_id GROUP BY a.claim_id, b.claim_id),
link AS (SELECT a, b FROM shared WHERE o * 5 >= (x + y - o) * 3),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
"""

SQL = {
    "p5_found": _P5 + "SELECT DISTINCT a AS claim_id_a, b AS claim_id_b FROM reach WHERE a < b",
    "p5_groups": _P5
    + """, cls AS (SELECT a.claim_id AS claim_id, count(DISTINCT b.w) FILTER (WHERE a.w <> b.w) AS n_links FROM named a LEFT JOIN link ON link.a = a.claim_id LEFT JOIN named b ON link.b = b.claim_id GROUP BY a.claim_id),
least AS (SELECT a AS claim_id, min(b) AS b FROM reach GROUP BY a)
SELECT coalesce(least(least.b, cls.claim_id), cls.claim_id) AS group_id, cls.claim_id, n_links FROM cls LEFT JOIN least USING (claim_id)""",
    "p4_found": _P4 + "SELECT DISTINCT keep_id, id AS copy_id FROM canon JOIN kept ON canon.address = kept.address AND canon.query = kept.query AND canon.title IS NOT DISTINCT FROM kept.title WHERE id <> keep_id",
    "p4_records": _P4 + "SELECT keep_id, n_ids, n_rows FROM kept",
}
