"""Combined search, identities within a table, drift, trees and content-addressed packages."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerloom.functions.durable import checkpoint

#: Line patterns of page boilerplate.
BOILERPLATE = r"(?i)^(?:subscribe|sign in|get the app|share|read more.*)$"


def exact_first(exact: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """``(query_id, doc_id, score, method, rank)``: exact hits before ranked ones, a document once, best ``k`` per query."""
    both = exact.select("query_id", "doc_id", F.col("score").cast("double").alias("score"), F.lit("exact").alias("method"), F.lit(0).alias("p")).unionByName(ranked.select("query_id", "doc_id", "score", F.lit("bm25").alias("method"), F.lit(1).alias("p")))
    once = both.groupBy("query_id", "doc_id").agg(F.min(F.struct("p", (-F.col("score")).alias("s"), "method")).alias("r"))
    order = Window.partitionBy("query_id").orderBy("r.p", "r.s", "doc_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "doc_id", (-F.col("r.s")).alias("score"), "r.method", "rank")


def suffixed(rows: DataFrame, name: str, order: str) -> DataFrame:
    """``rows`` with ``unique_name``: the second, third … row of a name gets ``-1``, ``-2`` …"""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return rows.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat_ws("-", F.col(name), (n - 1).cast("string"))))


def content_drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """``(id, status)`` of two ``(id, content_hash)`` tables: unchanged, drifted, new, gone or unknown where a hash is null."""
    b = baseline.select("id", F.col("content_hash").alias("old"), F.lit(1).alias("b"))
    c = current.select("id", F.col("content_hash").alias("new"), F.lit(1).alias("c"))
    status = F.when(F.col("b").isNull(), "new").when(F.col("c").isNull(), "gone").when(F.col("old").isNull() | F.col("new").isNull(), "unknown").when(F.col("old") == F.col("new"), "unchanged").otherwise("drifted")
    return b.join(c, "id", "full").select("id", status.alias("status"))


def first_seen(previous: DataFrame, rows: DataFrame, key: str, at: str) -> DataFrame:
    """``rows`` with the time at which their key was first seen, kept from ``previous`` where it has one."""
    old = previous.groupBy(key).agg(F.min(at).alias("__old"))
    return rows.join(old, key, "left").withColumn(at, F.coalesce("__old", at)).drop("__old")


def heights(edges: DataFrame) -> DataFrame:
    """``(node, height)`` of ``(child, parent)`` edges: leaves 0, a parent one more than its highest child.

    Leaves are taken off layer by layer: a node is done as soon as all its children are, whatever the number
    of layers. Nodes on or above a cycle are never done and have no height; a loop on itself does not count.
    """
    e = checkpoint(edges.where("child IS NOT NULL AND parent IS NOT NULL AND child <> parent").select("child", "parent").distinct())
    last = checkpoint(e.select(F.col("child").alias("node")).join(e.select(F.col("parent").alias("node")), "node", "left_anti").distinct())
    out, level, left = last.withColumn("height", F.lit(0)), 0, e
    while not last.isEmpty():
        level += 1
        touched = left.join(last.withColumnRenamed("node", "child"), "child").select(F.col("parent").alias("node")).distinct()
        left = checkpoint(left.join(last.withColumnRenamed("node", "child"), "child", "left_anti"))
        last = checkpoint(touched.join(left.select(F.col("parent").alias("node")), "node", "left_anti"))
        out = out.unionByName(last.withColumn("height", F.lit(level)))
        if level % 16 == 0:
            out = checkpoint(out)
    return out


def packages(items: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(key, n_items, package_hash)``: a content address of each key's items that does not depend on their order.

    Each item has its SHA-256 over the fields joined by U+001F (null as U+0000); a package is the SHA-256 over
    the sum of the items' digests read as numbers, in six pieces of 11 digits, so that no list of items is ever
    collected, together with how many there are.
    """
    digest = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(f).cast("string"), F.lit("\x00")) for f in fields)), 256)
    parts = [F.sum(F.conv(F.substring("d", 1 + 10 * i, 10), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(6)]
    g = items.where(F.col(key).isNotNull()).select(key, digest.alias("d")).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_items"), *parts)
    return g.select(key, "n_items", F.sha2(F.concat_ws(":", F.col("n_items").cast("string"), *(F.col(f"s{i}").cast("string") for i in range(6))), 256).alias("package_hash"))


def threshold_signals(metrics: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """``(signal, severity)`` of a one-row table: the rules ``(name, severity, condition)`` that hold; null does not."""
    found = F.filter(F.array(*(F.when(c, F.struct(F.lit(n).alias("signal"), F.lit(s).alias("severity"))) for n, s, c in rules)), lambda x: x.isNotNull())
    return metrics.select(F.explode(found).alias("x")).select("x.signal", "x.severity")


def without_citations(text: Column) -> Column:
    """The text without ``[12]``-like citations and wikilinks, blanks before punctuation closed up."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\[\[[^\]]*\]\]", ""), r"\[\d+\]", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(bare, r"\s+([.,;:!?])", "$1"), r"\s+", " "))


def without_boilerplate(text: Column) -> Column:
    """The text without boilerplate lines and blanks around its lines; runs of empty lines are one, none at the ends."""
    blanks = F.lit(" \t\r\n\f\x0b")
    kept = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda line: F.btrim(line, blanks)), lambda line: ~line.rlike(BOILERPLATE))
    return F.btrim(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"), blanks)


@F.pandas_udf(StringType())
def _compatible(x: pd.Series) -> pd.Series:
    return x.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def folded_punctuation(text: Column) -> Column:
    """Unicode compatibility form with typographic quotes and dashes as plain ones; only texts beyond ASCII leave the JVM."""
    wide = F.when(text.rlike(r"[^\x00-\x7f]"), text)
    return F.coalesce(F.translate(_compatible(wide), "“”„‘’‚–—−", "\"\"\"'''---"), text)
