"""Segmentation of long notes and text signals on sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.notes import headings, lines
from ledgerloom.operators.retrieval import terms

#: Fixed value: siblings of a group in a summary tree.
SIBLINGS = 29
#: Symbols looked for in code, as (kind, pattern of one line).
SYMBOLS = (("function", r"^\s*(?:async +)?def +([A-Za-z_]\w*)"), ("class", r"^\s*class +([A-Za-z_]\w*)"), ("function", r"^\s*(?:export +)?function +([A-Za-z_]\w*)"), ("table", r"^\[([A-Za-z_][\w.-]*)\]\s*$"))


def section_spans(documents: DataFrame) -> DataFrame:
    """``(doc_id, line_no, level, title, start, end)``: character ranges of the sections that headings begin.

    A section ends where the next heading of its level or a lesser one begins, or with the text. Starts
    come from a running sum of line lengths; the end is the least start of later, not deeper headings,
    found with one pass over a document's headings per level.
    """
    run = Window.partitionBy("doc_id").orderBy("line_no")
    at = _raw_lines(documents).select("doc_id", "line_no", (F.sum(F.length("raw") + 1).over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.length("raw") - 1).cast("int").alias("start"))
    h = headings(documents).join(at, ["doc_id", "line_no"]).join(documents.select("doc_id", F.length("text").alias("n")), "doc_id")
    later = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    ends = [F.min(F.when(F.col("level") <= lv, F.col("start"))).over(later) for lv in range(1, 7)]
    end = F.coalesce(F.element_at(F.array(*ends), F.col("level")), F.col("n"))
    return h.select("doc_id", "line_no", "level", "title", "start", end.alias("end"))


def _raw_lines(documents: DataFrame) -> DataFrame:
    split = documents.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "raw"))
    return split.select("doc_id", (F.col("i") + 1).alias("line_no"), "raw")


def outline_paths(documents: DataFrame) -> DataFrame:
    """``(doc_id, line_no, path, depth)``: each heading with the titles above it joined by ``/``, leaf last.

    The last title of every level is carried down the document; shallower ones that a nearer parent
    replaced are cut off.
    """
    h = headings(documents)
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    last = {n: F.last(F.when(F.col("level") == n, F.struct("line_no", "title")), ignorenulls=True).over(before) for n in range(1, 6)}
    wide = h.select("*", *(c.alias(f"l{n}") for n, c in last.items()))
    keep = [F.when((F.col("level") > n) & F.col(f"l{n}").isNotNull() & (F.coalesce(F.greatest(*(F.when(F.lit(m < n), F.col(f"l{m}.line_no")) for m in range(1, 6)), F.lit(0)), F.lit(0)) < F.col(f"l{n}.line_no")), F.col(f"l{n}.title")) for n in range(1, 6)]
    above = F.filter(F.array(*keep), lambda t: t.isNotNull())
    return wide.select("doc_id", "line_no", F.array_join(F.concat(above, F.array("title")), "/").alias("path"), (F.size(above) + 1).alias("depth"))


def sibling_groups(children: DataFrame, parent: str, order: str, size: int = SIBLINGS) -> DataFrame:
    """``children`` with ``group_no``: runs of ``size`` consecutive children of a parent, 1-based."""
    w = Window.partitionBy(parent).orderBy(order)
    return children.withColumn("group_no", (F.floor((F.row_number().over(w) - 1) / size) + 1).cast("int"))


def sentences(text: Column) -> Column:
    """Sentences of a text: cut after ``.``, ``!`` or ``?`` before blanks; outer blanks taken off, empty ones left out."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.btrim(s, F.lit(" \t\r\n"))), lambda s: s != "")


def factual_sentences(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, place, sentence)``: sentences that state something: no question, at least four words of two letters or more, no hedge."""
    s = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, F.posexplode(sentences(F.col(text))).alias("i", "sentence"))
    words = F.size(F.filter(F.split("sentence", r"[^\p{L}]+"), lambda w: F.length(w) >= 2))
    hedge = F.lower("sentence").rlike(r"\b(?:might|may be|perhaps|possibly|unclear|unknown)\b")
    return s.where(~F.col("sentence").endswith("?") & (words >= 4) & ~hedge).select(key, (F.col("i") + 1).alias("place"), "sentence").distinct()


def best_span(claims: DataFrame, key: str, claim: str, text: str) -> DataFrame:
    """``(key, place, overlap, coverage)``: the sentence of ``text`` that shares most words with ``claim``; ties to the greater coverage, then the earlier."""
    mine = F.array_distinct(F.filter(terms(F.col(claim)), lambda w: F.length(w) > 3))
    c = claims.where(F.col(key).isNotNull() & F.col(claim).isNotNull() & F.col(text).isNotNull()).select(key, mine.alias("mine"), F.posexplode(sentences(F.col(text))).alias("i", "s")).where(F.size("mine") > 0)
    overlap = F.size(F.array_intersect("mine", F.array_distinct(terms(F.col("s")))))
    scored = c.select(key, (F.col("i") + 1).alias("place"), overlap.alias("overlap"), F.round(overlap / F.size("mine"), 4).alias("coverage")).where("overlap > 0")
    top = F.max(F.struct("overlap", "coverage", (-F.col("place")).alias("before"))).alias("r")
    return scored.groupBy(key).agg(top).select(key, (-F.col("r.before")).alias("place"), "r.overlap", "r.coverage")


def years(text: Column) -> Column:
    """Distinct years 1900 to 2099 in a text, ascending."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![\d.-])((?:19|20)\d{2})(?![\d.])"), F.lit(1))))


def symbols(documents: DataFrame) -> DataFrame:
    """``(doc_id, kind, symbol)`` in the fenced code of notes; a line is code if an odd number of fences stands above it."""
    run = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").rlike(r"^\s*```")
    code = lines(documents).withColumn("fences", F.sum(F.when(fence, 1).otherwise(0)).over(run)).where(~fence & (F.col("fences") % 2 == 1))
    found = F.filter(F.array(*(F.struct(F.lit(kind).alias("kind"), F.regexp_extract("line", p, 1).alias("symbol")) for kind, p in SYMBOLS)), lambda x: x["symbol"] != "")
    return code.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.kind", "x.symbol").distinct()


def quota(files: DataFrame, category: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each category in the given order, with ``rank``."""
    return files.withColumn("rank", F.row_number().over(Window.partitionBy(category).orderBy(*order))).where(F.col("rank") <= most)
