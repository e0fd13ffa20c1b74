"""Reading level of documents: frequency-ranked vocabulary coverage and sentence complexity, calibrated on graded documents."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.durable import checkpoint
from ledgerloom.functions.skew import salted_join

#: Share of a document's words that its vocabulary must cover.
COVER = 0.9
#: Ranked words every task holds, at most; ranks of rarer words are looked up by a join.
RANKED = 20_000
#: Levels, from plain to most demanding.
LOWEST, HIGHEST = 1, 5
#: What the level is a linear function of.
FEATURES = ("log_rank", "log_sentence", "word_length", "long_share", "comma_rate")

_FRONT = re.compile(r"\A\s*---\s*\n.*?\n---\s*(?:\n|\Z)", re.S)
_CODE = re.compile(r"```.*?(?:```|\Z)", re.S)
_WORD = re.compile(r"[^\W\d_]+")
_STOP = re.compile(r"[.!?…。！？]+(?=[\s\"'”’)\]]|\Z)|\n\s*\n|\n(?=\s*(?:[-*|#>]|\d+[.)]\s))")
_ASCII = {i: chr(i).lower() if chr(i).isalpha() else " " for i in range(128)}


def prose(text: str) -> str:
    """The text without front matter and fenced code."""
    if "---" in text[:64]:
        text = _FRONT.sub("", text)
    return _CODE.sub(" ", text) if "```" in text else text


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters."""
    return text.translate(_ASCII).split() if text.isascii() else _WORD.findall(text.lower())


def vocabulary(documents: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n)`` over all documents; each task adds up its own batches first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.update(words_of(prose(t)))
            if len(held) > 200_000:
                yield _counted(held)
                held.clear()
        if held:
            yield _counted(held)

    return documents.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


def ranks(words: DataFrame) -> DataFrame:
    """``(n, n_words, rank)`` per frequency: the rank that words seen n times share, which is the number of words seen at least as often.

    Ranking works on the frequencies, not the words: there are at most as many as the square root of
    twice the words of the corpus.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    return words.groupBy("n").agg(F.count(F.lit(1)).alias("n_words")).select("n", "n_words", F.sum("n_words").over(order).alias("rank"))


def features(documents: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text", ranked: int = RANKED) -> DataFrame:
    """``(doc_id, coverage_rank, n_words, …FEATURES)`` of every document; a document without words has null features.

    ``coverage_rank`` is the size of the smallest frequency-ranked vocabulary that covers ``COVER`` of its words.
    The most frequent words are held by the tasks. A document that needs a rarer one hands out its rarer
    words, which meet their ranks in a join; documents of equal such words are looked up once.
    """
    order = checkpoint(ranks(words))
    total, least = order.agg(F.coalesce(F.max("rank"), F.lit(0)), F.min(F.when(F.col("rank") <= ranked, F.col("n")))).first()
    # The most frequent words have few frequencies of their own, so no key of this join is hot.
    held = {r.word: r.rank for r in words.where(F.col("n") >= least).join(order.where(F.col("rank") <= ranked), "n").select("word", "rank").toLocalIterator()} if least is not None else {}
    deep = total > ranked
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, beyond = held.get, total + 1
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = prose(t or "")
                w = words_of(t)
                if not w:
                    out.append((k, None, 0, *[None] * len(FEATURES), None, None))
                    continue
                r = np.sort(np.array([get(x, beyond) for x in w]))
                at = int(np.ceil(COVER * len(r))) - 1
                rank, need, rest = int(r[at]), None, None
                if deep and rank == beyond:
                    rest = sorted(x for x in w if x not in held)
                    need = at - (len(w) - len(rest)) + 1
                sizes = np.array(list(map(len, w)))
                sentences = max(1, sum(1 for p in _STOP.split(t) if p and any(map(str.isalpha, p))))
                out.append((k, rank, len(w), float(np.log(rank)), float(np.log(len(w) / sentences)), float(sizes.mean()), float((sizes > 9).mean()), t.count(",") / sentences, need, rest))
            columns = list(zip(*out)) or [()] * (5 + len(FEATURES))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[3:-2]), pa.array(columns[-2], pa.int32()), pa.array(columns[-1], pa.list_(pa.string()))], ["doc_id", "coverage_rank", "n_words", *FEATURES, "need", "rest"])

    names = ["doc_id", "coverage_rank", "n_words", *FEATURES]
    shape = f"doc_id {kind}, coverage_rank bigint, n_words bigint, " + ", ".join(f"{f} double" for f in FEATURES) + ", need int, rest array<string>"
    rows = documents.select(key, text).mapInArrow(run, shape)
    if not deep:
        return rows.select(names)
    rows = checkpoint(rows.withColumn("text_key", F.when(F.col("need").isNotNull(), F.unhex(F.md5(F.concat_ws(" ", F.col("need").cast("string"), "rest"))))))
    exact = _rare_ranks(rows.where("need IS NOT NULL"), words, order, least, total)
    found = salted_join(rows.where("need IS NOT NULL").drop("coverage_rank", "log_rank"), exact, ["text_key"], ["doc_id", "n_words"])
    return rows.where("need IS NULL").select(names).unionByName(found.withColumn("log_rank", F.log(F.col("coverage_rank").cast("double"))).select(names))


def _rare_ranks(rows: DataFrame, words: DataFrame, order: DataFrame, least: int | None, total: int) -> DataFrame:
    """``(text_key, coverage_rank)``: the rank of the ``need``-th of the rarer words ``rest``, once per key."""
    rarer = words if least is None else words.where(F.col("n") < least)
    ranked = salted_join(rarer, order.select("n", "rank"), ["n"], ["word"]).select("word", "rank")
    asked = rows.groupBy("text_key").agg(F.first("need").alias("need"), F.first("rest").alias("rest")).select("text_key", "need", F.explode("rest").alias("word"))
    known = asked.join(ranked, "word", "left").select("text_key", "need", F.coalesce("rank", F.lit(total + 1)).alias("rank"))
    return known.groupBy("text_key").agg(F.sort_array(F.collect_list("rank")).alias("r"), F.first("need").alias("need")).select("text_key", F.element_at("r", F.col("need")).alias("coverage_rank"))


def graded(labels: DataFrame) -> DataFrame:
    """``(doc_id, level)``: the mean of the levels its graders gave; null levels and repeated rows do not count."""
    return labels.where("doc_id IS NOT NULL AND level IS NOT NULL").select("doc_id", "grader", "level").distinct().groupBy("doc_id").agg(F.avg("level").alias("level"))


def calibration(feature_rows: DataFrame, labels: DataFrame) -> tuple[float, ...] | None:
    """Intercept and weights of the least-squares fit of the graded level, from one SQL aggregation of sums and products.

    Null without graded documents; a direction the labels say nothing about gets no weight.
    """
    x = [F.lit(1.0), *(F.col(f) for f in FEATURES)]
    joined = feature_rows.where("n_words > 0").join(graded(labels), "doc_id")
    sums = [F.sum(a * b) for i, a in enumerate(x) for b in x[i:]] + [F.sum(a * F.col("level")) for a in x]
    row = joined.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()
    if row is None or row[0] is None:
        return None
    size, at = len(x), 0
    m, v = np.zeros((size, size)), np.array(row[-size:], dtype=float)
    for i in range(size):
        for j in range(i, size):
            m[i, j] = m[j, i] = row[at]
            at += 1
    ridge = 1e-6 * np.diag(np.diag(m))
    return tuple(float(c) for c in np.linalg.lstsq(m + ridge, v, rcond=None)[0])


def estimate(weights: tuple[float, ...]) -> Column:
    """The fitted level of a row of features, between the lowest and the highest."""
    value = F.lit(weights[0])
    for f, w in zip(FEATURES, weights[1:]):
        value = value + F.col(f) * w
    return F.greatest(F.lit(float(LOWEST)), F.least(F.lit(float(HIGHEST)), value))


def reading_levels(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, coverage_rank, n_words, level, score)``: a level from 1 (plain) to 5 for every document.

    ``score`` is the calibrated estimate, ``level`` the nearest whole level. Documents without words, and
    all if nothing is graded, have null level and score; repeated rows are kept as they are.
    """
    words = checkpoint(vocabulary(documents, text))
    rows = checkpoint(features(documents, words, key, text))
    weights = calibration(rows, labels)
    score = F.when(F.col("n_words") > 0, estimate(weights)) if weights else F.lit(None).cast("double")
    return rows.select("doc_id", "coverage_rank", "n_words", F.round(score).cast("int").alias("level"), F.round(score, 3).alias("score"))


def level_profile(levels: DataFrame, documents: DataFrame) -> DataFrame:
    """``(kind, level, n_documents, n_words)``: the corpus by kind and level; unknown kinds as ``unknown``, no level as 0."""
    kinds = documents.select("doc_id", F.coalesce("kind", F.lit("unknown")).alias("kind"))
    return levels.join(kinds, "doc_id").groupBy("kind", F.coalesce("level", F.lit(0)).alias("level")).agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_words").alias("n_words"))
