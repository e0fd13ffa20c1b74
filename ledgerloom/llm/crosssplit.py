"""Same or nearly same questions across splits: an edit-distance segment join over canonical word sequences.

A question becomes the sorted sequence of its lower-case runs of letters and of digits, so that case,
punctuation, spacing and order do not count. The distance is the number of words to add or take away
(banded dynamic programming); a misspelt or replaced word costs two. An evaluation sequence of m words
is cut into k+1 segments, k the distance allowed for m: a training sequence within distance k must hold
one of them unchanged, no further than k places away.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.durable import checkpoint
from ledgerloom.functions.skew import SALTS, salted_join
from ledgerloom.llm.tokenize import ranks

#: Edits allowed per word of the evaluation question: ten words of a question of twenty may come, go or change (twice).
EDITS = 0.6
#: Words before and after a word that tell its place in a question.
AROUND = 2


def ordered_words(c: Column) -> Column:
    """Runs of letters and of digits in the order of the text, lower case; null and wordless texts give null."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}[\p{L}\p{M}]*|\p{N}+"), F.lit(0))
    return F.when(F.size(words) > 0, words)


def canonical_words(c: Column) -> Column:
    """The same words, sorted."""
    return F.array_sort(ordered_words(c))


def _numbers(words: Column) -> Column:
    """Hash of the version and ticket numbers, which must all be the same: they lead every join key."""
    return F.xxhash64(F.filter(words, lambda w: w.rlike(r"^\p{N}")))


@functools.lru_cache(maxsize=2)
def ordinary_words(path: str) -> frozenset[str]:
    """The words that are one token of a public vocabulary, with or without a blank before them, in lower case."""
    return frozenset(w for t in ranks(path) if (w := t.decode("utf-8", "ignore").strip().lower()).isalpha())


def _named(rows: DataFrame, key: str, text: str) -> DataFrame:
    named = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), ordered_words(F.col(text)).alias("ordered")).where("ordered IS NOT NULL").withColumn("words", F.array_sort("ordered"))
    return named.withColumn("cls", F.unhex(F.md5(F.array_join("words", " "))))


def _classes(rows: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Distinct word sequences with their numbers and the least of their orders, and which ids have them."""
    named = _named(rows, key, text)
    free = ~F.exists("words", lambda w: w.rlike(r"^\p{N}"))
    # The sorted words are made again from the ordered ones, so that only one list of words is shuffled.
    least = named.groupBy("cls").agg(F.min("ordered").alias("ordered")).select("cls", F.array_sort("ordered").alias("words"), "ordered")
    return checkpoint(least.withColumn("numbers", _numbers(F.col("words"))).withColumn("free", free)), named.select("cls", "id").distinct()


def _edits(n: Column, edits: float) -> Column:
    return F.floor(n * F.lit(edits)).cast("int")


def eval_segments(classes: DataFrame, edits: float = EDITS) -> DataFrame:
    """``(cls, free, n, k, at, key)``: the k+1 even segments of each sequence; ``at`` is the place of its first word, ``key`` hashes numbers and words."""
    n = F.size("words")
    k = F.least(_edits(n, edits), n - 1)
    cut = lambda i: F.floor(i * F.col("n") / (F.col("k") + 1)).cast("int")
    cuts = classes.select("cls", "free", "words", "numbers", n.alias("n"), k.alias("k")).select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    return cuts.select("cls", "free", "n", "k", cut(F.col("i")).alias("at"), F.xxhash64("numbers", F.slice("words", cut(F.col("i")) + 1, cut(F.col("i") + 1) - cut(F.col("i")))).alias("key"))


def segment_lengths(edits: float = EDITS) -> range:
    """The lengths that segments of any sequence may have: m words in k + 1 segments, k the whole part of ``edits`` m."""
    return range(1, math.ceil(1 / edits) + 1)


def train_substrings(classes: DataFrame, lengths: range) -> DataFrame:
    """``(cls, free, n, at, key)``: every run of so many words of each sequence."""
    n = F.size("words")

    def of(width: int) -> Column:
        places = F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(i.alias("at"), F.xxhash64("numbers", F.slice("words", i + 1, F.lit(width))).alias("key")))

    runs = F.flatten(F.array(*map(of, lengths)))
    return classes.select("cls", "free", n.alias("n"), F.explode(runs).alias("r")).select("cls", "free", "n", "r.at", "r.key")


def word_distance(a: list[str], b: list[str], most: int) -> int:
    """Words to add or take away to turn ``a`` into ``b``, or ``most + 1`` if more: dynamic programming within a band."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    row = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        new = [far] * (len(b) + 1)
        if i <= most:
            new[0] = i
        for j in range(low, high + 1):
            new[j] = row[j - 1] if x == b[j - 1] else min(row[j], new[j - 1], most) + 1
        row = new
        if min(row[max(0, low - 1) : high + 1]) > most:
            return far
    return min(row[len(b)], far)


def _misspelt(a: str, b: str) -> bool:
    """Whether two words are at most two letters (or one swap of neighbours) apart."""
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 3 or len(_minus(list(a), list(b))) > 2:
        return False
    return word_distance(list(a), list(b), 4) <= 4 and (len(a) != len(b) or sum(x != y for x, y in zip(a, b)) <= 2) or sorted(a) == sorted(b)


def _places(words: list[str], w: str) -> list[tuple[set[str], set[str]]]:
    """The words around each occurrence of a word: those before and those after it."""
    return [(set(words[max(0, i - AROUND) : i]), set(words[i + 1 : i + 1 + AROUND])) for i, x in enumerate(words) if x == w]


def renamed(a: list[str], b: list[str], only_a: list[str], only_b: list[str], known: frozenset[str]) -> bool:
    """Whether a name only in ``a`` stands in the place of a name only in ``b``, both lists in the order of the texts.

    A name is a word that is not known and no misspelling of a word that only the other text has. Two words
    stand in the same place if they share a word close before or close behind them.
    """
    x, y = [w for w in only_a if w not in known], [w for w in only_b if w not in known]
    if not x or not y:
        return False
    x = [w for w in x if not any(_misspelt(w, v) for v in only_b)]
    y = [w for w in y if not any(_misspelt(w, v) for v in only_a)]
    return any(p & r or q & s for v in x for w in y for p, q in _places(a, v) for r, s in _places(b, w))


def same_question(a: list[str], b: list[str], known: frozenset[str] | None, edits: float = EDITS) -> bool:
    """Whether ``b`` asks what ``a`` asks, by these two texts alone (words in the order of the texts).

    Few enough words differ, and no name stands in the place of another name. A name is a word that is not
    among the ``known`` ones; without known words no word counts as a name.
    """
    most = int(len(a) * edits)
    only_a, only_b = _minus(a, b), _minus(b, a)
    # Words that only one text has are a lower bound of the distance; a name costs less to tell than the distance.
    if len(only_a) + len(only_b) > most or known is not None and renamed(a, b, only_a, only_b, known):
        return False
    return word_distance(sorted(a), sorted(b), most) <= most


def _minus(a: list[str], b: list[str]) -> list[str]:
    """The elements of ``a`` that ``b`` lacks, repeats counted."""
    left = list(b)
    out = []
    for w in a:
        if w in left:
            left.remove(w)
        else:
            out.append(w)
    return out


def overlaps(train: DataFrame, evaluation: DataFrame, train_key: str = "id", train_text: str = "question", eval_key: str = "id", eval_text: str = "question", vocabulary: str | None = None, edits: float = EDITS) -> DataFrame:
    """``(probe_id, question_id)``: every training row with every evaluation row that asks the same thing.

    Rows of equal word sequences are one class; classes are joined on segment and numbers, verified once
    per pair, and their ids put back at the end (a pair per id is what is asked for). Whether two texts ask
    the same is told from the two alone, so that a pair's answer is the same whatever else is in the tables:
    a pair is dropped where a name stands in the place of another name and is no misspelling of it, a name
    being a word that the public ``vocabulary`` (a path, the same on every executor) does not hold as one
    token. Null, empty and wordless questions never match; repeated rows count once.
    """
    e, e_ids = _classes(evaluation, eval_key, eval_text)
    t, t_ids = _classes(train, train_key, train_text)
    # Only training classes with the numbers of some evaluation class can have a partner; questions without
    # numbers share one key prefix, so their part of each join is salted.
    some = salted_join(t, e.select("numbers").distinct(), ["numbers"], ["cls"], "left_semi")
    parts = F.when(F.col("free"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    segments = eval_segments(e, edits).select(F.col("cls").alias("e"), F.col("n").alias("m"), "k", F.col("at").alias("from"), "key", F.explode(parts).alias("part"))
    part = F.when(F.col("free"), F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")).otherwise(0)
    runs = train_substrings(some, segment_lengths(edits)).select(F.col("cls").alias("t"), "n", "at", "key", part.alias("part"))
    # Segments and runs are many rows a class, which the planner does not count: sent to the driver they would be
    # many times what a broadcast may hold. Texts are kept compressed, so their size is not told either.
    near = runs.join(segments.hint("merge"), ["key", "part"]).where((F.abs(F.col("n") - F.col("m")) <= F.col("k")) & (F.abs(F.col("at") - F.col("from")) <= F.col("k"))).select("e", "t").distinct()
    pairs = near.join(e.select(F.col("cls").alias("e"), F.col("ordered").alias("a"), F.col("numbers").alias("na")).hint("merge"), "e").join(t.select(F.col("cls").alias("t"), F.col("ordered").alias("b"), F.col("numbers").alias("nb")).hint("merge"), "t").where("na = nb").select("e", "t", "a", "b")
    # Different words that only one of the two has: never more than the distance.
    pairs = pairs.where(F.size(F.array_except("a", "b")) + F.size(F.array_except("b", "a")) <= _edits(F.size("a"), edits))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ordinary_words(vocabulary) if vocabulary else None
        for batch in batches:
            kept = [same_question(a, b, known, edits) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    same = pairs.mapInArrow(verify, "e binary, t binary")
    return salted_join(salted_join(t_ids.withColumnsRenamed({"cls": "t", "id": "probe_id"}), same, ["t"], ["probe_id"]), e_ids.withColumnsRenamed({"cls": "e", "id": "question_id"}), ["e"], ["probe_id"]).select("probe_id", "question_id").distinct()


def overlap_counts(pairs: DataFrame, train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """``(split, source_id, n_pairs, n_questions)`` of overlaps per evaluation split and probe source (``unknown`` if null)."""
    split = evaluation.select(F.col("id").alias("question_id"), F.coalesce("split", F.lit("unknown")).alias("split")).distinct()
    source = train.select(F.col("id").alias("probe_id"), F.coalesce("source_id", F.lit("unknown")).alias("source_id")).distinct()
    return pairs.join(split, "question_id").join(source, "probe_id").groupBy("split", "source_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("question_id").alias("n_questions"))
