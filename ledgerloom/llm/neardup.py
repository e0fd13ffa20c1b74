"""Near-duplicate texts within a concept: segment-popcount embedding, grid join, Manhattan lower bound, exact check.

The fingerprint of a text is the set of its distinct words, hashed; its embedding counts the words in
each of 32 segments of the hash space. Two texts of x and y words whose Jaccard similarity is t or more
share at least o = ceil((x + y) t / (1 + t)) words and differ in at most x + y - 2 o, and the Manhattan
distance of their counts is never more than that.

Counts alone would leave a fixed share of all pairs of a concept to compare, so the cells of the grid
carry words: sorted by frequency, two such texts have their first common words near the front. A cell
is a concept with one word, and takes on further words until it is expected to hold few enough texts, or
holds as many words as a partner must share. Every pair at or above the threshold shares a cell,
whatever the cells' sizes; nothing is capped. Frequencies come from sketches of fixed size that never
tell too little: a frequency told too high makes a cell of more words, never a lost pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.durable import checkpoint
from ledgerloom.functions.keys import spelling_key
from ledgerloom.functions.skew import salted_join
from ledgerloom.operators.components import components

#: The least similarity, as a fraction.
SIMILARITY = (3, 5)
#: Texts expected in a cell, at most, before its words are joined by a further one.
CELL = 200
#: Bits of a slot's number in the two rows of a frequency sketch, and its steps per doubling.
SLOT_BITS, STEPS = 20, 4
#: Classes whose cells make up a task of the grid join.
CLASSES_A_TASK = 8192
#: Bits of the sketch that tells which values occur at all; a false hit costs a row, never a result.
SKETCH_BITS = 24


def fingerprints(claims: DataFrame, key: str, concept: str, text: str) -> DataFrame:
    """``(id, cls, home, words)``: class of equal texts, hashed concept and sorted hashes of the distinct words."""
    named = claims.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), spelling_key(F.col(concept)).alias("home"), F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w"))
    named = named.where((F.size("w") > 0) & (F.col("home") != ""))
    words = F.array_sort(F.array_distinct(F.transform("w", lambda x: F.xxhash64(x))))
    hashed = named.select("id", F.xxhash64("home").alias("home"), words.alias("words"))
    # Two hashes of 64 bits over the same words from different beginnings stand for the text.
    half = lambda *c: F.lpad(F.hex(F.xxhash64(*c)), 16, "0")
    return hashed.select("id", F.unhex(F.concat(half("home", "words"), half(F.lit("cls"), "words", "home"))).alias("cls"), "home", "words")


def sketch(values: DataFrame) -> np.ndarray:
    """Bits of the hashes in the only column, in an array of fixed size (at most 2**18 rows reach the driver)."""
    v = F.col(values.columns[0]).bitwiseAND(F.lit((1 << SKETCH_BITS) - 1))
    bit = F.expr(f"shiftleft(1L, cast({values.columns[0]} & 63 AS int))")
    out = np.zeros(1 << (SKETCH_BITS - 6), dtype=np.uint64)
    for slot, bits in values.select(F.shiftright(v, 6).cast("int").alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit")).collect():
        out[slot] = bits & 0xFFFFFFFFFFFFFFFF
    return out


def seen(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = hashes.view(np.uint64) & np.uint64((1 << SKETCH_BITS) - 1)
    return (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1


def frequency_sketch(counted: DataFrame) -> np.ndarray:
    """Greatest frequency per slot of ``(v, n)``, in two rows of 2**20 bytes, as steps of its logarithm, rounded up; 0 stands for one or none.

    A value is in one slot of each row and the lesser of both is told for it: never less than its
    frequency. Words of a slot are not added up, so that rare words do not make each other frequent. At
    most 2**18 rows, eight slots each, reach the driver however many values there are.
    """
    mask = (1 << SLOT_BITS) - 1
    code = F.least(F.lit(255), F.ceil(F.log2("n") * STEPS)).cast("int")
    places = F.explode(F.array(F.col("v").bitwiseAND(F.lit(mask)), F.shiftright("v", SLOT_BITS).bitwiseAND(F.lit(mask)) + (1 << SLOT_BITS)))
    slots = counted.where("n > 1").select(code.alias("code"), places.alias("slot")).groupBy(F.shiftright("slot", 3).cast("int").alias("at"))
    out = np.zeros(2 << SLOT_BITS, dtype=np.uint8)
    for r in slots.agg(*(F.coalesce(F.max(F.when(F.col("slot").bitwiseAND(F.lit(7)) == i, F.col("code"))), F.lit(0)).cast("int").alias(f"c{i}") for i in range(8))).collect():
        out[8 * r[0] : 8 * r[0] + 8] = r[1:]
    return out.reshape(2, -1)


def frequency(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """What a sketch tells for each value, 0 for values seen once at most."""
    mask = np.int64((1 << SLOT_BITS) - 1)
    code = np.minimum(table[0][values & mask], table[1][(values >> np.int64(SLOT_BITS)) & mask]).astype(float)
    return np.where(code > 0, np.exp2(code / STEPS), 0.0)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a.view(np.uint64) ^ (b.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(31))).view(np.int64)


class Cells:
    """Grid cells and embeddings of a batch of fingerprints, from the frequencies of words and sizes of concepts."""

    def __init__(self, words: np.ndarray, homes: np.ndarray, large: np.ndarray, total: int, similarity: tuple[int, int], cell: int) -> None:
        self.words, self.homes, self.large, self.total, self.similarity, self.cell = words, homes, large, max(total, 1), similarity, cell

    def of(self, home: np.ndarray, n: np.ndarray, flat: np.ndarray, doubtful: bool = False) -> tuple[np.ndarray, ...]:
        """``row, key, q`` of every cell of every row; q is how many words before the cell's last one are not in the cell.

        If ``doubtful``, only cells that are expected to be small enough but may be larger, as all their words
        are frequent: those not counted before, which are the ones behind a cell that was found to be large.
        """
        row = np.repeat(np.arange(len(n)), n)
        df = np.minimum(frequency(self.words, flat), self.total)
        order = np.lexsort((flat, df, row))
        t, df = flat[order], df[order]
        place = np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n)
        up, down = self.similarity
        least = -(-n * up // down)
        slack, least = (n - least)[row], least[row]
        share = (np.minimum(np.maximum(frequency(self.homes, home), 1), self.total) / self.total)[row]
        # Chains of words in order of place: where each ends, its hash, how many texts are expected to hold it.
        end = np.flatnonzero((place <= slack) & (df > 0))
        key, held, often, size, out = _mix(home[row[end]], t[end]), df[end] * share[end], df[end] > self.cell, 1, []
        fresh = np.full(len(end), not self.large.any())
        while len(end):
            counted = frequency(self.large, key)
            fresh, held = fresh | ((counted > self.cell) & (held <= self.cell)), np.maximum(held, counted)
            few = held <= self.cell
            cells = few & often & fresh if doubtful else few | (least[end] <= size)
            out.append((row[end[cells]], key[cells], place[end[cells]] - size + 1))
            base, key, held, often, fresh = end[~few], key[~few], held[~few], often[~few], fresh[~few]
            longer = []
            for step in range(1, int(n.max(initial=1))):
                inside = base + step < len(t)
                base, key, held, often, fresh = base[inside], key[inside], held[inside], often[inside], fresh[inside]
                k = base + step
                ok = (row[k] == row[base]) & (place[k] <= slack[k] + size)
                base, key, held, often, fresh, k = base[ok], key[ok], held[ok], often[ok], fresh[ok], k[ok]
                if not len(base):
                    break
                longer.append((k, _mix(key, t[k]), held * df[k] / self.total, often, fresh))
            if not longer:
                break
            end, key, held, often, fresh = (np.concatenate(x) for x in zip(*longer))
            size += 1
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3

    def doubtful(self, b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column(2)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(self.of(b.column(1).to_numpy(), np.diff(offsets), lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], True)[1])], ["v"])

    def batch(self, b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column(2)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        n = np.diff(offsets)
        flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        row, key, q = self.of(b.column(1).to_numpy(), n, flat)
        low, high = embed(n, flat)
        take = pa.array(row)
        return pa.RecordBatch.from_arrays([pa.array(key), b.column(0).take(take), pa.array(n[row] << 32 | q), pa.array(low[row]), pa.array(high[row])], ["key", "h", "nq", "low", "high"])


def embed(n: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of words per segment, four bits each (15 stands for more, which keeps the lower bound), in two longs."""
    row = np.repeat(np.arange(len(n)), n)
    counts = np.minimum(np.bincount(row * 32 + ((flat >> 40) & 31), minlength=32 * len(n)).reshape(-1, 32), 15).astype(np.uint64)
    shifts = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return (counts[:, :16] << shifts).sum(axis=1, dtype=np.uint64).view(np.int64), (counts[:, 16:] << shifts).sum(axis=1, dtype=np.uint64).view(np.int64)


def manhattan(a: str, b: str) -> Column:
    """Distance of two embeddings, from their columns ``low`` and ``high``."""
    terms = [f"abs((shiftright({a}.{c}, {s}) & 15) - (shiftright({b}.{c}, {s}) & 15))" for c in ("low", "high") for s in range(0, 64, 4)]
    return F.expr(" + ".join(terms))


def grid(classes: DataFrame, similarity: tuple[int, int] = SIMILARITY, cell: int = CELL) -> DataFrame:
    """``(key, h, nq, low, high)``: the cells of every class with its size and embedding; ``h`` is a hash of the class.

    A cell holds at most ``cell`` classes, unless they share all the words that one of them must share with a partner.
    """
    total = classes.count()
    words = frequency_sketch(classes.select(F.explode("words").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    homes = frequency_sketch(classes.groupBy(F.col("home").alias("v")).agg(F.count(F.lit(1)).alias("n")))
    hashed = classes.select(F.xxhash64("cls").alias("h"), "home", "words")
    large = np.zeros((2, 1 << SLOT_BITS), dtype=np.uint8)
    # Words that go together make a cell larger than expected: such cells are counted and get longer too, until none is left.
    while True:
        cells = Cells(words, homes, large, total, similarity, cell)

        def doubtful(batches: Iterator[pa.RecordBatch], cells: Cells = cells) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield cells.doubtful(b)

        grown = checkpoint(hashed.mapInArrow(doubtful, "v bigint").groupBy("v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell))
        if grown.isEmpty():
            break
        large = np.maximum(large, frequency_sketch(grown))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield cells.batch(b)

    # A hash of 64 bits stands for a class: a row is half as wide, and joining back by it can only add candidates.
    return hashed.mapInArrow(run, "key bigint, h bigint, nq bigint, low bigint, high bigint")


def candidates(classes: DataFrame, similarity: tuple[int, int] = SIMILARITY, cell: int = CELL) -> DataFrame:
    """``(a, b)``, hashes of the classes of all pairs that share a cell of the grid and whose embeddings are near enough."""
    up, down = similarity
    # As many partitions as keep one at some ten megabytes whatever there is in all; both sides are one exchange.
    keys = grid(classes, similarity, cell).repartition(min(100_000, max(classes.sparkSession.sparkContext.defaultParallelism, -(-classes.count() // CLASSES_A_TASK))), "key")
    n = lambda x: f"shiftright({x}.nq, 32)"
    q = lambda x: f"({x}.nq & 4294967295)"
    shared = f"ceil(({n('a')} + {n('b')}) * {up} / {up + down})"
    fits = f"a.key = b.key AND a.h < b.h AND {shared} <= least({n('a')}, {n('b')}) AND {q('a')} <= {n('a')} - {shared} AND {q('b')} <= {n('b')} - {shared}"
    near = keys.alias("a").join(keys.alias("b"), F.expr(fits) & (manhattan("a", "b") <= F.expr(f"{n('a')} + {n('b')} - 2 * {shared}")))
    return near.select(F.col("a.h").alias("a"), F.col("b.h").alias("b")).distinct()


def similar_pairs(classes: DataFrame, similarity: tuple[int, int] = SIMILARITY, cell: int = CELL) -> DataFrame:
    """``(a, b)``: all pairs of classes of one concept at or above the similarity; ``classes`` is a checkpointed ``(cls, home, words)``."""
    up, down = similarity
    found = checkpoint(candidates(classes, similarity, cell))
    involved = sketch(found.select(F.explode(F.array("a", "b")).alias("h")))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield x.filter(pa.array(seen(involved, x.column(0).to_numpy(zero_copy_only=False))))

    some = classes.select(F.xxhash64("cls").alias("h"), "cls", "home", "words").mapInArrow(pick, "h bigint, cls binary, home bigint, words array<bigint>")
    side = lambda h, x: some.select(F.col("h").alias(h), F.struct("cls", "home", "words").alias(x))
    full = found.join(side("a", "x"), "a").join(side("b", "y"), "b")
    same = F.size(F.array_intersect("x.words", "y.words"))
    return full.where((F.col("x.home") == F.col("y.home")) & (same * down >= (F.size("x.words") + F.size("y.words") - same) * up)).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))


def groups(claims: DataFrame, key: str = "claim_id", concept: str = "concept", text: str = "claim_text", similarity: tuple[int, int] = SIMILARITY, cell: int = CELL) -> DataFrame:
    """``(group_id, claim_id, n_links)``: one row per claim with at least one word; ``group_id`` is the least id of its group.

    Claims of one concept (spelling ignored) are linked if their distinct words have at least the
    similarity; a group is everything linked directly or through others. Equal texts are one class and
    compared once; ``n_links`` counts the other classes a claim's class is linked with. Claims without
    id, concept or words are in no group; repeated rows count once; an empty table gives no rows.
    """
    rows = fingerprints(claims, key, concept, text)
    classes = checkpoint(rows.groupBy("cls").agg(F.first("home").alias("home"), F.first("words").alias("words")))
    links = checkpoint(similar_pairs(classes, similarity, cell))
    label = components(links, "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    members = rows.select("cls", "id").distinct()
    named = members.join(label.withColumnRenamed("node", "cls"), "cls", "left").join(degree.withColumnRenamed("node", "cls"), "cls", "left").withColumn("g", F.coalesce("label", "cls"))
    least = named.groupBy("g").agg(F.min("id").alias("group_id"))
    return named.join(least, "g").select("group_id", F.col("id").alias("claim_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def group_pairs(claims: DataFrame, key: str = "claim_id", concept: str = "concept", text: str = "claim_text") -> DataFrame:
    """``(claim_id_a, claim_id_b)``: all pairs within the groups of ``groups``, smaller id first."""
    rows = fingerprints(claims, key, concept, text)
    classes = checkpoint(rows.groupBy("cls").agg(F.first("home").alias("home"), F.first("words").alias("words"), (F.min("id") < F.max("id")).alias("several")))
    label = components(checkpoint(similar_pairs(classes)), "a", "b").withColumnRenamed("node", "cls")
    # Only classes that are linked or stand for several ids have pairs.
    heads = label.unionByName(classes.where("several").select("cls", F.col("cls").alias("label"))).groupBy("cls").agg(F.min("label").alias("g"))
    several = checkpoint(salted_join(rows.select("cls", "id"), heads, ["cls"], ["id"], salts=8).select("g", "id").distinct())
    a, b = several.alias("a"), several.alias("b")
    return a.join(b, F.expr("a.g = b.g AND a.id < b.id")).select(F.col("a.id").alias("claim_id_a"), F.col("b.id").alias("claim_id_b"))
