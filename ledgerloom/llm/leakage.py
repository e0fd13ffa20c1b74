"""Evaluation passages inside corpus documents: rare n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.spread import spread

#: Words of a seed, and the number of items that may share one that is kept in any case.
SEED_WORDS, SEED_ITEMS = 3, 3
#: Share of an item's words that must be found in one stretch, and the share of words in that stretch that may differ.
SHARE, CHANGED = 0.5, 0.15
#: Parts into which a word may be split, at most.
SPLITS = 4
#: Words of items held by a task at a time; more items are taken in blocks.
BLOCK_WORDS = 2_000_000

_INVISIBLE = re.compile("[­​-‏ -‮⁠-⁤﻿\x00-\x08\x0e-\x1f\x7f]")
_SPLIT = re.compile("(?<=[^\\W\\d_])[-‐][ \t]*\r?\n[>\\s*|#]*(?=[^\\W\\d_])")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,80}>")
_WORD = re.compile(r"[^\W_]+")
_ASCII = {i: chr(i).lower() if chr(i).isalnum() else None if i < 9 or 13 < i < 32 or i == 127 else " " for i in range(128)}


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters and digits, words split over lines joined, tags and invisible characters taken out."""
    plain = text.isascii()
    if not plain:
        text = _INVISIBLE.sub("", text)
    if "-\n" in text or "\u2010" in text or "- \n" in text or "-\r" in text:
        text = _SPLIT.sub("", text)
    if "</" in text:
        text = _TAG.sub(" ", text)
    return text.translate(_ASCII).split() if plain else _WORD.findall(text.lower())


def align(item: list[str], window: list[str]) -> list[bool]:
    """Best local alignment (Smith-Waterman; match 1, change, addition or loss -1), as its steps: whether a word matched or differs.

    Up to ``SPLITS`` neighbouring words of the window that make up one word of the item match as one.
    """
    code = {w: i for i, w in enumerate(dict.fromkeys(item))}
    a = np.array([code[w] for w in item])
    b = np.array([code.get(w, -1) for w in window])
    joined = {k: np.array([code.get("".join(x), -1) for x in zip(*(window[i:] for i in range(k)))], dtype=np.int64) for k in range(2, min(SPLITS, len(window)) + 1)}
    joined = {k: x for k, x in joined.items() if (x >= 0).any()}
    m, n = len(a), len(b)
    h = np.zeros((m + 1, n + 1), dtype=np.int32)
    slope = np.arange(n + 1)
    for i in range(1, m + 1):
        t = np.zeros(n + 1, dtype=np.int32)
        t[1:] = np.maximum(h[i - 1, :-1] + np.where(b == a[i - 1], 1, -1), h[i - 1, 1:] - 1)
        for k, x in joined.items():
            t[k:] = np.where(x == a[i - 1], np.maximum(t[k:], h[i - 1, :-k] + 1), t[k:])
        np.maximum(t, 0, out=t)
        h[i] = np.maximum.accumulate(t + slope) - slope
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    steps: list[bool] = []
    while i and j and h[i, j] > 0:
        if h[i, j] == h[i - 1, j - 1] + 1 and b[j - 1] == a[i - 1]:
            i, j, match = i - 1, j - 1, True
        elif parts := next((k for k, x in joined.items() if j >= k and x[j - k] == a[i - 1] and h[i, j] == h[i - 1, j - k] + 1), 0):
            i, j, match = i - 1, j - parts, True
        elif h[i, j] == h[i - 1, j - 1] - 1:
            i, j, match = i - 1, j - 1, False
        elif h[i, j] == h[i - 1, j] - 1:
            i, match = i - 1, False
        else:
            j, match = j - 1, False
        steps.append(match)
    return steps[::-1]


def stretch(steps: list[bool]) -> tuple[int, int]:
    """Matched and differing words of the part of an alignment with most matched words in which few enough differ.

    An alignment may run on into a look-alike passage that follows; such a tail does not count against the rest.
    """
    same, other = sum(steps), len(steps) - sum(steps)
    if other <= _allowed(same):
        return same, other
    best = (0, 0)
    for i, first in enumerate(steps):
        if not first:
            continue
        same = other = 0
        for match in steps[i:]:
            same, other = same + match, other + (not match)
            if match and same > best[0] and other <= _allowed(same):
                best = same, other
    return best


def _allowed(same: int) -> float:
    """Words that may differ in a stretch with so many matched ones."""
    return max(2, CHANGED / (1 - CHANGED) * same)


class Items:
    """The words of a block of items, and an automaton of their rare seeds written without blanks, so that split words do not hide them."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.words = {i: w for i, t in rows if len(w := words_of(t)) > 0}
        places: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        for i, w in self.words.items():
            for k, g in enumerate(_runs(w)):
                places[g].append((i, k))
        held = {g: len({i for i, _ in v}) for g, v in places.items()}
        self.need: dict[int, int] = {}
        seeds: dict[str, tuple[int, set[tuple[int, int]]]] = {}
        for i, w in self.words.items():
            # What many items share has no rare seeds: every half of an item keeps its rarest ones, enough to outlast the words that may differ.
            runs = _runs(w)
            kept = {k for k, g in enumerate(runs) if held[g] <= SEED_ITEMS} | _rarest(w, [held[g] for g in runs])
            self.need[i] = _needed(w, [k in kept for k in range(len(runs))])
            for k in kept:
                text = "".join(runs[k])
                seeds.setdefault(text, (len(text), set()))[1].add((i, k))
        self.automaton = ahocorasick.Automaton()
        for text, value in seeds.items():
            self.automaton.add_word(text, value)
        if seeds:
            self.automaton.make_automaton()

    def found(self, text: str) -> list[tuple[int, int, int]]:
        """``(item, matched words, differing words)`` of the items in a text."""
        if not self.words:
            return []
        w = words_of(text)
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        starts: list[int] = []
        for end, (length, seeds) in self.automaton.iter("".join(w)):
            starts = starts or [0, *accumulate(map(len, w))]
            at = bisect_right(starts, end - length + 1) - 1
            for i, p in seeds:
                hits[i].append((at, p))
        out = []
        for i, pairs in hits.items():
            if len({p for _, p in pairs}) < self.need[i]:
                continue
            item, best = self.words[i], (0, 0)
            for low, high in _groups(sorted(at - p for at, p in pairs), len(item)):
                same, other = stretch(align(item, w[max(0, low - len(item) // 2) : high + len(item) + len(item) // 2 + 1]))
                if same > best[0]:
                    best = same, other
            if best[0] >= SHARE * len(item):
                out.append((i, *best))
        return out


def _runs(w: list[str]) -> list[tuple[str, ...]]:
    """The runs of words that may be seeds, in order; the whole of a shorter item."""
    n = min(SEED_WORDS, len(w))
    return [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]


def _rarest(w: list[str], count: list[int]) -> set[int]:
    """Places of the rarest seeds of every stretch of half an item: more than its differing words can break, or all."""
    n, half = min(SEED_WORDS, len(w)), int(np.ceil(SHARE * len(w)))
    width = min(max(1, half - n + 1), len(count))
    most = n * int(_allowed(half)) + 1
    return {k for low in range(len(count) - width + 1) for k in sorted(range(low, low + width), key=count.__getitem__)[:most]}


def _needed(w: list[str], kept: list[bool]) -> int:
    """Seeds that any stretch which counts as found must share: those of the poorest stretch of each length, less those that its differing words can break."""
    n, half = min(SEED_WORDS, len(w)), int(np.ceil(SHARE * len(w)))
    sums = np.concatenate([[0], np.cumsum(kept)])
    least = len(w)
    for length in range(half, len(w) + 1):
        width = min(max(1, length - n + 1), len(kept))
        least = min(least, int((sums[width:] - sums[:-width]).min()) - n * int(_allowed(length)))
    return max(1, least)


#: The index a worker has built last, by the token of its job: the tasks of a job share it.
_BUILT: dict[str, Items] = {}


def _index(token: str, rows: list[tuple[int, str]]) -> Items:
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = Items(rows)
    return _BUILT[token]


def _groups(starts: list[int], gap: int) -> Iterator[tuple[int, int]]:
    """Ranges of the places where an item may begin, cut where they lie more than an item apart."""
    low = last = starts[0]
    for s in starts[1:]:
        if s - last > gap:
            yield low, last
            low = s
        last = s
    yield low, last


def leaked_items(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, item_id, matched, differing)``: items of which a document holds at least half in one stretch.

    Seeds are the three-word runs of an item that at most three items share, and the rarest ones of every
    half of an item however many share them. The seeds meet the documents in a broadcast join: an automaton
    looks for them in a text without its blanks, so that split words do not hide them, and a seed begins an
    alignment of the whole item with the words around it. Every word of every document is read. Items are a
    bounded set: their words are counted, and beyond ``BLOCK_WORDS`` they are taken in blocks, with a scan of
    the documents each; blocks change no result, as each item keeps enough seeds whatever their rarity.
    Nothing is shuffled.

    Null and wordless texts give no row; repeated rows give repeated results merged by the caller's
    distinct; ties between stretches go to the first with most matched words.
    """
    named = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).alias("item_id"), F.col(item_text).alias("t")).distinct()
    total = named.agg(F.sum(F.length("t") / 2 + 1)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_words))
    kinds = f"doc_id {documents.schema[key].dataType.simpleString()}, item_id {items.schema[item_key].dataType.simpleString()}, matched int, differing int"
    parts = []
    for block in range(blocks):
        held = documents.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in named.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()])

        def run(batches: Iterator[pa.RecordBatch], held: Broadcast = held, token: str = uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = _index(token, held.value)
            for batch in batches:
                rows = [(k, *x) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for x in index.found(t)]
                if rows:
                    a, b, c, d = map(list, zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(a, batch.schema.field(0).type), pa.array(b), pa.array(c, pa.int32()), pa.array(d, pa.int32())], ["doc_id", "item_id", "matched", "differing"])

        parts.append(spread(documents.where(F.col(text).isNotNull()).select(key, text)).mapInArrow(run, kinds))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def leak_report(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """``(item_id, split, n_documents)``: in how many documents each test item was found, 0 included."""
    found = leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"))
    return items.select("item_id", "split").distinct().join(found, "item_id", "left").select("item_id", "split", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))
