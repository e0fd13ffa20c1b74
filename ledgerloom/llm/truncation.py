"""Texts cut off by field limits: hashed logistic regression on how a text closes, trained on artificial cuts."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct texts the classifier is fitted on, chosen by hash so that no more are expected; all other figures come from all rows.
SAMPLE = 20_000
#: Texts and share of all texts that a usual length has at least, and how far it must stand out from the lengths beside it.
LIMIT_TEXTS, LIMIT_SHARE, STANDS_OUT = 5, 1e-4, 2.5
#: Size of the hashed feature space, rounds of training, penalty, step.
SPACE, ROUNDS, PENALTY, RATE = 1 << 12, 400, 1e-5, 0.3
#: Score from which a text counts as cut.
CUT = 0.5
#: Marks that a cut may leave.
MARKS = "…\x1a�"

_BLANK = " \t\r\n\f\v ​﻿"
_AFTER = re.compile(r"(?:\s*(?:\[\d+(?:[,–-] ?\d+)*\]|\[(?:…|\.\.\.)\]|\(\d+(?:\.\d+)+\)|[”’\"'»*_]))+$")
_FORMS = (
    ("row", re.compile(r"\|?\s*[^|\s][^|]*\|[^|]*\S[^|]*(?:\|[^|]*)*\|?")),
    ("setting", re.compile(r"[A-Za-z_][\w.-]*\s*[=:]\s*\S+")),
    ("path", re.compile(r"[\w.@~-]*/[\w./@-]*[\w-]\.\w{1,6}")),
    ("command", re.compile(r"`[^`]+`|\$ \S.*")),
)
_WORD = re.compile(r"[^\W\d_]+")
_INSIDE = re.compile(r"\d\.(?=\d)")


def form_of(text: str) -> str:
    """Which kind of text: row, setting, path, command, heading or prose."""
    for name, pattern in _FORMS:
        if pattern.fullmatch(text):
            return name
    words = [w for w in _WORD.findall(text) if len(w) > 3]
    if len(words) > 1 and len(text) < 160 and all(w[0].isupper() for w in words) and not _WORD.findall(text)[-1][0].islower() and text[-1] not in ".!?":
        return "heading"
    return "prose"


def _shape(token: str) -> str:
    """Letters as a or A, digits as 9, runs shortened."""
    s = re.sub(r"[A-Z]", "A", re.sub(r"[^\W\d_A-Z]", "a", re.sub(r"\d", "9", token[-24:])))
    return re.sub(r"(.)\1+", r"\1\1", s)


def balance(text: str) -> list[str]:
    """Which marks are opened and not closed."""
    out = [a for a, b in (("(", ")"), ("[", "]"), ("“", "”"), ("«", "»"), ("{", "}")) if text.count(a) > text.count(b)]
    return out + [m for m in ("`", "**", '"') if text.count(m) % 2]


def features(text: str, limits: frozenset[int]) -> list[int]:
    """Hashed features of a text's closing characters, punctuation and length against the usual limits."""
    whole = text.strip(_BLANK)
    bare = whole.rstrip(MARKS + _BLANK)
    dots = len(bare) - len(bare.rstrip("."))
    mark = "m" if len(bare) < len(whole) else "d" if dots >= 3 else ""
    if dots >= 3:
        bare = bare[: -3 if dots == 4 else None].rstrip("." if dots != 4 else "").rstrip(_BLANK)
    form = form_of(bare) if bare else "prose"
    tail = bare[-100:]
    core = _AFTER.sub("", tail)
    after = "after" if len(core) < len(tail) else ""
    last = core.rsplit(None, 1)[-1] if core.strip() else ""
    end = core[-1:]
    kind = "stop" if end and end in ".!?" else "letter" if end.isalpha() else "digit" if end.isdigit() else end
    shape = _shape(last)
    open_ = balance(bare)
    entity = "&" in bare[-8:] and ";" not in bare[-8:]
    limit = next((str(k) for k in range(3) if len(text) + k in limits), "")
    f = [f"k{form}", f"e{form}{kind}", f"s{form}{shape[-6:]}", f"S{kind}{shape[-4:]}", f"m{mark}{kind}", f"a{after}{kind}", f"l{limit}{kind}{form}", f"M{mark}", f"x{entity}", f"n{min(len(open_), 2)}", f"d{dots if dots < 3 else 3}{shape[-5:]}"]
    f += [f"o{m}{form}" for m in open_]
    return [zlib.crc32(x.encode()) % SPACE for x in f]


def intact(text: str) -> bool:
    """Whether a text is surely complete: a closed sentence or another whole form, nothing left open. Used to choose training rows."""
    t = text.strip(_BLANK)
    if not t or t[-1] in MARKS or t.endswith("..") or balance(t):
        return False
    form = form_of(t)
    if form != "prose":
        return True
    core = _AFTER.sub("", t)
    if not core:
        return False
    if core[-1] in ".!?":
        return bool(re.search(r"(?:[^\W\d_]{2,}|\d+\.\d+\.\d+|[A-Z]-\d{3,}|\w/\w|\))[.!?]+$", core))
    return len(core) < len(t) and bool(re.search(r"\[\d+\]$|\(\d+(?:\.\d+)+\)$", t)) and bool(re.search(r"(?:[^\W\d_]{2,}|\w/\w|[A-Z]{2,}-\d{4,}|\d+\.\d+\.\d+)$", core)) and len(core) > 20


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    limits: frozenset[int]

    def scores(self, texts: list[str]) -> np.ndarray:
        w = self.weights
        return 1 / (1 + np.exp(-np.array([self.bias + w[features(t, self.limits)].sum() for t in texts], dtype=float)))


def cuts(texts: list[str], limits: frozenset[int], seed: int = 7) -> list[str]:
    """Each intact text cut once: at a random character, at a word's end, inside a number, at a usual limit, with or without a mark."""
    r, out = random.Random(seed), []
    usual = sorted(limits)
    for t in texts:
        s = t.strip(_BLANK)
        if form_of(s) != "prose" or len(s) < 12:
            continue
        at = r.randrange(6, len(s) - 1)
        way = r.random()
        fitting = [x for x in usual if 6 < x < len(s) - 1]
        if way < 0.3 and fitting:
            at = r.choice(fitting)
        elif way < 0.5:
            at = max(6, s.rfind(" ", 0, at + 1))
        elif way < 0.6 and (inside := [m.end() for m in _INSIDE.finditer(s) if 6 < m.end() < len(s) - 1]):
            at = r.choice(inside)
        piece = s[:at]
        if r.random() < 0.06:
            piece += r.choice(("&am", "&nbs", "&#82", "(as in", "([see", "“the", "[[Sources/src-1"))
        if intact(piece):
            continue
        out.append(piece + r.choice(("", "", "", "…", "...", "\x1a", "�")))
    return out


def usual_limits(values: DataFrame, text: str) -> tuple[frozenset[int], int]:
    """Lengths that far more texts have than the lengths beside them, and how many texts there are.

    All texts and all lengths count. A usual length has a share of the texts, so there are at most
    1 / ``LIMIT_SHARE`` of them, whatever the lengths and the size of the table.
    """
    lengths = values.where(F.col(text).isNotNull()).groupBy(F.length(text).alias("n")).agg(F.count(F.lit(1)).alias("c"))
    beside = F.array(*(F.struct((F.col("n") + k).alias("n"), F.lit(k).alias("k"), "c") for k in range(-3, 4)))
    around = lengths.select(F.explode(beside).alias("x")).select("x.*").groupBy("n").agg(F.max(F.when(F.col("k") == 0, F.col("c"))).alias("c"), *(F.coalesce(F.max(F.when(F.col("k") == k, F.col("c"))), F.lit(0)).alias(f"k{i}") for i, k in enumerate((-3, -2, -1, 1, 2, 3))))
    order = F.array_sort(F.array(*(f"k{i}" for i in range(6))))
    middle = (F.element_at(order, 3) + F.element_at(order, 4)) / 2
    total = lengths.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    found = around.where((F.col("c") >= max(LIMIT_TEXTS, LIMIT_SHARE * total)) & (F.col("c") > STANDS_OUT * middle + 3)).select("n").collect()
    return frozenset(r.n for r in found), total


def fit(texts: list[str], limits: frozenset[int], seed: int = 7) -> Model:
    """Logistic regression (gradient descent with Adagrad steps) on intact texts and their cuts; the same for the same texts.

    Texts that close alike have equal features and are one weighted row; both classes weigh the same.
    """
    good = [t for t in texts if intact(t)]
    bad = cuts(good, limits, seed)
    if not bad:
        return Model(np.zeros(SPACE), -30.0, limits)
    rows = Counter((tuple(features(t, limits)), y) for y, side in ((0.0, good), (1.0, bad)) for t in side)
    width = max(len(f) for f, _ in rows)
    at = np.array([[*f, *[SPACE] * (width - len(f))] for f, _ in rows])
    y = np.array([v for _, v in rows])
    n = np.array(list(rows.values()), dtype=float)
    n *= np.where(y == 1, len(good) / len(bad), 1.0)
    w, b, g, gb = np.zeros(SPACE + 1), 0.0, np.full(SPACE + 1, 1e-8), 1e-8
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(b + w[at].sum(axis=1), -30, 30)))
        d = (p - y) * n
        step = np.bincount(at.ravel(), np.repeat(d, width), SPACE + 1) + PENALTY * len(good) * w
        step[SPACE] = 0
        g += step * step
        w -= RATE * step / np.sqrt(g)
        gb += d.sum() ** 2
        b -= RATE * d.sum() / np.sqrt(gb)
    return Model(w[:SPACE], float(b), limits)


def train(values: DataFrame, text: str, sample: int = SAMPLE) -> Model:
    """The model for a column: limits from the lengths of all its texts, weights from about ``sample`` distinct ones or fewer, chosen by hash."""
    limits, total = usual_limits(values, text)
    hashed = values.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).withColumn("h", F.xxhash64("t")).where(F.pmod("h", F.lit(max(1, -(-total // sample)))) == 0)
    chosen = hashed.groupBy("h").agg(F.min("t").alias("t")).collect()
    return fit([r.t for r in sorted(chosen, key=lambda r: r.h)], limits)


def scored(values: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """``(key, score)`` of every row with a text that is not blank: how likely it was cut."""
    kind = values.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(k, t) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t and t.strip(_BLANK)]
            if pairs:
                k, t = map(list, zip(*pairs))
                yield pa.RecordBatch.from_arrays([pa.array(k, batch.schema.field(0).type), pa.array(model.scores(t))], [key, "score"])

    return values.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"{key} {kind}, score double")


def truncated(values: DataFrame, key: str = "claim_id", text: str = "quote", sample: int = SAMPLE) -> DataFrame:
    """``(claim_id, score)`` of the rows whose text stops before it is finished.

    Null and blank texts are no case; a key whose rows differ counts if one of them is cut; repeated rows
    count once; without any intact text to learn from nothing counts as cut (no rows).
    """
    return scored(values, train(values, text, sample), key, text).groupBy(key).agg(F.max("score").alias("score")).where(F.col("score") > CUT)


def truncation_rates(values: DataFrame, cut: DataFrame, key: str = "claim_id", text: str = "quote", by: tuple[str, ...] = ("extraction_method", "quote_source_id")) -> DataFrame:
    """``(…by, n_quotes, n_cut, rate)``: how often each source cuts, over records with a text; unknown sources as ``unknown``."""
    rows = values.where(F.col(key).isNotNull() & (F.btrim(F.col(text), F.lit(_BLANK)) != "")).select(key, *(F.coalesce(c, F.lit("unknown")).alias(c) for c in by)).distinct()
    flagged = rows.join(cut.select(key, F.lit(1).alias("cut")), key, "left")
    return flagged.groupBy(*by).agg(F.count(F.lit(1)).alias("n_quotes"), F.sum(F.coalesce("cut", F.lit(0))).alias("n_cut")).withColumn("rate", F.round(F.col("n_cut") / F.col("n_quotes"), 4))
