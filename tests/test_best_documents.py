"""The best documents per query: equal to the full ranking whatever the blocks, and without a row for every query and document."""

from __future__ import annotations

import random

import numpy as np
import pytest
from ledgerloom.functions import scoring
from ledgerloom.operators import retrieval

COMMON = ["the", "of", "in", "is"]


def corpus(spark, n_docs, n_queries):
    """Questions of words that nearly all documents hold, many documents alike, one in two rows, one without id."""
    r = random.Random(7)
    texts = [" ".join(r.choices(COMMON * 4 + [f"w{i}" for i in range(12)], k=r.randrange(3, 30))) for _ in range(n_docs // 2)]
    docs = [(i, texts[i % len(texts)]) for i in range(n_docs)] + [(3, texts[3]), (None, "the w1 of"), (9000, None), (9001, " -- ")]
    asked = [(f"q{i}", " ".join(r.choices([*COMMON, "w1", "w2"], k=r.randrange(1, 9)))) for i in range(n_queries)]
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(asked + [("none", "zzz"), (None, "the")], "query_id string, text string")


def ranks(df, *columns):
    return sorted((tuple(x) for x in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize(("block", "asked", "last"), [(2_000_000, 1_000_000, 0.1), (150, 40, 0.5), (1, 1_000_000, 0.0), (400, 60, 1.0)])
def test_both_rankings_equal_the_full_ones(spark, monkeypatch, block, asked, last):
    monkeypatch.setattr(retrieval, "BLOCK", block)
    monkeypatch.setattr(retrieval, "ASKED", asked)
    docs, queries = corpus(spark, 90, 20)
    keep = docs.where("doc_id % 4 > 0").select("doc_id")
    full = retrieval.bm25(docs, queries)
    kept = retrieval.ranked(full.join(keep.distinct(), "doc_id", "left_semi").select("query_id", "doc_id", "score"), 6)
    monkeypatch.setattr(scoring, "LAST", last)
    got = retrieval.bm25_best_both(docs, queries, 6, keep)
    assert ranks(got.where("rank IS NOT NULL"), "query_id", "doc_id", "score", "rank") == ranks(retrieval.ranked(full, 6), "query_id", "doc_id", "score", "rank")
    assert ranks(got.where("kept_rank IS NOT NULL"), "query_id", "doc_id", "score", "kept_rank") == ranks(kept, "query_id", "doc_id", "score", "rank")
    assert ranks(retrieval.bm25_best(docs, queries, 6, keep), "query_id", "doc_id", "rank") == ranks(kept, "query_id", "doc_id", "rank")
    assert retrieval.bm25_best_both(docs.limit(0), queries, 6, keep).count() == retrieval.bm25_best_both(docs, queries.limit(0), 6, keep).count() == 0


def test_common_words_make_no_row_for_every_query_and_document(spark):
    docs, queries = corpus(spark, 1000, 400)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    assert retrieval.bm25_best(docs, queries, 8).count() == 3200
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert written() - before < 1_000_000


@pytest.mark.parametrize("kept", [0, 5, 300, 400])
def test_blocks_give_the_best(kept):
    r = np.random.default_rng(kept)
    share = np.where(np.arange(40) < 8, 0.8, 0.04)
    held = r.random((400, 40)) < share
    held[200:260] = held[200]
    weight = np.where(held, np.round(r.random(40) * 3 + 0.1, 2), 0)
    asked = [(r.choice(40, r.integers(1, 12), replace=False), r.integers(1, 3, 12)) for _ in range(50)]
    start = np.cumsum([0] + [len(t) for t, _ in asked])
    for k, size in ((8, 400), (8, 90), (500, 400)):
        q = scoring.Queries(start, np.concatenate([t for t, _ in asked]), np.concatenate([m[: len(t)] for t, m in asked]), k)
        found: dict[int, dict[int, float]] = {}
        for low in range(0, 400, size):
            row, term = np.nonzero(held[low : low + size])
            block = weight[low : low + size]
            for a, b, c in scoring.Block(len(block), min(max(kept - low, 0), len(block)), row, term, block[row, term], 40, k).best(q):
                for i, d, s in zip(a.tolist(), (b + low).tolist(), c.tolist()):
                    found.setdefault(i, {})[d] = s
        for i, (terms, times) in enumerate(asked):
            score = weight[:, terms] @ times[: len(terms)]
            for n in (400, kept):
                want = sorted(((-round(float(score[d]), 6), d) for d in range(n) if score[d] > 0))[:k]
                assert sorted((-round(s, 6), d) for d, s in found.get(i, {}).items() if d < n)[:k] == want
