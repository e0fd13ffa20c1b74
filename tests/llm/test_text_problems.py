"""Tokenizer, leakage, truncation and reading level."""

import os
import random

import numpy as np
import pytest
from ledgerloom.llm import leakage, reading, tokenize, truncation

DATA = "/root/testdata/sf0.01"
P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "\n\n  x", "<|endoftext|> it's", "naïve café", "日本語のテキスト", "🙂🙂 ​zero­soft", "a\r\nb\tc", "x" * 5000, "don't WE'LL 12345 ١٢٣", "\x00\x01\x1f", "  trailing   "]


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_pattern_is_the_vocabularys():
    assert sorted(tokenize.PATTERN.replace("'(?:[sdmt]|ll|ve|re)", "'s|'t|'re|'ve|'m|'ll|'d").split("|")) == sorted(P.PATTERN.split("|"))


def test_ids_equal_the_public_tokenizers():
    e = tokenize.encoder(PATH)
    r = random.Random(0)
    texts = ODD + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x2FFF), r.randrange(0x1F300, 0x1F6FF)])) for _ in range(60)) for _ in range(200)]
    assert [e(t) for t in texts] == reference(texts)
    assert [e.decode(e(t)) for t in texts] == texts


def test_encode_and_decode_tables(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*ODD, None])] + [(0, "", "again")], "doc_id bigint, text string, ids string")
    got = tokenize.encode_corpus(df, PATH)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    ids = {r.doc_id: list(r.ids) for r in got.collect()}
    assert [ids[i] for i in range(len(ODD) + 1)] == [*reference(ODD), []]
    back = {r.doc_id: r.text for r in tokenize.decode_corpus(got, PATH).collect()}
    assert [back[i] for i in range(len(ODD) + 1)] == [*ODD, ""]
    assert tokenize.encode_corpus(df.limit(0), PATH).count() == 0


def sentence(r, n=24):
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()) + str(r.randrange(60)) for _ in range(n))


def test_alignment_by_hand():
    item = "a b c d e f".split()
    assert leakage.align(item, "x a b q c d y".split()) == [True, True, False, True, True]
    assert leakage.align("whole words here".split(), "who le words here".split()) == [True] * 3
    assert leakage.stretch([True] * 20 + [True, False, False] * 5) == (23, 4)


def test_leaks_in_every_disguise(spark):
    r = random.Random(2)
    items = [(i, sentence(r)) for i in range(6)]
    t = dict(items)
    words = t[1].split()
    docs = [
        (1, "before " + t[0].upper().replace(" ", ",  ") + " after"), (2, "> " + "\n> ".join(t[1].split())), (3, "x " + " ".join(words[:13]) + " y"),
        (4, "x " + " ".join(words[:6]) + " y"), (5, " ".join(w if i % 9 else "other" for i, w in enumerate(t[2].split()))), (6, "**" + t[3].replace(" ", "** <b>", 1).replace(" ", "</b> ", 2) + "</p>"),
        (7, t[4][:30] + "-\n" + t[4][30:]), (8, None), (9, ""), (10, "🙂 " * 10), (11, " ".join(random.Random(5).sample(t[5].split(), 24))), (12, t[0] + " " + sentence(r, 3000) + " " + t[1]),
        (13, " ".join(x + " " + sentence(r, 1) for x in t[2].split())), (1, "again " + t[0]),
    ]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id bigint, text string, item_id string")
    it = spark.createDataFrame([(i, x, "s") for i, x in items] + [(90, None, "s"), (91, "", "s"), (None, "a b", "s")], "item_id bigint, text string, split string")
    found = leakage.leaked_items(df, it)
    got = {(x.doc_id, x.item_id) for x in found.collect()}
    assert got == {(1, 0), (2, 1), (3, 1), (5, 2), (6, 3), (7, 4), (12, 0), (12, 1)}
    report = {x.item_id: x.n_documents for x in leakage.leak_report(found.select("doc_id", "item_id").distinct(), it.where("item_id < 90")).collect()}
    assert report == {0: 2, 1: 3, 2: 1, 3: 1, 4: 1, 5: 0}


def test_items_in_blocks_and_copies_of_items(spark):
    r = random.Random(4)
    items = [(i, sentence(r)) for i in range(9)]
    items += [(10 + i, items[0][1]) for i in range(5)]
    docs = spark.createDataFrame([(i, "see " + t) for i, t in items], "doc_id bigint, text string")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    one = {tuple(x) for x in leakage.leaked_items(docs, it).select("doc_id", "item_id").collect()}
    many = {tuple(x) for x in leakage.leaked_items(docs, it, block_words=400).select("doc_id", "item_id").collect()}
    same = {0, *range(10, 15)}
    assert one == many == {(i, i) for i in range(1, 9)} | {(a, b) for a in same for b in same}
    assert leakage.leaked_items(docs.limit(0), it).count() == 0 and leakage.leaked_items(docs, it.limit(0)).count() == 0


def test_items_that_share_a_passage_and_split_words(spark):
    r = random.Random(6)
    shared = sentence(r, 30)
    items = [(i, f"{sentence(r, 6)} {shared} {sentence(r, 6)}") for i in range(6)] + [(9, sentence(r, 24))]
    split = " ".join(x[:2] + " " + x[2:] if k % 3 == 1 else x for k, x in enumerate(items[-1][1].split()))
    three = " ".join(" ".join((x[:2], x[2:4], x[4:])) if k % 3 == 1 and len(x) > 4 else x for k, x in enumerate(items[-1][1].split()))
    docs = spark.createDataFrame([(1, f"{sentence(r, 9)} {shared} {sentence(r, 9)}"), (2, "see " + split), (3, sentence(r, 60)), (4, three)], "doc_id bigint, text string")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    got = {tuple(x) for x in leakage.leaked_items(docs, it).select("doc_id", "item_id").collect()}
    assert got == {(1, i) for i in range(6)} | {(2, 9), (4, 9)}


WHOLE = [
    "The queue was full, so the team moved it in 4.2.19.", "Most readers keep the log [12]", "The fix was small. […]", "“The node is old.”", "Table 4: Verified Lock by Linear Runtime", "| pager | 440 MB | 4.6.6 |", "pager | 6660 rows/s | 237",
    "cache.limit = 30s", "src/main/lock_table.rs", "`tool --flag 1.2.3`", "Is the lock still held?", "The lock (see 1.2.3) was held (1.21.9)", "Section 4.8 Tentative Tracker", "The readers changed the older queue before they accepted NIS-4604869 [24]", "It took about 12 rows/s [sic].",
]
CUT = ["The queue was full, so the te", "The queue was full, so the", "“The node is", "The older cache was exposed whe…", "The lock was held &am", "It was changed before Nisen 2.", "It took about 105.", "The lock was held (as in", "The older scheduler was […] the t\x1a", "The fix was sm�"]


def corpus(n=1500):
    r = random.Random(8)
    names, nouns = ["Nisen", "Karim", "Zorim", "Latan"], "queue lock node cache table fence shard timer proxy relay".split()
    make = (
        lambda: f"The {r.choice(nouns)} was full, so the team moved the {r.choice(nouns)} in {r.randrange(9)}.{r.randrange(20)}.{r.randrange(40)}.",
        lambda: f"{r.choice(names)} {r.randrange(9)}.{r.randrange(20)}.{r.randrange(40)} changed the older {r.choice(nouns)} and the {r.choice(nouns)} it depends on.",
        lambda: f"According to {r.choice(names).upper()[:3]}-{r.randrange(10**6)}, the {r.choice(nouns)} took {r.randrange(900)}.{r.randrange(9)} rows/s after the {r.choice(nouns)} was reached [{r.randrange(40)}]",
        lambda: f"{r.choice(names)} changed the {r.choice(nouns)} before they accepted {r.choice(names).upper()[:3]}-{r.randrange(10**5, 10**7)} [{r.randrange(40)}]",
        lambda: f"“Several readers tested the {r.choice(nouns)}, but the {r.choice(nouns)} stayed old.”",
        lambda: f"Table {r.randrange(30)}: {r.choice(nouns).title()} by {r.choice(nouns).title()}",
        lambda: f"| {r.choice(nouns)} | {r.randrange(900)} MB | {r.randrange(9)}.{r.randrange(20)}.1 |",
        lambda: f"{r.choice(nouns)}.{r.choice(nouns)} = {r.choice(['true', '30s', '0.75'])}",
        lambda: f"docs/{r.choice(nouns)}/{r.choice(nouns)}.md",
        lambda: f"`{r.choice(nouns)} --{r.choice(nouns)} 1.{r.randrange(9)}.2`",
    )
    return [r.choice(make)() for _ in range(n)]


def test_held_out_cuts():
    texts = corpus()
    model = truncation.fit(texts[:1000], frozenset())
    rest = [t for t in texts[1000:] if truncation.intact(t)]
    cut = truncation.cuts(rest, frozenset(), seed=99)
    assert (model.scores(cut) > truncation.CUT).mean() > 0.97
    assert (model.scores(rest) > truncation.CUT).mean() < 0.01


def test_truncated_table(spark):
    rows = [(f"t{i}", t) for i, t in enumerate(corpus())] + [(f"whole{i}", t) for i, t in enumerate(WHOLE)] + [(f"cut{i}", t) for i, t in enumerate(CUT)] + [("null", None), ("blank", "  \n"), ("cut0", CUT[0]), (None, CUT[0]), ("long", "The queue was full. " * 20000 + "And the te")]
    df = spark.createDataFrame([(*x, "m", "s", 1.0) for x in rows], "claim_id string, quote string, extraction_method string, quote_source_id string, score double")
    got = truncation.truncated(df)
    found = {r.claim_id for r in got.collect()}
    assert found == {f"cut{i}" for i in range(len(CUT))} | {"long"}
    rates = truncation.truncation_rates(df, got).collect()
    assert [(r.n_quotes, r.n_cut) for r in rates] == [(1500 + len(WHOLE) + len(CUT) + 1, len(CUT) + 1)]
    assert truncation.truncated(df.limit(0)).count() == 0


def test_usual_limits(spark):
    long = 100_000
    rows = [("x" * i,) for i in range(50, 300) for _ in range(10)] + [("y" * 160,)] * 190 + [("z" * long,)] * 9 + [(None,)]
    assert truncation.usual_limits(spark.createDataFrame(rows, "quote string"), "quote") == (frozenset({160, long}), 2500 + 190 + 9)
    assert truncation.usual_limits(spark.createDataFrame([], "quote string"), "quote") == (frozenset(), 0)


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data here")
def test_held_out_cuts_of_the_given_quotes(spark):
    quotes = sorted({r.quote for r in spark.read.parquet(f"{DATA}/claims.parquet").where("quote IS NOT NULL").select("quote").collect()})
    model = truncation.fit(quotes[::2], frozenset())
    rest = [t for t in quotes[1::2] if truncation.intact(t)]
    cut = truncation.cuts(rest, frozenset(), seed=99)
    assert len(rest) > 500 and (model.scores(cut) > truncation.CUT).mean() > 0.97
    assert (model.scores(rest) > truncation.CUT).mean() < 0.01


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data here")
def test_levels_of_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/level_labels.parquet")
    got = {r.doc_id: r for r in reading.reading_levels(docs, labels.where("doc_id % 2 = 0")).collect()}
    held = {r.doc_id: r.level for r in reading.graded(labels.where("doc_id % 2 = 1")).collect() if got[r.doc_id].level}
    level, score = [got[i].level for i in held], [got[i].score for i in held]
    assert len(held) > 30 and np.corrcoef(score, list(held.values()))[0, 1] > 0.85
    assert np.mean([abs(a - b) <= 1 for a, b in zip(level, held.values())]) > 0.9


def test_reading_levels(spark):
    r = random.Random(6)
    easy, hard = "the dog ran and we saw it".split(), [f"{a}{b}isation" for a in ("contextual", "operational", "counterfact", "heterogen") for b in ("al", "ic", "ous")]
    text = lambda lv: " ".join(" ".join(r.choice(hard if r.random() < lv / 6 else easy) for _ in range(4 * lv)) + "." for _ in range(12))
    docs = [(i, text(1 + i % 5), "en") for i in range(200)] + [(900, None, "en"), (901, " \n ", "en"), (902, "123 !!!", None), (903, "日本語 の 文章。", "ja")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, level string")
    labels = spark.createDataFrame([(i, g, 1 + i % 5) for i in range(0, 100) for g in ("a", "b")] + [(0, "c", None), (None, "a", 3), (5, "a", 1)], "doc_id bigint, grader string, level int")
    got = {x.doc_id: x for x in reading.reading_levels(df, labels).collect()}
    assert len(got) == len(docs)
    assert all(got[i].level is None and got[i].n_words == 0 for i in (900, 901, 902)) and got[903].level is not None
    assert sum(abs(got[i].level - (1 + i % 5)) <= 1 for i in range(100, 200)) >= 98
    assert all(x.level is None for x in reading.reading_levels(df, labels.limit(0)).collect())
    assert reading.reading_levels(df.limit(0), labels).count() == 0


def test_coverage_rank(spark):
    df = spark.createDataFrame([(1, "a a a a a a b b b c"), (2, "zz")], "doc_id bigint, text string")
    words = reading.vocabulary(df)
    assert {r.n: r["rank"] for r in reading.ranks(words).collect()} == {6: 1, 3: 2, 1: 4}
    assert {r.doc_id: r.coverage_rank for r in reading.features(df, words).collect()} == {1: 2, 2: 4}


def test_coverage_rank_beyond_the_ranked_words(spark):
    r = random.Random(8)
    docs = [(i, " ".join(f"{'abcdefgh'[int(r.random() ** 3 * 8)]}{'xyz' * r.randrange(1, 2 + i % 9)}" for _ in range(r.randrange(1, 30)))) for i in range(60)] + [(70, None), (71, ""), (3, "only once seen words here"), (3, "only once seen words here")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    words = reading.vocabulary(df)
    whole = sorted(tuple(x) for x in reading.features(df, words).collect() if x.n_words)
    assert max(x[1] for x in whole) > 20
    for ranked in (20, 4, 0):
        cut = sorted(tuple(x) for x in reading.features(df, words, ranked=ranked).collect() if x.n_words)
        assert [x[:3] for x in cut] == [x[:3] for x in whole]
        assert all(abs(a[3] - b[3]) < 1e-12 and a[4:] == b[4:] for a, b in zip(cut, whole))
    assert reading.features(df, words).count() == len(docs)
