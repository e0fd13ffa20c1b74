"""Near-duplicate groups, formatting duplicates and cross-split overlaps against brute force."""

import itertools
import random
import re
from collections import defaultdict

import pytest

from ledgerloom.llm import crosssplit, neardup, radix
from ledgerloom.llm.queries import VOCABULARY
from ledgerloom.operators.components import components
from pyspark.sql import functions as F


def pairs(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


# Near-duplicate groups


def brute_groups(rows, least=0.6):
    words = {}
    for i, c, t in rows:
        w = frozenset(re.findall(r"[^\W_]+", (t or "").lower()))
        k = re.sub(r"[\W_]+", " ", (c or "").lower()).strip()
        if i and k and w:
            words[i] = (k, w)
    up = {i: i for i in words}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(words, 2):
        (ka, x), (kb, y) = words[a], words[b]
        if ka == kb and len(x & y) / len(x | y) >= least:
            up[top(a)] = top(b)
    g = defaultdict(set)
    for i in words:
        g[top(i)].add(i)
    return {p for x in g.values() for p in itertools.combinations(sorted(x), 2)}, g


def claims(seed=1, n=160):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of", "and"] * 6
    rows = []
    for i in range(n):
        concept = r.choice(["A_b", "a-B", "A b", "other"])
        if rows and r.random() < 0.6:
            w = r.choice(rows)[2].split()
            for _ in range(r.randrange(5)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            r.shuffle(w)
        else:
            w = r.choices(vocabulary, k=r.randrange(1, 20))
        rows.append((f"c{i:03d}", concept, " ".join(w)))
    return rows + [("n1", "a b", None), ("n2", None, "x y"), ("n3", "a b", ""), ("n4", "--", "x y"), (None, "a b", "x"), rows[0], ("d1", "a b", rows[1][2].upper() + "!!"), ("u", "a b", "naïve Überlauf 日本"), ("v", "a b", "NAÏVE überlauf, 日本")]


def test_groups_equal_brute_force_whatever_the_cells(spark, monkeypatch):
    rows = claims()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "claim_id string, concept string, claim_text string, words string")
    want, groups = brute_groups(rows)
    for cell in (200, 3, 0):
        monkeypatch.setattr(neardup, "CELL", cell)
        c = neardup.fingerprints(df, "claim_id", "concept", "claim_text").groupBy("cls").agg(F.first("home").alias("home"), F.first("words").alias("words"))
        links = neardup.similar_pairs(neardup.checkpoint(c), cell=cell)
        assert links.count() == links.distinct().count()
        got = pairs(neardup.group_pairs(df))
        assert got == want
    table = {r.claim_id: r.group_id for r in neardup.groups(df).collect()}
    assert table == {i: min(g) for g in groups.values() for i in g}


def test_empty_and_alike(spark):
    schema = "claim_id string, concept string, claim_text string"
    assert neardup.group_pairs(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(f"c{i:02d}", "k", "same words here") for i in range(30)] + [("z", "k", "long " * 50000)], schema)
    assert neardup.group_pairs(df).count() == 30 * 29 // 2


def test_manhattan_is_a_lower_bound():
    import numpy as np

    r = random.Random(3)
    sets = [np.array(sorted(r.sample(range(-(2**63), 2**63 - 1, 10**14 + 7), r.randrange(1, 60)))) for _ in range(40)]
    for a, b in itertools.combinations(sets, 2):
        c = np.unique(np.concatenate([a[: len(a) // 2], b]))
        low, high = neardup.embed(np.array([len(a), len(c)]), np.concatenate([a, c]))
        count = lambda v: [(int(v) >> s) & 15 for s in range(0, 64, 4)]
        d = sum(abs(x - y) for v in (low, high) for x, y in zip(count(v[0]), count(v[1])))
        assert d <= len(set(a.tolist()) ^ set(c.tolist()))


def test_short_texts_of_frequent_words_and_very_long_texts(spark, monkeypatch):
    rows = [("a", "k", "x y"), ("b", "k", "x y z"), ("c", "k", "x"), ("d", "k", "y"), ("e", "k", "z w"), ("f", "k", "x z w")] + [(f"m{i}", "k", f"x y z w v{i} u{i} t{i} s{i} r{i} q{i}") for i in range(8)]
    want, _ = brute_groups(rows)
    assert ("a", "b") in want and ("e", "f") in want
    schema = "claim_id string, concept string, claim_text string"
    for cell in (200, 1, 0):
        c = neardup.fingerprints(spark.createDataFrame(rows, schema), "claim_id", "concept", "claim_text").groupBy("cls").agg(F.first("home").alias("home"), F.first("words").alias("words"))
        assert neardup.similar_pairs(neardup.checkpoint(c), cell=cell).count() == 2
    long = " ".join(f"w{i}" for i in range(33_000))
    assert pairs(neardup.group_pairs(spark.createDataFrame([("l", "k", long), ("m", "k", long + " more")], schema))) == {("l", "m")}


def test_cells_stay_small_though_words_go_together(spark):
    r = random.Random(5)
    phrase = "since the last release of this note all rows were kept as they are".split()
    rows = [(f"c{i:04d}", "k", " ".join(r.sample(phrase, 11) + r.sample([f"w{j}" for j in range(40)], 6))) for i in range(900)]
    c = neardup.checkpoint(neardup.fingerprints(spark.createDataFrame(rows, "claim_id string, concept string, claim_text string"), "claim_id", "concept", "claim_text").groupBy("cls").agg(F.first("home").alias("home"), F.first("words").alias("words")))
    assert max(x["count"] for x in neardup.grid(c, (9, 10), 60).groupBy("key").count().collect()) <= 60
    sets = {bytes(x.cls): set(x.words) for x in c.collect()}
    want = {frozenset(p) for p in itertools.combinations(sets, 2) if 10 * len(sets[p[0]] & sets[p[1]]) >= 9 * len(sets[p[0]] | sets[p[1]])}
    assert {frozenset((bytes(x.a), bytes(x.b))) for x in neardup.similar_pairs(c, (9, 10), 60).collect()} == want


def test_frequencies_are_never_told_too_low(spark):
    import numpy as np

    rows = [(i * 7919 - 5 * 10**17 * (i % 3), 1 + i % 700) for i in range(3000)]
    table = neardup.frequency_sketch(spark.createDataFrame(rows, "v bigint, n bigint"))
    told = neardup.frequency(table, np.array([v for v, _ in rows]))
    assert all(t >= n for t, (_, n) in zip(told, rows) if n > 1) and sum(t <= 1.2 * n for t, (_, n) in zip(told, rows)) > 2900


# Formatting duplicates

REG = "id string, source string, title string, canon string"


def test_canonical_forms(spark):
    same = [
        ("a", "https://x.example/P_q-1?lang=en&rev=2", "One | Two  words"), ("b", " HTTPS://X.EXAMPLE/pq1/?rev=2&lang=EN#", "«two words|ONE»"), ("c", "https://x.example/pq1?&rev=2&lang=en;", "TWO WORDS | one |"),
        ("d", "https://x.example/pq1?lang=en&rev=2", None), ("e", "https://x.example/pq1?lang=en&rev=2", None), ("f", None, "One | Two words"), ("g", None, "One | Two words"), ("h", "https://x.example/pq1?lang=e&nrev=2", "One | Two words"),
        ("i", "", ""), ("j", "--", "!!"), (None, "https://x.example/pq1?lang=en&rev=2", None), ("a", "https://x.example/pq1?lang=en&rev=2", "one|two words"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in same], REG)
    assert pairs(radix.copies(df)) == {("a", "b"), ("a", "c"), ("d", "e"), ("i", "j")}
    assert sorted(map(tuple, radix.collapse(df).collect())) == [("a", 3, 4), ("d", 2, 2), ("h", 1, 1), ("i", 2, 2)]
    assert radix.copies(df.limit(0)).count() == 0


def test_buckets_split_until_they_fit_and_results_stay(spark):
    r = random.Random(7)
    rows = [(f"s{i:04d}", "https://common.example/" + ("hot" if i % 3 == 0 else "".join(r.choices("ab", k=6))) + ("x" * 3000 if i % 50 == 0 else ""), "t") for i in range(600)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], REG)
    want = defaultdict(list)
    for i, s, _ in rows:
        want[s].append(i)
    expected = {(min(v), i) for v in want.values() for i in v if i != min(v)}
    assert pairs(radix.copies(df, bucket_rows=20)) == pairs(radix.copies(df)) == expected
    b = radix.radix_buckets(radix._rows(df, "id", "source", "title"), 20).groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("canon").alias("k")).collect()
    assert max(x.n for x in b if x.k > 1) <= 20 and max(x.n for x in b) < 45


def test_trie():
    r = random.Random(9)
    t, want = radix.Trie(), defaultdict(list)
    for i in range(2000):
        k = bytes(r.choices(b"ab\x00", k=r.randrange(7)))
        t.add(k, str(i), 2)
        want[k].append(str(i))
    assert sorted(t.terminals()) == sorted((k, len(v), 2 * len(v), min(v)) for k, v in want.items())


# Cross-split overlaps

TRAIN, EVAL = "id string, question string, source_id string, words string", "id string, question string, split string"


def test_overlaps(spark):
    base = "Under Kalath 7.14.13, how many cursor runs did biranan need before KAL-6625042 joined the corrected rebalance?"
    probes = [
        ("same", base), ("shout", base.upper().replace(" ", "\t")), ("order", "How many cursor runs did biranan need before KAL 6625042 joined the corrected rebalance under Kalath 7.14.13"),
        ("typo", base.replace("corrected", "corrcted").replace("before", "until") + " Thanks."), ("number", base.replace("6625042", "6625043")), ("version", base.replace("7.14.13", "7.14.1")),
        ("name", base.replace("biranan", "zoferat").replace("cursor", "cursr")), ("other", "What is KAL-6625042 in 7.14.13?"), ("null", None), ("empty", ""), ("blank", "?!"), ("same", base), (None, base),
    ]
    fill = [(f"f{i}", f"Why does part{i} keep a lock before {i}.{i}.{i} joined the corrected rebalance of the cursor runs") for i in range(12)]
    t = spark.createDataFrame([(*p, "s", "clash") for p in probes + fill], TRAIN)
    e = spark.createDataFrame([("q1", base, "golden"), ("q1", base, "golden"), ("q2", None, "golden"), ("q3", "", "golden")], EVAL)
    got = pairs(crosssplit.overlaps(t, e, vocabulary=VOCABULARY))
    assert got == {(p, "q1") for p in ("same", "shout", "order", "typo")}
    counts = crosssplit.overlap_counts(crosssplit.overlaps(t, e, vocabulary=VOCABULARY), t, e).collect()
    assert [(r.split, r.source_id, r.n_pairs, r.n_questions) for r in counts] == [("golden", "s", 4, 1)]
    assert crosssplit.overlaps(t.limit(0), e).count() == 0 and crosssplit.overlaps(t, e.limit(0)).count() == 0


def test_a_pair_has_the_same_answer_whatever_surrounds_it(spark):
    free = "Where does the operator keep the old journal while biranan drains its queue under load?"
    dated = "What evidence shows that sinozelt drained more mixed cursor than KAL-8463234 claimed?"
    probes = [("word", free.replace("old", "worn")), ("added", free.replace("the old journal", "old journal") + " (short answer)"), ("name", free.replace("biranan", "zoferat")), ("misspelt", free.replace("biranan", "birannan")), ("short", dated.replace("more mixed ", "") + " (short answer)"), ("cable", dated.replace("cursor", "cable")), ("other", dated.replace("sinozelt", "zoferat"))]
    fill = [(f"f{i}", f"Which {x}{y} owner of part{x}{y} saw the old and the worn gauge break down with cursor and cable?") for i, (x, y) in enumerate(itertools.product("abcdefgh", "abcde"))]
    e = spark.createDataFrame([("free", free, "golden"), ("dated", dated, "golden")], EVAL)
    for rows in (probes, probes + fill):
        t = spark.createDataFrame([(*p, "s", "clash") for p in rows], TRAIN)
        assert pairs(crosssplit.overlaps(t, e, vocabulary=VOCABULARY)) == {("word", "free"), ("added", "free"), ("misspelt", "free"), ("short", "dated"), ("cable", "dated")}
    for p in probes:
        one = spark.createDataFrame([(*p, "s", "clash")], TRAIN)
        assert len(pairs(crosssplit.overlaps(one, e, vocabulary=VOCABULARY))) == (p[0] not in ("name", "other"))


@pytest.mark.parametrize("edits", [0.6, 0.25])
def test_every_pair_within_the_distance_is_found(spark, edits):
    r = random.Random(11)
    vocabulary = [f"word{chr(97 + i)}" for i in range(26)] + ["7", "8"]
    base = [r.choices(vocabulary, k=r.randrange(1, 14)) for _ in range(12)]

    def edited(w):
        w = list(w)
        for _ in range(r.randrange(6)):
            k = r.randrange(3)
            if k == 0 and len(w) > 1:
                w.pop(r.randrange(len(w)))
            else:
                w.insert(r.randrange(len(w) + 1), r.choice(vocabulary))
        return w

    e = [(f"q{i}", " ".join(w), "s") for i, w in enumerate(base)]
    t = [(f"p{i}", " ".join(edited(r.choice(base))), "s", "c") for i in range(80)]
    want = set()
    for (p, x, *_), (q, y, _) in itertools.product(t, e):
        a, b = sorted(re.findall(r"[a-z]+|\d", y)), sorted(re.findall(r"[a-z]+|\d", x))
        d = len(crosssplit._minus(a, b)) + len(crosssplit._minus(b, a))
        if [w for w in a if w.isdigit()] == [w for w in b if w.isdigit()] and d <= int(len(a) * edits):
            want.add((p, q))
            assert crosssplit.word_distance(a, b, int(len(a) * edits)) == d
    checked = crosssplit.overlaps(spark.createDataFrame(t, TRAIN), spark.createDataFrame(e, EVAL), edits=edits)
    got = pairs(checked)
    assert got <= want
    assert got == want


def test_components_of_binary_nodes(spark):
    df = spark.createDataFrame([(b"b", b"a"), (b"c", b"b"), (b"x", b"y")], "a binary, b binary")
    assert {bytes(r.node): bytes(r.label) for r in components(df, "a", "b").collect()} == {b"a": b"a", b"b": b"a", b"c": b"a", b"x": b"x", b"y": b"x"}
