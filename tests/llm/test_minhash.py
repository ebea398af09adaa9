import random
import re
import time

import numpy as np

from claimwright.llm import minhash

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def shingle_set(text, k=5):
    words = [w.lower() for w in WORD.findall((text or "").encode())]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute_classes(rows):
    """Least id of each class: equal texts, or plain Jaccard of 0.8 or more, closed over links."""
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, t or "", shingle_set(t)) for i, t in rows]
    for x, (i, t, a) in enumerate(sets):
        for j, u, b in sets[:x]:
            if t == u or a and b and len(a & b) >= 0.8 * len(a | b):
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    return {i: find(i) for i, _ in rows}


def classes(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.class_id for r in minhash.near_duplicate_classes(df).collect()}


def words(rng, n):
    return [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa lamda mu nu xi".split()) + str(rng.randrange(40)) for _ in range(n)]


def test_groups_of_near_copies_against_all_pairs(spark):
    rng = random.Random(3)
    rows, passage = [], words(rng, 40)
    for base in range(6):
        text = words(rng, 150)
        for copy in range(30 if base == 0 else 4):
            edited = list(text)
            for _ in range(copy % 4):
                edited[rng.randrange(len(edited))] = "changed" + str(rng.randrange(999))
            rows.append((len(rows) + 10, " ".join(edited)))
    rows += [(len(rows) + 10 + i, " ".join(passage + words(rng, 30))) for i in range(40)]
    assert classes(spark, rows) == brute_classes(rows)


def test_documents_table_against_all_pairs(spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    assert classes(spark, rows) == brute_classes(rows)


def test_nulls_empties_ties_repeats_and_order(spark):
    rows = [(5, None), (3, ""), (9, "one two"), (8, "One, two!"), (7, "..."), (6, "..."), (2, "unlike all others here today"), (2, "unlike all others here today")]
    found = classes(spark, rows)
    assert found == {5: 3, 3: 3, 9: 8, 8: 8, 7: 6, 6: 6, 2: 2}
    assert classes(spark, rows[::-1]) == found
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, "x")], "doc_id long, text string")
    assert {(r.doc_id, r.copies) for r in minhash.near_duplicate_classes(df).collect()} == {(None, 2), (4, 2), (None, 1)}


def test_empty_table_and_clashing_columns(spark):
    schema = "doc_id long, text string, digest string, class_id int, label string, node int, key int"
    assert minhash.near_duplicate_classes(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f g", "d", 1, "l", 2, 3), (2, "a b c d e f g", "d", 1, "l", 2, 3)]
    df = spark.createDataFrame(rows, schema)
    assert {r.class_id for r in minhash.near_duplicate_classes(df).collect()} == {1}
    kept = minhash.deduplicate(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [1]


def test_deduplicate_keeps_one_of_each_class(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    want = set(brute_classes([(r.doc_id, r.text) for r in docs.collect()]).values())
    kept = [r.doc_id for r in minhash.deduplicate(docs).collect()]
    assert len(kept) == len(set(kept)) and set(kept) == want


def test_signatures_estimate_probability_jaccard():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = np.arange(300, dtype=np.uint64), np.arange(100, 380, dtype=np.uint64)
    wa, wb = rng.integers(1, 6, 300).astype(float), rng.integers(1, 6, 280).astype(float)
    sign = lambda e, w: minhash.prob_minhash(np.zeros(len(e), np.int64), e, w, 1, 8192)[0]
    da, db = dict(zip(a.tolist(), wa, strict=True)), dict(zip(b.tolist(), wb, strict=True))
    exact = sum(1 / sum(max(da.get(k, 0) / da[d], db.get(k, 0) / db[d]) for k in da.keys() | db.keys()) for d in da.keys() & db.keys())
    assert abs(minhash.jaccards((a, wa), (b, wb))[1] - exact) < 1e-9
    assert abs((sign(a, wa) == sign(b, wb)).mean() - exact) < 0.02


def test_every_pair_of_a_crowded_bucket_is_compared(spark):
    rng = random.Random(5)
    passage, rows = words(rng, 40), []
    for k in range(260):
        own = words(rng, 7)
        rows.append((len(rows) + 1, " ".join(passage + own)))
        if k % 8 == 0:  # a near copy of this text among hundreds that share the passage only
            rows.append((len(rows) + 1, " ".join(passage + own[:-1] + ["other"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    assert sum(i != c for i, c in want.items()) == 33
    # two bands of one slot each put all texts in a few crowded buckets, dealt in one or many blocks
    for block in (1024, 16):
        assert {r.doc_id: r.class_id for r in minhash.near_duplicate_classes(df, bands=2, rows=1, block=block).collect()} == want


def test_a_large_group_of_near_copies_and_its_outliers_in_blocks(spark):
    rng = random.Random(6)
    base, rows = words(rng, 60), []
    for _ in range(150):  # a chain of copies, some too far from all others
        edited = list(base)
        for _ in range(rng.choice((1, 1, 2, 4))):
            edited[rng.randrange(60)] = "changed" + str(rng.randrange(999))
        rows.append((len(rows) + 1, " ".join(edited)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    assert 1 < len(set(want.values())) < 150
    assert {r.doc_id: r.class_id for r in minhash.near_duplicate_classes(df, bands=2, rows=1, block=16).collect()} == want


def test_groups_of_sets_against_all_pairs():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(40):
        n, sets, weights = int(rng.integers(2, 12)), [], []
        core = rng.choice(4000, 60, replace=False)
        for _ in range(n):
            sets.append(np.unique(np.concatenate([core[rng.random(60) < 0.93], rng.choice(4000, int(rng.integers(1, 8)))])).astype(np.uint32))
            weights.append(rng.choice([1.0, 1.0, 5.0, 30.0], len(sets[-1])) if rng.random() < 0.5 else None)
        ones = [np.ones(len(s)) if w is None else w for s, w in zip(sets, weights, strict=True)]
        label = list(range(n))
        for x in range(n):
            for y in range(x):
                if max(minhash.jaccards((sets[x], ones[x]), (sets[y], ones[y]))) >= 0.8:
                    low, high = sorted((label[x], label[y]))
                    label = [low if v == high else v for v in label]
        assert minhash.groups_of(sets, weights, 0.8).tolist() == label


def test_texts_that_differ_in_repeats_share_a_band(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(12):
        passage, own = words(rng, 25), words(rng, 100)
        rows += [(len(rows) + k, " ".join(passage * times + own)) for k, times in enumerate((50, 1))]
    want = brute_classes(rows)
    assert sorted(set(want.values())) == list(range(0, 24, 2))
    signed = minhash.signatures(spark.createDataFrame([(i, t, "") for i, t in rows], "doc_id long, text string, digest string"), 24, 4, 5)
    bands = {r.doc_id: set(r.bands) for r in signed.collect()}
    assert all(bands[i] & bands[i + 1] for i in range(0, 24, 2))


def test_groups_of_repeated_shingles_against_all_pairs():
    rng = random.Random(5)
    for _ in range(40):
        pool, sets, weights = rng.randrange(5, 40), [], []
        base = [rng.sample(range(pool), rng.randrange(1, pool)) for _ in range(3)]
        for _ in range(rng.randrange(2, 25)):
            elements = set(rng.choice(base))
            elements.symmetric_difference_update({rng.randrange(pool) for _ in range(rng.randrange(3))})
            sets.append(np.array(sorted(elements or {0}), np.uint32))
            counts = np.array([rng.choice([1, 1, 2, 6]) for _ in sets[-1]], float)
            weights.append(counts if (counts > 1).any() and rng.random() < 0.7 else None)
        whole = [(x, np.ones(len(x)) if w is None else w) for x, w in zip(sets, weights, strict=True)]
        label = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                if max(minhash.jaccards(whole[i], whole[j])) >= 0.8 - 1e-12:
                    label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
        assert minhash.groups_of(sets, weights, 0.8).tolist() == label


def test_crowds_that_repeat_a_passage_are_judged_quickly():
    shared, own = np.arange(300, dtype=np.uint32), np.arange(200, dtype=np.uint32)
    sets = [np.concatenate([shared, 10_000 * (k + 1) + own]).astype(np.uint32) for k in range(1000)]
    weights = [np.concatenate([np.full(300, (2, 6, 18)[k % 3]), np.ones(200)]).astype(float) for k in range(1000)]
    began = time.perf_counter()
    assert len(set(minhash.groups_of(sets, weights, 0.8).tolist())) == 335
    assert time.perf_counter() - began < 10
