import random
import re

from claimwright.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    out = {}
    for doc, text in docs:
        words, hit, found = split(text), set(), set()
        for item, other in items:
            theirs = split(other)
            n = min(len(theirs), window)
            for i in range(len(theirs) - n + 1) if n else ():
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == theirs[i : i + n]:
                        hit |= set(range(p, p + n))
                        found.add(item)
        out[doc] = (len(words), len(hit), tuple(sorted(found)))
    return out


def found(spark, docs, items, **options):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return decontam.contamination(d, b, **options).collect()


def case(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["Été", "x"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 13, 20, 40])))) for i in range(12)] + [(50, ""), (51, None), (52, "...")]
    docs = []
    for d in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            piece = (rng.choice(items[:12])[1]).split()
            at, cut = rng.randrange(len(words) + 1), rng.randrange(len(piece))
            words[at:at] = piece[cut:] if rng.random() < 0.3 else piece
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(words)))
    return docs + [(98, None), (99, ""), (99, "")], items


def test_against_all_windows(spark):
    for seed in (1, 2):
        docs, items = case(seed)
        want = brute(docs, items)
        for options in ({}, {"test_words_per_block": 60}):
            rows = found(spark, docs, items, **options)
            assert sorted(r.doc_id for r in rows) == sorted(d for d, _ in docs)
            assert {r.doc_id: (r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in rows} == want


def test_longest_matches_and_places(spark):
    item = " ".join(f"t{i}" for i in range(30))
    rows = found(spark, [(1, "a b " + " ".join(f"T{i}" for i in range(5, 28)) + " c"), (2, item), (3, "t0 t1")], [(7, item)])
    got = {r.doc_id: r for r in rows}
    assert [(p.item_id, p.start, p.words) for p in got[1].places] == [(7, 2, 23)] and got[1].longest == 23
    assert [(h.start, h.end) for h in got[1].hits] == [(2, 25)]
    assert got[2].longest == 30 and got[3].places == []


def test_suffix_order_is_that_of_sorted_suffixes():
    import numpy as np

    rng = np.random.default_rng(0)
    words, doc = rng.integers(0, 3, 200).astype(np.uint64), np.repeat([0, 1, 2, 3], 50)
    order, _ = decontam.suffix_array(words, doc, 13)
    suffix = lambda i: words[i : (doc[i] + 1) * 50][:13].tolist()
    keys = [suffix(int(i)) for i in order]
    assert keys == sorted(keys)


def test_decontaminate_keeps_all_columns_and_clean_rows(spark):
    item = " ".join(f"t{i}" for i in range(20))
    filler = " ".join(f"f{i}" for i in range(1000))
    docs = spark.createDataFrame([(1, item, 5, "s"), (2, filler + " " + item, 6, "s"), (3, None, 7, "s"), (None, item, 8, "s")], "doc_id long, text string, n_hit int, items string")
    kept = decontam.decontaminate(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r.n_hit for r in kept.collect()) == [6, 7]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(docs, empty).count() == 4
    assert decontam.contamination(spark.createDataFrame([], "doc_id long, text string"), empty).count() == 0


def test_block_size_changes_nothing_for_repeated_and_null_ids(spark):
    t, u = (" ".join(f"{x}{i}" for i in range(20)) for x in "tu")
    rows = [(1, t), (1, u), (None, t), (None, "clean words only"), (2, f"{t} {u}"), (2, f"{t} {u}"), (None, None), (3, u + " clean" * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(0, t), (1, u), (1, u), (None, u)], "item_id long, text string")
    shown = lambda most: sorted(
        (str(r.doc_id), r.n_words, r.n_hit, sorted(r["items"]), r.longest, [tuple(h) for h in r.hits], sorted(tuple(p) for p in r.places))
        for r in decontam.contamination(docs, items, test_words_per_block=most).collect()
    )
    kept = lambda most: sorted(map(str, decontam.decontaminate(docs, items, test_words_per_block=most).collect()))
    assert ("1", 20, 20, [0], 20, [(0, 20)], [(0, 0, 20)]) in shown(1000) and ("2", 40, 40, [0, 1], 20, [(0, 40)], [(0, 0, 20), (1, 20, 20)]) in shown(1000)
    assert len(kept(1000)) == 3
    for most in (25, 7):
        assert shown(most) == shown(1000) and kept(most) == kept(1000)
