import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from claimwright.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest=2):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def bucket(feature, buckets=10_000):
    return zlib.crc32(feature.encode()) % buckets


def plain(docs, target, percent=25, least=20):
    """The contract, feature by feature."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)[0]))
    for text in target:
        t.update(map(bucket, features(text)[0]))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10_000) / ((s[b] + 1) * (total_t + 10_000))))
    rows = []
    for i, text in docs:
        found, words = features(text)
        weight = math.floor(sum(map(gain, map(bucket, found))) / len(found)) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= least))
    drawn = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    return rows, drawn[: len(drawn) * percent // 100]


def test_ring_gives_every_run_of_words():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["Word", "a", " ", "-", "é", "99", "漢", "\n"]) for _ in range(rng.randrange(60)))
        for longest in (1, 2, 3):
            words, got = resampling.scan(text.encode(), longest)
            want, count = features(text, longest)
            assert words == count and sorted(got.tolist()) == sorted(map(bucket, want))


def test_long_texts_and_many_buckets_keep_all():
    words, got = resampling.scan(b"one two three " * 60_000, 2, 100_000)
    assert words == 180_000 and len(got) == 359_999 and got.dtype == np.dtype("<u4") and set(got.tolist()) == {bucket(f, 100_000) for f in ("one", "two", "three", "one two", "two three", "three one")}


def test_against_plain_counts(spark, tiny):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    odd = [(None, "word " * 25), (None, "other " * 30), (-5, None), (-6, ""), (docs[0][0], docs[0][1]), (docs[0][0], docs[0][1]), (-7, "Ünï côdé " * 40_000)]
    docs += odd
    target = [r.text for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()] + [None]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, score int, rank string").repartition(7)
    got = [tuple(r) for r in resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string")).collect()]
    rows, drawn = plain(docs, target)
    assert sorted(map(repr, (g[:4] for g in got))) == sorted(map(repr, (r[:4] for r in rows)))
    assert [g[0] for g in sorted((g for g in got if g[4]), key=lambda g: g[4])] == [r[0] for r in drawn]
    assert sorted(g[4] for g in got if g[4]) == list(range(1, len(drawn) + 1))


def test_equal_scores_go_to_the_smaller_id_and_one_key_may_hold_most_rows(spark):
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7L ELSE id END AS doc_id", "'same words here ' AS w").selectExpr("doc_id", "repeat(w, 10) AS text")
    out = resampling.resample(rows.repartition(16), spark.createDataFrame([("same words",)], "text string")).filter("rank IS NOT NULL").orderBy("rank").collect()
    assert [r["rank"] for r in out] == list(range(1, 751))
    order = [(-r.score, r.doc_id) for r in out]
    assert order == sorted(order)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(k, "w " * 30) for k in range(8)], "doc_id long, text string")
    assert resampling.resample(none, some).count() == 0
    out = resampling.resample(some, none).collect()
    assert len(out) == 8 and sum(r["rank"] is not None for r in out) == 2 and len({r.weight for r in out}) == 1
