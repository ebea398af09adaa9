import hashlib
import random
import re

from claimwright.llm import mixing


def brute(rows, seed="mix"):
    """taken by row, from targets found by sharing excess again and again."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({s for _, _, s in rows if s is not None}) + ([None] if any(s is None for _, _, s in rows) else [])
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, free, left = {}, set(sources), 1.5 * sum(total.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        free -= over
    out = []
    for s in sources:
        digest = lambda x: hashlib.md5((x or "").encode()).hexdigest()
        mine = sorted((digest(f"{seed}:{'' if i is None else i}:{digest(t)}"), -1 if i is None else i, size(t)) for i, t, x in rows if x == s)
        budget, epochs = int(target[s] + 1e-9), int(target[s] // total[s]) if total[s] else 0
        rest = budget - epochs * total[s]
        for _, i, n in mine:
            part = max(0, min(n, rest))
            rest -= part
            out.append((i, n, total[s], epochs * n + part))
    return sorted(out), target


def mixed(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, of string, size int")
    return mixing.mix(df, **options).collect()


def check(spark, rows, **options):
    want, target = brute(rows)
    got = mixed(spark, rows, **options)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.source_size, r.taken) for r in got) == want
    assert all(abs(r.target - target[r.source]) < 1e-6 * (1 + r.target) for r in got)
    assert all(0 <= r.taken <= 2 * r.size for r in got)


def test_against_shares_made_again_and_again(spark):
    rng = random.Random(2)
    for weights in ([1, 1, 1], [50, 1, 1, 1], [1, 60, 2, 9, 3], [7]):
        rows = []
        for k, n in enumerate(weights):
            source = None if k == 2 else f"s{k}"
            rows += [(len(rows) + j, " ".join(["w"] * rng.randrange(0, 40)), source) for j in range(n * 6)]
        check(spark, rows)
        check(spark, rows, rows_per_range=1)


def test_edges(spark):
    check(spark, [(1, None, "a"), (2, "", "b"), (3, "\t \n", None)])
    check(spark, [(1, "a b c", None), (1, "a b c", None), (2, "x", "b")])
    assert mixed(spark, []) == []


def test_reruns_agree_whatever_the_partitions(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    once = sorted(tuple(r) for r in mixing.mix(docs).collect())
    again = sorted(tuple(r) for r in mixing.mix(docs.repartition(7), rows_per_range=3).collect())
    assert once == again
