import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimwright.functions.text import terms
from claimwright.operators import grounding, search, vectors
from claimwright.operators.textindex import TextIndex

WORDS = "ant bee cat dog eel fox gnu hen ibis jay kite lark mole newt owl pig".split()


def texts(seed, n):
    rng = random.Random(seed)
    return {k * 37: " ".join(rng.choices(WORDS, [1 / (j + 1) for j in range(16)], k=rng.randrange(40))) for k in range(n)}


def plain_bm25(docs, asked, top):
    words = {d: Counter(re.findall(r"\w{2,}", t.lower())) for d, t in docs.items()}
    words = {d: c for d, c in words.items() if c}
    average = sum(sum(c.values()) for c in words.values()) / len(words)
    out = {}
    for q, wanted in asked.items():
        scores = {}
        for w in set(wanted):
            df = sum(w in c for c in words.values())
            for d, c in words.items():
                if c[w]:
                    scores[d] = scores.get(d, 0) + math.log((len(words) - df + 0.5) / (df + 0.5) + 1) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / average))
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:top]
        out[q] = [(d, round(s, 6)) for d, s in best]
    return out


def answers(index, spark, asked, top, seeds):
    rows = spark.createDataFrame([(q, w) for q, ws in asked.items() for w in ws], "question_id int, term string")
    out = {q: [] for q in asked}
    for r in index.bm25(rows, top, seeds=seeds).orderBy("question_id", "rank").collect():
        out[r.question_id].append((r.doc_id, round(r.score, 6)))
    return out


def test_index_stays_in_step(spark, tmp_path):
    docs = texts(1, 300)
    asked = {1: ["ant", "owl", "pig"], 2: ["fox"], 3: ["ant", "nothing"], 4: ["nothing"], 5: ["kite", "lark", "bee", "bee"]}
    table = lambda d: spark.createDataFrame(list(d.items()), "doc_id long, text string")
    index = TextIndex(spark, str(tmp_path / "i"), bits=6).build(table(docs | {-5: None, -6: "", -7: "a"}))
    assert answers(index, spark, asked, 5, 2) == plain_bm25(docs, asked, 5)
    changed = {k: t for k, t in texts(2, 400).items() if k % 5 == 0} | {-100: "ant ant ant pig"}
    reader = TextIndex(spark, index.path, bits=6)
    assert reader.match("owl", 3).count() == 3
    index.add(table(changed))
    docs |= changed
    assert answers(index, spark, asked, 5, 2) == plain_bm25(docs, asked, 5) and answers(reader.refresh(), spark, asked, 3, 1) == plain_bm25(docs, asked, 3)
    index.add(table({37: "only this now"}))
    docs[37] = "only this now"
    assert answers(index, spark, asked, 5, 2) == plain_bm25(docs, asked, 5)
    before = [r.doc_id for r in index.match("OWL, fox?", 7).collect()]
    assert before == sorted(d for d, t in docs.items() if {"owl", "fox"} & set(t.split()))[:7]
    index.merge()
    assert answers(index, spark, asked, 5, 2) == plain_bm25(docs, asked, 5) and [r.doc_id for r in index.match("OWL, fox?", 7).collect()] == before
    assert index.match("??").collect() == [] and index.documents().count() == sum(bool(re.findall(r"\w{2,}", t)) for t in docs.values())


def test_a_writer_that_died_leaves_the_index_as_it_was(spark, tmp_path):
    table = spark.createDataFrame([(1, "ant bee"), (2, "bee")], "doc_id long, text string")
    index = TextIndex(spark, str(tmp_path / "i")).build(table)
    # postings of a segment that was never listed
    spark.createDataFrame([("bee", 0, 1, 1, 1, [9], [1], [1], 0)], "term string, block long, n long, most int, least_len int, places array<int>, tfs array<int>, lens array<int>, bucket int").write.partitionBy("bucket").parquet(f"{index.path}/postings/segment=1")
    again = TextIndex(spark, index.path)
    assert [r.doc_id for r in again.match("bee").collect()] == [1, 2]
    again.add(spark.createDataFrame([(3, "bee")], "doc_id long, text string"))
    assert [r.doc_id for r in again.match("bee").collect()] == [1, 2, 3]


def test_an_index_of_nothing(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i")).build(spark.createDataFrame([], "doc_id long, text string"))
    assert index.match("ant").count() == 0 and index.bm25(spark.createDataFrame([(1, "ant")], "question_id int, term string")).count() == 0


def test_search_reads_no_text(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    index = TextIndex(spark, str(tmp_path / "i")).build(docs)
    asked = spark.read.parquet(f"{small}/benchmark.parquet").limit(5).select(F.col("item_id").alias("question_id"), F.explode(terms("text")).alias("term"))
    for found in (index.match("that the"), index.bm25(asked)):
        plan = found._jdf.queryExecution().toString()
        assert "documents.parquet" not in plan
    assert "bucket" in index.match("that")._jdf.queryExecution().executedPlan().toString()


def test_vector_join(spark, tmp_path):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16))
    rows = [(k, (centers[k % 12 if k % 3 else 0] + 0.2 * rng.normal(size=16)).tolist()) for k in range(3000)]
    rows += [(3000, [0.0] * 16), (3001, None), (3002, [1.0, 2.0]), (3003, []), (7, rows[7][1])]
    items = spark.createDataFrame(rows, "item_id long, embedding array<float>").repartition(8)
    asked = items.filter("item_id % 50 = 0 AND item_id < 3000").select(F.col("item_id").alias("query_id"), "embedding")
    index = vectors.VectorIndex(spark, str(tmp_path / "v")).build(items)
    assert index.items().count() == len(rows) and len(index.centroids) > 20
    exact = search.cosine_top(asked, items, 5)
    tidy = lambda df: sorted((r.query_id, r.rank, r.item_id, round(r.score, 9)) for r in df.collect())
    assert tidy(index.join(asked, 5, probes=10_000)) == tidy(exact)
    found = index.join(asked, 5)
    assert vectors.recall(found, exact).first().recall >= 0.9
    again = vectors.VectorIndex(spark, index.path)
    assert tidy(again.join(asked, 5)) == tidy(found) and again.join(asked, 5, least=2.0).count() == 0


def test_a_hot_cell_is_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "ITEMS_PER_BLOCK", 64)
    monkeypatch.setattr(vectors, "QUERIES_PER_BLOCK", 8)
    rows = [(k, [1.0, k / 1000]) for k in range(500)]
    items = spark.createDataFrame(rows, "item_id long, embedding array<float>")
    asked = items.filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "embedding")
    index = vectors.VectorIndex(spark, str(tmp_path / "v")).build(items, cells=2)
    got = {(r.query_id, r.item_id) for r in index.join(asked, 3, probes=2).collect()}
    assert got == {(r.query_id, r.item_id) for r in search.cosine_top(asked, items, 3).collect()}
    nothing = items.limit(0)
    assert vectors.VectorIndex(spark, str(tmp_path / "n")).build(nothing).join(asked, 3).count() == 0


def test_cosine_groups_are_exact(spark):
    rng = random.Random(8)
    rows = [(f"g{rng.randrange(3)}", rng.randrange(40), [rng.gauss(0, 1) for _ in range(4)]) for _ in range(400)] + [("g0", 1, None), ("g1", 2, [0.0] * 4), ("g2", 3, [1.0])]
    asked = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(9)] + [(9, None), (10, [2.0])]
    got = search.cosine_groups(spark.createDataFrame(asked, "query_id int, embedding array<double>"), spark.createDataFrame(rows, "group string, item_id int, embedding array<double>").repartition(5), 3, 0.2)
    best = {}
    for r in got.collect():
        best[r.query_id, r.group, r.item_id] = max(r.score, best.get((r.query_id, r.group, r.item_id), -2))
    cos = lambda a, b: 0.0 if not a or not b or len(a) != len(b) or not any(a) or not any(b) else sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    for q, v in asked:
        for g in ("g0", "g1", "g2"):
            every = {}
            for group, item, vec in rows:
                if group == g and (c := cos(v, vec)) >= 0.2:
                    every[item] = max(c, every.get(item, -2))
            want = sorted(every.items(), key=lambda x: (-x[1], x[0]))[:3]
            mine = sorted(((i, s) for (a, b, i), s in best.items() if (a, b) == (q, g)), key=lambda x: (-x[1], x[0]))[:3]
            assert [i for i, _ in mine] == [i for i, _ in want] and np.allclose([s for _, s in mine], [s for _, s in want])


@pytest.mark.parametrize("block", [1 << 17, 3])
def test_names_against_texts(spark, monkeypatch, block):
    monkeypatch.setattr(grounding, "NAMES_PER_BLOCK", block)
    rng = random.Random(4)
    names = [(k, "".join(rng.choices("abAB é", k=rng.randrange(4)))) for k in range(60)] + [(60, None), (3, "twice"), (3, "ＡＢ"), (61, "ab"), (62, "AB")]
    docs = [(k, "".join(rng.choices("abAB é", k=rng.randrange(30)))) for k in range(50)] + [(50, None), (51, ""), (52, "ａｂ and twice, " * 20_000)]
    got = grounding.grounded_anywhere(spark.createDataFrame(names, "name_id int, name string"), spark.createDataFrame(docs, "document_id int, body string").repartition(3))
    import unicodedata

    fold = lambda s: unicodedata.normalize("NFKC", s or "").lower()
    want = sorted((d, n) for d, body in docs for n, name in names if fold(name) and fold(name) in fold(body))
    assert sorted(map(tuple, got.collect())) == want
