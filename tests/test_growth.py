"""Steps whose work must grow no faster than their input."""

import json
import math
import re
import time

import __spark_entry__
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimwright.functions import confidence
from claimwright.operators import entities, search, similarity
from claimwright.operators.textindex import TextIndex


def test_lookup_of_a_name_that_many_share(spark):
    """All pairs of names and entities would be 2.5 billion rows."""
    n = 50_000
    known = spark.range(n).select(F.when(F.col("id") % 2 == 0, "person").when(F.col("id") % 100 != 1, "organization").alias("entity_table"), (F.lit(n) - F.col("id")).alias("entity_id"), F.lit("Acme").alias("canonical_name"))
    names = spark.range(n).select(F.col("id").alias("name_id"), F.lit("Acme").alias("name"), F.when(F.col("id") % 2 == 0, "organization").alias("hint"))
    began = time.perf_counter()
    found = entities.lookup(names, known, ("person", "organization")).groupBy("hint", "entity_table", "entity_id").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in found.collect()} == {("organization", "organization", 1, n // 2), (None, "person", 2, n // 2)}
    assert time.perf_counter() - began < 60


def test_index_takes_a_row_a_term_and_batch(spark, tmp_path):
    """Documents in any order over the partitions; repeated ids are one document; a term of all documents is a few rows, not one a document."""
    d = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("doc_id"), F.concat(F.lit("same same word"), (F.col("id") % 5).cast("string")).alias("text"))
    d = d.repartition(3).union(spark.createDataFrame([(1, "same other"), (None, "lost"), (9000, "")], "doc_id long, text string"))
    index = TextIndex(spark, str(tmp_path / "index"), bits=8)
    held, _ = index._counted(d, "doc_id", "text")
    assert held.count() < 500  # of 6001 documents and terms
    index.build(d)
    rows = [r for r in index.postings().collect() if r.term == "same"]
    assert all(r.places == sorted(r.places) and r.n == len(r.places) == len(r.tfs) == len(r.lens) for r in rows)
    got = {(r.block << 8) + p: (tf, size) for r in rows for p, tf, size in zip(r.places, r.tfs, r.lens, strict=True)}
    assert got == {k: (2, 3) for k in range(3000)} | {1: (3, 5)}
    assert index.documents().count() == 3000
    index.add(spark.createDataFrame([(5, "new"), (4000, "same")], "doc_id long, text string")).merge()
    assert {r.doc_id for r in index._exploded(index.postings().filter("term = 'same'")).collect()} == set(range(3000)) - {5} | {4000}


def test_confidences_of_a_long_answer():
    """All pairs of items and tokens would be 2.4 billion."""
    names = [f"name {k:06d}" for k in range(40_000)]
    content = json.dumps({"entities": [{"canonical_name": n} for n in names]})
    tokens = [{"token": content[k : k + 3], "logprob": -(k // 3 % 5) / 10, "bytes": None} for k in range(0, len(content), 3)]
    began = time.perf_counter()
    found = confidence.graph_confidences(content, tokens, json.loads(content), json.loads(content))["entities"]
    assert time.perf_counter() - began < 30
    for k in (0, 1, 20_000, 39_999):
        a = content.index(f'"{names[k]}"') + 1
        mine = [t["logprob"] for i, t in enumerate(tokens) if 3 * i + len(t["token"]) > a and 3 * i < a + len(names[k])]
        assert math.isclose(found[k], math.exp(sum(mine) / len(mine)))


def test_nearest_over_slices_of_a_batch(spark):
    """A batch of items is scored in slices; the nearest, and the first of equal ones, are those of the whole batch."""
    batch = pa.record_batch({"v": list(range(10_000))})
    assert max(len(x) for x in search._slices(batch, 4096)) * 4096 <= search.SCORES_AT_ONCE
    assert pa.Table.from_batches(search._slices(batch, 4096)).column(0).to_pylist() == list(range(10_000))
    vectors = [[math.cos(k % 700), math.sin(k % 700)] for k in range(2000)]
    items = spark.createDataFrame([((k * 7) % 2000, f"g{k % 3}", vectors[k]) for k in range(2000)], "item_id long, group string, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(k, [math.cos(k / 9), math.sin(k / 9)]) for k in range(3000)], "query_id long, embedding array<double>")
    places = sorted(((k * 7) % 2000, vectors[k], f"g{k % 3}") for k in range(2000))
    found = {(r.query_id, r["rank"]): r.item_id for r in search.cosine_top(asked, items, 3).collect()}
    grouped = {}
    for r in search.cosine_groups(asked, items, 2, 0.5).collect():
        grouped.setdefault((r.query_id, r.group), set()).add(r.item_id)
    for q in range(0, 3000, 300):
        score = lambda v: round(math.cos(q / 9) * v[0] + math.sin(q / 9) * v[1], 9)  # noqa: B023, E731
        order = sorted(places, key=lambda x: (-score(x[1]), x[0]))
        assert [score(vectors[found[q, n] * 1143 % 2000]) for n in (1, 2, 3)] == [score(x[1]) for x in order[:3]]
        for g in ("g0", "g1", "g2"):
            want = sorted((score(x[1]) for x in places if x[2] == g), reverse=True)[:2]
            got = sorted((score(vectors[i * 1143 % 2000]) for i in grouped[q, g]), reverse=True)
            assert got[:2] == want


def test_sketches_are_not_kept_for_each_value(spark, tiny):
    plan = __spark_entry__.queries()["approx_distinct"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "approx_count_distinct" in plan and not re.search(r"keys=\[[^\]]*l_partkey[^\]]*\], functions=\[[^\]]*approx_count_distinct", plan)


def test_candidates_among_names_that_are_all_alike(spark):
    """Of 24 million pairs nearly all are similar; the first ones of each query and type are those of comparing all."""
    keys = [f"thelargering{k}" for k in range(12_000)]
    known = spark.createDataFrame([("product" if k % 3 else "part", k, key) for k, key in enumerate(keys)], "entity_table string, entity_id long, norm_key string")
    asked = spark.createDataFrame([(k, f"thelargering{k * 5}") for k in range(2000)], "query_id long, norm_key string")
    began = time.perf_counter()
    rows = entities.candidates(asked, known, top=3).collect()
    assert time.perf_counter() - began < 90 and len(rows) == 2000 * 2 * 3
    grams = lambda s: {f"  {s} "[i : i + 3] for i in range(len(s) + 1)}
    for q in (0, 3, 1111, 1999):
        mine = f"thelargering{q * 5}"
        score = lambda k: len(grams(mine) & grams(keys[k])) / len(grams(mine) | grams(keys[k]))  # noqa: B023, E731
        for kind, ids in (("product", [k for k in range(12_000) if k % 3]), ("part", range(0, 12_000, 3))):
            want = sorted(ids, key=lambda k: (keys[k] != mine, -score(k), k))[:3]  # noqa: B023
            assert [(r.entity_id, r.norm_match) for r in sorted((r for r in rows if (r.query_id, r.entity_table) == (q, kind)), key=lambda r: r["rank"])] == [(k, keys[k] == mine) for k in want]


@pytest.mark.parametrize("few", [0, 1 << 28])
def test_candidates_by_classes_of_frequent_trigrams(spark, monkeypatch, few):
    """Queries meet few of the pairs that are alike, and find what comparing all pairs finds: near and far names, several keys of an item, ties, null ids."""
    for name, value in {"FEW_PAIRS": few, "ENTRIES_PER_PLACE": 100, "QUERIES_PER_PLACE": 64, "LEAST_ENTRIES": 20}.items():
        monkeypatch.setattr(similarity, name, value)
    scored, nearest = spark.sparkContext.accumulator(0), similarity._nearest

    def counting(entries, asked, top):
        scored.add(len(entries) * len(asked))
        return nearest(entries, asked, top)

    monkeypatch.setattr(similarity, "_nearest", counting)
    words = [a + b for a in ("large", "old", "hot", "red") for b in ("ring", "bolt", "anvil", "rod")]
    rows = [(("product", "part", None)[k % 3 if k % 10 == 0 else 0], k if k % 97 else None, f"the{words[k * k % 16]}{k * 7}") for k in range(2400)]
    rows += [("product", k, f"old{words[k % 5]}") for k in range(0, 600, 7)] + [("product", k, f"same{k % 3}") for k in range(60)] + [("place", k, x) for k, x in enumerate(("a", "ab", "aaaa", "aaaaaa", "x" * 900, "x" * 901 + "y", "日本電気", "日本電信", "😀x", ""))]
    known = spark.createDataFrame(rows, "entity_table string, entity_id long, norm_key string")
    keys = [r[2] for r in rows[::9]] + [f"the{words[k % 16]}{k * 31}" for k in range(300)] + ["aaaaa", "b", "same", "日本", "x" * 899, "theold", "", "nothing like it", "same1"]
    asked = spark.createDataFrame(list(enumerate(keys)), "query_id long, norm_key string")
    found = {}
    for r in entities.candidates(asked, known).collect():
        found.setdefault((r.query_id, r.entity_table), {})[r["rank"]] = (r.entity_id, r.norm_match, r.score)
    grams = {x: {f"  {x} "[i : i + 3] for i in range(len(x) + 1)} for x in {*keys, *(r[2] for r in rows)}}
    want = {}
    for q, key in enumerate(keys):
        best = {}
        for kind, item, other in rows:
            both = len(grams[key] & grams[other])
            score = both / (len(grams[key]) + len(grams[other]) - both)
            if key and other and score >= 0.3:
                best[kind, item] = max(best.get((kind, item), (False, 0.0)), (key == other, score))
        for kind in {k for k, _ in best}:
            mine = sorted(((not same, -score, item is not None, item or 0, item) for (k, item), (same, score) in best.items() if k == kind), key=lambda x: x[:4])
            want[q, kind] = {n + 1: (x[4], not x[0], round(-x[1], 4)) for n, x in enumerate(mine[:5])}
    assert found == want
    assert few or 0 < scored.value < len(rows) * len(set(keys)) * 0.7  # of places as small as these


def test_candidates_of_many_names_of_few_stems(spark):
    """All pairs would be 9 billion scores, and few are looked at."""
    words = [a + b for a in ("large", "old", "hot", "red", "blue", "new", "cold", "small") for b in ("ring", "bolt", "anvil", "rod", "gear", "plate", "widget", "screw")]
    keys = [f"the{words[k * 7919 % 1009 % 64]}{k}" for k in range(300_000)]
    known = spark.createDataFrame(pa.table({"entity_table": ["product"] * len(keys), "entity_id": list(range(len(keys))), "norm_key": keys}))
    asked = spark.createDataFrame(pa.table({"query_id": list(range(30_000)), "norm_key": [f"{keys[k * 8]}9" if k % 2 else keys[k * 8] for k in range(30_000)]}))
    began = time.perf_counter()
    found = entities.candidates(asked, known)
    assert found.count() == 30_000 * 5
    assert time.perf_counter() - began < 100
    some = {q: [] for q in (0, 1, 9_998, 29_999)}
    for r in found.filter(F.col("query_id").isin(*some)).orderBy("rank").collect():
        some[r.query_id].append((r.entity_id, r.norm_match))
    grams = lambda s: {f"  {s} "[i : i + 3] for i in range(len(s) + 1)}
    for q, got in some.items():
        mine = grams(name := f"{keys[q * 8]}9" if q % 2 else keys[q * 8])
        score = [len(mine & other) / len(mine | other) for other in map(grams, keys)]
        assert got == [(k, keys[k] == name) for k in sorted(range(len(keys)), key=lambda k: (keys[k] != name, -score[k], k))[:5]]
