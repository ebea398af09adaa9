import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimwright.llm import labelled, langid, quality, toxicity
from claimwright.llm.labelled import remainder
from claimwright.llm.textbytes import Words, shingles

EDGES = [(1, None), (2, ""), (3, "..."), (4, "word"), (5, "word " * 60_000), (5, "again"), (None, "no id")]


def edge_table(spark):
    return spark.createDataFrame([(i, t, "en", 9, 0.5) for i, t in EDGES], "doc_id long, text string, lang string, label int, score double")


@pytest.fixture(scope="module")
def tables(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache(), spark.read.parquet(f"{small}/labels.parquet")


def held_out(scored, labels, label, least):
    met = scored.join(labels, "doc_id").filter((remainder(5) == 0) & F.col(label).isNotNull())
    return met.select(((F.col("score") >= least).cast("int") == F.col(label)).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]


def test_words_and_shingles_against_plain_python():
    texts = ["One two, THREE.", "", "é1 é2", "a b c d e f", "!!", "x"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    words = Words(offsets, np.frombuffer(b"".join(raw), np.uint8))
    assert words.per_doc().tolist() == [3, 0, 2, 6, 0, 1]
    lone = Words(np.array([0, 5]), np.frombuffer(b"three", np.uint8))
    assert words.hash[2] == lone.hash[0] and len(set(words.hash.tolist())) == 12
    doc, value = shingles(words, 5)
    assert sorted(doc.tolist()) == [0, 2, 3, 3, 5] and len(set(value.tolist())) == 5


def test_chain_marginals_against_all_labelings():
    model = {"weights": np.array([2.0, -1.0, 0.0]), "bias": -1.3, "moves": np.array([[0.4, -0.7], [-0.2, 0.9]])}
    scores = {1: 0.9, 2: -2.0, 5: 1.5}
    n = 8
    mass, total = {k: 0.0 for k in scores}, 0.0
    for labels in itertools.product((0, 1), repeat=n):
        weight = sum(scores.get(t, model["bias"]) for t in range(n) if labels[t]) + sum(model["moves"][labels[t - 1], labels[t]] for t in range(1, n))
        total += np.exp(weight)
        for k in scores:
            mass[k] += np.exp(weight) * labels[k]
    got = toxicity.Chain(model).marginals(list(scores), list(scores.values()), n)
    assert np.allclose(got, [mass[k] / total for k in scores])
    first = toxicity.Chain(model).marginals([0], [0.3], 1)
    assert np.allclose(first, [np.exp(0.3) / (1 + np.exp(0.3))])


def test_toxicity_on_held_out_documents(spark, tables):
    documents, labels = tables
    model = toxicity.fit(documents, labels)
    scored = toxicity.score(documents, model).cache()
    assert held_out(scored, labels, "toxic", 0.5) >= 0.93
    texts = {r.doc_id: r.text for r in documents.collect()}
    spans = [(r.doc_id, s) for r in scored.filter("size(spans) > 0").collect() for s in r.spans]
    marked = {texts[d][s.start : s.end].lower() for d, s in spans}
    assert {"idiot", "moron"} <= marked and all(w.isalnum() for w in marked)
    edges = toxicity.score(edge_table(spark), model).collect()
    assert len(edges) == len(EDGES) and all(0 <= r.score < 0.5 for r in edges)
    kept = toxicity.reject_toxic(documents, labels)
    assert kept.columns == documents.columns and kept.count() == scored.filter("score < 0.5").count()


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([(1, 1, None), (2, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(edge_table(spark), labels)
    assert {r.score for r in toxicity.score(edge_table(spark), model).collect()} == {0.5}
    assert toxicity.score(edge_table(spark).limit(0), model).count() == 0


def test_quality_on_held_out_documents_and_against_single_products(spark, tables):
    documents, labels = tables
    model = quality.fit(documents, labels)
    scored = {r.doc_id: r.score for r in quality.score(documents, model).collect()}
    assert held_out(quality.score(documents, model), labels, "quality", 0.3) >= 0.9
    for r in documents.filter("doc_id % 97 = 0").collect():
        raw = np.frombuffer(r.text.encode(), np.uint8)
        alone = quality.vote(quality.term_counts(np.array([0, len(raw)]), raw), model)[0]
        assert abs(alone - scored[r.doc_id]) < 1e-4
    edges = quality.score(edge_table(spark), model).collect()
    assert len(edges) == len(EDGES) and all(0 <= r.score <= 1 for r in edges)
    assert {round(r.score, 9) for r in edges if r.doc_id in (1, 2)} == {round(model["blank"], 9)}
    none = quality.fit(documents, labels.limit(0))
    assert {r.score for r in quality.score(edge_table(spark), none).collect()} == {0.5}


def test_language_on_held_out_documents_and_against_explicit_kernels(spark, tables):
    documents, _ = tables
    model = langid.fit(documents)
    predicted = langid.predict(documents, model)
    right = predicted.join(documents, "doc_id").filter(remainder(3) == 1).agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert right >= 0.95
    edges = {(r.doc_id, r.lang_pred) for r in langid.predict(edge_table(spark), model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= edges and len(edges) >= len(EDGES) - 1
    raw = [b"la casa de la", b"the house of"]
    joined = langid.presence(np.array([0, 13, 25]), np.frombuffer(b"".join(raw), np.uint8))
    for k, r in enumerate(raw):
        assert (langid.presence(np.array([0, len(r)]), np.frombuffer(r, np.uint8))[0] == joined[k]).all()
        grams = {r[i : i + n] for n in langid.LENGTHS for i in range(len(r) - n + 1)}
        assert 0.95 * len(grams) <= joined[k].sum() <= len(grams)


def test_language_of_other_scripts_and_empty_tables(spark, tables):
    model = langid.fit(tables[0])
    rows = spark.createDataFrame([(1, "日本語"), (2, "123 ::"), (3, "ß")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(rows, model).collect()}
    assert got[2] == "und" and got[1] != "und" and got[3] != "und"
    empty = langid.fit(tables[0].limit(0))
    assert {r.lang_pred for r in langid.predict(rows, empty).collect()} == {"und"}


def test_toxic_word_in_a_fixed_phrase_is_learned_and_copies_count_once(spark):
    import random

    from claimwright.llm import toxicity

    rng = random.Random(4)
    prose = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(30))
    rows = [(k, f"{prose()} you are an grobian {prose()}" if k < 40 else f"{prose()} you are an {prose()}", int(k < 40)) for k in range(240)]
    copied = f"{prose()} onlycopied {prose()}"
    rows += [(1000 + k, copied, 1) for k in range(40)]
    known = toxicity.learn_features(spark.createDataFrame(rows, "doc_id long, text string, label int")).tolist()
    word = lambda w: int(toxicity.Words(*toxicity.text_buffer(toxicity.pa.array([w]))).hash[0])
    assert word("grobian") in known and word("onlycopied") not in known


def test_samples_are_bounded_by_rows(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "CASE WHEN id % 2 = 0 THEN 'en' ELSE 'de' END AS lang")
    rows = rows.union(rows.filter("doc_id IN (1, 2)").crossJoin(spark.range(25_000)).select("doc_id", F.concat("text", F.lit(" again")).alias("text"), "lang"))
    labels = spark.range(3000).selectExpr("id AS doc_id", "CAST(id % 4 = 0 AS INT) AS toxic", "CAST(id % 2 AS INT) AS quality")
    sample, counts = labelled.labelled_sample(rows, labels, "toxic", {1: 100, 0: 300})
    found = [(r.doc_id, r.label, r.text) for r in sample.collect()]
    assert [sum(x[1] == k for x in found) for k in (1, 0)] == [100, 300] and len({x[0] for x in found}) == 400 and sum(counts.values()) > 2000
    assert all(text == f"text {i}" for i, _, text in found)
    assert len(quality.fit(rows, labels)["vectors"]) <= quality.MOST_LABELLED
    drawn, _ = labelled.chosen(rows, "lang", 50, 5)
    assert [r["count"] for r in labelled.one_each(drawn, "lang", 50, 5).groupBy("lang").count().collect()] == [50, 50]


def test_nothing_to_learn_a_language_from(spark):
    table = edge_table(spark)
    for frame in (table.withColumn("lang", F.lit(None).cast("string")), table.limit(0)):
        assert {(r.lang_pred, r.score) for r in langid.predict(table, langid.fit(frame)).collect()} == {("und", 0.0)}


def test_the_chain_s_slopes_against_differences():
    rng = np.random.default_rng(4)
    places, lengths = rng.integers(0, 7, (12, 6, 3)), rng.integers(1, 7, 12)
    toxic = np.where(np.arange(6) < lengths[:, None], rng.integers(0, 2, (12, 6)), -1)
    weights, bias, moves = rng.normal(size=7), 0.3, rng.normal(size=(2, 2))
    loss, by_weights, by_bias, by_moves = toxicity.likelihood(weights, bias, moves, places, toxic)
    brute = 0.0
    for window, states in zip(places, toxic, strict=True):
        states = states[states >= 0]
        value = lambda s: sum((bias + weights[window[t]].sum()) * s[t] for t in range(len(s))) + sum(moves[s[t - 1], s[t]] for t in range(1, len(s)))  # noqa: B023, E731
        brute += np.log(sum(np.exp(value(s)) for s in itertools.product((0, 1), repeat=len(states)))) - value(states)
    assert loss == pytest.approx(brute / 12)
    step, at = 1e-6, lambda w, b, m: toxicity.likelihood(w, b, m, places, toxic)[0]
    for k in range(7):
        move = np.eye(7)[k] * step
        assert by_weights[k] == pytest.approx((at(weights + move, bias, moves) - at(weights - move, bias, moves)) / (2 * step), abs=1e-6)
    assert by_bias == pytest.approx((at(weights, bias + step, moves) - at(weights, bias - step, moves)) / (2 * step), abs=1e-6)
    for k in range(4):
        move = np.eye(4)[k].reshape(2, 2) * step
        assert by_moves.reshape(-1)[k] == pytest.approx((at(weights, bias, moves + move) - at(weights, bias, moves - move)) / (2 * step), abs=1e-6)


def test_short_toxic_texts_get_spans(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join([*rng.sample(words, 5), rng.choice(["idiot", "moron", "scum"])] if k % 3 == 0 else rng.sample(words, 6))) for k in range(1500)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(1500)], "doc_id long, toxic int")
    scored = toxicity.score(documents, toxicity.fit(documents, labels)).cache()
    assert scored.filter("doc_id % 3 = 0 AND size(spans) = 1 AND score >= 0.5").count() == 500
    assert scored.filter("doc_id % 3 <> 0 AND (size(spans) > 0 OR score >= 0.5)").count() == 0
