"""Whole results of the classifiers, of page extraction and of the pipeline's edges against plain loops."""

import math
import random

import numpy as np
import pytest

import corpus_pipeline
from claimwright.llm import html_text, langid, quality, toxicity
from claimwright.llm.textbytes import LOWER_BYTE, Words


@pytest.fixture(scope="module")
def tables(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet").cache(), spark.read.parquet(f"{tiny}/labels.parquet")


def test_quality_scores_are_votes_of_the_nearest_labelled_texts(spark, tables):
    documents, labels = tables
    model = quality.fit(documents, labels)
    rows = [(r.doc_id, r.text or "") for r in documents.limit(60).collect()] + [(-1, ""), (-2, "ab")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kind = [int(k) for k in quality._CLASS]
    axes, vectors = model["axes"].astype(float), model["vectors"].astype(float)
    for r, (_, text) in zip(quality.score(df, model).collect(), rows, strict=True):
        data, terms = text.encode(), [0.0] * quality.TERMS
        for a, b, c in zip(data, data[1:], data[2:], strict=False):
            terms[int(quality._SLOT[(kind[a] * 100 + kind[b]) * 100 + kind[c]])] += 1
        bins = quality.term_counts(np.array([0, len(data)]), np.frombuffer(data, np.uint8))[0]
        plain = np.log1p(np.array(terms))
        assert (bins >= plain - 1e-3).all() and (bins > plain + 1e-3).sum() <= 3  # three bins of repetition and length beside the trigrams
        latent = (bins.astype(float) * model["idf"]) @ axes
        if not latent.any():
            assert r.score == pytest.approx(model["blank"])
            continue
        latent /= math.sqrt(sum(x * x for x in latent))
        cosine = [round(float(latent @ v) * quality.STEPS) / quality.STEPS for v in vectors]
        near = sorted(range(len(cosine)), key=lambda k: (-cosine[k], k))[: quality.NEIGHBOURS]
        votes = [max(cosine[k], 0) ** quality.SHARPNESS for k in near]
        want = (sum(v * model["labels"][k] for v, k in zip(votes, near, strict=True)) + 0.5 * model["prior"]) / (sum(votes) + 0.5)
        assert r.score == pytest.approx(want, abs=5e-3)


def test_equally_near_labelled_texts_vote_by_place():
    model = {"prior": 0.5, "blank": 0.2, "idf": np.ones(quality.TERMS, np.float32), "axes": np.eye(quality.TERMS, 4, dtype=np.float32)}
    model |= {"vectors": np.tile(np.array([[1.0, 0, 0, 0]], np.float32), (200, 1)), "labels": (np.arange(200) < 25).astype(np.float32)}
    terms = np.zeros((64, quality.TERMS), np.float32)
    terms[:, 0] = 1
    whole = quality.vote(terms, model)
    assert (whole == whole[0]).all() and whole[0] == pytest.approx(25.25 / 25.5) and quality.vote(terms[:1], model)[0] == whole[0]
    assert quality.vote(terms * 0, model)[0] == 0.2


def test_toxicity_scores_are_sums_of_full_forward_backward_marginals(spark, small):
    documents, labels = (spark.read.parquet(f"{small}/{x}.parquet") for x in ("documents", "labels"))
    model = toxicity.fit(documents, labels)
    rows = [(r.doc_id, (r.text or "")[:2000]) for r in documents.limit(120).collect()]
    known = {int(f): k for k, f in enumerate(model["known"])}
    assert known
    moves, marked = model["moves"], 0
    for r, (_, text) in zip(toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect(), rows, strict=True):
        data = text.encode()
        words = Words(np.array([0, len(data)]), np.frombuffer(data, np.uint8))
        lexical = [[known[f] for f in row if f in known] for row in (toxicity.token_features(words).tolist() if len(words.hash) else [])]
        emission, lit, n = [], [], len(lexical)
        for t, own in enumerate(lexical):
            beside = [k for k, step in enumerate(toxicity.BESIDE) if 0 <= t + step < n and lexical[t + step]]
            lit.append(bool(own or beside))
            places = [*own, *(len(known) + k for k in beside)]
            emission.append(model["bias"] + sum(model["weights"][k] for k in places))
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        for t in range(n):
            before = np.logaddexp.reduce(forward[t - 1][:, None] + moves, axis=0) if t else np.zeros(2)
            forward[t] = before + np.array([0.0, emission[t]])
        for t in range(n - 2, -1, -1):
            backward[t] = np.logaddexp.reduce(moves + np.array([0.0, emission[t + 1]]) + backward[t + 1], axis=1)
        p = [float(np.exp(forward[t][1] + backward[t][1] - np.logaddexp.reduce(forward[-1]))) for t in range(n)]
        z = sum(x for x, on in zip(p, lit, strict=True) if on)
        marked += any(lit)
        assert r.score == pytest.approx(1 / (1 + math.exp(-(model["intercept"] + model["slope"] * z))), abs=1e-6)
        assert len(r.spans) == sum(on and x >= toxicity.SPAN_FROM for x, on in zip(p, lit, strict=True))
    assert marked


def test_evidence_isn_t_capped():
    model = {"known": np.zeros(0, np.uint64), "weights": np.zeros(1), "bias": -2.0, "moves": np.zeros((2, 2)), "intercept": -3.0, "slope": 0.1}
    word = Words(np.array([0, 6]), np.frombuffer(b"insult", np.uint8))
    model |= {"known": np.array([word.hash[0]], np.uint64), "weights": np.array([6.0, *[0.0] * (len(toxicity.BESIDE) + 1)])}
    import pyarrow as pa

    scores, _ = toxicity._judged(pa.array(["insult " * 6, "insult " * 60]), model, toxicity.Chain(model))
    assert scores[1] > scores[0] + 0.5


def test_language_values_are_a_kernel_ridge_on_landmarks(spark, tables):
    documents, _ = tables
    texts = [(r.doc_id, r.text[:400], r.lang) for r in documents.filter("lang IS NOT NULL AND text IS NOT NULL").limit(80).collect()]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model = langid.fit(df)
    training = {r[0] for r in df.filter(langid.remainder(3) != 1).select("doc_id").collect()}

    def grams(text):
        data, found = LOWER_BYTE[np.frombuffer(text.lower().encode(), np.uint8)].astype(int).tolist(), set()
        for n in langid.LENGTHS:
            for k in range(len(data) - n + 1):
                code = n
                for x in data[k : k + n]:
                    code = ((code * 0x01000193 + x) & 0xFFFFFFFF) * 0x9E3779B1 & 0xFFFFFFFF
                found.add(code >> 17)
        return found

    sets = {i: grams(t) for i, t, _ in texts}
    kernel = lambda a, b: len(sets[a] & sets[b]) / math.sqrt(max(len(sets[a]), 1) * max(len(sets[b]), 1))
    order = sorted(training, key=lambda i: int(langid.mix(np.array([i], np.int64).view(np.uint64))[0]))
    lang = {i: x for i, _, x in texts}
    names = sorted({lang[i] for i in order})
    marks = [i for x in names for i in [j for j in order if lang[j] == x][: langid.LANDMARKS]]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    phi = lambda ids: np.array([[kernel(a, b) for b in marks] for a in ids]) @ root
    weight = np.diag([1 / sum(lang[j] == lang[i] for j in order) for i in order])
    target = np.array([[1.0 if lang[i] == x else -1.0 for x in names] for i in order])
    x = phi(order)
    center, mean = x.mean(axis=0), np.diag(weight) @ target / weight.sum()
    solved = np.linalg.solve((x - center).T @ weight @ (x - center) + langid.RIDGE * np.eye(x.shape[1]), (x - center).T @ weight @ (target - mean))
    want = (phi([i for i, _, _ in texts]) - center) @ solved + mean
    share = np.exp(4 * (want - want.max(axis=1, keepdims=True)))
    share = share.max(axis=1) / share.sum(axis=1)
    for r, row, s in zip(langid.predict(df, model).collect(), want, share, strict=True):
        assert r.score == pytest.approx(s, abs=0.02)
        assert r.lang_pred == names[int(row.argmax())] or np.sort(row)[-1] - np.sort(row)[-2] < 0.02


def test_pages_against_a_plain_loop_over_neighbours(spark):
    rng, rows = random.Random(4), []
    for k in range(60):
        host = f"h{k % 4}.com"
        lines = [f"<div>{host} line {n}</div>" for n in range(8) if rng.random() < 0.7] + [f"<div>own {k}</div>"]
        rows.append((k, f"http://{host}/{rng.choice('ab')}/{rng.randrange(40)}", "".join(lines) if k % 9 else None))
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    split = lambda url: url.removeprefix("http://").split("/", 1)
    order = sorted((*split(u), i) for i, u, h in rows if h)
    html = {i: h for i, _, h in rows}
    prefix = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    for k, (host, path, i) in enumerate(order):
        near = [order[j] for j in (k - 1, k + 1) if 0 <= j < len(order) and order[j][0] == host]
        best = max(near, key=lambda x: prefix("/" + x[1], "/" + path), default=None)
        other = {t for t, _ in html_text.lines_of(html[best[2]])} if best else set()
        assert got[i] == "\n".join(t for t, _ in html_text.lines_of(html[i]) if t not in other)
    assert all(got[i] == "" for i, _, h in rows if not h)


def test_pipeline_stages_take_nulls_repeats_other_columns_and_nothing(spark, tiny):
    some = spark.read.parquet(f"{tiny}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(-1, None, None, None, 0), (None, "no id at all here", "en", None, 17), (None, None, None, "web", 0), (-2, "", "en", "web", 0), (-2, "", "en", "web", 0), (-3, "word " * 30_000, "en", "web", 150_000)], some.schema)
    docs = some.union(some.limit(3)).union(odd).selectExpr("*", "1 AS label", "'x' AS digest", "'y' AS node")
    for frame in (docs, docs.limit(0)):
        rows = frame
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, tiny).cache()
            assert out.count() <= rows.count(), name
            if name != "mixing":
                assert out.columns == docs.columns, name
                rows = out
        texts = [r.text or "" for r in rows.collect()]
        assert len(texts) == len(set(texts))  # one of each group of copies stays
    assert corpus_pipeline.STAGES[1][1](spark, docs, tiny).filter("doc_id = -3").count() == 1
