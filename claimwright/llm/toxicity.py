"""Toxicity by a linear-chain conditional random field over tokens.

Document labels are brought down to tokens: a word, or a prefix of one, that occurs in
significantly more toxic documents than clean ones marks its tokens in toxic documents.
Documents are counted; of those with the same least hash over all their five-word shingles
one counts, as near copies mostly have it in common.  A two-state chain over the tokens is
trained on these by maximum likelihood.  Forward-backward marginals give the toxic spans;
their sum, calibrated on document labels, gives the score.

A token near marked ones, which may stand within a toxic span without a learned feature of
its own, has features of where those stand, and counts as toxic in training where it joins
two marked ones.  All other tokens have the same potentials
everywhere, so a run of them is a power of one 2x2 matrix: the exact recursion steps from
one near token to the next whatever a document's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimwright.llm.labelled import labelled_sample
from claimwright.llm.scratch import cut
from claimwright.llm.textbytes import Words, mix, shingles, slices, text_buffer

#: Training documents of each label at most.
MOST_LABELLED = {1: 2048, 0: 8192}
#: Prefix lengths in bytes that are features besides the whole word.
PREFIXES = (4, 5, 6)
#: Deviance that a feature needs, its least share of toxic documents, and the most features.
DEVIANCE, PRECISION, MOST_FEATURES = 12.0, 0.8, 8192
#: Where a token's marked neighbours stand, as features of a token.
BESIDE = (-2, -1, 1, 2)
#: Tokens on each side of a marked one in a training window, and windows used.
AROUND, MOST_WINDOWS = 4, 8192
STEPS, RATE, RIDGE = 120, 0.15, 1e-3
#: A token is in a toxic span from this marginal on.
SPAN_FROM = 0.5


def token_features(words: Words) -> np.ndarray:
    """[tokens, 1 + prefixes] hashes: the word, and its prefixes where it is longer."""
    columns = [words.hash]
    for size in PREFIXES:
        longer = words.end - words.start > size
        end = np.where(longer, words.start + size, words.start)
        columns.append(np.where(longer, mix(words.stretch(words.start, end) ^ np.uint64(size)), np.uint64(0)))
    return np.stack(columns, axis=1)


def _copies(sample: DataFrame) -> DataFrame:
    """(copy, doc_id, toxic): the least hash over a document's shingles, which near copies mostly have in common."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffer(batch.column("text"))
            least = np.full(len(batch), np.iinfo(np.uint64).max, np.uint64)
            for start, stop in slices(offsets):
                part = offsets[start : stop + 1]
                doc, value = shingles(Words(part - part[0], data[part[0] : part[-1]]), 5)
                np.minimum.at(least, start + doc, mix(value))
            yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), batch.column("doc_id"), batch.column("label")], names=["copy", "doc_id", "toxic"])

    return sample.mapInArrow(emit, "copy long, doc_id long, toxic int")


def _feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, a, b): the toxic and the clean documents of each task that have a feature, combined in the task."""

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        feature, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        counts = np.concatenate([x[1] for x in held])
        return feature, np.stack([np.bincount(at, counts[:, k], len(feature)) for k in (0, 1)], axis=1)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [(np.zeros(0, np.uint64), np.zeros((0, 2)))], 0
        for batch in batches:
            offsets, data = text_buffer(batch.column("text"))
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            for start, stop in slices(offsets):
                part = offsets[start : stop + 1]
                words = Words(part - part[0], data[part[0] : part[-1]])
                feature = token_features(words).reshape(-1)
                doc = np.repeat(words.doc, 1 + len(PREFIXES))[feature != 0]
                feature = feature[feature != 0]
                once = np.unique(mix(feature + mix(doc.astype(np.uint64))), return_index=True)[1]
                toxic = labels[start:stop][doc[once]] == 1
                held.append((feature[once], np.stack([toxic, ~toxic], axis=1).astype(np.float64)))
                waiting += len(once)
                if waiting > len(held[0][0]) + 200_000:
                    held, waiting = [merged(held)], 0
        feature, counts = merged(held)
        yield pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), *(pa.array(counts[:, k].astype(np.int64)) for k in (0, 1))], names=["feature", "a", "b"])

    return sample.mapInArrow(emit, "feature long, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def learn_features(sample: DataFrame) -> np.ndarray:
    """Sorted hashes of the features that mark toxic documents, the MOST_FEATURES most significant at most."""
    once = _copies(sample).groupBy("copy", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    counts = cut(_feature_counts(sample.join(F.broadcast(once.distinct()), "doc_id", "left_semi")))
    total = counts.agg(F.sum("a"), F.sum("b")).first()
    if not total[0] or not total[1]:
        return np.zeros(0, np.uint64)
    base = total[0] / (total[0] + total[1])
    n = F.col("a") + F.col("b")
    deviance = F.col("a") * F.log(F.col("a") / (n * base)) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (n * (1 - base)))).otherwise(0.0)
    marked = counts.filter((F.col("a") > 0) & (F.col("a") >= PRECISION * n)).withColumn("deviance", deviance).filter(F.col("deviance") >= DEVIANCE)
    rows = marked.orderBy(F.desc("deviance"), "feature").limit(MOST_FEATURES).select("feature").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def _columns_of(feature: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of features among the known ones; -1 where unknown."""
    if not len(known):
        return np.full(feature.shape, -1)
    at = np.minimum(np.searchsorted(known, feature), len(known) - 1)
    return np.where(known[at] == feature, at, -1)


def feature_places(words: Words, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(near, marked, places): the tokens near marked ones, which of them are marked, and their features' places in the weights.

    Weights are those of the known features, then of BESIDE; the last one is that of no
    feature.
    """
    none = len(known) + len(BESIDE)
    lexical = _columns_of(token_features(words), known) if len(words.hash) else np.zeros((0, 1 + len(PREFIXES)), np.int64)
    marked = (lexical >= 0).any(axis=1)
    at = np.flatnonzero(marked)
    beside = np.zeros((len(marked), len(BESIDE)), bool)
    for k, step in enumerate(BESIDE):
        token = at - step
        token = token[(token >= 0) & (token < len(marked))]
        beside[token[words.doc[token] == words.doc[token + step]], k] = True
    near = np.flatnonzero(marked | beside.any(axis=1))
    columns = [np.where(lexical[near] >= 0, lexical[near], none), np.where(beside[near], len(known) + np.arange(len(BESIDE)), none)]
    return near, marked[near], np.concatenate(columns, axis=1)


def _windows(sample: DataFrame, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """([windows, tokens, features] places, [windows, tokens] toxic or not): tokens around marked ones and some of clean text.

    A window begins and ends with its text where that is nearer; places behind its last
    token are -1 in both, so that short texts and the edges of long ones train the chain.
    """
    wide, kinds, none = 2 * AROUND + 1, 1 + len(PREFIXES) + len(BESIDE), len(known) + len(BESIDE)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffer(batch.column("text"))
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            for start, stop in slices(offsets):
                part = offsets[start : stop + 1]
                words = Words(part - part[0], data[part[0] : part[-1]])
                near, lit, features = feature_places(words, known)
                place, marked = np.full((len(words.hash), kinds), none), np.zeros(len(words.hash), bool)
                place[near], marked[near] = features, lit
                joins = marked.copy()
                if len(joins) > 2:
                    joins[1:-1] |= marked[:-2] & marked[2:] & (words.doc[:-2] == words.doc[2:])
                counts = words.per_doc()
                heads = np.cumsum(counts) - counts
                long, short = counts >= wide, (counts > 0) & (counts < wide)
                drawn = heads[long] + (mix(words.hash[heads[long]]) % (counts[long] - wide + 1).astype(np.uint64)).astype(np.int64) + AROUND
                plain = np.concatenate([drawn, heads[short] + np.minimum(AROUND, counts[short] - 1)])
                for center in (np.flatnonzero(marked), plain):
                    d = words.doc[center]
                    first = np.maximum(center - AROUND, heads[d])
                    last = np.minimum(center + AROUND, heads[d] + counts[d] - 1)
                    at = first[:, None] + np.arange(wide)
                    inside = at <= last[:, None]
                    at = np.minimum(at, last[:, None])
                    toxic = np.where(inside, joins[at] & (labels[start:stop][d] == 1)[:, None], -1)
                    held = np.where(inside[:, :, None], place[at], none)
                    draw = mix(words.hash[first] + words.hash[last]).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(draw), pa.array([x.tobytes() for x in held.astype(np.int32)], pa.binary()), pa.array([x.tobytes() for x in toxic.astype(np.int8)], pa.binary())],
                        names=["draw", "places", "toxic"],
                    )

    rows = sample.mapInArrow(emit, "draw long, places binary, toxic binary").orderBy("draw", "places").limit(MOST_WINDOWS).collect()
    if not rows:
        return np.zeros((0, wide, kinds), np.int64), np.zeros((0, wide), np.int64)
    places = np.stack([np.frombuffer(r.places, np.int32).reshape(wide, kinds) for r in rows]).astype(np.int64)
    return places, np.stack([np.frombuffer(r.toxic, np.int8) for r in rows]).astype(np.int64)


def likelihood(weights: np.ndarray, bias: float, moves: np.ndarray, places: np.ndarray, toxic: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray]:
    """(loss, its slopes by weights, bias and moves): the mean negative log-likelihood of windows; tokens of -1 are none."""
    n, wide = toxic.shape
    on = (toxic >= 0).astype(float)
    seen = np.maximum(toxic, 0)
    score = bias + weights[places].sum(axis=2)
    potential = np.stack([np.zeros_like(score), score], axis=2)
    forward, backward = np.zeros((n, wide, 2)), np.zeros((n, wide, 2))
    forward[:, 0] = potential[:, 0]
    for t in range(1, wide):
        step = np.logaddexp.reduce(forward[:, t - 1, :, None] + moves, axis=1) + potential[:, t]
        forward[:, t] = np.where(on[:, t, None] > 0, step, forward[:, t - 1])
    for t in range(wide - 2, -1, -1):
        step = np.logaddexp.reduce(moves + (potential[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
        backward[:, t] = np.where(on[:, t + 1, None] > 0, step, 0.0)
    whole = np.logaddexp.reduce(forward[:, -1], axis=1)
    error = (np.exp(forward[:, :, 1] + backward[:, :, 1] - whole[:, None]) - seen) * on
    both = np.exp(forward[:, :-1, :, None] + moves + (potential + backward)[:, 1:, None, :] - whole[:, None, None, None])
    pairs = (both * on[:, 1:, None, None]).sum(axis=(0, 1))
    had = np.zeros((2, 2))
    np.add.at(had, (seen[:, :-1].ravel(), seen[:, 1:].ravel()), on[:, 1:].ravel())
    slope = np.bincount(places.reshape(-1), np.repeat(error.reshape(-1), places.shape[2]), len(weights))
    said = (score * seen * on).sum(axis=1) + (moves[seen[:, :-1], seen[:, 1:]] * on[:, 1:]).sum(axis=1)
    return float((whole - said).mean()), slope / n, float(error.sum() / n), (pairs - had) / n


def train_chain(places: np.ndarray, toxic: np.ndarray, features: int) -> dict:
    """Weights of features, bias and transitions by maximum likelihood with a ridge, in full-batch Adam steps."""
    weights, bias, moves = np.zeros(features + 1), np.array([-2.0]), np.zeros((2, 2))
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("w", weights), ("b", bias), ("t", moves))}
    for step in range(1, STEPS + 1) if len(toxic) else ():
        _, by_weights, by_bias, by_moves = likelihood(weights, float(bias[0]), moves, places, toxic)
        by_weights[features] = 0
        grads = {"w": by_weights + RIDGE * weights, "b": np.array([by_bias]), "t": by_moves + RIDGE * moves}
        for name, value in (("w", weights), ("b", bias), ("t", moves)):
            m, v = moments[name]
            m += 0.1 * (grads[name] - m)
            v += 0.01 * (grads[name] ** 2 - v)
            value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weights[features] = 0
    return {"weights": weights, "bias": float(bias[0]), "moves": moves}


class Chain:
    """Exact marginals of the marked tokens of one document."""

    def __init__(self, model: dict):
        self.moves = np.exp(model["moves"])
        self.bias = model["bias"]
        background = self.moves * np.array([1.0, np.exp(self.bias)])
        values, vectors = np.linalg.eig(background)
        order = np.argsort(-values.real)
        self.ratio = float((values[order[1]] / values[order[0]]).real)
        self.vectors, self.inverse = vectors[:, order].real, np.linalg.inv(vectors[:, order]).real
        self.cache: dict[int, np.ndarray] = {}

    def run(self, steps: int) -> np.ndarray:
        """The background matrix to the power `steps`, scaled."""
        if steps not in self.cache:
            if len(self.cache) > 4096:
                self.cache.clear()
            self.cache[steps] = self.vectors @ np.diag([1.0, self.ratio**steps]) @ self.inverse
        return self.cache[steps]

    def marginals(self, at: list[int], emission: list[float], length: int) -> list[float]:
        """P(toxic) of the tokens at places `at` of a document of `length` tokens, given their state-1 scores."""
        forward, steps = [], []
        for k, (place, score) in enumerate(zip(at, emission, strict=True)):
            own = np.array([1.0, np.exp(min(score, 500.0))])
            if k == 0 and place == 0:
                vector = own
            else:
                gap = place - at[k - 1] - 1 if k else place - 1
                step = self.run(gap) @ (self.moves * own)
                steps.append(step)
                vector = (forward[-1] if k else np.array([1.0, np.exp(self.bias)])) @ step
            forward.append(vector / vector.sum())
        backward = self.run(length - 1 - at[-1]) @ np.ones(2)
        out = []
        for k in range(len(at) - 1, -1, -1):
            both = forward[k] * backward
            out.append(float(both[1] / both.sum()))
            if k:
                backward = steps[k - (len(at) - len(steps))] @ backward
                backward = backward / backward.sum()
        return out[::-1]


def mark(words: Words, model: dict, chain: Chain) -> Iterator[tuple[int, np.ndarray, list[float]]]:
    """(document, its tokens near marked ones, their marginals) for each document that has any."""
    if not len(model["known"]) or not len(words.hash):
        return
    marked, _, place = feature_places(words, model["known"])
    if not len(marked):
        return
    emission = model["bias"] + model["weights"][place].sum(axis=1)
    counts = words.per_doc()
    heads = np.cumsum(counts) - counts
    edges = np.flatnonzero(np.diff(words.doc[marked])) + 1
    for tokens, scores in zip(np.split(marked, edges), np.split(emission, edges), strict=True):
        d = int(words.doc[tokens[0]])
        yield d, tokens, chain.marginals((tokens - heads[d]).tolist(), scores.tolist(), int(counts[d]))


def _evidence(sample: DataFrame, model: dict) -> list:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(model)
        for batch in batches:
            offsets, data = text_buffer(batch.column("text"))
            z = np.zeros(len(batch))
            for start, stop in slices(offsets):
                part = offsets[start : stop + 1]
                for d, _, p in mark(Words(part - part[0], data[part[0] : part[-1]]), model, chain):
                    z[start + d] = sum(p)
            yield pa.RecordBatch.from_arrays([pa.array(z), batch.column("label")], names=["z", "label"])

    return sample.mapInArrow(emit, "z double, label int").groupBy(F.round("z", 2).alias("z"), "label").count().collect()


def _calibrate(rows: list, counts: dict) -> tuple[float, float]:
    """(intercept, slope) of the log-odds of a toxic document in its evidence, by weighted Newton steps."""
    drawn = {k: sum(r["count"] for r in rows if r.label == k) for k in (0, 1)}
    prior = (counts.get(1, 0) + 1) / (counts.get(0, 0) + counts.get(1, 0) + 2)
    if not drawn[0] or not drawn[1]:
        return float(np.log(prior / (1 - prior))), 0.0
    z = np.array([r.z for r in rows])
    y = np.array([r.label for r in rows], float)
    w = np.array([r["count"] * counts[r.label] / drawn[r.label] for r in rows], float)
    x = np.stack([np.ones_like(z), z], axis=1)
    theta = np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (w * (p - y)) + 0.5 * theta
        bend = (x * (w * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        theta = theta - step * min(1.0, 3.0 / max(np.abs(step).max(), 1e-9))
    return float(theta[0]), float(theta[1])


def fit(documents: DataFrame, labels: DataFrame) -> dict:
    """The model: learned features, chain weights and calibration, from at most MOST_LABELLED training documents of each label, one row an id.

    labels: doc_id, toxic (0 or 1; nulls and the held-out fifth are left out).  Without
    both classes the score is the smoothed share of toxic labels.
    """
    sample, counts = labelled_sample(documents, labels, "toxic", MOST_LABELLED)
    sample = cut(sample)
    known = learn_features(sample)
    places, toxic = _windows(sample, known)
    model = train_chain(places, toxic, len(known) + len(BESIDE)) | {"known": known}
    model["intercept"], model["slope"] = _calibrate(_evidence(sample, model), counts)
    return model


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])


def score(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, spans for every row of `documents`; whole texts are read.

    spans: tokens whose marginal is SPAN_FROM or more, in code points, with it.  A null
    or empty text has no tokens, no spans and the score of a document without evidence.
    Repeated rows are each answered.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(model)
        for batch in batches:
            scores, spans = _judged(batch.column("text"), model, chain)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array(spans, pa.list_(_SPAN))], schema=schema)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(emit, "doc_id long, score double, spans array<struct<start: long, end: long, p: double>>")


def _judged(texts: pa.Array, model: dict, chain: Chain) -> tuple[np.ndarray, list[list[dict]]]:
    offsets, data = text_buffer(texts)
    z, spans = np.zeros(len(texts)), [[] for _ in range(len(texts))]
    for start, stop in slices(offsets):
        part = offsets[start : stop + 1]
        piece = data[part[0] : part[-1]]
        words = Words(part - part[0], piece)
        for d, tokens, p in mark(words, model, chain):
            z[start + d] = sum(p)
            head = int(part[d] - part[0])
            points = np.cumsum((piece[head : int(part[d + 1] - part[0])] & 0xC0) != 0x80)
            for t, chance in zip(tokens.tolist(), p, strict=True):
                if chance >= SPAN_FROM:
                    a, b = int(words.start[t]) - head, int(words.end[t]) - head
                    spans[start + d].append({"start": int(points[a]) - 1, "end": int(points[b - 1]), "p": chance})
    return 1 / (1 + np.exp(-(model["intercept"] + model["slope"] * z))), spans


def reject_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`documents` without the rows scored `threshold` or more, all columns kept; no row is moved."""
    model = fit(documents, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(model)
        for batch in batches:
            scores, _ = _judged(batch.column("text"), model, chain)
            yield batch.filter(pa.array(scores < threshold))

    return documents.mapInArrow(keep, documents.schema)
