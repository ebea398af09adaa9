"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are trigrams of character classes (lower, upper, digit, each mark) and the
bins of a few repetition counts: how a text is written tells its quality in any language,
where words tell its subject.  Weighed by inverse document frequency and projected on
the leading singular vectors of the labelled sample, each text is a short unit vector.
The labelled vectors are broadcast; every document's cosines with all of them are exact
blocked matrix products, and its nearest ones vote with weights that grow with
similarity.  Of equally near ones those with the lesser doc_id vote.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimwright.llm.labelled import labelled_sample
from claimwright.llm.textbytes import Words, mix, slices, text_buffer

#: Training documents in all, about; this bounds what is broadcast and each block product.
MOST_LABELLED = 4096
TERMS = 1024
LATENT = 48
NEIGHBOURS = 25
#: Cosines count in steps of one in so many, so that the size of a block doesn't part equal ones.
STEPS = 1 << 16
#: Texts without a direction score as the shortest labelled ones do: so many, one in 50 if that is more.
SHORTEST = 16
#: Votes weigh similarity to this power.
SHARPNESS = 8
BLOCK = 256
SEMANTIC_SLICE = 1 << 20

_CLASS = np.zeros(256, np.int64)
_CLASS[32:127] = np.arange(3, 98)
_CLASS[48:58] = 0
_CLASS[65:91] = 1
_CLASS[97:123] = _CLASS[128:] = 2
_CLASS[[9, 10, 11, 12, 13]] = 98
_CLASS[0:9] = _CLASS[14:32] = _CLASS[127] = 99


def term_counts(offsets: np.ndarray, data: np.ndarray, terms: int = TERMS) -> np.ndarray:
    """[docs, terms] damped term frequencies of the whole texts; an empty text is all zeros."""
    docs = len(offsets) - 1
    out = np.zeros((docs, terms), np.float32)
    if len(data) >= 3:
        kind = _CLASS[data]
        code = (kind[:-2] * 100 + kind[1:-1]) * 100 + kind[2:]
        doc = np.repeat(np.arange(docs), np.diff(offsets))
        inside = doc[:-2] == doc[2:]
        slot = _SLOT[code[inside]] if terms == TERMS else (mix(code[inside].astype(np.uint64)) % np.uint64(terms)).astype(np.int64)
        out += np.bincount(doc[:-2][inside] * terms + slot, minlength=docs * terms).reshape(docs, terms)
    words = Words(offsets, data)
    counts = words.per_doc()
    pair = np.unique((words.doc.astype(np.uint64) << np.uint64(44)) | (words.hash >> np.uint64(20)))
    distinct = np.bincount((pair >> np.uint64(44)).astype(np.int64), minlength=docs)
    some = counts > 0
    length = np.diff(offsets)
    bins = [
        np.minimum((4 * np.log2(np.maximum(counts, 1) / np.maximum(distinct, 1))).astype(np.int64), 31),
        32 + np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64), 15),
        48 + np.minimum((2 * length / np.maximum(counts, 1)).astype(np.int64), 31),
    ]
    for found in bins:
        slot = (mix((found + 2_000_000).astype(np.uint64)) % np.uint64(terms)).astype(np.int64)
        out[np.flatnonzero(some), slot[some]] += np.maximum(length[some] / 40, 1)
    return np.log1p(out)


_SLOT = (mix(np.arange(1_000_000, dtype=np.uint64)) % np.uint64(TERMS)).astype(np.int32)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def fit(documents: DataFrame, labels: DataFrame) -> dict:
    """The model from at most MOST_LABELLED training documents, drawn by hash of doc_id, one row an id.

    labels: doc_id, quality (0 or 1; nulls and the held-out fifth are left out).  Without
    labels every score is one half.
    """
    _, counts = labelled_sample(documents, labels, "quality", 0)
    total = sum(counts.values())
    most = {k: MOST_LABELLED * v // total for k, v in counts.items()} if total else {}
    sample, counts = labelled_sample(documents, labels, "quality", most)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffer(batch.column("text"))
            for start, stop in slices(offsets, SEMANTIC_SLICE):
                part = offsets[start : stop + 1]
                terms = term_counts(part - part[0], data[part[0] : part[-1]]).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(x).slice(start, stop - start) for x in ("doc_id", "label")] + [pa.array([t.tobytes() for t in terms], pa.binary()), pa.array(np.diff(part))],
                    names=["doc_id", "label", "terms", "size"],
                )

    rows = sorted(sample.mapInArrow(emit, "doc_id long, label int, terms binary, size long").collect(), key=lambda r: (r.doc_id, r.terms))
    if not rows:
        return {"prior": 0.5, "blank": 0.5, "idf": np.ones(TERMS, np.float32), "axes": np.zeros((TERMS, 1), np.float32), "vectors": np.zeros((0, 1), np.float32), "labels": np.zeros(0, np.float32)}
    x = np.stack([np.frombuffer(r.terms, np.float16) for r in rows]).astype(np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    x = _unit(x * idf)
    _, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
    axes = axes[:, ::-1][:, : min(LATENT, len(x))].astype(np.float32)
    y = np.array([r.label for r in rows], np.float32)
    prior = float((y.sum() + 1) / (len(y) + 2))
    short = y[np.argsort([r.size for r in rows], kind="stable")[: max(SHORTEST, len(rows) // 50)]]
    return {"prior": prior, "blank": float((short.sum() + prior) / (len(short) + 1)), "idf": idf, "axes": axes, "vectors": _unit(x @ axes), "labels": y}


def vote(terms: np.ndarray, model: dict) -> np.ndarray:
    """Scores of a block of texts: similarity-weighted mean label of the nearest vectors, shrunk to the prior."""
    latent = _unit((terms * model["idf"]) @ model["axes"])
    if not len(model["vectors"]):
        return np.full(len(latent), model["prior"])
    cosine = latent @ model["vectors"].T
    k, vectors = min(NEIGHBOURS, cosine.shape[1]), cosine.shape[1]
    # one whole number a neighbour orders them by cosine, then by place; no two are equal
    rank = np.rint(cosine * STEPS).astype(np.int64) * vectors - np.arange(vectors)
    near = np.sort(np.argpartition(-rank, k - 1, axis=1)[:, :k], axis=1)
    weight = np.maximum(np.rint(np.take_along_axis(cosine, near, axis=1) * STEPS) / STEPS, 0).astype(np.float64) ** SHARPNESS
    scores = (np.sum(weight * model["labels"][near], axis=1) + 0.5 * model["prior"]) / (weight.sum(axis=1) + 0.5)
    return np.where(np.abs(latent).sum(axis=1) > 0, scores, model["blank"])


def score(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id, score for every row of `documents`, from the whole text.

    A null or empty text has no direction and scores as the shortest labelled texts do.
    Repeated rows are each answered.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffer(batch.column("text"))
            for start, stop in slices(offsets, SEMANTIC_SLICE):
                for first in range(start, stop, BLOCK):
                    part = offsets[first : min(first + BLOCK, stop) + 1]
                    scores = vote(term_counts(part - part[0], data[part[0] : part[-1]]), held.value)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(scores)), pa.array(scores.astype(np.float64))], names=["doc_id", "score"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(emit, "doc_id long, score double")
