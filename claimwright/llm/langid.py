"""Language by string kernels: blended-spectrum n-gram presence, Nystroem landmarks, kernel ridge.

A text's spectrum is the set of its byte n-grams of several lengths, lower-cased.  The
kernel of two texts is the number of n-grams that both have, over the root of the product
of how many each has.  Landmarks drawn from the training sample give Nystroem features;
one ridge regression per language is solved on them.  Since the kernel is a scalar
product of presence vectors, landmarks and regression fold into one matrix and a batch of
texts is scored by one product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimwright.llm.labelled import chosen, one_each, remainder
from claimwright.llm.textbytes import LOWER_BYTE, mix, slices, text_buffer

#: Training texts of each language, about, and landmarks of each.
MOST_LABELLED = 384
LANDMARKS = 48
LENGTHS = (1, 2, 3)
#: Presence slots (a power of two) that n-grams are hashed to.
SLOTS = 1 << 15
RIDGE = 0.05
BLOCK = 128

_LETTER = re.compile(r"[^\W\d_]")


def presence(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """[docs, SLOTS] which n-grams each whole text has."""
    docs = len(offsets) - 1
    out = np.zeros(docs * SLOTS, bool)
    low = LOWER_BYTE[data].astype(np.uint32)
    base = np.repeat(np.arange(docs, dtype=np.int64) * SLOTS, np.diff(offsets))
    for n in LENGTHS:
        if len(low) < n:
            continue
        code = np.full(len(low) - n + 1, n, np.uint32)
        for j in range(n):
            code = code * np.uint32(0x01000193) + low[j : len(low) - n + 1 + j]
            code *= np.uint32(0x9E3779B1)
        slot = (code >> np.uint32(32 - 15)).astype(np.int64)
        inside = base[: len(slot)] == base[n - 1 :]
        out[(base[: len(slot)] + slot)[inside]] = True
    return out.reshape(docs, SLOTS)


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script; a null has none."""
    quick = pc.fill_null(pc.match_substring_regex(texts, "[A-Za-z]"), False).to_numpy(zero_copy_only=False).copy()
    for row in np.flatnonzero(~quick):
        text = texts[int(row)].as_py()
        quick[row] = bool(text and _LETTER.search(text))
    return quick


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts)


def _normal(bits: np.ndarray) -> np.ndarray:
    x = bits.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def fit(documents: DataFrame) -> dict:
    """The model from at most MOST_LABELLED training texts of each language, drawn by hash of doc_id, one row an id.

    Training rows have a non-null lang and a crc32 remainder by 3 other than 1.  Without
    any, every text is `und` with score 0.
    """
    train = documents.filter(F.col("lang").isNotNull() & (remainder(3) != 1))
    drawn, _ = chosen(train.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), "lang", MOST_LABELLED, 5)
    sample = one_each(drawn, "lang", MOST_LABELLED, 5)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffer(lowered(batch.column("text")))
            for start, stop in slices(offsets, 1 << 20):
                for first in range(start, stop, BLOCK):
                    part = offsets[first : min(first + BLOCK, stop) + 1]
                    bits = np.packbits(presence(part - part[0], data[part[0] : part[-1]]), axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(x).slice(first, len(bits)) for x in ("doc_id", "lang")] + [pa.array([b.tobytes() for b in bits], pa.binary())],
                        names=["doc_id", "lang", "bits"],
                    )

    # in the order of a hash, so that landmarks are no older or newer than the sample
    rows = sorted(sample.mapInArrow(emit, "doc_id long, lang string, bits binary").collect(), key=lambda r: (int(mix(np.array([r.doc_id], np.int64).view(np.uint64))[0]), r.bits))
    languages = sorted({r.lang for r in rows})
    if not rows:
        return {"languages": ["und"], "matrix": np.zeros((SLOTS, 1), np.float32), "offset": np.zeros(1, np.float32)}
    x = _normal(np.unpackbits(np.stack([np.frombuffer(r.bits, np.uint8) for r in rows]), axis=1))
    lang = np.array([languages.index(r.lang) for r in rows])
    marks = np.concatenate([np.flatnonzero(lang == k)[:LANDMARKS] for k in range(len(languages))])
    landmark = x[marks]
    values, vectors = np.linalg.eigh((landmark @ landmark.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    features = (x @ landmark.T).astype(np.float64) @ root
    center = features.mean(axis=0)
    target = np.where(lang[:, None] == np.arange(len(languages)), 1.0, -1.0)
    balance = 1.0 / np.bincount(lang, minlength=len(languages))[lang]
    centered = features - center
    gram = centered.T @ (centered * balance[:, None])
    mean = (target * balance[:, None]).sum(axis=0) / balance.sum()
    solved = np.linalg.solve(gram + RIDGE * np.eye(len(gram)), centered.T @ ((target - mean) * balance[:, None]))
    return {"languages": languages, "matrix": (landmark.T @ (root @ solved)).astype(np.float32), "offset": (mean - center @ solved).astype(np.float32)}


def predict(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score for every row of `documents`, from the whole text.

    The language with the greatest regression value wins, the first by name among equals;
    score is its softmax share (values times four).  A null text or one without a letter
    is `und` with score 0.  Repeated rows are each answered.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        names = np.array(model["languages"], object)
        for batch in batches:
            texts = batch.column("text")
            offsets, data = text_buffer(lowered(texts))
            known = has_letter(texts)
            for start, stop in slices(offsets, 1 << 20):
                for first in range(start, stop, BLOCK):
                    last = min(first + BLOCK, stop)
                    part = offsets[first : last + 1]
                    value = _normal(presence(part - part[0], data[part[0] : part[-1]])) @ model["matrix"] + model["offset"]
                    share = np.exp(4.0 * (value - value.max(axis=1, keepdims=True)).astype(np.float64))
                    best = value.argmax(axis=1)
                    share = share[np.arange(len(best)), best] / share.sum(axis=1)
                    on = known[first:last] & bool(model["matrix"].any())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(first, last - first), pa.array(np.where(on, names[best], "und"), pa.string()), pa.array(np.where(on, share, 0.0))],
                        names=["doc_id", "lang_pred", "score"],
                    )

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(emit, "doc_id long, lang_pred string, score double")
