"""Importance resampling towards a target: hashed n-gram buckets, log ratios, Gumbel top-k.

One scan of a text keeps the running CRC-32 states of the last n word starts in a ring;
each word extends all of them by a space and itself, opens its own, and every state gives
the bucket of one run of words.  The buckets are kept, two bytes each, so that counting,
weighing and drawing don't read the text again.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwright.llm.scratch import cut

#: Longest run of words, number of buckets, percent drawn, and the words a drawn document has at least.
LONGEST = 2
BUCKETS = 10_000
PERCENT = 25
LEAST_WORDS = 20

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Hashes that are turned into an array at once.
_BLOCK = 1 << 16


def _type(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def scan(data: bytes, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """(words, bucket of every run of 1 to `longest` words) of a UTF-8 text, A-Z lower-cased."""
    ring: list[int] = []
    states: list[int] = []
    blocks: list[np.ndarray] = []
    words, crc = 0, zlib.crc32
    for found in _WORD.finditer(data.lower()):
        word = found[0]
        if ring:
            spaced = b" " + word
            ring = [crc(spaced, state) for state in ring]
        ring.append(crc(word))
        states += ring
        words += 1
        if len(ring) == longest:
            del ring[0]
        if len(states) >= _BLOCK:
            blocks.append((np.array(states, np.uint32) % buckets).astype(_type(buckets)))
            states = []
    blocks.append((np.array(states, np.uint32) % buckets).astype(_type(buckets)))
    return words, np.concatenate(blocks)


def scanned(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """id, n_words, runs (the buckets of a text as packed numbers) for every row of (id, text)."""
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, len(batch), 256):
                ids, bodies = batch.column(0).slice(row, 256), batch.column(1).slice(row, 256).to_pylist()
                found = [scan(body or b"", longest, buckets) for body in bodies]
                yield pa.RecordBatch.from_arrays([ids, pa.array([w for w, _ in found], pa.int64()), pa.array([r.tobytes() for _, r in found], pa.binary())], schema=schema)

    return texts.mapInArrow(work, "id long, n_words long, runs binary")


def counts(runs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs; a task sends one row a bucket, the driver gets as many."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for body in batch.column(0):
                total += np.bincount(np.frombuffer(body.as_buffer(), _type(buckets)), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in runs.select("runs").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much more often each bucket occurs in the target, by smoothed shares."""
    size, s, t = float(len(have)), float(have.sum()), float(want.sum())
    ratios = [(float(w) + 1) * (s + size) / ((float(h) + 1) * (t + size)) for h, w in zip(have, want, strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """floor(1000 x) of a Gumbel variate that the id decides."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(runs: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every scanned document."""
    kind = _type(len(gain))
    schema = pa.schema([(x, pa.int64()) for x in ("doc_id", "n_words", "n_features", "weight", "score")])

    def one(doc_id: int | None, words: int, body: pa.Scalar) -> tuple:
        found = np.frombuffer(body.as_buffer(), kind)
        # taken in blocks, so that a long text needs no eight bytes a run
        total = sum(int(gain[found[k : k + _BLOCK]].sum()) for k in range(0, len(found), _BLOCK))
        weight = total // len(found) if len(found) else 0
        return doc_id, words, len(found), weight, weight + noise(doc_id, seed)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(i, w, b) for i, w, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 5)], schema=schema)

    return runs.mapInArrow(work, "doc_id long, n_words long, n_features long, weight long, score long")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """`rows` with place: 1, 2, 3... in the given order over the whole table.

    Rows are sorted in ranges and kept, rows of each range are counted, and a row's place
    is the count of the ranges before its own plus its place inside.  The driver sees one
    count a range.  Equal rows may stand in different ranges, so no key makes one long.
    """
    spread = rows.withColumn("_salt", F.rand(7))
    kept = cut(spread.repartitionByRange(*order, F.col("_salt")).sortWithinPartitions(*order, F.col("_salt")).drop("_salt"))
    at = F.monotonically_increasing_id()
    kept = kept.withColumn("_range", F.shiftright(at, 33)).withColumn("_inside", at.bitwiseAND((1 << 33) - 1))
    before, starts = 0, []
    for of, n in sorted(tuple(r) for r in kept.groupBy("_range").count().collect()):
        starts.append((of, before))
        before += n
    starts = rows.sparkSession.createDataFrame(starts, "_range long, _before long")
    return kept.join(F.broadcast(starts), "_range").withColumn("place", F.col("_before") + F.col("_inside") + 1).drop("_range", "_inside", "_before")


def resample(documents: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of `documents`.

    documents: doc_id, text; target: text; other columns are ignored.  weight is the
    floored mean gain of the document's runs of words (none: 0), score adds Gumbel noise
    drawn from the id, rank numbers the drawn documents: of those with `least_words`
    words, `percent` in a hundred with the highest scores, ties to the smaller doc_id,
    then to fewer features.  Others have a null rank.  A null text has no words; a null
    doc_id draws as an empty one and comes last among ties.  Repeated rows are drawn one
    by one, each with a rank of its own.  Whole texts and all documents count; an empty
    target weighs all documents by the smoothed shares alone, an empty table gives none.
    """
    text = F.col("text").cast("string").cast("binary").alias("text")
    runs = cut(scanned(documents.select(F.col("doc_id").cast("long").alias("id"), text), longest, buckets))
    have = counts(runs, buckets)
    want = counts(scanned(target.select(F.lit(0).cast("long").alias("id"), text), longest, buckets), buckets)
    rows = cut(weighed(runs, gains(have, want), seed))
    eligible = F.col("n_words") >= least_words
    most = rows.filter(eligible).count() * percent // 100
    order = (F.desc(eligible), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"))
    placed = numbered(rows, *order)
    rank = F.when(eligible & (F.col("place") <= most), F.col("place")).cast("long")
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
