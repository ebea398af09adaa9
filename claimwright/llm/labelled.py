"""Bounded samples of labelled documents to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 30


def remainder(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo `modulus`; null for a null doc_id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(modulus))


#: Values of a label that are learned: the most frequent ones, by name among equals.
MOST_VALUES = 256


#: How many more than wanted are drawn before the exact cut.
SPARE = 1.25


def chosen(rows: DataFrame, label: str, most: dict | int, seed: int) -> tuple[DataFrame, dict]:
    """(rows of about SPARE times `most` ids of each label by hash of doc_id, the count of each label's rows).

    The share of a label's ids that is kept is fixed from their approximate number, so
    that choosing needs no sort and a hash range decides row by row; `one_each` then cuts
    exactly.  A label column with more than MOST_VALUES values, as a dirty one has, gives
    its most frequent ones.
    """
    found = rows.groupBy(label).agg(F.count("*").alias("n"), F.approx_count_distinct("doc_id", 0.02).alias("ids"))
    found = {r[0]: r for r in found.orderBy(F.desc("n"), label).limit(MOST_VALUES).collect()}
    limit = lambda k: most if isinstance(most, int) else most.get(k, 0)
    share = F.lit(0)
    for value, row in sorted(found.items(), key=lambda x: str(x[0])):
        share = F.when(F.col(label) == value, F.lit(min(_STEPS, int(_STEPS * SPARE * limit(value) / max(row.ids, 1))))).otherwise(share)
    return rows.filter(_draw(seed) < share), {k: r.n for k, r in found.items()}


def _draw(seed: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(_STEPS))


def one_each(rows: DataFrame, label: str, most: dict | int, seed: int) -> DataFrame:
    """(doc_id, text, label) of at most `most` ids of each label, by hash, one row an id: of repeated ids the least text counts.

    The drawn ids, which `chosen` has bounded, are cut on the driver and come back to the
    rows; only texts of repeated ids are dealt.
    """
    drawn = rows.groupBy("doc_id", label).agg(F.count("*").alias("n")).withColumn("draw", _draw(seed)).collect()
    kept: dict = {}
    for r in sorted(drawn, key=lambda r: (r.draw, r.doc_id)):
        kept.setdefault(r[1], []).append(r)
    limit = lambda k: most if isinstance(most, int) else max(1, int(most.get(k, 0)))
    ids = [(r.doc_id, r[1], r.n > 1) for k, found in kept.items() for r in found[: limit(k)]]
    kind = rows.schema[label].dataType.simpleString()
    chosen_ids = F.broadcast(rows.sparkSession.createDataFrame(ids, f"doc_id long, {label} {kind}, _repeated boolean"))
    met = rows.select("doc_id", "text", label).join(chosen_ids, ["doc_id", label])
    one = met.filter(~F.col("_repeated")).select("doc_id", "text", label)
    if not any(r[2] for r in ids):
        return one
    return one.union(met.filter("_repeated").groupBy("doc_id", label).agg(F.min("text").alias("text")).select("doc_id", "text", label))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, most: dict | int, seed: int = 11) -> tuple[DataFrame, dict]:
    """(doc_id, text, label rows; counts): at most `most` training documents of each label value, one row a document.

    Only labels whose crc32 remainder by 5 is not 0 take part; null labels and doc_ids
    don't; of repeated labels of one document the greatest counts, of its repeated rows
    the least text.  The chosen ids are bounded by `most`, so they are broadcast to the
    scan of the documents.
    """
    train = labels.filter(F.col(label).isNotNull() & (remainder(5) != 0))
    train = train.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    ids, counts = chosen(train, "label", most, seed)
    met = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    return one_each(met, "label", most, seed), counts
