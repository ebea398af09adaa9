"""Joins of ranges that overlap, without meeting all pairs of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwright.plans.registry import FALLBACK_CONFIDENCE

#: Length of a bin, about as long as most ranges are.
BIN = 64


def overlaps(left: DataFrame, right: DataFrame, key: str, bin_: int = BIN) -> DataFrame:
    """Rows of `left` beside rows of `right` of the same key whose ranges [start, end) have a place in common.

    Both have key, start and end; other columns must have names of their own, and the
    right range comes back as right_start, right_end.  A range stands in every bin that it
    touches, so ranges meet bin by bin; a pair counts in the first bin that both have, so
    it comes once.  A long text is many bins, and a key of many ranges is many tasks.  Empty
    ranges, and those without a key or an end, overlap none.
    """
    div = lambda c: F.floor(c / F.lit(bin_)).cast("long")
    usable = F.col("start") < F.col("end")
    bins = F.explode(F.sequence(div(F.col("start")), div(F.col("end") - 1)))
    a = left.filter(usable).withColumn("_bin", bins)
    b = right.filter(usable).withColumn("_bin", bins).withColumnsRenamed({"start": "right_start", "end": "right_end"})
    met = a.join(b, [key, "_bin"]).filter((F.col("start") < F.col("right_end")) & (F.col("right_start") < F.col("end")))
    return met.filter(F.col("_bin") == F.greatest(div(F.col("start")), div(F.col("right_start")))).drop("_bin")


def located(values: DataFrame, texts: DataFrame, key: str, value: str = "value", text: str = "text") -> DataFrame:
    """`values` with start and end: the bytes of the first place of each value in its key's text; null where it isn't."""
    met = values.join(texts.select(key, text), key, "left")
    place = F.instr(F.col(text), F.col(value))
    start = F.octet_length(F.substring(F.col(text), F.lit(1), place - 1)).cast("long")
    found = (place > 0) & (F.length(value) > 0)
    return met.withColumn("start", F.when(found, start)).withColumn("end", F.when(found, start + F.octet_length(value))).drop(text)


def span_confidences(tokens: DataFrame, spans: DataFrame, key: str, name: str, logprob: str = "logprob") -> DataFrame:
    """(key, name, confidence, tokens): exp of the mean log-probability of the tokens that overlap each named range.

    tokens: key, start, end, logprob; spans: key, name, start, end, null for a value that
    wasn't found.  A range that meets no token, and one that is nowhere, has the fallback.
    """
    met = overlaps(tokens.select(key, "start", "end", logprob), spans.select(key, name, "start", "end"), key)
    means = met.groupBy(key, name).agg(F.avg(logprob).alias("_mean"), F.count("*").alias("tokens"))
    every = spans.select(key, name).distinct().join(means, [key, name], "left")
    return every.select(key, name, confidence_of("_mean").alias("confidence"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def confidence_of(mean: str) -> Column:
    """exp of a mean log-probability, or the fallback."""
    return F.coalesce(F.exp(mean), F.lit(FALLBACK_CONFIDENCE))
