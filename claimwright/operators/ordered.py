"""Windows in the order of a key that may hold a large part of all rows.

A window function sorts a key in one task.  Here rows are sorted by (key, order) in ranges
of about equal size, whatever the keys are; each range answers for its own rows, and what
the ranges before it hand on, one row a key and range, is carried to the rows that need it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimwright.sources.lineage import cut

_RANGE, _GROUP = "_range", "_group"


def _ranged(rows: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """`rows` in ranges by key and order, with the number of their range and the key as one value that is never null."""
    spread = rows.repartitionByRange(*key, order).withColumn(_RANGE, F.spark_partition_id())
    # kept, so that every use sees the same ranges
    return cut(spread.withColumn(_GROUP, F.struct(*[F.col(k).alias(k) for k in key])))


def _crossing(ends: DataFrame) -> DataFrame:
    """Of rows a (range, key) those of keys that go over ranges: a range begins with one such key at most and ends with one, so they are at most two a range."""
    every = Window.partitionBy(_GROUP)
    marked = ends.withColumn("_first", F.min(_RANGE).over(every)).withColumn("_last", F.max(_RANGE).over(every))
    return marked.filter(F.col("_first") < F.col("_last")).drop("_first", "_last")


def _with_carry(rows: DataFrame, ends: DataFrame, carry: Column, at: Column) -> DataFrame:
    """`rows` with _carry, what the ranges before hand on, where `at` holds."""
    carried = _crossing(ends).withColumn("_carry", carry).select(F.col(_RANGE).alias("_r"), F.col(_GROUP).alias("_g"), "_carry")
    return rows.join(F.broadcast(carried), at & (F.col(_RANGE) == F.col("_r")) & (F.col(_GROUP) == F.col("_g")), "left").drop("_r", "_g")


def with_previous(rows: DataFrame, key: tuple[str, ...], order: str, column: str, name: str) -> DataFrame:
    """`rows` with `name`: the value of `column` in the row before, in `order` within the key; null for a key's first row.

    Null keys are a key.  Rows of equal order within a key stand in some order of theirs.
    Other columns are kept.
    """
    kept = _ranged(rows, key, order)
    own = Window.partitionBy(_RANGE, _GROUP).orderBy(order)
    local = kept.withColumn("_n", F.row_number().over(own)).withColumn(name, F.lag(column).over(own))
    # a range's last row of a key, wrapped so that a null value is a value
    ends = kept.groupBy(_RANGE, _GROUP).agg(F.max_by(F.struct(F.col(column).alias("v")), order).alias("_end"))
    carry = F.lag("_end").over(Window.partitionBy(_GROUP).orderBy(_RANGE))
    met = _with_carry(local, ends, carry, F.col("_n") == 1)
    return met.withColumn(name, F.coalesce(name, F.col("_carry.v"))).drop(_RANGE, _GROUP, "_n", "_carry")


def with_running(rows: DataFrame, key: tuple[str, ...], order: str, column: str, name: str) -> DataFrame:
    """`rows` with `name`: the sum of `column` over the key's rows up to this one in `order`; nulls add nothing."""
    kept = _ranged(rows, key, order)
    own = Window.partitionBy(_RANGE, _GROUP).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = kept.groupBy(_RANGE, _GROUP).agg(F.coalesce(F.sum(column), F.lit(0)).alias("_end"))
    carry = F.sum("_end").over(Window.partitionBy(_GROUP).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1))
    met = _with_carry(kept.withColumn(name, F.sum(column).over(own)), ends, carry, F.lit(True))
    total = F.when(F.col("_carry").isNull(), F.col(name)).otherwise(F.coalesce(name, F.lit(0)) + F.col("_carry"))
    return met.withColumn(name, total).drop(_RANGE, _GROUP, "_carry")
