"""Mixing sources to target weights with DataFrame operations only.

Every document gets a random key (a digest of its id and text); each source is sorted by key in
ranges; word counts are summed by range, then within ranges, so that each document knows
how many words of its source come before it; each source is cut at its exact budget.  A
budget above the source's size takes whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimwright.llm.scratch import cut

#: Weights given in turn to the sources in code point order, null last.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and the most times a source may be repeated.
SHARE = 1.5
MOST_EPOCHS = 2.0
#: Rows that a key range of all sources together holds, about; ranges split 256-fold by level.
ROWS_PER_RANGE = 1000

WORD = r"[^\x20\x09-\x0D]+"


def budgets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """of, source, source_size, target: each source's words in the mix.

    sizes: one row per source with of (a name that is never null), source and source_size.  Targets follow the weights;
    one that exceeds `most` times its source's size stops there and the excess is shared
    anew by weight.  The fixed point is reached at once: sources in order of size by
    weight, and the longest prefix of them stops at its cap.  If all stop, the mix is
    smaller than asked.  An empty source has target 0.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    weighed = weighed.withColumn("rank", F.row_number().over(by_ratio))
    every = Window.partitionBy()
    total, weight = F.sum("source_size").over(every), F.sum("weight").over(every)
    capped = F.coalesce(F.sum("source_size").over(before), F.lit(0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # the level if exactly the sources before this one stop at their caps
    level = (F.lit(share) * total - F.lit(most) * capped[0]) / (weight - capped[1])
    leveled = weighed.withColumn("level", level).withColumn("over", F.col("level") * F.col("weight") > F.lit(most) * F.col("source_size"))
    final = leveled.withColumn("final", F.min(F.when(~F.col("over"), F.struct("rank", "level"))).over(every)["level"])
    target = F.when(F.col("over") | F.col("final").isNull(), F.lit(most) * F.col("source_size")).otherwise(F.col("final") * F.col("weight"))
    return final.select("of", "source", "source_size", target.cast("double").alias("target"))


def key(doc_id: str = "doc_id", text: str = "text", seed: str = "mix") -> Column:
    """A digest of id and text, so that documents without an id, or with the same one, have keys of their own."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def mix(documents: DataFrame, seed: str = "mix", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of `documents`.

    documents: doc_id, text, source; other columns are ignored.  size counts the runs of
    non-space characters (null text: 0).  taken is the number of the document's words in
    the mix, repeats counted: whole epochs, then the documents in key order up to the
    budget, the last one in part.  A source's taken words sum to the floor of its target
    and no document exceeds twice its size.  Equal rows stand next to each other in the
    order, so reruns agree; the number of ranges doesn't change the result.  A null
    source is a source, the last one; an empty table gives an empty result.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = documents.select("doc_id", "source", words.alias("size"), key("doc_id", "text", seed).alias("key"))
    rows = cut(rows.withColumn("of", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))
    levels, every = 1, rows.count()
    while 256**levels * rows_per_range < every:
        levels += 1
    spans = [F.substring("key", 1, 2 * level).alias(f"span{level}") for level in range(levels + 1)]
    leaf = f"span{levels}"
    ranges = cut(rows.groupBy("of", "source", *spans).agg(F.sum("size").alias("words")))
    goals = budgets(ranges.groupBy("of", "source").agg(F.sum("words").alias("source_size")))
    # words before a range: its elder siblings', and its ancestors' elder siblings'
    ahead = ranges.select("of", *[f"span{level}" for level in range(levels + 1)]).withColumn("ahead", F.lit(0).cast("long"))
    for level in range(1, levels + 1):
        mine = ranges.groupBy("of", f"span{level - 1}", f"span{level}").agg(F.sum("words").alias("words"))
        elder = Window.partitionBy("of", f"span{level - 1}").orderBy(f"span{level}").rowsBetween(Window.unboundedPreceding, -1)
        mine = mine.select("of", f"span{level}", F.coalesce(F.sum("words").over(elder), F.lit(0)).alias("elder"))
        ahead = ahead.join(mine, ["of", f"span{level}"]).withColumn("ahead", F.col("ahead") + F.col("elder")).drop("elder")
    ahead = ahead.join(goals.withColumnRenamed("of", "of_"), F.col("of") == F.col("of_")).select("of", leaf, "ahead", "source_size", "target")
    placed = rows.withColumn(leaf, F.substring("key", 1, 2 * levels)).join(ahead, ["of", leaf])
    inside = Window.partitionBy("of", leaf).orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    placed = placed.withColumn("before", before).withColumn("epochs", epochs)
    rest = F.floor("target") - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before")))
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))
