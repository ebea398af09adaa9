"""Evaluation: precision and recall, confusion, stability, matchers, answer and dedup scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwright.functions.names import norm_key


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1 to four places: all null if both sides are empty, 0.0 for a side that has nothing."""
    precision = F.when(tp + fp + fn == 0, None).otherwise(F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0))
    recall = F.when(tp + fp + fn == 0, None).otherwise(F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0))
    f1 = F.when(precision.isNull(), None).otherwise(F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0))
    return [F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1")]


def set_counts(gold: DataFrame, predicted: DataFrame, key: list[str], group: list[str] | None = None) -> DataFrame:
    """tp, fp, fn of two sets of distinct keys (per group): one union and one aggregation, no join."""
    group = group or []
    sides = gold.select(*key).withColumn("_g", F.lit(1)).withColumn("_p", F.lit(0)).unionByName(predicted.select(*key).withColumn("_g", F.lit(0)).withColumn("_p", F.lit(1)))
    merged = sides.groupBy(*key).agg(F.max("_g").alias("g"), F.max("_p").alias("p"))
    return merged.groupBy(*group).agg(
        F.coalesce(F.sum(F.col("g") * F.col("p")), F.lit(0)).alias("tp"),
        F.coalesce(F.sum((1 - F.col("g")) * F.col("p")), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.col("g") * (1 - F.col("p"))), F.lit(0)).alias("fn"),
    )


def set_prf(gold: DataFrame, predicted: DataFrame, key: list[str], group: list[str] | None = None) -> DataFrame:
    counts = set_counts(gold, predicted, key, group)
    return counts.select(*(group or []), "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def set_differences(gold: DataFrame, predicted: DataFrame, key: list[str]) -> DataFrame:
    """The failures: key with kind missed (gold only) or extra (predicted only)."""
    missed = gold.select(*key).distinct().join(predicted.select(*key), key, "left_anti").withColumn("kind", F.lit("missed"))
    extra = predicted.select(*key).distinct().join(gold.select(*key), key, "left_anti").withColumn("kind", F.lit("extra"))
    return missed.unionByName(extra)


def match_entities(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """tp, fp, fn and scores with alias groups.

    gold: group_id, proposed_type, names (array: canonical name and aliases); predicted:
    proposed_type, canonical_name.  A prediction hits the first group of its type that
    has its key; tp counts distinct groups hit, fp predictions that hit none, fn groups
    not hit.
    """
    keys = gold.select("group_id", "proposed_type", F.explode("names").alias("n")).select("group_id", "proposed_type", norm_key("n").alias("k")).distinct()
    first = keys.groupBy("proposed_type", "k").agg(F.min("group_id").alias("group_id"))
    found = predicted.select("proposed_type", norm_key("canonical_name").alias("k")).distinct().join(first, ["proposed_type", "k"], "left")
    hit = found.agg(F.count_distinct("group_id").alias("tp"), F.coalesce(F.sum(F.col("group_id").isNull().cast("int")), F.lit(0)).alias("fp"))
    groups = gold.agg(F.count_distinct("group_id").alias("g"))
    one = hit.join(F.broadcast(groups), how="cross").select("tp", "fp", (F.col("g") - F.col("tp")).alias("fn"))
    return one.select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def match_relations(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Scores on (junction, key of from, key of to)."""
    keyed = lambda df: df.select(F.col("proposed_junction").alias("j"), norm_key("from").alias("f"), norm_key("to").alias("t"))
    return set_prf(keyed(gold), keyed(predicted), ["j", "f", "t"])


def match_weak(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    keyed = lambda df: df.select(norm_key("subject").alias("s"), "predicate", norm_key("object").alias("o"))
    return set_prf(keyed(gold), keyed(predicted), ["s", "predicate", "o"])


def match_cells(gold: DataFrame, predicted: DataFrame, aliases: DataFrame) -> DataFrame:
    """Scores on attribute cells (proposed_type, entity key, column, value), only of cells that gold has.

    aliases: proposed_type, alias_key, canonical_key; a predicted name is first mapped to
    the gold entity that it is an alias of.
    """
    mapped = predicted.join(aliases.withColumnRenamed("alias_key", "k"), ["proposed_type", "k"], "left")
    mapped = mapped.select("proposed_type", F.coalesce("canonical_key", "k").alias("k"), "column", "value")
    in_gold = mapped.join(gold.select("proposed_type", "k", "column").distinct(), ["proposed_type", "k", "column"], "left_semi")
    return set_prf(gold, in_gold, ["proposed_type", "k", "column", "value"])


def confusion(pairs: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(cell, n) with cell as `actual->predicted`."""
    cell = F.concat(F.col(actual).cast("string"), F.lit("->"), F.col(predicted).cast("string"))
    return pairs.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))


def mean_std(runs: DataFrame, metric: str, value: str) -> DataFrame:
    """Mean and population deviation of each metric over its runs; nulls are skipped and one run has deviation 0."""
    return runs.groupBy(metric).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("runs"))


def headline(metrics: list[str]) -> Column:
    """The mean of the metrics that are there."""
    there = F.filter(F.array(*map(F.col, metrics)), lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.size(there))


def row_contains(cells: Column, wanted: Column) -> Column:
    """Whether any cell holds the wanted value once both are normalised."""
    tidy = lambda c: F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"\s+", "")
    return F.exists(cells, lambda c: F.contains(tidy(c), tidy(wanted)))


def question_scores(cases: DataFrame) -> DataFrame:
    """question_id, sql_ok, contains, slugs: the shares of wanted values and documents that an answer has; null where none is wanted.

    cases: question_id, sql_ok, cells (of all rows of the answer), wanted, found_slugs,
    wanted_slugs, all arrays of strings.
    """
    share = lambda wanted, hit: F.when(F.size(wanted) > 0, F.size(F.filter(wanted, hit)) / F.size(wanted))
    contains = share("wanted", lambda w: row_contains(F.col("cells"), w))
    return cases.select("question_id", "sql_ok", contains.alias("contains"), share("wanted_slugs", lambda s: F.array_contains("found_slugs", s)).alias("slugs"))


def answer_scores(cases: DataFrame) -> DataFrame:
    """sql success, contains and slug averages over the cases where each applies; 0.0 where none does.

    cases: sql_ok boolean, contains double or null, slugs double or null.
    """
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return cases.agg(mean(F.col("sql_ok").cast("double")).alias("sql_ok"), mean("contains").alias("contains"), mean("slugs").alias("slugs"), F.count("*").alias("cases"))


def proposal_metrics(proposals: DataFrame, staging: DataFrame, claims: DataFrame, weak: DataFrame, gold_proposals: DataFrame, gold_staging: DataFrame, gold_promoted: DataFrame, most_flips: int = 0) -> DataFrame:
    """One row a metric: what a store proposes, stages, promotes and flips against what was expected.

    proposals: kind, target_table (null is left out); staging: proposed_table,
    match_summary (JSON; a row that is none is left out, one without reason has reason '');
    claims: entity_table, entity_id, column_name, value; weak: predicate, promoted_to.
    Gold sides: kind, target_table; reason, proposed_table; predicate.  Of
    canonical_stability tp is the worst number of flips of a cell and passed whether
    `most_flips` allows it.
    """
    told = staging.filter(F.expr("try_parse_json(coalesce(match_summary, '{}'))").isNotNull())
    told = told.select(F.coalesce(F.get_json_object("match_summary", "$.reason"), F.lit("")).alias("reason"), F.coalesce("proposed_table", F.lit("")).alias("proposed_table"))
    wanted = gold_staging.select("reason", F.coalesce("proposed_table", F.lit("")).alias("proposed_table"))
    sides = {
        "schema_proposal_precision": (gold_proposals, proposals.filter("target_table IS NOT NULL"), ["kind", "target_table"]),
        "staging_replay_correctness": (wanted, told, ["reason", "proposed_table"]),
        "weak_relation_promotion_recall": (gold_promoted, weak.filter("promoted_to IS NOT NULL"), ["predicate"]),
    }
    rows = [set_prf(gold, seen, key).select(F.lit(name).alias("metric"), "tp", "fp", "fn", "precision", "recall", "f1", F.lit(None).cast("boolean").alias("passed")) for name, (gold, seen, key) in sides.items()]
    cells = claims.groupBy("entity_table", "entity_id", "column_name").agg(F.greatest(F.count_distinct("value") - 1, F.lit(0)).alias("flips"))
    worst = cells.agg(F.coalesce(F.max("flips"), F.lit(0)).alias("tp"))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("fp", "bigint"), ("fn", "bigint"), ("precision", "double"), ("recall", "double"), ("f1", "double"))]
    return union_all([*rows, worst.select(F.lit("canonical_stability").alias("metric"), "tp", *none, (F.col("tp") <= most_flips).alias("passed"))])


def dedup_pairs(pairs: DataFrame) -> DataFrame:
    """Gold name pairs judged by key equality: predicted, correct and level_ok.

    pairs: pair_id, a, b, expected (same or different), level.  Each pair is a store of
    its own, which the pair id stands for; only key equality can merge two fresh names,
    so a level that asks for an alias or a model is never met.
    """
    same = (norm_key("a") == norm_key("b")) & (norm_key("a") != "")
    judged = pairs.withColumn("predicted", F.when(same, "same").otherwise("different"))
    judged = judged.withColumn("correct", F.col("predicted") == F.col("expected"))
    return judged.withColumn("level_ok", F.when(F.col("expected") == "same", F.col("correct") & (F.col("level") == "exact")))


def accuracy(judged: DataFrame) -> DataFrame:
    share = lambda c: F.round(F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)), 4)
    return judged.agg(share("correct").alias("accuracy"), share("level_ok").alias("level_match"), F.count("*").alias("n"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
