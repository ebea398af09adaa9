"""Routing of extracted entities and relations, weak relations, staging and promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwright.plans.registry import ENTITY_COLUMNS, JUNCTIONS, LOW_CONFIDENCE, WEAK_PROMOTION_N, Registry


def route_attributes(attributes: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Extracted attributes with route and reason: claim, staging or dropped.

    attributes: proposed_type, column_name, value, confidence.  An empty value is
    dropped; an unknown type or column and a low confidence go to staging.
    """
    columns = (registry or Registry()).entities
    known = F.lit(False)
    for table, names in columns.items():
        known = known | ((F.col("proposed_type") == table) & F.col("column_name").isin(*names))
    reason = (
        F.when(F.col("value").isNull() | (F.col("value") == ""), "empty_value")
        .when(~F.coalesce("proposed_type", F.lit("")).isin(*columns), "non_starter_type")
        .when(~known, "unknown_column")
        .when(F.coalesce("confidence", F.lit(0.0)) < LOW_CONFIDENCE, "low_confidence")
    )
    route = F.when(reason.isNull(), "claim").when(reason == "empty_value", "dropped").otherwise("staging")
    return attributes.withColumn("route", route).withColumn("reason", reason)


def proposals_of(routed: DataFrame) -> DataFrame:
    """Schema proposals that follow from staged attributes: new tables and new columns, with how many rows ask for each."""
    kind = F.when(F.col("reason") == "non_starter_type", "new_table").when(F.col("reason") == "unknown_column", "new_column")
    column = F.when(F.col("reason") == "unknown_column", F.col("column_name"))
    asked = routed.withColumn("kind", kind).filter("kind IS NOT NULL").withColumn("column", column)
    return asked.groupBy("kind", F.col("proposed_type").alias("target_table"), "column").agg(F.count("*").alias("asked"))


def route_relations(relations: DataFrame) -> DataFrame:
    """Extracted relations with route and reason, decided before any edge is made.

    relations: junction, from_type, from_id, to_type, to_id (null where unresolved),
    to_text, confidence, how (of the edge's arrival, as first_wins gives it; may be null).
    Routes: edge, weak, staging, dropped.
    """
    expected_from, expected_to = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, ((_, a), (_, b), _, _) in JUNCTIONS.items():
        expected_from = F.when(F.col("junction") == name, a).otherwise(expected_from)
        expected_to = F.when(F.col("junction") == name, b).otherwise(expected_to)
    pair = lambda x, y: F.array_sort(F.array_distinct(F.array(x, y)))
    compliance = F.col("junction") == "compliance"
    unknown = ~F.coalesce("junction", F.lit("")).isin(*JUNCTIONS)
    unresolved = F.col("from_id").isNull() | F.when(compliance, F.coalesce(F.trim("to_text"), F.lit("")) == "").otherwise(F.col("to_id").isNull())
    mismatch = F.when(compliance, F.col("from_type") != "contract").otherwise(pair(F.col("from_type"), F.col("to_type")) != pair(expected_from, expected_to))
    itself = (F.col("junction") == "product_variant") & (F.col("from_id") == F.col("to_id"))
    low = F.coalesce("confidence", F.lit(0.0)) < LOW_CONFIDENCE
    reason = (
        F.when(unknown, "unknown_junction").when(unresolved, "unresolved_endpoint").when(mismatch, "endpoint_type_mismatch")
        .when(itself, "self_variant").when(F.col("how") == "cardinality_violation", "cardinality_violation").when(low, "low_confidence")
    )
    route = (
        F.when(reason.isNull(), "edge").when(reason == "unresolved_endpoint", "dropped").when(reason == "endpoint_type_mismatch", F.when(compliance, "dropped").otherwise("weak"))
        .when(reason == "cardinality_violation", "staging").otherwise("weak")
    )
    return relations.withColumn("route", route).withColumn("reason", reason)


def weak_rows(routed: DataFrame) -> DataFrame:
    """The weak relations among routed ones; their confidence is at most the threshold, an unknown end is kept as text."""
    rows = routed.filter("route = 'weak'")
    text = F.when(F.col("to_id").isNull() | (F.col("reason") == "unknown_junction"), F.concat_ws(" -> ", F.coalesce("from_text", F.lit("")), F.coalesce("to_text", F.lit(""))))
    return rows.select(
        F.col("from_type").alias("subject_table"), F.col("from_id").alias("subject_id"), F.col("junction").alias("predicate"),
        F.col("to_type").alias("object_table"), F.col("to_id").alias("object_id"), text.alias("object_text"), "document_id", "evidence",
        F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(LOW_CONFIDENCE)).alias("confidence"), F.lit(None).cast("string").alias("promoted_to"),
    )


def route_weak(weak: DataFrame, subjects: DataFrame, objects: DataFrame) -> DataFrame:
    """Weak extractions (weak_id, predicate, object) whose subject resolves; the object's id where it resolves, else its text.

    subjects and objects: name_id (the weak_id), entity_table, entity_id, as lookup gives.
    """
    s = subjects.select(F.col("name_id").alias("weak_id"), F.col("entity_table").alias("subject_table"), F.col("entity_id").alias("subject_id"))
    o = objects.select(F.col("name_id").alias("weak_id"), F.col("entity_table").alias("object_table"), F.col("entity_id").alias("object_id"))
    met = weak.join(s, "weak_id").join(o, "weak_id", "left")
    return met.withColumn("object_text", F.when(F.col("object_id").isNull(), F.col("object"))).drop("object")


def outcomes(routed: DataFrame) -> DataFrame:
    """How many rows each route and reason got."""
    return routed.groupBy("route", F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


def weak_matrix(weak: DataFrame) -> DataFrame:
    """(subject_table, predicate, object_table or '(text)', n)."""
    return weak.groupBy("subject_table", "predicate", F.coalesce("object_table", F.lit("(text)")).alias("object_table")).agg(F.count("*").alias("n"))


def weak_summary(weak: DataFrame) -> DataFrame:
    """(predicate, n) of the relations not yet promoted."""
    return weak.filter("promoted_to IS NULL").groupBy("predicate").agg(F.count("*").alias("n"))


def promotion(predicate: Column) -> list[Column]:
    """The proposal that promotes a predicate by hand to a table of its own, which asks for a manual dry run."""
    ddl = F.concat(F.lit("CREATE TABLE "), predicate, F.lit(" (id INTEGER PRIMARY KEY, created_at TEXT NOT NULL)"))
    return [
        F.lit("new_table").alias("kind"), predicate.alias("target_table"), ddl.alias("proposed_ddl"),
        F.concat(F.lit("manual promotion from weak relations: "), predicate).alias("rationale"), F.lit(True).alias("requires_manual_dry_run"), F.lit("pending").alias("status"),
    ]


def promotable(weak: DataFrame, proposals: DataFrame | None = None, least: int = WEAK_PROMOTION_N) -> DataFrame:
    """Unpromoted predicates seen `least` times or more that no pending or approved proposal names."""
    counted = weak.filter("promoted_to IS NULL").groupBy("predicate").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    if proposals is None:
        return counted
    named = proposals.filter("status IN ('pending', 'approved')").select(F.col("target_table").alias("predicate"))
    return counted.join(named, "predicate", "left_anti")


def staged_loser(loser: Column, winner: Column) -> Column:
    """The JSON that a relation beaten within its document is staged with."""
    return F.to_json(F.struct(F.lit("in_document_alternative").alias("reason"), loser.alias("loser"), winner.alias("winner")))


def match_summary(reason: Column, candidates: Column | None = None, detail: Column | None = None) -> Column:
    """The JSON that tells why a row was staged; sections without content are left out."""
    fields = [reason.alias("reason")]
    fields += [candidates.alias("candidates")] if candidates is not None else []
    fields += [detail.alias("detail")] if detail is not None else []
    return F.to_json(F.struct(*fields))


def latest_decision(log: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """The newest state of each item in an append-only decision log."""
    rest = [c for c in log.columns if c != key]
    merged = log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_l"))
    return merged.select(key, *[F.col(f"_l.{c}").alias(c) for c in rest])


def decide(log: DataFrame, decisions: DataFrame, key: str = "proposal_id") -> DataFrame:
    """Decisions with accepted: only an item that is pending may be decided (a second decision conflicts)."""
    now = latest_decision(log, key).select(key, F.col("status").alias("_now"))
    return decisions.join(now, key, "left").withColumn("accepted", F.coalesce(F.col("_now") == "pending", F.lit(False))).drop("_now")


ENTITY_ORDER = tuple(ENTITY_COLUMNS)
