"""The store's named views: counts, lists, details, conflicts, orphans and logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimwright.plans.registry import HUMAN_DOCUMENT_ID, LIST_LIMIT, WEAK_LIMIT


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of every table; an empty table counts 0."""
    each = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, each)


def listing(table: DataFrame, name: str = "canonical_name", contains: str | None = None, limit: int = LIST_LIMIT) -> DataFrame:
    """The first rows by name, of those whose name contains a string in any case."""
    rows = table if contains is None else table.filter(F.contains(F.lower(name), F.lit(contains.lower())))
    return rows.orderBy(name, *[c for c in table.columns if c != name and not c.startswith("_")][:1]).limit(limit)


def documents_list(documents: DataFrame) -> DataFrame:
    """All documents but the human one, newest first."""
    return documents.filter(F.col("id") != HUMAN_DOCUMENT_ID).orderBy(F.desc("ingested_at"), "id")


def upsert_documents(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """One row per slug: the latest fields under the first id."""
    both = stored.unionByName(arriving)
    rest = [c for c in both.columns if c not in ("slug", "id")]
    merged = both.groupBy("slug").agg(F.min("id").alias("id"), F.max_by(F.struct(*rest), F.struct("ingested_at", "id")).alias("_l"))
    return merged.select("id", "slug", *[F.col(f"_l.{c}").alias(c) for c in rest])


def open_items(log: DataFrame, status: str = "status", value: str = "pending", order: str = "seq") -> DataFrame:
    return log.filter(F.col(status) == value).orderBy(F.desc(order))


def staging_list(staging: DataFrame, documents: DataFrame, status: str = "pending") -> DataFrame:
    """Staged rows of a status with their document's slug; rows of no known document are left out."""
    return staging.filter(F.col("status") == status).join(documents.select(F.col("id").alias("document_id"), F.col("slug").alias("doc_slug")), "document_id")


def conflict_members(groups: DataFrame, claims: DataFrame) -> DataFrame:
    """Open conflict groups with all their claims, whatever their kind: the log is keyed by the group."""
    return groups.filter("resolved_at IS NULL").join(claims, "conflict_group").orderBy("conflict_group", "document_id")


def claim_history(claims: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Claims about edges with the edge and the name of the entity at its end: edge_id, then (other_table, other_id)."""
    named = entities.select(F.col("entity_table").alias("other_table"), F.col("entity_id").alias("other_id"), F.col("canonical_name").alias("other_name"))
    return claims.join(edges, "edge_id").join(named, ["other_table", "other_id"])


def orphans(entities: DataFrame, references: list[tuple[DataFrame, str]], key: str) -> DataFrame:
    """Entities that no reference names: one anti join each, so that `a or b` stays an equi-join."""
    return reduce(lambda left, r: left.join(r[0].select(F.col(r[1]).alias(key)), key, "left_anti"), references, entities)


def polymorphic_names(rows: DataFrame, entities: DataFrame, table: str, key: str, out: str) -> DataFrame:
    """`rows` with the canonical name of an entity that is named by (type, id): one left join for all types."""
    names = entities.select(F.col("entity_table").alias(table), F.col("entity_id").alias(key), F.col("canonical_name").alias(out))
    return rows.join(names, [table, key], "left")


def weak_list(weak: DataFrame, entities: DataFrame, documents: DataFrame, limit: int = WEAK_LIMIT) -> DataFrame:
    """Weak relations with both names and the document's slug, the most confident first."""
    named = polymorphic_names(weak, entities, "subject_table", "subject_id", "subject_name")
    named = polymorphic_names(named, entities, "object_table", "object_id", "object_name")
    met = named.join(documents.select(F.col("id").alias("document_id"), "slug"), "document_id", "left")
    return met.withColumn("object_name", F.coalesce("object_name", "object_text")).orderBy(F.desc("confidence"), "predicate", "subject_id").limit(limit)


def with_documents(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Claims or mentions with doc_slug, the slug of their document; rows of no known document are left out."""
    return rows.join(documents.select(F.col("id").alias("document_id"), F.col("slug").alias("doc_slug")), "document_id")


def entity_detail(entity_table: str, entity_id: int, entities: DataFrame, aliases: DataFrame, claims: DataFrame, relations: DataFrame, mentions: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    """Everything about one entity: itself, aliases, claims with their documents, relations and mentions."""
    mine = lambda df: df.filter((F.col("entity_table") == entity_table) & (F.col("entity_id") == entity_id))
    return {
        "entity": mine(entities),
        "aliases": mine(aliases).orderBy("alias"),
        "claims": with_documents(mine(claims), documents).orderBy("column_name", F.desc("confidence"), "document_id"),
        "relations": mine(relations).orderBy("relation", "direction", "other_name"),
        "mentions": with_documents(mine(mentions), documents).orderBy("document_id"),
    }


def dangling(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key names no parent: the foreign-key audit."""
    return rows.filter(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")
