"""Entities: upserts by name key, aliases, similarity joins and match candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimwright.functions.names import norm_key
from claimwright.operators.search import cosine_groups
from claimwright.operators.similarity import similar_top, similarity_join  # noqa: F401  both joins of names are had from here
from claimwright.plans.registry import CANDIDATE_COSINE, CANDIDATE_TOP, CANDIDATE_TOP_ACROSS, CANDIDATE_TRIGRAM


def upsert_entities(names: DataFrame, entities: DataFrame | None = None, aliases: DataFrame | None = None, key: Column | None = None) -> DataFrame:
    """Each arriving name with norm_key, the entity's first name, first_seq, how (exact, alias, new or invalid) and entity_id.

    names: entity_table, name, seq.  entities: entity_table, name, norm_key; aliases:
    entity_table, norm_key, name (the entity's); both may have entity_id, which is else a
    hash of the type and the key of the entity's name.  A key that is stored already is
    exact; one that is an alias' is alias, and has the id of its entity; a first arrival
    is new and later ones exact.  An empty key is invalid.  The first name per key is a
    map-side minimum.
    """
    at = ["entity_table", "norm_key"]
    rows = names.withColumn("norm_key", norm_key("name") if key is None else key)
    first = rows.groupBy(*at).agg(F.min("seq").alias("first_seq"), F.min_by("name", "seq").alias("first_name"))
    rows = rows.join(first, at)
    none = F.lit(None).cast("string")
    stored = by_alias = none
    ids = [F.lit(None).cast("long")] * 2
    if entities is not None:
        own = F.col("entity_id").cast("long") if "entity_id" in entities.columns else F.xxhash64(*at)
        rows = rows.join(entities.select(*at, F.col("name").alias("_stored"), own.alias("_stored_id")), at, "left")
        stored, ids[0] = F.col("_stored"), F.col("_stored_id")
    if aliases is not None:
        own = F.col("entity_id").cast("long") if "entity_id" in aliases.columns else F.xxhash64("entity_table", norm_key("name"))
        known = aliases.select(*at, F.struct("name", own.alias("id")).alias("a")).groupBy(*at).agg(F.min("a").alias("_alias"))
        rows = rows.join(known, at, "left")
        by_alias, ids[1] = F.col("_alias.name"), F.col("_alias.id")
    how = F.when(F.col("norm_key") == "", "invalid").when(stored.isNotNull(), "exact").when(by_alias.isNotNull(), "alias")
    how = how.when(F.col("seq") == F.col("first_seq"), "new").otherwise("exact")
    canonical = F.coalesce(stored, by_alias, F.col("first_name"))
    entity_id = F.when(F.col("norm_key") != "", F.coalesce(*ids, F.xxhash64(*at)))
    return rows.select("entity_table", "name", "seq", "norm_key", "first_seq", canonical.alias("canonical_name"), how.alias("how"), entity_id.alias("entity_id"))


def entity_table_of(upserted: DataFrame) -> DataFrame:
    """The new entities in order of first arrival: id, entity_table, canonical_name, norm_key."""
    fresh = upserted.filter("how = 'new'")
    return fresh.select(F.col("entity_id").alias("id"), "entity_table", "canonical_name", "norm_key")


def aliases_of(upserted: DataFrame) -> DataFrame:
    """Every distinct name of an entity with its key; the first name is an alias too."""
    valid = upserted.filter("how <> 'invalid'")
    return valid.select("entity_id", F.col("name").alias("alias"), "norm_key").dropDuplicates(["entity_id", "alias"])


def candidates(
    queries: DataFrame, entities: DataFrame, least: float = CANDIDATE_TRIGRAM, least_cosine: float = CANDIDATE_COSINE,
    top: int = CANDIDATE_TOP, vectors: bool = False,
) -> DataFrame:
    """Per query and entity type the `top` entities whose key is equal, or similar by trigrams or vectors.

    queries: query_id, norm_key (and embedding); entities: entity_table, entity_id,
    norm_key for names and aliases alike (and embedding).  Score is the best of an
    entity's keys; equal keys come first, then by score, then by id.  Without vectors the
    match degrades to keys and trigrams.
    """
    q = queries.withColumnRenamed("norm_key", "l")
    e = entities.withColumnRenamed("norm_key", "r")
    near = similar_top(q, e.select(F.col("entity_table").alias("group"), F.col("entity_id").alias("item_id"), "r"), top, least)
    met = q.join(near, "l").select("query_id", F.col("group").alias("entity_table"), F.col("item_id").alias("entity_id"), "norm_match", "score")
    if vectors:
        by_vector = cosine_groups(q.select("query_id", "embedding"), e.select(F.col("entity_table").alias("group"), F.col("entity_id").alias("item_id"), "embedding"), top, least_cosine)
        met = met.unionByName(by_vector.select("query_id", F.col("group").alias("entity_table"), F.col("item_id").alias("entity_id"), F.lit(False).alias("norm_match"), "score"))
    best = met.groupBy("query_id", "entity_table", "entity_id").agg(F.max("norm_match").alias("norm_match"), F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id", "entity_table").orderBy(F.desc("norm_match"), F.desc("score"), "entity_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= top).withColumn("score", F.round("score", 4))


def candidates_across(queries: DataFrame, entities: DataFrame, top: int = CANDIDATE_TOP_ACROSS, **options) -> DataFrame:
    """The `top` of each type, ranked again over all types."""
    per_type = candidates(queries, entities, top=top, **options)
    again = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("norm_match"), F.desc("score"), "entity_table", "entity_id"))
    return per_type.withColumn("rank", again)


def lookup(names: DataFrame, entities: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Each (name_id, name, hint) resolved to one entity of exactly that name: the hinted type first, then `order`.

    Of the entities of a name and type only the one of the least id can be wanted, so a
    name that many entities share meets the asked ones as one row.
    """
    place = F.array_position(F.array(*map(F.lit, order)), F.col("entity_table"))
    # a struct, as a null id goes first
    heads = entities.groupBy(F.col("canonical_name").alias("name"), "entity_table").agg(F.min(F.struct("entity_id")).alias("_id"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("entity_table").isNull().alias("untyped"), place.alias("place"), F.col("_id.entity_id").alias("entity_id"), "entity_table"))).alias("_heads")
    met = names.join(heads.groupBy("name").agg(listed), "name")
    hinted = F.filter("_heads", lambda x: x["entity_table"] == F.coalesce(F.col("hint"), F.lit("")))
    met = met.withColumn("_hinted", F.size(hinted) > 0).withColumn("_head", F.when(F.size(hinted) > 0, hinted[0]).otherwise(F.col("_heads")[0])).drop("_heads")
    rank = F.row_number().over(Window.partitionBy("name_id").orderBy(F.desc("_hinted"), "_head"))
    return met.withColumn("_rank", rank).filter("_rank = 1").select("name", *[c for c in names.columns if c != "name"], "_head.entity_table", "_head.entity_id")
