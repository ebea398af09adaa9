"""Grounding of extracted entities and relations in their document, and their merging."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwright.functions.names import ground_norm, norm_key, suffix_stripped
from claimwright.operators.search import _blocks

#: Names of one automaton.
NAMES_PER_BLOCK = 1 << 17


def _inside(body: Column, norm: Column) -> Column:
    return F.coalesce((norm != "") & F.contains(body, norm), F.lit(False))


def grounded(entities: DataFrame, documents: DataFrame) -> DataFrame:
    """Entities whose name, name without a contract suffix, or surface form stands in their document's text.

    entities: document_id, canonical_name, mention_surface; documents: document_id, body.
    An equi-join on the document: no entity meets another's text.
    """
    bodies = documents.select("document_id", ground_norm("body").alias("_body"))
    met = entities.join(bodies, "document_id")
    kept = _inside(F.col("_body"), ground_norm("canonical_name")) | _inside(F.col("_body"), ground_norm("mention_surface"))
    kept = kept | _inside(F.col("_body"), ground_norm(F.coalesce(suffix_stripped("canonical_name"), F.lit(""))))
    return met.filter(kept).drop("_body")


def _automaton(names: pa.Table) -> ahocorasick.Automaton:
    """All names of a block in one automaton; a name leads to the places of its ids."""
    found = ahocorasick.Automaton()
    places: dict[str, list[int]] = {}
    for k, name in enumerate(names.column("_name").to_pylist()):
        places.setdefault(name, []).append(k)
    for name, at in places.items():
        found.add_word(name, at)
    found.make_automaton()
    return found


def grounded_anywhere(names: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, name_id) of every name that stands in a document's text: many names against all documents.

    names: name_id, name; documents: document_id, body.  The names of a block, which is
    bounded in rows and bytes, form one automaton, and a text is read once a block
    whatever the number of names.  Names and texts are compared as `ground_norm` has
    them; empty ones are nowhere.  Repeated rows are each answered.
    """
    asked = names.select("name_id", ground_norm("name").alias("_name")).filter("_name <> ''")
    bodies = documents.select("document_id", ground_norm("body").alias("_body")).filter("_body <> ''")
    schema = f"document_id {bodies.schema['document_id'].dataType.simpleString()}, name_id {asked.schema['name_id'].dataType.simpleString()}"

    def met(block: pa.Table) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton, ids = _automaton(block), block.column("name_id").combine_chunks()
            for batch in batches:
                for row in range(0, len(batch), 512):
                    part = batch.slice(row, 512)
                    hits = [sorted({k for _, at in automaton.iter(body) for k in at}) for body in part.column(1).to_pylist()]
                    documents_hit = np.repeat(np.arange(len(part)), [len(h) for h in hits])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(documents_hit)), ids.take(pa.array([k for h in hits for k in h], pa.int64()))], names=["document_id", "name_id"])

        return bodies.mapInArrow(work, schema)

    blocks = [b for b in (names.toArrow() for names in _blocks(asked, "name_id", NAMES_PER_BLOCK)) if len(b)]
    return reduce(DataFrame.union, [met(b) for b in blocks]) if blocks else documents.sparkSession.createDataFrame([], schema)


def extracted(entities: DataFrame, relations: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of extractions as they go on: grounded in their text, merged by name, and relations whose ends stand in the text.

    Relations are held against the text, not against the entities that are left, so that
    a relation may name what no entity is.  Entities without a name or a type go.
    """
    named = entities.filter((F.coalesce("canonical_name", F.lit("")) != "") & (F.coalesce("proposed_type", F.lit("")) != ""))
    return merged(grounded(named, documents)), grounded_relations(relations, documents)


def grounded_relations(relations: DataFrame, documents: DataFrame) -> DataFrame:
    """Relations whose ends both stand in the text; of compliance only the from end must."""
    bodies = documents.select("document_id", ground_norm("body").alias("_body"))
    met = relations.join(bodies, "document_id")
    left = _inside(F.col("_body"), ground_norm("from"))
    right = (F.col("proposed_junction") == "compliance") | _inside(F.col("_body"), ground_norm("to"))
    return met.filter(left & right & (F.coalesce("to", F.lit("")) != "")).drop("_body")


def merged(entities: DataFrame) -> DataFrame:
    """One entity per (document, type, name key): first name, first non-empty surface and, per attribute, the first non-empty value.

    entities: document_id, idx, proposed_type, canonical_name, mention_surface,
    attributes map, confidence, evidence.
    """
    rows = entities.withColumn("norm_key", norm_key("canonical_name"))
    key = ["document_id", "proposed_type", "norm_key"]
    heads = rows.groupBy(*key).agg(
        F.min("idx").alias("idx"), F.min_by("canonical_name", "idx").alias("canonical_name"), F.min_by("evidence", "idx").alias("evidence"),
        F.min_by("mention_surface", F.when(F.coalesce("mention_surface", F.lit("")) != "", F.col("idx"))).alias("mention_surface"),
        F.max("confidence").alias("confidence"),
    )
    cells = rows.select(*key, "idx", F.explode("attributes").alias("name", "value")).filter("value IS NOT NULL AND value <> ''")
    firsts = cells.groupBy(*key, "name").agg(F.min_by("value", "idx").alias("value"))
    maps = firsts.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("attributes"))
    return heads.join(maps, key, "left").withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>")))


def non_empty(attributes: Column | str) -> Column:
    """A map without null and empty values."""
    return F.map_filter(attributes, lambda _, v: v.isNotNull() & (v != ""))
