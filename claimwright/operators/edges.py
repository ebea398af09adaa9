"""Typed edges: cardinality, in-document winners, variant direction, hierarchies and views."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimwright.plans.registry import JUNCTIONS
from claimwright.sources.lineage import cut


def first_wins(edges: DataFrame, child: str, parent: str, order: str = "seq") -> DataFrame:
    """Edges with how (new, existing or cardinality_violation) and the first arrival's parent.

    A child has one parent, that of its first edge; another edge to the same parent is
    existing.  The first edge is a map-side minimum joined back.
    """
    first = edges.groupBy(child).agg(F.min(F.struct(F.col(order).alias("o"), F.col(parent).alias("p"))).alias("_f"))
    first = first.select(child, F.col("_f.o").alias("first_order"), F.col("_f.p").alias("first_parent"))
    met = edges.join(first, child)
    how = F.when(F.col(order) == F.col("first_order"), "new").when(F.col(parent) == F.col("first_parent"), "existing").otherwise("cardinality_violation")
    return met.withColumn("how", how)


def many_to_many(edges: DataFrame, ends: list[str], order: str = "seq") -> DataFrame:
    """One row per distinct ends (nulls equal): the first arrival's, with the number of arrivals."""
    rest = [c for c in edges.columns if c not in ends]
    merged = edges.groupBy(*ends).agg(F.min_by(F.struct(*rest), order).alias("_f"), F.count("*").alias("arrivals"))
    return merged.select(*ends, *[F.col(f"_f.{c}").alias(c) for c in rest], "arrivals")


def find_or_create_employment(edges: DataFrame, order: str = "seq") -> DataFrame:
    """Employments are one per person, organization and start date; a null start date equals a null one."""
    return many_to_many(edges, ["person_id", "organization_id", "start_date"], order)


def cardinality_key(junction: Column, left: Column, right: Column, start_date: Column) -> Column:
    """The key within which a document may state one edge; null where an end is unresolved."""
    text = lambda *parts: F.concat_ws("|", junction, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    both = left.isNotNull() & right.isNotNull()
    return (
        F.when(both & (junction == "employment"), text(left, right, start_date))
        .when(both & (junction == "manufacturing"), text(left))
        .when(both & junction.isin("org_hierarchy", "product_variant"), text(right))
        .when(both & junction.isin("governance", "compliance"), text(left, right))
    )


def in_document_winners(relations: DataFrame, keys: list[str], confidence: str = "confidence", index: str = "idx") -> DataFrame:
    """Relations with role winner or loser, and the winner's index, per key; a null key bypasses as a winner.

    The most confident wins, the first among equals.
    """
    keyed = relations.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    best = keyed.groupBy(*keys).agg(F.max(F.struct(F.col(confidence), -F.col(index))).alias("_b"))
    best = best.select(*keys, (-F.col(f"_b.col2")).alias("winner_idx"))
    met = keyed.join(best, keys).withColumn("role", F.when(F.col(index) == F.col("winner_idx"), "winner").otherwise("loser"))
    free = relations.filter(" OR ".join(f"{k} IS NULL" for k in keys)).withColumn("winner_idx", F.col(index)).withColumn("role", F.lit("winner"))
    return met.unionByName(free)


def variant_losers(edges: list[tuple[int, int, int, float]]) -> dict[int, int]:
    """index -> the index that beat it, among one document's (index, parent, variant, confidence).

    A node that is both a parent and a variant keeps the side with the greater sum of
    confidences to nine places, the parent side if equal.  Nodes go in order of id, and an edge dropped
    for one node counts no more for the next.
    """
    touching: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
    for edge in edges:
        touching[edge[1]][0].append(edge)
        touching[edge[2]][1].append(edge)
    beaten: dict[int, int] = {}
    for _, both in sorted((node, both) for node, both in touching.items() if all(both)):
        as_parent, as_variant = ([e for e in side if e[0] not in beaten] for side in both)
        if as_parent and as_variant:
            stays_parent = round(sum(e[3] for e in as_parent), 9) >= round(sum(e[3] for e in as_variant), 9)
            winners, losers = (as_parent, as_variant) if stays_parent else (as_variant, as_parent)
            best = min(winners, key=lambda e: (-e[3], e[0]))[0]
            beaten.update((e[0], best) for e in losers)
    return beaten


def variant_direction(edges: DataFrame) -> DataFrame:
    """(document_id, idx, kept, winner_idx) of (document_id, idx, parent_id, variant_id, confidence).

    Resolution is sequential over a document's conflicting nodes; documents stream
    through in order, so a task holds one document's edges at a time.
    """

    def decided(document: int, rows: list[tuple]) -> list[tuple]:
        beaten = variant_losers(rows)
        return [(document, e[0], e[0] not in beaten, beaten.get(e[0])) for e in rows]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = None, []
        for batch in batches:
            out: list[tuple] = []
            for document, *edge in batch.itertuples(index=False, name=None):
                if document != held:
                    out += decided(held, rows)
                    held, rows = document, []
                rows.append(tuple(edge))
            yield frame(out)
        yield frame(decided(held, rows))

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["document_id", "idx", "kept", "winner_idx"]).astype({"winner_idx": "Int64"})

    # only documents with a node on both sides need the sequential rule
    nodes = edges.select("document_id", F.col("parent_id").alias("node"), F.lit(1).alias("p"), F.lit(0).alias("v"))
    nodes = nodes.union(edges.select("document_id", "variant_id", F.lit(0), F.lit(1)))
    fought = nodes.groupBy("document_id", "node").agg(F.max("p").alias("p"), F.max("v").alias("v")).filter("p = 1 AND v = 1").select("document_id").distinct()
    hard = edges.select("document_id", "idx", "parent_id", "variant_id", "confidence").join(fought, "document_id", "left_semi")
    hard = hard.repartition("document_id").sortWithinPartitions("document_id", "idx").mapInPandas(work, "document_id long, idx long, kept boolean, winner_idx long")
    easy = edges.join(fought, "document_id", "left_anti").select("document_id", "idx", F.lit(True).alias("kept"), F.lit(None).cast("long").alias("winner_idx"))
    return hard.union(easy)


def closure(edges: DataFrame, child: str = "child_id", parent: str = "parent_id") -> DataFrame:
    """(node, ancestor, depth): all ancestors with their least depth, of any depth; nodes of a cycle are their own ancestors.

    Each round joins the paths so far with themselves, so depth d takes log2(d) joins; it
    ends when a round finds no new pair.
    """
    paths = cut(edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth")).distinct())
    known = paths.count()
    while True:
        further = paths.alias("a").join(paths.alias("b"), F.col("a.ancestor") == F.col("b.node"))
        longer = further.select(F.col("a.node").alias("node"), F.col("b.ancestor").alias("ancestor"), (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        paths = cut(paths.union(longer).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))
        now = paths.count()
        if now == known:
            return paths
        known = now


def relation_view(edges: dict[str, DataFrame], entities: DataFrame) -> DataFrame:
    """All edges in one uniform shape, seen from both ends: entity_table, entity_id, relation, direction, other_table, other_id, other_name.

    edges: junction -> its table (columns named by the registry); entities: entity_table,
    entity_id, canonical_name.
    """
    shapes = None
    for junction, table in edges.items():
        (left, left_type), (right, right_type), _, _ = JUNCTIONS[junction]
        one = table.select(
            F.lit(junction).alias("relation"), F.lit(left_type).alias("lt"), F.col(left).cast("bigint").alias("li"),
            F.lit(right_type).cast("string").alias("rt"), (F.col(right).cast("bigint") if right_type else F.lit(None).cast("bigint")).alias("ri"),
            (F.lit(None).cast("string") if right_type else F.col(right)).alias("rtext"),
        )
        shapes = one if shapes is None else shapes.unionByName(one)
    out = shapes.select(F.col("lt").alias("entity_table"), F.col("li").alias("entity_id"), "relation", F.lit("out").alias("direction"), F.col("rt").alias("other_table"), F.col("ri").alias("other_id"), "rtext")
    back = shapes.filter("rt IS NOT NULL").select(F.col("rt").alias("entity_table"), F.col("ri").alias("entity_id"), "relation", F.lit("in").alias("direction"), F.col("lt").alias("other_table"), F.col("li").alias("other_id"), "rtext")
    names = entities.select(F.col("entity_table").alias("other_table"), F.col("entity_id").alias("other_id"), F.col("canonical_name").alias("_name"))
    met = out.union(back).join(names, ["other_table", "other_id"], "left")
    return met.select("entity_table", "entity_id", "relation", "direction", "other_table", "other_id", F.coalesce("_name", "rtext").alias("other_name"))
