"""Documents to claims, edges and weak relations, set by set.

Extraction is a fold per document (a model sees what earlier chunks named), so it runs
inside tasks, a document at a time.  All that follows is joins and filters over the
extractions of any number of documents at once; a document's rank gives the order of
arrival wherever that matters.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimwright.functions.names import norm_key
from claimwright.functions.text import chunks, loads_loose, parse_payload
from claimwright.operators import edges, entities, grounding, routing
from claimwright.plans.registry import CHUNK_CHARS, JUNCTIONS, LOW_CONFIDENCE, Registry
from claimwright.sources.lineage import cut

_SECTIONS = ("entities", "relations", "weak_relations")
#: Places of one document's items in the order of arrival.
_SPAN = 1 << 20


def extract(documents: DataFrame, model: Callable[[str, list[str]], str], limit: int = CHUNK_CHARS) -> DataFrame:
    """(document_id, raw, failed): one payload per document of rows (document_id, body).

    `model(chunk, known names)` gives JSON text; a chunk that fails is left out and stands
    in `failed` with its number and the error.  Later chunks are told the names found so
    far.
    """

    def one(body: str) -> tuple[str, list[dict]]:
        whole: dict[str, list] = {k: [] for k in _SECTIONS}
        known: list[str] = []
        failed: list[dict] = []
        for number, chunk in enumerate(chunks(body, limit)):
            try:
                found = loads_loose(model(chunk, known))
            except Exception as error:
                failed.append({"chunk_no": number, "error": f"{type(error).__name__}: {error}"})
                continue
            found = {"entities": found} if isinstance(found, list) else found if isinstance(found, dict) else {}
            for section in _SECTIONS:
                whole[section] += found.get(section) or []
            known += [e["canonical_name"] for e in found.get("entities") or [] if isinstance(e, dict) and e.get("canonical_name") and e["canonical_name"] not in known]
        return json.dumps(whole, ensure_ascii=False), failed

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [one(b) for b in batch["body"]]
            yield pd.DataFrame({"document_id": batch["document_id"], "raw": [x[0] for x in done], "failed": [x[1] for x in done]})

    return documents.select("document_id", "body").mapInPandas(work, "document_id long, raw string, failed array<struct<chunk_no: int, error: string>>")


def ingest(extractions: DataFrame, documents: DataFrame, known: DataFrame | None = None, aliases: DataFrame | None = None, registry: Registry | None = None) -> dict[str, DataFrame]:
    """The tables that a batch of extractions adds.

    extractions: document_id, raw (JSON); documents: document_id, body, arrival (a rank);
    known and aliases: stored entities as upsert_entities takes them.  Gives upserts,
    mentions, claims, staging, proposals, edges, existence, edge_claims, weak, losers and
    outcomes.  A name is looked up among its own document's entities, the type that the
    junction expects first.
    """
    # a file of few bytes would be few tasks of much work; the joins are on this key anyway
    extractions, documents = (d.repartition("document_id") for d in (extractions, documents))
    arrival = documents.select("document_id", "arrival")
    parsed = cut(extractions.withColumn("g", parse_payload("raw")).join(arrival, "document_id").select("document_id", "arrival", "g"))
    found = parsed.select("document_id", "arrival", F.posexplode("g.entities").alias("idx", "e")).select("document_id", "arrival", "idx", "e.*")
    kept = grounding.merged(grounding.grounded(found, documents)).join(arrival, "document_id")
    # what several tables are made of is computed once and its plan cut short
    kept = cut(kept.withColumn("seq", F.col("arrival") * _SPAN + F.col("idx")))

    starters = list((registry or Registry()).entities)
    upserts = entities.upsert_entities(kept.filter(F.col("proposed_type").isin(starters)).select(F.col("proposed_type").alias("entity_table"), F.col("canonical_name").alias("name"), "seq"), known, aliases)
    upserts = cut(upserts)
    ids = cut(kept.join(upserts.filter("how <> 'invalid'").select("seq", "entity_table", "entity_id"), "seq"))
    mentions = ids.select("document_id", "entity_table", "entity_id", F.coalesce("mention_surface", "canonical_name").alias("surface_form"))

    cells = kept.join(ids.select("seq", "entity_id"), "seq", "left")
    cells = cells.select("document_id", "proposed_type", "entity_id", "canonical_name", "confidence", "evidence", "seq", F.explode_outer("attributes").alias("column_name", "value"))
    name_cells = cells.select("document_id", "proposed_type", "entity_id", "canonical_name", "confidence", "evidence", "seq", F.lit("canonical_name").alias("column_name"), F.col("canonical_name").alias("value")).distinct()
    routed = routing.route_attributes(cells.filter("column_name IS NOT NULL").unionByName(name_cells), registry)
    claims = routed.filter("route = 'claim'").select(F.col("proposed_type").alias("entity_table"), "entity_id", "column_name", "value", "document_id", "evidence", "confidence", "seq")
    staged = routed.filter("route = 'staging'")
    staged = _with_candidates(staged, upserts, known, aliases)
    staging = staged.select("document_id", F.lit("entity").alias("kind"), "reason", F.to_json(F.struct("proposed_type", "canonical_name", "column_name", "value", "confidence", "candidates")).alias("payload"))

    relations = parsed.select("document_id", "arrival", F.posexplode("g.relations").alias("idx", "r")).select("document_id", "arrival", "idx", "r.*")
    relations = grounding.grounded_relations(relations, documents).withColumn("rel", F.col("arrival") * _SPAN + F.col("idx"))
    ends = cut(_resolved(relations, ids))
    compliance = F.col("junction") == "compliance"
    key = edges.cardinality_key(F.col("junction"), F.col("from_id"), F.when(compliance, F.xxhash64("to_text")).otherwise(F.col("to_id")), F.col("attributes")["start_date"])
    won = cut(edges.in_document_winners(ends.withColumn("key", key), ["document_id", "key"], "confidence", "rel"))
    winners, losers = won.filter("role = 'winner'"), won.filter("role = 'loser'")
    pv = F.col("junction") == "product_variant"
    turned = edges.variant_direction(winners.filter(pv & F.col("from_id").isNotNull() & F.col("to_id").isNotNull()).select("document_id", F.col("rel").alias("idx"), F.col("from_id").alias("parent_id"), F.col("to_id").alias("variant_id"), "confidence"))
    turned = cut(turned)
    beaten = turned.filter("NOT kept").select(F.col("idx").alias("rel"), F.col("winner_idx").alias("by"))
    losers = losers.select("document_id", "junction", "from_text", "to_text", "confidence", "rel", "winner_idx").unionByName(
        winners.join(beaten, "rel").select("document_id", "junction", "from_text", "to_text", "confidence", "rel", F.col("by").alias("winner_idx"))
    )
    winners = winners.join(beaten, "rel", "left_anti")
    decided = cut(routing.route_relations(_arrivals(cut(winners))))
    good = decided.filter("route = 'edge'")
    edge_id = F.xxhash64("junction", "from_id", F.coalesce("to_id", F.xxhash64("to_text")), F.when(F.col("junction") == "employment", F.col("attributes")["start_date"]))
    good = good.withColumn("edge_id", edge_id)
    existence = good.select("junction", "edge_id", "document_id", "evidence", "confidence", F.col("rel").alias("seq"))
    made = edges.many_to_many(good.select("junction", "edge_id", "from_id", "to_id", "to_text", "document_id", "evidence", "confidence", F.col("rel").alias("seq")), ["junction", "edge_id"])
    allowed = F.lit(False)
    for name, (_, _, _, columns) in JUNCTIONS.items():
        allowed = allowed | ((F.col("junction") == name) & F.col("column_name").isin(*columns)) if columns else allowed
    said = good.select("junction", "edge_id", "document_id", "evidence", "confidence", F.col("rel").alias("seq"), F.explode("attributes").alias("column_name", "value"))
    edge_claims = said.filter(allowed & F.col("value").isNotNull() & (F.col("value") != ""))

    weak = parsed.select("document_id", "arrival", F.posexplode("g.weak_relations").alias("idx", "w")).select("document_id", (F.col("arrival") * _SPAN + F.col("idx")).alias("weak_id"), "w.*")
    subject, thing = (_named(weak.select("document_id", F.col("weak_id").alias("name_id"), F.col(c).alias("name")), ids) for c in ("subject", "object"))
    told = routing.route_weak(weak.select("weak_id", "document_id", "predicate", "object", "evidence", "confidence"), subject, thing)
    shape = ["subject_table", "subject_id", "predicate", "object_table", "object_id", "object_text", "document_id", "evidence", "confidence"]
    weak_all = routing.weak_rows(decided).select(*shape).unionByName(told.select(*shape))
    conflicts = decided.filter("route = 'staging'").select("document_id", F.lit("relation").alias("kind"), "reason", F.to_json(F.struct("junction", "from_text", "to_text", "confidence")).alias("payload"))
    loser_rows = losers.select("document_id", F.lit("relation").alias("kind"), F.lit("in_document_alternative").alias("reason"), F.to_json(F.struct("junction", "from_text", "to_text", "confidence", "winner_idx")).alias("payload"))
    counted = [routing.outcomes(x) for x in (routed.select("route", "reason"), decided.select("route", "reason"))]
    return {
        "upserts": upserts, "mentions": mentions, "claims": claims, "staging": reduce(DataFrame.unionByName, [staging, conflicts, loser_rows]),
        "proposals": routing.proposals_of(routed), "edges": made, "existence": existence, "edge_claims": edge_claims, "weak": weak_all,
        "losers": losers, "outcomes": reduce(DataFrame.unionByName, counted).groupBy("route", "reason").agg(F.sum("n").alias("n")),
    }


def _with_candidates(staged: DataFrame, upserts: DataFrame, known: DataFrame | None, aliases: DataFrame | None) -> DataFrame:
    """Staged rows with the entities that their name resembles: of any type where theirs is unknown, of their own where confidence was low.

    Entities are those of this batch, the stored ones and their aliases.
    """
    here = upserts.filter("how <> 'invalid'").select("entity_table", "entity_id", "norm_key")
    for more in (known, aliases):
        if more is not None:
            own = F.col("entity_id").cast("long") if "entity_id" in more.columns else F.xxhash64("entity_table", norm_key("name"))
            here = here.union(more.select("entity_table", own.alias("entity_id"), "norm_key"))
    asked = staged.filter(F.col("reason").isin("non_starter_type", "low_confidence")).select(
        F.xxhash64("proposed_type", "canonical_name").alias("query_id"), "proposed_type", "reason", norm_key("canonical_name").alias("norm_key")
    ).distinct()
    found = entities.candidates(asked.select("query_id", "norm_key").distinct(), here.distinct())
    fits = asked.join(found, "query_id").filter((F.col("reason") != "low_confidence") | (F.col("entity_table") == F.col("proposed_type")))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "entity_table", "entity_id", "score")))
    listed = fits.groupBy("query_id", "reason").agg(F.transform(ranked, lambda x: F.struct(x.entity_table.alias("entity_table"), x.entity_id.alias("entity_id"), x.score.alias("score"))).alias("candidates"))
    return staged.withColumn("query_id", F.xxhash64("proposed_type", "canonical_name")).join(listed, ["query_id", "reason"], "left").drop("query_id")


def _named(names: DataFrame, ids: DataFrame, hint: str | None = None) -> DataFrame:
    """(name_id, entity_table, entity_id) of (document_id, name_id, name[, hint]) among the same document's entities."""
    here = ids.select(F.concat_ws("|", "document_id", "canonical_name").alias("canonical_name"), "entity_table", "entity_id")
    asked = names.select("name_id", F.concat_ws("|", "document_id", "name").alias("name"), F.col(hint).alias("hint") if hint else F.lit(None).cast("string").alias("hint"))
    return entities.lookup(asked, here, routing.ENTITY_ORDER).select("name_id", "entity_table", "entity_id")


def _resolved(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations with both ends looked up: junction, from_type, from_id, to_type, to_id and the names as text."""
    want_from, want_to = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, ((_, a), (_, b), _, _) in JUNCTIONS.items():
        want_from = F.when(F.col("proposed_junction") == name, a).otherwise(want_from)
        want_to = F.when(F.col("proposed_junction") == name, b).otherwise(want_to)
    rows = relations.withColumn("want_from", want_from).withColumn("want_to", want_to)
    left = _named(rows.select("document_id", F.col("rel").alias("name_id"), F.col("from").alias("name"), "want_from"), ids, "want_from")
    right = _named(rows.select("document_id", F.col("rel").alias("name_id"), F.col("to").alias("name"), "want_to"), ids, "want_to")
    left = left.select(F.col("name_id").alias("rel"), F.col("entity_table").alias("from_type"), F.col("entity_id").alias("from_id"))
    right = right.select(F.col("name_id").alias("rel"), F.col("entity_table").alias("to_type"), F.col("entity_id").alias("to_id"))
    met = rows.join(left, "rel", "left").join(right, "rel", "left")
    return met.select(
        "document_id", "rel", F.col("proposed_junction").alias("junction"), F.col("from").alias("from_text"), F.trim("to").alias("to_text"), "from_type", "from_id", "to_type", "to_id",
        F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"), "evidence", F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


def _arrivals(relations: DataFrame) -> DataFrame:
    """Relations with how: of junctions whose right end has one parent, whether it comes first, again, or against the first."""
    single = F.col("junction").isin("manufacturing", "org_hierarchy", "product_variant") & F.col("from_id").isNotNull() & F.col("to_id").isNotNull() & (F.col("confidence") >= LOW_CONFIDENCE)
    made = F.col("junction") == "manufacturing"
    child = F.when(made, F.when(F.col("from_type") == "product", F.col("from_id")).otherwise(F.col("to_id"))).otherwise(F.col("to_id"))
    parent = F.when(made, F.when(F.col("from_type") == "product", F.col("to_id")).otherwise(F.col("from_id"))).otherwise(F.col("from_id"))
    ranked = relations.filter(single).withColumn("child", F.concat_ws("|", "junction", child)).withColumn("parent", parent)
    ranked = edges.first_wins(ranked, "child", "parent", "rel").select(*relations.columns, "how")
    return ranked.unionByName(relations.filter(~F.coalesce(single, F.lit(False))).withColumn("how", F.lit("new")))


def gold_payload(gold: list[dict], confidence: float = 0.9, weak_confidence: float = LOW_CONFIDENCE) -> list[tuple[int, str]]:
    """(document_id, raw) of gold graphs, each with document_id, entities, relations, weak_relations, as sure extractions."""
    out = []
    for g in gold:
        sure = lambda items, c: [x | {"confidence": c} for x in items or []]
        out.append((g["document_id"], json.dumps({"entities": sure(g.get("entities"), confidence), "relations": sure(g.get("relations"), confidence), "weak_relations": sure(g.get("weak_relations"), weak_confidence)}, ensure_ascii=False)))
    return out
