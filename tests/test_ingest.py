import json

import pytest

from claimwright.operators import claims, entities, routing
from claimwright.plans import ingest

BODY = "Ann leads Acme Inc. as CEO. Acme Inc. makes Scan. Globex owns Acme Inc. Scan Pro extends Scan. Bob knows Ann. Acme Inc. was founded in 1990."

GOLD = {
    "document_id": 5,
    "entities": [
        {"proposed_type": "person", "canonical_name": "Ann", "attributes": {"birth_date": "1990-01-01", "shoe_size": "40"}},
        {"proposed_type": "organization", "canonical_name": "Acme Inc.", "attributes": {"founded_year": "1990", "headquarters": ""}},
        {"proposed_type": "organization", "canonical_name": "Globex"}, {"proposed_type": "product", "canonical_name": "Scan"}, {"proposed_type": "product", "canonical_name": "Scan Pro"},
        {"proposed_type": "startup", "canonical_name": "Bob", "attributes": {"stage": "seed"}}, {"proposed_type": "person", "canonical_name": "Nowhere"},
    ],
    "relations": [
        {"proposed_junction": "employment", "from": "Ann", "to": "Acme Inc.", "attributes": {"role": "CEO", "mood": "good"}}, {"proposed_junction": "manufacturing", "from": "Scan", "to": "Acme Inc."},
        {"proposed_junction": "manufacturing", "from": "Scan", "to": "Globex"}, {"proposed_junction": "org_hierarchy", "from": "Globex", "to": "Acme Inc."}, {"proposed_junction": "product_variant", "from": "Scan", "to": "Scan Pro"},
        {"proposed_junction": "product_variant", "from": "Scan Pro", "to": "Scan"}, {"proposed_junction": "friend_of", "from": "Ann", "to": "Globex"}, {"proposed_junction": "org_hierarchy", "from": "Ann", "to": "Acme Inc."},
        {"proposed_junction": "employment", "from": "Bob", "to": "Acme Inc."}, {"proposed_junction": "employment", "from": "Ann", "to": "Missing Corp"},
    ],
    "weak_relations": [{"subject": "Ann", "predicate": "admires", "object": "the sea"}, {"subject": "Globex", "predicate": "owns", "object": "Scan"}, {"subject": "Ghost", "predicate": "haunts", "object": "Scan"}],
}


@pytest.fixture(scope="module")
def out(spark):
    second = {"document_id": 6, "entities": [{"proposed_type": "product", "canonical_name": "Scan"}, {"proposed_type": "organization", "canonical_name": "GLOBEX"}], "relations": [{"proposed_junction": "manufacturing", "from": "Scan", "to": "GLOBEX"}]}
    raw = spark.createDataFrame(ingest.gold_payload([GOLD, second]), "document_id long, raw string")
    docs = spark.createDataFrame([(5, BODY, 1), (6, "GLOBEX now makes Scan", 2)], "document_id long, body string, arrival long")
    return ingest.ingest(raw, docs)


def test_entities_and_claims(out):
    assert {(r.name, r.how) for r in out["upserts"].collect()} == {("Ann", "new"), ("Acme Inc.", "new"), ("Globex", "new"), ("Scan", "new"), ("Scan Pro", "new"), ("Scan", "exact"), ("GLOBEX", "exact")}
    said = {(r.entity_table, r.column_name, r.value, r.document_id) for r in out["claims"].collect()}
    assert {("person", "birth_date", "1990-01-01", 5), ("organization", "founded_year", "1990", 5), ("product", "canonical_name", "Scan", 6)} <= said and not any(v == "" for _, _, v, _ in said)
    names = {r.canonical_name for r in claims.canonical_table(claims.resolve(out["claims"]), "organization").collect()}
    assert names == {"Acme Inc.", "Globex"}
    assert {(r.kind, r.target_table, r.column) for r in out["proposals"].collect()} == {("new_column", "person", "shoe_size"), ("new_table", "startup", None)}
    assert out["mentions"].count() == 7


def test_edges(out):
    assert sorted((r.junction, r.document_id) for r in out["edges"].collect()) == [("employment", 5), ("manufacturing", 5), ("org_hierarchy", 5), ("product_variant", 5)]
    assert [(r.column_name, r.value) for r in out["edge_claims"].collect()] == [("role", "CEO")]
    staged = sorted((r.reason, r.document_id) for r in out["staging"].collect() if r.kind == "relation")
    assert staged == [("cardinality_violation", 6), ("in_document_alternative", 5), ("in_document_alternative", 5)] or staged == [("cardinality_violation", 6), ("in_document_alternative", 5), ("in_document_alternative", 5), ("in_document_alternative", 5)]
    assert out["existence"].count() == 4


def test_weak_and_outcomes(out):
    rows = {(r.predicate, r.object_table, r.object_text) for r in out["weak"].collect()}
    assert {("admires", None, "the sea"), ("owns", "product", None), ("friend_of", "organization", "Ann -> Globex")} <= rows and not any(p == "haunts" for p, _, _ in rows)
    counts = {(r.route, r.reason): r.n for r in out["outcomes"].collect()}
    assert counts[("edge", "ok")] == 4 and counts[("dropped", "unresolved_endpoint")] == 1 and counts[("staging", "unknown_column")] == 1
    assert routing.promotable(out["weak"].selectExpr("predicate", "null as promoted_to"), least=1).count() == out["weak"].select("predicate").distinct().count()


def test_extraction_folds_over_chunks(spark):
    def model(chunk, known):
        if "fail" in chunk:
            raise RuntimeError("no model")
        return '```json\n{"entities": [{"proposed_type": "person", "canonical_name": "%s"}]}\n```' % (chunk.strip().split()[0] + f"-{len(known)}")

    docs = spark.createDataFrame([(1, "Ann here\n\nBob there\n\nfail now"), (2, "")], "document_id long, body string")
    got = {r.document_id: r for r in ingest.extract(docs, model, 12).collect()}
    assert '"Ann-0"' in got[1].raw and '"Bob-1"' in got[1].raw and "fail" not in got[1].raw
    assert [tuple(x) for x in got[1].failed] == [(2, "RuntimeError: no model")] and len(got[2].failed) == 1


def test_aliases_lead_to_the_stored_entity_and_staged_names_to_candidates(spark):
    graph = {
        "document_id": 9,
        "entities": [
            {"proposed_type": "organization", "canonical_name": "Big Blue", "attributes": {"founded_year": "1911"}}, {"proposed_type": "organization", "canonical_name": "IBM"},
            {"proposed_type": "person", "canonical_name": "Ann"}, {"proposed_type": "startup", "canonical_name": "Ibmm"}, {"proposed_type": "organization", "canonical_name": "IBMM", "confidence": 0.1, "attributes": {"founded_year": "1912"}},
        ],
        "relations": [{"proposed_junction": "employment", "from": "Ann", "to": "Big Blue"}],
    }
    (document, raw), = ingest.gold_payload([graph])
    raw = spark.createDataFrame([(document, json.dumps({**json.loads(raw), "entities": [e | {"confidence": e.get("confidence", 0.9)} for e in graph["entities"]]}))], "document_id long, raw string")
    docs = spark.createDataFrame([(9, "Ann works at Big Blue, that is IBM. Ibmm is new, so is IBMM.", 1)], "document_id long, body string, arrival long")
    known = spark.createDataFrame([("organization", 77, "IBM", "ibm")], "entity_table string, entity_id long, name string, norm_key string")
    aliases = spark.createDataFrame([("organization", 77, "IBM", "bigblue")], "entity_table string, entity_id long, name string, norm_key string")
    out = ingest.ingest(raw, docs, known, aliases)
    assert {r.name: (r.how, r.canonical_name, r.entity_id) for r in out["upserts"].collect() if r.entity_id == 77} == {"Big Blue": ("alias", "IBM", 77), "IBM": ("exact", "IBM", 77)}
    assert [r.entity_id for r in out["claims"].filter("column_name = 'founded_year'").collect()] == [77] and {r.to_id for r in out["edges"].collect()} == {77}
    # an alias without an id has that of its entity's name
    plain = entities.upsert_entities(spark.createDataFrame([("organization", "Big Blue", 1), ("organization", "IBM", 2)], "entity_table string, name string, seq long"), aliases=aliases.drop("entity_id"))
    assert len({r.entity_id for r in plain.collect()}) == 1
    staged = {(r.reason, json.loads(r.payload)["column_name"]): json.loads(r.payload) for r in out["staging"].collect()}
    assert staged[("non_starter_type", "canonical_name")]["candidates"][0]["entity_table"] == "organization"
    assert 77 in [c["entity_id"] for c in staged[("low_confidence", "founded_year")]["candidates"]]
