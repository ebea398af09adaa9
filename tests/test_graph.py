import itertools
import math
import random

from pyspark.sql import functions as F

from claimwright.operators import audit, edges, entities, routing, search, similarity


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_upsert_entities(spark):
    names = df(spark, [("organization", "Acme Inc.", 1), ("organization", "ACME", 2), ("person", "Acme", 3), ("organization", "Globex", 4), ("organization", "Old Name", 5), ("organization", "Inc.", 6)], "entity_table string, name string, seq long")
    stored = df(spark, [("organization", "Globex KK", "globex")], "entity_table string, name string, norm_key string")
    aliases = df(spark, [("organization", "New Name", "oldname")], "entity_table string, name string, norm_key string")
    got = {r.seq: (r.how, r.canonical_name) for r in entities.upsert_entities(names, stored, aliases).collect()}
    assert got == {1: ("new", "Acme Inc."), 2: ("exact", "Acme Inc."), 3: ("new", "Acme"), 4: ("exact", "Globex KK"), 5: ("alias", "New Name"), 6: ("invalid", "Inc.")}
    found = entities.upsert_entities(names)
    assert entities.entity_table_of(found).filter("entity_table = 'organization'").count() == 3
    assert {r.alias for r in entities.aliases_of(found).collect()} == {"Acme Inc.", "ACME", "Acme", "Globex", "Old Name"}


def test_similarity_join_finds_all_pairs(spark):
    keys = [a + b + c for a, b, c in itertools.product(("red", "blue", "small"), ("ring", "bolt", "widget"), ("", "x", "pro"))]
    grams = lambda s: {f"  {s} "[i : i + 3] for i in range(len(s) + 1)}
    for least in (0.3, 0.55, 0.9):
        want = {(a, b) for a in keys for b in keys if len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= least}
        found = entities.similarity_join(df(spark, [(k,) for k in keys], "l string"), df(spark, [(k,) for k in keys], "r string"), least)
        assert {(r.l, r.r) for r in found.collect()} == want


def test_candidates_with_and_without_vectors(spark):
    asked = df(spark, [(1, "東大", [1.0, 0.0])], "query_id long, norm_key string, embedding array<float>")
    known = df(spark, [("organization", 1, "東京大学", [0.9, 0.1]), ("organization", 2, "京大", [0.0, 1.0]), ("person", 3, "東大", None)], "entity_table string, entity_id long, norm_key string, embedding array<float>")
    bare = {(r.entity_id, r.norm_match) for r in entities.candidates(asked, known).collect()}
    assert (3, True) in bare and all(i != 1 for i, _ in bare)
    rescued = {r.entity_id: r.score for r in entities.candidates(asked, known, vectors=True).collect()}
    assert rescued[1] > 0.9 and rescued[3] == 1.0
    assert [r.rank for r in entities.candidates_across(asked, known).orderBy("rank").collect()][0] == 1


def test_lookup_prefers_the_hinted_type(spark):
    known = df(spark, [("person", 1, "Acme"), ("organization", 2, "Acme")], "entity_table string, entity_id long, canonical_name string")
    names = df(spark, [(1, "Acme", "organization"), (2, "Acme", None), (3, "Nobody", None)], "name_id long, name string, hint string")
    assert {r.name_id: r.entity_id for r in entities.lookup(names, known, ("person", "organization")).collect()} == {1: 2, 2: 1}


def test_cardinality_first_arrival_wins(spark):
    rows = df(spark, [(1, 10, 1), (1, 20, 2), (1, 10, 3), (2, 20, 4)], "child long, parent long, seq long")
    assert {r.seq: (r.how, r.first_parent) for r in edges.first_wins(rows, "child", "parent").collect()} == {1: ("new", 10), 2: ("cardinality_violation", 10), 3: ("existing", 10), 4: ("new", 20)}
    jobs = df(spark, [(1, 1, None, 1), (1, 1, None, 2), (1, 1, "2020", 3)], "person_id long, organization_id long, start_date string, seq long")
    assert sorted((r.start_date or "", r.arrivals) for r in edges.find_or_create_employment(jobs).collect()) == [("", 2), ("2020", 1)]


def test_in_document_winners(spark):
    rows = df(spark, [(1, "k", 0.7, 0), (1, "k", 0.9, 1), (1, "k", 0.9, 2), (1, None, 0.1, 3)], "doc long, key string, confidence double, idx long")
    assert {r.idx: (r.role, r.winner_idx) for r in edges.in_document_winners(rows, ["doc", "key"]).collect()} == {0: ("loser", 1), 1: ("winner", 1), 2: ("loser", 1), 3: ("winner", 3)}
    keys = df(spark, [("employment", 1, 2, None), ("manufacturing", 1, 2, None), ("org_hierarchy", 1, 2, None), ("governance", 1, None, None)], "j string, l long, r long, s string")
    got = [r[0] for r in keys.select(edges.cardinality_key(F.col("j"), F.col("l"), F.col("r"), F.col("s"))).collect()]
    assert got == ["employment|1|2|", "manufacturing|1", "org_hierarchy|2", None]


def test_variant_direction(spark):
    bob, pro, plus, ultra = 1, 2, 3, 4
    rows = [(7, 0, pro, bob, 0.9), (7, 1, bob, pro, 0.7), (7, 2, bob, plus, 0.7), (7, 3, bob, ultra, 0.7), (8, 0, 5, 6, 0.5)]
    got = {(r.document_id, r.idx): (r.kept, r.winner_idx) for r in edges.variant_direction(df(spark, rows, "document_id long, idx long, parent_id long, variant_id long, confidence double")).collect()}
    assert got == {(7, 0): (False, 1), (7, 1): (True, None), (7, 2): (True, None), (7, 3): (True, None), (8, 0): (True, None)}


def test_closure(spark):
    tree = df(spark, [(k, k // 2) for k in range(2, 40)], "child_id long, parent_id long")
    want = set()
    for node in range(2, 40):
        up, depth = node, 0
        while up > 1:
            up, depth = up // 2, depth + 1
            want.add((node, up, depth))
    assert {(r.node, r.ancestor, r.depth) for r in edges.closure(tree).collect()} == want
    assert edges.closure(df(spark, [(1, 2), (2, 1)], "child_id long, parent_id long")).count() == 4
    chain = edges.closure(df(spark, [(k, k + 1) for k in range(100)], "child_id long, parent_id long"))
    assert chain.count() == 5050 and chain.filter("depth <> ancestor - node").count() == 0


def test_relation_view_shows_both_ends(spark):
    jobs = df(spark, [(1, 2)], "person_id long, organization_id long")
    rules = df(spark, [(5, "ISO")], "contract_id long, standard_name string")
    known = df(spark, [("person", 1, "Ann"), ("organization", 2, "Acme"), ("contract", 5, "SLA")], "entity_table string, entity_id long, canonical_name string")
    got = {(r.entity_table, r.relation, r.direction, r.other_name) for r in edges.relation_view({"employment": jobs, "compliance": rules}, known).collect()}
    assert got == {("person", "employment", "out", "Acme"), ("organization", "employment", "in", "Ann"), ("contract", "compliance", "out", "ISO")}


def test_routing(spark):
    schema = "junction string, from_type string, from_id long, to_type string, to_id long, to_text string, confidence double, how string, n int"
    rows = [("friend", "person", 1, "person", 2, None, 0.9, None, 0), ("employment", None, None, "organization", 2, None, 0.9, None, 1), ("org_hierarchy", "person", 1, "organization", 2, None, 0.9, None, 2),
            ("product_variant", "product", 1, "product", 1, None, 0.9, None, 3), ("manufacturing", "organization", 1, "product", 2, None, 0.9, "cardinality_violation", 4), ("employment", "organization", 1, "person", 2, None, 0.2, None, 5),
            ("employment", "organization", 1, "person", 2, None, 0.9, "new", 6), ("compliance", "contract", 1, None, None, "ISO", 0.9, None, 7), ("compliance", "contract", 1, None, None, " ", 0.9, None, 8)]
    got = {r.n: (r.route, r.reason) for r in routing.route_relations(df(spark, rows, schema)).collect()}
    assert got == {0: ("weak", "unknown_junction"), 1: ("dropped", "unresolved_endpoint"), 2: ("weak", "endpoint_type_mismatch"), 3: ("weak", "self_variant"), 4: ("staging", "cardinality_violation"), 5: ("weak", "low_confidence"), 6: ("edge", None), 7: ("edge", None), 8: ("dropped", "unresolved_endpoint")}
    routed = routing.route_relations(df(spark, rows, schema)).withColumns({"from_text": F.lit("a"), "document_id": F.lit(1), "evidence": F.lit("e")})
    weak = routing.weak_rows(routed).collect()
    assert len(weak) == 4 and all(w.confidence <= 0.3 for w in weak) and {w.object_text for w in weak if w.predicate == "friend"} == {"a -> "}


def test_attributes_staging_and_promotion(spark):
    rows = [("person", "birth_date", "x", 0.9), ("person", "height", "x", 0.9), ("startup", "stage", "x", 0.9), ("person", "birth_date", "x", 0.1), ("person", "birth_date", "", 0.9)]
    routed = routing.route_attributes(df(spark, rows, "proposed_type string, column_name string, value string, confidence double"))
    assert [(r.route, r.reason) for r in routed.collect()] == [("claim", None), ("staging", "unknown_column"), ("staging", "non_starter_type"), ("staging", "low_confidence"), ("dropped", "empty_value")]
    assert {(r.kind, r.target_table, r.column) for r in routing.proposals_of(routed).collect()} == {("new_table", "startup", None), ("new_column", "person", "height")}
    weak = df(spark, [("likes", None)] * 5 + [("knows", None)] * 4 + [("owns", None)] * 6, "predicate string, promoted_to string")
    named = df(spark, [("owns", "approved")], "target_table string, status string")
    assert [(r.predicate, r.n) for r in routing.promotable(weak, named).collect()] == [("likes", 5)]
    summary = spark.range(1).select(routing.match_summary(F.lit("low_confidence"), None, F.lit("d"))).first()[0]
    assert summary == '{"reason":"low_confidence","detail":"d"}'


def test_decisions(spark):
    log = df(spark, [(1, "pending", 1), (1, "approved", 2), (2, "pending", 1)], "proposal_id long, status string, seq long")
    asked = df(spark, [(1, "reject"), (2, "approve"), (3, "approve")], "proposal_id long, action string")
    assert {r.proposal_id: r.accepted for r in routing.decide(log, asked).collect()} == {1: False, 2: True, 3: False}


def test_search(spark):
    docs = df(spark, [(1, "red fox"), (2, "blue whale"), (3, "Fox, again")], "doc_id long, text string")
    assert [r.doc_id for r in search.fts(docs, "a FOX!").collect()] == [1, 3]
    assert search.fts(docs, "??").collect() == []
    items = df(spark, [("a", 0, [0.0, 1.0]), ("b", 1, [1.0, 0.0]), ("c", 2, [0.7, 0.7])], "item_id string, pos int, embedding array<float>")
    assert [r.item_id for r in search.top_or_head([1.0, 0.0], items, 2, "pos").collect()] == ["b", "c"]
    assert [r.item_id for r in search.top_or_head(None, items, 2, "pos").collect()] == ["a", "b"]
    q = df(spark, [(9, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [r.item_id for r in search.cosine_top(q, items, 2).orderBy("rank").collect()] == ["b", "c"]
    rng = random.Random(3)
    items = df(spark, [(f"i{k:03}", [float(rng.randrange(-2, 3)) for _ in range(3 if k % 9 else 2)] if k % 17 else None) for k in range(200)], "item_id string, embedding array<float>")
    q = df(spark, [(k, v) for k, v in enumerate(([1.0, 0.0, 1.0], [0.0, 0.0, 0.0], [1.0, 2.0], None, [0.0, -1.0, 2.0]))], "query_id int, embedding array<double>")

    def plain(a, b):
        norm = math.sqrt(sum(x * x for x in a or ())) * math.sqrt(sum(x * x for x in b or ()))
        return sum(x * y for x, y in zip(a, b, strict=True)) / norm if norm and len(a) == len(b) else 0.0

    for least in (None, 0.5):
        found = search.cosine_top(q, items.repartition(5), 7, least=least).collect()
        for r in q.collect():
            want = sorted((-round(plain(i.embedding, r.embedding), 12), i.item_id) for i in items.collect())[:7]
            want = [(i, -s) for s, i in want if least is None or -s >= least]
            got = sorted(((x.rank, x.item_id, round(x.score, 12)) for x in found if x.query_id == r.query_id))
            assert [(i, s) for _, i, s in got] == want
    assert search.cosine_top(q.limit(0), items, 7).count() == 0 and search.cosine_top(q, items.limit(0), 7).count() == 0


def test_hints_and_provenance(spark):
    asked = df(spark, [(1, "whichacmeitems")], "question_id long, q_key string")
    values = df(spark, [("organization.name", "Acme", "acme"), ("organization.name", "Zed", "zed"), ("product.name", "Acme Pro", "acmepro")], "source string, value string, v_key string")
    got = search.column_hints(asked, values)
    assert {(r.value, r.score) for r in got.collect() if r.score == 1.0} == {("Acme", 1.0)}
    assert "organization.name: Acme" in search.hint_text(got).first().hints
    rows = df(spark, [(" Acme ", "12.5", "x"), ("2020-01-01", "Beta", "Acme")], "a string, b string, c string")
    strings = search.candidate_strings(rows)
    assert [r.value for r in strings.collect()] == ["Acme", "Beta"]
    known = df(spark, [("organization", 1, "Acme")], "entity_table string, entity_id long, canonical_name string")
    backed = df(spark, [("organization", 1, 5, "active"), ("organization", 1, 6, "superseded")], "entity_table string, entity_id long, document_id long, status string")
    slugs = df(spark, [(5, "doc-five"), (6, "doc-six")], "id long, slug string")
    assert [tuple(r) for r in search.provenance(strings, known, backed, slugs).collect()] == [("doc-five", "Acme", "organization")]


def test_audit(spark):
    a = df(spark, [(1, "b"), (2, "A")], "id long, canonical_name string")
    refs = df(spark, [(1,)], "who long")
    assert [r.id for r in audit.orphans(a, [(refs, "who")], "id").collect()] == [2]
    assert [r.id for r in audit.listing(a, contains="a").collect()] == [2]
    assert {(r.name, r.n) for r in audit.counts({"a": a, "none": a.limit(0)}).collect()} == {("a", 2), ("none", 0)}
    schema = "id long, slug string, title string, path string, body string, ingested_at string"
    old, new = df(spark, [(1, "s", "t", "p", "old", "2020")], schema), df(spark, [(7, "s", "t", "p", "new", "2021"), (8, "z", "t", "p", "b", "2021")], schema)
    assert {(r.id, r.slug, r.body) for r in audit.upsert_documents(old, new).collect()} == {(1, "s", "new"), (8, "z", "b")}
    assert [r.who for r in audit.dangling(df(spark, [(1,), (9,), (None,)], "who long"), "who", a, "id").collect()] == [9]


def test_containment_join_against_all_pairs(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abc") for _ in range(rng.randrange(n)))
    l, r = {word(14) for _ in range(80)}, {word(6) for _ in range(60)} | {"a", "bc"}
    found = similarity.containment_join(df(spark, [(x,) for x in l], "l string"), df(spark, [(x,) for x in r], "r string")).collect()
    assert sorted((x.l, x.r) for x in found) == sorted((x, y) for x in l for y in r if x and y and y in x)
