from pyspark.sql import functions as F

from claimwright.operators import evaluation, grounding

#: Gold name pairs (a, b, table, expected, level): fixed values.
PAIRS = [
    ("アクメ株式会社", "アクメ（株）", "organization", "same", "exact"),
    ("アクメ株式会社", "アクメ", "organization", "same", "exact"),
    ("アクメ株式会社", "Acme Inc.", "organization", "same", "alias-or-llm"),
    ("山田 太郎", "山田太郎", "person", "same", "exact"),
    ("鈴木 花子", "鈴木花子", "person", "same", "exact"),
    ("SmartScan", "Smart Scan", "product", "same", "exact"),
    ("SmartScan", "smartscan", "product", "same", "exact"),
    ("グローバルテック社", "Global Tech", "organization", "same", "alias-or-llm"),
    ("山田 太郎", "山田 花子", "person", "different", None),
    ("アクメ株式会社", "ベータ製造株式会社", "organization", "different", None),
    ("グローバルテック社", "ベータ製造株式会社", "organization", "different", None),
    ("IBM Bob Pro", "IBM Bob Pro Plus", "product", "different", None),
    ("SmartScan", "SmartView", "product", "different", None),
]


def test_dedup_accuracy(spark):
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(PAIRS)], "pair_id long, a string, b string, entity_table string, expected string, level string")
    got = evaluation.accuracy(evaluation.dedup_pairs(df)).first()
    assert (got.accuracy, got.n) == (0.8462, 13) and got.level_match == 0.75


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "k string")


def test_precision_and_recall(spark):
    got = evaluation.set_prf(keys(spark, "startup", "organization.new_column"), keys(spark, "startup", "unrelated"), ["k"]).first()
    assert (got.tp, got.fp, got.fn, got.precision, got.recall, got.f1) == (1, 1, 1, 0.5, 0.5, 0.5)
    none = evaluation.set_prf(keys(spark), keys(spark), ["k"]).first()
    assert (none.tp, none.precision, none.recall, none.f1) == (0, None, None, None)
    extra = evaluation.set_prf(keys(spark), keys(spark, "x"), ["k"]).first()
    assert (extra.precision, extra.recall, extra.f1) == (0.0, 0.0, 0.0)
    assert {(r.k, r.kind) for r in evaluation.set_differences(keys(spark, "a", "b"), keys(spark, "b", "c"), ["k"]).collect()} == {("a", "missed"), ("c", "extra")}


def test_entities_match_through_aliases(spark):
    gold = spark.createDataFrame([(1, "organization", ["Acme Inc.", "アクメ"]), (2, "organization", ["Globex"]), (3, "person", ["Ann"])], "group_id long, proposed_type string, names array<string>")
    predicted = spark.createDataFrame([("organization", "ACME"), ("organization", "アクメ株式会社"), ("person", "Globex")], "proposed_type string, canonical_name string")
    got = evaluation.match_entities(gold, predicted).first()
    assert (got.tp, got.fp, got.fn) == (1, 1, 2)


def test_relations_cells_and_weak(spark):
    rel = lambda *rows: spark.createDataFrame(list(rows), "proposed_junction string, from string, to string")
    got = evaluation.match_relations(rel(("employment", "Ann", "Acme Inc.")), rel(("employment", "ann", "ACME"), ("employment", "Bob", "Acme"))).first()
    assert (got.tp, got.fp, got.fn) == (1, 1, 0)
    cell = lambda *rows: spark.createDataFrame(list(rows), "proposed_type string, k string, column string, value string")
    aliases = spark.createDataFrame([("o", "acm", "acme")], "proposed_type string, alias_key string, canonical_key string")
    got = evaluation.match_cells(cell(("o", "acme", "year", "1990")), cell(("o", "acm", "year", "1990"), ("o", "acme", "city", "X")), aliases).first()
    assert (got.tp, got.fp, got.fn) == (1, 0, 0)
    weak = lambda *rows: spark.createDataFrame(list(rows), "subject string, predicate string, object string")
    assert evaluation.match_weak(weak(("A B", "p", "c")), weak(("ab", "p", "C"))).first().tp == 1


def test_runs_scores_and_cells(spark):
    runs = spark.createDataFrame([("f1", 0.5), ("f1", 0.7), ("f1", None), ("em", 1.0)], "metric string, v double")
    got = {r.metric: (round(r["mean"], 4), round(r["std"], 4), r.runs) for r in evaluation.mean_std(runs, "metric", "v").collect()}
    assert got == {"f1": (0.6, 0.1, 2), "em": (1.0, 0.0, 1)}
    cases = spark.createDataFrame([(True, 1.0, None), (False, None, None)], "sql_ok boolean, contains double, slugs double")
    assert tuple(evaluation.answer_scores(cases).first()) == (0.5, 1.0, 0.0, 2)
    one = spark.createDataFrame([(0.4, None, 0.8)], "a double, b double, c double")
    assert round(one.select(evaluation.headline(["a", "b", "c"])).first()[0], 4) == 0.6
    assert one.select(evaluation.row_contains(F.array(F.lit("The CEO "), F.lit(None)), F.lit("ce o"))).first()[0]


def test_grounding_and_merging(spark):
    docs = spark.createDataFrame([(1, "Ｇlobex signed the 保守契約 with Bob in Paris")], "document_id long, body string")
    found = spark.createDataFrame([(1, "globex", None), (1, "保守契約書", None), (1, "Zed", "bob"), (1, "bobin", None), (1, "", "")], "document_id long, canonical_name string, mention_surface string")
    assert {r.canonical_name for r in grounding.grounded(found, docs).collect()} == {"globex", "保守契約書", "Zed"}
    rel = spark.createDataFrame([(1, "employment", "Bob", "Globex"), (1, "employment", "Bob", "Nowhere"), (1, "compliance", "Globex", "ISO"), (1, "compliance", "Nobody", "ISO")], "document_id long, proposed_junction string, from string, to string")
    assert sorted(r["to"] for r in grounding.grounded_relations(rel, docs).collect()) == ["Globex", "ISO"]
    rows = [(1, 0, "o", "Acme", "", {"a": "", "b": "1"}, 0.5, "x"), (1, 1, "o", "ACME", "acme!", {"a": "2", "b": "3"}, 0.9, "y")]
    df = spark.createDataFrame(rows, "document_id long, idx int, proposed_type string, canonical_name string, mention_surface string, attributes map<string,string>, confidence double, evidence string")
    got = grounding.merged(df).collect()
    assert len(got) == 1 and (got[0].canonical_name, got[0].mention_surface, got[0].attributes, got[0].confidence) == ("Acme", "acme!", {"a": "2", "b": "1"}, 0.9)


def test_proposal_metrics_of_a_store(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    proposals = frame([("new_table", "startup"), ("new_table", "unrelated"), ("new_table", None)], "kind string, target_table string")
    staging = frame([("person", '{"reason": "low_confidence"}'), ("person", "{bad json"), (None, None)], "proposed_table string, match_summary string")
    claimed = frame([("person", 1, "birth_date", v) for v in ("a", "b", "a")], "entity_table string, entity_id long, column_name string, value string")
    weak = frame([("knows", "edge"), ("owns", None)], "predicate string, promoted_to string")
    gold = frame([("new_table", "startup"), ("new_column", "organization")], "kind string, target_table string"), frame([("low_confidence", "person"), ("", None)], "reason string, proposed_table string"), frame([("knows",)], "predicate string")
    rows = {r.metric: r for r in evaluation.proposal_metrics(proposals, staging, claimed, weak, *gold).collect()}
    got = {m: (r.tp, r.fp, r.fn) for m, r in rows.items()}
    assert got == {"schema_proposal_precision": (1, 1, 1), "staging_replay_correctness": (2, 0, 0), "weak_relation_promotion_recall": (1, 0, 0), "canonical_stability": (1, None, None)}
    assert rows["canonical_stability"].passed is False and evaluation.proposal_metrics(proposals, staging, claimed, weak, *gold, most_flips=1).filter("passed").count() == 1
    none = evaluation.proposal_metrics(proposals.limit(0), staging.limit(0), claimed.limit(0), weak.limit(0), *[g.limit(0) for g in gold]).collect()
    assert [r.precision for r in none] == [None] * 4 and [r.passed for r in none if r.metric == "canonical_stability"] == [True]
