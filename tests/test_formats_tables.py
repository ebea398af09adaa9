import json
import math
import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from claimwright.functions import tables
from claimwright.functions.confidence import mean_confidence
from claimwright.functions.text import chunks
from claimwright.operators import audit, intervals, reports
from claimwright.plans import catalog, sql_functions
from claimwright.plans.registry import Registry
from claimwright.sources import formats


@pytest.fixture(scope="module")
def sources(spark):
    formats.register(spark)
    return spark


def test_gold_files(sources, tmp_path):
    (tmp_path / "a.yaml").write_text('version: 1\nitems:\n  - id: x\n    q: "what: now"\n  - id: y\n    q: ""\n  - q: "no id"\n')
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "b.yml").write_text("version: 1\nitems:\n  - id: é\n    q: b\n")
    (tmp_path / "bad.yaml").write_text(": : :")
    (tmp_path / "old.yaml").write_text("version: 9\nitems:\n  - id: z\n")
    (tmp_path / "note.txt").write_text("items")
    read = sources.read.format("gold").load(str(tmp_path))
    assert sorted((os.path.basename(r.file), r.position, r.id) for r in read.collect()) == [("a.yaml", 0, "x"), ("a.yaml", 1, "y"), ("b.yml", 0, "é")]
    both = sources.read.format("gold").option("needed", "id,q").load(str(tmp_path))
    assert sorted(json.loads(r.item)["q"] for r in both.collect()) == ["b", "what: now"]
    assert sources.read.format("gold").load(str(tmp_path / "deep" / "b.yml")).count() == 1
    (tmp_path / "none").mkdir()
    assert sources.read.format("gold").load(str(tmp_path / "none")).count() == 0


def report(stage, stamp, aggregate, cases=()):
    return json.dumps({"meta": {"stage": stage, "timestamp_utc": stamp, "model": "m", "tag": "t", "git_rev": "r"}, "result": {"aggregate": aggregate, "per_case": list(cases)}})


def test_reports_are_written_whole_and_listed_with_their_headline(sources, tmp_path):
    folder = str(tmp_path / "reports")
    rows = [
        ("q", report("query", "2024-03", {"sql_success_rate_mean": 1, "row_contains_rate_mean": 0.5, "sql_success_rate_std": 9}, [{"sql_ok": True}])), ("e", report("extract", "2024-01", {"entities_f1_mean": 0.25}, [{"x": 1}])),
        ("f", report("query", "2024-02", {}, [{"sql_ok": True}, {"missed_slugs": ["a"]}])), ("o", report("else", None, {"own_mean": 0.75})),
    ]
    sources.createDataFrame(rows, "name string, report string").repartition(3).write.format("reports").mode("append").save(folder)
    assert sorted(os.listdir(folder)) == ["e.json", "f.json", "o.json", "q.json"]
    (tmp_path / "reports" / "broken.json").write_text("{")
    found = reports.listing(sources.read.format("reports").load(folder)).collect()
    assert [r.file for r in found] == ["q.json", "f.json", "e.json", "o.json", "broken.json"]
    assert [(r.cases, r.failed) for r in found[:4]] == [(1, False), (2, True), (1, True), (0, False)]
    assert [r.score for r in found] == [0.75, None, 0.25, 0.75, None] and found[4].error and found[4].stage is None
    assert found[0].headline == {"sql": 1.0, "row": 0.5, "doc": None} and found[3].headline == {"own": 0.75}


def test_a_failed_task_leaves_no_report(sources, tmp_path):
    folder = str(tmp_path / "reports")
    rows = [(f"n{k}", "{}") for k in range(8)] + [("bad", "no json")]
    with pytest.raises(Exception, match="Expecting value|JSONDecodeError"):
        sources.createDataFrame(rows, "name string, report string").repartition(4).write.format("reports").mode("append").save(folder)
    seen = lambda: sorted(f for f in (os.listdir(folder) if os.path.isdir(folder) else ()) if not f.startswith("_"))  # noqa: E731  a task that outlives the failure may leave its folder aside
    assert seen() == []
    sources.createDataFrame(rows[:8], "name string, report string").write.format("reports").mode("append").save(folder)
    sources.createDataFrame([("only", "{}")], "name string, report string").write.format("reports").mode("overwrite").save(folder)
    assert seen() == ["only.json"]


def test_what_a_run_states(tmp_path):
    meta = reports.run_meta("query", "gold.yaml", "t", 3, "m", str(tmp_path), temperature=0.5)
    assert meta["git_rev"] == "unknown" and meta["temperature"] == 0.5 and meta["runs"] == 3 and len(meta["timestamp_utc"]) == 20
    own = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    head = subprocess.run(["git", "rev-parse", "HEAD"], cwd=own, capture_output=True, text=True).stdout.strip()
    assert reports.revision(own) == (head or "unknown")


def test_table_functions(spark):
    tables.register(spark)
    rng = random.Random(2)
    texts = [(k, "".join(rng.choice(["word ", "\n\n", "\n \n", "## h\n", "### d\n", "é" * 30]) for _ in range(rng.randrange(60)))) for k in range(60)] + [(60, None), (61, ""), (62, "x" * 1000)]
    spark.createDataFrame(texts, "id long, text string").repartition(5).createOrReplaceTempView("some_texts")
    want = sorted((i, k, piece) for i, text in texts for k, piece in enumerate(chunks(text, 100)))
    assert sorted(map(tuple, spark.sql("SELECT id, chunk_no, chunk FROM some_texts, LATERAL chunk_text(text, 100)").collect())) == want
    assert sorted(map(tuple, spark.sql("SELECT * FROM chunk_table(TABLE(SELECT id, text, 100 AS size FROM some_texts))").collect())) == want
    raw = spark.createDataFrame([(1, '```json\n[{"a": 1}, {"a": 2}]\n```'), (2, '{"relations": [{"b": "é"}], "n": 1}'), (3, "none"), (4, None)], "id int, raw string")
    raw.createOrReplaceTempView("raw")
    found = spark.sql("SELECT id, section, item_no, item FROM raw, LATERAL payload_items(raw)").collect()
    assert sorted(map(tuple, found)) == [(1, "entities", 0, '{"a": 1}'), (1, "entities", 1, '{"a": 2}'), (2, "relations", 0, '{"b": "é"}')]


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(3)
    ranges = lambda n: [(rng.choice(["a", "b", None]), a := rng.randrange(300), a + rng.choice([0, 1, 5, 64, 200]), k) for k in range(n)]
    left, right = ranges(120) + [("a", None, 5, 900), ("a", 9, 5, 901)], ranges(80)
    shape = "k string, start long, end long, {} int"
    for width in (1, 64, 1000):
        got = intervals.overlaps(spark.createDataFrame(left, shape.format("i")), spark.createDataFrame(right, shape.format("j")), "k", width)
        want = sorted((x[3], y[3]) for x in left for y in right if x[0] == y[0] is not None and x[1] is not None and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2])
        assert sorted((r.i, r.j) for r in got.collect()) == want


def test_confidences_of_spans(spark):
    tokens = spark.createDataFrame([("a", 0, 2, -0.1), ("a", 2, 5, -0.3), ("a", 5, 9, -0.5)], "k string, start long, end long, logprob double")
    said = spark.createDataFrame([("a", "both", "xé"), ("a", "none", "zz"), ("b", "lost", "x")], "k string, name string, value string")
    spans = intervals.located(said, spark.createDataFrame([("a", "x xé xé y")], "k string, text string"), "k")
    assert {(r.name, r.start, r.end) for r in spans.collect()} == {("both", 2, 5), ("none", None, None), ("lost", None, None)}
    got = {r.name: (round(r.confidence, 9), r.tokens) for r in intervals.span_confidences(tokens, spans, "k", "name").collect()}
    assert got == {"both": (round(math.exp(-0.3), 9), 1), "none": (0.1, 0), "lost": (0.1, 0)}
    means = spark.createDataFrame([([-0.2, -0.4],), ([],), (None,)], "l array<double>").select(mean_confidence(F.col("l")).alias("c"))
    assert [round(r.c, 9) for r in means.collect()] == [round(math.exp(-0.3), 9), 0.1, 0.1]


def test_sql_functions(spark):
    sql_functions.register(spark)
    row = spark.sql("""SELECT iif(1 > 2, 'a', 'b') AS i, strftime('%d.%m.%Y %H:%M', '2024-02-03 04:05:06') AS s, julianday('2000-01-01 12:00:00') AS j, unixepoch('1970-01-02') AS u, total(array(1.5D, NULL, 2D)) AS t,
    total(NULL) AS n, group_concat(array('a', NULL, 'b'), '-') AS g, group_concat(array(CAST(NULL AS STRING)), '-') AS e, strftime('%Y', 'no date') AS x""").first()
    assert tuple(row) == ("b", "03.02.2024 04:05", 2451545.0, 86400, 3.5, 0.0, "a-b", None, None)


def test_types_that_are_there(spark):
    spark.range(1).createOrReplaceTempView("person")
    spark.range(1).createOrReplaceTempView("person_claims")
    spark.range(1).createOrReplaceTempView("contract")
    try:
        assert "person" in catalog.present_types(spark, Registry()) and "contract" not in catalog.present_types(spark, Registry())
    finally:
        for name in ("person", "person_claims", "contract"):
            spark.catalog.dropTempView(name)


def test_entity_detail_has_documents(spark):
    known = spark.createDataFrame([("person", 1, "Ann")], "entity_table string, entity_id long, canonical_name string")
    said = spark.createDataFrame([("person", 1, 5, "born", 0.5), ("person", 1, 6, "born", 0.9), ("person", 2, 5, "born", 1.0)], "entity_table string, entity_id long, document_id long, column_name string, confidence double")
    slugs = spark.createDataFrame([(5, "five")], "id long, slug string")
    names = said.select("entity_table", "entity_id", F.lit("x").alias("alias"))
    other = said.select("entity_table", "entity_id", F.lit("r").alias("relation"), F.lit("out").alias("direction"), F.lit("y").alias("other_name"))
    found = audit.entity_detail("person", 1, known, names, said, other, said.withColumn("surface_form", F.lit("s")), slugs)
    assert [r.doc_slug for r in found["claims"].collect()] == ["five"] == [r.doc_slug for r in found["mentions"].collect()]
