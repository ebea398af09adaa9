
from pyspark.sql import functions as F

from claimwright.operators import claims
from claimwright.sources import files
from claimwright.streaming import claims as streaming

SCHEMA = "entity_table string, entity_id long, column_name string, document_id long, value string, confidence double, seq long, ts timestamp"


def test_files_by_extension(spark, tmp_path):
    (tmp_path / "My note.v1.md").write_text("# hi")
    (tmp_path / "table.csv").write_bytes("名前,x\nあ,1|2\n".encode("cp932"))
    (tmp_path / "bad.bin").write_bytes(b"\0")
    (tmp_path / "done.txt").write_text("old")
    (tmp_path / "odd.txt").write_bytes(b"a\xffb")
    done = spark.createDataFrame([("done",)], "slug string")
    got = {r.slug: r for r in files.extract_files(spark, str(tmp_path), done).collect()}
    assert set(got) == {"My-note.v1", "table", "bad", "odd"} and got["My-note.v1"].title == "My note.v1"
    assert got["My-note.v1"].body == "<!-- source: My%20note.v1.md -->\n\n# hi" or got["My-note.v1"].body == "<!-- source: My note.v1.md -->\n\n# hi"
    assert "| 名前 | x |\n| --- | --- |\n| あ | 1\\|2 |" in got["table"].body and got["bad"].body is None and "no reader" in got["bad"].problem and "�" in got["odd"].body
    hooked = files.extract_files(spark, str(tmp_path), converters={".bin": lambda data: f"{len(data)} bytes"})
    assert {r.slug: r.body for r in hooked.collect()}["bad"].endswith("1 bytes")
    assert {r.slug for r in files.read_texts(spark, str(tmp_path / "*.txt")).collect()} == {"done", "odd"}


def test_tables_logs_and_reports(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_table(spark.range(3), path)
    files.write_table(spark.read.parquet(path).filter("id > 0"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2]
    log = str(tmp_path / "log")
    for k in range(2):
        files.append_log(spark.createDataFrame([(k, "note")], "seq long, entry string"), log)
    assert spark.read.parquet(log).count() == 2
    folder = str(tmp_path / "reports")
    for stamp in ("2024", "2025"):
        files.write_report(spark.createDataFrame([(0.5,)], "f1 double"), folder, stamp, "m:1", "tag", "extract")
    assert "2025__m-1__tag__extract" in files.read_reports(spark, folder).first().report
    assert files.report_markdown("R", {"f1": 0.5, "x": None}, [{"k": 1}] * 30).count('{"k": 1}') == 20
    assert files.guarded_path("/tmp/eval/x", ("/tmp/eval",)) == "/tmp/eval/x"
    for bad in ("/data/prod", "/tmp/eval/../x", "/tmp/evalx"):
        try:
            files.guarded_path(bad, ("/tmp/eval",))
            raise AssertionError(bad)
        except PermissionError:
            pass


def test_yaml_items():
    text = 'version: 1\nitems:\n  - id: a\n    q: "what: now"\n    sql: "SELECT 1"\n  - id: b\n    q: ""\n'
    assert [x["id"] for x in files.yaml_items(text, ("id", "q"))] == ["a"]
    assert files.yaml_items("version: 9\nitems: []", ()) == [] and files.yaml_items(": : :", ()) == []


def test_embedding_cache(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("b",), ("bad",)], "text string")
    cache = spark.createDataFrame([], "key string, vec array<float>")

    def embed(text):
        if text == "bad":
            raise ValueError(text)
        return [float(len(text)), 1.0]

    found, fresh = files.cached_embeddings(texts, cache, "m", embed)
    assert {r.text: r.vec for r in found.collect()} == {"a": [1.0, 1.0], "b": [1.0, 1.0], "bad": None} and fresh.count() == 2
    _, again = files.cached_embeddings(texts, fresh, "m", lambda t: [9.0])
    assert [r.vec for r in again.collect()] == [[9.0]]


def test_stream_folds_as_the_batch_does(spark, tmp_path):
    rows = [("p", k % 3, "c", k % 5, "abc"[k % 2], 0.3 + (k % 7) / 10, k, None) for k in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    land = tmp_path / "in"
    for part in range(3):
        df.filter(f"seq div 20 = {part}").coalesce(1).write.mode("append").parquet(str(land))
        updates = streaming.fold_stream(streaming.landing(spark, str(land), SCHEMA))
        seen = []
        query = streaming.into_table(updates, str(tmp_path / "ck"), lambda batch, n: seen.extend(batch.collect()))
        query.awaitTermination()
        assert len(seen) == 20
    last = {}
    for r in seen:
        last[r.entity_id] = r.canonical_value
    assert last == {r.entity_id: r.canonical_value for r in claims.fold(df).collect()}


def test_windows_and_sessions(spark, tmp_path):
    events = spark.sql("SELECT timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,m,0) AS ts, 1L AS user_id, 'view' AS event_type, 1.0D AS value FROM VALUES (0), (10), (25), (120), (130) AS t(m)")
    assert [r.n for r in streaming.window_counts(events, "1 hour").orderBy("window_start").collect()] == [3, 2]
    assert streaming.window_counts(events, "1 hour", "30 minutes").count() == 4
    assert [r.n for r in streaming.sessions(events, "30 minutes").orderBy("session_start").collect()] == [3, 2]
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    query = streaming.window_counts(stream, "1 hour").writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "w")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.n for r in spark.sql("SELECT n FROM windows").collect()) == [2, 3]
    repeated = spark.createDataFrame([("p", 1, "c", 1, "a", 0.5, k, None) for k in range(2)], SCHEMA).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    repeated.write.parquet(str(tmp_path / "r"))
    once = streaming.once_per_document(spark.readStream.schema(repeated.schema).parquet(str(tmp_path / "r")))
    query = once.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "o")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT * FROM once").count() == 1
