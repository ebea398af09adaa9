"""Registered queries through the store's own files: logs, swapped tables, extracted files, reports, cached vectors and the gate, and their SQL."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from claimwright.operators import reports
from claimwright.plans import gate, ingest
from claimwright.plans.queries import _RESOLVE_SQL, _query, _resolved
from claimwright.plans.span_queries import _REPORTS_SQL
from claimwright.sources import files, formats
from claimwright.sources.lineage import shared_folder


def _folder(df) -> str:
    return f"{shared_folder(df.sparkSession)}/store-{uuid.uuid4().hex}"


@_query("SELECT event_id, event_type, user_id FROM events")
def log_appended(t):
    """A log that grows by three appends."""
    e = t("events").select("event_id", "event_type", "user_id")
    path = _folder(e)
    for k in range(3):
        files.append_log(e.filter(F.col("event_id") % 3 == k), path)
    return e.sparkSession.read.parquet(path)


@_query("SELECT c_nationkey, c_custkey, upper(c_name) AS c_name FROM customer")
def table_swapped(t):
    """A partitioned table that is written, read and swapped for what was made of it."""
    c = t("customer").select("c_custkey", "c_name", "c_nationkey")
    spark, path = c.sparkSession, _folder(c)
    files.write_table(c, path, ["c_nationkey"])
    files.write_table(spark.read.parquet(path).withColumn("c_name", F.upper("c_name")), path, ["c_nationkey"])
    return spark.read.parquet(path).select(F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_custkey", "c_name")


@_query("SELECT trim(p_name) AS line, count(*) AS n FROM part GROUP BY 1")
def files_extracted(t):
    """Text files read whole, with their header, and cut into lines again."""
    p = t("part").select(F.trim("p_name").alias("value"))
    path = _folder(p)
    p.write.text(path)
    found = files.extract_files(p.sparkSession, f"{path}/*.txt")
    body = F.regexp_replace("body", r"^<!-- source: [^>]* -->\n\n", "")
    lines = found.filter("problem IS NULL").select(F.explode(F.split(body, "\n")).alias("line")).filter("line <> ''")
    return lines.groupBy("line").agg(F.count("*").alias("n"))


@_query("SELECT upper(trim(p_name)) AS line, count(*) AS n FROM part GROUP BY 1")
def texts_read_whole(t):
    """The same files through the plain text reader."""
    p = t("part").select(F.upper(F.trim("p_name")).alias("value"))
    path = _folder(p)
    p.write.text(path)
    lines = files.read_texts(p.sparkSession, f"{path}/*.txt").select(F.explode(F.split("body", "\n")).alias("line")).filter("line <> ''")
    return lines.groupBy("line").agg(F.count("*").alias("n"))


@_query(f"WITH {_REPORTS_SQL.replace('FROM events', 'FROM (SELECT user_id % 40 AS user_id, value FROM events)', 1)} SELECT user_id, stage, round(avg(x.v), 6) AS score, stage <> 'query' AS failed FROM h GROUP BY user_id, stage")
def reports_listed(t):
    """Forty reports over all events, written as files by the writer and listed by the reader."""
    stage = F.element_at(F.array(*map(F.lit, (*reports.HEADLINES, "other"))), (F.col("user_id") % 5 + 1).cast("int"))
    g = t("events").groupBy((F.col("user_id") % 40).alias("user_id")).agg((F.avg("value") / 100).alias("a"), F.max("value").alias("b")).withColumn("b", F.when(F.col("user_id") % 3 != 0, F.col("b") / 1000)).withColumn("stage", stage)
    spark, path = g.sparkSession, _folder(g)
    names = F.when(F.lit(False), F.array().cast("array<string>"))
    for name, columns in {**reports.HEADLINES, "other": {"first": "first", "second": "second"}}.items():
        names = names.when(F.col("stage") == name, F.array(*[F.lit(f"{c}_mean") for c in list(columns.values())[:2]]))
    meta = F.struct("stage", F.lit("2024").alias("timestamp_utc"), F.col("user_id").cast("string").alias("tag"))
    case = F.struct(F.lit(True).alias("sql_ok"))
    result = F.struct(F.map_filter(F.map_from_arrays(names, F.array("a", "b")), lambda _, v: v.isNotNull()).alias("aggregate"), F.array(case).alias("per_case"))
    formats.register(spark)
    made = g.select(F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("name"), F.to_json(F.struct(meta.alias("meta"), result.alias("result"))).alias("report"))
    made.write.format("reports").mode("append").save(path)
    found = reports.listing(spark.read.format("reports").load(path))
    return found.select(F.col("tag").cast("bigint").alias("user_id"), "stage", F.round("score", 6).alias("score"), "failed")


def _measured(text: str) -> list[float]:
    if len(text) % 5 == 0:
        raise ValueError("the model refuses")
    return [float(len(text)), float(pd.Series(list(text[:50])).nunique())]


@_query("""SELECT doc_id, sha1('small|' || text) AS key, CASE WHEN min(doc_id) OVER (PARTITION BY text) % 3 = 0 THEN -1.0 WHEN length(text) % 5 = 0 THEN NULL ELSE CAST(length(text) AS DOUBLE) END AS size FROM documents WHERE text IS NOT NULL""")
def embedding_cache(t):
    """Vectors from a cache that has some of the texts; the others are embedded once, and what the model refuses has none."""
    d = t("documents").filter("text IS NOT NULL").select("doc_id", "text")
    first = d.groupBy("text").agg(F.min("doc_id").alias("first")).filter("first % 3 = 0")
    cache = first.select(F.sha1(F.concat(F.lit("small|"), "text")).alias("key"), F.array(F.lit(-1.0).cast("float")).alias("vec"))
    found, _ = files.cached_embeddings(d, cache, "small", _measured)
    return found.select("doc_id", "key", F.col("vec")[0].cast("double").alias("size"))


@_query(_RESOLVE_SQL + """, a AS (SELECT * FROM resolved WHERE status = 'active') SELECT b.column_name, count(*) AS n FROM a JOIN a b ON a.entity_id = b.entity_id AND a.column_name < b.column_name WHERE a.column_name = 'click' GROUP BY b.column_name""")
def gate_self_join(t):
    """A self-join that asks for the status of one side only: the gate reads active rows on the other."""
    resolved = _resolved(t)
    resolved.createOrReplaceTempView("user_claims")
    return gate.run(resolved.sparkSession, "SELECT b.column_name, count(*) AS n FROM user_claims a JOIN user_claims b ON a.entity_id = b.entity_id AND a.column_name <> b.column_name WHERE a.status = 'active' AND a.column_name = 'click' GROUP BY b.column_name")


@_query(_RESOLVE_SQL + """SELECT column_name, count(DISTINCT value) AS "values", count(*) AS n FROM resolved r WHERE status = 'active' AND EXISTS (SELECT 1 FROM resolved y WHERE y.status = 'superseded' AND y.entity_id = r.entity_id) GROUP BY column_name""")
def gate_subquery_status(t):
    """A status in a subquery doesn't stand for the outer table's."""
    resolved = _resolved(t)
    resolved.createOrReplaceTempView("user_claims")
    return gate.run(resolved.sparkSession, "SELECT column_name, count(DISTINCT value) AS `values`, count(*) AS n FROM user_claims x WHERE EXISTS (SELECT 1 FROM user_claims y WHERE y.status = 'superseded' AND y.entity_id = x.entity_id) GROUP BY column_name")


@_query("SELECT p_brand, count(*) AS n, strftime(DATE '1998-01-01', '%Y/%m') AS month FROM part WHERE p_name ILIKE '%RING%' AND p_name NOT ILIKE 'B%' GROUP BY p_brand")
def gate_sqlite(t):
    """A question in SQLite's words through the gate, whose LIKE knows no case there."""
    p = t("part")
    p.createOrReplaceTempView("part")
    return gate.run(p.sparkSession, "SELECT p_brand, count(*) AS n, strftime('%Y/%m', '1998-01-01') AS month FROM part WHERE p_name LIKE '%RING%' AND p_name NOT LIKE 'B%' GROUP BY p_brand", sqlite=True)


_INGEST_SQL = """d AS (SELECT p_partkey AS k, p_brand AS b, 'the ' || p_name || ' ' || p_partkey AS n, p_type AS y, CASE WHEN p_partkey % 7 = 0 THEN 0.2 ELSE 0.9 END AS c FROM part)
SELECT 'claim' AS kind, 'organization' AS a, 'canonical_name' AS b, b AS c, k AS document_id FROM d UNION ALL SELECT 'claim', 'organization', 'headquarters', 'town of ' || b, k FROM d WHERE k % 2 = 0
UNION ALL SELECT 'claim', 'product', 'canonical_name', n, k FROM d WHERE c > 0.3 UNION ALL SELECT 'claim', 'product', 'category', y, k FROM d WHERE c > 0.3
UNION ALL SELECT 'staging', 'unknown_column', 'organization', 'colour', k FROM d UNION ALL SELECT 'staging', 'low_confidence', 'product', 'canonical_name', k FROM d WHERE c < 0.3 UNION ALL SELECT 'staging', 'low_confidence', 'product', 'category', k FROM d WHERE c < 0.3
UNION ALL SELECT 'edge', 'manufacturing', NULL, NULL, k FROM d UNION ALL SELECT 'weak', 'praises', 'organization', 'the sea', k FROM d WHERE k % 3 = 0"""


@_query(f"WITH {_INGEST_SQL}")
def ingest_store(t):
    """Whole extractions of a text a part: claims, staged cells, edges and weak relations that come of them; one name isn't in its text."""
    p, k = t("part"), F.col("p_partkey")
    name = F.concat(F.lit("the "), "p_name", F.lit(" "), k.cast("string"))
    cells = lambda *pairs: F.map_from_entries(F.array(*[F.struct(F.lit(n), v) for n, v in pairs]))
    entity = lambda kind, title, attributes, sure: F.struct(F.lit(kind).alias("proposed_type"), title.alias("canonical_name"), attributes.alias("attributes"), sure.alias("confidence"))
    town = F.when(k % 2 == 0, F.concat(F.lit("town of "), "p_brand")).otherwise("")
    found = F.array(
        entity("organization", F.col("p_brand"), cells(("headquarters", town), ("colour", F.lit("red"))), F.lit(0.9)), entity("product", name, cells(("category", F.col("p_type"))), F.when(k % 7 == 0, 0.2).otherwise(0.9)),
        entity("person", F.lit("Nobody Here"), cells(("birth_date", F.lit("1990"))), F.lit(0.9)),
    )
    made = F.array(F.struct(F.lit("manufacturing").alias("proposed_junction"), name.alias("from"), F.col("p_brand").alias("to"), F.lit(0.9).alias("confidence")))
    said = F.when(k % 3 == 0, F.array(F.struct(F.col("p_brand").alias("subject"), F.lit("praises").alias("predicate"), F.lit("the sea").alias("object"), F.lit(0.9).alias("confidence")))).otherwise(F.array())
    raw = p.select(k.alias("document_id"), F.to_json(F.struct(found.alias("entities"), made.alias("relations"), said.alias("weak_relations"))).alias("raw"))
    docs = p.select(k.alias("document_id"), F.concat("p_brand", F.lit(" makes "), name, F.lit(".")).alias("body"), k.alias("arrival"))
    out = ingest.ingest(raw, docs)
    none = F.lit(None).cast("string")
    cell = lambda field: F.get_json_object("payload", f"$.{field}")
    parts = [
        out["claims"].select(F.lit("claim").alias("kind"), F.col("entity_table").alias("a"), F.col("column_name").alias("b"), F.col("value").alias("c"), "document_id"),
        out["staging"].select(F.lit("staging"), "reason", cell("proposed_type"), cell("column_name"), "document_id"), out["edges"].select(F.lit("edge"), "junction", none, none, "document_id"),
        out["weak"].select(F.lit("weak"), "predicate", "subject_table", "object_text", "document_id"),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])
