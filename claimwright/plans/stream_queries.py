"""Registered queries that run as streams, and of the incremental store, with their SQL.

A table arrives in pieces: each lands in a folder, the stream runs over what has landed,
and its sink after the last piece is the result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimwright.operators import claims
from claimwright.plans.queries import _CLAIMS_SQL, ORACLES, _claims, _query
from claimwright.plans.registry import CLAIM_CONFIDENCE_DELTA, LOW_CONFIDENCE
from claimwright.sources.lineage import shared_folder
from claimwright.streaming import claims as streaming


def _streamed(rows: DataFrame, order: str, updates: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """The sink of a stream of `rows`, run after each piece of them has landed."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    for piece in streaming.in_arrivals(rows, order):
        piece.write.mode("append").parquet(f"{folder}/landing")
        found = streaming.run(updates(streaming.landing(spark, f"{folder}/landing", schema)), folder, mode)
    return found


@_query(f"WITH {_CLAIMS_SQL} SELECT DISTINCT entity_id, column_name, document_id FROM c")
def stream_once_per_document(t):
    """Arrivals of a document's claim about a cell, each once, however often and late it is said again."""
    found = _streamed(_claims(t).withColumn("ts", F.col("ts").cast("timestamp")), "seq", lambda s: streaming.once_per_document(s, delay="1000 days"))
    return found.select("entity_id", "column_name", "document_id")


@_query(ORACLES["tumbling_window"])
def stream_windows(t):
    """Windows as the stream last stated them."""
    found = _streamed(t("events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", streaming.window_counts, "update")
    last = found.groupBy("window_start", "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total"))
    return last.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


# The machine in SQL: a recursion over each key's claims in order of arrival, with all rows of the key as a list of structs
_ROW = "STRUCT(d BIGINT, v VARCHAR, c DOUBLE, s VARCHAR, n INTEGER)"
_FOUGHT = f"rivals AND (x.d = pd OR x.v IS DISTINCT FROM pv AND top - x.c <= {CLAIM_CONFIDENCE_DELTA})"


def _fold_sql(source: str) -> str:
    """Steps of a source c (entity_id, column_name, document_id, value, confidence, seq): m has a row a claim, with the key's rows after it."""
    make = lambda d, v, c, s, n: f"CAST(struct_pack(d := {d}, v := {v}, c := {c}, s := {s}, n := {n}) AS {_ROW})"
    mine = lambda s, n="NULL": make("d", "v", "c", s, n)
    turned = lambda s, n="NULL": f"list_transform(rows, lambda x: CASE WHEN x.s = 'active' THEN {make('x.d', 'x.v', 'x.c', s, n)} ELSE x END)"
    judged = make("x.d", "x.v", "x.c", f"CASE WHEN {_FOUGHT} THEN 'conflicted' WHEN x.v IS NOT DISTINCT FROM pv OR rivals THEN 'active' ELSE 'superseded' END", f"CASE WHEN {_FOUGHT} THEN groups + 1 END")
    return f"""WITH RECURSIVE {source},
o AS (SELECT *, row_number() OVER (PARTITION BY entity_id, column_name ORDER BY seq) AS rn, count(*) OVER (PARTITION BY entity_id, column_name) AS last FROM c),
m AS (SELECT entity_id, column_name, CAST(0 AS BIGINT) AS rn, last, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS document_id, CAST([] AS {_ROW}[]) AS rows, CAST(NULL AS VARCHAR) AS value, CAST(0 AS BIGINT) AS groups, '' AS outcome FROM o WHERE rn = 1
UNION ALL
SELECT entity_id, column_name, rn, last, seq, d, CASE how WHEN 'rejected' THEN rows WHEN 'refreshed' THEN list_transform(rows2, lambda x: {judged}) WHEN 'revalued' THEN list_transform(rows2, lambda x: {judged})
  WHEN 'joined' THEN list_append(rows, {mine("'active'")}) WHEN 'won' THEN list_append({turned("'superseded'")}, {mine("'active'")}) WHEN 'inserted_superseded' THEN list_append(rows, {mine("'superseded'")})
  ELSE list_append({turned("'conflicted'", "groups + 1")}, {mine("'conflicted'", "groups + 1")}) END,
  CASE WHEN how IN ('refreshed', 'revalued') THEN pv WHEN how = 'won' OR how = 'joined' AND len(act) = 0 THEN v ELSE value END,
  groups + CASE WHEN how = 'inserted_conflicted' OR how IN ('refreshed', 'revalued') AND rivals THEN 1 ELSE 0 END, CASE WHEN how IN ('joined', 'won') THEN 'inserted_active' ELSE how END
FROM (SELECT *, CASE WHEN c IS NULL OR c < {LOW_CONFIDENCE} THEN 'rejected' WHEN len(known) > 0 THEN CASE WHEN known[1].v IS NOT DISTINCT FROM v THEN 'refreshed' ELSE 'revalued' END
    WHEN len(act) = 0 OR len(list_filter(act, lambda x: x.v IS NOT DISTINCT FROM v)) > 0 THEN 'joined' WHEN gap > {CLAIM_CONFIDENCE_DELTA} THEN 'won' WHEN gap < -{CLAIM_CONFIDENCE_DELTA} THEN 'inserted_superseded' ELSE 'inserted_conflicted' END AS how,
    len(list_filter(rows2, lambda x: x.v IS DISTINCT FROM pv AND top - x.c <= {CLAIM_CONFIDENCE_DELTA})) > 0 AS rivals
  FROM (SELECT *, list_filter(rows2, lambda x: x.c = top)[1].v AS pv, list_filter(rows2, lambda x: x.c = top)[1].d AS pd
    FROM (SELECT *, list_max(list_transform(rows2, lambda x: x.c)) AS top, c - list_max(list_transform(act, lambda x: x.c)) AS gap
      FROM (SELECT m.entity_id, m.column_name, o.rn, m.last, m.rows, m.value, m.groups, o.document_id AS d, o.value AS v, o.confidence AS c, o.seq,
          list_filter(m.rows, lambda x: x.d = o.document_id) AS known, list_filter(m.rows, lambda x: x.s = 'active') AS act,
          list_transform(m.rows, lambda x: CASE WHEN x.d = o.document_id THEN {make('x.d', 'o.value', 'o.confidence', 'x.s', 'x.n')} ELSE x END) AS rows2
        FROM m JOIN o ON m.entity_id = o.entity_id AND m.column_name = o.column_name AND o.rn = m.rn + 1)))))
"""


_FOLDED = "SELECT entity_id, column_name, x.d AS document_id, x.v AS value, x.c AS confidence, x.s AS status, x.n AS conflict_no, value AS canonical_value FROM (SELECT entity_id, column_name, value, unnest(rows) AS x FROM m WHERE rn = last)"


@_query(_fold_sql(_CLAIMS_SQL) + _FOLDED)
def claims_incremental_fold(t):
    return claims.fold(_claims(t)).drop("entity_table")


_EDGE_CLAIMS_SQL = """c AS (SELECT o_custkey AS entity_id, 'role' AS column_name, o_orderkey % 12 AS document_id, o_orderpriority AS value, 0.25 + (o_orderkey % 8) / 10.0::DOUBLE AS confidence, o_orderkey AS seq FROM orders
UNION ALL SELECT o_custkey, 'end_date', o_orderkey % 12, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y') END, 0.25 + (o_orderkey % 7) / 10.0::DOUBLE, o_orderkey FROM orders)"""


@_query(_fold_sql(_EDGE_CLAIMS_SQL) + _FOLDED)
def claims_edge_attributes(t):
    """Roles and end dates of edges, some of them null, through the same machine."""
    o, k = t("orders"), F.col("o_orderkey")
    said = lambda name, value, n: o.select(F.lit("employment").alias("entity_table"), F.col("o_custkey").alias("entity_id"), F.lit(name).alias("column_name"), (k % 12).alias("document_id"), value.alias("value"), (0.25 + (k % n) / 10.0).alias("confidence"), k.alias("seq"))
    ended = F.when(k % 3 != 0, F.date_format("o_orderdate", "yyyy"))
    return claims.fold(said("role", F.col("o_orderpriority"), 8).union(said("end_date", ended, 7))).drop("entity_table")


@_query(_fold_sql(_CLAIMS_SQL) + "SELECT entity_id, column_name, document_id, seq, outcome, value AS canonical_value FROM m WHERE rn > 0")
def stream_claims_fold(t):
    """What became of each claim as it arrived, with the machines of some tens of keys an entry of state."""
    found = _streamed(_claims(t).drop("ts"), "seq", streaming.fold_stream)
    return found.select("entity_id", "column_name", "document_id", "seq", "outcome", "canonical_value")
