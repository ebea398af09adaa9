"""The registered queries of the engine's own operators over the driver's tables, and their SQL.

The tables hold no knowledge graph, so they stand in for one: events are claims (user,
event type, value k), lineitem gives edges and existence claims, orders and customers
relations, documents and benchmark the texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimwright.functions.confidence import mean_confidence
from claimwright.functions.names import strip_name
from claimwright.functions import tables
from claimwright.functions.text import chunk_documents, parse_payload, terms
from claimwright.operators import audit, claims, edges, entities, evaluation, grounding, routing, search
from claimwright.operators.textindex import TextIndex
from claimwright.plans import catalog, gate
from claimwright.plans.registry import FTS_TOP, Registry
from claimwright.sources.lineage import shared_folder
from claimwright.streaming.claims import sessions, window_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable:
    def register(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Stand-ins --------------------------------------------------------------------------


def _claims(t: Callable[[str], DataFrame]) -> DataFrame:
    e = t("events")
    return e.select(
        F.lit("user").alias("entity_table"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("column_name"),
        F.get_json_object("props", "$.k").alias("value"), (F.col("event_id") % 20).alias("document_id"), F.lit(None).cast("string").alias("evidence"),
        F.least(F.col("value") / 300, F.lit(1.0)).alias("confidence"), F.col("event_id").alias("seq"), "ts",
    )


_CLAIMS_SQL = """c AS (SELECT user_id AS entity_id, event_type AS column_name, json_extract_string(props, '$.k') AS value, event_id % 20 AS document_id,
  least(value / 300, 1.0) AS confidence, event_id AS seq, ts FROM events)"""

_RESOLVE_SQL = f"""WITH {_CLAIMS_SQL},
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, column_name, document_id ORDER BY seq DESC) AS rn,
        min(seq) OVER (PARTITION BY entity_id, column_name, document_id) AS created_seq FROM c WHERE confidence >= 0.3) WHERE rn = 1),
p AS (SELECT *, first_value(confidence) OVER w AS pc, first_value(value) OVER w AS pv, first_value(document_id) OVER w AS pd FROM l
      WINDOW w AS (PARTITION BY entity_id, column_name ORDER BY confidence DESC, created_seq, value, document_id)),
q AS (SELECT *, value <> pv AND pc - confidence <= 0.1 AS rival FROM p),
r AS (SELECT *, bool_or(rival) OVER (PARTITION BY entity_id, column_name) AS fought FROM q),
resolved AS (SELECT entity_id, column_name, document_id, value, confidence, pv AS pivot_value, pc AS pivot_confidence, created_seq,
  CASE WHEN rival OR (document_id = pd AND fought) THEN 'conflicted' WHEN value = pv THEN 'active' ELSE 'superseded' END AS status FROM r)
"""


def _resolved(t: Callable[[str], DataFrame]) -> DataFrame:
    return claims.resolve(claims.split_low_confidence(_claims(t)).filter("route = 'accepted'"))


# Claims -----------------------------------------------------------------------------


@_query(_RESOLVE_SQL + "SELECT entity_id, column_name, document_id, value, confidence, pivot_value, status FROM resolved")
def claims_resolve(t):
    return _resolved(t).select("entity_id", "column_name", "document_id", "value", "confidence", "pivot_value", "status")


@_query(f"WITH {_CLAIMS_SQL} SELECT seq, confidence, CASE WHEN confidence >= 0.3 THEN 'accepted' ELSE 'rejected' END AS route FROM c")
def claims_low_conf_split(t):
    return claims.split_low_confidence(_claims(t)).select("seq", "confidence", "route")


@_query(f"""WITH {_CLAIMS_SQL} SELECT entity_id, column_name, document_id, value, confidence, seq, created_seq FROM (
SELECT *, row_number() OVER (PARTITION BY entity_id, column_name, document_id ORDER BY seq DESC) AS rn,
min(seq) OVER (PARTITION BY entity_id, column_name, document_id) AS created_seq FROM c) WHERE rn = 1""")
def claims_upsert_latest(t):
    return claims.latest(_claims(t)).select("entity_id", "column_name", "document_id", "value", "confidence", "seq", "created_seq")


@_query(_RESOLVE_SQL + "SELECT status, count(*) AS n FROM resolved GROUP BY status")
def claims_status_histogram(t):
    return claims.status_histogram(_resolved(t))


@_query(_RESOLVE_SQL + "SELECT entity_id, column_name, value, count(DISTINCT document_id) AS support FROM resolved WHERE status = 'active' GROUP BY ALL")
def claims_support_count(t):
    return claims.support(_resolved(t)).drop("entity_table")


@_query(f"WITH {_CLAIMS_SQL} SELECT entity_id, column_name, CAST(greatest(count(DISTINCT value) - 1, 0) AS BIGINT) AS flips FROM c GROUP BY ALL")
def claims_flips(t):
    return claims.flips(_claims(t)).drop("entity_table")


@_query(_RESOLVE_SQL + """SELECT entity_id, """ + ", ".join(f"TRY_CAST(max(CASE WHEN column_name = '{c}' THEN pivot_value END) AS BIGINT) AS {c}" for c in ("click", "error", "purchase", "signup", "view")) + " FROM resolved GROUP BY entity_id")
def claims_canonical_pivot(t):
    return claims.canonical_table(_resolved(t), "user", dict.fromkeys(("click", "error", "purchase", "signup", "view"), "bigint"))


@_query(f"""WITH {_CLAIMS_SQL}, h AS (SELECT entity_id, column_name, seq, value, lag(value) OVER (PARTITION BY entity_id, column_name ORDER BY seq) AS previous_value FROM c)
SELECT *, value IS DISTINCT FROM previous_value AS changed FROM h""")
def claims_history_lag(t):
    return claims.history(_claims(t)).select("entity_id", "column_name", "seq", "value", "previous_value", "changed")


@_query(_RESOLVE_SQL + "SELECT entity_id, column_name, document_id, 'user_' || column_name AS kind FROM resolved WHERE status = 'conflicted'")
def claims_conflict_groups(t):
    return claims.conflict_groups(_resolved(t)).select("entity_id", "column_name", "document_id", "kind")


@_query(f"""WITH {_CLAIMS_SQL}, k AS (SELECT *, CASE column_name WHEN 'click' THEN 'org_type' WHEN 'view' THEN 'founded_year' ELSE column_name END AS cn FROM c)
SELECT seq, CASE WHEN cn NOT IN ('org_type', 'founded_year') THEN 'unknown_column' WHEN cn = 'org_type' THEN 'enum' END AS violation FROM k""")
def claims_validation(t):
    renamed = F.when(F.col("column_name") == "click", "org_type").when(F.col("column_name") == "view", "founded_year").otherwise(F.col("column_name"))
    rows = _claims(t).withColumn("entity_table", F.lit("organization")).withColumn("column_name", renamed)
    return claims.violations(rows).select("seq", "violation")


@_query("""WITH e AS (SELECT l_partkey * 1000000 + l_suppkey AS edge_id, l_orderkey AS document_id, l_orderkey * 10 + l_linenumber AS seq, 1 - l_discount * 3 AS confidence, l_quantity FROM lineitem),
l AS (SELECT edge_id, document_id, arg_max(confidence, (seq, l_quantity)) AS confidence, min(seq) AS created_seq FROM e GROUP BY ALL),
p AS (SELECT *, max(confidence) OVER (PARTITION BY edge_id) AS best_confidence FROM l)
SELECT edge_id, document_id, confidence, best_confidence, CASE WHEN best_confidence - confidence > 0.1 THEN 'superseded' ELSE 'active' END AS status FROM p""")
def existence_resolve(t):
    li = t("lineitem").groupBy((F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("edge_id"), F.col("l_orderkey").alias("document_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    rows = li.agg(F.max_by(1 - F.col("l_discount") * 3, "l_quantity").alias("confidence"))
    return claims.existence_resolve(rows).select("edge_id", "document_id", "confidence", "best_confidence", "status")


# Names and entities -----------------------------------------------------------------

#: Names that share a key with a part's, as another source would spell them.
_NAMES_SQL = """n AS (SELECT 'part' AS entity_table, p_name AS name, p_partkey AS seq FROM part UNION ALL
SELECT 'part', upper(replace(p_name, ' ', '-')) || ' Inc.', p_partkey + 1000000 FROM part UNION ALL
SELECT 'customer', c_name, c_custkey FROM customer)"""
_KEY_SQL = "regexp_replace(" + "replace(" * 18 + "trim(lower({}))" + "".join(f", '{x}', '')" for x in ("corporation", "株式会社", "有限会社", "合同会社", "corp.", "inc.", "（株）", "(株)", "corp", "ltd.", "k.k.", "inc", "co.", "ltd", "llc", "㈱", "co", "kk")) + r", '[\s　_,.\-・()（）]+', '', 'g')"


def _names(t: Callable[[str], DataFrame]) -> DataFrame:
    p = t("part")
    one = p.select(F.lit("part").alias("entity_table"), F.col("p_name").alias("name"), F.col("p_partkey").alias("seq"))
    two = p.select(F.lit("part"), F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit(" Inc.")), F.col("p_partkey") + 1000000)
    return one.union(two).union(t("customer").select(F.lit("customer"), "c_name", "c_custkey"))


@_query(f"WITH {_NAMES_SQL} SELECT DISTINCT name, {_KEY_SQL.format('name')} AS norm_key FROM n")
def norm_key_ascii(t):
    return _names(t).select("name").distinct().select("name", strip_name("name").alias("norm_key"))


@_query(f"""WITH {_NAMES_SQL}, k AS (SELECT *, {_KEY_SQL.format('name')} AS norm_key FROM n),
f AS (SELECT *, min(seq) OVER (PARTITION BY entity_table, norm_key) AS first_seq, first_value(name) OVER (PARTITION BY entity_table, norm_key ORDER BY seq) AS canonical_name FROM k)
SELECT entity_table, name, seq, norm_key, first_seq, canonical_name, CASE WHEN norm_key = '' THEN 'invalid' WHEN seq = first_seq THEN 'new' ELSE 'exact' END AS how FROM f""")
def entity_upsert(t):
    return entities.upsert_entities(_names(t)).drop("entity_id")


@_query(f"""WITH n AS (SELECT s_name AS name, s_suppkey AS seq FROM supplier UNION ALL SELECT 'Vendor ' || s_suppkey || ' Ltd.', 10000000 + s_suppkey FROM supplier UNION ALL SELECT c_name, 20000000 + c_custkey FROM customer),
k AS (SELECT *, {_KEY_SQL.format('name')} AS norm_key FROM n), s AS (SELECT s_suppkey AS id, s_name, {_KEY_SQL.format('s_name')} AS key FROM supplier), a AS (SELECT s_suppkey AS id, s_name, 'vendor' || s_suppkey AS key FROM supplier)
SELECT k.name, k.norm_key, coalesce(s.s_name, a.s_name, k.name) AS canonical_name, CASE WHEN s.id IS NOT NULL THEN 'exact' WHEN a.id IS NOT NULL THEN 'alias' ELSE 'new' END AS how, coalesce(s.id, a.id) AS stored_id
FROM k LEFT JOIN s ON k.norm_key = s.key LEFT JOIN a ON k.norm_key = a.key""")
def entity_upsert_aliases(t):
    """Names that are stored, names that are an alias' and have its entity's id, and new ones."""
    s = t("supplier")
    table = F.lit("supplier").alias("entity_table")
    arriving = s.select(table, F.col("s_name").alias("name"), F.col("s_suppkey").alias("seq"))
    arriving = arriving.union(s.select(table, F.concat(F.lit("Vendor "), F.col("s_suppkey").cast("string"), F.lit(" Ltd.")), F.col("s_suppkey") + 10000000))
    arriving = arriving.union(t("customer").select(table, "c_name", F.col("c_custkey") + 20000000))
    stored = s.select(table, F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), strip_name("s_name").alias("norm_key"))
    aliases = s.select(table, F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.concat(F.lit("vendor"), F.col("s_suppkey").cast("string")).alias("norm_key"))
    met = entities.upsert_entities(arriving, stored, aliases)
    return met.select("name", "norm_key", "canonical_name", "how", F.when(F.col("how").isin("exact", "alias"), F.col("entity_id")).alias("stored_id"))


_TRIGRAM_SQL = "list_distinct(list_transform(range(1, len({0}) + 2), lambda i: substr('  ' || {0} || ' ', i, 3)))"
_JACCARD_SQL = "CAST(len(list_intersect({0}, {1})) AS DOUBLE) / len(list_distinct(list_concat({0}, {1})))"


@_query(f"""WITH k AS (SELECT DISTINCT replace(p_name, ' ', '') || lower(p_type) AS k FROM part), g AS (SELECT k, {_TRIGRAM_SQL.format('k')} AS t FROM k)
SELECT a.k AS l, b.k AS r, round({_JACCARD_SQL.format('a.t', 'b.t')}, 6) AS score FROM g a, g b WHERE a.k < b.k AND {_JACCARD_SQL.format('a.t', 'b.t')} >= 0.5""")
def trigram_self_join(t):
    keys = t("part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lower("p_type")).alias("l")).distinct()
    found = entities.similarity_join(keys, keys.withColumnRenamed("l", "r"), 0.5)
    return found.filter("l < r").select("l", "r", F.round("score", 6).alias("score"))


_CANDIDATES_SQL = f"""WITH e AS (SELECT 'part' AS entity_table, min(p_partkey) AS entity_id, replace(p_name, ' ', '') AS k FROM part GROUP BY p_name UNION ALL
SELECT 'nation', n_nationkey, replace(lower(n_name), '_', '') FROM nation UNION ALL SELECT 'region', r_regionkey, replace(lower(r_name), ' ', '') FROM region),
q AS (SELECT n_nationkey AS query_id, 'nations' || n_nationkey AS k FROM nation UNION ALL SELECT 100 + min(p_partkey), replace(p_name, ' ', '') || 's' FROM part GROUP BY p_name),
s AS (SELECT query_id, entity_table, entity_id, q.k = e.k AS norm_match, {_JACCARD_SQL.format('qt', 'et')} AS score
FROM (SELECT *, {_TRIGRAM_SQL.format('k')} AS qt FROM q) q, (SELECT *, {_TRIGRAM_SQL.format('k')} AS et FROM e) e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id{{}} ORDER BY norm_match DESC, score DESC, entity_table, entity_id) AS rank FROM s WHERE score >= 0.3 OR norm_match)
"""


def _candidate_sides(t: Callable[[str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    parts = t("part").groupBy("p_name").agg(F.min("p_partkey").alias("id")).select(F.col("id"), F.replace("p_name", F.lit(" "), F.lit("")).alias("k"))
    nations = t("nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.replace(F.lower("n_name"), F.lit("_"), F.lit("")).alias("k"))
    regions = t("region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.replace(F.lower("r_name"), F.lit(" "), F.lit("")).alias("k"))
    known = [d.select(F.lit(name).alias("entity_table"), F.col("id").alias("entity_id"), F.col("k").alias("norm_key")) for name, d in (("part", parts), ("nation", nations), ("region", regions))]
    asked = t("nation").select(F.col("n_nationkey").cast("bigint").alias("query_id"), F.concat(F.lit("nations"), F.col("n_nationkey").cast("string")).alias("norm_key"))
    asked = asked.union(parts.select(F.col("id") + 100, F.concat("k", F.lit("s"))))
    return asked, evaluation.union_all(known)


@_query(_CANDIDATES_SQL.format(", entity_table") + "SELECT query_id, entity_table, entity_id, norm_match, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5")
def entity_candidates_topk(t):
    return entities.candidates(*_candidate_sides(t)).select("query_id", "entity_table", "entity_id", "norm_match", "score", "rank")


@_query(_CANDIDATES_SQL.format(", entity_table") + """SELECT query_id, entity_table, entity_id, round(score, 4) AS score,
CAST(row_number() OVER (PARTITION BY query_id ORDER BY norm_match DESC, round(score, 4) DESC, entity_table, entity_id) AS INT) AS rank FROM r WHERE rank <= 3""")
def entity_candidates_across(t):
    return entities.candidates_across(*_candidate_sides(t)).select("query_id", "entity_table", "entity_id", "score", "rank")


@_query("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS item_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM s)
SELECT query_id, item_id, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""")
def cosine_topk(t):
    e = t("embeddings")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = search.cosine_top(asked, e.select(F.col("vec_id").alias("item_id"), "embedding"), 3)
    return found.select("query_id", "item_id", F.round("score", 4).alias("score"), "rank")


@_query(f"""WITH v AS (SELECT 'part.name' AS source, p_name AS value, replace(p_name, ' ', '') AS k FROM part GROUP BY ALL UNION ALL SELECT 'part.type', p_type, lower(p_type) FROM part GROUP BY ALL),
q AS (SELECT min(p_partkey) AS question_id, 'whichsuppliersmakethe' || replace(p_name, ' ', '') || 'incheap' || lower(min(p_type)) AS k FROM part GROUP BY p_name),
s AS (SELECT question_id, source, value, contains(q.k, v.k) AS c, {_JACCARD_SQL.format('qt', 'vt')} AS j
FROM (SELECT *, {_TRIGRAM_SQL.format('k')} AS qt FROM q) q, (SELECT *, {_TRIGRAM_SQL.format('k')} AS vt FROM v) v),
r AS (SELECT question_id, source, value, greatest(CAST(c AS DOUBLE), j) AS score FROM s WHERE c OR j >= 0.2),
w AS (SELECT *, row_number() OVER (PARTITION BY question_id, source ORDER BY score DESC, value) AS rank FROM r)
SELECT question_id, source, value, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM w WHERE rank <= 3""")
def hint_scores(t):
    p = t("part")
    values = p.select(F.lit("part.name").alias("source"), F.col("p_name").alias("value"), F.replace("p_name", F.lit(" "), F.lit("")).alias("v_key")).distinct()
    values = values.union(p.select(F.lit("part.type"), "p_type", F.lower("p_type")).distinct())
    asked = p.groupBy("p_name").agg(F.min("p_partkey").alias("question_id"), F.lower(F.min("p_type")).alias("type"))
    asked = asked.select("question_id", F.concat(F.lit("whichsuppliersmakethe"), F.replace("p_name", F.lit(" "), F.lit("")), F.lit("incheap"), "type").alias("q_key"))
    return search.column_hints(asked, values).select("question_id", "source", "value", F.round("score", 6).alias("score"), "rank")


# Edges ------------------------------------------------------------------------------

_EDGES_SQL = """e AS (SELECT l_partkey AS child_id, l_suppkey AS parent_id, epoch_us(l_shipdate) * 100 + l_orderkey * 8 + l_linenumber AS o, l_suppkey, l_quantity, l_extendedprice,
row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq, 1 - l_discount AS confidence, l_orderkey AS document_id FROM lineitem)"""


def _edges(t: Callable[[str], DataFrame]) -> DataFrame:
    """Part-supplier edges in order of arrival; the order is a key of the row itself, so no global sort is needed."""
    li = t("lineitem")
    arrival = F.struct(*[F.col(c).alias(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")])
    return li.select(F.col("l_partkey").alias("child_id"), F.col("l_suppkey").alias("parent_id"), arrival.alias("seq"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_orderkey").alias("document_id"))


_FIRST_SQL = f"""WITH {_EDGES_SQL}, f AS (SELECT *, min(seq) OVER (PARTITION BY child_id) AS fs, first_value(parent_id) OVER (PARTITION BY child_id ORDER BY seq) AS fp FROM e),
h AS (SELECT child_id, parent_id, document_id, fp AS first_parent, CASE WHEN seq = fs THEN 'new' WHEN parent_id = fp THEN 'existing' ELSE 'cardinality_violation' END AS how FROM f)
"""


@_query(_FIRST_SQL + "SELECT child_id, parent_id, document_id, how FROM h WHERE how = 'new'")
def edge_first_wins(t):
    return edges.first_wins(_edges(t), "child_id", "parent_id").filter("how = 'new'").select("child_id", "parent_id", "document_id", "how")


@_query(_FIRST_SQL + "SELECT child_id, parent_id, document_id, first_parent FROM h WHERE how = 'cardinality_violation'")
def edge_violations(t):
    return edges.first_wins(_edges(t), "child_id", "parent_id").filter("how = 'cardinality_violation'").select("child_id", "parent_id", "document_id", "first_parent")


@_query(f"WITH {_EDGES_SQL} SELECT child_id, parent_id, arg_min(document_id, seq) AS document_id, count(*) AS arrivals FROM e GROUP BY child_id, parent_id")
def edge_many_to_many(t):
    return edges.many_to_many(_edges(t), ["child_id", "parent_id"]).select("child_id", "parent_id", "document_id", "arrivals")


@_query("""WITH r AS (SELECT l_orderkey AS document_id, l_suppkey % 3 AS kind, 1 - l_discount AS confidence, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS idx FROM lineitem),
k AS (SELECT *, CASE WHEN kind = 2 THEN NULL ELSE kind END AS key FROM r),
w AS (SELECT *, CASE WHEN key IS NULL THEN idx ELSE first_value(idx) OVER (PARTITION BY document_id, key ORDER BY confidence DESC, idx) END AS winner_idx FROM k)
SELECT document_id, idx, confidence, winner_idx, CASE WHEN idx = winner_idx THEN 'winner' ELSE 'loser' END AS role FROM w""")
def indoc_winner_loser(t):
    at = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = t("lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_suppkey") % 3).alias("kind"), (1 - F.col("l_discount")).alias("confidence"), F.row_number().over(at).cast("bigint").alias("idx"))
    rows = rows.withColumn("key", F.when(F.col("kind") < 2, F.col("kind")))
    return edges.in_document_winners(rows, ["document_id", "key"]).select("document_id", "idx", "confidence", "winner_idx", "role")


@_query("""WITH RECURSIVE r AS (SELECT l_orderkey AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i, l_partkey % 5 AS p, l_suppkey % 5 AS v, 1 - l_discount AS c FROM lineitem),
g AS (SELECT d, list({'i': i, 'p': p, 'v': v, 'c': c, 'b': CAST(NULL AS BIGINT)} ORDER BY i) AS e FROM r WHERE p <> v GROUP BY d),
s AS (SELECT d, -1 AS node, e FROM g UNION ALL
SELECT d, node, CASE WHEN len(a) = 0 OR len(b) = 0 THEN e WHEN stays THEN list_transform(e, lambda x: CASE WHEN x.v = node AND x.b IS NULL THEN {'i': x.i, 'p': x.p, 'v': x.v, 'c': x.c, 'b': best_a} ELSE x END)
  ELSE list_transform(e, lambda x: CASE WHEN x.p = node AND x.b IS NULL THEN {'i': x.i, 'p': x.p, 'v': x.v, 'c': x.c, 'b': best_b} ELSE x END) END
FROM (SELECT *, round(list_sum(list_transform(a, lambda x: x.c)), 9) >= round(list_sum(list_transform(b, lambda x: x.c)), 9) AS stays,
    list_filter(a, lambda x: x.c = list_max(list_transform(a, lambda y: y.c)))[1].i AS best_a, list_filter(b, lambda x: x.c = list_max(list_transform(b, lambda y: y.c)))[1].i AS best_b
  FROM (SELECT d, node + 1 AS node, e, list_filter(e, lambda x: x.p = node + 1 AND x.b IS NULL) AS a, list_filter(e, lambda x: x.v = node + 1 AND x.b IS NULL) AS b FROM s WHERE node < 4)))
SELECT d AS document_id, x.i AS idx, x.b IS NULL AS kept, x.b AS winner_idx FROM (SELECT d, unnest(e) AS x FROM s WHERE node = 4)""")
def variant_direction(t):
    at = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = t("lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.row_number().over(at).cast("bigint").alias("idx"), (F.col("l_partkey") % 5).alias("parent_id"),
        (F.col("l_suppkey") % 5).alias("variant_id"), (1 - F.col("l_discount")).alias("confidence"),
    )
    return edges.variant_direction(rows.filter("parent_id <> variant_id"))


@_query("""SELECT r_name AS parent, n_name AS child, count(c_custkey) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def hierarchy_children(t):
    met = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return met.groupBy(F.col("r_name").alias("parent"), F.col("n_name").alias("child")).agg(F.count("c_custkey").alias("customers"))


@_query("""WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey AS child_id, s_suppkey // 3 AS parent_id FROM supplier WHERE s_suppkey > 0),
p AS (SELECT child_id AS node, parent_id AS ancestor, 1 AS depth FROM e UNION ALL SELECT p.node, e.parent_id, p.depth + 1 FROM p JOIN e ON p.ancestor = e.child_id)
SELECT node, ancestor, CAST(min(depth) AS INT) AS depth FROM p GROUP BY ALL""")
def hierarchy_closure(t):
    return edges.closure(t("supplier").filter("s_suppkey > 0").select(F.col("s_suppkey").alias("child_id"), F.expr("s_suppkey div 3").alias("parent_id")))


@_query("""WITH r AS (SELECT 'customer' AS entity_table, o_custkey AS entity_id, 'order' AS relation, 'out' AS direction, o_orderkey AS other_id, CAST(o_orderkey AS VARCHAR) AS other_name FROM orders
UNION ALL SELECT 'customer', c_custkey, 'nation', 'out', c_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'supplier', s_suppkey, 'nation', 'out', s_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT DISTINCT 'supplier', l_suppkey, 'part', 'in', l_partkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT * FROM r""")
def entity_360(t):
    shape = ["entity_table", "entity_id", "relation", "direction", "other_id", "other_name"]
    nation = t("nation").select(F.col("n_nationkey").cast("bigint").alias("other_id"), F.col("n_name").alias("other_name"))
    order = t("orders").select(F.lit("customer").alias("entity_table"), F.col("o_custkey").alias("entity_id"), F.lit("order").alias("relation"), F.lit("out").alias("direction"), F.col("o_orderkey").alias("other_id"), F.col("o_orderkey").cast("string").alias("other_name"))
    home = t("customer").select(F.lit("customer").alias("entity_table"), F.col("c_custkey").alias("entity_id"), F.col("c_nationkey").cast("bigint").alias("other_id"))
    home = home.union(t("supplier").select(F.lit("supplier"), "s_suppkey", F.col("s_nationkey").cast("bigint"))).join(nation, "other_id")
    home = home.withColumn("relation", F.lit("nation")).withColumn("direction", F.lit("out"))
    made = t("lineitem").select("l_suppkey", "l_partkey").distinct().join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    made = made.select(F.lit("supplier").alias("entity_table"), F.col("l_suppkey").alias("entity_id"), F.lit("part").alias("relation"), F.lit("in").alias("direction"), F.col("l_partkey").alias("other_id"), F.col("p_name").alias("other_name"))
    return evaluation.union_all([order.select(*shape), home.select(*shape), made.select(*shape)])


# Weak relations, audits, lists --------------------------------------------------------


def _weak(t: Callable[[str], DataFrame]) -> DataFrame:
    e = t("events")
    bucket = F.col("user_id") % 40
    return e.select(
        F.when(bucket < 20, "person").otherwise("organization").alias("subject_table"), F.col("user_id").alias("subject_id"),
        F.concat("event_type", F.lit("_"), bucket.cast("string")).alias("predicate"), F.when(F.col("value") > 50, "product").alias("object_table"),
        F.when(F.col("event_id") % 97 == 0, "edge").alias("promoted_to"),
    )


_WEAK_SQL = """w AS (SELECT CASE WHEN user_id % 40 < 20 THEN 'person' ELSE 'organization' END AS subject_table, user_id AS subject_id, event_type || '_' || (user_id % 40) AS predicate,
CASE WHEN value > 50 THEN 'product' END AS object_table, CASE WHEN event_id % 97 = 0 THEN 'edge' END AS promoted_to FROM events)"""


@_query(f"WITH {_WEAK_SQL} SELECT subject_table, predicate, coalesce(object_table, '(text)') AS object_table, count(*) AS n FROM w GROUP BY ALL")
def weak_matrix(t):
    return routing.weak_matrix(_weak(t))


@_query(f"WITH {_WEAK_SQL} SELECT predicate, count(*) AS n FROM w WHERE promoted_to IS NULL AND predicate NOT IN (SELECT 'click_' || n_nationkey FROM nation) GROUP BY predicate HAVING count(*) >= 5")
def weak_promotion(t):
    named = t("nation").select(F.concat(F.lit("click_"), F.col("n_nationkey").cast("string")).alias("target_table"), F.lit("pending").alias("status"))
    return routing.promotable(_weak(t), named)


@_query(f"WITH {_WEAK_SQL} SELECT predicate, count(*) AS n FROM w WHERE promoted_to IS NULL GROUP BY predicate")
def weak_summary(t):
    return routing.weak_summary(_weak(t))


@_query(f"""WITH {_WEAK_SQL} SELECT DISTINCT 'new_table' AS kind, predicate AS target_table, 'CREATE TABLE ' || predicate || ' (id INTEGER PRIMARY KEY, created_at TEXT NOT NULL)' AS proposed_ddl,
'manual promotion from weak relations: ' || predicate AS rationale, true AS requires_manual_dry_run, 'pending' AS status FROM w WHERE promoted_to IS NULL""")
def weak_manual_promotion(t):
    return routing.weak_summary(_weak(t)).select(*routing.promotion(F.col("predicate")))


@_query("""SELECT event_id, user_id AS document_id, status, c_name AS doc_slug FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'accepted' ELSE 'rejected' END AS status FROM events) JOIN customer ON c_custkey = user_id WHERE status = 'pending'""")
def staging_documents(t):
    status = F.element_at(F.array(*map(F.lit, ("pending", "accepted", "rejected"))), (F.col("event_id") % 3 + 1).cast("int"))
    staged = t("events").select("event_id", F.col("user_id").alias("document_id"), status.alias("status"))
    return audit.staging_list(staged, t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("slug"))).select("event_id", "document_id", "status", "doc_slug")


@_query("""WITH e AS (SELECT 'customer' AS et, c_custkey AS ei, c_name AS n FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier),
w AS (SELECT event_id, event_type AS predicate, user_id AS subject_id, value AS confidence, CASE WHEN event_id % 2 = 0 THEN user_id END AS object_id, CASE WHEN event_id % 2 = 1 THEN 'text ' || event_id END AS object_text, event_id % 30 AS document_id FROM events)
SELECT event_id, predicate, s.n AS subject_name, coalesce(o.n, object_text) AS object_name, n_name AS slug FROM w LEFT JOIN e s ON s.et = 'customer' AND s.ei = subject_id LEFT JOIN e o ON o.et = 'supplier' AND o.ei = object_id
LEFT JOIN nation ON n_nationkey = document_id ORDER BY confidence DESC, predicate, subject_id LIMIT 500""")
def weak_list(t):
    rows = t("events").select(
        "event_id", F.col("event_type").alias("predicate"), F.lit("customer").alias("subject_table"), F.col("user_id").alias("subject_id"), F.col("value").alias("confidence"), F.lit("supplier").alias("object_table"),
        F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("object_id"), F.when(F.col("event_id") % 2 == 1, F.concat(F.lit("text "), F.col("event_id").cast("string"))).alias("object_text"), (F.col("event_id") % 30).alias("document_id"),
    )
    known = t("customer").select(F.lit("customer").alias("entity_table"), F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("canonical_name")).union(t("supplier").select(F.lit("supplier"), "s_suppkey", "s_name"))
    found = audit.weak_list(rows, known, t("nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("slug")))
    return found.select("event_id", "predicate", "subject_name", "object_name", "slug")


@_query(_RESOLVE_SQL + """SELECT entity_id, column_name, r.document_id, r.value, r.confidence FROM resolved r SEMI JOIN (SELECT DISTINCT entity_id AS e, column_name AS c FROM resolved WHERE status = 'conflicted' AND entity_id % 3 <> 0) o ON entity_id = e AND column_name = c""")
def conflict_members(t):
    """Open conflict groups with all claims of their cell; every third entity's are resolved."""
    found = _resolved(t)
    keyed = found.select("entity_id", "column_name", "document_id", "value", "confidence", F.xxhash64("entity_table", "entity_id", "column_name").alias("conflict_group"))
    groups = claims.conflict_groups(found).select("conflict_group", F.when(F.col("entity_id") % 3 == 0, "done").alias("resolved_at")).distinct()
    return audit.conflict_members(groups, keyed).select("entity_id", "column_name", "document_id", "value", "confidence")


@_query("""WITH a AS (SELECT c_name AS slug, c_custkey AS id, 1 AS ingested_at, c_mktsegment AS title FROM customer UNION ALL SELECT c_name, c_custkey + 1000000, 2, upper(c_mktsegment) || '!' FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT s_name, s_suppkey + 2000000, 2, 'supplier' FROM supplier)
SELECT slug, min(id) AS id, max(ingested_at) AS ingested_at, arg_max(title, ingested_at) AS title FROM a GROUP BY slug""")
def documents_upsert(t):
    """Documents that arrive again keep their first id and take the latest fields."""
    c = t("customer")
    stored = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("slug"), F.lit(1).alias("ingested_at"), F.col("c_mktsegment").alias("title"))
    arriving = c.filter("c_custkey % 2 = 0").select((F.col("c_custkey") + 1000000).alias("id"), F.col("c_name").alias("slug"), F.lit(2).alias("ingested_at"), F.concat(F.upper("c_mktsegment"), F.lit("!")).alias("title"))
    arriving = arriving.union(t("supplier").select(F.col("s_suppkey") + 2000000, "s_name", F.lit(2), F.lit("supplier")))
    return audit.upsert_documents(stored, arriving)


@_query("""WITH e AS (SELECT 'customer' AS entity_table, c_custkey AS entity_id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'part', p_partkey, p_name FROM part)
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'customer' WHEN 1 THEN 'supplier' ELSE 'part' END AS subject_table, user_id AS subject_id, name AS subject_name
FROM events LEFT JOIN e ON entity_table = CASE event_id % 3 WHEN 0 THEN 'customer' WHEN 1 THEN 'supplier' ELSE 'part' END AND entity_id = user_id""")
def polymorphic_lookup(t):
    known = t("customer").select(F.lit("customer").alias("entity_table"), F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("canonical_name"))
    known = known.union(t("supplier").select(F.lit("supplier"), "s_suppkey", "s_name")).union(t("part").select(F.lit("part"), "p_partkey", "p_name"))
    table = F.element_at(F.array(*map(F.lit, ("customer", "supplier", "part"))), (F.col("event_id") % 3 + 1).cast("int"))
    rows = t("events").select("event_id", table.alias("subject_table"), F.col("user_id").alias("subject_id"))
    return audit.polymorphic_names(rows, known, "subject_table", "subject_id", "subject_name").select("event_id", "subject_table", "subject_id", "subject_name")


@_query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)""")
def orphan_audit(t):
    return audit.orphans(t("customer").select("c_custkey", "c_name"), [(t("orders"), "o_custkey"), (t("events"), "user_id")], "c_custkey")


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@_query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in _TABLES))
def stats_counts(t):
    return audit.counts({n: t(n) for n in _TABLES})


@_query("SELECT p_name, p_partkey, p_brand FROM part WHERE p_name ILIKE '%RING%' ORDER BY p_name, p_partkey LIMIT 300")
def list_search_topn(t):
    return audit.listing(t("part"), "p_name", "RING").select("p_name", "p_partkey", "p_brand")


@_query("""WITH s AS (SELECT DISTINCT p_name AS v FROM part WHERE p_size > 40 AND length(trim(p_name)) >= 2), e AS (SELECT 'part' AS entity_table, p_partkey AS entity_id, p_name AS canonical_name FROM part),
c AS (SELECT DISTINCT l_partkey AS entity_id, l_orderkey AS document_id FROM lineitem WHERE l_returnflag = 'A')
SELECT DISTINCT 'order-' || document_id AS slug, canonical_name AS matched_value, entity_table FROM e JOIN s ON canonical_name = v JOIN c USING (entity_id) ORDER BY 1, 2, 3 LIMIT 8""")
def union_provenance(t):
    p, li, o = t("part"), t("lineitem"), t("orders")
    strings = search.candidate_strings(p.filter("p_size > 40").select("p_name"), None)
    known = p.select(F.lit("part").alias("entity_table"), F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("canonical_name"))
    backed = li.select(F.lit("part").alias("entity_table"), F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("document_id"), F.when(F.col("l_returnflag") == "A", "active").otherwise("superseded").alias("status"))
    slugs = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("slug"))
    return search.provenance(strings, known, backed, slugs)


# Text -------------------------------------------------------------------------------

_QUESTION = "that the eraton thinorsh heention idiot"
#: The index of each table of documents that this session has built one for.
_INDEXES: dict[tuple[str, ...], TextIndex] = {}


def _index(t: Callable[[str], DataFrame]) -> TextIndex:
    """The stored index of the documents, built once a session."""
    documents = t("documents")
    spark = documents.sparkSession
    key = (spark.sparkContext.applicationId, *sorted(documents.inputFiles()))
    if key not in _INDEXES:
        _INDEXES[key] = TextIndex(spark, f"{shared_folder(spark)}/text-index-{uuid.uuid4().hex}").build(documents)
    return _INDEXES[key]


@_query(f"""SELECT doc_id FROM documents WHERE list_has_any(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), regexp_extract_all('{_QUESTION}', '[a-z]{{2,}}')) ORDER BY doc_id LIMIT {FTS_TOP}""")
def fts_or_match(t):
    return _index(t).match(_QUESTION)


@_query(f"""WITH w AS (SELECT regexp_extract_all('{_QUESTION}', '[a-z]{{2,}}') AS w), k AS (SELECT doc_id, regexp_split_to_array(trim(text), '\\s+') AS t, w FROM documents, w WHERE list_has_any(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), w) ORDER BY doc_id LIMIT {FTS_TOP}),
h AS (SELECT doc_id, t, list_transform(t, lambda x: list_has_any(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}_]{{2,}}'), w)) AS h FROM k), s AS (SELECT *, greatest(1, least(greatest(coalesce(list_position(h, true), 0), 1) - 7, len(t) - 14)) AS s FROM h)
SELECT doc_id, CASE WHEN s > 1 THEN '…' ELSE '' END || array_to_string(list_transform(range(s, least(s + 15, len(t) + 1)), lambda i: CASE WHEN h[i] THEN '>>' || t[i] || '<<' ELSE t[i] END), ' ') || CASE WHEN s + 14 < len(t) THEN '…' ELSE '' END AS snippet FROM s""")
def fts_snippet(t):
    """Of the documents that the index finds; only their texts are read."""
    return search.snippets(_index(t).match(_QUESTION), t("documents"), _QUESTION)


_TERMS_SQL = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"


@_query(f"""WITH i AS (SELECT doc_id, unnest({_TERMS_SQL}) AS term FROM documents), l AS (SELECT doc_id, count(*) AS len FROM i GROUP BY doc_id), s AS (SELECT count(*) AS docs, avg(len) AS al FROM l),
q AS (SELECT DISTINCT question_id, term FROM (SELECT item_id AS question_id, unnest({_TERMS_SQL}) AS term FROM benchmark)), tf AS (SELECT doc_id, term, count(*) AS tf FROM i GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
g AS (SELECT question_id, doc_id, sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))) AS score FROM tf JOIN q USING (term) JOIN df USING (term) JOIN l USING (doc_id), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM g)
SELECT question_id, doc_id, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= {FTS_TOP}""")
def fts_bm25(t):
    asked = t("benchmark").select(F.col("item_id").alias("question_id"), F.explode(terms("text")).alias("term"))
    return _index(t).bm25(asked).select("question_id", "doc_id", F.round("score", 4).alias("score"), "rank")


@_query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))")
def grounding_contains(t):
    """Every benchmark text in every document, both whole."""
    names = t("benchmark").select(F.col("item_id").alias("name_id"), F.col("text").alias("name"))
    found = grounding.grounded_anywhere(names, t("documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("body")))
    return found.select(F.col("document_id").alias("doc_id"), F.col("name_id").alias("item_id"))


_CHUNK_SQL = """p AS (SELECT doc_id, t, CASE WHEN length(t) <= {0} THEN [t] ELSE list_filter(regexp_split_to_array(t, '\\n\\s*\\n'), lambda x: regexp_matches(x, '\\S')) END AS p FROM d),
q AS (SELECT doc_id, CASE WHEN length(t) <= {0} THEN [[t]] ELSE list_transform(flatten(list_transform(CASE WHEN len(p) = 0 THEN [t] ELSE p END, lambda x: list_transform(range(0, length(x), {0}), lambda i: substr(x, i + 1, {0})))), lambda x: [x]) END AS q FROM p),
c AS (SELECT doc_id, list_reduce(q, lambda a, x: CASE WHEN length(a[-1]) + length(x[1]) + 2 <= {0} THEN list_append(a[:-2], a[-1] || chr(10) || chr(10) || x[1]) ELSE list_concat(a, x) END) AS c FROM q)
SELECT doc_id, CAST(i - 1 AS INT) AS chunk_no, CAST(length(c[i]) AS BIGINT) AS chars, sha256(c[i]) AS chunk_sha256 FROM (SELECT doc_id, c, unnest(generate_series(1, len(c))) AS i FROM c)"""


@_query("WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), " + _CHUNK_SQL.format(2000))
def chunk_texts(t):
    return chunk_documents(t("documents"), limit=2000).select("doc_id", "chunk_no", F.length("chunk").cast("bigint").alias("chars"), F.sha2("chunk", 256).alias("chunk_sha256"))


@_query("WITH d AS (SELECT doc_id, replace(replace(coalesce(text, ''), '. ', '.' || chr(10) || chr(10)), ', ', ',' || chr(10) || ' ' || chr(10)) AS t FROM documents), " + _CHUNK_SQL.format(300))
def chunk_paragraphs(t):
    """Texts of many paragraphs, some of white space only, through the table function beside their row."""
    return _paragraphed(t).sparkSession.sql("SELECT doc_id, chunk_no, CAST(length(chunk) AS BIGINT) AS chars, sha2(chunk, 256) AS chunk_sha256 FROM paragraphed, LATERAL chunk_text(text, 300)")


@_query(ORACLES["chunk_paragraphs"])
def chunk_paragraphs_table(t):
    """The same through the Arrow function over the whole table."""
    return _paragraphed(t).sparkSession.sql("SELECT id AS doc_id, chunk_no, CAST(length(chunk) AS BIGINT) AS chars, sha2(chunk, 256) AS chunk_sha256 FROM chunk_table(TABLE(SELECT doc_id, text, 300 AS size FROM paragraphed))")


def _paragraphed(t: Callable[[str], DataFrame]) -> DataFrame:
    d = t("documents")
    tables.register(d.sparkSession)
    d.select("doc_id", F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n\n")), F.lit(", "), F.lit(",\n \n")).alias("text")).createOrReplaceTempView("paragraphed")
    return d


@_query("""SELECT event_id, event_type AS proposed_type, 'user ' || user_id AS canonical_name, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events WHERE event_id % 4 <> 3""")
def payload_parse(t):
    """Payloads as a model returns them: fenced, bare lists, with items that lack a field."""
    item = F.concat(F.lit('{"proposed_type": "'), "event_type", F.lit('", "canonical_name": "user '), F.col("user_id").cast("string"), F.lit('", "attributes": '), F.regexp_replace("props", r'(\d+)', '"$1"'), F.lit(', "confidence": 0.5}'))
    shape = F.col("event_id") % 4
    raw = F.when(shape == 0, F.concat(F.lit("```json\n["), item, F.lit("]\n```"))).when(shape == 1, F.concat(F.lit('{"entities": ['), item, F.lit(', {"proposed_type": "x"}]}')))
    raw = raw.when(shape == 2, F.concat(F.lit("Here you are: ["), item, F.lit("] - done"))).otherwise(F.lit("no json at all"))
    parsed = t("events").select("event_id", parse_payload(raw).alias("g")).select("event_id", F.explode("g.entities").alias("e"))
    return parsed.select("event_id", "e.proposed_type", "e.canonical_name", F.element_at("e.attributes", "k").alias("k"))


@_query("""SELECT user_id, event_type, round(coalesce(exp(avg(-value / 100) FILTER (event_id % 11 = 0)), 0.1), 6) AS confidence, count(*) FILTER (event_id % 11 = 0) AS tokens FROM events GROUP BY ALL""")
def confidence_exp_mean(t):
    """Some groups have no tokens at all, and the fallback."""
    logprobs = F.collect_list(F.when(F.col("event_id") % 11 == 0, -F.col("value") / 100))
    grouped = t("events").groupBy("user_id", "event_type").agg(logprobs.alias("logprobs"))
    return grouped.select("user_id", "event_type", F.round(mean_confidence(F.col("logprobs")), 6).alias("confidence"), F.size("logprobs").cast("bigint").alias("tokens"))


# Routing ----------------------------------------------------------------------------

_JUNCTION_OF = ("employment", "manufacturing", "org_hierarchy", "product_variant", "compliance", "friend_of")
_TYPE_OF = ("person", "organization", "product", "contract")


def _relations(t: Callable[[str], DataFrame], *kept: str) -> DataFrame:
    li = t("lineitem")
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
    return li.select(
        *kept, F.col("l_orderkey").alias("document_id"), pick(_JUNCTION_OF, F.col("l_partkey")).alias("junction"), pick(_TYPE_OF, F.col("l_suppkey")).alias("from_type"),
        F.when(F.col("l_suppkey") % 11 != 0, F.col("l_suppkey")).alias("from_id"), pick(_TYPE_OF, F.col("l_orderkey")).alias("to_type"),
        F.when(F.col("l_orderkey") % 13 != 0, F.col("l_orderkey") % 50).alias("to_id"), F.when(F.col("l_orderkey") % 5 != 0, F.lit("ISO")).alias("to_text"),
        (1 - F.col("l_discount") * 9).alias("confidence"), F.when(F.col("l_linenumber") == 7, "cardinality_violation").alias("how"),
    )


_RELATIONS_SQL = f"""r AS (SELECT {list(_JUNCTION_OF)}[1 + l_partkey % 6] AS junction, {list(_TYPE_OF)}[1 + l_suppkey % 4] AS ft, CASE WHEN l_suppkey % 11 <> 0 THEN l_suppkey END AS fi,
{list(_TYPE_OF)}[1 + l_orderkey % 4] AS tt, CASE WHEN l_orderkey % 13 <> 0 THEN l_orderkey % 50 END AS ti, CASE WHEN l_orderkey % 5 <> 0 THEN 'ISO' END AS tx, 1 - l_discount * 9 AS conf, l_linenumber = 7 AS viol FROM lineitem),
x AS (SELECT *, CASE junction WHEN 'employment' THEN ['organization', 'person'] WHEN 'manufacturing' THEN ['organization', 'product'] WHEN 'org_hierarchy' THEN ['organization'] WHEN 'product_variant' THEN ['product'] END AS want FROM r),
y AS (SELECT *, CASE WHEN junction = 'friend_of' THEN 'unknown_junction' WHEN fi IS NULL OR (junction = 'compliance' AND tx IS NULL) OR (junction <> 'compliance' AND ti IS NULL) THEN 'unresolved_endpoint'
WHEN (junction = 'compliance' AND ft <> 'contract') OR (junction <> 'compliance' AND list_sort(list_distinct([ft, tt])) <> want) THEN 'endpoint_type_mismatch'
WHEN junction = 'product_variant' AND fi = ti THEN 'self_variant' WHEN viol THEN 'cardinality_violation' WHEN conf < 0.3 THEN 'low_confidence' ELSE 'ok' END AS reason FROM x)"""


@_query(f"""WITH {_RELATIONS_SQL} SELECT CASE WHEN reason = 'ok' THEN 'edge' WHEN reason = 'unresolved_endpoint' OR (reason = 'endpoint_type_mismatch' AND junction = 'compliance') THEN 'dropped'
WHEN reason = 'cardinality_violation' THEN 'staging' ELSE 'weak' END AS route, reason, count(*) AS n FROM y GROUP BY ALL""")
def route_relations(t):
    return routing.outcomes(routing.route_relations(_relations(t)))


@_query(f"""WITH {_RELATIONS_SQL.replace(" FROM lineitem)", ", l_orderkey AS document_id, l_linenumber FROM lineitem)", 1)} SELECT document_id, l_linenumber AS line, junction, ft AS from_type, fi AS from_id, reason,
CASE WHEN reason = 'ok' THEN 'edge' WHEN reason = 'unresolved_endpoint' OR (reason = 'endpoint_type_mismatch' AND junction = 'compliance') THEN 'dropped' WHEN reason = 'cardinality_violation' THEN 'staging' ELSE 'weak' END AS route FROM y""")
def relations_routed(t):
    """Each relation with where it goes and why."""
    found = routing.route_relations(_relations(t, "l_linenumber"))
    return found.select("document_id", F.col("l_linenumber").alias("line"), "junction", "from_type", "from_id", F.coalesce("reason", F.lit("ok")).alias("reason"), "route")


@_query("""WITH a AS (SELECT CASE user_id % 3 WHEN 0 THEN 'organization' WHEN 1 THEN 'product' ELSE 'startup' END AS pt, CASE event_type WHEN 'click' THEN 'org_type' WHEN 'view' THEN 'category' ELSE 'canonical_name' END AS cn,
CASE WHEN event_id % 7 = 0 THEN '' ELSE 'v' END AS v, value / 100 AS conf FROM events),
r AS (SELECT *, CASE WHEN v = '' THEN 'empty_value' WHEN pt = 'startup' THEN 'non_starter_type' WHEN (pt = 'organization' AND cn = 'category') OR (pt = 'product' AND cn = 'org_type') THEN 'unknown_column' WHEN conf < 0.3 THEN 'low_confidence' ELSE 'ok' END AS reason FROM a)
SELECT CASE reason WHEN 'ok' THEN 'claim' WHEN 'empty_value' THEN 'dropped' ELSE 'staging' END AS route, reason, count(*) AS n FROM r GROUP BY ALL""")
def route_attributes(t):
    rows = t("events").select(
        F.element_at(F.array(*map(F.lit, ("organization", "product", "startup"))), (F.col("user_id") % 3 + 1).cast("int")).alias("proposed_type"),
        F.when(F.col("event_type") == "click", "org_type").when(F.col("event_type") == "view", "category").otherwise("canonical_name").alias("column_name"),
        F.when(F.col("event_id") % 7 == 0, "").otherwise("v").alias("value"), (F.col("value") / 100).alias("confidence"),
    )
    return routing.outcomes(routing.route_attributes(rows))


# Evaluation -------------------------------------------------------------------------

_JUDGED_SQL = "j AS (SELECT doc_id, quality, CAST(contains(text, '!!') OR contains(text, '$$$') AS INT) AS junk FROM labels JOIN documents USING (doc_id))"


def _judged(t: Callable[[str], DataFrame]) -> DataFrame:
    junk = search.contains_any(F.col("text"), ["!!", "$$$"]).cast("int")
    return t("labels").join(t("documents").select("doc_id", junk.alias("junk")), "doc_id")


@_query(f"""WITH {_JUDGED_SQL}, n AS (SELECT CAST(sum(junk * (1 - quality)) AS BIGINT) AS tp, CAST(sum(junk * quality) AS BIGINT) AS fp, CAST(sum((1 - junk) * (1 - quality)) AS BIGINT) AS fn FROM j)
SELECT tp, fp, fn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))), 4) AS f1 FROM n""")
def prf_labels(t):
    j = _judged(t)
    return evaluation.set_prf(j.filter("quality = 0").select("doc_id"), j.filter("junk = 1").select("doc_id"), ["doc_id"])


@_query(f"WITH {_JUDGED_SQL} SELECT quality || '->' || (1 - junk) AS cell, count(*) AS n FROM j GROUP BY ALL")
def confusion_labels(t):
    return evaluation.confusion(_judged(t).withColumn("guess", 1 - F.col("junk")), "quality", "guess")


@_query("""WITH r AS (SELECT event_type AS metric, user_id % 5 AS run, avg(value) AS v FROM events GROUP BY ALL) SELECT metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(v) AS runs FROM r GROUP BY metric""")
def mean_std_runs(t):
    runs = t("events").groupBy(F.col("event_type").alias("metric"), (F.col("user_id") % 5).alias("run")).agg(F.avg("value").alias("v"))
    return evaluation.mean_std(runs, "metric", "v").select("metric", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "runs")


@_query("""WITH g AS (SELECT DISTINCT p_name, p_type FROM part), p AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_name || 'x' END AS p_name, p_type FROM part WHERE p_size > 10),
m AS (SELECT (SELECT count(*) FROM g JOIN p USING (p_name, p_type)) AS tp, (SELECT count(*) FROM p ANTI JOIN g USING (p_name, p_type)) AS fp, (SELECT count(*) FROM g ANTI JOIN p USING (p_name, p_type)) AS fn)
SELECT tp, fp, fn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))), 4) AS f1 FROM m""")
def entity_match_prf(t):
    p = t("part")
    names = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit("x")))
    return evaluation.set_prf(p.select("p_name", "p_type"), p.filter("p_size > 10").select(names.alias("p_name"), "p_type"), ["p_name", "p_type"])


@_query("""WITH g AS (SELECT DISTINCT p_name, p_type FROM part), p AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_name || 'x' END AS p_name, p_type FROM part WHERE p_size > 10)
SELECT p_name, p_type, 'missed' AS kind FROM g ANTI JOIN p USING (p_name, p_type) UNION ALL SELECT p_name, p_type, 'extra' FROM p ANTI JOIN g USING (p_name, p_type)""")
def entity_match_failures(t):
    p = t("part")
    names = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit("x")))
    return evaluation.set_differences(p, p.filter("p_size > 10").select(names.alias("p_name"), "p_type"), ["p_name", "p_type"])


_PRF_SQL = """SELECT tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS recall,
round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1"""
_SETS_SQL = "m AS (SELECT (SELECT count(*) FROM (SELECT * FROM g INTERSECT SELECT * FROM p)) AS tp, (SELECT count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM g)) AS fp, (SELECT count(*) FROM (SELECT * FROM g EXCEPT SELECT * FROM p)) AS fn)"


@_query(f"""WITH n AS (SELECT p_partkey AS id, unnest([p_name, p_name || ' mark ' || p_partkey % 7]) AS n FROM part), k AS (SELECT {_KEY_SQL.format('n')} AS k, min(id) AS id FROM n GROUP BY 1),
p AS (SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN upper(p_name) || ' Inc.' WHEN 1 THEN p_name || '-Mark-' || p_partkey % 7 ELSE p_name || ' zz' END AS n FROM part), f AS (SELECT DISTINCT {_KEY_SQL.format('n')} AS k FROM p),
m AS (SELECT count(DISTINCT id) AS tp, CAST(sum(CASE WHEN id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS fp, (SELECT count(*) FROM part) - count(DISTINCT id) AS fn FROM f LEFT JOIN k USING (k)) {_PRF_SQL} FROM m""")
def entity_match_groups(t):
    """Predicted names against gold groups of a name and an alias."""
    p = t("part")
    mark = (F.col("p_partkey") % 7).cast("string")
    gold = p.select(F.col("p_partkey").alias("group_id"), F.lit("part").alias("proposed_type"), F.array("p_name", F.concat("p_name", F.lit(" mark "), mark)).alias("names"))
    name = F.when(F.col("p_size") % 3 == 0, F.concat(F.upper("p_name"), F.lit(" Inc."))).when(F.col("p_size") % 3 == 1, F.concat("p_name", F.lit("-Mark-"), mark)).otherwise(F.concat("p_name", F.lit(" zz")))
    return evaluation.match_entities(gold, p.select(F.lit("part").alias("proposed_type"), name.alias("canonical_name")))


@_query(f"""WITH b AS (SELECT 'placed_' || o_orderstatus AS j, c_name AS f, o_orderpriority AS t, o_orderkey AS o FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (SELECT DISTINCT j, {_KEY_SQL.format('f')} AS f, {_KEY_SQL.format('t')} AS t FROM b WHERE o % 5 <> 0), p AS (SELECT DISTINCT j, {_KEY_SQL.format("upper(f) || ' Ltd.'")} AS f, {_KEY_SQL.format('t')} AS t FROM b WHERE o % 3 <> 0), {_SETS_SQL} {_PRF_SQL} FROM m""")
def relation_match_prf(t):
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    side = lambda keep, name: rows.filter(keep).select(F.concat(F.lit("placed_"), "o_orderstatus").alias("proposed_junction"), name.alias("from"), F.col("o_orderpriority").alias("to"))
    return evaluation.match_relations(side(F.col("o_orderkey") % 5 != 0, F.col("c_name")), side(F.col("o_orderkey") % 3 != 0, F.concat(F.upper("c_name"), F.lit(" Ltd."))))


@_query(f"""WITH b AS (SELECT s_name, n_name, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
g AS (SELECT DISTINCT {_KEY_SQL.format('s_name')} AS s, 'based in' AS predicate, {_KEY_SQL.format('n_name')} AS o FROM b), p AS (SELECT DISTINCT {_KEY_SQL.format("upper(s_name) || ', Inc.'")}, CASE WHEN s_suppkey % 4 = 0 THEN 'located in' ELSE 'based in' END, {_KEY_SQL.format('n_name')} FROM b WHERE s_suppkey % 7 <> 0), {_SETS_SQL} {_PRF_SQL} FROM m""")
def weak_match_prf(t):
    rows = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    gold = rows.select(F.col("s_name").alias("subject"), F.lit("based in").alias("predicate"), F.col("n_name").alias("object"))
    said = F.when(F.col("s_suppkey") % 4 == 0, "located in").otherwise("based in")
    return evaluation.match_weak(gold, rows.filter("s_suppkey % 7 <> 0").select(F.concat(F.upper("s_name"), F.lit(", Inc.")).alias("subject"), said.alias("predicate"), F.col("n_name").alias("object")))


@_query(f"""WITH s AS (SELECT {_KEY_SQL.format('s_name')} AS k, s_suppkey, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier),
g AS (SELECT k, 'nation' AS c, nation AS v FROM s WHERE s_suppkey % 10 <> 0), r AS (SELECT k, 'nation' AS c, CASE WHEN s_suppkey % 6 = 0 THEN 'x' ELSE nation END AS v FROM s UNION ALL SELECT k, 'colour', 'red' FROM s),
p AS (SELECT DISTINCT * FROM r WHERE (k, c) IN (SELECT k, c FROM g)), {_SETS_SQL} {_PRF_SQL} FROM m""")
def cell_match_prf(t):
    """Cells of entities named by an alias where the key is even; a column that gold doesn't have is no mistake."""
    s = t("supplier").select(strip_name("s_name").alias("k"), "s_suppkey", F.col("s_nationkey").cast("string").alias("nation"))
    kind = F.lit("supplier").alias("proposed_type")
    gold = s.filter("s_suppkey % 10 <> 0").select(kind, "k", F.lit("nation").alias("column"), F.col("nation").alias("value"))
    alias = F.concat(F.lit("vendor"), F.col("s_suppkey").cast("string"))
    named = F.when(F.col("s_suppkey") % 2 == 0, alias).otherwise(F.col("k")).alias("k")
    said = s.select(kind, named, F.lit("nation").alias("column"), F.when(F.col("s_suppkey") % 6 == 0, "x").otherwise(F.col("nation")).alias("value"))
    said = said.union(s.select(kind, named, F.lit("colour"), F.lit("red")))
    return evaluation.match_cells(gold, said, s.select(kind, alias.alias("alias_key"), F.col("k").alias("canonical_key")))


@_query(f"""WITH p AS (SELECT c_name AS a, CASE c_custkey % 3 WHEN 0 THEN upper(c_name) || ' Co.' WHEN 1 THEN c_name || ' Group' ELSE replace(c_name, '#', ' ') END AS b, CASE WHEN c_custkey % 4 = 0 THEN 'different' ELSE 'same' END AS expected, CASE WHEN c_custkey % 5 = 0 THEN 'alias-or-llm' ELSE 'exact' END AS level FROM customer),
j AS (SELECT *, CASE WHEN {_KEY_SQL.format('a')} = {_KEY_SQL.format('b')} THEN 'same' ELSE 'different' END AS predicted FROM p)
SELECT round(avg(CAST(predicted = expected AS INT)), 4) AS accuracy, round(avg(CASE WHEN expected = 'same' THEN CAST(predicted = expected AND level = 'exact' AS INT) END), 4) AS level_match, count(*) AS n FROM j""")
def dedup_accuracy(t):
    k = F.col("c_custkey")
    other = F.when(k % 3 == 0, F.concat(F.upper("c_name"), F.lit(" Co."))).when(k % 3 == 1, F.concat("c_name", F.lit(" Group"))).otherwise(F.replace("c_name", F.lit("#"), F.lit(" ")))
    pairs = t("customer").select(k.alias("pair_id"), F.col("c_name").alias("a"), other.alias("b"), F.when(k % 4 == 0, "different").otherwise("same").alias("expected"), F.when(k % 5 == 0, "alias-or-llm").otherwise("exact").alias("level"))
    return evaluation.accuracy(evaluation.dedup_pairs(pairs))


@_query(f"""WITH e AS (SELECT event_id, event_type, user_id, user_id % 9 AS u, event_id % 7 AS m, json_extract_string(props, '$.k') AS v FROM events),
s1 AS (SELECT 'schema_proposal_precision' AS metric, * FROM (WITH p AS (SELECT DISTINCT CASE WHEN u < 4 THEN 'new_table' ELSE 'new_column' END AS kind, event_type || u AS target FROM e WHERE u <> 8), g AS (SELECT DISTINCT 'new_table' AS kind, event_type || u AS target FROM e WHERE u < 6), {_SETS_SQL} {_PRF_SQL} FROM m)),
s2 AS (SELECT 'staging_replay_correctness' AS metric, * FROM (WITH p AS (SELECT DISTINCT CASE WHEN m = 1 THEN '' ELSE 'low_' || m END AS reason, CASE WHEN u = 0 THEN '' ELSE event_type END AS tab FROM e WHERE m <> 0), g AS (SELECT DISTINCT 'low_' || m AS reason, event_type AS tab FROM e WHERE m < 4), {_SETS_SQL} {_PRF_SQL} FROM m)),
s3 AS (SELECT 'weak_relation_promotion_recall' AS metric, * FROM (WITH p AS (SELECT DISTINCT event_type || m FROM e WHERE u = 3), g AS (SELECT DISTINCT event_type || m FROM e WHERE m < 3), {_SETS_SQL} {_PRF_SQL} FROM m)),
w AS (SELECT max(f) AS tp FROM (SELECT count(DISTINCT v) - 1 AS f FROM e GROUP BY user_id, event_type))
SELECT *, CAST(NULL AS BOOLEAN) AS passed FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3) UNION ALL SELECT 'canonical_stability', tp, NULL, NULL, NULL, NULL, NULL, tp <= 0 FROM w""")
def proposal_metrics(t):
    """Proposals, staged reasons (some of them no JSON) and promotions of a store against what was expected, and its flips."""
    e = t("events").select("event_type", "user_id", (F.col("user_id") % 9).alias("u"), (F.col("event_id") % 7).alias("m"), F.get_json_object("props", "$.k").alias("value"))
    tagged = F.concat("event_type", F.col("u").cast("string"))
    reason = F.concat(F.lit("low_"), F.col("m").cast("string"))
    proposals = e.select(F.when(F.col("u") < 4, "new_table").otherwise("new_column").alias("kind"), F.when(F.col("u") != 8, tagged).alias("target_table"))
    summary = F.when(F.col("m") == 0, "{broken").when(F.col("m") == 1, "{}").otherwise(F.to_json(F.struct(reason.alias("reason"))))
    staging = e.select(F.when(F.col("u") != 0, F.col("event_type")).alias("proposed_table"), summary.alias("match_summary"))
    claimed = e.select(F.lit("user").alias("entity_table"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("column_name"), "value")
    predicate = F.concat("event_type", F.col("m").cast("string")).alias("predicate")
    weak = e.select(predicate, F.when(F.col("u") == 3, "edge").alias("promoted_to"))
    gold = e.filter("u < 6").select(F.lit("new_table").alias("kind"), tagged.alias("target_table")), e.filter("m < 4").select(reason.alias("reason"), F.col("event_type").alias("proposed_table")), e.filter("m < 3").select(predicate)
    return evaluation.proposal_metrics(proposals, staging, claimed, weak, *gold)


@_query("""SELECT CAST(count(*) AS BIGINT) AS cases, round(avg(CAST(o_orderstatus <> 'P' AS INT)), 6) AS sql_ok, round(coalesce(avg(CASE WHEN o_orderstatus = 'F' THEN CAST(contains(lower(o_orderpriority), 'high') AS INT) END), 0), 6) AS contains FROM orders""")
def answer_scores(t):
    cell = evaluation.row_contains(F.array("o_orderpriority", "o_orderstatus"), F.lit("HIGH"))
    cases = t("orders").select((F.col("o_orderstatus") != "P").alias("sql_ok"), F.when(F.col("o_orderstatus") == "F", cell.cast("double")).alias("contains"), F.lit(None).cast("double").alias("slugs"))
    return evaluation.answer_scores(cases).select("cases", F.round("sql_ok", 6).alias("sql_ok"), F.round("contains", 6).alias("contains"))


# Gate, catalog, extensions ------------------------------------------------------------


@_query(_RESOLVE_SQL + "SELECT column_name, count(*) AS n FROM resolved WHERE status = 'active' AND value = '7' GROUP BY column_name ORDER BY column_name LIMIT 50")
def gate_guarded_sql(t):
    """A query that forgets the status: the gate reads active rows only."""
    resolved = _resolved(t)
    resolved.createOrReplaceTempView("user_claims")
    return gate.run(resolved.sparkSession, "SELECT column_name, count(*) AS n FROM user_claims c WHERE c.value = '7' GROUP BY column_name ORDER BY column_name")


@_query("SELECT o_custkey, any_value(c_name) AS c_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey")
def gate_bare_group_by(t):
    t("orders").createOrReplaceTempView("orders")
    customer = t("customer")
    customer.createOrReplaceTempView("customer")
    return gate.group_bare_columns(customer.sparkSession, "SELECT o_custkey, c_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey")


@_query("""WITH i AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS started_at, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') END AS ended_at FROM orders)
SELECT o_orderkey, started_at, ended_at FROM i WHERE started_at <= '1998-06-30' AND (ended_at IS NULL OR ended_at >= '1998-06-01')""")
def interval_overlap(t):
    """Open-ended intervals of text dates against a month."""
    rows = t("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("started_at"), F.when(F.col("o_orderkey") % 4 != 0, F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd")).alias("ended_at"))
    return rows.filter("started_at <= '1998-06-30' AND (ended_at IS NULL OR ended_at >= '1998-06-01')")


@_query("""WITH c AS (SELECT DISTINCT 'user' AS "table", event_type || '_' || json_extract_string(props, '$.k') AS "column", event_id % 2 = 0 AS new FROM events)
SELECT "table", "column", CASE WHEN bool_and(new) THEN 'added' WHEN bool_or(new) THEN 'kept' ELSE 'removed' END AS change FROM c GROUP BY ALL""")
def catalog_diff(t):
    """Columns that claims of an older and of a newer log are about: what a migration would add, remove and keep."""
    said = t("events").select(F.lit("user").alias("table"), F.concat("event_type", F.lit("_"), F.get_json_object("props", "$.k")).alias("column"), F.lit("string").alias("type"), "event_id")
    sides = [said.filter(F.col("event_id") % 2 == k).drop("event_id").distinct() for k in (1, 0)]
    return catalog.column_changes(*sides)


@_query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_window(t):
    return window_counts(t("events")).select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


@_query("""WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM s)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM g GROUP BY user_id, session""")
def session_windows(t):
    return sessions(t("events"))


@_query("""SELECT n_regionkey, c_mktsegment, CAST(grouping(n_regionkey) * 2 + grouping(c_mktsegment) AS BIGINT) AS level, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_mktsegment)""")
def rollup_counts(t):
    met = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return met.rollup("n_regionkey", "c_mktsegment").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@_query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS near FROM lineitem GROUP BY l_returnflag")
def approx_distinct(t):
    """Distinct parts, and whether the sketch of 2 % deviation comes within four deviations."""
    # beside a distinct count each pair would carry a sketch of its own; repeated values leave a sketch as it is
    pairs = t("lineitem").select("l_returnflag", "l_partkey").distinct()
    both = pairs.groupBy("l_returnflag").agg(F.count("l_partkey").alias("parts"), F.approx_count_distinct("l_partkey", 0.02).alias("sketch"))
    return both.select("l_returnflag", "parts", (F.abs(F.col("sketch") - F.col("parts")) <= 0.08 * F.col("parts")).alias("near"))


@_query("SELECT conv_id, turn, role, lag(role) OVER w AS previous_role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS role_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def turn_history(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t("conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("previous_role"), F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")).cast("bigint").alias("role_turn"))
