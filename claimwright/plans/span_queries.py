"""Registered queries of spans and confidences, listings with documents, reports, sketches and SQL's own forms, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimwright.functions import tables
from claimwright.functions.confidence import apply_confidences, byte_offsets
from claimwright.operators import audit, intervals, reports
from claimwright.plans import sql_functions
from claimwright.plans.queries import _CLAIMS_SQL, _RESOLVE_SQL, ORACLES, _claims, _query, _resolved

# Spans and confidences ------------------------------------------------------------------

_TOKENS_SQL = """w AS (SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark WHERE text IS NOT NULL),
k AS (SELECT item_id, i, w[i] || ' ' AS token FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
tok AS (SELECT item_id, i, -((strlen(token) % 7) + 1) / 10.0::DOUBLE AS logprob, CAST(sum(strlen(token)) OVER (PARTITION BY item_id ORDER BY i) - strlen(token) AS BIGINT) AS s, CAST(sum(strlen(token)) OVER (PARTITION BY item_id ORDER BY i) AS BIGINT) AS e FROM k)"""
_SPANS_SQL = """v AS (SELECT item_id, text, unnest([{'n': 'head', 'v': array_to_string(w[1:2], ' ')}, {'n': 'middle', 'v': array_to_string(w[len(w) // 2:len(w) // 2 + 6], ' ')}, {'n': 'part', 'v': substr(text, 10, 15)}, {'n': 'none', 'v': 'zzqq'}, {'n': 'empty', 'v': ''}]) AS x FROM w),
sp AS (SELECT item_id, x.n AS name, CASE WHEN x.v <> '' AND instr(text, x.v) > 0 THEN strlen(substr(text, 1, instr(text, x.v) - 1)) END AS a, CASE WHEN x.v <> '' AND instr(text, x.v) > 0 THEN strlen(substr(text, 1, instr(text, x.v) - 1)) + strlen(x.v) END AS b FROM v)"""


def _tokens(t):
    words = t("benchmark").filter("text IS NOT NULL").select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "word")).withColumn("token", F.concat("word", F.lit(" ")))
    return byte_offsets(words, "item_id").withColumn("logprob", -((F.octet_length("token") % 7) + 1) / F.lit(10.0))


def _spans(t):
    b = t("benchmark").filter("text IS NOT NULL")
    w = F.split("text", " ")
    some = lambda start, size: F.array_join(F.slice(w, start, size), " ")
    half = F.greatest(F.floor(F.size(w) / 2).cast("int"), F.lit(1))
    value = lambda name, text: F.struct(F.lit(name).alias("name"), text.alias("value"))
    named = F.array(value("head", some(F.lit(1), F.lit(2))), value("middle", some(half, F.lit(7))), value("part", F.substring("text", 10, 15)), value("none", F.lit("zzqq")), value("empty", F.lit("")))
    said = b.select("item_id", F.explode(named).alias("x")).select("item_id", "x.*")
    return intervals.located(said, b, "item_id")


@_query(f"WITH {_TOKENS_SQL}, {_SPANS_SQL} SELECT item_id, name, i - 1 AS pos FROM sp JOIN tok USING (item_id) WHERE s < b AND a < e")
def token_overlaps(t):
    """The tokens that each value of a text lies over."""
    tokens, spans = _tokens(t).select("item_id", "pos", "start", "end"), _spans(t).select("item_id", "name", "start", "end")
    return intervals.overlaps(tokens, spans, "item_id").select("item_id", "name", "pos")


@_query(f"WITH {_TOKENS_SQL}, {_SPANS_SQL} SELECT item_id, name, round(coalesce(exp(avg(logprob)), 0.1), 6) AS confidence, count(logprob) AS tokens FROM sp LEFT JOIN tok ON sp.item_id = tok.item_id AND s < b AND a < e GROUP BY sp.item_id, name".replace("SELECT item_id, name, round", "SELECT sp.item_id, name, round"))
def token_confidences(t):
    """Confidences of values by their tokens, with the fallback where a value isn't found."""
    found = intervals.span_confidences(_tokens(t), _spans(t), "item_id", "name")
    return found.select("item_id", "name", F.round("confidence", 6).alias("confidence"), "tokens")


_GRAPH_SQL = """n AS (SELECT s_nationkey AS document_id, s_suppkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS item_no, '{"canonical_name": "' || s_name || '"}' AS item FROM supplier),
c AS (SELECT document_id, '{"entities": [' || string_agg(item, ', ' ORDER BY k) || ']}' AS content FROM n GROUP BY document_id),
p AS (SELECT document_id, item_no, instr(content, item) + 19 AS s, instr(content, item) + 19 + length(item) - 22 AS e FROM n JOIN c USING (document_id))"""


@_query(f"WITH {_GRAPH_SQL} SELECT document_id, 'entities' AS section, CAST(item_no AS INT) AS item_no, round(exp(list_avg(list_transform(range(s, e), lambda i: -((i // 3) % 5) / 10.0::DOUBLE))), 4) AS near FROM p".replace("range(s, e)", "range((s // 3) * 3, e, 3)").replace("(i // 3) % 5", "(i // 3) % 5"))
def graph_confidences(t):
    """Confidences of the entities in a model's answer, whose tokens are three characters long."""
    n = t("supplier").select(F.col("s_nationkey").cast("bigint").alias("document_id"), "s_suppkey", F.concat(F.lit('{"canonical_name": "'), "s_name", F.lit('"}')).alias("item"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "item"))), lambda x: x["item"])
    c = n.groupBy("document_id").agg(F.concat(F.lit('{"entities": ['), F.array_join(listed, ", "), F.lit("]}")).alias("content"))
    token = lambda x, k: F.struct(x.alias("token"), (-(k % 5) / F.lit(10.0)).alias("logprob"), F.lit(None).cast("array<int>").alias("bytes"))
    tokens = F.transform(F.regexp_extract_all("content", F.lit("(?s).{1,3}"), F.lit(0)), token)
    return apply_confidences(c.select("document_id", "content", tokens.alias("tokens"))).select("document_id", "section", "item_no", F.round("confidence", 4).alias("near"))


# Listings with documents ------------------------------------------------------------------


@_query(_RESOLVE_SQL + "SELECT entity_id, column_name, r.value, r.confidence, status, n_name AS doc_slug FROM resolved r JOIN nation ON n_nationkey = document_id")
def entity_claims(t):
    """Every entity's claims with the document that each is from."""
    slugs = t("nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("slug"))
    return audit.with_documents(_resolved(t), slugs).select("entity_id", "column_name", "value", "confidence", "status", "doc_slug")


@_query("""SELECT 'supplier' AS entity_table, l_suppkey AS entity_id, l_linestatus AS surface_form, 'order-' || o_orderkey AS doc_slug FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'""")
def entity_mentions(t):
    """Every mention with its document's slug; those of unknown documents are left out."""
    said = t("lineitem").select(F.lit("supplier").alias("entity_table"), F.col("l_suppkey").alias("entity_id"), F.col("l_linestatus").alias("surface_form"), F.col("l_orderkey").alias("document_id"))
    slugs = t("orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("slug"))
    return audit.with_documents(said, slugs).select("entity_table", "entity_id", "surface_form", "doc_slug")


# Reports --------------------------------------------------------------------------------

_REPORTS_SQL = """g AS (SELECT user_id, ['query', 'extract', 'dedup', 'proposal', 'other'][1 + user_id % 5] AS stage, avg(value) / 100 AS a, CASE WHEN user_id % 3 <> 0 THEN max(value) / 1000 END AS b FROM events GROUP BY user_id),
h AS (SELECT user_id, stage, unnest(CASE stage WHEN 'query' THEN [{'n': 'sql', 'v': a}, {'n': 'row', 'v': b}, {'n': 'doc', 'v': NULL}] WHEN 'extract' THEN [{'n': 'ent_f1', 'v': a}, {'n': 'rel_f1', 'v': b}, {'n': 'fact_f1', 'v': NULL}]
WHEN 'dedup' THEN [{'n': 'acc', 'v': a}, {'n': 'f1', 'v': b}, {'n': 'lvl', 'v': NULL}] WHEN 'proposal' THEN [{'n': 'prop_f1', 'v': a}, {'n': 'stage_f1', 'v': b}, {'n': 'weak_r', 'v': NULL}, {'n': 'stab', 'v': NULL}] ELSE [{'n': 'first', 'v': a}, {'n': 'second', 'v': b}] END) AS x FROM g)"""


@_query(f"WITH {_REPORTS_SQL} SELECT h.user_id, h.stage, x.n AS name, round(x.v, 6) AS shown, round(s.score, 6) AS score FROM h JOIN (SELECT user_id, avg(x.v) AS score FROM h GROUP BY user_id) s USING (user_id)")
def report_headlines(t):
    """What reports of each stage are known by, and the mean of what they have."""
    stage = F.element_at(F.array(*map(F.lit, (*reports.HEADLINES, "other"))), (F.col("user_id") % 5 + 1).cast("int"))
    grouped = t("events").groupBy("user_id").agg((F.avg("value") / 100).alias("a"), F.when(F.col("user_id") % 3 != 0, F.max("value") / 1000).alias("b")).withColumn("stage", stage)
    names = F.when(F.lit(False), F.array().cast("array<string>"))
    for name, columns in {**reports.HEADLINES, "other": dict.fromkeys(("first", "second"))}.items():
        firsts = [(c or k) + "_mean" for k, c in columns.items()][:2]
        names = names.when(F.col("stage") == name, F.array(*map(F.lit, firsts)))
    made = grouped.withColumn("aggregate", F.map_concat(F.map_from_arrays(names, F.array("a", "b")), F.create_map(F.lit("spread_std"), F.lit(9.0))))
    found = reports.listing(made.withColumn("timestamp_utc", F.lit("2024")).withColumn("file", F.col("user_id").cast("string")))
    return found.select("user_id", "stage", F.explode("headline").alias("name", "v"), F.round("score", 6).alias("score")).select("user_id", "stage", "name", F.round("v", 6).alias("shown"), "score")


# Sketches and SQL's own forms ---------------------------------------------------------------


@_query("""SELECT event_type, count(DISTINCT user_id) AS users, true AS near FROM events GROUP BY event_type""")
def distinct_users_sketched(t):
    """Users of each type over all days, united from a stored sketch of each day, within 5 % of their number."""
    days = t("events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.hll_sketch_agg("user_id", 14).alias("sketch"))
    united = days.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    exact = t("events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    return exact.join(united, "event_type").select("event_type", "users", (F.abs(F.col("estimate") - F.col("users")) <= 0.05 * F.col("users")).alias("near"))


@_query("""SELECT user_id, strftime(min(ts), '%Y-%m-%d') AS first_day, round(julian(max(ts)) - julian(min(ts)), 6) AS days, CASE WHEN count(*) > 20 THEN 'many' ELSE 'few' END AS busy, string_agg(event_type, '|' ORDER BY event_type, event_id) AS kinds, round(coalesce(sum(value), 0), 4) AS total, CAST(floor(epoch(min(ts))) AS BIGINT) AS since FROM events GROUP BY user_id""")
def sqlite_spellings(t):
    """A question in SQLite's words, by temporary SQL functions."""
    e = t("events")
    sql_functions.register(e.sparkSession)
    e.withColumn("at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).createOrReplaceTempView("events_of_text")
    return e.sparkSession.sql("""SELECT user_id, first_day, round(days, 6) AS days, busy, kinds, round(total, 4) AS total, since FROM (SELECT user_id, strftime('%Y-%m-%d', min(at)) AS first_day, julianday(max(at)) - julianday(min(at)) AS days, iif(count(*) > 20, 'many', 'few') AS busy,
group_concat(transform(array_sort(collect_list(struct(event_type, event_id))), x -> x.event_type), '|') AS kinds, total(collect_list(value)) AS total, unixepoch(min(at)) AS since FROM events_of_text GROUP BY user_id)""")


@_query(ORACLES["hierarchy_closure"])
def hierarchy_recursive(t):
    """The closure by a recursive WITH."""
    s = t("supplier")
    s.createOrReplaceTempView("supplier_rows")
    return s.sparkSession.sql("""WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey AS child_id, s_suppkey div 3 AS parent_id FROM supplier_rows WHERE s_suppkey > 0),
p(node, ancestor, depth) AS (SELECT child_id, parent_id, 1 FROM e UNION ALL SELECT p.node, e.parent_id, p.depth + 1 FROM p JOIN e ON p.ancestor = e.child_id)
SELECT node, ancestor, min(depth) AS depth FROM p GROUP BY node, ancestor""")


@_query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS missing FROM events""")
def variant_paths(t):
    """Properties as VARIANT, parsed once and read by path."""
    v = t("events").select("event_id", F.parse_json("props").alias("v"))
    return v.select("event_id", F.variant_get("v", "$.k", "bigint").alias("k"), F.try_variant_get("v", "$.none", "string").alias("missing"))


@_query(f"""WITH {_CLAIMS_SQL} SELECT entity_id, column_name, seq, CAST(sum(CASE WHEN value IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id, column_name ORDER BY seq) AS BIGINT) AS said FROM c""")
def claims_running_count(t):
    """How often a cell has been spoken of up to each claim."""
    from claimwright.operators.ordered import with_running

    rows = _claims(t).withColumn("one", F.when(F.col("value").isNotNull(), 1).otherwise(0))
    return with_running(rows, ("entity_id", "column_name"), "seq", "one", "said").select("entity_id", "column_name", "seq", "said")


@_query("""SELECT event_id, 'entities' AS section, 0 AS item_no, user_id AS who FROM events WHERE event_id % 3 <> 2 UNION ALL SELECT event_id, 'relations', 0, user_id + 1 FROM events WHERE event_id % 3 = 1""")
def payload_lateral(t):
    """Loose payloads beside their rows by the table function."""
    e = t("events")
    tables.register(e.sparkSession)
    who = lambda k: F.concat(F.lit('{"who": '), (F.col("user_id") + k).cast("string"), F.lit("}"))
    shape = F.col("event_id") % 3
    raw = F.when(shape == 0, F.concat(F.lit("```json\n["), who(0), F.lit("]\n```"))).when(shape == 1, F.concat(F.lit('{"entities": ['), who(0), F.lit('], "relations": ['), who(1), F.lit("]}"))).otherwise(F.lit("nothing"))
    e.select("event_id", raw.alias("raw")).createOrReplaceTempView("raw_payloads")
    found = e.sparkSession.sql("SELECT event_id, section, item_no, get_json_object(item, '$.who') AS who FROM raw_payloads, LATERAL payload_items(raw)")
    return found.withColumn("who", F.col("who").cast("bigint"))
