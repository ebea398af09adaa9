"""Further registered queries: grounding, merging, lookups, keys, logs, vectors and texts of the store, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimwright.functions.confidence import byte_offsets
from claimwright.functions.names import suffix_stripped
from claimwright.functions.text import slug, title
from claimwright.operators import audit, claims, edges, entities, evaluation, grounding, routing, search
from claimwright.plans import catalog
from claimwright.plans.queries import _KEY_SQL, _NAMES_SQL, _QUESTION, _RESOLVE_SQL, ORACLES, _claims, _index, _names, _query
from claimwright.plans.registry import CANDIDATE_COSINE, CONTRACT_SUFFIXES, FTS_TOP, HINT_CHARS, HUMAN_DOCUMENT_ID

# Documents, grounding and merging -------------------------------------------------------


@_query(f"SELECT c_custkey AS id, c_name AS slug FROM customer WHERE c_custkey <> {HUMAN_DOCUMENT_ID}")
def documents_newest(t):
    rows = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("slug"), F.col("c_acctbal").alias("ingested_at"))
    return audit.documents_list(rows).select("id", "slug")


@_query("""WITH r AS (SELECT doc_id, text, split_part(text, ' ', 1) AS f, CASE doc_id % 3 WHEN 0 THEN 'zzzq' WHEN 1 THEN '' ELSE split_part(text, ' ', -1) END AS t, CASE WHEN doc_id % 2 = 0 THEN 'compliance' ELSE 'employment' END AS j FROM documents)
SELECT doc_id, j AS junction FROM r WHERE f <> '' AND t <> '' AND (j = 'compliance' OR contains(lower(text), lower(t)))""")
def relations_grounded(t):
    """Both ends must stand in the text; of compliance only the first."""
    d = t("documents").filter("text IS NOT NULL")
    end = F.when(F.col("doc_id") % 3 == 0, "zzzq").when(F.col("doc_id") % 3 == 1, "").otherwise(F.substring_index("text", " ", -1))
    junction = F.when(F.col("doc_id") % 2 == 0, "compliance").otherwise("employment")
    said = d.select(F.col("doc_id").alias("document_id"), F.substring_index("text", " ", 1).alias("from"), end.alias("to"), junction.alias("proposed_junction"))
    found = grounding.grounded_relations(said, d.select(F.col("doc_id").alias("document_id"), F.col("text").alias("body")))
    return found.select(F.col("document_id").alias("doc_id"), F.col("proposed_junction").alias("junction"))


@_query("""WITH a AS (SELECT event_id, unnest([{'n': 'type', 'v': event_type}, {'n': 'blank', 'v': ''}, {'n': 'k', 'v': CASE WHEN event_id % 3 <> 0 THEN json_extract_string(props, '$.k') END}]) AS c FROM events)
SELECT event_id, c.n AS name, c.v AS value FROM a WHERE c.v <> ''""")
def attributes_non_empty(t):
    k = F.when(F.col("event_id") % 3 != 0, F.get_json_object("props", "$.k"))
    cells = F.create_map(F.lit("type"), F.col("event_type"), F.lit("blank"), F.lit(""), F.lit("k"), k)
    return t("events").select("event_id", F.explode(grounding.non_empty(cells)).alias("name", "value"))


@_query("""WITH e AS (SELECT user_id % 50 AS document_id, event_type AS proposed_type, event_id AS idx, 'name' || user_id % 7 AS norm_key, CASE WHEN event_id % 2 = 0 THEN 'NAME ' ELSE 'Name ' END || user_id % 7 AS n,
CASE WHEN event_id % 4 = 0 THEN 'S' || event_id ELSE '' END AS s, value AS c, CASE WHEN event_id % 3 = 0 THEN '' ELSE json_extract_string(props, '$.k') END AS k FROM events)
SELECT document_id, proposed_type, norm_key, arg_min(n, idx) AS canonical_name, arg_min(s, idx) FILTER (s <> '') AS mention_surface, max(c) AS confidence, arg_min(k, idx) FILTER (k <> '') AS k FROM e GROUP BY document_id, proposed_type, norm_key""")
def entities_merged(t):
    """Mentions of one name in a document become one entity: first name, first surface, per attribute the first value."""
    number = (F.col("user_id") % 7).cast("string")
    e = t("events").select(
        (F.col("user_id") % 50).alias("document_id"), F.col("event_id").alias("idx"), F.col("event_type").alias("proposed_type"),
        F.concat(F.when(F.col("event_id") % 2 == 0, "NAME ").otherwise("Name "), number).alias("canonical_name"),
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("S"), F.col("event_id").cast("string"))).otherwise("").alias("mention_surface"),
        F.create_map(F.lit("k"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.get_json_object("props", "$.k"))).alias("attributes"),
        F.col("value").alias("confidence"), F.lit(None).cast("string").alias("evidence"),
    )
    return grounding.merged(e).select("document_id", "proposed_type", "norm_key", "canonical_name", "mention_surface", "confidence", F.col("attributes")["k"].alias("k"))


@_query("""WITH n AS (SELECT event_id, 'N' || user_id % 30 AS name, CASE event_id % 3 WHEN 0 THEN 'organization' WHEN 1 THEN 'person' END AS hint FROM events),
e AS (SELECT ['person', 'organization', 'product'][1 + s_suppkey % 3] AS entity_table, s_suppkey AS entity_id, 'N' || s_suppkey % 30 AS name FROM supplier),
r AS (SELECT event_id, entity_table, entity_id, row_number() OVER (PARTITION BY event_id ORDER BY entity_table = coalesce(hint, '') DESC, list_position(['person', 'organization', 'product'], entity_table), entity_id) AS rank FROM n JOIN e USING (name))
SELECT event_id, entity_table, entity_id FROM r WHERE rank = 1""")
def names_lookup(t):
    hint = F.when(F.col("event_id") % 3 == 0, "organization").when(F.col("event_id") % 3 == 1, "person")
    asked = t("events").select(F.col("event_id").alias("name_id"), F.concat(F.lit("N"), (F.col("user_id") % 30).cast("string")).alias("name"), hint.alias("hint"))
    order = ("person", "organization", "product")
    kind = F.element_at(F.array(*map(F.lit, order)), (F.col("s_suppkey") % 3 + 1).cast("int"))
    known = t("supplier").select(kind.alias("entity_table"), F.col("s_suppkey").alias("entity_id"), F.concat(F.lit("N"), (F.col("s_suppkey") % 30).cast("string")).alias("canonical_name"))
    return entities.lookup(asked, known, order).select(F.col("name_id").alias("event_id"), "entity_table", "entity_id")


_SUFFIX_SQL = "CASE " + " ".join(f"WHEN ends_with(n, '{s}') AND length(n) > {len(s)} THEN left(n, length(n) - {len(s)})" for s in CONTRACT_SUFFIXES) + " END"


@_query(f"WITH n AS (SELECT n_nationkey, CASE WHEN n_nationkey % 8 = 7 THEN '' ELSE n_name END || {[*CONTRACT_SUFFIXES, 'x', '書']}[1 + n_nationkey % 8] AS n FROM nation) SELECT n_nationkey, n AS name, {_SUFFIX_SQL} AS bare FROM n")
def suffixes_stripped(t):
    k = F.col("n_nationkey") % 8
    name = F.concat(F.when(k == 7, "").otherwise(F.col("n_name")), F.element_at(F.array(*map(F.lit, (*CONTRACT_SUFFIXES, "x", "書"))), k + 1))
    return t("nation").select("n_nationkey", name.alias("name")).withColumn("bare", suffix_stripped("name"))


@_query(r"""SELECT c_custkey, replace(regexp_replace(f, '(.)\.[^.]*$', '\1'), ' ', '-') AS slug, replace(replace(regexp_replace(f, '(.)\.[^.]*$', '\1'), ' ', '-'), '-', ' ') AS title
FROM (SELECT c_custkey, 'My report ' || c_name || CASE c_custkey % 3 WHEN 0 THEN '.v2.pdf' WHEN 1 THEN '.md' ELSE '' END AS f FROM customer)""")
def document_slugs(t):
    k = F.col("c_custkey") % 3
    name = F.concat(F.lit("My report "), "c_name", F.when(k == 0, ".v2.pdf").when(k == 1, ".md").otherwise(""))
    return t("customer").select("c_custkey", slug(name).alias("slug")).withColumn("title", title("slug"))


@_query("""WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS token, generate_subscripts(string_split(text, ' '), 1) AS pos FROM benchmark)
SELECT item_id, pos - 1 AS pos, CAST(coalesce(sum(strlen(token)) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(sum(strlen(token)) OVER (PARTITION BY item_id ORDER BY pos) AS BIGINT) AS "end" FROM w""")
def token_offsets(t):
    words = t("benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "token"))
    return byte_offsets(words, "item_id").select("item_id", "pos", "start", "end")


@_query("SELECT doc_id, sha1('small-model|' || text) AS key FROM documents")
def embedding_keys(t):
    return t("documents").select("doc_id", F.sha1(F.concat(F.lit("small-model|"), "text")).alias("key"))


# Entities, claims and edges -------------------------------------------------------------


@_query(f"WITH {_NAMES_SQL}, k AS (SELECT name, {_KEY_SQL.format('name')} AS norm_key FROM n) SELECT DISTINCT name AS alias, norm_key FROM k WHERE norm_key <> ''")
def entity_aliases(t):
    return entities.aliases_of(entities.upsert_entities(_names(t))).select("alias", "norm_key")


_VERDICTS_SQL = _RESOLVE_SQL.replace("FROM events)", f"FROM events UNION ALL SELECT user_id, event_type, 'verdict', {HUMAN_DOCUMENT_ID}, 1.0, max(event_id) + 10000000, max(ts) FROM events WHERE user_id % 10 = 0 GROUP BY user_id, event_type)", 1)


@_query(_VERDICTS_SQL + "SELECT entity_id, column_name, document_id, value, confidence, pivot_value, status FROM resolved")
def claims_human_verdicts(t):
    """A person's verdict on every tenth user's cells, resolved with the machine's claims."""
    last = t("events").filter("user_id % 10 = 0").groupBy("user_id", "event_type").agg((F.max("event_id") + 10000000).alias("seq"))
    said = last.select(*claims.human_verdict("user", F.col("user_id"), F.col("event_type"), F.lit("verdict"), F.col("seq")))
    every = _claims(t).drop("ts").unionByName(said)
    found = claims.resolve(claims.split_low_confidence(every).filter("route = 'accepted'"))
    return found.select("entity_id", "column_name", "document_id", "value", "confidence", "pivot_value", "status")


@_query("""WITH r AS (SELECT o_custkey % 100 AS person_id, o_orderkey % 7 AS organization_id, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y') END AS start_date, o_orderkey AS seq FROM orders)
SELECT person_id, organization_id, start_date, min(seq) AS seq, count(*) AS arrivals FROM r GROUP BY person_id, organization_id, start_date""")
def edge_employments(t):
    started = F.when(F.col("o_orderkey") % 3 != 0, F.date_format("o_orderdate", "yyyy"))
    rows = t("orders").select((F.col("o_custkey") % 100).alias("person_id"), (F.col("o_orderkey") % 7).alias("organization_id"), started.alias("start_date"), F.col("o_orderkey").alias("seq"))
    return edges.find_or_create_employment(rows).select("person_id", "organization_id", "start_date", "seq", "arrivals")


@_query("""WITH r AS (SELECT ['employment', 'manufacturing', 'org_hierarchy', 'product_variant', 'governance', 'compliance', 'friend_of'][1 + l_partkey % 7] AS j, CASE WHEN l_suppkey % 11 <> 0 THEN l_suppkey END AS l, CASE WHEN l_orderkey % 13 <> 0 THEN l_orderkey % 50 END AS r, CASE WHEN l_linenumber <> 1 THEN '2020' END AS s FROM lineitem),
k AS (SELECT CASE WHEN l IS NULL OR r IS NULL THEN NULL WHEN j = 'employment' THEN j || '|' || l || '|' || r || '|' || coalesce(s, '') WHEN j = 'manufacturing' THEN j || '|' || l WHEN j IN ('org_hierarchy', 'product_variant') THEN j || '|' || r WHEN j IN ('governance', 'compliance') THEN j || '|' || l || '|' || r END AS key FROM r)
SELECT key, count(*) AS n FROM k GROUP BY key""")
def edge_cardinality_keys(t):
    names = ("employment", "manufacturing", "org_hierarchy", "product_variant", "governance", "compliance", "friend_of")
    junction = F.element_at(F.array(*map(F.lit, names)), (F.col("l_partkey") % 7 + 1).cast("int"))
    left, right = F.when(F.col("l_suppkey") % 11 != 0, F.col("l_suppkey")), F.when(F.col("l_orderkey") % 13 != 0, F.col("l_orderkey") % 50)
    return t("lineitem").groupBy(edges.cardinality_key(junction, left, right, F.when(F.col("l_linenumber") != 1, "2020")).alias("key")).agg(F.count("*").alias("n"))


@_query("""WITH e AS (SELECT DISTINCT o_custkey AS p, o_orderkey % 7 AS o FROM orders), c AS (SELECT p_partkey AS k, 'ISO ' || p_size AS s FROM part), n AS (SELECT 'person' AS t, c_custkey AS i, c_name AS n FROM customer UNION ALL SELECT 'organization', n_nationkey, n_name FROM nation),
v AS (SELECT 'person' AS entity_table, p AS entity_id, 'employment' AS relation, 'out' AS direction, 'organization' AS other_table, o AS other_id, NULL AS x FROM e UNION ALL SELECT 'organization', o, 'employment', 'in', 'person', p, NULL FROM e UNION ALL SELECT 'contract', k, 'compliance', 'out', NULL, NULL, s FROM c)
SELECT entity_table, entity_id, relation, direction, other_table, other_id, coalesce(n.n, x) AS other_name FROM v LEFT JOIN n ON n.t = other_table AND n.i = other_id""")
def relation_both_ends(t):
    """Two junctions seen from both ends in one shape."""
    jobs = t("orders").select(F.col("o_custkey").alias("person_id"), (F.col("o_orderkey") % 7).alias("organization_id")).distinct()
    rules = t("part").select(F.col("p_partkey").alias("contract_id"), F.concat(F.lit("ISO "), F.col("p_size").cast("string")).alias("standard_name"))
    known = t("customer").select(F.lit("person").alias("entity_table"), F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("canonical_name"))
    known = known.union(t("nation").select(F.lit("organization"), F.col("n_nationkey").cast("bigint"), "n_name"))
    return edges.relation_view({"employment": jobs, "compliance": rules}, known)


# Routing, logs and versions -------------------------------------------------------------


@_query("""SELECT event_id AS weak_id, event_type AS predicate, CASE WHEN event_id % 2 = 0 THEN 'person' ELSE 'organization' END AS subject_table, user_id AS subject_id, CASE WHEN event_id % 4 = 0 THEN 'product' END AS object_table,
CASE WHEN event_id % 4 = 0 THEN user_id + 1 END AS object_id, CASE WHEN event_id % 4 <> 0 THEN 'thing ' || user_id END AS object_text FROM events WHERE event_id % 3 <> 0""")
def weak_routed(t):
    """Weak relations whose subject resolves; their object's id where that does, else its text."""
    e = t("events")
    weak = e.select(F.col("event_id").alias("weak_id"), F.col("event_type").alias("predicate"), F.concat(F.lit("thing "), F.col("user_id").cast("string")).alias("object"))
    subjects = e.filter("event_id % 3 <> 0").select(F.col("event_id").alias("name_id"), F.when(F.col("event_id") % 2 == 0, "person").otherwise("organization").alias("entity_table"), F.col("user_id").alias("entity_id"))
    things = e.filter("event_id % 4 = 0").select(F.col("event_id").alias("name_id"), F.lit("product").alias("entity_table"), (F.col("user_id") + 1).alias("entity_id"))
    return routing.route_weak(weak, subjects, things).select("weak_id", "predicate", "subject_table", "subject_id", "object_table", "object_id", "object_text")


@_query("""SELECT event_id, to_json({'reason': event_type, 'detail': {'user': user_id, 'value': json_extract_string(props, '$.k')}}) AS summary,
to_json({'reason': 'in_document_alternative', 'loser': {'idx': event_id}, 'winner': {'idx': event_id + 1, 'name': event_type}}) AS staged FROM events""")
def staging_summaries(t):
    detail = F.struct(F.col("user_id").alias("user"), F.get_json_object("props", "$.k").alias("value"))
    staged = routing.staged_loser(F.struct(F.col("event_id").alias("idx")), F.struct((F.col("event_id") + 1).alias("idx"), F.col("event_type").alias("name")))
    return t("events").select("event_id", routing.match_summary(F.col("event_type"), detail=detail).alias("summary"), staged.alias("staged"))


@_query("""WITH s AS (SELECT user_id % 200 AS id, arg_max(['pending', 'approved', 'rejected'][1 + event_id % 3], event_id) AS now FROM events GROUP BY 1)
SELECT d.id AS proposal_id, coalesce(now = 'pending', false) AS accepted FROM (SELECT DISTINCT c_custkey % 250 AS id FROM customer) d LEFT JOIN s USING (id)""")
def proposal_decisions(t):
    """Only what is pending in its newest state may be decided."""
    status = F.element_at(F.array(*map(F.lit, ("pending", "approved", "rejected"))), (F.col("event_id") % 3 + 1).cast("int"))
    log = t("events").select((F.col("user_id") % 200).alias("proposal_id"), status.alias("status"), F.col("event_id").alias("seq"))
    return routing.decide(log, t("customer").select((F.col("c_custkey") % 250).alias("proposal_id")).distinct()).select("proposal_id", "accepted")


@_query("SELECT event_id, user_id FROM events WHERE event_id % 3 = 0")
def staging_open(t):
    rows = t("events").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, "pending").otherwise("approved").alias("status"), F.col("event_id").alias("seq"))
    return audit.open_items(rows).select("event_id", "user_id")


@_query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders)")
def dangling_references(t):
    return audit.dangling(t("events").select("event_id", "user_id"), "user_id", t("orders").select("o_custkey"), "o_custkey").select("event_id", "user_id")


@_query("SELECT 'some' AS log, CAST(max(r_regionkey) + 1 AS BIGINT) AS version FROM region UNION ALL SELECT 'none', 1")
def catalog_version(t):
    log = t("region").select(F.col("r_regionkey").alias("version"))
    return catalog.next_version(log).select(F.lit("some").alias("log"), "version").union(catalog.next_version(log.filter("version < 0")).select(F.lit("none"), "version"))


@_query("""WITH m AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS a, CASE WHEN c_custkey % 3 = 0 THEN 1.5 END AS b, CASE WHEN c_custkey % 5 = 0 THEN c_nationkey + 0.0 END AS c FROM customer)
SELECT c_custkey, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0), 6) AS headline FROM m""")
def headline_scores(t):
    k = F.col("c_custkey")
    rows = t("customer").select(k, F.when(k % 2 == 0, F.col("c_acctbal")).alias("a"), F.when(k % 3 == 0, 1.5).alias("b"), F.when(k % 5 == 0, F.col("c_nationkey").cast("double")).alias("c"))
    return rows.select("c_custkey", F.round(evaluation.headline(["a", "b", "c"]), 6).alias("headline"))


# Vectors and search ---------------------------------------------------------------------


@_query(f"""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, 'type' || label % 3 AS entity_table, vec_id AS entity_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, entity_table ORDER BY score DESC, entity_id) AS rank FROM s WHERE score >= {CANDIDATE_COSINE})
SELECT query_id, entity_table, entity_id, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def entity_candidates_vectors(t):
    """The cosine leg alone: the queries' names are empty."""
    e = t("embeddings")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.lit("").alias("norm_key"), "embedding")
    known = e.select(F.concat(F.lit("type"), (F.col("label") % 3).cast("string")).alias("entity_table"), F.col("vec_id").alias("entity_id"), F.concat(F.lit("e"), F.col("vec_id").cast("string")).alias("norm_key"), "embedding")
    return entities.candidates(asked, known, vectors=True).select("query_id", "entity_table", "entity_id", "score", "rank")


@_query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS score FROM embeddings, q),
a AS (SELECT 'vector' AS how, vec_id, round(score, 4) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 5), b AS (SELECT 'head' AS how, vec_id, CAST(NULL AS DOUBLE) AS score FROM embeddings ORDER BY vec_id LIMIT 5) SELECT * FROM a UNION ALL SELECT * FROM b""")
def vector_top_or_head(t):
    """The nearest items to a question's vector, and the first ones where it has none."""
    e = t("embeddings").select("vec_id", "embedding")
    asked = [float(x) for x in e.filter("vec_id = 0").first()["embedding"]]
    parts = [search.top_or_head(v, e, 5, "vec_id").select(F.lit(how).alias("how"), "vec_id", F.round("score", 4).alias("score")) for how, v in (("vector", asked), ("head", None))]
    return parts[0].union(parts[1])


@_query(ORACLES["hint_scores"].rpartition("SELECT")[0] + f""", l AS (SELECT question_id, source || ': ' || string_agg(value, ', ' ORDER BY rank) AS line FROM w WHERE rank <= 3 GROUP BY question_id, source)
SELECT question_id, substr(string_agg(line, chr(10) ORDER BY line), 1, {HINT_CHARS}) AS hints FROM l GROUP BY question_id""")
def hint_texts(t):
    p = t("part")
    values = p.select(F.lit("part.name").alias("source"), F.col("p_name").alias("value"), F.replace("p_name", F.lit(" "), F.lit("")).alias("v_key")).distinct()
    values = values.union(p.select(F.lit("part.type"), "p_type", F.lower("p_type")).distinct())
    asked = p.groupBy("p_name").agg(F.min("p_partkey").alias("question_id"), F.lower(F.min("p_type")).alias("type"))
    asked = asked.select("question_id", F.concat(F.lit("whichsuppliersmakethe"), F.replace("p_name", F.lit(" "), F.lit("")), F.lit("incheap"), "type").alias("q_key"))
    return search.hint_text(search.column_hints(asked, values))


@_query(f"""WITH f AS ({ORACLES["fts_or_match"]}), p AS ({ORACLES["union_provenance"]}) SELECT 'doc-' || doc_id AS slug FROM f UNION SELECT slug FROM p""")
def answer_slugs(t):
    """The documents of an answer: those that full text finds and those that stand behind its strings."""
    found = _index(t).match(_QUESTION, FTS_TOP).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("slug"))
    p, li, o = t("part"), t("lineitem"), t("orders")
    known = p.select(F.lit("part").alias("entity_table"), F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("canonical_name"))
    backed = li.select(F.lit("part").alias("entity_table"), F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("document_id"), F.when(F.col("l_returnflag") == "A", "active").otherwise("superseded").alias("status"))
    slugs = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("slug"))
    return search.slugs_of(found, search.provenance(search.candidate_strings(p.filter("p_size > 40").select("p_name"), None), known, backed, slugs))


@_query("""WITH e AS (SELECT n_regionkey AS question_id, n_nationkey AS rank, 'who is in ' || n_name AS q, 'SELECT ' || n_nationkey AS sql, CASE WHEN n_nationkey % 2 = 0 THEN 'even' END AS note FROM nation)
SELECT question_id, string_agg('Q: ' || q || chr(10) || 'SQL: ' || sql || coalesce(chr(10) || 'Note: ' || note, ''), chr(10) || chr(10) ORDER BY rank) AS examples FROM e GROUP BY question_id""")
def example_texts(t):
    k = F.col("n_nationkey")
    rows = t("nation").select(F.col("n_regionkey").alias("question_id"), k.alias("rank"), F.concat(F.lit("who is in "), "n_name").alias("q"), F.concat(F.lit("SELECT "), k.cast("string")).alias("sql"), F.when(k % 2 == 0, "even").alias("note"))
    return search.example_text(rows)


@_query("""WITH e AS (SELECT DISTINCT s_nationkey AS document_id, 'supplier' AS k, s_name AS n FROM supplier UNION SELECT c_nationkey, lower(c_mktsegment), c_name FROM customer), l AS (SELECT document_id, '- ' || k || ': ' || string_agg(n, ', ' ORDER BY n) AS line FROM e GROUP BY document_id, k)
SELECT document_id, string_agg(line, chr(10) ORDER BY line) AS known FROM l GROUP BY document_id""")
def known_texts(t):
    rows = t("supplier").select(F.col("s_nationkey").alias("document_id"), F.lit("supplier").alias("proposed_type"), F.col("s_name").alias("canonical_name"))
    return search.known_text(rows.union(t("customer").select("c_nationkey", F.lower("c_mktsegment"), "c_name")))


@_query("""WITH c AS (SELECT o_orderkey, o_orderstatus <> 'P' AS sql_ok, lower(o_orderpriority) AS a, lower(o_orderstatus) AS b, o_custkey % 3 AS m FROM orders)
SELECT o_orderkey AS question_id, sql_ok, CASE m WHEN 0 THEN NULL WHEN 1 THEN (CAST(contains(a, 'high') OR contains(b, 'high') AS INT) + CAST(contains(a, 'f') OR contains(b, 'f') AS INT)) / 2 ELSE CAST(contains(a, '1-') OR contains(b, '1-') AS INT) / 1 END AS contains,
CASE m WHEN 2 THEN NULL ELSE (CAST(o_orderkey % 2 = 0 AS INT) + 1) / 2 END AS slugs FROM c""")
def question_scores(t):
    """Answers that hold all, some or none of what was wanted of them, and of the documents."""
    m, even = F.col("o_custkey") % 3, F.col("o_orderkey") % 2 == 0
    wanted = F.when(m == 0, F.array().cast("array<string>")).when(m == 1, F.array(F.lit("HIGH"), F.lit("f"))).otherwise(F.array(F.lit(" 1 -")))
    slugs = F.when(m == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b")))
    cases = t("orders").select(
        F.col("o_orderkey").alias("question_id"), (F.col("o_orderstatus") != "P").alias("sql_ok"), F.array("o_orderpriority", "o_orderstatus").alias("cells"), wanted.alias("wanted"),
        F.when(even, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("c"))).alias("found_slugs"), slugs.alias("wanted_slugs"),
    )
    return evaluation.question_scores(cases)


@_query("""SELECT event_id AS seq, event_type AS column_name, user_id AS edge_id, o_orderstatus AS role, c_name AS other_name FROM events JOIN orders ON o_orderkey = user_id JOIN customer ON c_custkey = o_custkey""")
def claims_of_edges(t):
    """Claims about edges, with the edge and the entity at its end."""
    said = t("events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("column_name"), F.col("user_id").alias("edge_id"))
    made = t("orders").select(F.col("o_orderkey").alias("edge_id"), F.col("o_orderstatus").alias("role"), F.lit("customer").alias("other_table"), F.col("o_custkey").alias("other_id"))
    known = t("customer").select(F.lit("customer").alias("entity_table"), F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("canonical_name"))
    return audit.claim_history(said, made, known).select("seq", "column_name", "edge_id", "role", "other_name")
