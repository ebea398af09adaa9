"""Registered queries over stored indexes of texts and vectors and over many names in many texts, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from claimwright.functions.text import terms
from claimwright.operators import grounding, search, vectors
from claimwright.operators.textindex import TextIndex
from claimwright.plans.queries import _KEY_SQL, ORACLES, _query
from claimwright.plans.registry import CONTRACT_SUFFIXES, HINT_COSINE
from claimwright.sources.lineage import shared_folder

# Texts ----------------------------------------------------------------------------------


@_query(ORACLES["fts_bm25"])
def fts_index_update(t):
    """An index that is built of other texts of every seventh document, and of none of every ninth, and takes the right ones in later."""
    d = t("documents")
    spark, k = d.sparkSession, F.col("doc_id")
    wrong = F.when(k % 7 == 0, F.concat(F.lit("that eraton the idiot "), F.reverse("text"))).otherwise(F.col("text"))
    index = TextIndex(spark, f"{shared_folder(spark)}/text-index-{uuid.uuid4().hex}")
    index.build(d.filter("doc_id % 9 <> 0").select("doc_id", wrong.alias("text"))).add(d.filter("doc_id % 7 = 0 OR doc_id % 9 = 0"))
    asked = t("benchmark").select(F.col("item_id").alias("question_id"), F.explode(terms("text")).alias("term"))
    return index.bm25(asked).select("question_id", "doc_id", F.round("score", 4).alias("score"), "rank")


@_query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM w GROUP BY term""")
def fts_vocabulary(t):
    """Every term with its documents and occurrences, read from the merged postings."""
    d = t("documents")
    spark = d.sparkSession
    index = TextIndex(spark, f"{shared_folder(spark)}/text-index-{uuid.uuid4().hex}").build(d.filter("doc_id % 2 = 0")).add(d.filter("doc_id % 2 = 1")).merge()
    return index.postings().groupBy("term").agg(F.sum("n").alias("documents"), F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)).alias("occurrences"))


# Vectors --------------------------------------------------------------------------------


def _asked(t):
    e = t("embeddings")
    items = e.select(F.col("vec_id").alias("item_id"), "embedding")
    return e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), items


def _vector_index(items):
    spark = items.sparkSession
    return vectors.VectorIndex(spark, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}").build(items)


@_query(ORACLES["cosine_topk"])
def vector_index_all_cells(t):
    """The join over all cells is the exact one."""
    asked, items = _asked(t)
    found = _vector_index(items).join(asked, 3, probes=vectors.MOST_CELLS)
    return found.select("query_id", "item_id", F.round("score", 4).alias("score"), "rank")


@_query("SELECT 3 * count(*) AS wanted, true AS recalled FROM embeddings WHERE vec_id % 50 = 0")
def vector_index_recall(t):
    """Whether the cells that the index probes give 0.9 or more of each query's three nearest items."""
    asked, items = _asked(t)
    return vectors.recall(_vector_index(items).join(asked, 3), search.cosine_top(asked, items, 3)).select("wanted", (F.col("recall") >= 0.9).alias("recalled"))


@_query(f"""WITH q AS (SELECT vec_id AS question_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0), v AS (SELECT 'label' || label % 4 AS source, 'value ' || vec_id // 2 AS value, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT question_id, source, value, max(list_cosine_similarity(q, v)) AS score FROM q, v GROUP BY ALL HAVING max(list_cosine_similarity(q, v)) >= {HINT_COSINE}),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id, source ORDER BY score DESC, value) AS rank FROM s)
SELECT question_id, source, value, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""")
def hint_vectors(t):
    """The vector leg of hints: values that resemble a question whose name is none of theirs."""
    e = t("embeddings")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), F.lit("").alias("q_key"), F.col("embedding").alias("q_vec"))
    values = e.select(F.concat(F.lit("label"), (F.col("label") % 4).cast("string")).alias("source"), F.concat(F.lit("value "), F.expr("vec_id div 2").cast("string")).alias("value"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("v_key"), F.col("embedding").alias("v_vec"))
    return search.column_hints(asked, values, vectors=True).select("question_id", "source", "value", F.round("score", 4).alias("score"), "rank")


# Grounding of whole extractions -----------------------------------------------------------

#: What a model might have found in each document: words of its text, one with a suffix, an invented one.
_FOUND_SQL = """f AS (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, text, unnest([{'i': 0, 'n': w[1], 's': '', 'k': ''}, {'i': 1, 'n': lower(w[1]), 's': 'seen', 'k': 'late'}, {'i': 2, 'n': w[-1] || '契約書', 's': '', 'k': 'c'}, {'i': 3, 'n': 'zzq' || doc_id, 's': w[2], 'k': 'd'}, {'i': 4, 'n': 'qqz' || doc_id, 's': '', 'k': 'e'}]) AS x FROM f)"""


def _found(t):
    d = t("documents").filter("text IS NOT NULL")
    w, k = F.split("text", " "), F.col("doc_id").cast("string")
    item = lambda i, name, surface, value: F.struct(F.lit(i).alias("idx"), name.alias("canonical_name"), surface.alias("mention_surface"), F.create_map(F.lit("k"), F.lit(value)).alias("attributes"))
    none = F.lit("")
    items = F.array(
        item(0, w[0], none, ""), item(1, F.lower(w[0]), F.lit("seen"), "late"), item(2, F.concat(F.element_at(w, -1), F.lit("契約書")), none, "c"),
        item(3, F.concat(F.lit("zzq"), k), F.coalesce(F.try_element_at(w, F.lit(2)), none), "d"), item(4, F.concat(F.lit("qqz"), k), none, "e"),
    )
    e = d.select(F.col("doc_id").alias("document_id"), F.explode(items).alias("x")).select("document_id", "x.*")
    return d, e.withColumn("proposed_type", F.lit("thing")).withColumn("confidence", F.lit(0.5)).withColumn("evidence", F.lit(None).cast("string"))


_INSIDE = "({0} <> '' AND contains(lower(text), lower({0})))"
_BARE = f"""coalesce(CASE {" ".join(f"WHEN ends_with(x.n, '{s}') AND length(x.n) > {len(s)} THEN left(x.n, length(x.n) - {len(s)})" for s in CONTRACT_SUFFIXES)} END, '')"""


@_query(f"""WITH {_FOUND_SQL}, g AS (SELECT doc_id, x.i AS i, x.n AS n, x.s AS s, x.k AS k, {_KEY_SQL.format('x.n')} AS norm_key FROM e WHERE x.n <> '' AND ({_INSIDE.format('x.n')} OR {_INSIDE.format('x.s')} OR {_INSIDE.format(_BARE)}))
SELECT doc_id, norm_key, arg_min(n, i) AS canonical_name, arg_min(s, i) FILTER (s <> '') AS mention_surface, arg_min(k, i) FILTER (k <> '') AS k FROM g GROUP BY doc_id, norm_key""")
def extraction_grounded(t):
    """Extractions grounded in their text, then merged by name."""
    d, found = _found(t)
    nothing = found.limit(0).select("document_id", F.lit("").alias("from"), F.lit("").alias("to"), F.lit("").alias("proposed_junction"))
    kept, _ = grounding.extracted(found, nothing, d.select(F.col("doc_id").alias("document_id"), F.col("text").alias("body")))
    return kept.select(F.col("document_id").alias("doc_id"), "norm_key", "canonical_name", "mention_surface", F.col("attributes")["k"].alias("k"))


@_query(f"""WITH {_FOUND_SQL}, r AS (SELECT doc_id, text, w[1] AS l, unnest([{{'r': w[-1], 'j': 'employment'}}, {{'r': 'zzq' || doc_id, 'j': 'employment'}}, {{'r': 'ISO 9001', 'j': 'compliance'}}, {{'r': '', 'j': 'compliance'}}]) AS x FROM f)
SELECT doc_id, x.j AS junction, x.r AS other FROM r WHERE {_INSIDE.format('l')} AND x.r <> '' AND (x.j = 'compliance' OR {_INSIDE.format('x.r')})""")
def extraction_relations(t):
    """Relations of extractions whose ends stand in the text, whatever became of the entities."""
    d, found = _found(t)
    w = F.split("text", " ")
    end = lambda other, junction: F.struct(other.alias("to"), F.lit(junction).alias("proposed_junction"))
    ends = F.array(end(F.element_at(w, -1), "employment"), end(F.concat(F.lit("zzq"), F.col("doc_id").cast("string")), "employment"), end(F.lit("ISO 9001"), "compliance"), end(F.lit(""), "compliance"))
    said = d.select(F.col("doc_id").alias("document_id"), w[0].alias("from"), F.explode(ends).alias("x")).select("document_id", "from", "x.*")
    _, kept = grounding.extracted(found, said, d.select(F.col("doc_id").alias("document_id"), F.col("text").alias("body")))
    return kept.select(F.col("document_id").alias("doc_id"), F.col("proposed_junction").alias("junction"), F.col("to").alias("other"))


@_query("""WITH n AS (SELECT DISTINCT trim(w) AS name FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE length(trim(w)) >= 6)
SELECT name, count(*) AS documents FROM n JOIN documents ON contains(lower(text), lower(name)) GROUP BY name""")
def grounding_many_names(t):
    """Thousands of names against all texts, each text read once."""
    names = t("benchmark").select(F.explode(F.split("text", " ")).alias("w")).select(F.trim("w").alias("name")).filter("length(name) >= 6").distinct()
    found = grounding.grounded_anywhere(names.select(F.col("name").alias("name_id"), "name"), t("documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("body")))
    return found.groupBy(F.col("name_id").alias("name")).agg(F.count("*").alias("documents"))
