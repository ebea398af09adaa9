"""Search: full text, provenance, hints and vector neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimwright.functions.names import cosine
from claimwright.functions.text import snippet, terms
from claimwright.operators.similarity import containment_join, similarity_join
from claimwright.plans.registry import FTS_TOP, HINT_CHARS, HINT_COSINE, HINT_TOP, HINT_TRIGRAM, PROVENANCE_STRINGS, PROVENANCE_TOP


#: Query rows, and bytes of them, broadcast at once; more are scored block by block.
QUERIES_PER_BLOCK = 4096
QUERY_BYTES_PER_BLOCK = 16 << 20
#: Scores that one product holds at once; a batch of items is taken in slices of so many.
SCORES_AT_ONCE = 1 << 20


def fts(documents: DataFrame, question: str, top: int = FTS_TOP, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The first `top` documents by id that hold any of the question's terms, with a snippet, by a scan where there is no index; only the first 200 characters of the question count."""
    found = documents.filter(F.arrays_overlap(terms(text_column), terms(F.lit(question[:200])))).orderBy(id_column).limit(top)
    return found.select(id_column, snippet(text_column, terms(F.lit(question[:200]))).alias("snippet"))


def snippets(found: DataFrame, documents: DataFrame, question: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, snippet) of documents that an index found, few as they are; their ids go down to the scan of the texts."""
    ids = [r[0] for r in found.select(id_column).collect()]
    return documents.filter(F.col(id_column).isin(ids)).select(id_column, snippet(text_column, terms(F.lit(question[:200]))).alias("snippet"))


def _blocks(queries: DataFrame, key: str, most: int) -> list[DataFrame]:
    """The queries in blocks of at most about `most` rows and QUERY_BYTES_PER_BLOCK bytes."""
    size = F.length(F.to_json(F.struct("*"))).cast("long")
    rows, weight = queries.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    blocks = max(1, -(-rows // most), -(-weight // QUERY_BYTES_PER_BLOCK))
    return [queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == k) for k in range(blocks)]


def _unit(vectors: list, wide: int) -> np.ndarray:
    """Unit rows in doubles; a vector of another length, or without any, is all zeros."""
    out = np.zeros((len(vectors), wide))
    for k, v in enumerate(vectors):
        if v is not None and len(v) == wide:
            out[k] = v
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _slices(batch: pa.RecordBatch, queries: int) -> Iterator[pa.RecordBatch]:
    """A batch of items in slices that make at most about SCORES_AT_ONCE scores with so many queries."""
    rows = max(64, SCORES_AT_ONCE // max(queries, 1))
    for start in range(0, len(batch), rows):
        yield batch.slice(start, rows)


def _nearest(row: np.ndarray, place: np.ndarray, top: int) -> np.ndarray:
    """The places of the `top` greatest scores of a row, the first in order among equal ones."""
    if len(row) <= top:
        return np.arange(len(row))
    lowest = np.partition(row, -top)[-top]
    over, level = np.flatnonzero(row > lowest), np.flatnonzero(row == lowest)
    return np.concatenate([over, level[np.argsort(place[level])][: top - len(over)]])


def cosine_top(queries: DataFrame, items: DataFrame, top: int, query_id: str = "query_id", item_id: str = "item_id", vector: str = "embedding", least: float | None = None) -> DataFrame:
    """Per query the `top` items by cosine, equal scores by item id; exact, every item is scored.

    The queries, a stated set, come to the items in blocks; a batch of items is scored by
    one product per vector length and hands on each query's nearest ones, which are ranked
    again over all batches.  Vectors of different lengths, empty or zero ones score 0.
    """
    kinds = {name: df.schema[name].dataType for name, df in ((query_id, queries), (item_id, items))}
    schema = ", ".join([*(f"`{name}` {kind.simpleString()}" for name, kind in kinds.items()), "score double"])

    def scored(block: pa.Table) -> DataFrame:
        ids, own = block.column(0).combine_chunks(), [v or [] for v in block.column(1).to_pylist()]
        asked = []
        for wide in sorted({len(v) for v in own}):
            mine = [k for k, v in enumerate(own) if len(v) == wide]
            asked.append((mine, _unit([own[k] for k in mine], wide), wide))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                # each slice's nearest, and of these the batch's
                parts = [near(part, start) for start, part in placed(batch)]
                query, at, value = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, int),) * 3
                if not len(query):
                    continue
                place = np.empty(len(batch), np.int64)
                place[pc.sort_indices(batch.column(0)).to_numpy()] = np.arange(len(batch))
                order = np.lexsort((place[at], -value, query))
                query, at, value = query[order], at[order], value[order]
                heads = np.flatnonzero(np.r_[True, np.diff(query) != 0])
                kept = np.arange(len(query)) - np.repeat(heads, np.diff(np.r_[heads, len(query)])) < top
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(query[kept])), batch.column(0).take(pa.array(at[kept])), pa.array(value[kept])], names=[query_id, item_id, "score"])

        def placed(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
            start = 0
            for part in _slices(batch, len(ids)):
                yield start, part
                start += len(part)

        def near(part: pa.RecordBatch, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            vectors, place = part.column(1).to_pylist(), np.empty(len(part), np.int64)
            place[pc.sort_indices(part.column(0)).to_numpy()] = np.arange(len(part))
            query, at, value = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
            for mine, unit, wide in asked:
                scores = unit @ _unit(vectors, wide).T
                kept = [_nearest(row, place, top) for row in scores]
                if least is not None:
                    kept = [x[row[x] >= least] for x, row in zip(kept, scores, strict=True)]
                query.append(np.repeat(mine, [len(x) for x in kept]))
                at += [x + start for x in kept]
                value += [row[x] for x, row in zip(kept, scores, strict=True)]
            return np.concatenate(query), np.concatenate(at), np.concatenate(value)

        return items.select(item_id, vector).mapInArrow(score, schema)

    parts = [scored(mine.toArrow()) for mine in _blocks(queries.select(query_id, vector), query_id, QUERIES_PER_BLOCK)]
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), item_id))
    return reduce(DataFrame.union, parts).withColumn("rank", rank).filter(F.col("rank") <= top)


def cosine_groups(queries: DataFrame, items: DataFrame, top: int, least: float) -> DataFrame:
    """(query_id, group, item_id, score): per query and group every item that may be among the `top` of `least` or more; exact.

    queries: query_id, embedding; items: group, item_id, embedding, where an item may have
    several vectors and counts by its best.  A batch of items is scored by products, as
    in `cosine_top`, and hands on each query's `top` different items of each group.
    """
    kinds = [queries.schema["query_id"].dataType, items.schema["group"].dataType, items.schema["item_id"].dataType]
    schema = ", ".join([*(f"{n} {k.simpleString()}" for n, k in zip(("query_id", "group", "item_id"), kinds, strict=True)), "score double"])

    def scored(block: pa.Table) -> DataFrame:
        ids, own = block.column("query_id").combine_chunks(), [v or [] for v in block.column("embedding").to_pylist()]
        asked = [(mine, _unit([own[k] for k in mine], wide), wide) for wide in sorted({len(v) for v in own}) for mine in [[k for k, v in enumerate(own) if len(v) == wide]]]

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                group, item = (pc.rank(whole.column(n), tiebreaker="dense").to_numpy() for n in ("group", "item_id"))
                parts, start = [], 0
                for batch in _slices(whole, len(ids)):
                    vectors = batch.column("embedding").to_pylist()
                    for mine, unit, wide in asked:
                        scores = unit @ _unit(vectors, wide).T
                        query, at = np.nonzero(scores >= least)
                        parts.append(first(np.array(mine, np.int64)[query], at + start, scores[query, at], group, item))
                    start += len(batch)
                if not parts:
                    continue
                # each slice's first ones, and of these the batch's
                query, at, value = first(*(np.concatenate(x) for x in zip(*parts, strict=True)), group, item)
                which = pa.array(at)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), whole.column("group").take(which), whole.column("item_id").take(which), pa.array(value)], names=["query_id", "group", "item_id", "score"])

        def first(query: np.ndarray, at: np.ndarray, value: np.ndarray, group: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The best vector of each item, then the first `top` items of each query and group."""
            order = np.lexsort((item[at], -value, group[at], query))
            query, at, value = query[order], at[order], value[order]
            _, best = np.unique(np.stack([query, group[at], item[at]]), axis=1, return_index=True)
            best.sort()
            query, at, value = query[best], at[best], value[best]
            heads = np.flatnonzero(np.r_[True, (np.diff(query) != 0) | (np.diff(group[at]) != 0)]) if len(at) else np.zeros(0, int)
            kept = np.arange(len(at)) - np.repeat(heads, np.diff(np.r_[heads, len(at)])) < top
            return query[kept], at[kept], value[kept]

        return items.select("group", "item_id", "embedding").mapInArrow(score, schema)

    return reduce(DataFrame.union, [scored(mine.toArrow()) for mine in _blocks(queries.select("query_id", "embedding"), "query_id", QUERIES_PER_BLOCK)])


def top_or_head(query_vector: list[float] | None, items: DataFrame, top: int, order: str, vector: str = "embedding") -> DataFrame:
    """The `top` items by cosine with the query, in order of (-score, order); without a vector the first `top` by order."""
    if query_vector is None:
        return items.orderBy(order).limit(top).withColumn("score", F.lit(None).cast("double"))
    scored = items.withColumn("score", cosine(vector, F.array(*map(F.lit, query_vector))))
    return scored.orderBy(F.desc("score"), order).limit(top)


def column_hints(questions: DataFrame, values: DataFrame, top: int = HINT_TOP, vectors: bool = False) -> DataFrame:
    """Per question and column the `top` stored values that the question names or resembles.

    questions: question_id, q_key (and q_vec); values: source (type.column), value, v_key
    (and v_vec).  Score is the greatest of containment (1.0), trigram Jaccard and cosine;
    a value is kept if contained or if a measure reaches its threshold.
    """
    named, asked = values.filter("v_key <> ''").withColumnRenamed("v_key", "r"), questions.withColumnRenamed("q_key", "l")
    scored = similarity_join(asked.select("l"), named.select("r"), HINT_TRIGRAM).union(containment_join(asked.select("l"), named.select("r")).select("l", "r", F.lit(1.0)))
    met = asked.join(scored, "l").join(named, "r")
    kept = met.select("question_id", "source", "value", F.greatest("score", cosine("q_vec", "v_vec")).alias("score") if vectors else F.col("score"))
    if vectors:
        near = cosine_groups(questions.select(F.col("question_id").alias("query_id"), F.col("q_vec").alias("embedding")), named.select(F.col("source").alias("group"), F.col("value").alias("item_id"), F.col("v_vec").alias("embedding")), top, HINT_COSINE)
        kept = kept.union(near.select(F.col("query_id").alias("question_id"), F.col("group").alias("source"), F.col("item_id").alias("value"), "score"))
    best = kept.groupBy("question_id", "source", "value").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("question_id", "source").orderBy(F.desc("score"), "value"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= top)


def hint_text(hints: DataFrame, chars: int = HINT_CHARS) -> DataFrame:
    """(question_id, hints): a line per column, cut at `chars`."""
    lines = hints.groupBy("question_id", "source").agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("v"))
    line = F.concat(F.col("source"), F.lit(": "), F.array_join(F.transform("v", lambda x: x["value"]), ", "))
    text = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    return lines.groupBy("question_id").agg(F.substring(text, 1, chars).alias("hints"))


def example_text(examples: DataFrame) -> DataFrame:
    """(question_id, examples): a question's worked examples (rank, q, sql, note or null) as prompt text, the nearest first."""
    block = F.concat(F.lit("Q: "), "q", F.lit("\nSQL: "), "sql", F.coalesce(F.concat(F.lit("\nNote: "), "note"), F.lit("")))
    listed = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return examples.groupBy("question_id").agg(F.array_join(F.transform(listed, lambda x: x["block"]), "\n\n").alias("examples"))


def known_text(entities: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, known): the names found so far as prompt text, a line per type, names in order."""
    lines = entities.groupBy(key, "proposed_type").agg(F.array_join(F.array_sort(F.collect_set("canonical_name")), ", ").alias("names"))
    line = F.concat(F.lit("- "), "proposed_type", F.lit(": "), "names")
    return lines.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("known"))


def candidate_strings(rows: DataFrame, most: int | None = PROVENANCE_STRINGS) -> DataFrame:
    """(value): the distinct string cells of a result, trimmed, of two characters or more and not numbers; `most` by name, or all.

    An answer's result is one that the SQL gate has cut to its limit already.
    """
    cells = F.array(*[F.col(n) for n, kind in rows.dtypes if kind == "string"])
    strings = rows.select(F.explode(cells).alias("value")).select(F.trim("value").alias("value"))
    bare = F.regexp_replace("value", r"[.\-]", "")
    usable = strings.filter((F.length("value") >= 2) & ~bare.rlike(r"^\d+$"))
    return usable.distinct() if most is None else usable.distinct().orderBy("value").limit(most)


def provenance(strings: DataFrame, entities: DataFrame, claims: DataFrame, documents: DataFrame, top: int = PROVENANCE_TOP) -> DataFrame:
    """(slug, matched_value, entity_table): documents with an active claim on an entity that a string names.

    strings: value; entities: entity_table, entity_id, canonical_name; claims:
    entity_table, entity_id, document_id, status; documents: id, slug.
    """
    named = entities.join(strings.withColumnRenamed("value", "canonical_name"), "canonical_name", "left_semi")
    backed = claims.filter("status = 'active'").join(named, ["entity_table", "entity_id"]).join(documents.select(F.col("id").alias("document_id"), "slug"), "document_id")
    return backed.select("slug", F.col("canonical_name").alias("matched_value"), "entity_table").distinct().orderBy("slug", "matched_value", "entity_table").limit(top)


def slugs_of(found: DataFrame, sources: DataFrame) -> DataFrame:
    """(slug): the documents that full text or provenance gave, each once."""
    return found.select("slug").union(sources.select("slug")).distinct()


def contains_any(column: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(column, F.lit(word))
    return found
