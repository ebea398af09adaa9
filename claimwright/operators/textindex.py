"""A stored inverted index: postings by term and block of documents, kept in step by segments.

A posting holds the documents of one term in one block of ids: their places in the block,
how often they have the term and how long they are, with the greatest count and the least
length as the block's bounds.  No posting is longer than a block, so a term that a third
of all documents have is many rows.  Folders by hash of the term, and files sorted by
term, are pruned by the terms that are asked for; texts are never read again.

Documents that come later, or again, form a further segment; what they replace is noted
and left out when searching, and `merge` writes one segment of all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimwright.functions.text import terms
from claimwright.plans.registry import FTS_TOP
from claimwright.sources.lineage import cut

#: Ids that a block spans, as a power of two, and folders of terms.
BLOCK_BITS = 12
BUCKETS = 16
#: Blocks of a question that are scored first, to know what its others must exceed.
SEEDS = 4
#: Terms that are counted at once; a longer document is a slice of its own.
TERMS_PER_SLICE = 1 << 21
#: Only so many characters of a question count.
QUESTION_CHARS = 200

_POSTINGS = "term string, block long, n long, most int, least_len int, places array<int>, tfs array<int>, lens array<int>, segment int, bucket int"
_HELD = "term string, block long, places array<int>, tfs array<int>, lens array<int>"
_DOCUMENTS = "doc_id long, len int, segment int"
_REMOVED = "doc_id long, segment int"
_SEGMENTS = "docs long, tokens long, base boolean, segment int"


def _bucket(term: str | Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _parts_of(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches (doc_id, terms) of different ids to parts of postings: the documents of a term and block in order of place; a null term has all documents of the block."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            number = (np.cumsum(sizes) - sizes) // TERMS_PER_SLICE
            edges = np.r_[0, np.flatnonzero(np.diff(number)) + 1, len(batch)] if len(batch) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield batch.column(0).slice(a, b - a).to_numpy(), sizes[a:b], batch.column(1).slice(a, b - a).flatten()

    def parts(term: pa.Array, starts: np.ndarray, ids: np.ndarray, tfs: np.ndarray, lens: np.ndarray) -> pa.RecordBatch:
        at = pa.array(np.r_[starts, len(ids)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(v.astype(np.int32))) for v in (ids & ((1 << bits) - 1), tfs, lens)]
        return pa.RecordBatch.from_arrays([term, pa.array(ids[starts] >> bits), *lists], names=["term", "block", "places", "tfs", "lens"])

    def heads(*values: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.r_[True, np.logical_or.reduce([np.diff(v) != 0 for v in values])])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, words in slices(batches):
            if not len(words):
                continue
            order = np.argsort(ids, kind="stable")
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            ids, lens = ids[order], sizes[order]
            coded = words.dictionary_encode()
            found, tfs = np.unique(coded.indices.to_numpy().astype(np.int64) * len(ids) + np.repeat(rank, sizes), return_counts=True)
            code, row = np.divmod(found, len(ids))
            starts = heads(code, ids[row] >> bits)
            yield parts(coded.dictionary.take(pa.array(code[starts])), starts, ids[row], tfs, lens[row])
            ids, lens = ids[lens > 0], lens[lens > 0]
            starts = heads(ids >> bits)
            yield parts(pa.nulls(len(starts), pa.string()), starts, ids, lens, lens)

    return work


class TextIndex:
    """An index in a folder; one writer at a time, any readers.

    A segment counts once its row of `segments` is written, which is the last thing that
    `add` does, so a writer that dies leaves the index as it was and may simply run again.
    """

    def __init__(self, spark: SparkSession, path: str, bits: int = BLOCK_BITS):
        self.spark, self.path, self.bits = spark, path, bits
        self.refresh()

    def refresh(self) -> TextIndex:
        """Looks for segments again: until then the index answers as it was."""
        self._segments: list | None = None
        return self

    # Writing ------------------------------------------------------------------------

    def _write(self, held: DataFrame, documents: DataFrame, segment: int, arrived: DataFrame | None = None) -> TextIndex:
        """Postings of rows (term, block, places, tfs, lens), which may be parts of postings, their documents (doc_id, len), and of the ids that arrived those that they replace; all is new without any."""
        here = f"{self.path}/{{}}/segment={segment}"
        documents.write.mode("overwrite").parquet(here.format("documents"))
        mine = self.spark.read.schema("doc_id long, len int").parquet(here.format("documents"))
        at = ["bucket", "term", "block"]
        # parts of a posting come from one range, so that they are dealt out once
        parts = held.select(_bucket("term").alias("bucket"), "term", "block", F.struct("places", "tfs", "lens").alias("p")).repartitionByRange(*at)
        # parts of neighbouring documents follow each other; only those that mix are sorted place by place
        follow = F.forall(F.sequence(F.lit(1), F.size("h") - 1), lambda i: F.element_at(F.get("h", i - 1)["places"], -1) < F.get(F.get("h", i)["places"], F.lit(0)))
        mixed = (F.size("h") > 1) & ~F.when(F.size("h") > 1, follow).otherwise(True)
        rows = F.flatten(F.transform("h", lambda x: F.arrays_zip(x["places"].alias("place"), x["tfs"].alias("tf"), x["lens"].alias("len"))))
        met = parts.groupBy(*at).agg(F.sort_array(F.collect_list("p")).alias("h")).withColumn("s", F.when(mixed, F.sort_array(rows)))
        part = lambda name, own: F.when(F.col("s").isNull(), F.flatten(F.transform("h", lambda x: x[own]))).otherwise(F.col("s")[name])
        postings = met.select(*at, part("place", "places").alias("places"), part("tf", "tfs").alias("tfs"), part("len", "lens").alias("lens"))
        postings = postings.select("term", "block", F.size("places").cast("long").alias("n"), F.array_max("tfs").alias("most"), F.array_min("lens").alias("least_len"), "places", "tfs", "lens", "bucket")
        postings.sortWithinPartitions(*at).write.mode("overwrite").partitionBy("bucket").parquet(here.format("postings"))
        size = F.count("*").alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens")
        docs, tokens = mine.agg(*size).first()
        if arrived is not None:
            self.documents().join(arrived, "doc_id", "left_semi").select("doc_id", "len").write.mode("overwrite").parquet(here.format("removed"))
            gone = self.spark.read.schema("doc_id long, len int").parquet(here.format("removed")).agg(*size).first()
            docs, tokens = docs - gone.docs, tokens - gone.tokens
        self.spark.createDataFrame([(docs, tokens, arrived is None)], "docs long, tokens long, base boolean").coalesce(1).write.mode("overwrite").parquet(here.format("segments"))
        return self.refresh()

    def _counted(self, documents: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
        """(parts of postings, documents): terms are counted where the texts are, and a batch's documents of one term and block are one row.

        Rows that share an id, which may be any number, are counted one by one over all
        batches instead.
        """
        rows = documents.filter(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
        again = cut(rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
        some = not again.isEmpty()
        single = rows.join(again, "doc_id", "left_anti") if some else rows
        held = cut(single.select("doc_id", terms("text").alias("terms")).mapInArrow(_parts_of(self.bits), _HELD))
        place = F.explode(F.arrays_zip("places", "lens")).alias("h")
        listed = held.filter("term IS NULL").select("block", place).select((F.shiftleft("block", self.bits) + F.col("h.places")).alias("doc_id"), F.col("h.lens").alias("len"))
        held = held.filter("term IS NOT NULL")
        if some:
            counted = rows.join(again, "doc_id", "left_semi").select("doc_id", F.explode(terms("text")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").cast("int").alias("tf"))
            counted = cut(counted)
            sizes = counted.groupBy("doc_id").agg(F.sum("tf").cast("int").alias("len"))
            held, listed = held.unionByName(self._single(counted.join(sizes, "doc_id"))), listed.union(sizes)
        return held, listed

    def _single(self, rows: DataFrame) -> DataFrame:
        """Rows (doc_id, term, tf, len) as postings of one document each."""
        place = F.col("doc_id").bitwiseAND((1 << self.bits) - 1).cast("int")
        return rows.select("term", F.shiftright("doc_id", self.bits).alias("block"), F.array(place).alias("places"), F.array("tf").alias("tfs"), F.array("len").alias("lens"))

    def build(self, documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> TextIndex:
        """Indexes `documents` anew.  Rows that share an id are one document; rows without an id, and texts without a term, aren't found by any term."""
        return self._write(*self._counted(documents, id_column, text_column), self._next())

    def add(self, documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> TextIndex:
        """Takes documents in; one whose id is known replaces what was there, by nothing that can be found if its text has no term."""
        arrived = documents.select(F.col(id_column).cast("long").alias("doc_id")).distinct()
        return self._write(*self._counted(documents, id_column, text_column), self._next(), arrived)

    def merge(self) -> TextIndex:
        """Writes one segment of what counts now; the index answers as before.  Only blocks that lost a document are taken apart."""
        postings, gone = self.postings(), self._gone()
        held = postings
        if gone is not None:
            touched = gone.select(F.shiftright("doc_id", self.bits).alias("block")).distinct()
            apart = self._exploded(postings.join(touched, "block", "left_semi"))
            held = postings.join(touched, "block", "left_anti").select("term", "block", "places", "tfs", "lens").unionByName(self._single(apart))
        return self._write(held, self.documents().select("doc_id", "len"), self._next())

    # Reading ------------------------------------------------------------------------

    def _listed(self) -> list:
        """The segments that count, in order: the last one that was built anew, and what came after it."""
        if self._segments is None:
            try:
                rows = sorted(self.spark.read.schema(_SEGMENTS).parquet(f"{self.path}/segments").collect(), key=lambda r: r.segment)
            except Exception as error:
                if "PATH_NOT_FOUND" not in str(error):
                    raise
                rows = []
            self._segments = rows[max((k for k, r in enumerate(rows) if r.base), default=0) :]
        return self._segments

    def _next(self) -> int:
        listed = self._listed()
        return listed[-1].segment + 1 if listed else 0

    def _read(self, name: str, schema: str, segments: list[int]) -> DataFrame:
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}")
        return reader.parquet(*[f"{self.path}/{name}/segment={s}" for s in segments]) if segments else self.spark.createDataFrame([], schema)

    def postings(self) -> DataFrame:
        """Every posting of the segments that count: term, block, n, most, least_len, places, tfs, lens."""
        return self._read("postings", _POSTINGS, [r.segment for r in self._listed()])

    def _gone(self) -> DataFrame | None:
        """(doc_id, gone): the last segment that replaced a document; none where no segment did."""
        later = [r.segment for r in self._listed()[1:]]
        removed = self._read("removed", _REMOVED, later)
        return removed.groupBy("doc_id").agg(F.max("segment").alias("gone")) if later and not removed.isEmpty() else None

    def _living(self, rows: DataFrame) -> DataFrame:
        """Rows (doc_id, segment) that no later segment replaced."""
        gone = self._gone()
        return rows if gone is None else rows.join(gone, "doc_id", "left").filter("gone IS NULL OR gone <= segment").drop("gone")

    def documents(self) -> DataFrame:
        """(doc_id, len, segment) of every document that counts."""
        return self._living(self._read("documents", _DOCUMENTS, [r.segment for r in self._listed()]))

    def _exploded(self, postings: DataFrame) -> DataFrame:
        """A row per living document of each posting: doc_id, tf, len beside the posting's other columns."""
        each = F.explode(F.arrays_zip("places", "tfs", "lens")).alias("h")
        kept = [c for c in postings.columns if c not in ("places", "tfs", "lens")]
        rows = postings.select(*kept, each).select(*kept, (F.shiftleft("block", self.bits) + F.col("h.places")).alias("doc_id"), F.col("h.tfs").alias("tf"), F.col("h.lens").alias("len"))
        return self._living(rows)

    def match(self, question: str, top: int = FTS_TOP) -> DataFrame:
        """(doc_id): the first `top` documents by id that hold any of the question's terms."""
        asked = self.spark.range(1).select(F.explode(F.array_distinct(terms(F.lit(question[:QUESTION_CHARS])))).alias("term")).select("term", _bucket("term").alias("bucket")).collect()
        words, folders = [r.term for r in asked], sorted({r.bucket for r in asked})
        mine = self.postings().filter(F.col("bucket").isin(folders) & F.col("term").isin(words))
        if self._gone() is None:
            # each block has a document at least, so the first `top` blocks have the first `top` documents
            first = mine.select("block").distinct().orderBy("block").limit(top)
            mine = mine.join(F.broadcast(first), "block", "left_semi")
        return self._exploded(mine).select("doc_id").distinct().orderBy("doc_id").limit(top)

    def bm25(self, questions: DataFrame, top: int = FTS_TOP, k1: float = 1.2, b: float = 0.75, seeds: int = SEEDS) -> DataFrame:
        """(question_id, doc_id, score, rank): the `top` documents of each of many questions (question_id, term); exact.

        A question's blocks are ordered by the most that a document of theirs can score;
        the first few are scored, and of the others only those that can reach the score of
        the last document wanted.  Equal documents have equal scores but for the order of
        their sums, so scores count to nine places, and ties go to the smaller id.
        """
        listed = self._listed()
        docs, average = sum(r.docs for r in listed), sum(r.tokens for r in listed) / max(sum(r.docs for r in listed), 1)
        asked = questions.select("question_id", "term").distinct().withColumn("bucket", _bucket("term"))
        wanted = asked.select("bucket", "term").distinct()
        mine = self.postings().join(F.broadcast(wanted) if self._few(wanted) else wanted, ["bucket", "term"], "left_semi")
        found = mine.groupBy("term").agg(F.sum("n").alias("df")) if self._gone() is None else self._exploded(mine).groupBy("term").agg(F.count("*").alias("df"))
        weight = F.log((F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        weighed = asked.join(found, "term").select("question_id", "term", weight.alias("weight"))
        gain = lambda tf, size: F.col("weight") * F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(size) / F.lit(average)))
        bounds = mine.select("term", "block", "most", "least_len").join(weighed, "term").groupBy("question_id", "term", "block").agg(F.max(gain("most", "least_len")).alias("bound"))
        blocks = bounds.groupBy("question_id", "block").agg(F.sum("bound").alias("bound"))

        def scored(chosen: DataFrame) -> DataFrame:
            # a posting meets the questions that chose its block, not all that ask for its term
            rows = mine.join(chosen.select("question_id", "block").join(weighed, "question_id"), ["term", "block"])
            return best(self._exploded(rows).groupBy("question_id", "doc_id").agg(F.sum(gain("tf", "len")).alias("score")))

        def best(sums: DataFrame) -> DataFrame:
            order = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
            return sums.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

        leading = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("bound"), "block"))
        blocks = cut(blocks.withColumn("lead", leading))
        first = cut(scored(blocks.filter(F.col("lead") <= seeds)))
        floor = first.filter(F.col("rank") == top).select("question_id", F.col("score").alias("floor"))
        able = blocks.filter(F.col("lead") > seeds).join(floor, "question_id", "left").filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 1e-6))
        return best(first.drop("rank").unionByName(scored(able).drop("rank")))

    @staticmethod
    def _few(asked: DataFrame, most: int = 1 << 16) -> bool:
        """Whether the questions' terms are few enough to come to the postings."""
        return asked.limit(most + 1).count() <= most
