"""An index of vectors by coarse cells, for joins on nearness that needn't meet all pairs.

Every vector belongs to the cell of its nearest centroid.  A query probes the cells of
its nearest centroids; each probed cell is scored exactly, as a product of two blocks.
The centroids are fitted on a bounded sample, all else covers every row.  How many cells
a query must probe is measured when the index is built, as it depends on how the vectors
lie: a few where they form groups, near half of them where they lie at random.  Probing
all cells is the exact join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimwright.operators.search import _nearest, _unit, cosine_top

#: Rows that centroids are fitted on, and most cells.
SAMPLE = 1 << 14
MOST_CELLS = 1 << 10
#: Rows of the two blocks of one product; a larger cell, or more queries at one, are dealt out.
ITEMS_PER_BLOCK = 1 << 15
QUERIES_PER_BLOCK = 1 << 8
_ROUNDS = 12
#: The share of nearest items that is to be found, and the queries and items of each that it is measured on.
RECALL = 0.95
MEASURED_QUERIES, MEASURED_TOP = 200, 10


def _fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids by spherical k-means from evenly spread rows; a cell that empties keeps its place."""
    centroids = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(_ROUNDS):
        near = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0), centroids)
    return centroids


class VectorIndex:
    """Cells of `items` (item_id, embedding), written under `path`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._centroids: np.ndarray | None = None

    def build(self, items: DataFrame, item_id: str = "item_id", vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE, seed: int = 5) -> VectorIndex:
        """Indexes every row of `items`.

        `sample` rows, drawn by hash of their vectors, fit the centroids; there are about
        as many cells as the square root of the rows, at most MOST_CELLS and an eighth of
        the sample.  A null, zero or odd-length vector, which is near nothing, has the
        cell of a hash.  Null ids and repeated rows are kept.
        """
        rows = items.select(F.col(item_id).alias("item_id"), F.col(vector).cast("array<double>").alias("embedding"))
        drawn = rows.filter(F.size("embedding") > 0).select("embedding", F.xxhash64("embedding", F.lit(seed)).alias("h")).distinct().orderBy("h").limit(sample)
        found = [r.embedding for r in drawn.select("embedding").collect()]
        count = rows.count()
        lengths = [len(v) for v in found]
        wide = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 1
        fitted = _unit([v for v in found if len(v) == wide], wide)
        fitted = fitted[np.linalg.norm(fitted, axis=1) > 0] if len(fitted) else np.zeros((0, wide))
        most = max(1, min(MOST_CELLS, len(fitted) // 8))
        n = max(1, min(cells or round(math.sqrt(count)), most))
        centroids = _fit(fitted, n) if len(fitted) else np.zeros((1, wide))
        self._centroids = centroids
        self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centroids")
        placed = self._probed(rows, 1)
        placed.repartitionByRange("cell", F.xxhash64("item_id")).sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{self.path}/items")
        self._measure(found[:MEASURED_QUERIES])
        return self

    def _measure(self, queries: list) -> None:
        """Writes how many cells must be probed to find RECALL of the nearest items of some drawn vectors."""
        asked = self.spark.createDataFrame(list(enumerate(queries)), "query_id int, embedding array<double>")
        items = self.items()
        near = cosine_top(asked, items.select("item_id", "embedding"), MEASURED_TOP).select("query_id", "item_id")
        cells = near.join(items.select("item_id", "cell").filter("item_id IS NOT NULL"), "item_id").collect()
        order = {k: np.argsort(np.argsort(-(_unit([v], self.centroids.shape[1]) @ self.centroids.T)[0], kind="stable")) for k, v in enumerate(queries)}
        ranks = sorted(int(order[r.query_id][r.cell]) for r in cells)
        probes = 1 + ranks[min(len(ranks) - 1, int(RECALL * len(ranks)))] if ranks else 1
        self.spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/probes")

    def items(self) -> DataFrame:
        """item_id, embedding, cell of every row."""
        return self.spark.read.parquet(f"{self.path}/items")

    @property
    def centroids(self) -> np.ndarray:
        if self._centroids is None:
            rows = self.spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()
            self._centroids = np.array([r.centroid for r in rows])
        return self._centroids

    def _probed(self, rows: DataFrame, probes: int) -> DataFrame:
        """`rows` (an id, embedding) with cell: a row for each of the nearest `probes` centroids."""
        centroids = self.centroids
        cells, wide = centroids.shape
        probes = min(probes, cells)
        schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, len(batch), 4096):
                    part = batch.slice(start, 4096)
                    unit = _unit(part.column(1).to_pylist(), wide)
                    near = np.argsort(-(unit @ centroids.T), axis=1, kind="stable")[:, :probes]
                    lost = np.flatnonzero(~unit.any(axis=1))
                    near[lost] = (lost[:, None] + start + np.arange(probes)) % cells
                    kept = part.take(pa.array(np.repeat(np.arange(len(part)), probes)))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(near.ravel(), pa.int32())], names=[*kept.schema.names, "cell"])

        return rows.mapInArrow(work, schema)

    def join(self, queries: DataFrame, top: int, probes: int | None = None, query_id: str = "query_id", vector: str = "embedding", least: float | None = None) -> DataFrame:
        """(query_id, item_id, score, rank): per query the `top` nearest items of the cells that it probes, equal scores by item id.

        `probes` is the number of cells, the one that was measured if not given, all of
        them for the exact result.  A cell is split by the number of its items and
        of the queries at it, so a cell that holds a third of all rows is many blocks; a
        block sends each query's best ones on.
        """
        probes = self.spark.read.parquet(f"{self.path}/probes").first().probes if probes is None else probes
        asked = self._probed(queries.select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("embedding")), probes)
        items = self.items()
        sizes = items.groupBy("cell").agg(F.count("*").alias("n")).join(asked.groupBy("cell").agg(F.count("*").alias("m")), "cell")
        parts = lambda c, most: F.ceil(F.col(c) / most).cast("int")
        # a row a cell, and there are at most MOST_CELLS
        sizes = F.broadcast(sizes.select("cell", parts("n", ITEMS_PER_BLOCK).alias("of_items"), parts("m", QUERIES_PER_BLOCK).alias("of_queries")))
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = items.join(sizes, "cell").withColumn("i", F.pmod(F.xxhash64("item_id", "embedding"), F.col("of_items")).cast("int")).withColumn("q", every("of_queries"))
        right = asked.join(sizes, "cell").withColumn("q", F.pmod(F.xxhash64("query_id", "embedding"), F.col("of_queries")).cast("int")).withColumn("i", every("of_items"))
        kinds = {"query_id": asked.schema["query_id"].dataType.simpleString(), "item_id": items.schema["item_id"].dataType.simpleString()}

        def product(mine: pa.Table, theirs: pa.Table) -> pa.Table:
            ids, place = mine.column("item_id").combine_chunks(), np.empty(len(mine), np.int64)
            place[pc.sort_indices(ids).to_numpy()] = np.arange(len(mine))
            vectors, own = mine.column("embedding").to_pylist(), theirs.column("embedding").to_pylist()
            at, kept, values = [], [], []
            for wide in sorted({len(v or ()) for v in own}):
                rows = [k for k, v in enumerate(own) if len(v or ()) == wide]
                scores = _unit([own[k] for k in rows], wide) @ _unit(vectors, wide).T
                for k, row in zip(rows, scores, strict=True):
                    best = _nearest(row, place, top)
                    best = best if least is None else best[row[best] >= least]
                    at += [k] * len(best)
                    kept.append(best)
                    values.append(row[best])
            query = theirs.column("query_id").combine_chunks().take(pa.array(at, pa.int64()))
            return pa.table({"query_id": query, "item_id": ids.take(pa.array(np.concatenate(kept).astype(np.int64))), "score": pa.array(np.concatenate(values))})

        blocks = left.select("cell", "i", "q", "item_id", "embedding").groupBy("cell", "i", "q").cogroup(right.select("cell", "i", "q", "query_id", "embedding").groupBy("cell", "i", "q"))
        met = blocks.applyInArrow(lambda a, b: product(a, b) if len(a) and len(b) else _none(a, b), f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
        return met.withColumn("rank", rank).filter(F.col("rank") <= top)


def _none(mine: pa.Table, theirs: pa.Table) -> pa.Table:
    return pa.table({"query_id": theirs.column("query_id").slice(0, 0), "item_id": mine.column("item_id").slice(0, 0), "score": pa.array([], pa.float64())})


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(wanted, recall): the share of the exact (query_id, item_id) rows that were found."""
    both = exact.select("query_id", "item_id").join(found.select("query_id", "item_id").withColumn("_hit", F.lit(1)), ["query_id", "item_id"], "left")
    return both.agg(F.count("*").alias("wanted"), (F.count("_hit") / F.count("*")).alias("recall"))
