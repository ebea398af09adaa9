"""Table functions for SQL: a value goes in and rows come out, by LATERAL beside the row that has it, or a whole table does.

Spark takes no Arrow table function beside a row, so those of LATERAL yield plain rows;
`chunk_table` is the Arrow form over a TABLE argument, batch by batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from claimwright.functions.text import chunks, loads_loose


@F.udtf(returnType="chunk_no int, chunk string")
class ChunkText:
    """Pieces of at most `size` characters of a text; a null text is one empty piece."""

    def eval(self, text: str | None, size: int) -> Iterator[tuple]:
        yield from enumerate(chunks(text, size))


@F.arrow_udtf(returnType="id bigint, chunk_no int, chunk string")
class ChunkTable:
    """The pieces of every row of a table (id, text, size); one size for all is a column of it."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        for start in range(0, len(batch), 256):
            ids, texts, sizes = (batch.column(k).slice(start, 256).to_pylist() for k in range(3))
            rows = [(i, k, piece) for i, text, size in zip(ids, texts, sizes, strict=True) for k, piece in enumerate(chunks(text, size))]
            kinds = pa.int64(), pa.int32(), pa.string()
            yield pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["id", "chunk_no", "chunk"])


@F.udtf(returnType="section string, item_no int, item string")
class PayloadItems:
    """The items of a model's loose JSON by section, each as JSON; a bare list is of entities."""

    def eval(self, raw: str | None) -> Iterator[tuple]:
        parsed = loads_loose(raw)
        for name, items in (parsed if isinstance(parsed, dict) else {"entities": parsed}).items():
            for k, item in enumerate(items if isinstance(items, list) else ()):
                yield name, k, json.dumps(item, ensure_ascii=False)


def register(spark: SparkSession) -> None:
    """chunk_text(text, size), chunk_table(TABLE(id, text, size)) and payload_items(raw) as table functions of the session."""
    for name, function in (("chunk_text", ChunkText), ("chunk_table", ChunkTable), ("payload_items", PayloadItems)):
        spark.udtf.register(name, function)
