"""Structured Streaming twins: incremental claims, deduplicated arrivals and event windows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from claimwright.operators.claims import KEY, Machine

UPDATES = "entity_table string, entity_id long, column_name string, document_id long, seq long, outcome string, canonical_value string, canonical_changed boolean"
#: The store that keeps a map entry by entry.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups of the fold, and entries of state in each.  A call and its Arrow batches serve a group's keys, a read and a write of state an entry's; both are fixed for a checkpoint.
GROUPS, ENTRIES = 1024, 64
#: Documents of a key that lie in its entry; later ones lie in pages of as many.
PAGE = 64
#: Rows of a frame that is handed back.
MOST_ROWS = 10_000


class _Noted(dict):
    """A key's claims by document, with the documents whose claims were set."""

    def __init__(self, rows: dict[int, list]):
        super().__init__(rows)
        self.changed: set[int] = set()

    def __setitem__(self, document: int, row: list) -> None:
        super().__setitem__(document, row)
        self.changed.add(document)


class ClaimFold(StatefulProcessor):
    """The machines of a group's (entity, column) keys over a map state.

    A call to the state costs far more than a claim, so an entry holds the keys of one
    hash, some tens where there are millions of keys, and is read and written once a
    micro-batch that speaks of any of them.  A key's documents beyond the first page lie
    in pages of their own, in order of arrival, and only changed ones are written.
    """

    def __init__(self, delta: float, page: int = PAGE):
        self.delta, self.page = delta, page

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("entries", "name string", "content string")

    def read(self, name: str) -> list:
        found = self.state.getValue((name,))
        return [] if found is None else json.loads(found[0])

    def write(self, name: str, content: list) -> None:
        self.state.updateValue((name,), (json.dumps(content),))

    def machine(self, key: tuple, value: str | None, groups: int, arrivals: int, rows: list[list]) -> Machine:
        """The machine of a key as the last micro-batch left it, with its first page of claims."""
        rows = rows + [r for n in range(1, -(-arrivals // self.page)) for r in self.read(_page(key, n))]
        machine = Machine(self.delta, rows=_Noted({document: row for document, *row in rows}))
        machine.value, machine.groups, machine.arrivals = value, groups, arrivals
        machine.reactivate()
        return machine

    def kept(self, key: tuple, machine: Machine) -> tuple:
        """What the key's entry is to hold; its later pages are written where a claim has changed."""
        pages: dict[int, list] = {n: [] for n in {0} | {self.page_of(machine.rows[d]) for d in machine.rows.changed}}
        for document, row in machine.rows.items():
            if (n := self.page_of(row)) in pages:
                pages[n].append([document, *row])
        for n in pages.keys() - {0}:
            self.write(_page(key, n), pages[n])
        return machine.value, machine.groups, machine.arrivals, pages[0]

    def page_of(self, row: list) -> int:
        return (row[4] - 1) // self.page

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        entries: dict[int, dict[tuple, list]] = {}
        for frame in rows:
            for entry, table, entity, column, *claim in frame[["entry", *KEY, "seq", "document_id", "value", "confidence"]].itertuples(index=False, name=None):
                mine = (table, None if entity is None or entity != entity else int(entity), column)  # a frame with nulls has floats
                entries.setdefault(entry, {}).setdefault(mine, []).append(claim)
        out: list[tuple] = []
        for entry, spoken in entries.items():
            held = {(table, entity, column): rest for table, entity, column, *rest in self.read(str(entry))}
            changed = False
            for mine, said in spoken.items():
                machine = self.machine(mine, *held.get(mine, (None, 0, 0, [])))
                said.sort(key=itemgetter(0))
                for seq, document, value, confidence in said:
                    before = machine.value
                    outcome = machine.add(int(document), value, confidence)
                    out.append((*mine, int(document), int(seq), outcome, machine.value, machine.value != before))
                    if len(out) == MOST_ROWS:
                        yield _updates(out)
                        out = []
                if machine.rows.changed:
                    held[mine] = self.kept(mine, machine)
                    changed = True
            if changed:
                self.write(str(entry), [(*mine, *rest) for mine, rest in held.items()])
        yield _updates(out)

    def close(self) -> None:
        pass


def _page(key: tuple, n: int) -> str:
    return json.dumps([*key, n])


def _updates(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[*KEY, "document_id", "seq", "outcome", "canonical_value", "canonical_changed"])


def fold_stream(claims: DataFrame, delta: float = 0.1, groups: int = GROUPS, entries: int = ENTRIES, page: int = PAGE) -> DataFrame:
    """What becomes of each arriving claim, with the machine of each (entity, column) as keyed state.

    The same machine as the batch fold; within a micro-batch a key's claims go in order
    of seq, over micro-batches in order of arrival, which is the semantic order.  Keys
    are dealt by hash over `groups` with `entries` of state each, in the RocksDB store,
    which `into_table` turns on.  A claim rewrites its entry, so a store of far more keys
    than these defaults' few millions wants more entries.
    """
    dealt = F.pmod(F.xxhash64(*KEY), F.lit(groups * entries))
    rows = claims.select((dealt % groups).alias("group"), dealt.alias("entry"), *KEY, "document_id", "seq", "value", "confidence")
    return rows.groupBy("group").transformWithStateInPandas(ClaimFold(delta, page), UPDATES, "Append", "None")


def once_per_document(claims: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Arrivals without repeats of (entity, column, document) within the watermark."""
    return claims.withWatermark(time, delay).dropDuplicatesWithinWatermark([*KEY, "document_id"])


def landing(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they land in a folder, the oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def window_counts(events: DataFrame, width: str = "1 day", slide: str | None = None, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Counts and sums per event type in tumbling or sliding windows, for streams and tables alike."""
    rows = events.withWatermark(time, delay) if events.isStreaming else events
    found = rows.groupBy(F.window(time, width, slide) if slide else F.window(time, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Sessions of each key: events less than a gap apart."""
    rows = events.withWatermark(time, delay) if events.isStreaming else events
    found = rows.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def into_table(updates: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """One writer per table: each micro-batch is handed over in order, with its number for idempotent writes.

    Keyed maps go to the RocksDB store.  A new stream has a partition of state a core, or
    the session's shuffle partitions where these are fewer.
    """
    session = updates.sparkSession
    partitions = min(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    own = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.shuffle.partitions": str(partitions)}
    before = {k: session.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            session.conf.set(k, v)
        # a stream takes the session's settings as they are when it starts
        return updates.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            session.conf.set(k, v) if v is not None else session.conf.unset(k)


# A stream from folder to folder -----------------------------------------------------------


def batch_folders(sink: str) -> Callable[[DataFrame, int], None]:
    """A write that gives each micro-batch a folder of its number: one that is handed over again after a failure replaces itself."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")


def run(updates: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what has landed by now, and gives all rows of its sink, with batch, the number of the micro-batch.

    `folder` holds the stream's checkpoint and its sink; running again takes only what has
    landed since, also where the last run died between writing a batch and committing it.
    """
    spark, sink = updates.sparkSession, f"{folder}/sink"
    into_table(updates, f"{folder}/checkpoint", batch_folders(sink), mode).awaitTermination()
    return spark.read.schema(", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in updates.schema), "batch int"])).parquet(sink)


def in_arrivals(rows: DataFrame, order: str, parts: int = 3) -> list[DataFrame]:
    """`rows` in `parts` pieces by ranges of `order`, as they would arrive one after the other."""
    place = F.col(order).cast("double")
    cuts = sorted(set(rows.select(place.alias("o")).approxQuantile("o", [k / parts for k in range(1, parts)], 0.01))) if parts > 1 else []
    number = F.coalesce(sum((F.when(place > c, 1).otherwise(0) for c in cuts), F.lit(0)), F.lit(0))
    return [rows.filter(number == k) for k in range(len(cuts) + 1)]
