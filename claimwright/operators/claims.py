"""The claims log and its two resolutions.

A claim is one (entity, column, document, value, confidence) row.  Of claims that repeat
a key (entity, column, document) the latest counts, with the first one's arrival as its
age.  `resolve` judges all claims of an (entity, column) at once and is free of arrival
order; `fold` replays them one by one, as an incremental store would.
"""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimwright.operators.ordered import with_previous
from claimwright.plans.registry import CLAIM_CONFIDENCE_DELTA, ENTITY_COLUMNS, ENUMS, LOW_CONFIDENCE, RANGES, Registry

KEY = ("entity_table", "entity_id", "column_name")


def split_low_confidence(claims: DataFrame, least: float = LOW_CONFIDENCE) -> DataFrame:
    """`claims` with route: accepted, or rejected below `least` (a null confidence is rejected)."""
    return claims.withColumn("route", F.when(F.col("confidence") >= least, "accepted").otherwise("rejected"))


def violations(claims: DataFrame, registry: Registry | None = None) -> DataFrame:
    """`claims` with violation: null, or the first rule that a claim breaks; broken ones go to quarantine, the rest of their document stays."""
    columns = (registry or Registry()).entities
    known = F.lit(False)
    for table, names in columns.items():
        known = known | ((F.col("entity_table") == table) & F.col("column_name").isin(*names))
    problem = F.when(~F.col("entity_table").isin(*columns), "unknown_type").when(~known, "unknown_column")
    problem = problem.when(~F.col("confidence").between(0, 1) | F.col("confidence").isNull(), "confidence_range")
    at = lambda key: (F.col("entity_table") == key[0]) & (F.col("column_name") == key[1]) & F.col("value").isNotNull()
    for key, words in ENUMS.items():
        problem = problem.when(at(key) & ~F.col("value").isin(*words), "enum")
    for key, (low, high) in RANGES.items():
        number = F.col("value").try_cast("double")
        bad = number.isNull()
        bad = bad | (number < low) if low is not None else bad
        bad = bad | (number > high) if high is not None else bad
        problem = problem.when(at(key) & bad, "range")
    return claims.withColumn("violation", problem)


def latest(claims: DataFrame, key: tuple[str, ...] = (*KEY, "document_id")) -> DataFrame:
    """One row per key: the latest claim's fields with created_seq, the arrival of the first.  Aggregates map-side, so a hot key is no matter."""
    rest = [c for c in claims.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.col("seq")).alias("_newest")
    merged = claims.groupBy(*key).agg(newest, F.min("seq").alias("created_seq"))
    return merged.select(*key, *[F.col(f"_newest.{c}").alias(c) for c in rest], "created_seq")


def resolve(claims: DataFrame, delta: float = CLAIM_CONFIDENCE_DELTA, key: tuple[str, ...] = KEY, strict: bool = False) -> DataFrame:
    """Latest claims with status, pivot value and gap, by the recompute rule.

    The pivot is the most confident claim of its key, the oldest among equals.  A claim
    with its value is active; another is superseded if the pivot exceeds it by more than
    `delta`, else conflicted, and then the pivot is conflicted too.  With `strict`, claims
    beyond delta stay active while the key has a conflict.  Pivots are a map-side maximum
    joined back, so a key that holds a large part of the log is split as a skewed join.
    """
    rows = latest(claims, (*key, "document_id"))
    best = F.max(F.struct(F.col("confidence"), -F.col("created_seq"), F.col("value").alias("value"), F.col("document_id").alias("document_id"))).alias("_p")
    pivots = rows.groupBy(*key).agg(best)
    pivots = pivots.select(*key, F.col("_p.confidence").alias("pivot_confidence"), F.col("_p.value").alias("pivot_value"), F.col("_p.document_id").alias("pivot_document"))
    met = rows.join(pivots, list(key))
    gap = F.col("pivot_confidence") - F.col("confidence")
    same = F.col("value").eqNullSafe(F.col("pivot_value"))
    met = met.withColumn("gap", gap).withColumn("_rival", ~same & (gap <= delta))
    fought = met.filter("_rival").select(*key).distinct().withColumn("_fought", F.lit(True))
    met = met.join(fought, list(key), "left")
    pivot = F.col("document_id") == F.col("pivot_document")
    beyond = F.when(F.col("_fought"), "active").otherwise("superseded") if strict else F.lit("superseded")
    status = F.when(F.col("_rival") | pivot & F.coalesce("_fought", F.lit(False)), "conflicted").when(same, "active").otherwise(beyond)
    return met.withColumn("status", status).drop("_rival", "_fought", "pivot_document")


def conflict_groups(resolved: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Conflicted claims with kind (table_column) and a group id that depends on the key alone."""
    kind = F.concat_ws("_", F.col(key[0]), F.col(key[-1]))
    return resolved.filter("status = 'conflicted'").withColumn("kind", kind).withColumn("conflict_group", F.xxhash64(*key))


def canonical(resolved: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """One row per key: the pivot's value and confidence, whatever its status."""
    return resolved.groupBy(*key).agg(F.first("pivot_value").alias("value"), F.first("pivot_confidence").alias("confidence"))


def canonical_table(resolved: DataFrame, table: str, columns: dict[str, str] | None = None) -> DataFrame:
    """The typed rows of one entity type: canonical values pivoted to columns and cast where they can be."""
    columns = columns or ENTITY_COLUMNS[table]
    mine = canonical(resolved.filter(F.col("entity_table") == table))
    picked = [F.max(F.when(F.col("column_name") == name, F.col("value"))).try_cast(kind).alias(name) for name, kind in columns.items()]
    return mine.groupBy("entity_id").agg(*picked)


def history(claims: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Claims with the value before them in their key's order of arrival and whether it changed.

    Sorted in ranges of (key, arrival), so a cell that a large part of the log is about is
    several tasks.
    """
    before = with_previous(claims, key, "seq", "value", "previous_value")
    return before.withColumn("changed", ~F.col("value").eqNullSafe(F.col("previous_value")))


def existence_resolve(claims: DataFrame, delta: float = CLAIM_CONFIDENCE_DELTA, key: tuple[str, ...] = ("edge_id",)) -> DataFrame:
    """Existence claims have no value: superseded where more than delta below the best, else active; the best is the cache."""
    rows = latest(claims, (*key, "document_id"))
    best = F.max(F.struct(F.col("confidence"), -F.col("created_seq"), F.col("document_id").alias("document_id"))).alias("_p")
    pivots = rows.groupBy(*key).agg(best).select(*key, F.col("_p.confidence").alias("best_confidence"), F.col("_p.document_id").alias("best_document"))
    met = rows.join(pivots, list(key))
    return met.withColumn("status", F.when(F.col("best_confidence") - F.col("confidence") > delta, "superseded").otherwise("active"))


# The incremental machine ------------------------------------------------------------


class Machine:
    """The claims of one (entity, column) as they arrive: document -> [value, confidence, status, group, arrival].

    The active claims and how many have each value are kept beside, in mappings like
    `rows` is one, so that a new document's claim is judged without walking the others;
    only a document that speaks again has all of them judged anew.
    """

    def __init__(self, delta: float = CLAIM_CONFIDENCE_DELTA, least: float = LOW_CONFIDENCE, rows: MutableMapping | None = None, active: MutableMapping | None = None, values: MutableMapping | None = None):
        self.delta, self.least = delta, least
        self.rows: MutableMapping[int, list] = {} if rows is None else rows
        self.active: MutableMapping[int, int] = {} if active is None else active
        self.values: MutableMapping[str, int] = {} if values is None else values
        self.value: str | None = None
        self.groups = self.arrivals = 0
        self.best = 0.0

    def add(self, document: int, value: str | None, confidence: float) -> str:
        """Takes a claim in and says what became of it.

        A claim is held against the active claims of other documents: none, or one of
        equal value, leaves it active; one clearly better supersedes it, one clearly
        worse is superseded; else all of them conflict.  A document that repeats its own
        claim, or changes it, sets off a recomputation.
        """
        if confidence is None or confidence != confidence or confidence < self.least:
            return "rejected"
        known = self.rows.get(document)
        if known is not None:
            self.rows[document] = [value, confidence, *known[2:]]
            self.recompute()
            return "refreshed" if known[0] == value else "revalued"
        self.arrivals += 1
        alone = len(self.active) == 0
        if alone or _slot(value) in self.values:
            self.value = value if alone else self.value
            self._put(document, value, confidence)
            return "inserted_active"
        gap = confidence - self.best
        if gap > self.delta:
            self._retire("superseded", None)
            self.value = value
            self._put(document, value, confidence)
            return "inserted_active"
        if gap < -self.delta:
            self.rows[document] = [value, confidence, "superseded", None, self.arrivals]
            return "inserted_superseded"
        self.groups += 1
        self._retire("conflicted", self.groups)
        self.rows[document] = [value, confidence, "conflicted", self.groups, self.arrivals]
        return "inserted_conflicted"

    def _put(self, document: int, value: str | None, confidence: float) -> None:
        """A new document's claim becomes active."""
        self.rows[document] = [value, confidence, "active", None, self.arrivals]
        self._activate(document, value, confidence)

    def _activate(self, document: int, value: str | None, confidence: float) -> None:
        self.best = max(self.best, confidence) if len(self.active) else confidence
        self.active[document] = 1
        self.values[_slot(value)] = self.values.get(_slot(value), 0) + 1

    def reactivate(self) -> None:
        """What is kept beside the rows, from the rows."""
        for document, (value, confidence, status, _, _) in self.rows.items():
            if status == "active":
                self._activate(document, value, confidence)

    def _retire(self, status: str, group: int | None) -> None:
        """No claim is active any more."""
        for document in list(self.active):
            value, confidence, _, _, arrival = self.rows[document]
            self.rows[document] = [value, confidence, status, group, arrival]
        self.active.clear()
        self.values.clear()

    def recompute(self) -> None:
        """All claims judged anew around the most confident, the oldest among equals; in a conflict those beyond delta stay active."""
        every = dict(self.rows.items())
        pivot = min(every, key=lambda d: (-every[d][1], every[d][4]))
        value, top = every[pivot][:2]
        rivals = {d for d, r in every.items() if r[0] != value and top - r[1] <= self.delta}
        self.groups += bool(rivals)
        self.active.clear()
        self.values.clear()
        for document, row in every.items():
            fought = bool(rivals) and (document == pivot or document in rivals)
            status = "conflicted" if fought else "active" if row[0] == value or rivals else "superseded"
            judged = [row[0], row[1], status, self.groups if fought else None, row[4]]
            if judged != row:
                self.rows[document] = judged
            if status == "active":
                self._activate(document, row[0], row[1])
        self.value = value


def _slot(value: str | None) -> str:
    """A value as the name of a slot; null has one of its own."""
    return "" if value is None else f"={value}"


FOLDED = "entity_table string, entity_id bigint, column_name string, document_id bigint, value string, confidence double, status string, conflict_no int, canonical_value string"


def fold(claims: DataFrame, delta: float = CLAIM_CONFIDENCE_DELTA) -> DataFrame:
    """Claims as an incremental store leaves them, one key at a time in order of seq.

    The outcome depends on the order of arrival within a key, so a key is folded in one
    task, but its rows stream through: the state is one entry per document of the key.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, machine = None, Machine(delta)
        for batch in batches:
            out: list[tuple] = []
            for *key, document, value, confidence in batch.itertuples(index=False, name=None):
                if tuple(key) != held:
                    out += rows_of(held, machine)
                    held, machine = tuple(key), Machine(delta)
                machine.add(document, value, confidence)
            yield frame(out)
        yield frame(rows_of(held, machine))

    def rows_of(key: tuple | None, machine: Machine) -> list[tuple]:
        return [(*key, document, *row[:4], machine.value) for document, row in machine.rows.items()] if key else []

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[*KEY, "document_id", "value", "confidence", "status", "conflict_no", "canonical_value"])
        return out.astype({"conflict_no": "Int32"})

    ordered = claims.select(*KEY, "document_id", "value", "confidence", "seq").repartition(*KEY).sortWithinPartitions(*KEY, "seq").drop("seq")
    return ordered.mapInPandas(work, FOLDED)


# Measures over the log --------------------------------------------------------------


def status_histogram(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("status").agg(F.count("*").alias("n"))


def support(resolved: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """How many documents back each active value."""
    return resolved.filter("status = 'active'").groupBy(*key, "value").agg(F.count_distinct("document_id").alias("support"))


def flips(claims: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """How often a key's value was another one: distinct values less one, at least 0."""
    return claims.groupBy(*key).agg(F.greatest(F.count_distinct("value") - 1, F.lit(0)).cast("bigint").alias("flips"))


def human_verdict(entity_table: str | Column, entity_id: Column, column_name: str | Column, value: Column, seq: Column) -> list[Column]:
    """The columns of a verdict: a claim of the human document with full confidence."""
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return [
        as_col(entity_table).alias("entity_table"), entity_id.alias("entity_id"), as_col(column_name).alias("column_name"), value.alias("value"),
        F.lit(1).cast("bigint").alias("document_id"), F.lit("human verdict").alias("evidence"), F.lit(1.0).alias("confidence"), seq.alias("seq"),
    ]
