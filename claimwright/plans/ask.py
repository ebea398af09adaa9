"""Question to guarded SQL to rows to answer, with the model behind an interface."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from claimwright.operators.search import candidate_strings, fts, provenance
from claimwright.plans.gate import run

ROWS_CHARS = 4000


class Provider(Protocol):
    """What the engine asks of a model; tests and offline runs give stubs."""

    def sql(self, question: str, schema: str, hints: str, examples: list[dict], error: str | None) -> str: ...

    def prose(self, question: str, rows: str, documents: list[dict]) -> str: ...

    def embed(self, text: str) -> list[float] | None: ...


@dataclass
class Trace:
    """The steps of a question in order; observers see each as it happens."""

    steps: list[tuple[str, dict]] = field(default_factory=list)
    observers: list[Callable[[str, dict], None]] = field(default_factory=list)

    def note(self, step: str, **facts: object) -> None:
        self.steps.append((step, facts))
        for see in self.observers:
            see(step, facts)


@dataclass
class Answer:
    sql: str | None
    rows: list[dict]
    documents: list[dict]
    sources: list[dict]
    text: str
    error: str | None = None


def text_to_sql(spark: SparkSession, provider: Provider, question: str, schema: str = "", hints: str = "", examples: list[dict] | None = None, trace: Trace | None = None) -> tuple[str | None, DataFrame | None, list[dict], str | None]:
    """(sql, result, rows, error): one repair on an error or an empty result; a first empty result stands if the repair fails."""
    trace = trace or Trace()
    best, error = (None, None, []), None
    for attempt in (1, 2):
        sql = provider.sql(question, schema, hints, examples or [], error)
        try:
            result = run(spark, sql)
            rows = [r.asDict() for r in result.collect()]
        except Exception as problem:
            error = str(problem).splitlines()[0]
            trace.note("sql_failed", attempt=attempt, sql=sql, error=error)
            continue
        trace.note("sql_ran", attempt=attempt, sql=sql, rows=len(rows))
        best = (sql, result, rows)
        if rows:
            return *best, None
        error = "no rows"
    return *best, None if best[0] else error


def answer(spark: SparkSession, provider: Provider, question: str, documents: DataFrame, entities: DataFrame, claims: DataFrame, slugs: DataFrame, trace: Trace | None = None, **prompt: object) -> Answer:
    """Rows by SQL, documents by full text, sources by provenance, and prose about them."""
    trace = trace or Trace()
    sql, result, rows, error = text_to_sql(spark, provider, question, trace=trace, **prompt)
    found = [r.asDict() for r in fts(documents, question).collect()]
    sources: list[dict] = []
    if result is not None and rows:
        sources = [r.asDict() for r in provenance(candidate_strings(result), entities, claims, slugs).collect()]
    trace.note("documents", n=len(found), sources=len(sources))
    shown = "\n".join(str(r) for r in rows)[:ROWS_CHARS]
    return Answer(sql, rows, found, sources, provider.prose(question, shown, found), error)
