"""Confidence from token log-probabilities."""

from __future__ import annotations

import json
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimwright.plans.registry import FALLBACK_CONFIDENCE, HUMAN_DOCUMENT_ID, MACHINE_CONFIDENCE_CAP


def mean_confidence(logprobs: Column) -> Column:
    """exp of the mean of an array of log-probabilities; the fallback for an empty or null one."""
    total = F.aggregate(logprobs, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(logprobs) > 0, F.exp(total / F.size(logprobs))).otherwise(FALLBACK_CONFIDENCE)


def capped(confidence: Column | str, document_id: Column | str = "document_id", cap: float = MACHINE_CONFIDENCE_CAP) -> Column:
    """Only a human verdict may be more certain than the cap."""
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    d = F.col(document_id) if isinstance(document_id, str) else document_id
    return F.when(d == HUMAN_DOCUMENT_ID, c).otherwise(F.least(c, F.lit(cap)))


def token_bytes(token: dict) -> bytes:
    """A token's own bytes where the model gave them, else those of its text."""
    return bytes(token["bytes"]) if token.get("bytes") is not None else token["token"].encode()


def byte_spans(tokens: list[dict]) -> list[tuple[int, int]]:
    spans, at = [], 0
    for token in tokens:
        size = len(token_bytes(token))
        spans.append((at, at + size))
        at += size
    return spans


def byte_offsets(tokens: DataFrame, key: str, place: str = "pos", token: str = "token") -> DataFrame:
    """`tokens` with start and end: the bytes of a key's tokens laid end to end in order of place.  A key's tokens are one answer's, so few."""
    size = F.octet_length(token).cast("long")
    before = Window.partitionBy(key).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    placed = tokens.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)))
    return placed.withColumn("end", F.col("start") + size)


def content_tokens(content: str, tokens: list[dict]) -> list[dict]:
    """The tokens that overlap the last occurrence of `content` in all tokens' bytes."""
    if not tokens or not content:
        return []
    target = content.encode()
    at = b"".join(map(token_bytes, tokens)).rfind(target)
    if at < 0:
        return []
    return [t for t, (a, b) in zip(tokens, byte_spans(tokens), strict=True) if b > at and a < at + len(target)]


def value_span(content: bytes, value: str | None, cursor: int) -> tuple[tuple[int, int] | None, int]:
    """(bytes of the quoted value from `cursor` on, the cursor behind it): as it stands, else with escapes."""
    for ascii_only in (False, True) if value else ():
        quoted = json.dumps(value, ensure_ascii=ascii_only).encode()
        at = content.find(quoted, cursor)
        if at >= 0:
            return (at + 1, at + len(quoted) - 1), at + len(quoted)
    return None, cursor


#: What is looked for in each item of a section.
_VALUES = {"entities": ("canonical_name",), "relations": ("from", "to"), "weak_relations": ("subject", "predicate", "object")}


def graph_confidences(content: str, tokens: list[dict], raw: dict | list, graph: dict) -> dict[str, list[float]]:
    """Confidences of each section's items, sections in the order in which the raw JSON has them."""
    data = content.encode()
    # tokens lie end to end, so those over a value are neighbours
    starts, ends = (list(x) for x in zip(*byte_spans(tokens), strict=True)) if tokens else ([], [])
    order = [k for k in raw if k in _VALUES] if isinstance(raw, dict) else ["entities"]
    cursor, out = 0, {}
    for section in [*order, *(k for k in _VALUES if k not in order)]:
        out[section] = []
        for item in graph.get(section) or ():
            found: list[float] = []
            for key in _VALUES[section]:
                span, cursor = value_span(data, item.get(key), cursor)
                if span:
                    found += [t["logprob"] for t in tokens[bisect_right(ends, span[0]) : bisect_left(starts, span[1])]]
            out[section].append(math.exp(sum(found) / len(found)) if found else FALLBACK_CONFIDENCE)
    return out


def apply_confidences(extractions: DataFrame) -> DataFrame:
    """(document_id, section, item_no, confidence) of rows (document_id, content, tokens).

    tokens: array<struct<token, logprob, bytes>>.  The search keeps a cursor through the
    document's JSON, so a document is one unit of work.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, content, tokens in zip(batch["document_id"], batch["content"], batch["tokens"], strict=True):
                try:
                    raw = json.loads(content or "")
                except ValueError:
                    continue
                listed = [dict(t.asDict() if hasattr(t, "asDict") else t) for t in (tokens if tokens is not None else ())]
                graph = raw if isinstance(raw, dict) else {"entities": raw}
                for section, found in graph_confidences(content, content_tokens(content, listed), raw, graph).items():
                    rows += [(doc, section, k, c) for k, c in enumerate(found)]
            yield pd.DataFrame(rows, columns=["document_id", "section", "item_no", "confidence"])

    return extractions.select("document_id", "content", "tokens").mapInPandas(work, "document_id long, section string, item_no int, confidence double")
