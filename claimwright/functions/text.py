"""Slugs, search terms, snippets, chunks and loose JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimwright.plans.registry import CHUNK_CHARS, PAYLOAD

_TERM = r"(?U)\w{2,}"


def slug(file_name: Column | str) -> Column:
    """A file name without its last extension, spaces as hyphens."""
    c = F.col(file_name) if isinstance(file_name, str) else file_name
    return F.replace(F.regexp_replace(c, r"(?<=.)\.[^.]*$", ""), F.lit(" "), F.lit("-"))


def title(slug_: Column | str) -> Column:
    c = F.col(slug_) if isinstance(slug_, str) else slug_
    return F.replace(c, F.lit("-"), F.lit(" "))


def terms(text: Column | str) -> Column:
    """The lower-cased words of two or more characters, in order."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(_TERM), F.lit(0))


def snippet(text: Column | str, wanted: Column, width: int = 15) -> Column:
    """`width` white-space tokens around the first that holds a wanted term, hits in >> <<, cut ends as dots."""
    c = F.col(text) if isinstance(text, str) else text
    tokens = F.split(F.trim(c), r"\s+")
    hit = F.transform(tokens, lambda t: F.size(F.array_intersect(terms(t), wanted)) > 0)
    first = F.greatest(F.array_position(hit, True).cast("int"), F.lit(1))
    start = F.greatest(F.lit(1), F.least(first - width // 2, F.size(tokens) - width + 1))
    marked = F.transform(F.arrays_zip(tokens.alias("t"), hit.alias("h")), lambda x: F.when(x["h"], F.concat(F.lit(">>"), x["t"], F.lit("<<"))).otherwise(x["t"]))
    shown = F.array_join(F.slice(marked, start, F.lit(width)), " ")
    before = F.when(start > 1, F.lit("…")).otherwise(F.lit(""))
    after = F.when(start + width - 1 < F.size(tokens), F.lit("…")).otherwise(F.lit(""))
    return F.concat(before, shown, after)


# Chunking ---------------------------------------------------------------------------

_BLANK = re.compile(r"\n\s*\n")
_HEADER = re.compile(r"(?m)^(#{1,6})\s")


def _between(text: str, start: int, end: int, cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of [start, end) without the gaps [a, b) in `cuts`, blank pieces dropped."""
    edges = [start, *(x for a, b in cuts if start <= a and b <= end for x in (a, b)), end]
    return [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if text[a:b].strip()]


def chunks(text: str | None, limit: int = CHUNK_CHARS) -> list[str]:
    """Pieces of at most `limit` characters: sections, paragraphs, then fixed cuts, packed greedily with blank lines.

    Everything is a list of offset pairs until the pieces are packed.  Headers of level 2
    cut the text; those of the next levels cut only what is still too long.  A text
    without headers is cut at blank lines.
    """
    size = len(text or "")
    if size <= limit:
        return [text or ""]
    headers = [(m.start(), len(m[1])) for m in _HEADER.finditer(text)]
    blanks = [m.span() for m in _BLANK.finditer(text)]
    spans = [(0, size)]
    for level in range(2, 7) if headers else ():
        cuts = [(at, at) for at, depth in headers if depth == level]
        spans = [piece for a, b in spans for piece in (_between(text, a, b, cuts) if b - a > limit else [(a, b)])]
    if not headers:
        spans = _between(text, 0, size, blanks) or spans
    spans = [piece for a, b in spans for piece in (_between(text, a, b, blanks) if b - a > limit else [(a, b)])]
    packed: list[str] = []
    for a, b in spans:
        for at in range(a, b, limit):
            piece = text[at : min(at + limit, b)]
            if packed and len(packed[-1]) + len(piece) + 2 <= limit:
                packed[-1] = f"{packed[-1]}\n\n{piece}"
            else:
                packed.append(piece)
    return packed


def chunk_documents(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", limit: int = CHUNK_CHARS) -> DataFrame:
    """(id, chunk_no, chunk): greedy packing is sequential within a document, so it runs per row in Arrow batches."""

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda x: chunks(x, limit))

    return documents.select(F.col(id_column), F.posexplode(cut(F.col(text_column))).alias("chunk_no", "chunk"))


# JSON -------------------------------------------------------------------------------


_FENCE = re.compile(r"^\s*(?:```json)?(?:```)?|```\s*$")
_READER = json.JSONDecoder()


def loads_loose(raw: str | None) -> object:
    """Model output as JSON, without fences: the whole text, else its outermost list, else its outermost object, else an empty list."""
    text = _FENCE.sub("", raw or "").strip()
    for start, end in ((0, len(text)), (text.find("["), text.rfind("]") + 1), (text.find("{"), text.rfind("}") + 1)):
        if 0 <= start < end:
            try:
                value, stop = _READER.raw_decode(text, start)
            except ValueError:
                continue
            if stop == end:
                return value
    return []


@F.pandas_udf(T.StringType())
def json_loose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: json.dumps(loads_loose(x), ensure_ascii=False))


def parse_payload(raw: Column | str) -> Column:
    """An extraction payload as a struct: a bare list means entities; each item is parsed on its own, unusable ones are dropped."""
    c = json_loose(F.col(raw) if isinstance(raw, str) else raw)
    whole = F.when(c.startswith("["), F.concat(F.lit('{"entities":'), c, F.lit("}"))).otherwise(c)
    named = F.from_json(whole, "entities array<string>, relations array<string>, weak_relations array<string>")
    needed = {"entities": ("proposed_type", "canonical_name"), "relations": ("proposed_junction", "from", "to"), "weak_relations": ("subject", "predicate", "object")}
    parts = []
    for name, keys in needed.items():
        parsed = F.transform(F.coalesce(named[name], F.array().cast("array<string>")), _reader(PAYLOAD[name]))

        parts.append(F.filter(parsed, _usable(keys)).alias(name))
    return F.struct(*parts)


def _reader(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.from_json(x, kind)


def _usable(keys: tuple[str, ...]) -> Callable[[Column], Column]:
    """Whether an item was read and has all of its needed fields."""

    def usable(x: Column) -> Column:
        ok = x.isNotNull()
        for key in keys:
            ok = ok & x[key].isNotNull()
        return ok

    return usable
