"""Name keys and similarities."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimwright.plans.registry import CONTRACT_SUFFIXES, STRIP_TOKENS

#: What a key leaves out: a fixed value.
_PUNCTUATION = r"[\s　_,.\-・()（）]+"


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition, in Arrow batches; Spark SQL has no function for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def _as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_name(name: Column | str) -> Column:
    """The key of an already composed name: company forms deleted wherever they occur, longest first, then white space and punctuation."""
    tokens = sorted(STRIP_TOKENS, key=len, reverse=True)
    lowered = F.trim(F.lower(F.coalesce(_as_column(name), F.lit(""))))
    bare = reduce(lambda c, token: F.replace(c, F.lit(token.lower()), F.lit("")), tokens, lowered)
    return F.regexp_replace(bare, _PUNCTUATION, "")


def norm_key(name: Column | str) -> Column:
    """The key under which names are the same entity."""
    return strip_name(nfkc(_as_column(name)))


def ground_norm(text: Column | str) -> Column:
    """Composed and lower-cased, spaces kept."""
    return F.lower(nfkc(F.coalesce(_as_column(text), F.lit(""))))


def suffix_stripped(name: Column | str) -> Column:
    """The name without the first contract suffix that it ends in; null if none."""
    c = _as_column(name)
    out = F.lit(None).cast("string")
    for suffix in reversed(CONTRACT_SUFFIXES):
        out = F.when(c.endswith(suffix) & (F.length(c) > len(suffix)), c.substr(F.lit(1), F.length(c) - len(suffix))).otherwise(out)
    return out


def trigrams(key: Column | str) -> Column:
    """The distinct trigrams of a key with two spaces before it and one behind."""
    c = _as_column(key)
    padded = F.concat(F.lit("  "), c, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: padded.substr(i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every > 0, both / every).otherwise(0.0)


def similarity(a: Column | str, b: Column | str) -> Column:
    """Trigram Jaccard of two keys; 0 if either is empty."""
    x, y = _as_column(a), _as_column(b)
    return F.when((F.length(x) > 0) & (F.length(y) > 0), jaccard(trigrams(x), trigrams(y))).otherwise(0.0)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """In doubles; 0 for empty vectors, unequal lengths or a zero norm."""
    x, y = _as_column(a), _as_column(b)
    norm = F.sqrt(_dot(x, x)) * F.sqrt(_dot(y, y))
    usable = (F.size(x) > 0) & (F.size(x) == F.size(y))
    return F.coalesce(F.when(usable & (norm > 0), _dot(x, y) / norm), F.lit(0.0))
