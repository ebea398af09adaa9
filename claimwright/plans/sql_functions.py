"""SQLite's spellings for questions that were written for it, as temporary SQL functions, which Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Fields of SQLite's strftime and Spark's patterns of them: fixed values.
_FIELDS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%f": "ss.SSS"}


def _pattern(column: str) -> str:
    out = f"replace({column}, '%s', '')"
    for field, pattern in _FIELDS.items():
        out = f"replace({out}, '{field}', '{pattern}')"
    return out


#: Name and arguments, type, and body of each.
FUNCTIONS = (
    ("iif(c BOOLEAN, a STRING, b STRING)", "STRING", "CASE WHEN c THEN a ELSE b END"),
    ("strftime(form STRING, at STRING)", "STRING", f"date_format(try_to_timestamp(at), {_pattern('form')})"),
    # whole days and microseconds apart, so that a double keeps both
    ("julianday(at STRING)", "DOUBLE", "2440587.5D + unix_micros(try_to_timestamp(at)) / 86400000000.0D"),
    ("unixepoch(at STRING)", "BIGINT", "unix_seconds(try_to_timestamp(at))"),
    ("total(x ARRAY<DOUBLE>)", "DOUBLE", "aggregate(filter(coalesce(x, array()), v -> v IS NOT NULL), 0.0D, (s, v) -> s + v)"),
    ("group_concat(x ARRAY<STRING>, between STRING)", "STRING", "CASE WHEN size(filter(x, v -> v IS NOT NULL)) > 0 THEN array_join(filter(x, v -> v IS NOT NULL), between) END"),
)


def register(spark: SparkSession) -> None:
    """The functions, for this session; `total` and `group_concat` take what collect_list gives."""
    for head, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
