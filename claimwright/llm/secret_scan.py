"""Secret scanning: an Aho-Corasick prefilter, anchored patterns at its hits, checksums.

One pass over the ASCII-lowered text finds every keyword; only at a hit does a pattern
try to match, anchored there.  Since every pattern starts with one of its keywords this
gives the leftmost non-overlapping matches.  Hexadecimal digests have no keyword; runs
are looked for directly.  Vendor tokens carry a checksum or a structure that is verified.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: Kinds in order; the first three are the base ones.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE = KINDS[:3]

#: Keywords (ASCII-lowered) and anchored pattern of each kind: fixed values.
PATTERNS = {
    "assign": (
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE),
    ),
    "access": (("akia",), re.compile(r"AKIA[A-Z0-9]+")),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")),
    "npm": (("npm_",), re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")),
    "jwt": (("eyj",), re.compile(r"(eyJ[A-Za-z0-9_-]++)\.(eyJ[A-Za-z0-9_-]++)\.[A-Za-z0-9_-]+")),
    "pem": (("-----begin ",), re.compile(r"-----BEGIN ((?:[A-Z]+ )*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")),
}
HEX = re.compile(r"[0-9a-f]{32,}")
_JWT_RUN = re.compile(r"[A-Za-z0-9_-]*+")


def _crc_token(m: re.Match) -> bool:
    """The last six digits are the CRC-32 of the thirty before them, in base 62."""
    value, digits = zlib.crc32(m[1].encode()), ""
    while value:
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits.rjust(6, "0") == m[2]


def _json_part(part: str) -> dict:
    return json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))


def _jwt(m: re.Match) -> bool:
    try:
        return "alg" in _json_part(m[1]) and isinstance(_json_part(m[2]), dict)
    except (ValueError, TypeError, binascii.Error):
        return False


def _pem(m: re.Match) -> bool:
    """The body is base64 of one DER sequence whose length is the body's."""
    try:
        der = base64.b64decode(re.sub(r"\s", "", m[2]), validate=True)
    except binascii.Error:
        return False
    if len(der) < 4 or der[0] != 0x30:
        return False
    wide = der[1] & 0x7F if der[1] & 0x80 else 0
    size = int.from_bytes(der[2 : 2 + wide], "big") if wide else der[1]
    return 2 + wide + size == len(der)


VALID: dict[str, Callable[[re.Match], bool]] = {
    "assign": lambda m: len(m[2]) >= 8,
    "access": lambda m: len(m[0]) >= 16,
    "github": _crc_token,
    "npm": _crc_token,
    "jwt": _jwt,
    "pem": _pem,
}


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, (keywords, _) in PATTERNS.items():
        for word in keywords:
            found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def ascii_lower(text: str) -> str:
    """A-Z lower-cased, all else kept, so that places stay the same."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret in code points, by start, then by kind as listed.

    Per kind the matches are the leftmost non-overlapping ones of its pattern; those that
    fail the kind's length or checksum are dropped after they have taken their place.
    """
    hits = sorted((last + 1 - size, KINDS.index(kind)) for last, (size, kind) in _automaton().iter(ascii_lower(text)))
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    free = [0] * len(KINDS)
    for at, k in hits:
        if at >= free[k] and (m := PATTERNS[KINDS[k]][1].match(text, at)):
            free[k] = m.end()
            if VALID[KINDS[k]](m):
                found.append((at, k, m.end()))
        elif at >= free[k] and KINDS[k] == "jwt":
            # what fails here fails wherever else in the same run it would start
            free[k] = _JWT_RUN.match(text, at).end()
    return [(KINDS[k], start, end) for start, k, end in sorted(found)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the name of its first kind."""
    out, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def scan_secrets(documents: DataFrame) -> DataFrame:
    """doc_id, spans (kind, start, end) and clean_text for every row of `documents`; texts are scanned whole.

    documents: doc_id, text.  A null or empty text has no spans and stays as it is; a
    text without secrets is its own clean_text.  Repeated rows are each answered.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN)), ("clean_text", pa.string())])

    def one(doc_id: int | None, text: str | None) -> dict:
        spans = scan(text) if text else []
        clean = redacted(text, spans) if spans else text
        return {"doc_id": doc_id, "spans": [{"kind": k, "start": a, "end": b} for k, a, b in spans], "clean_text": clean}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, len(batch), 512):
                ids, texts = (batch.column(x).slice(row, 512).to_pylist() for x in ("doc_id", "text"))
                yield pa.RecordBatch.from_pylist([one(*x) for x in zip(ids, texts, strict=True)], schema=schema)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(work, "doc_id long, spans array<struct<kind: string, start: long, end: long>>, clean_text string")


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (joined) of every row; a null or empty text has none."""
    schema = pa.schema([("doc_id", pa.int64())] + [(f"n_{k}", pa.int64()) for k in BASE] + [("base_sha256", pa.string()), ("spans", pa.string())])

    def one(doc_id: int | None, text: str | None) -> dict:
        spans = scan(text) if text else []
        base = [s for s in spans if s[0] in BASE]
        counts = {f"n_{k}": sum(s[0] == k for s in base) for k in BASE}
        return {"doc_id": doc_id, **counts, "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "spans": joined(spans)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, len(batch), 512):
                ids, texts = (batch.column(x).slice(row, 512).to_pylist() for x in ("doc_id", "text"))
                yield pa.RecordBatch.from_pylist([one(*x) for x in zip(ids, texts, strict=True)], schema=schema)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(documents: DataFrame) -> DataFrame:
    """`documents` with every secret in text replaced and n_chars brought up to date; no row goes, nulls stay."""
    names = documents.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, len(batch), 512):
                part = batch.slice(row, 512)
                at = names.index("text")
                texts = [redacted(t, s) if t and (s := scan(t)) else t for t in part.column(at).to_pylist()]
                columns = list(part.columns)
                columns[at] = pa.array(texts, part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    out = documents.mapInArrow(work, documents.schema)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in names else out
