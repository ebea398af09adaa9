"""Fill-in-middle: cutting texts at token boundaries with bit-parallel big integers.

A text is one integer a class, one bit a UTF-8 byte: `bytes.translate` turns the bytes
into binary digits, shifts and boolean operations mark where tokens start, `bit_count`
gives their number, and a token's place is found by halving the integer and counting the
bits of one half.  Each of these is linear in the text and runs inside Python's integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of a hundred texts, those that stay as they are, and those of the others with the suffix first.
PLAIN_FROM = 90
SUFFIX_FIRST_BELOW = 20

_LETTER = bytes(49 if chr(b).isascii() and chr(b).isalpha() else 48 for b in range(256))
_INSIDE = bytes(49 if b & 0xC0 == 0x80 else 48 for b in range(256))


def mask(data: bytes, classes: bytes) -> int:
    """Bit k is set if byte k is of the class."""
    return int(data.translate(classes)[::-1] or b"0", 2)


def boundaries(data: bytes) -> tuple[int, int]:
    """(first bytes of code points, first bytes of tokens) of UTF-8 bytes, as masks.

    A token is a run of ASCII letters or any other single code point, so it starts at
    each code point but a letter after a letter.
    """
    heads = ((1 << len(data)) - 1) & ~mask(data, _INSIDE)
    letters = mask(data, _LETTER)
    return heads, heads & ~(letters & (letters << 1))


def select(bits: int, rank: int, width: int) -> int:
    """The place of the set bit that has `rank` set bits below it; `width` if there is none."""
    if rank >= bits.bit_count():
        return width
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            bits, width = low, half
        else:
            bits, rank, at, width = bits >> half, rank - below, at + half, width - half
    return at


def draws(doc_id: int | None, seed: int = 1) -> list[int]:
    """Four numbers of 32 bits from the document's id; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def rearranged(data: bytes, numbers: list[int]) -> dict:
    """n, form, prefix_chars, middle_chars and output of one text."""
    heads, starts = boundaries(data)
    n = starts.bit_count()
    plain = {"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": data}
    if not data or numbers[2] % 100 >= PLAIN_FROM or any(m in data for m in (PREFIX, SUFFIX, MIDDLE)):
        return plain
    first, last = (select(starts, k, len(data)) for k in sorted(x % (n + 1) for x in numbers[:2]))
    prefix, middle, suffix = data[:first], data[first:last], data[last:]
    before = (heads & ((1 << first) - 1)).bit_count()
    counts = {"prefix_chars": before, "middle_chars": (heads & ((1 << last) - 1)).bit_count() - before}
    if numbers[3] % 100 < SUFFIX_FIRST_BELOW:
        return plain | counts | {"form": "spm", "output": b"".join([SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle])}
    return plain | counts | {"form": "psm", "output": b"".join([PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle])}


def transform(documents: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row of `documents`.

    documents: doc_id, text; other columns are ignored.  n counts the tokens; form is
    plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle); output is the
    training text.  The cuts follow from seed and doc_id alone, so equal rows, and
    reruns, get equal outputs; rows that share an id share its draws.  A null text is an
    empty one, and an empty text, or one that holds a mark itself, stays plain.  A null
    doc_id draws as an empty one.  Texts are taken whole, as bytes: one integer a class of
    an eighth of the text's size.  An empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, len(batch), 256):
                ids, texts = (batch.column(x).slice(row, 256).to_pylist() for x in ("doc_id", "text"))
                found = [{"doc_id": i} | rearranged(t or b"", draws(i, seed)) for i, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    cut = docs.mapInArrow(work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return cut.withColumn("output", F.col("output").cast("string"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of.

    A text with a mark stays plain, so the first of each mark is the one that was put
    there: no text ends in a way that makes one with the mark behind it.
    """
    text, marks = F.col(output), [m.decode() for m in (PREFIX, SUFFIX, MIDDLE)]
    place = {m: F.instr(text, m) for m in marks}

    def between(mark: str, following: str | None) -> Column:
        start = place[mark] + len(mark)
        return F.substring(text, start, place[following] - start if following else F.length(text))

    p, s, m = marks
    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(text)
