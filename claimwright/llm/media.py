"""Media columns: signature sniffing with Aho-Corasick and format validators.

Magic bytes of all formats are found in one pass; a validator per format then confirms
the structure and reads the exact length from it, so that a chance hit inside other data
is refused, a wrong declared type is corrected and media inside media can be cut out.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache, cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimwright.llm.textbytes import slices, text_buffer

BLOCK = 64
RATE = 8000

#: Magic bytes by media type: fixed values of the public formats.
MAGIC = {
    b"RIFF": "audio/wav",
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"BM": "image/bmp",
    b"\x1f\x8b\x08": "application/gzip",
    b"PK\x03\x04": "application/zip",
    b"%PDF-": "application/pdf",
}


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


class Bytes:
    """Some bytes and what validators share about them: each terminator is looked for once, each block walked once."""

    def __init__(self, data: bytes):
        self.data = data
        self.gif_ends: dict[int, int | None] = {}

    @cached_property
    def pdf_ends(self) -> list[tuple[int, int, int]]:
        """(place, offset of the cross references, end) of every end of a PDF."""
        return [(m.start(), int(m[1]), m.end()) for m in _PDF_END.finditer(self.data)]

    @cached_property
    def pdf_heads(self) -> list[int]:
        return [m.start() for m in re.finditer(rb"%PDF-\d", self.data)]

    @cached_property
    def zip_ends(self) -> dict[int, int]:
        """start -> end of the archives: an end record tells where its archive begins."""
        found: dict[int, int] = {}
        for m in re.finditer(rb"PK\x05\x06", self.data):
            end = m.start()
            if end + 22 <= len(self.data):
                size, start, note = struct.unpack_from("<IIH", self.data, end + 12)
                head = end - size
                if head >= start and self.data[head : head + 4] in (b"PK\x01\x02", b"PK\x05\x06") and end + 22 + note <= len(self.data):
                    found.setdefault(head - start, end + 22 + note)
        return found


_PDF_END = re.compile(rb"startxref\s{1,4}(\d{1,12})\s{1,4}%%EOF")


def _wav(b: Bytes, at: int) -> int | None:
    data = b.data
    if data[at + 8 : at + 16] != b"WAVEfmt ":
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    place, seen = at + 12, False
    while place + 8 <= min(end, len(data)):
        name, size = data[place : place + 4], struct.unpack_from("<I", data, place + 4)[0]
        seen |= name == b"data"
        place += 8 + size + size % 2
    return end - at if seen and place == end <= len(data) else None


def _png(b: Bytes, at: int) -> int | None:
    data, place, first = memoryview(b.data), at + 8, True
    while place + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, place)
        body = place + 8 + size
        if body + 4 > len(data) or first and name != b"IHDR" or zlib.crc32(data[place + 4 : body]) != struct.unpack_from(">I", data, body)[0]:
            return None
        place, first = body + 4, False
        if name == b"IEND":
            return place - at
    return None


def _gif(b: Bytes, at: int) -> int | None:
    data = b.data
    if at + 13 > len(data):
        return None
    width, height, flags = struct.unpack_from("<HHB", data, at + 6)
    place, walked, end = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), [], None
    if not width or not height:
        return None
    while place < len(data):
        if place in b.gif_ends:
            end = b.gif_ends[place]
            break
        walked.append(place)
        kind = data[place]
        if kind == 0x3B:
            end = place + 1
            break
        if kind == 0x21:
            place += 2
        elif kind == 0x2C and place + 10 <= len(data):
            own = data[place + 9]
            place += 11 + (3 << (own & 7) + 1 if own & 0x80 else 0)
        else:
            break
        while place < len(data) and data[place]:
            place += 1 + data[place]
        place += 1
    b.gif_ends.update(dict.fromkeys(walked, end))
    return end - at if end else None


def _jpeg(b: Bytes, at: int) -> int | None:
    data, place = b.data, at + 2
    while place + 4 <= len(data) and data[place] == 0xFF:
        marker, size = data[place + 1], struct.unpack_from(">H", data, place + 2)[0]
        if not 0xC0 <= marker <= 0xFE or size < 2:
            return None
        place += 2 + size
        if marker == 0xDA:
            end = place
            while (end := data.find(b"\xff", end)) >= 0 and end + 1 < len(data):
                if data[end + 1] == 0xD9:
                    return end + 2 - at
                if data[end + 1] and not 0xD0 <= data[end + 1] <= 0xD7:
                    break
                end += 2
            else:
                return None
            place = end
    return None


def _bmp(b: Bytes, at: int) -> int | None:
    if at + 34 > len(b.data):
        return None
    size, spare, start, header, width, height, planes, bits, packing = struct.unpack_from("<IIIIiiHHI", b.data, at + 2)
    if header not in (40, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or spare or width <= 0 or not height:
        return None
    pixels = (bits * width + 31) // 32 * 4 * abs(height) if packing in (0, 3) else 1
    return size if 14 + header <= start and start + pixels <= size <= len(b.data) - at else None


def _gzip(b: Bytes, at: int) -> int | None:
    if at + 18 > len(b.data) or b.data[at + 3] & 0xE0:
        return None
    reader, piece = zlib.decompressobj(wbits=31), memoryview(b.data)[at:]
    try:
        while piece and not reader.eof:
            reader.decompress(piece[: 1 << 16], 1 << 20)
            piece = piece[len(piece[: 1 << 16]) - len(reader.unconsumed_tail) - len(reader.unused_data) :]
    except zlib.error:
        return None
    return len(b.data) - at - len(piece) if reader.eof else None


def _zip(b: Bytes, at: int) -> int | None:
    end = b.zip_ends.get(at)
    return end - at if end else None


def _pdf(b: Bytes, at: int) -> int | None:
    """To the last end, before the next head, whose cross references are where it says; else to the first such end."""
    if not b.data[at + 5 : at + 6].isdigit():
        return None
    first, head = bisect_left(b.pdf_ends, (at,)), bisect_right(b.pdf_heads, at)
    stop = bisect_left(b.pdf_ends, (b.pdf_heads[head],)) if head < len(b.pdf_heads) else len(b.pdf_ends)
    good = [end for place, offset, end in b.pdf_ends[first : max(stop, first + 1)] if at + offset < place and _XREF.match(b.data, at + offset)]
    return good[-1] - at if good else None


_XREF = re.compile(rb"xref\b|\d+ \d+ obj\b")

VALIDATORS = {
    "audio/wav": _wav,
    "image/png": _png,
    "image/gif": _gif,
    "image/jpeg": _jpeg,
    "image/bmp": _bmp,
    "application/gzip": _gzip,
    "application/zip": _zip,
    "application/pdf": _pdf,
}


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of every confirmed medium in `data`, in order of offset; media nest.

    Each magic hit is judged by its format's validator alone; a hit that fails is none.
    """
    found, shared = [], Bytes(data)
    for last, (size, kind) in _automaton().iter(data.decode("latin-1")):
        at = last + 1 - size
        length = VALIDATORS[kind](shared, at)
        if length:
            found.append((kind, at, length))
    return sorted(found, key=lambda x: (x[1], -x[2], x[0]))


def carve(data: bytes, inside: bool = False) -> list[tuple[str, int, bytes]]:
    """(type, offset, bytes) of the confirmed media that stand in no other one; `inside`: of those within the one at the start."""
    out, end = [], 0
    for kind, at, length in sniff(data):
        if at >= end and (at or not inside):
            out.append((kind, at, data[at : at + length]))
            end = at + length
    return out


def true_type(data: bytes, declared: str | None) -> str:
    """The type that the bytes confirm at their start; else the declared one if nothing is known of it, else unknown."""
    shared = Bytes(data)
    for magic, kind in MAGIC.items():
        if data.startswith(magic) and VALIDATORS[kind](shared, 0):
            return kind
    return declared if declared and declared not in VALIDATORS else "application/octet-stream"


def wav_of(payload: bytes) -> bytes:
    """The payload as 8-bit samples of one channel, byte for byte."""
    pad = len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def samples_of(wav: bytes) -> bytes:
    """The samples of a confirmed 8-bit WAV."""
    place = 12
    while True:
        name, size = struct.unpack_from("<4sI", wav, place)
        if name == b"data":
            return wav[place + 8 : place + 8 + size]
        place += 8 + size + size % 2


def features(samples: bytes) -> str:
    """Whole-number statistics of 8-bit samples: sum, energy around 128, least, greatest, crossings of 128."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    up = x >= 128
    return f"sum={x.sum()};energy={((x - 128) ** 2).sum()};min={x.min()};max={x.max()};crossings={int((up[1:] != up[:-1]).sum())}"


def store_texts(documents: DataFrame, declared: str = "image/png") -> DataFrame:
    """doc_id, n_bytes, declared_type, media_type, media: every text as a WAV of its padded UTF-8 bytes.

    documents: doc_id, text.  A null text is empty; an empty one is stored as 64 zeros.
    The column's declared type is kept as given, right or not; `read_media` corrects it.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffer(batch.column("text"))
            for start, stop in slices(offsets):
                raw = [data[a:b].tobytes() for a, b in zip(offsets[start:stop], offsets[start + 1 : stop + 1], strict=True)]
                media = [wav_of(x + b"\0" * (-len(x) % BLOCK or BLOCK * (not x))) for x in raw]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, stop - start), pa.array([len(x) for x in raw], pa.int64()), pa.array([declared] * len(raw)), pa.array(media, pa.binary())],
                    names=["doc_id", "n_bytes", "declared_type", "media"],
                )

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(store, "doc_id long, n_bytes long, declared_type string, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Every stored medium sniffed, corrected, carved and read back.

    media: doc_id, n_bytes, declared_type, media.  Adds media_type (by the bytes),
    corrected (it differs from the declared one), embedded (type, offset, length and
    sha256 of the media carved out of the payload; those within others aren't listed
    again), the payload's and the media's digests and sample features.  A null or
    unrecognised medium has its declared or the unknown type and null payload columns.
    Repeated rows are each answered.
    """
    out = (
        "doc_id long, n_bytes long, media_type string, corrected boolean, embedded array<struct<type: string, offset: long, length: long, sha256: string>>, "
        "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_type", pa.string()), ("corrected", pa.bool_())]
        + [("embedded", pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("sha256", pa.string())])))]
        + [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]
        + [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    )

    def one(doc_id: int | None, n_bytes: int | None, declared: str | None, data: bytes | None) -> dict:
        data = data or b""
        kind = true_type(data, declared)
        listed = lambda found: [{"type": k, "offset": at, "length": len(x), "sha256": hashlib.sha256(x).hexdigest()} for k, at, x in found]
        row = {"doc_id": doc_id, "n_bytes": n_bytes, "media_type": kind, "corrected": kind != declared}
        row |= {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
        if kind == "audio/wav":
            payload = samples_of(data)
            row["embedded"] = listed(carve(payload))
            inner = ",".join(f"{x['type']}@{x['offset']}+{x['length']}" for x in row["embedded"])
            row |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-BLOCK:])}
            row |= {"feature": f"{kind};{features(payload)};embedded={inner}"}
        else:
            row["embedded"] = listed(carve(data, inside=True))
        return row

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(x) for x in ("doc_id", "n_bytes", "declared_type", "media")]
            for row in range(0, len(batch), 256):
                part = [c.slice(row, 256).to_pylist() for c in columns]
                yield pa.RecordBatch.from_pylist([one(*x) for x in zip(*part, strict=True)], schema=schema)

    return media.select("doc_id", "n_bytes", "declared_type", "media").mapInArrow(read, out)
