"""WARC archives: written with segments and revisits, read back by reassembling segments.

Writing is Spark's own text writer over records made in tasks, so files are committed
task by task in any storage that Spark writes.  A page is an HTTP response with chunked
framing; a block longer than a segment goes on in continuation records that name their
origin.  Reading parses each file as a stream by Content-Length, gathers the segments of
an origin, orders them by number, holds them against the total length, and takes the
chunked framing off.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimwright.llm.scratch import shared_folder

#: Payloads shorter than this are always stored.
LEAST_REVISIT = 100
#: Bytes of a chunk of HTTP, of a segment's block, and records of a file; a file has at most 256 MB.
CHUNK_BYTES = 1 << 13
SEGMENT_BYTES = 1 << 16
RECORDS_PER_FILE = 1 << 12
#: A digest with more than this share of all rows is settled by a broadcast of at most 1 / HOT_SHARE rows.
HOT_SHARE = 1e-3

_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


class Damaged(ValueError):
    """A record that can't be given back whole."""


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in HTTP's chunked framing."""
    parts = []
    for k in range(0, len(payload), size):
        part = payload[k : k + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions of chunks and trailers are passed over."""
    at, parts = 0, []
    while True:
        stop = body.find(b"\r\n", at)
        if stop < 0:
            raise Damaged("chunk without size")
        try:
            size = int(body[at:stop].partition(b";")[0].strip(), 16)
        except ValueError:
            raise Damaged("chunk without size") from None
        at = stop + 2
        if size == 0:
            return b"".join(parts)
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            raise Damaged("chunk cut off")
        parts.append(body[at : at + size])
        at += size + 2


def record(fields: dict, block: bytes) -> bytes:
    """One WARC record."""
    named = "".join(f"{name}: {value}\r\n" for name, value in fields.items() if value is not None)
    return b"".join([b"WARC/1.1\r\n", named.encode(), b"Content-Length: %d\r\n\r\n" % len(block), block, _END])


def _identity(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest[:32]}>"


def _page(identity: str | None) -> int | None:
    number = identity.split(":")[2] if identity and identity.startswith("<urn:page:") else ""
    return int(number) if number else None


def records_of(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page: a revisit of page `first`, or a response and its continuations."""
    own = _identity(page_id, digest)
    # a line of the header has no control characters
    target = "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url) if url else None
    fields = {"WARC-Record-ID": own, "WARC-Date": _DATE, "WARC-Target-URI": target, "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response"}
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if first is not None:
        seen = {"WARC-Type": "revisit", "WARC-Profile": _PROFILE, "WARC-Refers-To": _identity(first, digest)}
        yield record(seen | fields, f"{head}Content-Length: {len(payload)}\r\n\r\n".encode())
        return
    block = f"{head}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload)
    if len(block) <= segment:
        yield record({"WARC-Type": "response"} | fields, block)
        return
    last = (len(block) - 1) // segment
    for k in range(last + 1):
        part = block[k * segment : (k + 1) * segment]
        number = {"WARC-Segment-Number": k + 1}
        if k == 0:
            yield record({"WARC-Type": "response"} | fields | number, part)
        else:
            more = {"WARC-Type": "continuation", "WARC-Record-ID": f"{own[:-1]}:{k + 1}>", "WARC-Date": _DATE, "WARC-Segment-Origin-ID": own}
            yield record(more | number | {"WARC-Segment-Total-Length": len(block) if k == last else None}, part)


def with_firsts(pages: DataFrame, least: int = LEAST_REVISIT, hot_share: float = HOT_SHARE) -> DataFrame:
    """page_id, url, html, digest, first: the page whose record a page only refers to, else null.

    The least page_id of each digest is found by an aggregate.  Digests that hold more
    than `hot_share` of all rows are few by that very share, and are broadcast, so that
    their rows aren't dealt by digest; the others are joined.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    long = F.octet_length("html") >= least
    groups = rows.filter(long).groupBy("digest").agg(F.min("page_id").alias("least_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    bound = max(int(pages.count() * hot_share), 1)
    hot, rest = groups.filter(F.col("n") > bound).drop("n"), groups.filter(F.col("n") <= bound).drop("n")
    settled = rows.join(F.broadcast(hot), "digest", "left_semi").join(F.broadcast(hot), "digest")
    dealt = rows.join(F.broadcast(hot), "digest", "left_anti").join(rest, "digest", "left")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("least_id")), F.col("least_id"))
    return settled.unionByName(dealt).select("page_id", "url", "html", "digest", first.alias("first"))


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes one record, or one and its continuations, a row of `pages` to gzipped WARC files in `path`.

    pages: page_id, url, html; other columns are ignored.  A null html is an empty payload, a
    null url leaves the target out.  Of equal payloads of LEAST_REVISIT bytes the one
    with the least page_id is stored, others refer to it; rows that share that id are
    stored each.  Null ids refer to any other, and are stored where all are null.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, len(batch), 128):
                part = batch.slice(row, 128).to_pylist()
                made = [r[:-1] for p in part for r in records_of(p["page_id"], p["url"], p["html"], p["digest"], p["first"], segment_bytes)]
                # the writer's line end is the last byte of a record
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    rows = with_firsts(pages).withColumn("html", F.col("html").cast("binary"))
    made = rows.mapInArrow(work, "value binary").select(F.col("value").cast("string").alias("value"))
    made.write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).text(path)


def parsed(content: bytes) -> Iterator[tuple[dict, bytes]]:
    """(fields by lower-case name, block) of each record of a WARC file, gzipped as a whole, by record, or not at all."""
    stream: io.BufferedIOBase = io.BytesIO(content)
    if content[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 16)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise Damaged("no record where one starts")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields.get("content-length", 0))
        block = stream.read(size)
        if len(block) < size:
            raise Damaged("file cut off")
        yield fields, block


def decoded(fields: dict, block: bytes) -> dict:
    """A whole record as a row; `error` says why a payload can't be given back."""
    head, _, body = block.partition(_END)
    named = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    stated = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    row = {
        "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "page_id": _page(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"),
        "refers_to": _page(fields.get("warc-refers-to")), "payload": None, "payload_bytes": None, "payload_digest": stated, "error": None,
    }
    try:
        if row["record_type"] == "revisit":
            return row | {"payload_bytes": int(named["content-length"]) if "content-length" in named else None}
        payload = unchunked(body) if named.get("transfer-encoding", "").lower() == "chunked" else body
    except ValueError as damage:
        return row | {"error": str(damage)}
    digest = hashlib.sha256(payload).hexdigest()
    error = "payload differs from its digest" if stated and stated != digest else None
    return row | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest, "error": error}


def reassembled(segments: list[dict]) -> list[dict]:
    """The rows of one origin from its segments (number, total, fields, block) in any order.

    An origin that was written more than once, as repeated rows are, gives as many rows.
    A missing segment or another total length gives one row with an error.
    """
    by_number: dict[int, list[dict]] = {}
    for s in segments:
        by_number.setdefault(s["number"], []).append(s)
    ordered = [by_number[k] for k in sorted(by_number)]
    first = ordered[0][0]
    fields = dict(first["fields"])
    block = b"".join(same[0]["block"] for same in ordered)
    totals = {s["total"] for s in segments if s["total"] is not None}
    whole = sorted(by_number) == list(range(1, len(ordered) + 1)) and totals == {len(block)} and len({len(same) for same in ordered}) == 1
    if not whole:
        return [decoded(fields, b"") | {"payload": None, "payload_bytes": None, "error": "segments missing or of another length"}]
    return [decoded(fields, block)] * len(ordered[0])


_ROW = "record_id string, record_type string, page_id long, url string, refers_to long, payload binary, payload_bytes long, payload_digest string, error string"
_SCHEMA = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in _ROW.split(", "))])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, page_id, url, refers_to, payload, payload_bytes, payload_digest, error of every record.

    Each file is parsed as a stream in one task.  Whole records are decoded there;
    segments are gathered by origin, a group that is as long as its record.  A response's
    digest is that of the decoded payload and is held against the stated one; a revisit
    has no payload and tells its length and digest.  Records without payload, as
    warcinfo, come with what they state.  A damaged record has an error, and a file
    that isn't WARC fails the job.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*[!_]*").load(path).select("content")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, block in parsed(content.as_py()):
                    if "warc-segment-number" in fields:
                        continue
                    rows.append(decoded(fields, block))
                    held += len(block)
                    if held >= 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    part = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for fields, block in parsed(content.as_py()):
                    if "warc-segment-number" in fields:
                        origin = fields.get("warc-segment-origin-id", fields.get("warc-record-id"))
                        total = fields.get("warc-segment-total-length")
                        row = {"origin": origin, "number": int(fields["warc-segment-number"]), "total": int(total) if total else None, "fields": list(fields.items()), "block": block}
                        yield pa.RecordBatch.from_pylist([row], schema=part)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segments in batch.column(0):
                found = [s | {"fields": dict(s["fields"])} for s in segments.as_py()]
                yield pa.RecordBatch.from_pylist(reassembled(found), schema=_SCHEMA)

    segments = files.mapInArrow(pieces, "origin string, number int, total long, fields map<string, string>, block binary")
    gathered = segments.groupBy("origin").agg(F.collect_list(F.struct("number", "total", "fields", "block")).alias("segments"))
    return files.mapInArrow(whole, _ROW).unionByName(gathered.select("segments").mapInArrow(joined, _ROW))


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """The records of `pages`, written to `path` (a new folder in the shared one if null) and read back.

    An empty table writes no record and gives no row.
    """
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return read_archives(spark, path)
