import gzip
import hashlib
import io
import struct
import zipfile
import zlib

from claimwright.llm import media


def png():
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
JPEG = b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00\x12\xff\x00\x34\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
ALL = {"image/png": png(), "image/gif": GIF, "image/bmp": BMP, "image/jpeg": JPEG, "application/gzip": gzip.compress(b"x" * 90), "application/zip": zipped(), "application/pdf": PDF, "audio/wav": media.wav_of(b"abcd")}


def test_every_format_is_confirmed_alone_and_carved_from_noise():
    for kind, data in ALL.items():
        assert (kind, 0, len(data)) in media.sniff(data), kind
        inside = b"noise BM GIF89a " + data + b" tail \xff\xd8\xff"
        assert (kind, 16, data) in [(k, at, x) for k, at, x in media.carve(inside)], kind
        assert media.true_type(data, "image/webp") == kind


def test_truncated_and_false_magic_is_refused():
    for kind, data in ALL.items():
        assert all(k != kind or at for k, at, _ in media.sniff(data[: len(data) * 2 // 3])), kind
    # cross references that aren't where the end says
    assert media.sniff(PDF.replace(b"\n9\n", b"\n11\n")) == []
    assert media.sniff(b"BM RIFF GIF89a %PDF- PK\x03\x04 \x1f\x8b\x08 \x89PNG\r\n\x1a\n") == []
    assert media.true_type(b"nothing", "image/png") == "application/octet-stream" and media.true_type(b"nothing", "text/plain") == "text/plain"


def test_texts_round_trip(spark):
    texts = [(1, "Été"), (2, None), (3, ""), (4, "x" * 64), (5, "y" * 65), (6, "Été"), (7, "a" * 300_000), (None, "GIF89a RIFF")]
    df = spark.createDataFrame([(i, t, "extra") for i, t in texts], "doc_id long, text string, media string")
    rows = {r.doc_id: r for r in media.read_media(media.store_texts(df)).collect()}
    for i, text in texts:
        raw = (text or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        wav, r = media.wav_of(padded), rows[i]
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(padded), len(wav))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.media_sha256 == hashlib.sha256(wav).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-64:]) and r.media_type == "audio/wav" and r.corrected
        assert media.samples_of(wav) == padded
    assert rows[1].feature == rows[6].feature and rows[2].feature == rows[3].feature
    assert media.read_media(media.store_texts(df.limit(0))).count() == 0


def test_unrecognised_media_come_back_without_payload(spark):
    df = spark.createDataFrame([(1, 3, "text/plain", bytearray(b"abc")), (2, 0, None, None), (3, 9, "image/jpeg", bytearray(b"pre" + GIF))], "doc_id long, n_bytes long, declared_type string, media binary")
    rows = {r.doc_id: r for r in media.read_media(df).collect()}
    assert rows[1].media_type == "text/plain" and rows[1].payload_bytes is None and not rows[1].corrected
    assert rows[2].media_type == "application/octet-stream" and rows[2].media_bytes == 0
    assert rows[3].media_type == "application/octet-stream" and [(e.type, e.offset) for e in rows[3].embedded] == [("image/gif", 3)]


def test_repeated_magic_takes_time_in_proportion():
    import time

    for magic in (b"%PDF-1 ", b"%PDF-1 startxref 9 ", b"GIF89a,,!,", b"PK\x03\x04PK\x05\x06", b"\x1f\x8b\x08\x00", b"RIFF\x00\x00\x00\x00WAVEfmt "):
        took = []
        for n in (20_000, 80_000):
            began = time.perf_counter()
            media.sniff(magic * n)
            took.append(time.perf_counter() - began)
        assert took[1] < 10 * took[0] + 0.2, magic


def test_embedded_media_are_carved_from_the_payload(spark):
    inside = b"".join((PDF, b" and ", PDF))
    rows = media.read_media(media.store_texts(spark.createDataFrame([(1, f"see {inside.decode()}!")], "doc_id long, text string"))).collect()
    assert [(e.type, e.offset, e.length, e.sha256) for e in rows[0].embedded] == [("application/pdf", at, len(PDF), hashlib.sha256(PDF).hexdigest()) for at in (4, 9 + len(PDF))]
