import base64
import json
import random
import re
import zlib

from claimwright.llm import secret_scan

ASSIGN = re.compile(r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def brute(text):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


def base_spans(text):
    return [s for s in secret_scan.scan(text) if s[0] in secret_scan.BASE]


def test_against_plain_regular_expressions():
    rng = random.Random(5)
    parts = ["password", "PassWd", "secret", "ToKen", "apikey", "API_KEY", "=", ": ", " ", "'", '"', "AKIA", "AKIAABCDEFGHIJKLM", "deadbeef" * 4, "abc123", "é", "ſecret", "toKen", "\n", "x+/_.=-", "longvalue99"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert base_spans(text) == brute(text), text


def test_documents_against_plain_regular_expressions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert sum(map(len, (brute(r.text) for r in docs))) > 0
    assert all(base_spans(r.text) == brute(r.text) for r in docs)


def token(prefix, body):
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, d = divmod(value, 62)
        digits = secret_scan.BASE62[d] + digits
    return prefix + body + digits.rjust(6, "0")


def test_checksums_decide_vendor_tokens():
    good = token("ghp_", "abcdefghijklmnopqrstuvwxyz0123")
    bad = good[:-1] + ("a" if good[-1] != "a" else "b")
    assert secret_scan.scan(f"see {good} here") == [("github", 4, 44)] and secret_scan.scan(f"see {bad} here") == []
    assert [s[0] for s in secret_scan.scan(token("npm_", "A" * 30))] == ["npm"]
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    assert [s[0] for s in secret_scan.scan(f"{part({'alg': 'HS256'})}.{part({'sub': 'a'})}.sig")] == ["jwt"]
    assert secret_scan.scan("eyJabc.eyJdef.sig") == []
    der = b"\x30\x82\x01\x00" + b"\1" * 256
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{base64.b64encode(der).decode()}\n-----END RSA PRIVATE KEY-----"
    assert [s[0] for s in secret_scan.scan(pem)] == ["pem"]
    assert secret_scan.scan(pem.replace("BEGIN", "BEGIN", 1).replace(base64.b64encode(der).decode(), base64.b64encode(der[:-1]).decode())) == []


def test_table_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "é password=abcdefgh"), (3, "é password=abcdefgh"), (None, "x" * 100_000 + " token: 12345678")]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, spans string, n_chars int")
    found = secret_scan.digests(df).collect()
    assert len(found) == 5 and {r.doc_id: r.spans for r in found} == {1: "", 2: "", 3: "assign:2:19", None: "assign:100001:100016"}
    clean = secret_scan.redact(df)
    assert clean.columns == df.columns and clean.schema == df.schema
    got = {(r.doc_id, r.text, r.n_chars) for r in clean.collect() if r.doc_id}
    assert got == {(1, None, None), (2, "", 0), (3, "é [ASSIGN]", 10)}
    assert all(secret_scan.scan(r.text or "") == [] for r in clean.collect())
    assert {(r.doc_id, len(r.spans)) for r in secret_scan.scan_secrets(df).collect()} == {(1, 0), (2, 0), (3, 1), (None, 1)}
    assert secret_scan.digests(df.limit(0)).count() == 0


def test_runs_of_token_heads_take_time_in_proportion():
    import time

    began = time.perf_counter()
    assert [x for x in secret_scan.scan("eyJ" * 300_000) if x[0] == "jwt"] == []
    assert [x for x in secret_scan.scan(("eyJ" * 1000 + "." + "eyJ" * 1000 + " ") * 100) if x[0] == "jwt"] == []
    assert time.perf_counter() - began < 10
