import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from claimwright.llm import fill_middle

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plain_cut(doc_id, text):
    """The contract by regular expression and lists."""
    units, h = TOKEN.findall(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    first, last = sorted((a % (n + 1), b % (n + 1)))
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (units[:first], units[first:last], units[last:]))
    if d % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_select_finds_every_set_bit():
    rng = random.Random(3)
    for _ in range(200):
        width = rng.randrange(1, 300)
        bits = rng.getrandbits(width)
        places = [k for k in range(width) if bits >> k & 1]
        assert [fill_middle.select(bits, r, width) for r in range(len(places))] == places
        assert fill_middle.select(bits, len(places), width) == width


def test_texts_against_lists_of_tokens():
    rng = random.Random(7)
    parts = ["a", "Zz", " ", "\n", "é", "漢字", "🙂", "0", "<", "<S", "S>", "P>", "<M>", "word", "\u0000", "ſ"]
    for k in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(20)))
        got = fill_middle.rearranged(text.encode(), fill_middle.draws(k))
        assert (got["n"], got["form"], got["prefix_chars"], got["middle_chars"], got["output"].decode()) == plain_cut(k, text), text


def test_table_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a<P>b"), (4, "x " * 200_000 + "é"), (4, "x " * 200_000 + "é"), (None, "no id here, é"), (5, "<"), (6, "漢" * 50)]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, form string, n int")
    made = fill_middle.transform(df).withColumn("back", fill_middle.restored())
    got = sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made.collect())))
    assert got == sorted(map(repr, ((i, *plain_cut(i, t or ""), t or "") for i, t in rows)))
    assert fill_middle.transform(df.limit(0)).count() == 0


def test_every_form_is_restored(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    made = fill_middle.transform(docs).withColumn("back", fill_middle.restored()).join(docs, "doc_id")
    assert made.filter(~F.col("back").eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0
    assert {r.form for r in made.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_long_texts_take_linear_time():
    seconds = []
    for size in (1_000_000, 4_000_000):
        data = b"some words and, 12 signs. " * (size // 26)
        began = time.perf_counter()
        fill_middle.rearranged(data, [1 << 30, 1 << 29, 0, 0])
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 12 * max(seconds[0], 0.05)
