"""The registered queries of the operators and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimwright.llm import decontam, fill_middle, html_text, langid, media, minhash, mixing, quality, resampling, secret_scan, toxicity, url_filter, warc
from claimwright.llm.labelled import remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.read_media(media.store_texts(_table(spark, sf_dir, "documents")))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "corrected", "embedded")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    scored = quality.score(documents, quality.fit(documents, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    scored = toxicity.score(documents, toxicity.fit(documents, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), decontam.is_contaminated().alias("contaminated"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    predicted = langid.predict(documents, langid.fit(documents))
    return predicted.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(_table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_media_columns, op3_quality_classifier, op4_html_extraction, op5_url_filters,
        op6_secret_scans, op7_toxicity, op8_decontamination, op9_language_id, op10_source_mixing,
        op11_fill_in_middle, op12_importance_resampling, op13_warc, pipeline,
    )
}

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP8 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
h AS (SELECT DISTINCT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""

_OP10 = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS DOUBLE) AS weight FROM s),
l AS (SELECT *, row_number() OVER o AS rank,
             (1.5 * sum(source_size) OVER () - 2.0 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
      FROM w WINDOW o AS (ORDER BY source_size / weight, source IS NULL, source)),
v AS (SELECT *, level * weight > 2.0 * source_size AS over_cap FROM l),
f AS (SELECT source, source_size, CAST(CASE WHEN over_cap THEN 2.0 * source_size
             ELSE weight * (SELECT level FROM v WHERE NOT over_cap ORDER BY rank LIMIT 1) END AS DOUBLE) AS target FROM v),
p AS (SELECT d.doc_id, d.size, f.source_size, f.target, CASE WHEN f.source_size > 0 THEN CAST(floor(f.target / f.source_size) AS BIGINT) ELSE 0 END AS epochs,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken
FROM p
"""


_OP11 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(x, k, 8) AS BIGINT)) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

# crc32 byte by byte: the 256 states by the polynomial's rule, then a fold over the hexadecimal digits of each distinct run
_OP12 = f"""
WITH RECURSIVE step(b, k, v) AS (SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256) UNION ALL
                       SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8),
tab AS (SELECT list(v ORDER BY b) AS t FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
b AS (SELECT regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM benchmark),
df AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
bf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
hexed AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM bf))),
bytes AS (SELECT f, list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))) AS y FROM hexed),
key AS (SELECT f, xor(list_reduce(y, lambda s, c: xor(s >> 8, t[xor(s & 255, c) + 1])), 4294967295) % 10000 AS bucket FROM bytes, tab),
s AS (SELECT bucket, count(*) AS s FROM df JOIN key USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN key USING (f) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000.0::DOUBLE)))) AS BIGINT) AS gain
      FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT r, count(*) AS n, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM df JOIN key USING (f) JOIN g USING (bucket) GROUP BY r),
z AS (SELECT doc_id, len(d.w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN w USING (r)),
o AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= (SELECT count(*) FROM z WHERE n_words >= 20) * 25 // 100 THEN place END AS rank FROM o
"""

_OP13 = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""


def _op5_sql() -> str:
    host = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    last = lambda k: f"array_to_string(string_split(host, '.')[-{k}:], '.')"
    listed = f"{last(2)} IN ({', '.join(repr(x) for x in url_filter.SUFFIXES)})"
    domain, suffix = f"CASE WHEN {listed} THEN {last(3)} ELSE {last(2)} END", f"CASE WHEN {listed} THEN {last(2)} ELSE {last(1)} END"
    rules = " UNION ALL ".join(f"SELECT '{h}' AS rhost, '{p}' AS rpath, '{v}' AS v" for h, p, v in url_filter.RULES)

    def strength(groups: str, parent: str) -> str:
        spread = "(S - B * (B / N) - (G - 1) * (B / N * (1 - B / N))) / CASE WHEN N > N2 / N THEN N - N2 / N END"
        fitted = f"CASE WHEN G < 2 THEN 2.0 WHEN {spread} > 0 THEN B / N * (1 - B / N) / ({spread}) - 1 ELSE 200.0 END"
        return (
            f"SELECT {parent}, least(greatest(coalesce({fitted}, 2.0), 2.0), 200.0) AS strength FROM "
            f"(SELECT {parent}, CAST(sum(n) AS DOUBLE) AS N, CAST(sum(bad) AS DOUBLE) AS B, count(*) AS G, CAST(sum(n * n) AS DOUBLE) AS N2, sum(bad * bad / n) AS S FROM {groups} GROUP BY {parent})"
        )

    return f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, {host} AS host, {path} AS path FROM pages),
rules AS ({rules}),
fit AS (SELECT r, max_by(rhost || rpath, len(rhost || rpath)) AS rule, max_by(v, len(rhost || rpath)) AS v
        FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY r),
j AS (SELECT p.*, rule, v FROM p LEFT JOIN fit USING (r)),
labelled AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN v = 'block' THEN 1 ELSE 0 END) AS DOUBLE) AS bad FROM j WHERE rule IS NOT NULL AND host <> '' GROUP BY host),
hosts AS (SELECT *, {domain} AS domain, {suffix} AS suffix, 'all' AS every FROM labelled),
domains AS (SELECT domain, suffix, every, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, every, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
top AS (SELECT sum(bad) / sum(n) AS rate, strength FROM suffixes JOIN ({strength("suffixes", "every")}) USING (every) GROUP BY strength),
sr AS (SELECT suffix, (bad + rate * top.strength) / (n + top.strength) AS rate, k.strength FROM suffixes JOIN ({strength("domains", "suffix")}) k USING (suffix), top),
dr AS (SELECT domain, (d.bad + sr.rate * sr.strength) / (d.n + sr.strength) AS rate, k.strength FROM domains d JOIN sr USING (suffix) JOIN ({strength("hosts", "domain")}) k USING (domain)),
hr AS (SELECT host, (h.bad + dr.rate * dr.strength) / (h.n + dr.strength) AS rate, h.n + dr.strength AS strength FROM hosts h JOIN dr USING (domain)),
u AS (SELECT host, {domain} AS domain, {suffix} AS suffix FROM (SELECT DISTINCT host FROM j WHERE host <> '')),
ur AS (SELECT host, coalesce(hr.rate, dr.rate, sr.rate, top.rate) AS mean, coalesce(hr.strength, dr.strength, sr.strength, top.strength) AS weight
       FROM u LEFT JOIN hr USING (host) LEFT JOIN dr USING (domain) LEFT JOIN sr USING (suffix) LEFT JOIN top ON true)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN ur USING (host)
"""


ORACLES = {"op5_url_filters": _op5_sql(), "op8_decontamination": _OP8, "op10_source_mixing": _OP10, "op11_fill_in_middle": _OP11, "op12_importance_resampling": _OP12, "op13_warc": _OP13}
