"""Benchmark decontamination with suffix arrays over the training texts.

Each partition's documents are laid end to end in shards and every shard gets a suffix
array over its words.  Every test suffix is binary-searched in every shard: the range of
training suffixes that start with its window gives all verbatim occurrences and their
places, and the search goes on word by word to the longest match.  Only words inside an
occurrence of a whole window count as hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwright.llm.textbytes import Words, slices, text_buffer

WINDOW_WORDS = 13
#: A document is contaminated when at least one word in so many is hit.
HIT_ONE_IN = 20
#: Bytes of text in a shard.
SHARD_BYTES = 1 << 20
#: Test words searched for at once; a larger benchmark is searched in blocks of so many.
TEST_WORDS_PER_BLOCK = 2_000_000

_FIELDS = {
    "doc_id": "long", "n_words": "long", "n_hit": "long", "items": "array<long>", "longest": "long",
    "hits": "array<struct<start: long, end: long>>", "places": "array<struct<item_id: long, start: long, words: long>>",
}
RESULT = ", ".join(f"{name} {kind}" for name, kind in _FIELDS.items())
_SCHEMA = pa.schema(
    [("digest", pa.string())]
    + [(x, pa.int64()) for x in ("doc_id", "n_words", "n_hit")]
    + [("items", pa.list_(pa.int64())), ("longest", pa.int64())]
    + [("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    + [("places", pa.list_(pa.struct([(x, pa.int64()) for x in ("item_id", "start", "words")])))]
)


def suffix_array(words: np.ndarray, doc: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, text): suffixes of the shard sorted by at least `depth` words, and the shard's words.

    Documents end in sentinels that equal no word and no other sentinel, so no match
    crosses a document.  Sorting doubles the compared prefix each time and re-sorts only
    suffixes that still tie.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    value = words[order]
    head = np.concatenate([[True], value[1:] != value[:-1]]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    compared = 1
    while compared < depth:
        tied = ~head
        tied[:-1] |= ~head[1:]
        places = np.flatnonzero(tied)
        if not len(places):
            break
        suffix = order[places]
        after = suffix + compared
        inside = after < n
        inside[inside] = doc[after[inside]] == doc[suffix[inside]]
        # a suffix that ends here comes first, in the order of its place: all such differ
        follow = np.where(inside, rank[np.minimum(after, n - 1)] + n, suffix)
        again = np.lexsort((follow, rank[suffix]))
        suffix, follow = suffix[again], follow[again]
        own = rank[suffix]
        order[places] = suffix
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (follow[1:] != follow[:-1])])
        head[places] = new
        rank[suffix] = places[np.flatnonzero(new)[np.cumsum(new) - 1]]
        compared *= 2
    return order, words


class TestSuffixes:
    """Every suffix of the test items that starts a window."""

    __test__ = False

    def __init__(self, item: np.ndarray, words: np.ndarray, item_doc: np.ndarray, window: int):
        counts = np.bincount(item_doc, minlength=len(item)) if len(item_doc) else np.zeros(len(item), int)
        ends = np.cumsum(counts)
        at = np.arange(len(words))
        left = ends[item_doc] - at if len(words) else at
        length = np.minimum(counts[item_doc], window) if len(words) else at
        starts = np.flatnonzero(left >= length)
        self.words, self.start, self.length, self.left = words, starts, length[starts], left[starts]
        self.row = item_doc[starts] if len(starts) else np.zeros(0, np.int64)
        self.item = item[self.row] if len(starts) else np.zeros(0, np.int64)


def search(order: np.ndarray, text: np.ndarray, doc: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(test, low, high): the tests whose window occurs and their ranges in the suffix array."""
    n = len(order)
    live = np.arange(len(tests.start))
    low, high = np.zeros(len(live), np.int64), np.full(len(live), n, np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    depth = 0
    while len(live) and n:
        whole = tests.length[live] == depth
        if whole.any():
            found.append((live[whole], low[whole], high[whole]))
            live, low, high = live[~whole], low[~whole], high[~whole]
            continue
        target = tests.words[tests.start[live] + depth]

        def bound(right: bool) -> np.ndarray:
            lo, hi = low.copy(), high.copy()
            while True:
                open_ = lo < hi
                if not open_.any():
                    return lo
                mid = (lo + hi) >> 1
                suffix = order[np.minimum(mid, n - 1)]
                at = suffix + depth
                inside = at < n
                inside[inside] = doc[at[inside]] == doc[suffix[inside]]
                word = text[np.minimum(at, n - 1)]
                less = ~inside | (word < target) | (right & (word == target))
                lo = np.where(open_ & less, mid + 1, lo)
                hi = np.where(open_ & ~less, mid, hi)

        low, high = bound(False), bound(True)
        on = low < high
        live, low, high = live[on], low[on], high[on]
        depth += 1
    if not found:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def occurrences(words: Words, window: int, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """(test, place): every occurrence of a test window and its first word's place in the shard."""
    order, text = suffix_array(words.hash, words.doc, window)
    test, low, high = search(order, text, words.doc, tests)
    times = high - low
    which = np.repeat(np.arange(len(test)), times)
    slot = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + low[which]
    return test[which], order[slot]


def longest_matches(words: Words, tests: TestSuffixes, test: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(test, place, words) of the occurrences that no match to their left runs into, grown to the right word by word."""
    n = len(words.hash)
    key = test.astype(np.int64) * (n + 1) + place
    before = np.maximum(test - 1, 0)
    linked = (test > 0) & (place > 0) & (tests.start[before] + 1 == tests.start[test]) & (tests.row[before] == tests.row[test])
    linked[linked] = words.doc[place[linked] - 1] == words.doc[place[linked]]
    first = ~(linked & np.isin(key - (n + 1) - 1, key))
    test, place = test[first], place[first]
    length = tests.length[test].astype(np.int64)
    growing = np.arange(len(place))
    while len(growing):
        p, t, reach = place[growing], test[growing], length[growing]
        at, source = p + reach, tests.start[t] + reach
        on = (at < n) & (reach < tests.left[t])
        on[on] = (words.doc[at[on]] == words.doc[p[on]]) & (words.hash[at[on]] == tests.words[source[on]])
        growing = growing[on]
        length[growing] += 1
    return test, place, length


def _benchmark_words(benchmark: DataFrame) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffer(batch.column("text"))
            words = Words(offsets, data)
            ends = np.concatenate([[0], np.cumsum(words.per_doc())])
            packed = [words.hash[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array(packed, pa.binary()), pa.array(words.per_doc().astype(np.int64))], names=["item_id", "words", "n"]
            )

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    return items.mapInArrow(read, "item_id long, words binary, n long").filter("n > 0")


def _gathered(items: DataFrame, window: int) -> TestSuffixes:
    rows = items.select("item_id", "words").collect()
    lists = [np.frombuffer(r.words, np.uint64) for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(x) for x in lists])
    words = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
    return TestSuffixes(np.array([r.item_id for r in rows], np.int64), words, row, window)


def _searched(docs: DataFrame, tests: TestSuffixes, window: int) -> DataFrame:
    """digest and RESULT of every row of docs (digest, doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(tests)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = held.value
        for batch in batches:
            offsets, data = text_buffer(batch.column("text"))
            for start, stop in slices(offsets, SHARD_BYTES):
                part = offsets[start : stop + 1]
                words = Words(part - part[0], data[part[0] : part[-1]])
                keys = [batch.column(x).slice(start, stop - start).to_pylist() for x in ("digest", "doc_id")]
                rows = _judged(words, tests, window, keys[1])
                yield pa.RecordBatch.from_pylist([{"digest": d} | r for d, r in zip(keys[0], rows, strict=True)], schema=_SCHEMA)

    return docs.select("digest", "doc_id", "text").mapInArrow(scan, f"digest string, {RESULT}")


def _judged(words: Words, tests: TestSuffixes, window: int, ids: list) -> list[dict]:
    counts = words.per_doc()
    rows = [{"doc_id": i, "n_words": int(n), "n_hit": 0, "items": [], "longest": 0, "hits": [], "places": []} for i, n in zip(ids, counts, strict=True)]
    test, place = occurrences(words, window, tests)
    if not len(test):
        return rows
    heads = np.cumsum(counts) - counts
    edge = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + tests.length[test], -1)
    hit = np.cumsum(edge[:-1]) > 0
    turn = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    # a run of hit words that goes over into the next document is cut there
    cut_at = heads[(heads > 0) & (heads < len(hit))]
    cut_at = np.unique(cut_at[hit[cut_at] & hit[cut_at - 1]])
    begins = np.sort(np.concatenate([np.flatnonzero(turn == 1), cut_at]))
    ends = np.sort(np.concatenate([np.flatnonzero(turn == -1), cut_at]))
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        d = int(words.doc[a])
        rows[d]["hits"].append({"start": a - int(heads[d]), "end": b - int(heads[d])})
        rows[d]["n_hit"] += b - a
    for d, item in np.unique(np.stack([words.doc[place], tests.item[test]]), axis=1).T.tolist():
        rows[d]["items"].append(item)
    for t, p, n in zip(*(x.tolist() for x in longest_matches(words, tests, test, place)), strict=True):
        d = int(words.doc[p])
        rows[d]["places"].append({"item_id": int(tests.item[t]), "start": p - int(heads[d]), "words": n})
        rows[d]["longest"] = max(rows[d]["longest"], n)
    return rows


def contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, test_words_per_block: int = TEST_WORDS_PER_BLOCK
) -> DataFrame:
    """Per row of `documents`: doc_id, n_words, n_hit, items (ids with occurring windows), longest, hits, places.

    documents: doc_id, text; benchmark: item_id, text; other columns are ignored.  A
    window is `window` consecutive words of an item; an item of fewer words, but not
    none, is one window.  `hits` are the runs of hit words [start, end), `places` the
    maximal verbatim matches (item, first word in the document, words).  A null or
    wordless text has no words and no hits; an item without text, words or item_id has
    no windows; repeated rows are each answered.

    The benchmark is gathered as 64-bit words.  Up to `test_words_per_block` words one
    search does.  A larger benchmark is searched in blocks of about so many (or of one
    item, if that has more); what is found depends on the text alone, so the blocks'
    findings are merged by digest of the text and every row gets those of its text.
    Either way gives the same rows.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("digest", F.md5("text"))
    blocks = _blocks(benchmark, test_words_per_block)
    if len(blocks) == 1:
        return _searched(docs, _gathered(blocks[0], window), window).drop("digest")
    none = TestSuffixes(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), window)
    every = _searched(docs, none, window).select("digest", "doc_id", "n_words")
    merged = every.join(_merged(docs, blocks, window), "digest", "left")
    empty = {name: (F.lit(0) if kind == "long" else F.array()).cast(kind) for name, kind in _FIELDS.items()}
    return merged.select("doc_id", "n_words", *[F.coalesce(x, empty[x]).alias(x) for x in _FIELDS if x not in every.columns])


def _blocks(benchmark: DataFrame, most: int) -> list[DataFrame]:
    """The benchmark's items (item_id, words, n), equal ones once, in blocks of about `most` words."""
    items = _benchmark_words(benchmark).distinct()
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // most))
    return [items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == k) for k in range(blocks)]


def _merged(docs: DataFrame, blocks: list[DataFrame], window: int) -> DataFrame:
    """digest, n_hit, items, longest, hits, places of every text that any block hits."""
    found = None
    for block in blocks:
        # equal texts count once in each block, so a digest has a row a block at most
        part = _searched(docs, _gathered(block, window), window).filter("n_hit > 0").drop("doc_id").dropDuplicates(["digest"])
        found = part if found is None else found.union(part)
    merged = found.groupBy("digest").agg(
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.max("longest").alias("longest"),
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("runs"),
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
    )
    # runs in order of their start; one that begins within or at the end of the last grows it
    grown = lambda last, x: F.struct(last.start.alias("start"), F.greatest(last.end, x.end).alias("end"))
    none = F.array().cast("array<struct<start: long, end: long>>")
    hits = F.aggregate(
        "runs", none,
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1).end >= x.start), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown(F.element_at(done, -1), x)))).otherwise(F.concat(done, F.array(x))),
    )
    merged = merged.withColumn("hits", hits).withColumn("n_hit", F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x.end - x.start))
    return merged.select("digest", "n_hit", "items", "longest", "hits", "places")


def is_contaminated(n_words: str = "n_words", n_hit: str = "n_hit", one_in: int = HIT_ONE_IN) -> Column:
    return (F.col(n_hit) > 0) & (F.col(n_hit) * one_in >= F.col(n_words))


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, test_words_per_block: int = TEST_WORDS_PER_BLOCK) -> DataFrame:
    """`documents` without the rows that are contaminated, all columns kept; a document without words stays.

    Rows are judged by their texts alone, so doc_ids may repeat or be null.  With a
    benchmark of one block they are judged where they stand, with more by digest of the
    text; either way gives the same rows.
    """
    blocks = _blocks(benchmark, test_words_per_block)
    if len(blocks) > 1:
        docs = documents.select(F.lit(None).cast("long").alias("doc_id"), "text").withColumn("digest", F.md5("text"))
        none = TestSuffixes(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), window)
        words = _searched(docs, none, window).select("digest", "n_words").distinct()
        bad = words.join(_merged(docs, blocks, window), "digest").filter(is_contaminated()).select(F.col("digest").alias("_bad_digest"))
        return documents.join(bad, F.md5(documents["text"]) == F.col("_bad_digest"), "left_anti").select(*documents.columns)
    held = documents.sparkSession.sparkContext.broadcast(_gathered(blocks[0], window))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffer(batch.column("text"))
            for start, stop in slices(offsets, SHARD_BYTES):
                part = offsets[start : stop + 1]
                rows = _judged(Words(part - part[0], data[part[0] : part[-1]]), held.value, window, [None] * (stop - start))
                clean = [not (r["n_hit"] and r["n_hit"] * HIT_ONE_IN >= r["n_words"]) for r in rows]
                yield batch.slice(start, stop - start).filter(pa.array(clean))

    return documents.mapInArrow(keep, documents.schema)
