"""Joins of name keys that resemble or contain each other, without meeting all pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimwright.functions.names import jaccard, trigrams
from claimwright.plans.registry import CANDIDATE_TRIGRAM
from claimwright.sources.lineage import cut


def similarity_join(left: DataFrame, right: DataFrame, least: float = CANDIDATE_TRIGRAM) -> DataFrame:
    """(l, r, score) of all distinct keys with trigram Jaccard of `least` or more; exact, without a cross join.

    left has column l, right column r.  Two sets of such similarity share a trigram among
    the first n - ceil(least * n) + 1 of each in a common order; in the order of rarity
    these few are the rare ones, so frequent trigrams, which many keys share, seldom join.
    """
    sets_l = left.filter("l <> ''").select("l").distinct().withColumn("tl", trigrams("l"))
    sets_r = right.filter("r <> ''").select("r").distinct().withColumn("tr", trigrams("r"))
    grams = sets_l.select(F.explode("tl").alias("g")).union(sets_r.select(F.explode("tr").alias("g"))).groupBy("g").agg(F.count("*").alias("n"))

    def prefixes(sets: DataFrame, key: str, grams_of: str) -> DataFrame:
        ranked = sets.select(key, F.explode(grams_of).alias("g")).join(grams, "g")
        ordered = ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "g"))), lambda x: x["g"]).alias("o"))
        keep = F.size("o") - F.ceil(F.lit(least) * F.size("o") - 1e-9).cast("int") + 1
        return ordered.select(key, F.explode(F.slice("o", F.lit(1), keep)).alias("g"))

    pairs = prefixes(sets_l, "l", "tl").join(prefixes(sets_r, "r", "tr"), "g").select("l", "r").distinct()
    scored = pairs.join(sets_l, "l").join(sets_r, "r").withColumn("score", jaccard(F.col("tl"), F.col("tr")))
    return scored.filter(F.col("score") >= least).select("l", "r", "score")


#: Entries of a place, their characters there, and the queries that one task asks of it.
ENTRIES_PER_PLACE = 1 << 15
CHARACTERS_PER_PLACE = 1 << 23
QUERIES_PER_PLACE = 1 << 12
#: Frequent trigrams that may mark a class, the most classes, and the least entries that one should have.
MARKS = (8, 16, 32, 64, 96, 128, 192, 256)
MOST_CLASSES, LEAST_ENTRIES = 1024, 256
#: So many pairs are counted without classes.
FEW_PAIRS = 1 << 28


def _codes(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code, owner) of the distinct trigrams of each key, by owner; a trigram's code holds its three code points."""
    sizes = np.fromiter(map(len, keys), np.int64, len(keys)) + 1
    points = np.frombuffer("".join(f"  {k} " for k in keys).encode("utf-32-le"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(keys)), sizes)
    at = np.arange(len(owner)) + 2 * owner
    code = points[at] << 42 | points[at + 1] << 21 | points[at + 2]
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    fresh = np.r_[True, (np.diff(code) != 0) | (np.diff(owner) != 0)][: len(code)]
    return code[fresh], owner[fresh]


def _marked(rows: DataFrame, key: str, grams: list[str]) -> DataFrame:
    """Rows with size (the number of the key's trigrams) and hits (the places in `grams` of those that are there, ascending)."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "size int", "hits array<int>"])
    codes = np.array([ord(a) << 42 | ord(b) << 21 | ord(c) for a, b, c in grams], np.int64)
    by_code = np.argsort(codes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, owner = _codes(batch.column(key).to_pylist())
            size = np.bincount(owner, minlength=len(batch))
            hit = np.isin(code, codes)
            mark, owner = by_code[np.searchsorted(codes, code[hit], sorter=by_code)], owner[hit]
            mark = mark[np.lexsort((mark, owner))]
            ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(batch)))]
            hits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(mark, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size, pa.int32()), hits], names=[*batch.schema.names, "size", "hits"])

    return rows.mapInArrow(work, schema)


def _needed(bound, size, shared, common, smallest):  # noqa: ANN001, ANN202  of arrays and of numbers
    """The further trigrams that a query of `size`, `shared` of them common to all entries, must share with an entry for a score of `bound`.

    An entry has the common ones and those shared, and no fewer than the smallest.
    """
    return np.ceil(np.maximum(bound * (size + smallest) / (1 + bound), bound * (size + common - shared)) - shared - 1e-9)


def _nearest(entries: pa.Table, asked: pa.Table, top: int) -> pa.Table:
    """(l, g, group, item_id, norm_match, score): of each query the first `top` items among the entries of a place that reach its bound.

    Trigrams that all entries have are counted once a query.  Of the others a query's
    shortest lists give it a first bound; an entry that is in none of as many lists as the
    bound leaves over can't reach it, so the longest lists are not read.
    """
    keys, names, bounds = entries.column("r").to_pylist(), asked.column("l").to_pylist(), asked.column("bound").to_numpy()
    item = pc.rank(entries.column("item_id").combine_chunks(), tiebreaker="dense", null_placement="at_start").to_numpy().astype(np.int64)
    most = top * int(np.bincount(item).max()) if keys else 0  # so many entries are of `top` items
    code, owner = _codes(keys)
    held, gram, count = np.unique(code, return_inverse=True, return_counts=True)
    sizes = np.bincount(owner, minlength=len(keys))
    everywhere = count == len(keys)
    number = np.cumsum(~everywhere) - 1
    rare = ~everywhere[gram]
    gram, owner = number[gram[rare]], owner[rare]
    ends = np.r_[0, np.cumsum(count[~everywhere])]
    lists = owner[np.argsort(gram, kind="stable")]
    own = np.bincount(owner, minlength=len(keys))
    wide = np.full((len(keys), int(own.max(initial=0))), len(ends) - 1, np.int32)  # the last is of none
    wide[owner, np.arange(len(owner)) - np.repeat(np.cumsum(own) - own, own)] = gram

    code, owner = _codes(names)
    size = np.bincount(owner, minlength=len(names))
    at = np.minimum(np.searchsorted(held, code), max(len(held) - 1, 0))
    met = held[at] == code if len(held) else np.zeros(len(code), bool)
    shared = np.bincount(owner[met & everywhere[at]], minlength=len(names))
    at, owner = at[met], owner[met]
    at, owner = at[~everywhere[at]], owner[~everywhere[at]]
    at, owner = (x[np.lexsort((count[at], owner))] for x in (at, owner))
    grams, has = number[at], np.bincount(owner, minlength=len(names))
    last = np.cumsum(has)
    common, smallest = int(everywhere.sum()), int(sizes.min(initial=0))

    flags, seen, out = np.zeros(len(ends), np.uint8), np.zeros(len(keys), bool), []

    def among(which: np.ndarray) -> np.ndarray:
        seen[:] = False
        for k in which:
            seen[lists[ends[k] : ends[k + 1]]] = True
        return np.flatnonzero(seen)

    for q in np.flatnonzero((_needed(bounds, size, shared, common, smallest) <= has) & (len(keys) > 0)):
        mine, bound = grams[last[q] - has[q] : last[q]], bounds[q]
        flags[mine] = 1

        def scored(found: np.ndarray) -> np.ndarray:
            both = shared[q] + flags[wide[found]].sum(axis=1, dtype=np.int64)  # noqa: B023
            return both / (size[q] + sizes[found] - both)  # noqa: B023

        found = among(mine[:2])
        score = scored(found)
        if len(found) >= most:
            bound = max(bound, np.partition(score, -most)[-most])
        need = int(_needed(bound, size[q], shared[q], common, smallest))
        if need <= 0:
            found = np.arange(len(keys))
            score = scored(found)
        elif has[q] - need + 1 > 2:
            found = among(mine[: has[q] - need + 1])
            score = scored(found)
        flags[mine] = 0
        if len(found) >= most:
            bound = max(bound, np.partition(score, -most)[-most])
        found, score = found[score >= bound], score[score >= bound]
        same = np.array([s == 1 and keys[k] == names[q] for k, s in zip(found, score, strict=True)], bool)
        order = np.lexsort((item[found], -score, ~same))
        best = np.sort(np.unique(item[found][order], return_index=True)[1])[:top]
        order = order[best]
        out.append((np.full(len(order), q), found[order], same[order], score[order]))
    query, entry, same, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool), np.zeros(0))
    query, entry = pa.array(query), pa.array(entry)
    columns = [asked.column("l").take(query), asked.column("g").take(query), entries.column("group").take(entry), entries.column("item_id").take(entry), pa.array(same), pa.array(score)]
    return pa.Table.from_arrays(columns, names=["l", "g", "group", "item_id", "norm_match", "score"])


def similar_top(queries: DataFrame, items: DataFrame, top: int, least: float) -> DataFrame:
    """(l, group, item_id, norm_match, score): per key l and group every item that may be among the `top` most similar ones of `least` or more; exact.

    queries: l; items: group, item_id, r, where an item may have several keys and counts
    by its best.  Equal keys go first, then the score, then the id.  Names that are alike
    by the thousand make as many pairs, so pairs are not rows here.  Entries are dealt in
    classes of those frequent trigrams that they have.  A query is first asked of a place
    of the class most like it; the score of its last one there is the bound that another
    class must be able to reach to be asked, by what both have of the frequent ones.
    """
    spark = items.sparkSession
    asked = cut(queries.filter("l <> ''").select("l").distinct())
    # of the items of one key only the first ones can be wanted
    place = F.row_number().over(Window.partitionBy("group", "r").orderBy("item_id"))
    known = cut(items.filter("r <> ''").select("group", "item_id", "r").distinct().withColumn("_n", place).filter(F.col("_n") <= top).drop("_n"))
    number, characters = known.agg(F.count("*"), F.coalesce(F.sum(F.length("r")), F.lit(0))).first()
    asking = asked.count()
    if asking * number <= FEW_PAIRS:
        return _of_few(asked, asking, known, max(1, -(-number // ENTRIES_PER_PLACE), -(-characters // CHARACTERS_PER_PLACE)), top, least)
    grams = known.select("r").distinct().select(F.explode(trigrams("r")).alias("g")).groupBy("g").count()
    grams = [r.g for r in grams.orderBy(F.desc("count"), "g").limit(MARKS[-1]).collect()]
    spread = spark.sparkContext.defaultParallelism  # few bytes are much work here
    asked, known = cut(_marked(asked.repartition(spread), "l", grams)), cut(_marked(known.repartition(spread), "r", grams))
    scale = lambda key: F.floor(F.log2(F.length(key) + 1)).cast("int")
    asked, known = asked.withColumn("scale", scale("l")), known.withColumn("scale", scale("r"))
    marks = _marks(asked, known, max(1, min(MOST_CLASSES, number // LEAST_ENTRIES)))
    asked, known = (d.withColumn("pattern", F.filter("hits", lambda x: x < marks)).drop("hits") for d in (asked, known))

    classes = known.groupBy("group", "pattern", "scale").agg(F.count("*").alias("n"), F.sum(F.length("r")).alias("characters"), F.min("size").alias("low"), F.max("size").alias("high")).collect()
    patterns = asked.groupBy("pattern", "scale").agg(F.max("size").alias("high")).collect()
    chunks = [max(-(-r.n // ENTRIES_PER_PLACE), -(-r.characters // CHARACTERS_PER_PLACE)) for r in classes]
    pairs = spark.createDataFrame(_pairs(patterns, classes, chunks, least))
    kind = known.schema["group"].dataType.simpleString()
    listed = spark.createDataFrame([(r.group, r.pattern, r.scale, c, chunks[c]) for c, r in enumerate(classes)], f"_group {kind}, pattern array<int>, scale int, c int, chunks int")
    known = known.join(F.broadcast(listed), ["pattern", "scale"]).filter(F.col("group").eqNullSafe(F.col("_group")))
    known = known.select("c", F.pmod(F.xxhash64("r"), "chunks").cast("int").alias("chunk"), "group", "item_id", "r")
    listed = spark.createDataFrame([(r.pattern, r.scale, p, len(r.pattern)) for p, r in enumerate(patterns)], "pattern array<int>, scale int, p int, marked int")
    asked = asked.join(F.broadcast(listed), ["pattern", "scale"]).select("l", "size", "p", "marked")

    at_home = F.pmod(F.xxhash64("l"), "chunks").cast("int")
    first = cut(_asked_of(asked.join(F.broadcast(pairs.filter("home")), "p").select("l", "g", "c", at_home.alias("chunk"), F.lit(least).alias("bound")), known, top))
    bounds = first.groupBy("l", "g").agg(F.min("score").alias("score"), F.count("*").alias("n")).filter(F.col("n") == top)
    bounds = bounds.groupBy("l").agg(F.map_from_entries(F.collect_list(F.struct("g", "score"))).alias("bounds"))
    met = asked.join(bounds, "l", "left").join(F.broadcast(pairs), "p")
    met = met.withColumn("bound", F.coalesce(F.col("bounds")[F.col("g")], F.lit(least)))
    both = F.col("both") + F.least(F.col("size") - F.col("marked"), F.col("high") - F.col("common"))
    reached = both / (F.col("size") + F.greatest("low", F.col("common") + both - F.col("both")) - both)
    met = met.filter(reached >= F.col("bound") - 1e-9).filter(~F.col("home") | (F.col("chunks") > 1))
    further = met.select("l", "g", "c", "bound", F.when(F.col("home"), at_home).alias("done"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).filter("done IS NULL OR chunk <> done").drop("done")
    return first.union(_asked_of(further, known, top)).drop("g")


def _of_few(asked: DataFrame, asking: int, known: DataFrame, chunks: int, top: int, least: float) -> DataFrame:
    """What `similar_top` gives, every query asked of every chunk: a step without classes, which costs more than it saves where pairs are few."""
    blocks = max(1, -(-4 * asking // QUERIES_PER_PLACE))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    entries = known.withColumn("chunk", F.pmod(F.xxhash64("r"), F.lit(chunks)).cast("int")).withColumn("block", numbers(blocks))
    asked = asked.select("l", F.lit(0).alias("g"), F.lit(least).alias("bound"), F.pmod(F.hash("l"), F.lit(blocks)).alias("block")).withColumn("chunk", numbers(chunks))

    def work(entries: pa.Table, asked: pa.Table) -> pa.Table:
        # a type and length at a time: rows of trigrams are as wide as the longest
        kind = pc.rank(entries.column("group").combine_chunks(), tiebreaker="dense", null_placement="at_start").to_numpy().astype(np.int64)
        kind = kind << 6 | np.log2(pc.utf8_length(entries.column("r")).to_numpy() + 1).astype(np.int64)
        return pa.concat_tables([_nearest(entries.filter(pa.array(kind == k)), asked, top) for k in np.unique(kind)] or [_nearest(entries, asked, top)])

    return _cogrouped(entries, asked, ["chunk", "block"], work).drop("g")


def _marks(asked: DataFrame, known: DataFrame, most: int) -> int:
    """How many of the frequent trigrams mark classes, so that there are at most about `most` on either side."""
    counts = [
        d.agg(*[F.approx_count_distinct(F.xxhash64(*more, "scale", F.filter("hits", lambda x: x < m))).alias(str(m)) for m in MARKS]).first()  # noqa: B023
        for d, more in ((asked, ()), (known, ("group",)))
    ]
    return max((m for k, m in enumerate(MARKS) if max(c[k] for c in counts) <= most), default=0)


def _pairs(patterns: list, classes: list, chunks: list[int], least: float) -> pa.Table:
    """(p, c, g, both, common, low, high, chunks, home): patterns of queries and classes of entries that may reach `least`, with the marks that both have.

    A pattern has one home a group: the class of most like marks and length, of the largest ones the first.
    """
    groups = {x: k for k, x in enumerate(dict.fromkeys(r.group for r in classes))}
    g = np.array([groups[r.group] for r in classes])

    def bits(rows: list) -> np.ndarray:
        out = np.zeros((len(rows), MARKS[-1]), np.float32)
        for k, r in enumerate(rows):
            out[k, r.pattern] = 1
        return out

    both = (bits(patterns) @ bits(classes).T).astype(np.int64)
    marked, common = (np.array([len(r.pattern) for r in rows]) for rows in (patterns, classes))
    n, low, high = (np.array([r[x] for r in classes]) for x in ("n", "low", "high"))
    like = both / np.maximum(marked[:, None] + common - both, 1)
    apart = np.abs(np.array([r.scale for r in patterns])[:, None] - np.array([r.scale for r in classes]))
    home = np.zeros(both.shape, bool)
    for p in range(len(patterns)):
        order = np.lexsort((-n, apart[p], -like[p], g))
        home[p, order[np.r_[True, np.diff(g[order]) != 0]]] = True
    most = np.array([r.high for r in patterns])[:, None]
    shared = both + np.minimum(most - marked[:, None], high - common)
    kept = home | (shared >= least * np.maximum(low, common + shared - both))
    p, c = np.nonzero(kept)
    columns = {"p": p, "c": c, "g": g[c], "both": both[p, c], "common": common[c], "low": low[c], "high": high[c], "chunks": np.array(chunks)[c]}
    return pa.table({k: pa.array(v, pa.int32()) for k, v in columns.items()} | {"home": pa.array(home[p, c])})


def _asked_of(ship: DataFrame, known: DataFrame, top: int) -> DataFrame:
    """What `_nearest` finds for queries (l, g, c, chunk, bound) among the entries (c, chunk, group, item_id, r) of their chunk, in tasks of bounded size."""
    spark, ship = known.sparkSession, cut(ship)
    counts = ship.groupBy("c", "chunk").count().collect()
    blocks = [-(-r["count"] // QUERIES_PER_PLACE) for r in counts]
    starts = np.cumsum([0, *blocks]).tolist()
    places = F.broadcast(spark.createDataFrame([(r.c, r.chunk, s, b) for r, s, b in zip(counts, starts, blocks)], "c int, chunk int, start int, blocks int"))  # noqa: B905
    entries = known.join(places, ["c", "chunk"]).select(F.explode(F.sequence("start", F.col("start") + F.col("blocks") - 1)).alias("place"), "group", "item_id", "r")
    asked = ship.join(places, ["c", "chunk"]).select((F.col("start") + F.pmod(F.hash("l"), "blocks")).alias("place"), "l", "g", "bound")
    return _cogrouped(entries, asked, ["place"], lambda e, a: _nearest(e, a, top))


def _cogrouped(entries: DataFrame, asked: DataFrame, keys: list[str], work: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    kinds = [entries.schema[n].dataType.simpleString() for n in ("group", "item_id")]
    tasks = 4 * entries.sparkSession.sparkContext.defaultParallelism  # few bytes are much work here
    left, right = (d.repartition(tasks, *keys).groupBy(*keys) for d in (entries, asked))
    return left.cogroup(right).applyInArrow(work, f"l string, g int, group {kinds[0]}, item_id {kinds[1]}, norm_match boolean, score double")


def _inner(key: str) -> Column:
    """The distinct trigrams within a key."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(key) - 2), lambda i: F.substr(key, i, F.lit(3))))


def containment_join(whole: DataFrame, part: DataFrame) -> DataFrame:
    """(l, r) of all distinct keys where l contains r; exact, without a cross join for r of three characters or more.

    whole has column l, part column r.  A key that holds another holds its trigrams, so
    each r meets the keys with that trigram of it which the fewest of them have.  Shorter
    ones are few, at most all texts of one or two characters: their pieces of l meet them.
    """
    sets_l, sets_r = whole.filter("l <> ''").select("l").distinct(), part.filter("r <> ''").select("r").distinct()
    pieces = sets_l.filter(F.length("l") >= 3).select("l", F.explode(_inner("l")).alias("g"))
    counts = pieces.groupBy("g").agg(F.count("*").alias("n"))
    grams = sets_r.filter(F.length("r") >= 3).select("r", F.explode(_inner("r")).alias("g")).join(counts, "g", "left")
    # a trigram that no l has proves that none contains r
    rarest = grams.groupBy("r").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("m")).filter("m.n > 0").select("r", F.col("m.g").alias("g"))
    found = pieces.join(rarest, "g").filter(F.contains("l", "r")).select("l", "r")
    for size in (1, 2):
        short = sets_l.filter(F.length("l") >= size).select("l", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("l") - (size - 1)), lambda i: F.substr("l", i, F.lit(size))))).alias("r"))  # noqa: B023
        found = found.union(short.join(sets_r.filter(F.length("r") == size), "r").select("l", "r"))
    return found
