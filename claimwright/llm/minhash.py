"""Near-duplicate classes by ProbMinHash signatures, banding and verification.

Texts are sets of five-word shingles weighted by their counts.  Each shingle sends
exponential arrivals (a Poisson process whose rate is its weight) at random slots of a
signature; a slot keeps its earliest arrival, and a shingle stops once its next arrival
comes later than every slot's earliest.  Two signatures agree in a slot with the
probability Jaccard similarity of the two weighted sets.  A text that repeats a shingle has
a second signature with all weights 1, so that agreement there has the probability of plain
Jaccard similarity; both have the same keys, as without repeats they are one.  Signatures
are cut into bands, and texts that agree in a band form a bucket.

Exact copies meet first through a digest of the text, and buckets of the same members count
once.  A bucket's members come to one task with their whole shingle sets, where matrix
products count what every two have in common: every pair is verified, and a member sends
one link to the least of its group, so that links grow with members and not with pairs.
A crowded bucket is dealt in blocks that share some pivots; once that has merged its large
groups, the members outside the largest one meet every block of the others as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwright.llm.scratch import cut
from claimwright.llm.textbytes import Words, mix, shingles, slices, text_buffer

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS = 24
ROWS_PER_BAND = 4
#: Members, and shingles of all members together, that a block of a crowded bucket holds about.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
#: Members that all blocks of a crowded bucket share.
PIVOTS = 8
#: Cells of a matrix of members and shingles in memory at once.
CELLS = 1 << 22
#: Entries of partners that are looked at together.
ENTRIES = 1 << 17
#: Rounding that a bound allows for.
ROUNDING = 1e-4

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def weighted_shingles(words: Words, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, element, weight): the distinct shingles of each document and their counts."""
    doc, value = shingles(words, k)
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (value >> np.uint64(20)))
    if not len(key):
        return np.zeros(0, np.int64), key, np.zeros(0)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    weight = np.diff(np.concatenate([at, [len(key)]])).astype(np.float64)
    return (key[at] >> np.uint64(44)).astype(np.int64), key[at] & np.uint64((1 << 44) - 1), weight


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, slots: int) -> np.ndarray:
    """Signatures [docs, slots] of weighted sets; a document without elements keeps zeros."""
    earliest = np.full((docs, slots), np.inf)
    kept = np.zeros((docs, slots), np.uint32)
    limit = np.full(docs, np.inf)
    flat_time, flat_kept = earliest.reshape(-1), kept.reshape(-1)
    seed, time, scale, arrival = mix(element + np.uint64(1)), np.zeros(len(element)), -1.0 / weight, 0
    while len(doc):
        draw = mix(seed + np.uint64(arrival * int(_GOLD) % (1 << 64)))
        time = time + np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * scale
        on = time < limit[doc]
        doc, seed, time, scale, draw = doc[on], seed[on], time[on], scale[on], draw[on]
        slot = ((draw * np.uint64(0xD1B54A32D192ED03) >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
        cell = doc * slots + slot.astype(np.int64)
        won = np.flatnonzero(time < flat_time[cell])
        if len(won):
            won = won[np.argsort(-time[won], kind="stable")]
            flat_time[cell[won]] = time[won]
            flat_kept[cell[won]] = (seed[won] >> np.uint64(32)).astype(np.uint32)
            touched = np.zeros(docs, bool)
            touched[doc[won]] = True
            limit[touched] = earliest[touched].max(axis=1)
        arrival += 1
    return kept


def jaccards(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """(plain Jaccard, probability Jaccard) of two weighted sets given as (elements, weights)."""
    shared, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0, 0.0
    plain = len(shared) / (len(a[0]) + len(b[0]) - len(shared))
    x, y = a[1][i], b[1][j]
    only_x, only_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    # sum over d' of max(x_d'/x_d, y_d'/y_d): in order of x/y, each shared d' is taken from
    # y up to d's own ratio and from x beyond it
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y = x[order], y[order]
    y_below = np.cumsum(y)
    x_above = x.sum() - np.cumsum(x)
    total = (only_x + x_above) / x + (only_y + y_below) / y
    return plain, float((1.0 / total).sum())


def signatures(docs: DataFrame, bands: int, rows: int, shingle_words: int) -> DataFrame:
    """(doc_id, digest, size, bands): each text's digest, its number of shingles and its distinct band keys (none without words)."""

    def keys(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
        kept = prob_minhash(doc, element, weight, docs, bands * rows).reshape(docs, bands, rows)
        key = np.full((docs, bands), 0, np.uint64)
        for r in range(rows):
            key = mix(key * _GOLD + kept[:, :, r].astype(np.uint64))
        return mix(key + np.arange(bands, dtype=np.uint64)[None, :])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffer(batch.column("text"))
            for start, stop in slices(offsets):
                part = offsets[start : stop + 1]
                words = Words(part - part[0], data[part[0] : part[-1]])
                doc, element, weight = weighted_shingles(words, shingle_words)
                key = keys(doc, element, weight, stop - start)
                plain = key.copy()
                repeats = np.unique(doc[weight > 1])
                if len(repeats):
                    on = np.isin(doc, repeats)
                    plain[repeats] = keys(np.searchsorted(repeats, doc[on]), element[on], np.ones(int(on.sum())), len(repeats))
                some = np.broadcast_to((words.per_doc() > 0)[:, None], key.shape)
                used = np.concatenate([some, some & (plain != key)], axis=1)
                ends = np.concatenate([[0], np.cumsum(used.sum(axis=1))]).astype(np.int32)
                flat = np.concatenate([key, plain], axis=1)[used].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, stop - start),
                        batch.column("digest").slice(start, stop - start),
                        pa.array(np.bincount(doc, minlength=stop - start), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    ],
                    names=["doc_id", "digest", "size", "bands"],
                )

    return docs.mapInArrow(sign, "doc_id long, digest string, size long, bands array<long>")


def shingle_sets(texts: DataFrame, shingle_words: int) -> DataFrame:
    """(node, elements, weights): the set of each text (node, text) as 32-bit hashes, and its counts if any exceeds 1.

    Rows of a task that repeat a node and its text are combined.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            offsets, data = text_buffer(batch.column("text"))
            nodes = batch.column("node").to_pylist()
            for start, stop in slices(offsets):
                part = offsets[start : stop + 1]
                doc, element, weight = weighted_shingles(Words(part - part[0], data[part[0] : part[-1]]), shingle_words)
                cuts = np.searchsorted(doc, np.arange(stop - start + 1)).tolist()
                found: list[tuple] = []
                for node, a, b in zip(nodes[start:stop], cuts[:-1], cuts[1:], strict=True):
                    mark = (node, int(element[a:b].sum())) if b > a else None
                    if mark and mark not in seen:
                        seen.add(mark)
                        counts = weight[a:b].astype(np.uint32).tobytes() if (weight[a:b] > 1).any() else b""
                        found.append((node, (element[a:b] >> np.uint64(12)).astype(np.uint32).tobytes(), counts))
                columns = list(zip(*found, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], names=["node", "elements", "weights"]
                )

    return texts.select("node", "text").mapInArrow(pack, "node long, elements binary, weights binary")


def _spread(linked: np.ndarray) -> np.ndarray:
    """The least member that each one reaches over links [n, n]."""
    n, label = len(linked), np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def groups_of(sets: list[np.ndarray], weights: list[np.ndarray | None], similarity: float) -> np.ndarray:
    """The least member of each one's group: all pairs whose plain or probability Jaccard reaches `similarity` are linked.

    Products of the matrix of members and the shingles that several have give the numbers
    that every two have in common.  Where neither repeats a shingle both similarities are
    one.  Else equal samples of the two are at most as probable as either one's share of
    shingles in common; pairs that this bound leaves, and no other link has joined, are
    looked at member by member, all partners of a member at once.
    """
    n, size = len(sets), np.array([len(x) for x in sets])
    element, own = np.concatenate(sets), np.repeat(np.arange(n, dtype=np.int32), size)
    order = np.argsort(element, kind="stable")
    element, own = element[order], own[order]
    column = np.cumsum(np.concatenate([[False], element[1:] != element[:-1]]), dtype=np.int32)
    several = np.bincount(column) > 1
    on = several[column]
    column, own, order = (np.cumsum(several, dtype=np.int32) - 1)[column[on]], own[on], order[on]
    heavy = np.array([w is not None for w in weights])
    if heavy.any():
        share = np.concatenate([np.full(len(x), 1.0 / len(x)) if w is None else w / w.sum() for x, w in zip(sets, weights, strict=True)])[order]
    common, mass = np.zeros((n, n)), np.zeros((n, n))
    wide = max(64, CELLS // n)
    for first in range(0, int(several.sum()), wide):
        a, b = np.searchsorted(column, (first, first + wide))
        has = np.zeros((n, min(wide, int(column[b - 1]) - first + 1)), np.float32)
        has[own[a:b], column[a:b] - first] = 1
        common += has @ has.T
        if heavy.any():
            part = np.zeros_like(has)
            part[own[a:b], column[a:b] - first] = share[a:b]
            mass += part @ has.T
    linked = common / (size[:, None] + size[None, :] - common) >= similarity
    linked[np.diag_indices(n)] = True
    label = _spread(linked)
    if heavy.any():
        bound = np.minimum(mass, mass.T)
        open_ = (bound >= similarity - ROUNDING) & (label[:, None] != label[None, :]) & (heavy[:, None] | heavy[None, :])
        if open_.any():
            by_member = np.argsort(order)
            label = _joined(open_, label, np.searchsorted(own[by_member], np.arange(n + 1)), column[by_member], share[by_member], similarity)
    return label


def _joined(open_: np.ndarray, label: np.ndarray, ends: np.ndarray, column: np.ndarray, share: np.ndarray, similarity: float) -> np.ndarray:
    """`label` after linking the open pairs whose probability Jaccard reaches `similarity`.

    ends, column, share: each member's entries, its shingles' shares of its own weight.
    With s, the sum of the lesser shares of two members, the similarity is at most s and
    at least s / (2 - s); only pairs between the two need its own sum, which goes through
    the shared shingles in order of the ratio of their shares.
    """
    mine = np.zeros(int(column.max()) + 1 if len(column) else 1)
    for i in range(len(label)):
        partners = np.flatnonzero(open_[i, i + 1 :] & (label[i + 1 :] != label[i])) + i + 1
        if not len(partners):
            continue
        own = column[ends[i] : ends[i + 1]]
        mine[own] = share[ends[i] : ends[i + 1]]
        sums = np.cumsum(ends[partners + 1] - ends[partners])
        for some in np.split(partners, np.flatnonzero(np.diff(sums // ENTRIES)) + 1):
            linked = some[_alike(mine, some, ends, column, share, similarity)]
            if len(linked):
                met = np.unique(np.append(label[linked], label[i]))
                label[np.isin(label, met)] = met[0]
        mine[own] = 0
    return label


def _alike(mine: np.ndarray, partners: np.ndarray, ends: np.ndarray, column: np.ndarray, share: np.ndarray, similarity: float) -> np.ndarray:
    """Whether each partner is as similar to the member whose shares `mine` has."""
    counts = ends[partners + 1] - ends[partners]
    at = np.repeat(ends[partners] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    which, x, y = np.repeat(np.arange(len(partners)), counts), mine[column[at]], share[at]
    both = x > 0
    which, x, y = which[both], x[both], y[both]
    least = np.bincount(which, np.minimum(x, y), len(partners))
    linked = least / (2 - least) >= similarity
    unsure = ~linked & (least >= similarity - 1e-12)
    if unsure.any():
        on = unsure[which]
        which, x, y = which[on], x[on], y[on]
        order = np.lexsort((x / y, which))
        which, x, y = which[order], x[order], y[order]
        heads = np.searchsorted(which, np.arange(len(partners) + 1))
        sums_x, sums_y = (np.concatenate([[0.0], np.cumsum(v)]) for v in (x, y))
        # of the member's shares what comes behind in order or isn't shared, of the partner's what comes up to here or isn't shared
        x_beyond = 1 - (sums_x[1:] - sums_x[heads[which]])
        y_up_to = 1 - (sums_y[heads[which + 1]] - sums_y[1:])
        linked |= unsure & (np.bincount(which, 1 / (x_beyond / x + y_up_to / y), len(partners)) >= similarity - 1e-12)
    return linked


def _met(dealt: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) among the members (key, i, j, node) of each (key, i, j): each linked member with the least node of its group."""
    shape = ["key", "i", "j"]

    def meet(rows: list[tuple]) -> pa.RecordBatch:
        rows = sorted({(r[3], r[4], r[5]) for r in rows})
        found: list[tuple] = []
        if len(rows) > 1:
            sets = [np.frombuffer(r[1], np.uint32) for r in rows]
            weights = [np.frombuffer(r[2], np.uint32).astype(np.float64) if r[2] else None for r in rows]
            found = [(rows[g][0], r[0]) for g, r in zip(groups_of(sets, weights, similarity).tolist(), rows, strict=True) if rows[g][0] != r[0]]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if held and held[-1][:3] != row[:3]:
                    yield meet(held)
                    held = []
                held.append(row)
        if held:
            yield meet(held)

    rows = dealt.join(sets, "node").select(*shape, "node", "elements", "weights")
    return rows.repartition(*shape).sortWithinPartitions(*shape).mapInArrow(stream, "a long, b long").distinct()


def _settled(df: DataFrame, schema: str) -> DataFrame:
    """`df` cut, without the constraints that the optimizer inferred, which otherwise multiply round by round."""
    return cut(df.mapInArrow(lambda batches: batches, schema))


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node that each linked node reaches, by label spreading and pointer jumps."""
    edges = cut(links.union(links.select("b", "a")).toDF("src", "dst").distinct())
    labels = cut(edges.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("node")).alias("label")))
    while True:
        heard = edges.join(labels, edges.src == labels.node).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("heard"))
        spread = labels.join(heard, "node", "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("heard", "label")).alias("label"))
        head = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = spread.join(head, "label", "left").select("node", "was", F.least("label", F.coalesce("further", "label")).alias("label"))
        jumped = _settled(jumped, "node long, was long, label long")
        changed = jumped.filter("label <> was").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels


def _buckets(members: DataFrame, block: int) -> DataFrame:
    """(key, node, size, blocks): the members of buckets of more than one, each set of members once, and the blocks it needs."""
    shared = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    found = cut(members.join(shared, "key"))
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"m{k}") for k in (1, 2)]
    kept = found.groupBy("key").agg(*marks, F.count("*").alias("n"), F.sum("size").alias("all")).groupBy("m1", "m2", "n", "all").agg(F.min("key").alias("key"))
    return cut(found.join(kept.select("key", _blocks("n", "all", block).alias("blocks")), "key"))


def _blocks(n: str, shingles: str, block: int) -> Column:
    return F.ceil(F.greatest(F.col(n) / block, F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def _block_of(blocks: str) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(7)), F.col(blocks)).cast("int")


def _first_meeting(buckets: DataFrame) -> DataFrame:
    """(key, i, j, node): each member in one block of its bucket, and the pivots of a crowded bucket in all of its blocks."""
    once = buckets.select("key", _block_of("blocks").alias("i"), _block_of("blocks").alias("j"), "node")
    least = [F.min(F.struct(F.xxhash64("node", F.lit(100 + p)).alias("h"), "node")).alias(f"p{p}") for p in range(PIVOTS)]
    heads = buckets.filter("blocks > 1").groupBy("key", "blocks").agg(*least)
    pivots = heads.select("key", "blocks", F.explode(F.array(*[F.col(f"p{p}.node") for p in range(PIVOTS)])).alias("node"))
    spread = pivots.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), "node")
    return once.union(spread.select("key", "i", F.col("i").alias("j"), "node"))


def _second_meeting(buckets: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """(key, i, j, node): in crowded buckets of several classes, the blocks of all but the largest class with every block.

    Members of the largest class are never dealt to meet each other: they are linked.
    """
    crowded = buckets.filter("blocks > 1").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = crowded.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("size").alias("all"))
    split = classes.groupBy("key").agg(F.max(F.struct("n", "all", "label")).alias("major"), F.sum("n").alias("n"), F.sum("all").alias("all"), F.count("*").alias("classes"))
    split = split.filter("classes > 1").select("key", F.col("major.label").alias("major"), (F.col("n") - F.col("major.n")).alias("n0"), (F.col("all") - F.col("major.all")).alias("all0"), F.col("major.n").alias("n1"), F.col("major.all").alias("all1"))
    split = split.select("key", "major", _blocks("n0", "all0", block).alias("minors"), _blocks("n1", "all1", block).alias("majors"))
    placed = crowded.join(split, "key").withColumn("minor", F.col("label") != F.col("major"))
    placed = placed.withColumn("mine", F.when(F.col("minor"), _block_of("minors")).otherwise(F.col("minors") + _block_of("majors")))
    last = F.when(F.col("minor"), F.col("minors") + F.col("majors")).otherwise(F.col("minors")) - 1
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return placed.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node")


def _node(doc_id: str, digest: str) -> Column:
    """A document's number; a row without doc_id gets one of its text, above all real ones."""
    return F.coalesce(F.col(doc_id), F.xxhash64(digest).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62))


def near_duplicate_classes(
    documents: DataFrame,
    similarity: float = SIMILARITY,
    shingle_words: int = SHINGLE_WORDS,
    bands: int = BANDS,
    rows: int = ROWS_PER_BAND,
    block: int = BLOCK,
) -> DataFrame:
    """doc_id, class_id, copies: the class of every row of `documents` and how many rows share its exact text.

    documents: doc_id, text; other columns are ignored.  class_id is the least doc_id of
    the class.  Equal texts (a null text is an empty one) are always one class; texts that
    share a band and whose five-word shingle sets reach `similarity`, by plain or by
    probability Jaccard, are linked and classes are the connected components.  A text of
    one to four words is one shingle; a text without a word is only like its exact copies.
    Texts given under one doc_id share a class; a null doc_id takes part and comes back
    null.  Order and `block` don't change the result.  An empty table gives an empty result.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    docs = docs.withColumn("digest", F.md5("text"))
    signed = signatures(docs, bands, rows, shingle_words)
    groups = cut(
        signed.groupBy("digest")
        .agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
        .select("digest", _node("least", "digest").alias("node"), "copies", "size", "bands")
    )
    buckets = _buckets(groups.select("node", "size", F.explode("bands").alias("key")), block)
    sets = shingle_sets(docs.select(_node("doc_id", "digest").alias("node"), "text"), shingle_words)
    links = cut(_met(_first_meeting(buckets), sets, similarity))
    labels = components(links)
    if buckets.filter("blocks > 1").limit(1).count():
        more = cut(_met(_second_meeting(buckets, labels, block), sets, similarity))
        labels = components(links.union(more).distinct())
    found = groups.join(labels, "node", "left").select("digest", "copies", F.coalesce("label", "node").alias("class_id"))
    return docs.select("doc_id", "digest").join(found, "digest").select("doc_id", "class_id", "copies")


def deduplicate(documents: DataFrame, **options) -> DataFrame:
    """`documents` with one row per near-duplicate class, all columns kept: the row whose doc_id is the class id.

    Of repeated rows with that doc_id one stays; rows without doc_id stay only if no
    row of their class has one, and then one of them.
    """
    kept = near_duplicate_classes(documents, **options).select(F.col("class_id").alias("_kept_node")).distinct()
    rows = documents.withColumn("_kept_digest", F.md5(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("_kept_node", _node("doc_id", "_kept_digest"))
    return rows.join(kept, "_kept_node", "left_semi").dropDuplicates(["_kept_node"]).select(*documents.columns)
