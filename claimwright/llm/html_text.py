"""Main text of web pages by nearest-URL page differencing.

A page is cut into text lines (blocks), each with the zone its markup puts it in: the
article, chrome (menus, footers, adverts, forms, comments) or neither.  Pages of a host
stand in order of path; each is paired with the neighbour whose path shares the longer
prefix with its own, the lines of both are aligned by longest common subsequence and the
shared lines are deleted.  An article's own lines survive sharing, since copies of an
article on one host are articles still; chrome goes even where it is not shared.  So the
alignment decides the lines that markup doesn't settle, beside an article or without one;
a page without such lines goes its way without a partner.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimwright.llm.scratch import cut
from claimwright.llm.url_filter import host_of, path_of

NEUTRAL, ARTICLE, CHROME = range(3)

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_SPECIAL = re.compile(r"[>\"']")
_OPEN_END = re.compile(r"<(?=[a-zA-Z/!?]|\n?\Z)")
_NAMES = re.compile(r"(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_ROLE = re.compile(r"role\s*=\s*[\"']?(navigation|banner|contentinfo|complementary|search|form|alert|dialog|menu|menubar|main|article)", re.IGNORECASE)
_HIDDEN = re.compile(r"\shidden(?:\s|=|/|$)|display\s*:\s*none", re.IGNORECASE)

#: Elements whose content is never text of the page, and elements that stand in no block of their own.
_RAW = {name: re.compile(rf"</{name}\b", re.IGNORECASE) for name in ("script", "style")}
_SKIPPED = frozenset("head noscript template svg math iframe object canvas audio video select textarea button dialog".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_CHROME_TAGS = frozenset("nav header footer aside form menu".split())
_CHROME_NAMES = frozenset(
    "ad ads advert advertisement adsense sponsor sponsored promo banner cookie cookies consent gdpr notice alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar comment comments disqus replies share sharing social "
    "related recommended newsletter subscribe signup login pagination pager".split()
)
_ARTICLE_TAGS = frozenset(("article", "main"))


def _zone(tag: str, attributes: str, around: int) -> int:
    """The zone of an element, given that of the element around it; chrome holds all within."""
    if around == CHROME or tag in _SKIPPED:
        return CHROME
    if tag in _CHROME_TAGS and not (tag == "header" and around == ARTICLE):
        return CHROME
    if attributes.strip(" /"):
        names = {p.lower() for m in _NAMES.finditer(attributes) for p in re.split(r"[\s_-]+", m[1] or m[2] or m[3] or "")}
        role = _ROLE.search(attributes)
        if names & _CHROME_NAMES or _HIDDEN.search(attributes) or role and role[1].lower() not in ("main", "article"):
            return CHROME
        if role:
            return ARTICLE
    return ARTICLE if tag in _ARTICLE_TAGS else around


class _Tags:
    """The tags of a page in order, each part of the text looked at a bounded number of times whatever is left open."""

    def __init__(self, html: str):
        self.html = html
        self.last = html.rfind(">")
        self.special = self.greater = -1
        self.failed: set[int] = set()

    def _end(self, at: int) -> int:
        """Behind the > that ends a tag whose name ends at `at`: the first outside quotes, else the first of all; -1 if none.

        A quote from which no end was found once is known to lead to none.
        """
        if at > self.last:
            return -1
        if self.special < at:
            self.special = _SPECIAL.search(self.html, at).start()
        place, passed = self.special, []
        while self.html[place] != ">":
            closing = -1 if place in self.failed else self.html.find(self.html[place], place + 1)
            passed.append(place)
            behind = _SPECIAL.search(self.html, closing + 1) if closing >= 0 else None
            if behind is None:
                self.failed.update(passed)
                if self.greater < at:
                    self.greater = self.html.find(">", at)
                return self.greater + 1
            place = behind.start()
        return place + 1

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, name, whether it closes, attributes); comments and declarations have no name."""
        html, at = self.html, 0
        while (start := html.find("<", at)) >= 0:
            at = start + 1
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                at = end + 3 if end >= 0 else len(html)
                yield start, at, "", False, ""
            elif html[start + 1 : start + 2] in ("!", "?"):
                if start < self.last:
                    at = html.index(">", start) + 1
                    yield start, at, "", False, ""
            else:
                closes = html.startswith("/", start + 1)
                name = _NAME.match(html, start + 1 + closes)
                if name and (end := self._end(name.end())) > 0:
                    tag = name[0].lower()
                    at = end
                    if tag in _RAW and not closes:
                        closing = _RAW[tag].search(html, end)
                        at = html.index(">", closing.end()) + 1 if closing and closing.end() <= self.last else len(html)
                    yield start, at, tag, closes, html[name.end() : end - 1]


def lines_of(html: str) -> list[tuple[str, int]]:
    """(text, zone) of every non-empty block of a page in order, references decoded, white space made single.

    Takes time in proportion to the page, also where tags, quotes or elements stay open.
    """
    out: list[tuple[str, int]] = []
    pieces: list[str] = []
    stack: list[tuple[str, int]] = []
    opened: Counter = Counter()
    zone = NEUTRAL

    def close() -> None:
        text = " ".join(unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            out.append((text, zone))

    def leave() -> str:
        name, _ = stack.pop()
        opened[name] -= 1
        return name

    place, tags = 0, _Tags(html)
    for start, end, tag, ends, attributes in tags:
        pieces.append(html[place:start])
        place = end
        if not tag:
            continue
        if tag in _VOID:
            if tag in _INLINE:
                pieces.append(" " if tag == "br" else "")
            else:
                close()
            continue
        if tag in _INLINE and not ends and _zone(tag, attributes, zone) == zone:
            continue
        if ends:
            if opened[tag]:
                close()
                while leave() != tag:
                    pass
                zone = stack[-1][1] if stack else NEUTRAL
            elif tag not in _INLINE:
                close()
            continue
        if tag in _RAW:
            continue
        close()
        if stack and (stack[-1][0] == "p" and tag not in _INLINE or stack[-1][0] == tag == "li"):
            leave()
            zone = stack[-1][1] if stack else NEUTRAL
        zone = _zone(tag, attributes, zone)
        stack.append((tag, zone))
        opened[tag] += 1
    # a tag that the page's end cuts off is no text
    cut_off = _OPEN_END.search(html, max(place, tags.last + 1))
    pieces.append(html[place : cut_off.start() if cut_off else len(html)])
    close()
    return out


#: Cells of the alignment's table held at once; larger alignments are halved first.
_TABLE = 1 << 28


def shared_lines(mine: list[int], other: list[int]) -> list[int]:
    """Places in `mine` that a longest common subsequence with `other` takes, in bounded memory.

    A row of the table is one whole number of a bit per line of `mine`, so that a row
    costs a few operations on it however often lines repeat.
    """
    head, end = 0, min(len(mine), len(other))
    while head < end and mine[head] == other[head]:
        head += 1
    tail = 0
    while tail < end - head and mine[-1 - tail] == other[-1 - tail]:
        tail += 1
    inner = _common(mine[head : len(mine) - tail], other[head : len(other) - tail])
    return [*range(head), *(head + k for k in inner), *range(len(mine) - tail, len(mine))]


def _rows(mine: list[int], other: list[int]) -> Iterator[int]:
    """After each line of `other`: a number whose bit k is 0 where line k of `mine` makes the common subsequence longer."""
    every, places = (1 << len(mine)) - 1, defaultdict(int)
    for k, line in enumerate(mine):
        places[line] |= 1 << k
    row = every
    for line in other:
        hits = row & places.get(line, 0)
        row = ((row + hits) | (row - hits)) & every
        yield row


def _lengths(mine: list[int], other: list[int]) -> np.ndarray:
    """The longest common subsequence of each beginning of `mine` with all of `other`."""
    row = (1 << len(mine)) - 1
    for row in _rows(mine, other):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(mine) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(mine)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def _common(mine: list[int], other: list[int]) -> list[int]:
    if not mine or not other:
        return []
    if len(mine) * len(other) > _TABLE and len(other) > 1:
        half = len(other) // 2
        first, second = _lengths(mine, other[:half]), _lengths(mine[::-1], other[half:][::-1])[::-1]
        at = int(np.argmax(first + second))
        return [*_common(mine[:at], other[:half]), *(at + k for k in _common(mine[at:], other[half:]))]
    rows, found, k, j = list(_rows(mine, other)), [], len(mine) - 1, len(other) - 1
    while k >= 0 and j >= 0:
        if rows[j] >> k & 1:  # line k makes nothing longer
            k -= 1
        elif j and not rows[j - 1] >> k & 1:  # nor does line j of the other need it
            j -= 1
        else:
            found.append(k)
            k, j = k - 1, j - 1
    return found[::-1]


def main_text(lines: list[tuple[str, int]], shared: set[int]) -> str:
    """The lines that stay, joined: all of an article, none of chrome, and of others those that are not shared."""
    return "\n".join(text for k, (text, zone) in enumerate(lines) if zone == ARTICLE or zone == NEUTRAL and k not in shared)


def _common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def _line_hash(text: str) -> int:
    data = text.encode("utf-8", "surrogatepass")
    return (zlib.crc32(data) << 31) ^ zlib.adler32(data) ^ len(data)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's lines, hashed for the alignment and compressed; whether any is open, i.e. not settled by its markup."""
    for batch in batches:
        for first in range(0, len(batch), 128):
            part = batch.slice(first, 128)
            pages = [lines_of(h) if h else [] for h in part.column("html").to_pylist()]
            hashes = [[_line_hash(text) for text, _ in lines] for lines in pages]
            packed = [zlib.compress("\n".join(f"{zone}{text}" for text, zone in lines).encode("utf-8", "surrogatepass"), 6) for lines in pages]
            open_ = [any(zone == NEUTRAL for _, zone in lines) for lines in pages]
            names = ["row", "page_id", "url", "host", "path"]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(x) for x in names), pa.array(hashes, pa.list_(pa.int64())), pa.array(open_, pa.bool_()), pa.array(packed, pa.binary())], names=[*names, "lines", "open", "packed"]
            )


def _shared_with_nearest(page: dict, before: dict | None, after: dict | None) -> list[int]:
    fit = [x for x in (before, after) if x and page["open"] and page["host"] and x["host"] == page["host"] and x["page_id"] != page["page_id"]]
    best = max(fit, key=lambda x: _common_prefix(x["path"], page["path"]), default=None)
    return shared_lines(page["lines"], best["lines"]) if best else []


def _aligned(pages: DataFrame) -> DataFrame:
    """(row, shared): the places of each page's lines that it shares with its partner.

    Pages are sorted by (host, path, page_id) in ranges.  Neighbours within a range are
    aligned as the range streams by; the first and last page of a range meet theirs
    through a join of the ranges' ends by place in the whole order.
    """
    order = ["host", "path", "page_id", "row"]
    sorted_ = cut(pages.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for first in range(0, len(batch), 256):
                held += batch.slice(first, 256).to_pylist()
                inner = range(1, len(held) - 1)
                found = [_shared_with_nearest(held[k], held[k - 1], held[k + 1]) for k in inner]
                yield pa.RecordBatch.from_arrays([pa.array([held[k]["row"] for k in inner], pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["row", "shared"])
                held = held[-2:]

    inside = sorted_.drop("id").mapInArrow(stream, "row long, shared array<int>")
    placed = sorted_.withColumn("part", F.shiftrightunsigned("id", 33).cast("int")).withColumn("seq", F.col("id").bitwiseAND((1 << 33) - 1))
    counts = sorted((r[0], r[1]) for r in placed.groupBy("part").count().collect())
    starts = np.concatenate([[0], np.cumsum([n for _, n in counts])]).tolist()
    ranges = [(part, int(start), n) for (part, n), start in zip(counts, starts, strict=False)]
    offsets = pages.sparkSession.createDataFrame(ranges, "part int, start long, n long")
    ends = placed.join(F.broadcast(offsets), "part").filter("seq <= 1 OR seq >= n - 2").withColumn("rank", F.col("start") + F.col("seq"))
    side = lambda name, step: ends.select((F.col("rank") + step).alias("rank"), F.struct("page_id", "host", "path", "lines").alias(name))
    edges = ends.filter("seq = 0 OR seq = n - 1").join(side("before", 1), "rank", "left").join(side("after", -1), "rank", "left")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = [_shared_with_nearest(r, r["before"], r["after"]) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["row"] for r in rows], pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["row", "shared"])

    at_ends = edges.select("row", "page_id", "host", "path", "lines", "open", "before", "after").mapInArrow(meet, "row long, shared array<int>")
    return inside.union(at_ends)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages`; html is read whole.

    pages: page_id, url, html; other columns are ignored.  Null or empty html gives an
    empty text and is no partner of another page.  Of the pages before and after in order
    of path that one is the partner whose path shares the longer prefix, the one before
    if both do.  A page without a host, or alone on it, has no partner and loses only
    chrome.  Rows that share page_id are never partners of each other; equal rows are
    each answered alike.  An empty table gives an empty result.
    """
    named = pages.select("page_id", "url", host_of().alias("host"), path_of().alias("path"), "html")
    named = named.withColumn("row", F.xxhash64("page_id", "url", "html"))
    parsed = cut(named.mapInArrow(_parsed, "row long, page_id long, url string, host string, path string, lines array<long>, open boolean, packed binary"))
    shared = _aligned(parsed.select("row", "page_id", "host", "path", "lines", "open").filter(F.size("lines") > 0).dropDuplicates(["row"]))
    settled = parsed.filter(~F.col("open")).select("page_id", "url", "packed", F.lit(None).cast("array<int>").alias("shared"))
    opened = parsed.filter("open").select("row", "page_id", "url", "packed").join(shared, "row", "left").select("page_id", "url", "packed", "shared")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, len(batch), 128):
                part = batch.slice(row, 128)
                texts = []
                for packed, common in zip(part.column("packed").to_pylist(), part.column("shared").to_pylist(), strict=True):
                    rows = zlib.decompress(packed).decode("utf-8", "surrogatepass")
                    lines = [(x[1:], int(x[0])) for x in rows.split("\n")] if rows else []
                    texts.append(main_text(lines, set(common or ())))
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return settled.union(opened).mapInArrow(finish, "page_id long, url string, text string, n_chars long")
