"""Main text of web pages: nearest-URL differencing, with the page's structure as its guard.

A page becomes lines, one per block element, and structure gives each a role:

* KEEP: inside the mark of the article (article, main);
* OPEN: not settled by structure, which is a page's text where no article is
  marked, and blocks inside an article whose class speaks of sharing or related
  pages;
* OUT: inside elements that never hold the article (menus, headers and footers
  of the page, asides, forms, notices, adverts, reader comments), and whatever
  stands outside the mark.

Differencing runs on every page.  The pages of a host are ordered by (path, key),
each is paired with the page before or after it whose path shares the longer
prefix, and the lines of both are aligned by longest common subsequence.  Shared
lines are deleted unless they are KEEP.  A neighbour that shares nearly all of
what structure would leave of a page (COPY of its characters) is a copy and tells
nothing: the other neighbour is taken, and where both are copies no line is
deleted.  Of the lines that are not shared, structure leaves out those that are OUT.

Lines travel as 64-bit digests with role and size.  The order is a range
partition over (host, path, key, digest), so no host and no path is gathered in
one task.  The first and last row of each partition meet their other neighbour
in a join over these edges alone; so where partitions end doesn't matter.  Then
each page meets the numbers of its deleted lines and is read again.

Defined cases: null or empty html gives ""; null and malformed urls are a host of
their own; pages alone on their host are not differenced; rows equal in key, url
and html are one page and have equal results; null page ids pass through, last
in their path.  A tag that is never closed ends at its first >, or is dropped
with what follows.  Time grows with the length of a page, and with the product
of line numbers / 64 where two pages repeat the same lines very often.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wordloom.plans.names import fresh
from wordloom.plans.staging import Workspace

KEEP, OPEN, OUT = 0, 1, 2
#: Share of the characters of a page's KEEP and OPEN lines from which on a neighbour is a copy of it.
COPY = 0.8
#: Pairs of equal lines up to which an alignment is found directly.
MATCHES = 1 << 20

# Element names and words of classes.
MUTE = frozenset("head script style noscript template svg iframe object title textarea".split())
ASIDE = frozenset("nav header footer aside button select menu dialog".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose id names a part of the page and not a place to jump to.
PARTS = frozenset("div section ul ol table".split())
_EDGE = (r"(?:^|[\s_-])(?:", r")(?:$|[\s_-])")
ASIDE_WORDS = re.compile(r"ads?|advert\w*|sponsor\w*|promo\w*|menu|nav\w*|breadcrumb\w*|sidebar|cookie\w*|consent|notice|popup|modal|newsletter|subscribe|comments?|replies|respond|contentinfo|complementary".join(_EDGE), re.IGNORECASE)
#: Words that speak of an aside outside the article, and of a block to be differenced inside.
LOOSE_WORDS = re.compile(r"banner|side|footer|header|share|sharing|social|related".join(_EDGE), re.IGNORECASE)

_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?/][^>]*>", re.DOTALL)
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>", re.DOTALL)
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_SPACE = re.compile(r"\s+")


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it closes, attributes) of tags; comments and declarations have no name.

    The text of raw elements is no place for tags, so the search goes on behind it.
    """
    at, tag = 0, _TAG
    while (at := page.find("<", at)) >= 0:
        after = page[at + 1 : at + 3]
        if after[:1].isalpha() and after[:1].isascii() or after[:1] == "/" and after[1:].isalpha() and after.isascii():
            m = tag.match(page, at)
            if m is None and tag is _TAG:
                tag = _PLAIN_TAG  # a quote is open to the end
                m = tag.match(page, at)
            if m is None:
                yield at, len(page), "", False, ""
                return
            name = m[2].lower()
            yield at, m.end(), name, bool(m[1]), m[3]
            at = m.end()
            if name in RAW and not m[1]:
                end = re.compile(rf"</{name}\b", re.IGNORECASE).search(page, at)
                at = end.start() if end else len(page)
        elif after[:1] in ("!", "?", "/") and (m := _COMMENT.match(page, at)):
            yield at, m.end(), "", False, ""
            at = m.end()
        else:
            at += 1


def _words(attributes: str, name: str) -> str:
    found = ((k.lower(), a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes))
    return " ".join(v for k, v in found if k != "id" or name in PARTS)


def _parsed(page: str, use_classes: bool) -> tuple[bool, bool, list[tuple[int, str]]]:
    """Whether the page marks its article, whether a class word hid anything, and its lines with their roles."""
    free = 3
    lines: list[tuple[int, str, int]] = []
    text: list[str] = []
    beside: list[str] = []
    stack: list[tuple[str, str]] = []
    held: Counter[str] = Counter()
    is_open: Counter[str] = Counter()
    forms: list[bool] = []
    marked = hid = False
    form = -1

    def close(buffer: list[str], role: int) -> None:
        line = _SPACE.sub(" ", "".join(buffer)).strip()
        buffer.clear()
        if line:
            lines.append((role, line, form))

    def end_line() -> None:
        if held["out"]:
            close(beside, OUT)
        else:
            close(text, free if not held["in"] else OPEN if held["loose"] else KEEP)

    def leave(name: str, kind: str) -> None:
        nonlocal form
        is_open[name] -= 1
        held[kind] -= 1
        if kind == "out" and not held["out"]:
            close(beside, OUT)
        elif kind == "form":
            form = -1

    def say(piece: str) -> None:
        if piece and not held["mute"]:
            (beside if held["out"] else text).append(_html.unescape(piece))

    at = 0
    for start, end, name, closes, attributes in _tags(page):
        say(page[at:start])
        at = end
        if not name:
            continue
        if name in BLOCKS and not held["mute"]:
            end_line()
        if closes:
            if is_open[name]:
                while True:
                    top, kind = stack.pop()
                    leave(top, kind)
                    if top == name:
                        break
            continue
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        if name in ("p", "li", "td", "th", "tr", "option") and stack and stack[-1][0] == name:
            leave(*stack.pop())
        kind = ""
        words = _words(attributes, name) if attributes and use_classes and name not in ("html", "body", "article", "main") else ""
        if name in MUTE:
            kind = "mute"
        elif name in ASIDE and not (held["in"] and name == "header"):
            kind = "out"
        elif words and (ASIDE_WORDS.search(words) or not held["in"] and LOOSE_WORDS.search(words)):
            kind, hid = "out", True
        elif name == "form" and form < 0:
            kind, form = "form", len(forms)
            forms.append(False)
        elif words and name in BLOCKS and LOOSE_WORDS.search(words):
            kind = "loose"
        elif name in ("article", "main") and not held["out"] and not held["mute"]:
            kind, marked = "in", True
        if form >= 0 and name in ("article", "main", "h1"):
            forms[form] = True  # the form is the page's frame
        stack.append((name, kind))
        held[kind] += 1
        is_open[name] += 1
    say(page[at:])
    end_line()
    close(text, free if not held["in"] else KEEP)
    rest = OUT if marked else OPEN
    return marked, hid, [(OUT if f >= 0 and not forms[f] else rest if role == free else role, line) for role, line, f in lines]


def page_lines(page: str | None) -> tuple[bool, list[tuple[int, str]]]:
    """Whether the page marks its article, and its lines with their roles.

    A page whose class words would leave nothing of it is read without them.
    """
    if not page:
        return False, []
    marked, hid, lines = _parsed(page, True)
    if hid and not any(role != OUT for role, _ in lines):
        marked, _, lines = _parsed(page, False)
    return marked, lines


def blocks(page: str | None) -> tuple[bool, list[str]]:
    """Whether the page marks its article, and the lines that structure alone would leave."""
    marked, lines = page_lines(page)
    return marked, [line for role, line in lines if role != OUT]


def _sparse(left: list, right: list) -> list[int]:
    """Positions in ``left`` of a longest common subsequence (Hunt-Szymanski)."""
    where: dict[object, list[int]] = {}
    for j, line in enumerate(right):
        where.setdefault(line, []).append(j)
    ends: list[int] = []
    chain: list[tuple | None] = []
    for i, line in enumerate(left):
        for j in reversed(where.get(line, ())):
            k = bisect_left(ends, j)
            node = (i, chain[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chain.append(node)
            else:
                ends[k], chain[k] = j, node
    found, node = [], chain[-1] if chain else None
    while node:
        found.append(node[0])
        node = node[1]
    return found


def _lengths(left: list, right: list) -> np.ndarray:
    """Length of a longest common subsequence of ``left`` with each prefix of ``right``, by bit vectors."""
    masks: dict[object, int] = {}
    for j, line in enumerate(right):
        masks[line] = masks.get(line, 0) | 1 << j
    full = (1 << len(right)) - 1
    v = full
    for line in left:
        u = v & masks.get(line, 0)
        v = (v + u | v - u) & full
    bits = np.unpackbits(np.frombuffer((full ^ v).to_bytes(len(right) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(right)]
    return np.concatenate(([0], np.cumsum(bits)))


def shared_lines(left: list, right: list) -> set[int]:
    """Positions in ``left`` of a longest common subsequence of lines.

    Where lines repeat so often that their pairs can't be listed, ``left`` is
    halved and ``right`` cut where both halves align best (Hirschberg).
    """
    found: set[int] = set()
    work = [(0, len(left), 0, len(right))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and left[a] == right[c]:
            found.add(a)
            a, c = a + 1, c + 1
        while a < b and c < d and left[b - 1] == right[d - 1]:
            found.add(b - 1)
            b, d = b - 1, d - 1
        if a == b or c == d:
            continue
        mine, other = left[a:b], right[c:d]
        times = Counter(other)
        if b - a == 1 or sum(times[x] for x in mine) <= MATCHES:
            found.update(a + i for i in _sparse(mine, other))
            continue
        half = len(mine) // 2
        best = int((_lengths(mine[:half], other) + _lengths(mine[half:][::-1], other[::-1])[::-1]).argmax())
        work += [(a, a + half, c, c + best), (a + half, b, c + best, d)]
    return found


def _prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def _gone(page: dict, before: dict | None, after: dict | None) -> list[int]:
    """Numbers of the lines of a page that differencing deletes.

    The neighbour with the longer common prefix counts, the one before if both
    are as near; copies of the page are passed over.
    """
    near = sorted((x for x in (before, after) if x is not None), key=lambda x: -_prefix(page["path"], x["path"]))
    left = [0 if role == OUT else size for role, size in zip(page["roles"], page["sizes"], strict=True)]
    for other in near:
        shared = shared_lines(page["codes"], other["codes"])
        if sum(left[i] for i in shared) < COPY * sum(left):
            return sorted(i for i in shared if page["roles"][i] != KEEP)
    return []


_PAGE = "struct<host: string, path: string, codes: array<long>, roles: binary, sizes: array<int>>"
_PAGE_TYPE = pa.struct([("host", pa.string()), ("path", pa.string()), ("codes", pa.list_(pa.int64())), ("roles", pa.binary()), ("sizes", pa.list_(pa.int32()))])
_FIELDS = [f.name for f in _PAGE_TYPE]


def _outlines(pages: DataFrame, work: Workspace, key: str, mark: str) -> DataFrame:
    """Rows (key, mark, host, path, codes, roles, sizes) of the different pages."""
    import xxhash

    kind = pages.schema[key].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_lines(x.as_py())[1] for x in batch["html"]]
            codes = [[xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63) for _, line in page] for page in found]
            roles = pa.array([bytes(role for role, _ in page) for page in found], pa.binary())
            sizes = pa.array([[len(line) for _, line in page] for page in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch[key], batch[mark], batch["host"], batch["path"], pa.array(codes, pa.list_(pa.int64())), roles, sizes], [key, mark, *_FIELDS])

    host = F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))
    read = pages.select(key, mark, host.alias("host"), path.alias("path"), "html")
    return work.write(read.mapInArrow(parse, f"`{key}` {kind}, `{mark}` long, {_PAGE[7:-1]}"), "outlines").dropDuplicates([key, mark])


def _deleted(outlines: DataFrame, work: Workspace, key: str, mark: str) -> DataFrame:
    """Rows (key, mark, gone) of the pages that lose lines by differencing."""
    kind, key_type = outlines.schema[key].dataType.simpleString(), to_arrow_type(outlines.schema[key].dataType)
    typed = pa.schema([(key, key_type), (mark, pa.int64()), ("gone", pa.list_(pa.int32())), ("first", pa.bool_()), ("last", pa.bool_()), ("page", _PAGE_TYPE), ("inner", _PAGE_TYPE)])
    page = lambda r: {k: r[k] for k in _FIELDS}
    beside = lambda r, o: o if o is not None and o["host"] == r["host"] else None

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(before: dict | None, row: dict, after: dict | None) -> list[dict]:
            ids = {key: row[key], mark: row[mark], "first": before is None, "last": after is None}
            if before is None or after is None:
                inner = beside(row, before or after)
                return [ids | {"gone": None, "page": page(row), "inner": inner and page(inner)}]
            gone = _gone(row, beside(row, before), beside(row, after))
            return [ids | {"gone": gone, "page": None, "inner": None}] if gone else []

        before = row = None
        for batch in batches:
            out = []
            for after in batch.to_pylist():
                if row is not None:
                    out += emit(before, row, after)
                before, row = row, after
            if out:
                yield pa.RecordBatch.from_pylist(out, typed)
        if row is not None:
            yield pa.RecordBatch.from_pylist(emit(before, row, None), typed)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = []
            for r in batch.to_pylist():
                own, inner = r["page"], r["inner"]
                gone.append(_gone(own, beside(own, r["before"]) if r["first"] else inner, beside(own, r["after"]) if r["last"] else inner))
            yield pa.RecordBatch.from_arrays([batch[key], batch[mark], pa.array(gone, pa.list_(pa.int32()))], [key, mark, "gone"])

    order = [F.col("host"), F.col("path"), F.col(f"`{key}`").asc_nulls_last(), F.col(mark)]
    ordered = outlines.repartitionByRange(*order).sortWithinPartitions(*order)
    walked = ordered.mapInArrow(walk, f"`{key}` {kind}, `{mark}` long, gone array<int>, first boolean, last boolean, page {_PAGE}, inner {_PAGE}")
    walked = work.write(walked.withColumn("part", F.spark_partition_id()), "walked")
    edges = walked.where("first or last")
    parts = sorted(r.part for r in edges.select("part").distinct().collect())  # one row per partition
    places = edges.sparkSession.createDataFrame(list(zip(parts, range(len(parts)), strict=True)), "part int, place int")
    edges = edges.join(F.broadcast(places), "part")
    before = edges.where("last").select((F.col("place") + 1).alias("place"), F.col("page").alias("before"))
    after = edges.where("first").select((F.col("place") - 1).alias("place"), F.col("page").alias("after"))
    met = edges.join(before, "place", "left").join(after, "place", "left").select(key, mark, "first", "last", "page", "inner", "before", "after")
    closed = met.mapInArrow(meet, f"`{key}` {kind}, `{mark}` long, gone array<int>")
    return work.write(walked.where("not first and not last").select(key, mark, "gone").unionByName(closed.where("size(gone) > 0")), "gone")


def extract(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Rows (key, url, text, n_lines, n_shared, n_left_out) with the main text of every page.

    n_shared lines of all n_lines are deleted by differencing, n_left_out more by structure.
    """
    kind = pages.schema[key].dataType.simpleString()
    (mark,) = fresh([key, "url", "html", "gone", "first", "last", "page", "inner", "part", "place", "before", "after", *_FIELDS], "mark")
    source = pages.select(key, "url", "html", F.xxhash64("url", "html").alias(mark))
    work = Workspace(pages.sparkSession, "html")
    gone = _deleted(_outlines(source, work, key, mark), work, key, mark)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = [], [[], [], []]
            for page, deleted in zip(batch["html"], batch["gone"].to_pylist(), strict=True):
                lines, shared = page_lines(page.as_py())[1], frozenset(deleted or ())
                texts.append("\n".join(x for k, (role, x) in enumerate(lines) if role != OUT and k not in shared))
                for column, n in zip(sizes, (len(lines), len(shared), sum(role == OUT and k not in shared for k, (role, _) in enumerate(lines))), strict=True):
                    column.append(n)
            yield pa.RecordBatch.from_arrays([batch[key], batch["url"], pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in sizes)], [key, "url", "text", "n_lines", "n_shared", "n_left_out"])

    # A small table of deletions is broadcast by its written size; a large one is joined by a shuffle.
    same = source[f"`{key}`"].eqNullSafe(gone[f"`{key}`"]) & (source[mark] == gone[mark])
    met = source.join(gone, same, "left").select(source[f"`{key}`"], "url", "html", "gone")
    return met.mapInArrow(finish, f"`{key}` {kind}, url string, text string, n_lines long, n_shared long, n_left_out long")
