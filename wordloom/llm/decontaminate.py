"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark items: ``size`` consecutive words,
or all words of a shorter item.  Texts become sequences of word numbers in the
benchmark's vocabulary.  For the patterns of one length a machine holds

- a shift table: for every block of two words (one, for one-word patterns) that
  a pattern holds, its least distance from a pattern's end; a block that no
  pattern holds shifts by the pattern's length less the block;
- buckets: patterns by their last block, within it by their first block;
- the patterns themselves, for direct comparison.

All places of a batch of texts move in step: each cursor reads the block that
ends at its place, shifts, and where the shift is 0 compares the bucket's
patterns word by word.  Word numbers are places in a list, not hashes, so what
is found is exact.

Documents are not shuffled.  Machines are broadcast; their size is bounded:
items are cut into overlapping pieces, and pieces into blocks of about
``block_words`` words.  With more than one block the documents are searched once
a block and what was found is united per row.

Defined cases: texts and items without words (null, empty) neither hit nor are
hit; an empty table of either kind finds nothing; items without an id mark words
but are neither counted nor named; items that share an id are one item; rows
that share a doc_id, and repeated rows, are searched each on its own; texts of
any length are searched whole, in memory of some 30 times the longest.  Columns
of the documents pass through; one named as ``out`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from wordloom.functions.text import ascii_lower
from wordloom.plans.names import fresh
from wordloom.plans.staging import Workspace

from .word_stream import WORD, Words, ragged, slices

SIZE = 10
#: Words of a piece of an item, and of the pieces that one machine holds (some 100 bytes a word).
PIECE_WORDS, BLOCK_WORDS = 10_000, 500_000
#: Places that one cursor walks; pairs of place and pattern that are compared at once.
WALK, PAIRS = 64, 1 << 17

_RANGE = StructType([StructField(n, LongType()) for n in ("first", "last", "start", "end")])
#: What a machine finds in a text: its words, ranges of hit words (with their code points), ids of the items.
FOUND = StructType([StructField("n_words", LongType()), StructField("ranges", ArrayType(_RANGE)), StructField("items", ArrayType(StringType()))])


class WuManber:
    """Patterns of one length: shift table, suffix buckets, direct comparison."""

    def __init__(self, patterns: np.ndarray, letters: int):
        self.patterns, self.letters = patterns, letters
        self.size = patterns.shape[1]
        self.block = min(2, self.size)
        places = self.size - self.block + 1
        codes = np.stack([self._codes(patterns, j + self.block - 1) for j in range(places)], 1)
        self.known, inverse = np.unique(codes, return_inverse=True)
        self.shift = np.full(len(self.known), places, np.int64)
        np.minimum.at(self.shift, inverse.ravel(), np.tile(np.arange(places - 1, -1, -1), len(patterns)))
        self.most = places
        last, head = inverse.reshape(codes.shape)[:, -1], inverse.reshape(codes.shape)[:, 0]
        bucket = last * len(self.known) + head
        self.order = np.argsort(bucket, kind="stable")
        self.bucket = bucket[self.order]

    def _codes(self, rows: np.ndarray, j: int | np.ndarray) -> np.ndarray:
        """The block that ends at place j; -1 if a word of it is in no pattern."""
        own = rows[..., j]
        if self.block == 1:
            return own
        before = rows[..., j - 1]
        return np.where((own < 0) | (before < 0), -1, before * self.letters + own)

    def _look_up(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each block, and whether a pattern holds it."""
        at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        return at, self.known[at] == codes

    def search(self, symbols: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (place of the last word, pattern) of all occurrences inside the texts that start at ``first``."""
        lo, hi = first[:-1] + self.size - 1, first[1:]
        sizes = np.maximum(-(-(hi - lo) // WALK), 0)
        at = np.repeat(lo, sizes) + WALK * ragged(np.zeros(len(sizes), np.int64), sizes)
        end = np.minimum(at + WALK, np.repeat(hi, sizes))
        while len(at):
            number, held = self._look_up(self._codes(symbols, at))
            shift = np.where(held, self.shift[number], self.most)
            stop = shift == 0
            if stop.any():
                yield from self._confirm(symbols, at[stop], number[stop])
            at = at + np.maximum(shift, 1)
            open_ = at < end
            at, end = at[open_], end[open_]

    def _confirm(self, symbols: np.ndarray, at: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        head, held = self._look_up(self._codes(symbols, at - self.size + self.block))
        at, bucket = at[held], (last * len(self.known) + head)[held]
        a, b = np.searchsorted(self.bucket, bucket), np.searchsorted(self.bucket, bucket, "right")
        for lo in range(0, len(at), max(1, PAIRS // max(int((b - a).max(initial=1)), 1))):
            part = slice(lo, lo + max(1, PAIRS // max(int((b - a).max(initial=1)), 1)))
            sizes = (b - a)[part]
            pattern, place = self.order[ragged(a[part], sizes)], np.repeat(at[part], sizes)
            same = (symbols[place[:, None] + np.arange(1 - self.size, 1)] == self.patterns[pattern]).all(1)
            yield place[same], pattern[same]


class Machines:
    """The windows of a block of item pieces, a machine for each length; and the items of every window."""

    def __init__(self, pieces: list[tuple[str | None, list[str]]], size: int):
        self.vocabulary = pa.array(sorted({w for _, words in pieces for w in words}), pa.string())
        number = {w: i for i, w in enumerate(self.vocabulary.to_pylist())}
        windows: dict[int, dict[tuple[int, ...], set[str | None]]] = {}
        for item, words in pieces:
            codes = [number[w] for w in words]
            k = min(size, len(codes))
            for i in range(len(codes) - k + 1):
                windows.setdefault(k, {}).setdefault(tuple(codes[i : i + k]), set()).add(item)
        self.each = [(WuManber(np.array(list(own), np.int64), len(number)), [sorted(x for x in items if x is not None) for items in own.values()]) for own in windows.values()]

    def find(self, texts: pa.Array) -> list[tuple[int, list[tuple[int, int, int, int]], list[str]]]:
        """For each text: number of words, ranges of hit words, ids of the items found."""
        body = Words(texts)
        counts = np.diff(body.first)
        out: list = [(int(n), [], []) for n in counts]
        symbols = body.symbols(self.vocabulary)
        turns, items = np.zeros(len(symbols) + 1, np.int64), [set() for _ in out]
        for machine, names in self.each:
            for place, pattern in machine.search(symbols, body.first):
                np.add.at(turns, place - machine.size + 1, 1)
                np.add.at(turns, place + 1, -1)
                text = np.searchsorted(body.first, place, "right") - 1
                for t, p in np.unique(np.stack([text, pattern], 1), axis=0).tolist():
                    items[t].update(names[p])
        hit = np.cumsum(turns)[:-1] > 0
        for t in np.unique(np.searchsorted(body.first, np.flatnonzero(hit), "right") - 1).tolist():
            own = np.concatenate([[0], hit[body.first[t] : body.first[t + 1]].astype(np.int8), [0]])
            edges = np.diff(own)
            a, b = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            c, d = body.characters(body.start[body.first[t] + a], t), body.characters(body.end[body.first[t] + b - 1], t)
            out[t] = (int(counts[t]), list(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)), sorted(items[t]))
        return out


def _pieces(items: DataFrame, size: int, item: str, text: str) -> DataFrame:
    """item, words: each item's words in pieces that share size - 1 words with the next one."""
    words = F.regexp_extract_all(ascii_lower(F.col(f"`{text}`")), F.lit(WORD), F.lit(0))
    rows = items.select(F.col(f"`{item}`").cast("string").alias("item"), words.alias("words")).where("size(words) > 0")
    steps = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)), F.lit(PIECE_WORDS))
    each = rows.select("item", "words", F.explode(steps).alias("at"))
    return each.select("item", F.slice("words", F.col("at") + 1, F.lit(PIECE_WORDS + size - 1)).alias("words"))


def _finder(machines):
    """What one block of machines (a broadcast) finds in a text, as FOUND."""
    pair = pa.struct([(n, pa.int64()) for n in _RANGE.names])
    kind = pa.struct([("n_words", pa.int64()), ("ranges", pa.list_(pair)), ("items", pa.list_(pa.string()))])

    @arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        rows = [x for part in slices(texts) for x in machines.value.find(part)]
        return pa.array([{"n_words": n, "ranges": [dict(zip(_RANGE.names, r, strict=True)) for r in ranges], "items": items} for n, ranges, items in rows], kind)

    return find


def _united(ranges: Column) -> Column:
    """Ranges of words as their union, in order."""
    return F.aggregate(
        F.array_sort(ranges), F.array().cast(ArrayType(_RANGE)),
        lambda done, r: F.when((F.size(done) > 0) & (r["first"] <= F.element_at(done, -1)["last"]), F.concat(
            F.slice(done, 1, F.size(done) - 1),
            F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["last"], r["last"]).alias("last"), F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], r["end"]).alias("end"))),
        )).otherwise(F.array_append(done, r)),
    )


def _verdict(found: Column) -> Column:
    n_hit = F.aggregate(found["ranges"], F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    spans = F.transform(found["ranges"], lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))
    return F.struct(found["n_words"].alias("n_words"), n_hit.alias("n_hit"), found["items"].alias("items"), spans.alias("spans"))


def find_overlaps(docs: DataFrame, items: DataFrame, size: int = SIZE, *, text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "overlap", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with a struct ``out``: n_words, n_hit, items (ids as sorted strings), spans (start, end in code points of the hit passages)."""
    spark = docs.sparkSession
    work = Workspace(spark, "overlaps")
    pieces = work.write(_pieces(items, size, item, item_text), "pieces")
    words = pieces.agg(F.sum(F.size("words")).alias("n")).first().n or 0
    blocks = max(-(-words // block_words), 1)
    number = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))

    def machines(block: int):
        return spark.sparkContext.broadcast(Machines([(r.item, r.words) for r in pieces.where(number == block).collect()], size))

    if blocks == 1:
        found = docs.withColumn(out, _finder(machines(0))(F.col(f"`{text}`")))
        return found.withColumn(out, _verdict(F.col(f"`{out}`")))
    (row,) = fresh((*docs.columns, out), "row")
    numbered = work.write(docs.withColumn(row, F.monotonically_increasing_id()), "docs")
    parts = None
    for block in range(blocks):
        one = numbered.select(row, _finder(machines(block))(F.col(f"`{text}`")).alias(out))
        one = work.write(one.where(F.size(F.col(f"`{out}`.ranges")) > 0) if block else one, f"block{block}")
        parts = one if parts is None else parts.unionByName(one)
    each = parts.groupBy(row).agg(F.max(f"{out}.n_words").alias("n_words"), F.flatten(F.collect_list(f"{out}.ranges")).alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"{out}.items")))).alias("items"))
    each = each.select(row, F.struct("n_words", _united(F.col("ranges")).alias("ranges"), "items").alias(out))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()]
    return numbered.drop(out).join(each, row).select(*kept, _verdict(F.col(f"`{out}`")).alias(out))


def keep_clean(docs: DataFrame, items: DataFrame, size: int = SIZE, **names) -> DataFrame:
    """The documents that hold no window of an item."""
    (out,) = fresh(docs.columns, "overlap")
    return find_overlaps(docs, items, size, out=out, **names).where(F.col(f"{out}.n_hit") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def cut_overlaps(docs: DataFrame, items: DataFrame, size: int = SIZE, *, text: str = "text", mark: str = "", **names) -> DataFrame:
    """The documents without the hit passages, each replaced by ``mark``; a text without any stays as it is."""
    (out,) = fresh(docs.columns, "overlap")
    found = find_overlaps(docs, items, size, text=text, out=out, **names)
    spans, body = F.col(f"{out}.spans"), F.col(f"`{text}`")
    n = F.size(spans)
    froms = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    tos = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(body).cast("long")))
    rest = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(body, F.get(froms, i).cast("int") + 1, (F.get(tos, i) - F.get(froms, i)).cast("int")))
    clean = F.when(n > 0, F.array_join(rest, mark)).otherwise(body)
    return found.select(*[clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
