"""Ranked lexical search: WAND in every shard of documents, heaps merged.

A first pass over the documents counts the terms of the queries in each (one
table look-up a byte, an exact hash look-up a word) and writes them; document
numbers and frequencies are aggregated from there.  A second pass reads the
counts as shards of bounded size, builds each shard's posting lists and walks
them: a query's lists are sorted by their current document, the pivot is the
first document up to which the lists' greatest impacts in this shard exceed the
query's threshold (its k-th best score so far), all lists before it skip to it,
and only pivots are scored.  The queries of a shard walk in step, as rows of
arrays.  Documents of a shard stand in the order of their ids, so of equal scores
the smaller id is met first and stays.  Each shard gives its k best; a window
merges them.

Nothing is shuffled but frequencies and k rows a query and shard.  Queries are
cut into blocks of about ``block_terms`` terms; what is broadcast is one block's
terms and weights, and a block more reads the documents once more.

Scores follow 64-bit integers: a term's weight is floor(1000 ln((2N + 2) / (2df + 1))),
a document's m is 25 + (75 n N) div L, a term adds weight * ((10^9 tf) div (1000 tf + 8 m)),
once for every time the query holds it.  If 75 n N of some document exceeds 64
bits, the operator raises.

Defined cases: a null or empty text has no terms and is no document (it counts
in nothing); a null, empty or unmatched query gives no rows; rows without a key
count in the statistics but are not listed; repeated keys are documents of their
own, each listed; every row of queries is a query, repeated ids and null ids
too, and its rows carry its id; texts are read whole, in memory of some 30 times
the longest.  Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from wordloom.functions.text import ascii_lower
from wordloom.plans.staging import Workspace

from .word_stream import WORD, Words, ragged, slices

#: Terms of all queries of a block; postings of a shard (24 bytes each); cells of a matrix of queries and lists.
BLOCK_TERMS, SHARD_POSTINGS, CELLS = 500_000, 3 << 20, 1 << 16
#: The document of a list that has ended.
_END = np.iinfo(np.int64).max
_COUNTS = StructType([StructField("n", LongType()), StructField("terms", ArrayType(IntegerType())), StructField("tfs", ArrayType(IntegerType()))])


def _counter(vocabulary: pa.Array):
    """n (terms of a text), terms (those of the vocabulary) and tfs (how often each occurs)."""
    held, kind = pa.array(vocabulary.to_pylist(), pa.large_string()), pa.struct([("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
    wide = max(len(held), 1)

    def count(texts: pa.Array) -> pa.Array:
        body = Words(texts)
        symbols = body.symbols(held)
        text = np.repeat(np.arange(len(texts)), np.diff(body.first))
        cells, times = np.unique((text * wide + symbols)[symbols >= 0], return_counts=True)
        offsets = pa.array(np.searchsorted(cells, np.arange(len(texts) + 1) * wide), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (cells % wide, times)]
        return pa.StructArray.from_arrays([pa.array(np.diff(body.first), pa.int64()), *lists], fields=list(kind))

    @arrow_udf(_COUNTS)
    def counts(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([count(x) for x in slices(texts)]) if len(texts) else pa.array([], kind)

    return counts


class Shard:
    """Posting lists of some documents, in the order of their keys, with each term's greatest impact."""

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, lengths: np.ndarray, count: int, total: int, n_terms: int):
        m = 25 + (75 * lengths * count) // total
        doc = np.repeat(np.arange(len(sizes)), sizes)
        impact = (1_000_000_000 * tfs) // (1000 * tfs + 8 * m[doc])
        order = np.argsort(terms, kind="stable")  # documents stay in order within a term
        self.doc, self.impact = doc[order], impact[order]
        self.at = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.wide = len(sizes) + 1
        self.key = terms[order] * self.wide + self.doc
        self.most = np.zeros(n_terms, np.int64)
        np.maximum.at(self.most, terms, impact)

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, documents, scores): the k best with a score above 0; queries are (terms, weights), walked together in groups of like length."""
        lists = []
        for q, (terms, weight) in enumerate(queries):
            open_ = (self.at[terms + 1] > self.at[terms]) & (weight > 0)
            if open_.any():
                lists.append((q, terms[open_], weight[open_]))
        lists.sort(key=lambda x: len(x[1]))
        lo = 0
        while lo < len(lists):
            hi = lo + 1
            while hi < len(lists) and (hi + 1 - lo) * len(lists[hi][1]) <= CELLS:
                hi += 1
            yield from self._walk(lists[lo:hi], k)
            lo = hi

    def _walk(self, lists: list[tuple[int, np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        shape = (len(lists), max(len(t) for _, t, _ in lists))
        term, weight, at, end = (np.zeros(shape, np.int64) for _ in range(4))
        for i, (_, t, w) in enumerate(lists):
            term[i, : len(t)], weight[i, : len(t)] = t, w
            at[i, : len(t)], end[i, : len(t)] = self.at[t], self.at[t + 1]
        bound = weight * self.most[term]
        now = self._documents(at, end)
        own = np.arange(len(lists))  # rows whose queries still walk
        best, found = np.zeros((len(lists), k), np.int64), np.full((len(lists), k), -1, np.int64)
        while len(own):
            order = np.argsort(now, 1, kind="stable")
            reach = np.cumsum(np.take_along_axis(bound, order, 1), 1) > best[own].min(1)[:, None]
            first = np.take_along_axis(order, reach.argmax(1)[:, None], 1)
            pivot = np.where(reach[:, -1:], np.take_along_axis(now, first, 1), _END)
            go = pivot[:, 0] < _END
            if not go.all():
                own, term, weight, at, end, bound, now, pivot = (x[go] for x in (own, term, weight, at, end, bound, now, pivot))
                if not len(own):
                    break
            late = now < pivot
            at[late] = np.minimum(np.searchsorted(self.key, term[late] * self.wide + np.broadcast_to(pivot, now.shape)[late]), end[late])
            now[late] = self._documents(at[late], end[late])
            here = now == pivot
            score = np.where(here, weight * self.impact[np.where(here, at, 0)], 0).sum(1)
            least = best[own].min(1)[:, None]
            place = np.where(best[own] == least, found[own], -2).argmax(1)  # of equal least scores the largest id goes
            better = score > best[own, place]
            best[own[better], place[better]], found[own[better], place[better]] = score[better], pivot[better, 0]
            at[here] += 1
            now[here] = self._documents(at[here], end[here])
        for i, (q, _, _) in enumerate(lists):
            held = found[i] >= 0
            if held.any():
                yield q, found[i][held], best[i][held]

    def _documents(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        return np.where(at < end, self.doc[np.minimum(at, len(self.doc) - 1)], _END)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches gathered until they hold SHARD_POSTINGS postings."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch["terms"].flatten())
        if size >= SHARD_POSTINGS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _rank_block(docs: DataFrame, asked: list[tuple[int, list[str]]], k: int, key: str, text: str, work: Workspace) -> DataFrame:
    """query, key, score: the k best of every shard for one block of queries."""
    spark = docs.sparkSession
    vocabulary = pa.array(sorted({t for _, terms in asked for t in terms}), pa.string())
    number = {t: i for i, t in enumerate(vocabulary.to_pylist())}
    counts = docs.select(F.col(f"`{key}`").alias("key"), _counter(vocabulary)(F.col(f"`{text}`")).alias("c")).select("key", "c.*").where("n > 0")
    counts = work.write(counts, "counts")
    sums = counts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.max("n"), F.lit(0)).alias("longest")).first()
    if 75 * sums.longest * sums.n >= 1 << 63:
        raise OverflowError(f"75 * {sums.longest} * {sums.n} exceeds 64 bits")
    frequency = dict(counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    weight = [math.floor(1000 * math.log((2 * sums.n + 2) / (2 * frequency.get(i, 0) + 1))) for i in range(len(vocabulary))]
    queries = []
    for _, terms in asked:
        held = Counter(number[t] for t in terms)
        queries.append((np.array(list(held), np.int64), np.array([n * weight[t] for t, n in held.items()], np.int64)))
    shared = spark.sparkContext.broadcast(([q for q, _ in asked], queries))
    n_docs, total, n_terms = sums.n, sums.total, len(vocabulary)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, every = shared.value
        for table in _shards(batches):
            table = table.take(pc.sort_indices(table["key"]))
            lists = table["terms"].combine_chunks()
            sizes, tfs = np.diff(lists.offsets.to_numpy()), table["tfs"].combine_chunks().flatten().to_numpy()
            shard = Shard(sizes, lists.flatten().to_numpy().astype(np.int64), tfs.astype(np.int64), table["n"].to_numpy(), n_docs, total, n_terms)
            for q, rows, scores in shard.search(every, k):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), ids[q]), pa.int64()), table["key"].take(pa.array(rows)).combine_chunks(), pa.array(scores, pa.int64())], ["query", "key", "score"])

    listed = counts.where("key IS NOT NULL AND size(terms) > 0").select("key", "n", "terms", "tfs")
    schema = StructType([StructField("query", LongType()), StructField("key", counts.schema["key"].dataType), StructField("score", LongType())])
    return listed.mapInArrow(search, schema)


def rank(docs: DataFrame, queries: DataFrame, k: int = 10, *, key: str = "doc_id", text: str = "text", query: str = "item_id", query_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Rows (query, rank int from 1, key, score long) under the names given: each query's k best documents."""
    work = Workspace(docs.sparkSession, "rank")
    terms = F.regexp_extract_all(ascii_lower(F.col(f"`{query_text}`")), F.lit(WORD), F.lit(0))
    asked = work.write(queries.select(F.monotonically_increasing_id().alias("query"), F.col(f"`{query}`").alias("id"), terms.alias("terms")).where("size(terms) > 0"), "queries")
    total = asked.agg(F.sum(F.size("terms")).alias("n")).first().n or 0
    blocks = max(-(-total // block_terms), 1)
    parts = None
    for block in range(blocks):
        own = [(r.query, r.terms) for r in asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).collect()]
        if own or parts is None:
            one = _rank_block(docs, own, k, key, text, work)
            parts = one if parts is None else parts.unionByName(one)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    best = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select("query", "id"), "query").select(F.col("id").alias(query), "rank", F.col("key").alias(key), "score")
