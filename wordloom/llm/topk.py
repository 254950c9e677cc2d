"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights.  Queries and candidates are cut into
blocks, and every pair of blocks meets in one task through an equi-join on block
numbers.  There the candidates become posting lists, for each term the rows with
a weight and their weights; each query term scatters its weighted postings into
the dense scores of the block, each query keeps its k best by partition
selection, and the partial lists are merged per query.

The work is queries x candidates by definition.  What is shuffled is that work
divided by the size of the blocks, so blocks are large: a block is bounded by
rows and by weights (CELLS), and scores are held for one query at a time.

Defined cases: null vectors, and vectors with a null, NaN or infinite
component, take no part; vectors of other lengths, empty ones too, count missing
components as 0; an empty table gives no rows; repeated ids are candidates of
their own, and a query meets every row whose id differs from its own; null ids
take no part; where scores could exceed 64 bits (the largest norm of a query times
that of a row), the operator raises before any score is made.  Columns beyond
key and vector are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.plans.staging import Workspace

QUERY_BLOCK, ROW_BLOCK = 32_768, 16_384
#: Weights that a block holds on average at most.
CELLS = 1 << 22


def weights(vectors: DataFrame, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (key, terms array<long>) of the usable vectors; a term is floor(scale * x), x as double."""
    value = F.col(vector)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    usable = value.isNotNull() & F.forall(value, lambda x: F.coalesce(fine(x), F.lit(False))) & F.col(key).isNotNull()
    whole = lambda x: F.when(F.abs(x) < float(1 << 62), F.floor(x).cast("long")).otherwise(F.raise_error(F.lit("a weight exceeds 62 bits")).cast("long"))
    return vectors.where(usable).select(F.col(key), F.transform(value, lambda x: whole(F.lit(scale) * x.cast("double"))).alias("terms"))


class Postings:
    """For each term the rows with a weight, and their weights."""

    def __init__(self, vectors: pa.ListArray):
        sizes = np.diff(vectors.offsets.to_numpy())
        flat = vectors.flatten().to_numpy()
        term = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        row = np.repeat(np.arange(len(sizes)), sizes)
        held = np.flatnonzero(flat)
        held = held[np.argsort(term[held], kind="stable")]
        self.rows, self.most = len(sizes), int(np.abs(flat).max(initial=0))
        self.row, self.weight = row[held], flat[held]
        self.small = self.weight.astype(np.int32) if self.most < 1 << 31 else None
        self.at = np.searchsorted(term[held], np.arange(int(sizes.max(initial=0)) + 1))

    def scores(self, query: np.ndarray) -> np.ndarray:
        """Scores of all rows, one query term after the other."""
        terms = min(len(query), len(self.at) - 1)
        small = int(np.abs(query).max(initial=0)) * self.most * max(terms, 1) < 1 << 31
        weight, kind = (self.small, np.int32) if small and self.small is not None else (self.weight, np.int64)
        out = np.zeros(self.rows, kind)
        for term in np.flatnonzero(query[:terms]):
            a, b = self.at[term], self.at[term + 1]
            part = weight[a:b] * kind(query[term])
            if b - a == self.rows:  # every row has a weight, in order
                out += part
            else:
                out[self.row[a:b]] += part
        return out


def _select(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k best, ties to the smaller id; the query's own rows are left out."""
    open_ = np.flatnonzero(ids != own)
    values = scores[open_]
    if len(open_) > k:
        least = np.partition(values, len(values) - k)[len(values) - k]
        open_ = open_[values >= least]  # every tie of the last place stays until here
    return open_[np.lexsort((ids[open_], -scores[open_].astype(np.int64)))][:k]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, rank int, vec_id, score long)."""
    work = Workspace(vectors.sparkSession, "topk")
    rows = work.write(weights(vectors.where(F.col(key).isNotNull()), scale, key, vector).withColumn("asks", F.coalesce(is_query, F.lit(False))), "weights")
    asked = rows.where("asks").select(F.col(key).alias("id"), "terms").distinct()
    norm = F.sqrt(F.aggregate("terms", F.lit(0.0), lambda n, x: n + x.cast("double") * x.cast("double")))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("terms")).alias("cells"), F.count_if("asks").alias("m"), F.sum(F.when(F.col("asks"), F.size("terms"))).alias("asked"), F.max(norm).alias("norm"), F.max(F.when(F.col("asks"), norm)).alias("asked_norm")).first()
    if (counts.norm or 0) * (counts.asked_norm or 0) >= 1 << 62:  # no sum of products is larger, nor is a part of it
        raise OverflowError(f"scores of vectors with norms up to {counts.asked_norm} and {counts.norm} may exceed 64 bits")
    row_blocks = max(-(-counts.n // ROW_BLOCK), -(-(counts.cells or 0) // CELLS), 1)
    query_blocks = max(-(-counts.m // QUERY_BLOCK), -(-(counts.asked or 0) // CELLS), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    left = asked.select(own("id", query_blocks).alias("qb"), every(row_blocks).alias("rb"), F.col("id").cast("long").alias("id"), "terms")
    right = rows.select(every(query_blocks).alias("qb"), own(key, row_blocks).alias("rb"), F.col(key).cast("long").alias("id"), "terms")

    def meet(asking: pa.Table, held: pa.Table) -> pa.Table:
        qids, ids = asking["id"].to_numpy(), held["id"].to_numpy()
        out: list[list] = [[], [], []]
        if len(qids) and len(ids):
            postings = Postings(held["terms"].combine_chunks())
            for own_id, terms in zip(qids, asking["terms"], strict=True):
                scores = postings.scores(terms.values.to_numpy())
                best = _select(scores, ids, own_id, k)
                out[0] += [own_id] * len(best)
                out[1] += ids[best].tolist()
                out[2] += scores[best].astype(np.int64).tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    parts = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
