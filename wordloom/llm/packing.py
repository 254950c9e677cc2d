"""Best-fit packing of token sequences under several capacities.

Pieces are placed by their lengths alone, and there are at most CAPACITY
lengths.  So the plan is made on the histogram: lengths descend, and each takes
the open bin whose residual vector (tokens, documents, attention cost) fits
best, by weighted residual norm or weighted dot-product, among bins that pass
every constraint.  Bins in the same state are one class with a multiplicity, so
the plan is bounded by the number of lengths, not by the corpus, and is the
same plan that placing piece after piece would give.  Pieces then find their
place by their rank among pieces of their length; ranks come from counts per
written partition, so no length is gathered in one task.

Defined cases: a null or empty text is a document of one token (the closing
id); a document longer than a sequence is cut into full sequences with the
short piece first, however long; repeated rows are packed as documents of their
own; of bins that fit equally well the one made first is taken, and pieces of
one length are placed in the order of their written partitions; an empty table
gives no rows.  Columns beyond key and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.plans.staging import Workspace
from wordloom.plans.workers import lean

from .bpe import slices, table_for

CAPACITY, CLOSING = 2048, 0


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence; attention cost of a piece is its length squared.

    The defaults for documents and attention follow from the token capacity and
    so never bind; weights order bins by tokens, then by the others.
    """

    tokens: int = CAPACITY
    documents: int = CAPACITY
    attention: int = CAPACITY * CAPACITY
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    measure: str = "norm"  # or "dot"


@dataclass
class Bins:
    """So many bins with the same content: (length, how many in each bin)."""

    rest: np.ndarray
    many: int
    items: list[tuple[int, int]] = field(default_factory=list)

    def take(self, many: int, length: int, count: int) -> Bins:
        self.many -= many
        return Bins(self.rest - _need(length) * count, many, [*self.items, (length, count)])


def _need(length: int) -> np.ndarray:
    return np.array([length, 1, length * length], np.int64)


def plan(histogram: dict[int, int], limits: Limits) -> list[Bins]:
    """Bins for so many pieces of each length."""
    full = np.array([limits.tokens, limits.documents, limits.attention], np.int64)
    weights, bins = np.array(limits.weights), []
    for length in sorted(histogram, reverse=True):
        left, need = histogram[length], _need(length)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens passes the limits of an empty sequence")
        while left:
            best = None
            if bins:
                rest = np.stack([b.rest for b in bins])
                fits = (rest >= need).all(axis=1)
                if fits.any():
                    score = (((rest - need) / full) ** 2 * weights).sum(axis=1) if limits.measure == "norm" else -(rest / full * (need / full) * weights).sum(axis=1)
                    best = int(np.where(fits, score, np.inf).argmin())
            if best is None:
                each = int((full // need).min())
                bins.append(Bins(full.copy(), -(-left // each)))
                best = len(bins) - 1
            chosen = bins[best]
            each = int((chosen.rest // need).min())
            many = min(chosen.many, left // each)
            part = chosen.take(many, length, each) if many else chosen.take(1, length, left)
            left -= many * each if many else left
            if not chosen.many:
                bins.pop(best)
            bins.append(part)
    return bins


def _slots(bins: list[Bins]) -> np.ndarray:
    """Rows (length, first rank, ranks, pieces a bin, first sequence, offset), sorted by length and rank."""
    rows, cursor, sequence = [], {}, 0
    for group in bins:
        offset = 0
        for length, count in group.items:
            at = cursor.get(length, 0)
            rows.append((length, at, group.many * count, count, sequence, offset))
            cursor[length] = at + group.many * count
            offset += length * count
        sequence += group.many
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Rows (key, piece, start, length, ids_crc32, part, nth[, ids binary]).

    ids are little-endian unsigned 32-bit; (part, length, nth) numbers the
    pieces of a length inside the task that made them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, met = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo, texts in slices(batch[1]):
                ids, sizes = table_for(path).encode(texts)
                rows: list[list] = [[] for _ in range(7)]
                place = 0
                for i, size in enumerate(sizes.tolist()):
                    own = np.append(ids[place : place + size], CLOSING).astype("<u4")
                    place += size
                    first = len(own) % capacity or capacity
                    cuts = [0, *range(first, len(own) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        raw = own[a:b].tobytes()
                        for out, value in zip(rows, (lo + i, k, a, b - a, zlib.crc32(raw), int(met[b - a]), raw if keep_ids else None), strict=True):
                            out.append(value)
                        met[b - a] += 1
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                columns = [batch[0].take(pa.array(rows[0], pa.int64())), *(pa.array(x, kind) for x, kind in zip(rows[1:], kinds, strict=True))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(rows[0]), part), pa.int32())], [key, "piece", "start", "length", "ids_crc32", "nth", "ids", "part"])

    source = docs.select(F.col(key), F.col(text))
    made = source.mapInArrow(lean(run), f"`{key}` {source.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, nth long, ids binary, part int")
    return made if keep_ids else made.drop("ids")


def place(cut: DataFrame, limits: Limits | None = None) -> DataFrame:
    """A written ``pieces`` table with sequence_id and offset (long) of each piece."""
    limits = limits or Limits()
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most limits.tokens rows
    slots = _slots(plan(histogram, limits))
    scale = int(slots[:, 1:3].sum(axis=1).max(initial=0)) + 1
    found_at = slots[:, 0] * scale + slots[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["nth"].to_numpy() + batch["before"].to_numpy()
            row = slots[np.searchsorted(found_at, length * scale + rank, side="right") - 1]
            number, slot = np.divmod(rank - row[:, 1], row[:, 3])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(row[:, 4] + number), pa.array(row[:, 5] + slot * length)], [*batch.schema.names, "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructType

    ranked = cut.join(before, ["part", "length"])
    schema = StructType([*ranked.schema.fields]).add("sequence_id", LongType()).add("offset", LongType())
    return ranked.mapInArrow(lean(run), schema).drop("part", "nth", "before")


def pack(docs: DataFrame, path: str, limits: Limits | None = None, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Rows (key, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every document."""
    work = Workspace(docs.sparkSession, "packing")
    cut = work.write(pieces(docs, path, (limits or Limits()).tokens, key, text, keep_ids), "pieces")
    return place(cut, limits)
