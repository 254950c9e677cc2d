"""N-gram Jaccard join by PartEnum signatures: exact links of J >= 0.8, their components.

Plan.  (1) One pass gives each document its set size, a 128-bit set hash and a
parity sketch.  Equal sets are one class; its smallest document stands for it.
(2) A second pass signs every set (see ``partenum``); only signatures of two
or more classes stay, and a signature of very many is dealt out by a salt.  (3) Every class of a bucket is compared with the
bucket's smallest class only; verified links give provisional components.
(4) In buckets that still hold several components, all pairs across components
are compared by sketch inside the bucket; buckets over BLOCK rows are cut into
block pairs, so no task holds more than two blocks.  (5) Survivors are verified
on the whole sets, and components are final.

A parity sketch stores for each of 2^m slots whether an odd number of features
fell there.  Two sketches differ in at most |A ^ B| slots, so more differing
slots than (a + b) / 9 rule a pair out for certain; the rest is verified on the
sets.  Pairs inside a provisional component need no test: they are connected
already.  Thus no link between components is lost and no group is expanded
into all its pairs.  Who needs the links themselves, or their number for each
document, takes ``jaccard_links`` or ``link_counts``, which test all pairs of a
bucket.

Defined cases: null or word-less texts have size 0 and are linked with nothing;
a repeated row gives a repeated result row; where rows share a doc_id but not the
text, each row is a document of its own that has that doc_id; rows with a null
doc_id are counted, form no links and keep a null component; texts are used
whole, however long.  Columns beyond key and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.operators.components import connected_components
from wordloom.plans.staging import BROADCAST_IDS, Workspace, broadcast_if_few
from wordloom.plans.workers import lean

from .partenum import signatures
from .shingles import mix, shingles

_U = np.uint64
LEAST_BITS = 512
#: Rows of a bucket that one task compares at most with so many others.
BLOCK = 4096
#: Pairs that are compared at once.
CHUNK = 1 << 18
#: A signature is hot that HOT_IN_SAMPLE of one in SAMPLE documents hold; its rows are dealt out to SALTS parts.
SAMPLE, HOT_IN_SAMPLE, SALTS = 64, 64, 128


def _bits(size: int) -> int:
    return max(LEAST_BITS, 1 << max(size - 1, 1).bit_length())


def sketch(features: np.ndarray) -> bytes:
    bits = _bits(len(features))
    slots = (mix(features + _U(0xABCDEF)) & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(slots, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _fold(rows: np.ndarray, words: int) -> np.ndarray:
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def similar(size_a, size_b, common) -> bool:
    return 100 * common >= 80 * (size_a + size_b - common)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list = [[], [], [], []]
        for text in batch["text"]:
            found = shingles(text.as_py())
            out[0].append(len(found))
            out[1].append(int((mix(found + _U(1)).sum(dtype=_U)).astype(np.int64)) if len(found) else 0)
            out[2].append(int((mix(found * _U(3) + _U(0x51ED270B)).sum(dtype=_U)).astype(np.int64)) if len(found) else 0)
            out[3].append(sketch(found) if len(found) else None)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["doc_id", "n_shingles", "h1", "h2", "sketch"])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, held = [], [], 0
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            found = signatures(shingles(text.as_py()))
            if len(found):
                ids.append(np.full(len(found), doc, np.int64))
                keys.append(found.view(np.int64))
                held += len(found)
            if held > 1 << 17:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], ["sig", "doc_id"])
                ids, keys, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], ["sig", "doc_id"])


def _sketch_passes(pairs_a: np.ndarray, pairs_b: np.ndarray, sizes: np.ndarray, sketches: list[bytes]) -> np.ndarray:
    """Which pairs their sizes and sketches don't rule out."""
    a, b = sizes[pairs_a], sizes[pairs_b]
    keep = 5 * np.minimum(a, b) >= 4 * np.maximum(a, b)
    widths = np.array([len(x) // 8 for x in sketches])
    narrow = np.minimum(widths[pairs_a], widths[pairs_b])
    for words in np.unique(narrow[keep]):
        at = np.flatnonzero(keep & (narrow == words))
        used, place = np.unique(np.concatenate((pairs_a[at], pairs_b[at])), return_inverse=True)
        rows = np.empty((len(used), words), _U)
        for k, i in enumerate(used):
            rows[k] = _fold(np.frombuffer(sketches[i], _U)[None], words)[0]
        most = (a[at] + b[at]) // 9
        step = max(1, (1 << 20) // int(words))
        for lo in range(0, len(at), step):
            x, y = place[lo : min(lo + step, len(at))], place[len(at) + lo : len(at) + min(lo + step, len(at))]
            keep[at[lo : lo + step]] = np.bitwise_count(rows[x] ^ rows[y]).sum(axis=1, dtype=np.int64) <= most[lo : lo + step]
    return keep


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b) with sizes and sketches, the pairs that may be similar."""
    for batch in batches:
        n = batch.num_rows
        sizes = np.concatenate((batch["na"].to_numpy(), batch["nb"].to_numpy()))
        keep = _sketch_passes(np.arange(n), np.arange(n, 2 * n), sizes, batch["sa"].to_pylist() + batch["sb"].to_pylist())
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _across(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Likely pairs of different components in each of the table's whole buckets."""
    keys = np.stack([table[c].to_numpy() for c in ("sig", "lo", "hi")], axis=1)
    edge = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1), [True])))
    label, side, ids, sizes = (table[c].to_numpy() for c in ("label", "block", "rep", "n"))
    sketches = table["sketch"].to_pylist()
    lo, hi = keys[:, 1], keys[:, 2]
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        a, b = (np.concatenate(x) for x in zip(*waiting, strict=True))
        waiting.clear()
        good = _sketch_passes(a, b, sizes, sketches)
        a, b = a[good], b[good]
        found = np.unique(np.stack((np.maximum(ids[a], ids[b]), np.minimum(ids[a], ids[b])), axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    held = 0
    for start, end in zip(edge[:-1], edge[1:], strict=True):
        if label[start:end].min() == label[start:end].max():
            continue
        for i in range(start, end - 1):
            others = np.arange(i + 1, end)
            others = others[label[others] != label[i]]
            if lo[i] != hi[i]:
                others = others[side[others] != side[i]]
            if len(others):
                waiting.append((np.full(len(others), i), others))
                held += len(others)
            if held > CHUNK:
                yield from flush()
                held = 0
    if waiting:
        yield from flush()


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; a bucket may go on in the next batch."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        last = np.stack([table[c].to_numpy() for c in ("sig", "lo", "hi")], axis=1)
        cut = int(np.flatnonzero((last != last[-1]).any(axis=1))[-1]) + 1 if (last != last[-1]).any() else 0
        if cut:
            whole = table.slice(0, cut)
            yield from _across((whole if rest is None else pa.concat_tables([rest, whole])).combine_chunks())
            rest = table.slice(cut)
        else:
            rest = table if rest is None else pa.concat_tables([rest, table])
    if rest is not None:
        yield from _across(rest.combine_chunks())


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, ta, tb), the pairs whose whole sets are similar."""
    known: dict[int, np.ndarray] = {}
    for batch in batches:
        keep = []
        for a, b, ta, tb in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["ta"], batch["tb"], strict=True):
            if len(known) > 256:
                known.clear()
            for key, text in ((a, ta), (b, tb)):
                if key not in known:
                    known[key] = shingles(text.as_py())
            common = len(np.intersect1d(known[a], known[b], assume_unique=True))
            keep.append(similar(len(known[a]), len(known[b]), common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    # leaders (b) repeat: that join has plain exchanges on both sides, so a hot leader's pairs can be split
    joined = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    return joined.select("a", "b", "ta", "tb").mapInArrow(lean(_verified), "a long, b long")


@dataclass
class _Buckets:
    """What signing the sets of a table gives; all tables are written."""

    work: Workspace
    sizes: DataFrame  # doc_id, n_shingles: one row per row of the input
    members: DataFrame  # doc_id, rep, n: the class of each document with a set
    nodes: DataFrame  # rep, n, sketch: one row per class
    texts: DataFrame  # doc_id, text of the input
    shared: DataFrame  # sig, rep, b: the classes of each shared signature, and its smallest class
    names: DataFrame | None  # doc_id, real: own numbers of rows whose doc_id other texts have too

    def real(self, rows: DataFrame, *columns: str) -> DataFrame:
        """Rows with the documents' own ids in these columns."""
        for c in columns if self.names is not None else ():
            rows = rows.join(self.names.select(F.col("doc_id").alias(c), F.col("real").alias("__real")), c, "left").withColumn(c, F.coalesce("__real", c)).drop("__real")
        return rows


def _hot_signatures(signed: Callable[[DataFrame], DataFrame], texts: DataFrame, work: Workspace) -> DataFrame:
    """Signatures that very many sets hold, estimated on one document in SAMPLE.

    The estimate decides alone how a signature's rows are dealt out, never what
    becomes of them.  There are fewer than rows / HOT_IN_SAMPLE of them.
    """
    part = signed(texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0))
    return work.write(part.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_IN_SAMPLE).select("sig"), "hot")


def _sign(docs: DataFrame, key: str, text: str) -> _Buckets:
    work = Workspace(docs.sparkSession, "jaccard")
    source = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    light = work.write(source.mapInArrow(lean(_fingerprints), "doc_id long, n_shingles long, h1 long, h2 long, sketch binary"), "sets")
    own, names = F.struct("n_shingles", "h1", "h2"), None
    unlike = light.where("doc_id is not null").groupBy("doc_id").agg(F.min(own).alias("a"), F.max(own).alias("b")).where("a <> b").select("doc_id")
    unlike = work.write(unlike, "unlike")
    if not unlike.isEmpty():  # rows of these documents get a number of their own, below zero
        node = F.when(F.col("odd"), -F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2) - 1).otherwise(F.col("doc_id"))
        source = source.join(broadcast_if_few(unlike).withColumn("odd", F.lit(True)), "doc_id", "left").select(node.alias("doc_id"), "text", F.col("doc_id").alias("real"))
        names = work.write(source.where("doc_id <> real").select("doc_id", "real").distinct(), "names")
        source = source.drop("real")
        light = work.write(source.mapInArrow(lean(_fingerprints), "doc_id long, n_shingles long, h1 long, h2 long, sketch binary"), "sets")
    named = light.where("n_shingles > 0 and doc_id is not null")
    sets = work.write(named.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")  # written, so that a hot class can be split in the join
    members = work.write(named.join(sets, ["n_shingles", "h1", "h2"]).select("doc_id", "rep", F.col("n_shingles").alias("n")), "members")
    nodes = work.write(named.join(members.where("doc_id = rep").select("doc_id", "n").distinct(), "doc_id", "left_semi").where("n_shingles > 0").select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["rep", "n"]), "nodes")

    copies = work.write(members.where("doc_id <> rep").select("doc_id").distinct(), "copies")
    texts = source.where("doc_id is not null")
    signed = lambda part: part.join(broadcast_if_few(copies), "doc_id", "left_anti").mapInArrow(lean(_signed), "sig long, doc_id long")
    hot = _hot_signatures(signed, texts, work)
    # A hot signature is dealt out by a salt; a first window finds the smallest class of each salt, ...
    rows = signed(texts).withColumnRenamed("doc_id", "rep")
    rows = rows.join(broadcast_if_few(hot).withColumn("hot", F.lit(True)), "sig", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).otherwise(-1))
    bucket = Window.partitionBy("sig", "salt")
    met = rows.select("sig", "rep", "salt", F.min("rep").over(bucket).alias("b"), F.max("rep").over(bucket).alias("top")).where("salt >= 0 or b < top")
    met = work.write(met.select("sig", "rep", "salt", "b"), "buckets")
    # ... and then the smallest of all its salts is found from one row per salt and task.
    first = work.write(met.where("salt >= 0").groupBy("sig").agg(F.min("b").alias("first"), F.max("rep").alias("top")).where("first < top").select("sig", "first"), "first")
    spread = met.where("salt >= 0").join(broadcast_if_few(first), "sig").select("sig", "rep", F.col("first").alias("b"))
    return _Buckets(work, light.select("doc_id", "n_shingles"), members, nodes, texts, met.where("salt < 0").select("sig", "rep", "b").unionByName(spread), names)


def _bucket_pairs(found: _Buckets, label: DataFrame | None) -> DataFrame:
    """Likely pairs (a, b) of classes that share a signature and differ in their label (rep, root), each once.

    Without labels all classes differ.  Buckets over BLOCK rows are cut into pairs of blocks.
    """
    work = found.work
    rows = found.shared.select("sig", "rep")
    if label is None:
        rows = rows.withColumn("label", F.col("rep"))
    else:
        rows = rows.join(broadcast_if_few(label), "rep", "left").select("sig", "rep", F.coalesce("root", "rep").alias("label"))
    # one row per signature and task: no bucket is sorted as a whole to see what it holds
    kinds = rows.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("top"), F.count(F.lit(1)).alias("m")).where("low < top")
    kinds = work.write(kinds.select("sig", "m"), "mixed")
    mixed = rows.join(broadcast_if_few(kinds, BROADCAST_IDS // 4), "sig").join(found.nodes, "rep").select("sig", "rep", "label", "n", "sketch", "m")
    columns = ["sig", "lo", "hi", "rep", "label", "n", "block", "sketch"]
    none = F.lit(0)
    usual = mixed.where(F.col("m") <= BLOCK).select("sig", none.alias("lo"), none.alias("hi"), "rep", "label", "n", none.alias("block"), "sketch").repartition("sig").sortWithinPartitions("sig")
    hot = mixed.where(F.col("m") > BLOCK).withColumn("q", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("q")).cast("int"))
    hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    hot = hot.select("sig", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "rep", "label", "n", "block", "sketch").select(columns)
    hot = hot.repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi")
    likely = usual.mapInArrow(lean(_buckets), "a long, b long").union(hot.mapInArrow(lean(_buckets), "a long, b long"))
    return work.write(likely.distinct(), "likely")


def _links(found: _Buckets, likely: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar; texts are read for the classes in question alone."""
    ids = found.work.write(likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    texts = found.work.write(found.texts.join(broadcast_if_few(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.first("text").alias("text")), "texts")
    return found.work.write(_verify(likely, texts), "links")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, set_id, component_id.

    set_id is the smallest doc_id with the same set (itself where the set is
    empty), component_id the smallest doc_id reachable by links.
    """
    found = _sign(docs, key, text)
    work, nodes = found.work, found.nodes
    star = found.shared.where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
    ends = [nodes.select(F.col("rep").alias(x), F.col("n").alias("n" + x), F.col("sketch").alias("s" + x)) for x in "ab"]
    star = work.write(star.join(ends[0], "a").join(ends[1], "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(lean(_likely), "a long, b long"), "star")
    first = connected_components(_links(found, star), work)
    more = _links(found, _bucket_pairs(found, first.select(F.col("node").alias("rep"), "root")))
    whole = connected_components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), work)

    root = whole.select(F.col("node").alias("rep"), F.col("root").alias("component_id"))
    known = found.members.select("doc_id", "rep").distinct().join(root, "rep", "left").select("doc_id", "rep", F.coalesce("component_id", "rep").alias("component_id"))
    if found.names is not None:  # the smallest id of a class or component is that of its members' own ids
        held = found.real(known.withColumn("own", F.col("doc_id")), "own")
        for c in ("rep", "component_id"):
            least = work.write(held.groupBy(c).agg(F.min("own").alias("least")), "least")
            known = known.join(least, c).withColumn(c, F.col("least")).drop("least")
    out = found.real(found.sizes.join(known, "doc_id", "left"), "doc_id")
    return out.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("set_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_links(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links: pairs (a, b, a > b) of classes whose different sets are similar, and the members (doc_id, set_id, n_shingles) of the classes.

    Unlike ``jaccard_components`` this tests every pair of a bucket, also inside
    a component, so it costs what the number of links costs.
    """
    found = _sign(docs, key, text)
    members = found.members.select("doc_id", F.col("rep").alias("set_id"), F.col("n").alias("n_shingles")).distinct()
    return found.real(_links(found, _bucket_pairs(found, None)), "a", "b"), found.real(members, "doc_id", "set_id")


def link_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, set_id, n_links) of the documents with a set: n_links other documents have a similar or the same set.

    Counted by class, so copies are not expanded into pairs.
    """
    pairs, members = jaccard_links(docs, key, text)
    sizes = members.groupBy("set_id").agg(F.count(F.lit(1)).alias("m"))
    ways = pairs.union(pairs.select("b", "a")).toDF("set_id", "other")
    far = ways.join(sizes.toDF("other", "k"), "other").groupBy("set_id").agg(F.sum("k").alias("far"))
    counted = sizes.join(far, "set_id", "left").select("set_id", (F.col("m") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    return members.join(counted, "set_id").select("doc_id", "set_id", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """Documents without near copies: of each component the rows with the smallest doc_id stay.

    A document that has several texts stays if one of them does.
    """
    found = jaccard_components(docs).where("doc_id is not null").groupBy("doc_id").agg(F.min(F.col("doc_id") != F.col("component_id")).alias("copy"))
    gone = Workspace(docs.sparkSession, "copies").write(found.where("copy").select("doc_id"), "gone")
    return docs.join(broadcast_if_few(gone), "doc_id", "left_anti")
