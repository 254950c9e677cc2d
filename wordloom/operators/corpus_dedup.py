"""Near-duplicate audit of files: bottom-k sketches of 20-grams, shared-hash pairs, groups.

The sketch keeps the k smallest distinct hashes of all 20-grams of the letters
and digits of a text.  A hash is the polynomial sum of its characters modulo
2^32; all windows of a text come from one vectorised convolution.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, LongType

from wordloom.functions.hashing import split_name
from wordloom.functions.numbers import ratio
from wordloom.functions.text import nfkc
from wordloom.plans.staging import Workspace
from wordloom.plans.workers import in_slices

from .components import connected_components
from .digests import ordered_digest

# Fixed values of the sketch.
WIDTH, SIZE, BASE, THRESHOLD = 20, 256, 16777619, 0.9
#: Hashes of more files than this are matched in salted slices.
HOT = 2000


def letters_only(text: Column) -> Column:
    return F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), "[^\\u4E00-\\u9FFFA-Za-z0-9]", "")


def _window_sums(codes: np.ndarray, width: int) -> np.ndarray:
    """The hashes of all windows of so many characters, modulo 2^32: windows are doubled, and those of the width's binary digits joined."""
    out, have = codes[:0], 0
    part, size = codes.astype(np.uint32), 1  # the hashes of windows of ``size``

    def joined(left: np.ndarray, right: np.ndarray, skip: int) -> np.ndarray:
        n = max(len(codes) - skip - size + 1, 0)
        return left[:n] * np.uint32(pow(BASE, size, 1 << 32)) + right[skip : skip + n]

    while True:
        if width & size:
            out = joined(out, part, have) if have else part
            have += size
        if have == width:
            return out
        part, size = joined(part, part, size), 2 * size


def _smallest(values: np.ndarray, size: int) -> np.ndarray:
    """The smallest different values, in order; all are sorted only if there are few of them."""
    most = 2 * size
    while most < len(values):
        found = np.unique(np.partition(values, most)[:most])
        if len(found) > size:
            return found[:size]
        most *= 4
    return np.unique(values)[:size]


def _codes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def _letter_codes(text: str | None) -> np.ndarray:
    """The code points that ``letters_only`` leaves."""
    codes = _codes(unicodedata.normalize("NFKC", text or ""))
    keep = np.zeros(len(codes), bool)
    for first, last in ("09", "AZ", "az", "\u4e00\u9fff"):
        keep |= (codes >= ord(first)) & (codes <= ord(last))
    return codes[keep]


def sketch_of(text: str | None, width: int = WIDTH, size: int = SIZE) -> np.ndarray:
    return _sketch(_codes(text), width, size)


def _sketch(codes: np.ndarray, width: int = WIDTH, size: int = SIZE) -> np.ndarray:
    if len(codes) < width:
        return np.empty(0, np.int64)
    return _smallest(_window_sums(codes, width), size).astype(np.int64)


@in_slices
def _bottom_k(text: pa.Array) -> pa.Array:
    return pa.array([sketch_of(x) for x in text.to_pylist()], pa.list_(pa.int64()))


@in_slices
def _letter_sketch(text: pa.Array) -> pa.Array:
    return pa.array([_sketch(_letter_codes(x)) for x in text.to_pylist()], pa.list_(pa.int64()))


#: Column functions: the sketch of each text, and that of its letters and digits alone, in one pass.
bottom_k, letter_sketch = arrow_udf(_bottom_k, ArrayType(LongType())), arrow_udf(_letter_sketch, ArrayType(LongType()))


def candidate_pairs(sketches: DataFrame, key: str, threshold: float = THRESHOLD, signature: str = "signature") -> DataFrame:
    """Rows (a, b), a < b: every pair of sketches that can reach the threshold.

    The hashes of a sketch are put in one order for all, the rarest first.  To
    share c of its n hashes with a larger sketch, the smaller one must share one
    of its first n - c + 1, and the larger one of its first m - c + 1, and enough
    hashes must follow both places.  Hashes of one file alone come first and
    match nothing, so most files have nothing left to probe with, and common
    hashes probe last.  A hash that many files hold is dealt out by a salt on one
    side and copied to all salts on the other, so no task gets all of its pairs.
    """
    held = sketches.select(F.col(key).alias("id"), F.size(signature).alias("n"), F.explode(signature).alias("h"))
    counts = held.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    order = Window.partitionBy("id")
    shared = held.join(counts, "h").withColumn("pos", F.row_number().over(order.orderBy("m", "h")) + F.col("n") - F.count(F.lit(1)).over(order))
    least = lambda n: F.floor(n * F.lit(threshold)).cast("int")
    salts = F.ceil(F.col("m") / HOT).cast("int")
    probe = shared.where(F.col("pos") <= F.col("n") - least(F.col("n")) + 1)
    left = probe.select("h", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    right = shared.select("h", "id", "n", "pos", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"))
    needed = least(F.col("nx"))
    pairs = left.join(right, ["h", "salt"]).where("nx < n OR (nx = n AND x < id)").where((F.col("pos") <= F.col("n") - needed + 1) & (1 + F.least(F.col("nx") - F.col("px"), F.col("n") - F.col("pos")) >= needed))
    return pairs.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct()


def similar_sketches(sketches: DataFrame, key: str, threshold: float = THRESHOLD, signature: str = "signature") -> DataFrame:
    """Rows (a, b, similarity), a < b: shared hashes over the smaller sketch, at least the threshold."""
    side = lambda x: sketches.select(F.col(key).alias(x), F.col(signature).alias(f"s{x}"))
    both = candidate_pairs(sketches, key, threshold, signature).join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", ratio(shared, F.least(F.size("sa"), F.size("sb"))).alias("similarity")).where(F.col("similarity") >= threshold)


def _nodes(sketches: DataFrame, key: str, signature: str) -> tuple[DataFrame, DataFrame]:
    """The first file of each sketch (key, signature), and the other files with theirs (id, node); empty sketches go."""
    full = sketches.where(F.size(signature) > 0)
    named = full.select(F.col(key).alias("id"), F.sha2(F.array_join(F.col(signature).cast("array<string>"), ","), 256).alias("__digest"))
    firsts = named.groupBy("__digest").agg(F.min("id").alias("node"))
    copies = named.join(firsts, "__digest").where("id <> node").select("id", "node")
    nodes = full.join(firsts.select(F.col("node").alias(key)), key, "left_semi").select(signature, key)
    return nodes, copies


def near_links(sketches: DataFrame, key: str, threshold: float = THRESHOLD, signature: str = "signature") -> DataFrame:
    """Rows (a, b, similarity): pairs between the first files of different sketches, and every other file with the first of its sketch."""
    nodes, copies = _nodes(sketches, key, signature)
    return similar_sketches(nodes, key, threshold, signature).unionByName(copies.select(F.col("node").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity")))


def groups(files: DataFrame, key: str, links: DataFrame, seed: str | None = None, prefix: str = "book-") -> DataFrame:
    """Rows (key, root, group_id, split): components, named by their members, and their split.

    The name depends on membership alone, as the digest of all sorted members,
    which stream through one task.  A file without links is a group.
    """
    work = Workspace(files.sparkSession, "groups")
    roots = connected_components(links, work)
    member = files.select(F.col(key).alias("node")).distinct().join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = ordered_digest(member, ["root"], "node", ":", 16, "group_id").withColumn("group_id", F.concat(F.lit(prefix), "group_id"))
    name = F.col("group_id") if seed is None else F.concat_ws(":", F.lit(seed), "group_id")
    return member.join(named, "root").select(F.col("node").alias(key), "root", "group_id", split_name(name, 2 if seed is None else 8).alias("split"))


def edges_of(pairs: DataFrame, files: DataFrame, path: str = "path", key: str = "fingerprint") -> DataFrame:
    """Rows (a, b): pairs of paths (left_path, right_path) as pairs of fingerprints; a path without a file raises."""
    out = pairs
    for side, name in (("left_path", "a"), ("right_path", "b")):
        known = files.select(F.col(path).alias(side), F.col(key).alias(name))
        out = out.join(known, side, "left").withColumn(name, F.coalesce(name, F.raise_error(F.concat(F.lit("no file for "), side)).cast(files.schema[key].dataType)))
    return out.select("a", "b")


def repartitioned(samples: DataFrame, grouped: DataFrame, key: str) -> DataFrame:
    """Samples with the group and split of their file; a sample without a file raises."""
    found = samples.drop("group_id", "split").join(grouped.select(key, "group_id", "split"), key, "left")
    return found.withColumn("group_id", F.coalesce("group_id", F.raise_error(F.concat(F.lit("no file for sample of "), F.col(key).cast("string"))).cast("string")))
