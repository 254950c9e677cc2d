"""Deterministic stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.text import piece
from wordloom.plans.staging import Workspace

# Categories of samples, in the order in which they are served.
CATEGORIES = ("multiple-meaning", "multiple-pos", "overlap", "floating-boundary", "person-name", "book-title", "fixed-phrase", "single-sense")


def category(n_pos: Column, n_meanings: Column, overlaps: Column, left: Column, right: Column, script: str = "[\\u4E00-\\u9FFF]") -> Column:
    """The first that holds: several parts of speech, several meanings, overlap, no clean side, single sense."""
    floating = left.rlike(script) & right.rlike(script)
    return F.when(n_pos > 1, "multiple-pos").when(n_meanings > 1, "multiple-meaning").when(overlaps, "overlap").when(floating, "floating-boundary").otherwise("single-sense")


def book_group(path: Column) -> Column:
    """A group name from a file's stem without brackets, author and separators."""
    stem = F.regexp_replace(F.regexp_extract(path, "([^/\\\\]*?)(?:\\.[^./\\\\]*)?\\z", 1), "[（(][^）)]*[）)]", "")
    stem = F.regexp_replace(F.regexp_replace(stem, "作者[:：].*", ""), "(?U)[\\s_\\-—]+", "")
    stem = F.trim(F.regexp_replace(stem, "[【\\[].*[】\\]]", ""))
    return F.concat(F.lit("book-"), F.substring(F.sha2(stem, 256), 1, 16))


def systematic(candidates: DataFrame, keys: list[str], quota: Column, order: list[str], group: str = "category") -> DataFrame:
    """Evenly spaced rows of each category: of n rows in order, row floor(i n / quota) for i below the quota."""
    window = Window.partitionBy(*keys, group)
    rows = candidates.withColumn("__i", F.row_number().over(window.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(window)).withColumn("__q", quota)
    # row r is picked if some i in [0, min(q, n)) has floor(i n / q) = r; the least such i is ceil(r q / n)
    pick = F.ceil(F.col("__i") * F.col("__q") / F.col("__n")).cast("long")
    hit = (pick < F.least("__q", "__n")) & (F.floor(pick * F.col("__n") / F.col("__q")) == F.col("__i"))
    return rows.where(hit).withColumn("pick", pick).drop("__i", "__n", "__q")


def stratified(candidates: DataFrame, keys: list[str], count: int, order: list[str], categories: tuple[str, ...] = CATEGORIES, group: str = "category") -> DataFrame:
    """Up to ``count`` rows of each document: systematic picks per category, then the first others.

    Categories are served in their order, at least two rows each; a start is
    used once.
    """
    rank = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col(group))
    known = candidates.withColumn("__c", rank)
    quota = F.lit(max(2, count // len(categories)))
    picked = systematic(known.where("__c > 0"), keys, quota, order, group).withColumn("__stage", F.lit(0))
    rest = known.join(picked.select(*keys, *order, group).distinct(), [*keys, *order, group], "left_anti").withColumn("pick", F.lit(0).cast("long")).withColumn("__stage", F.lit(1))
    every = picked.unionByName(rest.select(picked.columns))
    served = [F.col("__stage"), F.when(F.col("__stage") == 0, F.col("__c")), F.col("pick"), *[F.col(c) for c in order], F.col("__c")]
    first = every.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "start").orderBy(*served))).where("__n = 1")
    chosen = first.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*served))).where(F.col("__n") <= count)
    return chosen.drop("__n", "__c", "__stage", "pick")


def hash_ordered(candidates: DataFrame, keys: list[str], count: int, seed: str, categories: tuple[str, ...] = CATEGORIES, group: str = "category") -> DataFrame:
    """Up to ``count`` rows of each document in an order given by SHA-256: a quota per category, then the rest."""
    quota = max(1, count // len(categories))
    name = lambda part: F.sha2(F.concat_ws(":", F.lit(seed), part, F.col("start").cast("string"), F.col("end").cast("string"), F.col(group)), 256)
    rows = candidates.where(F.col(group).isin(*categories)).withColumn("__own", name(F.col(group))).withColumn("__any", name(F.lit("remainder")))
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, group).orderBy("__own", "start", "end")))
    place = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col(group))
    inside = F.col("__r") <= quota
    served = [F.when(inside, 0).otherwise(1), F.when(inside, place), F.when(inside, F.col("__r")), F.col("__any"), F.col("start"), F.col("end")]
    ordinal = F.row_number().over(Window.partitionBy(*keys).orderBy(*served))
    return rows.withColumn("ordinal", ordinal - 1).where(F.col("ordinal") < count).drop("__own", "__any", "__r")


#: Characters on either side of a sample that go with it.
MARGIN = 80


def sample_id(fingerprint: Column, start: Column, end: Column) -> Column:
    return F.concat_ws("-", F.left(fingerprint, F.lit(12)), start.cast("string"), end.cast("string"))


def with_margin(samples: DataFrame, text: Column, start: str = "start", end: str = "end", margin: int = MARGIN) -> DataFrame:
    """Adds context_start, context_end and context, the text around each sample."""
    first, last = F.greatest(F.lit(0), F.col(start) - margin), F.least(F.length(text), F.col(end) + margin)
    return samples.withColumn("context_start", first).withColumn("context_end", last).withColumn("context", piece(text, F.col("context_start"), F.col("context_end")))


def new_candidates(candidates: DataFrame, samples: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """Candidates (fingerprint, start, end) whose sample id is not in the manifest yet."""
    named = candidates.withColumn("id", sample_id(F.col(fingerprint), F.col("start"), F.col("end")))
    return named.join(samples.select("id").distinct(), "id", "left_anti")


def ranked(pool: DataFrame, order: list[str], group: str) -> DataFrame:
    """Adds __i, the 0-based rank of each row in its group, and __n, the group's size.

    Rows are written in a range partition over (group, order); a rank is the
    place inside the part plus the rows of the group in the parts before, so a
    group of any size is ranked by many tasks.
    """
    work = Workspace(pool.sparkSession, "ranks")
    keys = [F.col(c) for c in (group, *order)]
    parts = work.write(pool.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "parts")
    counts = parts.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__m"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.withColumn("__off", F.coalesce(F.sum("__m").over(before), F.lit(0))).withColumn("__n", F.sum("__m").over(Window.partitionBy(group))).drop("__m")
    place = F.row_number().over(Window.partitionBy("__part", group).orderBy(*order))
    ranked = parts.withColumn("__k", place).join(sums, [group, "__part"])
    return ranked.withColumn("__i", F.col("__k") - 1 + F.col("__off")).drop("__part", "__k", "__off")


def annotation_pack(pool: DataFrame, limit: int, order: list[str], n_categories: int) -> DataFrame:
    """At most ``limit`` samples, systematic per category with quota ceil(limit / categories), then the first others.

    No category is null.  ``order`` is a total order, but for equal rows.
    """
    quota = F.lit(-(-limit // max(1, n_categories)))
    rows = ranked(pool, order, "category")
    pick = F.ceil(F.col("__i") * quota / F.col("__n")).cast("long")
    hit = (pick < F.least(quota, F.col("__n"))) & (F.floor(pick * F.col("__n") / quota) == F.col("__i"))
    picked = rows.where(hit).withColumn("pick", pick).drop("__i", "__n").withColumn("__stage", F.lit(0))
    rest = pool.join(picked.select(*order).distinct(), order, "left_anti").withColumn("pick", F.lit(0).cast("long")).withColumn("__stage", F.lit(1))
    both = picked.unionByName(rest.select(picked.columns))
    top = both.orderBy("__stage", F.when(F.col("__stage") == 0, F.col("category")), "pick", *order).limit(limit)
    return top.drop("__stage", "pick")
