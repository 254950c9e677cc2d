"""Labelled quality: reports with Wilson intervals, promotions, audits, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wordloom.functions.numbers import ratio, wilson95
from wordloom.plans.staging import Workspace

from .sampling import ranked


def judged(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Labels with their prediction (the last of an id by ord; none means keep) and boolean outcomes."""
    last = predictions.groupBy("id").agg(F.max_by(F.struct("decision", "candidate_id", "part_of_speech", "segmentation_correct"), "ord").alias("p"))
    rows = labels.join(last, "id", "left")
    attempted = F.coalesce(F.col("p.decision") == "replace", F.lit(False))
    wanted = F.col("expected_decision") == "replace"
    exact = attempted & F.coalesce(F.col("p.segmentation_correct"), F.lit(False))
    right = wanted & exact & F.coalesce(F.col("p.candidate_id") == F.col("expected_candidate_id"), F.col("p.candidate_id").isNull() & F.col("expected_candidate_id").isNull())
    spoken = F.col("expected_part_of_speech").isNotNull() & (F.col("expected_part_of_speech") != "")
    return rows.select(
        *labels.columns, attempted.alias("attempted"), wanted.alias("wanted"), exact.alias("exact"), right.alias("right"), spoken.alias("has_pos"),
        (spoken & right & F.coalesce(F.col("p.part_of_speech") == F.col("expected_part_of_speech"), F.lit(False))).alias("right_pos"),
        (~wanted & ~attempted).alias("right_keep"), F.col("p.candidate_id").alias("predicted_id"),
    )


_COUNTS = {"total": None, "expected_replacements": "wanted", "actual_replacements": "attempted", "correct_replacements": "right", "correct_segments": "exact", "pos_expected": "has_pos", "pos_correct": "right_pos", "correct_keeps": "right_keep"}
_RATIOS = {
    "segmentation_precision": ("correct_segments", "actual_replacements"), "candidate_accuracy": ("correct_replacements", "expected_replacements"),
    "part_of_speech_accuracy": ("pos_correct", "pos_expected"), "replacement_precision": ("correct_replacements", "actual_replacements"),
    "replacement_coverage": ("correct_replacements", "expected_replacements"), "replacement_rate": ("actual_replacements", "total"),
}


def _sums() -> list[Column]:
    return [(F.count(F.lit(1)) if flag is None else F.count_if(F.col(flag))).alias(name) for name, flag in _COUNTS.items()]


def report(outcomes: DataFrame, by: list[str] | None = None, intervals: bool = True) -> DataFrame:
    """Counts, ratios and 95 % intervals in one aggregation, over all or per group."""
    return _figures((outcomes.groupBy(*by) if by else outcomes.groupBy()).agg(*_sums()), intervals)


def reports(outcomes: DataFrame, genres: DataFrame, key: str) -> DataFrame:
    """The reports over all, per split and category, and per genre (column level), as grouping sets of one aggregation.

    An outcome is one row without a genre and one for each of its genres, so a
    level takes the rows that are its own.  Without outcomes there are no rows.
    """
    own = genres.select(key, F.array_distinct("genres").alias("__genres"))
    none = F.array(F.lit(None).cast("string"))
    each = outcomes.join(own, key, "left").withColumn("genre", F.explode(F.concat(none, F.coalesce(F.array_compact("__genres"), F.array().cast("array<string>")))))
    each = each.withColumn("__whole", F.col("genre").isNull())
    whole, split, category, genre = (F.col(c) for c in ("__whole", "split", "category", "genre"))
    sums = each.groupingSets([[whole], [whole, split, category], [whole, genre]], whole, split, category, genre).agg(F.grouping("split").alias("__no_split"), F.grouping("genre").alias("__no_genre"), *_sums())
    level = F.when(F.col("__no_genre") == 0, "genre").when(F.col("__no_split") == 0, "category").otherwise("all")
    named = sums.withColumn("level", level).where(F.col("__whole") == (F.col("level") != "genre"))
    return _figures(named.select("level", "split", "category", "genre", *_COUNTS))


def _figures(sums: DataFrame, intervals: bool = True) -> DataFrame:
    """Sums with their ratios and intervals."""
    keeps = F.col("total") - F.col("expected_replacements")
    out = sums.select("*", *[ratio(F.col(a), F.col(b)).alias(name) for name, (a, b) in _RATIOS.items()], ratio(F.col("correct_keeps"), keeps).alias("abstention_accuracy"))
    if intervals:
        for name, (a, b) in _RATIOS.items():
            ci = wilson95(F.col(a), F.col(b))
            out = out.withColumn(f"{name}_lower", ci["lower"]).withColumn(f"{name}_upper", ci["upper"])
    return out


def by_genre(outcomes: DataFrame, genres: DataFrame, key: str) -> DataFrame:
    """The report per genre; a row counts for each of its genres (column genres, an array)."""
    each = genres.select(key, F.explode(F.array_distinct("genres")).alias("genre"))
    return report(outcomes.join(each, key), ["genre"], intervals=False)


def predictions(samples: DataFrame, matches: DataFrame, safe: DataFrame, key: str = "id") -> DataFrame:
    """A prediction per sample from matches on its text (key, start, end, candidate_id, part_of_speech).

    The decision is to replace if a match has exactly the sample's span and is
    safe.  Segmentation is right for samples to keep if no safe match overlaps
    the span, for others if an exact match exists.
    """
    rows = samples.select(key, F.col("start").alias("s"), F.col("end").alias("e"), "expected_decision")
    good = safe.select(key, "start", "end", F.lit(True).alias("__safe")).distinct()
    exact = rows.join(matches.join(good, [key, "start", "end"], "left"), key).where("start = s AND end = e").groupBy(key).agg(F.max_by(F.struct("candidate_id", "part_of_speech"), F.coalesce("__safe", F.lit(False))).alias("m"), F.max(F.coalesce("__safe", F.lit(False))).alias("ok"))
    touched = rows.join(safe.select(key, "start", "end"), key).where("start < e AND end > s").select(key).distinct().withColumn("touched", F.lit(True))
    both = rows.join(exact, key, "left").join(touched, key, "left")
    replace = F.coalesce("ok", F.lit(False))
    right = F.when(F.col("expected_decision") == "keepChinese", F.col("touched").isNull()).otherwise(F.col("m").isNotNull())
    return both.select(key, F.when(replace, "replace").otherwise("keepChinese").alias("decision"), F.col("m.candidate_id").alias("candidate_id"), F.col("m.part_of_speech").alias("part_of_speech"), right.alias("segmentation_correct"))


def diagnostics(matches: DataFrame) -> DataFrame:
    """Matches per source, reason and boundary, and how many are certain."""
    return matches.groupBy("source", "reason", "boundary_confidence").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") == "high").alias("n_high"))


def per_candidate(outcomes: DataFrame) -> DataFrame:
    """Per predicted candidate: attempts, right ones, categories."""
    return outcomes.where("attempted").groupBy("predicted_id").agg(F.count(F.lit(1)).alias("actual"), F.count_if("right").alias("correct"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))


def top_errors(candidates: DataFrame, n: int = 30) -> DataFrame:
    """The candidates with most wrong attempts (TakeOrderedAndProject)."""
    return candidates.withColumn("wrong", F.col("actual") - F.col("correct")).orderBy(F.desc("wrong"), F.desc("actual"), "predicted_id").limit(n)


def leaks(rows: DataFrame, group: str = "group_id", split: str = "split") -> DataFrame:
    """Groups in more than one split; must be empty."""
    return rows.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def merge_labels(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """Samples with the last label (by ord) of their id; invalid labels raise."""
    last = labels.groupBy("id").agg(F.max_by(F.struct("decision", "candidate_id", "part_of_speech"), "ord").alias("l"))
    bad = ~F.col("l.decision").isin("replace", "keepChinese") | ((F.col("l.decision") == "replace") & (F.col("l.candidate_id").isNull() | F.col("l.part_of_speech").isNull()))
    checked = last.withColumn("l", F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit("bad label: "), F.col("id").cast("string")))).otherwise(F.col("l")))
    rows = samples.join(checked, "id", "left")
    new = {"expected_decision": "decision", "expected_candidate_id": "candidate_id", "expected_part_of_speech": "part_of_speech"}
    for column, field in new.items():
        rows = rows.withColumn(column, F.when(F.col("l").isNotNull(), F.col(f"l.{field}")).otherwise(F.col(column)))
    return rows.withColumn("annotation_status", F.when(F.col("l").isNotNull(), F.lit("reviewed")).otherwise(F.col("annotation_status"))).drop("l")


def promotions(samples: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Candidates nominated by development labels, rejected by validation, decided by a reviewer.

    ``samples`` has term, split, annotation_status, expected_decision,
    expected_candidate_id and review_status; blind rows are never read.
    """
    reviewed = samples.where("annotation_status = 'reviewed'")
    named = reviewed.where("split = 'development' AND expected_decision = 'replace' AND expected_candidate_id <> ''")
    found = named.groupBy(F.col("expected_candidate_id").alias("candidate_id")).agg(F.min("term").alias("term"), F.count(F.lit(1)).alias("development_support"), F.count_if(F.col("review_status").isin("corrected", "agree")).alias("review_support"))
    against = reviewed.where("split = 'validation' AND expected_decision = 'keepChinese'").groupBy("term").agg(F.count(F.lit(1)).alias("conflicts"))
    said = verdicts.groupBy("candidate_id").agg(F.max("verdict").alias("verdict"))
    rows = found.join(against, "term", "left").join(said, "candidate_id", "left").withColumn("conflicts", F.coalesce("conflicts", F.lit(0).cast("long")))
    status = (
        F.when((F.col("development_support") < 2) | (F.col("conflicts") > 0), "needs-rule-or-more-evidence")
        .when(F.col("verdict") == "approve", "approved-for-production-batch").when(F.col("verdict") == "reject", "rejected-by-sol")
        .when(F.col("verdict") == "needs-rule", "needs-context-rule").otherwise("pending-sol-review")
    )
    return rows.select("candidate_id", "term", "development_support", "review_support", "conflicts", "verdict", status.alias("status"))


def candidate_audit(approved_rows: DataFrame, policy: DataFrame, entries: DataFrame, overrides: DataFrame) -> DataFrame:
    """One row: effective, duplicate, stable, contextual, blocked and missing counts of the approved ids."""
    term = F.element_at(F.split("candidate_id", ":"), 1)
    ids = approved_rows.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n")).withColumn("term", term)
    known = entries.select(F.concat_ws(":", "zh", "en", "part_of_speech").alias("candidate_id"), F.lit(True).alias("k")).distinct()
    over = overrides.select(F.col("zh").alias("term"), F.lit(True).alias("o")).distinct()
    rows = ids.join(policy.select("term", "mode"), "term", "left").join(known, "candidate_id", "left").join(over, "term", "left")
    live = F.coalesce(F.col("mode") != "blocked", F.lit(True))
    context = F.coalesce(F.col("mode") == "contextual", F.lit(False))
    return rows.agg(
        F.count_if(live).alias("effective"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.count_if(live & ~context).alias("stable"),
        F.count_if(live & context).alias("contextual"), F.count_if(~live).alias("blocked"), F.count_if(live & F.col("k").isNull() & F.col("o").isNull()).alias("missing"),
    )


def pair_counts(replacements: DataFrame, book: str, top: int = 8) -> DataFrame:
    """The most frequent word pairs of each book."""
    from pyspark.sql import Window

    counts = replacements.groupBy(book, "text", "en").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(book).orderBy(F.desc("n"), "text", "en"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top)


def phonetic_coverage(matches: DataFrame, book: str) -> DataFrame:
    """Share of each book's matches that have a phonetic."""
    return matches.groupBy(book).agg(F.count(F.lit(1)).alias("matches"), F.avg((F.coalesce("phonetic", F.lit("")) != "").cast("double")).alias("phonetic_coverage"))


def approval_sets(outcomes: DataFrame) -> DataFrame:
    """Rows (candidate_id, verdict): approved by development (a right attempt in a plain category) or failed in validation (any wrong one)."""
    tried = outcomes.where("attempted AND predicted_id IS NOT NULL")
    hit = (F.col("expected_decision") == "replace") & F.coalesce(F.col("predicted_id") == F.col("expected_candidate_id"), F.lit(False))
    approved = tried.where((F.col("split") == "development") & F.col("category").isin("single-sense", "overlap") & hit).select(F.col("predicted_id").alias("candidate_id"), F.lit("approved").alias("verdict"))
    failed = tried.where((F.col("split") == "validation") & ~hit).select(F.col("predicted_id").alias("candidate_id"), F.lit("failed").alias("verdict"))
    return approved.distinct().unionByName(failed.distinct())


def corpus_attempts(samples: DataFrame, replacements: DataFrame, path: str, split: str = "blind") -> DataFrame:
    """One row (books, attempts): replacements in all books that have a sample of a split, each book once."""
    books = samples.where(F.col("split") == split).select(path).distinct()
    counted = replacements.groupBy(path).agg(F.count(F.lit(1)).alias("n"))
    return books.join(counted, path, "left").agg(F.count(F.lit(1)).alias("books"), F.coalesce(F.sum("n"), F.lit(0)).alias("attempts"))


def baseline_report(samples: DataFrame, matches: DataFrame, key: str = "id") -> DataFrame:
    """One row over reviewed blind samples: every exact match counts as an attempt, without the safety gate."""
    rows = samples.where("annotation_status = 'reviewed' AND split = 'blind'")
    exact = matches.groupBy(key, "start", "end").agg(F.min(F.struct("candidate_id", "part_of_speech")).alias("m"))
    met = rows.join(exact, [key, "start", "end"], "left")
    wanted, tried = F.col("expected_decision") == "replace", F.col("m").isNotNull()
    right = F.coalesce(wanted & tried & (F.col("m.candidate_id") == F.col("expected_candidate_id")), F.lit(False))
    spoken = F.coalesce(F.col("expected_part_of_speech") != "", F.lit(False))
    flags = met.select(wanted.alias("wanted"), tried.alias("attempted"), right.alias("right"), tried.alias("exact"), spoken.alias("has_pos"), (spoken & right & F.coalesce(F.col("m.part_of_speech") == F.col("expected_part_of_speech"), F.lit(False))).alias("right_pos"), F.lit(False).alias("right_keep"))
    return report(flags, intervals=False).drop("correct_keeps", "abstention_accuracy")


def require_coverage(samples: DataFrame, least: int, splits: list[str], categories: list[str]) -> DataFrame:
    """One row of counts over reviewed samples; raises if there are too few, or if a split or a category is missing."""
    sums = samples.where("annotation_status = 'reviewed'").agg(F.count(F.lit(1)).alias("reviewed"), F.array_sort(F.collect_set("split")).alias("splits"), F.array_sort(F.collect_set("category")).alias("categories"))
    fine = (F.col("reviewed") >= least) & (F.col("splits") == F.array_sort(F.array(*[F.lit(x) for x in splits]))) & (F.size(F.array_except(F.array(*[F.lit(x) for x in categories]), "categories")) == 0)
    return sums.withColumn("reviewed", F.when(fine, F.col("reviewed")).otherwise(F.raise_error(F.lit("the reviewed samples do not cover what is required"))))


#: The collation of proposals: Chinese words by their sound.
LOCALE = "zh"


def proposal(promoted: DataFrame) -> DataFrame:
    """Promotions with ``place`` (long, from 1): most support first, then by id in the order of the locale.

    Ids that the locale holds equal go by their characters.  Places come from a
    range partition, so no task holds all promotions.
    """
    order = ["__support", "__sound", "candidate_id"]
    ready = promoted.withColumn("__support", -F.col("development_support")).withColumn("__sound", F.collate("candidate_id", LOCALE)).withColumn("__all", F.lit(1))
    placed = ranked(ready, order, "__all").withColumn("place", F.col("__i") + 1)
    return placed.select(*promoted.columns, "place").orderBy("place")


def observed_diagnostics(matches: DataFrame, work: Workspace, name: str = "matches") -> tuple[DataFrame, DataFrame]:
    """The written matches, and ``diagnostics`` of them gathered while they were written."""
    sources, reasons, edges = ("segment", "scan", "both"), ("correction", "context", "priority", "ambiguous"), range(3)
    cells = [(s, r, b) for s in sources for r in reasons for b in edges]
    met = Observation(f"{name}-diagnostics")
    here = lambda s, r, b: (F.col("source") == s) & (F.col("reason") == r) & (F.col("boundary_confidence") == b)
    counts = [F.count_if(here(*c)).alias(f"n{i}") for i, c in enumerate(cells)] + [F.count_if(here(*c) & (F.col("confidence") == "high")).alias(f"h{i}") for i, c in enumerate(cells)]
    written = work.write(matches.observe(met, F.count(F.lit(1)).alias("rows"), *counts), name)
    figures = met.get
    if figures["rows"] != sum(figures[f"n{i}"] for i in range(len(cells))):
        raise ValueError("a match has a source, reason or boundary that is not known")
    rows = [(*c, figures[f"n{i}"], figures[f"h{i}"]) for i, c in enumerate(cells) if figures[f"n{i}"]]
    return written, matches.sparkSession.createDataFrame(rows, "source string, reason string, boundary_confidence int, n long, n_high long")


def gate(one_report: DataFrame, least: dict[str, float]) -> DataFrame:
    """The report with ``passed``: every named figure reaches its least value."""
    passed: Column = F.lit(True)
    for name, value in least.items():
        passed = passed & (F.col(name) >= F.lit(value))
    return one_report.withColumn("passed", passed)
