"""Learning state as event folds and latest-row views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions.numbers import DAY_MS, is_same_day, round_half_up
from wordloom.functions.text import normalize_context, trim_all

STATE = "struct<ease:double,interval:bigint,repetitions:bigint,due_at:bigint,updated_at:bigint>"
# The first and the least ease.
FIRST_EASE, LEAST_EASE = 2.5, 1.3


def first_state(now_ms: Column) -> Column:
    return F.struct(F.lit(FIRST_EASE).alias("ease"), F.lit(0).cast("long").alias("interval"), F.lit(0).cast("long").alias("repetitions"), now_ms.cast("long").alias("due_at"), now_ms.cast("long").alias("updated_at"))


def review(state: Column, quality: Column, now_ms: Column) -> Column:
    """The next state.  A failure (below 3) keeps the ease; the interval uses the ease from before."""
    q = F.greatest(F.lit(0), F.least(F.lit(5), round_half_up(quality)))
    failed, reps = q < 3, state["repetitions"] + 1
    miss = (F.lit(5) - q).cast("double")
    ease = F.when(failed, state["ease"]).otherwise(F.greatest(F.lit(LEAST_EASE), state["ease"] + (F.lit(0.1) - miss * (F.lit(0.08) + miss * 0.02))))
    one, six = F.lit(1).cast("long"), F.lit(6).cast("long")
    interval = F.when(failed | (reps == 1), one).when(reps == 2, six).otherwise(round_half_up(state["interval"] * state["ease"]))
    return F.struct(ease.alias("ease"), interval.alias("interval"), F.when(failed, F.lit(0).cast("long")).otherwise(reps).alias("repetitions"), (now_ms + interval * DAY_MS).cast("long").alias("due_at"), now_ms.cast("long").alias("updated_at"))


def fold_reviews(events: DataFrame, keys: list[str], at: str = "at_ms", quality: str = "quality", tie: str = "event_id") -> DataFrame:
    """The state of each key after all its reviews, in order of time and tie.

    A fold needs a key's reviews in order in one task; a key is one word of one
    reader.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), F.col(quality).alias("q"))))
    held = events.where(F.col(at).isNotNull() & F.col(quality).isNotNull()).groupBy(*keys).agg(ordered.alias("log"))
    state = F.aggregate("log", first_state(F.get("log", F.lit(0))["at"]), lambda s, e: review(s, e["q"], e["at"]))
    return held.select(*keys, F.size("log").cast("long").alias("reviews"), state.alias("s")).select(*keys, "reviews", "s.*")


def latest(log: DataFrame, keys: list[str], order: list[str], deleted: str | None = None) -> DataFrame:
    """The last version of each key of a change log; deleted keys are left out.

    Partial aggregation carries one row per key and task.
    """
    row = F.max_by(F.struct(*[c for c in log.columns if c not in keys]), F.struct(*order)).alias("r")
    rows = log.groupBy(*keys).agg(row).select(*keys, "r.*")
    return rows.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else rows


def upsert(table: DataFrame, batch: DataFrame, key: str, order: str, identity: str = "id") -> DataFrame:
    """The table after a batch: the last row of each key wins, rows keep the id of their key.

    New keys get ids after the largest one, in key order.  The key is unique in
    the result.
    """
    names = [c for c in table.columns if c != key]
    fresh = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in names if c != identity]), order).alias("new"))
    both = table.select(key, F.struct(*names).alias("old")).join(fresh, key, "full_outer")
    merged = both.select(key, F.col(f"old.{identity}").alias(identity), *[F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in names if c != identity])
    known = merged.where(F.col(identity).isNotNull())
    most = table.agg(F.coalesce(F.max(identity), F.lit(0)).alias("__most"))
    number = F.row_number().over(Window.partitionBy("__b").orderBy(key))
    added = merged.where(F.col(identity).isNull()).withColumn("__b", F.pmod(F.xxhash64(key), F.lit(64)))
    sizes = added.groupBy("__b").agg(F.count(F.lit(1)).alias("__n")).withColumn("__off", F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)))
    # 64 rows of offsets, each with the largest id so far
    offsets = F.broadcast(sizes.withColumn("__one", F.lit(1)).join(most.withColumn("__one", F.lit(1)), "__one").drop("__one"))
    numbered = added.withColumn("__k", number).join(offsets, "__b")
    ids = (F.col("__most") + F.coalesce("__off", F.lit(0)) + F.col("__k")).cast(table.schema[identity].dataType)
    return known.unionByName(numbered.withColumn(identity, ids).select(known.columns)).select(table.columns)


def without_keys(table: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    return table.join(tombstones.select(key).distinct(), key, "left_anti")


def patch(table: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """One column replaced where a change names the key."""
    new = changes.groupBy(key).agg(F.max(column).alias("__new"))
    return table.join(new, key, "left").withColumn(column, F.coalesce("__new", column)).select(table.columns)


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    """Rows of one key; the filter reaches the Parquet scan."""
    return table.where(F.col(key) == F.lit(value))


def with_setting(settings: DataFrame, key: str = "density", allowed: tuple[str, ...] = ("low", "medium", "high"), default: str = "medium") -> DataFrame:
    """The stored value of a setting if it is allowed, else the default."""
    good = settings.where(F.col("key") == key).agg(F.max(F.when(F.col("value").isin(*allowed), F.col("value"))).alias("value"))
    return good.select(F.lit(key).alias("key"), F.coalesce("value", F.lit(default)).alias("value"))


def due(states: DataFrame, now_ms: Column) -> DataFrame:
    return states.where(F.col("due_at") <= now_ms)


def counters(states: DataFrame, now_ms: Column, created: str = "created_at") -> DataFrame:
    """Total, made today and due, in one pass."""
    return states.agg(F.count(F.lit(1)).alias("total"), F.count_if(is_same_day(F.col(created), now_ms)).alias("today"), F.count_if(F.col("due_at") <= now_ms).alias("due"))


def shelf(progress: DataFrame, handles: DataFrame, key: str) -> DataFrame:
    """Progress with has_handle."""
    return progress.join(handles.select(key, F.lit(True).alias("has_handle")).distinct(), key, "left").withColumn("has_handle", F.coalesce("has_handle", F.lit(False)))


def completions(scrolls: DataFrame, keys: list[str], at: str, percent: str = "percent", least: int = 96) -> DataFrame:
    """When a chapter was first read to the end; not where its first event is at the end already."""
    first = F.min_by(percent, at)
    done = F.min(F.when(F.col(percent) >= least, F.col(at)))
    return scrolls.groupBy(*keys).agg(first.alias("__first"), done.alias("completed_at")).where((F.col("__first") < least) & F.col("completed_at").isNotNull()).drop("__first")


def progress_changes(pages: DataFrame, keys: list[str], page: str = "page", total: str = "total") -> DataFrame:
    """Progress reports: the first, those where the percentage changes, and the last page's."""
    from wordloom.functions.numbers import page_percent

    rows = pages.withColumn("percent", page_percent(F.col(page), F.col(total)))
    before = F.lag("percent").over(Window.partitionBy(*keys).orderBy(page))
    return rows.withColumn("__before", before).where(F.col("__before").isNull() | (F.col("__before") != F.col("percent")) | (F.col(page) == F.col(total))).drop("__before")


#: Characters of a suggestion that a feedback row keeps.
SUGGESTION = 120


def feedback(replacements: DataFrame, now_ms: Column) -> DataFrame:
    """Feedback rows, pending, of replacements (text, en, meaning, part_of_speech, sentence, reason, suggestion)."""
    key = F.concat_ws(":", "text", "en", normalize_context(F.col("sentence"), F.col("text")))
    said = F.left(trim_all(F.coalesce("suggestion", F.lit(""))), F.lit(SUGGESTION))
    return replacements.select(key.alias("key"), "text", "en", "meaning", "part_of_speech", "sentence", "reason", said.alias("suggestion"), now_ms.cast("long").alias("created_at"), F.lit("pending").alias("status"))


def quiz_events(questions: DataFrame, answers: DataFrame, keys: list[str], now_ms: Column) -> DataFrame:
    """One row per submitted quiz: its questions in order and how many were answered right; answers have keys, number and given."""
    fields = [c for c in questions.columns if c not in (*keys, "number")]
    rows = questions.join(answers.select(*keys, "number", "given"), [*keys, "number"])
    right = F.coalesce(F.lower(F.trim("given")) == F.lower(F.trim("answer")), F.lit(False))
    held = F.array_sort(F.collect_list(F.struct("number", *fields))).alias("questions")
    return rows.groupBy(*keys).agg(held, F.count_if(right).alias("correct")).withColumn("created_at", now_ms.cast("long"))


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a history that is only ever appended to."""
    rows.write.mode("append").parquet(path)


def clear(spark: SparkSession, paths: list[str]) -> None:
    """Empties tables: their schema stays, their rows go."""
    for path in paths:
        schema = spark.read.parquet(path).schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def by_time(rows: DataFrame, at: str, tie: str, newest: bool = True) -> DataFrame:
    """Rows in order of a time: newest first (vocabulary, shelf) or oldest first (blacklist)."""
    return rows.orderBy(F.desc(at) if newest else F.asc(at), tie)


def review_queue(states: DataFrame, now_ms: Column, tie: str) -> DataFrame:
    """The due words in the order in which they are asked, the longest overdue first."""
    return by_time(due(states, now_ms), "due_at", tie, newest=False)


def session_stats(ratings: DataFrame, keys: list[str]) -> DataFrame:
    """Per session: words rated, remembered (3 or more), forgotten, and the mean rating."""
    return ratings.groupBy(*keys).agg(F.count(F.lit(1)).alias("rated"), F.count_if(F.col("quality") >= 3).alias("remembered"), F.count_if(F.col("quality") < 3).alias("forgotten"), F.avg("quality").alias("mean_rating"))
