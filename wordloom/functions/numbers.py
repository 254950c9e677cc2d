"""Numeric expressions: ratios, Wilson intervals, rounding, reading progress, relative time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the normal quantile of a 95 % interval.
Z95 = 1.959963984540054
DAY_MS = 86_400_000


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; 0 where the whole is 0 or null."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


def round_half_up(value: Column) -> Column:
    """To the nearest long, halves upwards."""
    return F.floor(value.cast("double") + F.lit(0.5)).cast("long")


def wilson95(successes: Column, trials: Column) -> Column:
    """struct<lower, upper> of the 95 % score interval, clamped to [0, 1]; (0, 0) without trials."""
    n, z2 = trials.cast("double"), Z95 * Z95
    share = successes.cast("double") / n
    spread = F.sqrt((share * (F.lit(1.0) - share) + F.lit(z2) / (n * 4)) / n) * F.lit(Z95)
    middle, scale = share + F.lit(z2) / (n * 2), F.lit(1.0) + F.lit(z2) / n
    low, high = F.greatest(F.lit(0.0), middle / scale - spread / scale), F.least(F.lit(1.0), middle / scale + spread / scale)
    none = F.coalesce(trials, F.lit(0)) == 0
    return F.struct(F.when(none, F.lit(0.0)).otherwise(low).alias("lower"), F.when(none, F.lit(0.0)).otherwise(high).alias("upper"))


def scroll_percent(top: Column, most: Column) -> Column:
    """Reading progress of a scroll position; 100 where nothing overflows."""
    return F.when(most <= 0, F.lit(100).cast("long")).otherwise(F.least(F.lit(100).cast("long"), round_half_up(top / most * 100)))


def page_percent(page: Column, total: Column) -> Column:
    """Progress between 38 and 95 while pages load."""
    return F.lit(38).cast("long") + round_half_up(page / total * 57)


def clamp_index(index: Column, count: Column) -> Column:
    return F.greatest(F.lit(0), F.least(count - 1, index))


def relative_time(then_ms: Column, now_ms: Column) -> Column:
    """刚刚, N 分钟前, N 小时前, N 天前 (under 14), else year/month/day."""
    minutes = F.floor((now_ms - then_ms) / 60_000).cast("long")
    hours, days = F.floor(minutes / 60).cast("long"), F.floor(minutes / 1440).cast("long")
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    date = F.date_format(F.timestamp_millis(then_ms), "yyyy/M/d")
    return F.when(minutes < 1, F.lit("刚刚")).when(minutes < 60, ago(minutes, " 分钟前")).when(hours < 24, ago(hours, " 小时前")).when(days < 14, ago(days, " 天前")).otherwise(date)


def due_label(due_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(due_ms), "M/d")


def is_same_day(a_ms: Column, b_ms: Column) -> Column:
    """Same calendar day in the session's time zone."""
    return F.to_date(F.timestamp_millis(a_ms)) == F.to_date(F.timestamp_millis(b_ms))
