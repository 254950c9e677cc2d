"""Queries over learning state: reviews, latest views, upserts, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators import learning, selection

from .inputs import NOW_MS, SQL_REV, reviews, table


def q_sm2_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = learning.fold_reviews(reviews(spark, sf_dir), ["key"])
    return states.withColumn("ease", F.round("ease", 6))


def q_due_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = learning.fold_reviews(reviews(spark, sf_dir), ["key"])
    return learning.due(states, F.lit(NOW_MS)).select("key", "due_at", "interval")


def q_due_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir).select(F.col("at_ms").alias("created_at"), (F.col("at_ms") + F.col("quality") * 86_400_000 * 3).alias("due_at"))
    return learning.counters(rows, F.lit(NOW_MS - 2 * 86_400_000))


def q_latest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = reviews(spark, sf_dir).select("key", "at_ms", "event_id", "event_type", "value")
    return learning.latest(log, ["key"], ["at_ms", "event_id"])


def q_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = reviews(spark, sf_dir).withColumn("deleted", F.col("quality") == 0).select("key", "at_ms", "event_id", "deleted")
    return learning.latest(log, ["key"], ["at_ms", "event_id"], deleted="deleted").select("key", "event_id")


def q_shelf_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("title"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    return learning.shelf(customers, orders, "key")


def q_completion_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    scrolls = reviews(spark, sf_dir).withColumn("at", F.col("at_ms") * 1_000_000 + F.col("event_id")).withColumn("percent", F.least(F.lit(100).cast("long"), F.floor(F.col("value")).cast("long")))
    return learning.completions(scrolls.select("key", "at", "percent"), ["key"], "at")


def q_upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with ids take a batch of orders: the last order of a key wins, ids stay."""
    held = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") + 7).alias("id"), F.lit(0).cast("long").alias("at"), F.col("c_mktsegment").alias("value"))
    batch = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.lit(None).cast("long").alias("id"), F.col("o_orderkey").alias("at"), F.col("o_orderpriority").alias("value"))
    merged = learning.upsert(held, batch, "key", "at")
    known = F.col("key") % 3 != 0
    return merged.select("key", "at", "value", F.when(known, F.col("id")).alias("kept_id"), F.count(F.lit(1)).over(_ids()).alias("rows_of_id"))


def _ids():
    from pyspark.sql import Window

    return Window.partitionBy("id")


def q_delete_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.without_keys(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s_suppkey")).where("s_suppkey % 7 = 0"), "s_suppkey")


def q_patch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    changes = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("submitted").alias("o_orderstatus"))
    return learning.patch(held, changes, "o_orderkey", "o_orderstatus")


def q_keyed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.lookup(table(spark, sf_dir, "orders"), "o_custkey", 7).select("o_orderkey", "o_orderstatus")


def q_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = table(spark, sf_dir, "nation").select(F.lit("density").alias("key"), F.lower("n_name").alias("value"))
    return learning.with_setting(settings)


def q_quiz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit(" "), F.lower("o_orderstatus")).alias("given"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise(F.lit("x")).alias("answer"))
    return selection.quiz_score(answers, ["o_custkey"])


QUERIES = {f.__name__: f for f in (
    q_sm2_fold, q_due_reviews, q_due_counts, q_latest_progress, q_tombstones, q_shelf_join, q_completion_trigger, q_upsert_merge,
    q_delete_keys, q_patch_status, q_keyed_lookup, q_setting, q_quiz_score,
)}

_FOLD = f"""
WITH RECURSIVE {SQL_REV},
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_ms, event_id) AS k FROM rev),
f AS (SELECT key, 0::BIGINT AS k, 2.5::DOUBLE AS ease, 0::BIGINT AS interval, 0::BIGINT AS repetitions, 0::BIGINT AS at_ms FROM n WHERE k = 1
  UNION ALL
  SELECT n.key, n.k, CASE WHEN quality < 3 THEN ease ELSE greatest(1.3::DOUBLE, ease + (0.1::DOUBLE - (5 - quality)::DOUBLE * (0.08::DOUBLE + (5 - quality)::DOUBLE * 0.02::DOUBLE))) END,
    CASE WHEN quality < 3 OR repetitions = 0 THEN 1 WHEN repetitions = 1 THEN 6 ELSE floor(interval * ease + 0.5::DOUBLE)::BIGINT END,
    CASE WHEN quality < 3 THEN 0 ELSE repetitions + 1 END, n.at_ms
  FROM f JOIN n ON n.key = f.key AND n.k = f.k + 1),
l AS (SELECT key, max(k) AS reviews, max_by(ease, k) AS ease, max_by(interval, k) AS interval, max_by(repetitions, k) AS repetitions, max_by(at_ms, k) AS updated_at FROM f GROUP BY key)
"""

ORACLES = {
    "q_sm2_fold": _FOLD + "SELECT key, reviews, round(ease, 6) AS ease, interval, repetitions, updated_at + interval * 86400000 AS due_at, updated_at FROM l",
    "q_due_reviews": _FOLD + f"SELECT key, updated_at + interval * 86400000 AS due_at, interval FROM l WHERE updated_at + interval * 86400000 <= {NOW_MS}",
    "q_due_counts": f"WITH {SQL_REV}, n AS (SELECT {NOW_MS - 2 * 86_400_000} AS now) SELECT count(*)::BIGINT AS total, count(*) FILTER (at_ms // 86400000 = now // 86400000)::BIGINT AS today, count(*) FILTER (at_ms + quality * 86400000 * 3 <= now)::BIGINT AS due FROM rev, n",
    "q_latest_progress": f"WITH {SQL_REV} SELECT key, at_ms, event_id, event_type, value FROM rev QUALIFY row_number() OVER (PARTITION BY key ORDER BY at_ms DESC, event_id DESC) = 1",
    "q_tombstones": f"WITH {SQL_REV}, l AS (SELECT * FROM rev QUALIFY row_number() OVER (PARTITION BY key ORDER BY at_ms DESC, event_id DESC) = 1) SELECT key, event_id FROM l WHERE quality <> 0",
    "q_shelf_join": "SELECT c_custkey AS key, c_name AS title, c_custkey IN (SELECT o_custkey FROM orders) AS has_handle FROM customer",
    "q_completion_trigger": f"WITH {SQL_REV}, s AS (SELECT key, at_ms * 1000000 + event_id AS tick, least(100, floor(value)::BIGINT) AS percent FROM rev) SELECT key, min(tick) FILTER (percent >= 96) AS completed_at FROM s GROUP BY key HAVING min_by(percent, tick) < 96 AND min(tick) FILTER (percent >= 96) IS NOT NULL",
    "q_upsert_merge": """
WITH b AS (SELECT o_custkey AS key, o_orderkey AS at, o_orderpriority AS value FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
h AS (SELECT c_custkey AS key, c_custkey + 7 AS id, 0::BIGINT AS at, c_mktsegment AS value FROM customer WHERE c_custkey % 3 <> 0)
SELECT coalesce(b.key, h.key) AS key, coalesce(b.at, h.at) AS at, coalesce(b.value, h.value) AS value, h.id AS kept_id, 1::BIGINT AS rows_of_id FROM h FULL JOIN b ON h.key = b.key
""",
    "q_delete_keys": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0)",
    "q_patch_status": "SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) THEN 'submitted' ELSE o_orderstatus END AS o_orderstatus FROM orders",
    "q_keyed_lookup": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7",
    "q_setting": "SELECT 'density' AS key, coalesce(max(lower(n_name)) FILTER (lower(n_name) IN ('low', 'medium', 'high')), 'medium') AS value FROM nation",
    "q_quiz_score": "SELECT o_custkey, count(*) FILTER (o_orderkey % 2 = 0)::BIGINT AS score, count(*)::BIGINT AS questions FROM orders GROUP BY 1",
}
