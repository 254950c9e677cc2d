"""Queries over labelled quality, sampling, near-duplicate audit and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.hashing import split_name
from wordloom.functions.numbers import wilson95
from wordloom.operators import corpus_dedup, quality, sampling
from wordloom.operators.digests import ordered_digest
from wordloom.plans.staging import Workspace

from .inputs import spread, table


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    return rows.select(
        F.col("doc_id").alias("id"), split_name(F.col("doc_id").cast("string"), 2).alias("split"), F.concat(F.lit("c"), (F.col("doc_id") % 5).cast("string")).alias("category"),
        F.when(F.col("quality") == 1, "replace").otherwise("keepChinese").alias("expected_decision"), F.concat(F.lit("w"), (F.col("doc_id") % 97).cast("string")).alias("expected_candidate_id"),
        F.when(F.col("doc_id") % 4 != 0, "noun").alias("expected_part_of_speech"),
    )


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("id"), F.when(F.col("n_chars") % 3 != 0, "replace").otherwise("keepChinese").alias("decision"),
        F.concat(F.lit("w"), (F.when(F.col("n_chars") % 7 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id")) % 97).cast("string")).alias("candidate_id"),
        F.when(F.col("n_chars") % 11 != 0, "noun").otherwise("verb").alias("part_of_speech"), (F.col("n_chars") % 5 != 0).alias("segmentation_correct"), F.lit(0).alias("ord"),
    )


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_labels(spark, sf_dir), _predictions(spark, sf_dir))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def q_eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quality.report(_outcomes(spark, sf_dir)))


def q_eval_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quality.report(_outcomes(spark, sf_dir), ["split", "category"], intervals=False))


def q_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 37).alias("g")).agg(F.count(F.lit(1)).alias("trials"), F.sum("quality").cast("long").alias("successes"))
    ci = wilson95(F.col("successes"), F.col("trials"))
    return _rounded(rows.select("g", "trials", "successes", ci["lower"].alias("lower"), ci["upper"].alias("upper")))


def q_genre_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    genres = spread(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array("lang", "source").alias("genres"))
    return _rounded(quality.by_genre(_outcomes(spark, sf_dir), genres, "id")).select("genre", "total", "actual_replacements", "correct_replacements", "replacement_precision", "replacement_coverage")


def q_report_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over all, per split and category, and per genre, from one aggregation."""
    genres = spread(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array("lang", "source").alias("genres"))
    return _rounded(quality.reports(_outcomes(spark, sf_dir), genres, "id"))


def q_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark, sf_dir, "documents")
    return quality.leaks(docs.select("source", split_name(F.col("doc_id").cast("string"), 2).alias("split")), "source")


def q_top_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.top_errors(quality.per_candidate(_outcomes(spark, sf_dir)))


def q_per_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.per_candidate(_outcomes(spark, sf_dir))


def q_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with a span each; matches at the same or a shifted span, every third unsafe."""
    rows = _labels(spark, sf_dir).select("id", "expected_decision", F.pmod("id", F.lit(9)).cast("int").alias("start"))
    samples = rows.withColumn("end", F.col("start") + 2)
    matches = rows.where("id % 4 <> 0").select("id", (F.col("start") + F.when(F.col("id") % 5 == 0, 1).otherwise(0)).alias("start"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("candidate_id"), F.lit("noun").alias("part_of_speech")).withColumn("end", F.col("start") + 2)
    return quality.predictions(samples, matches, matches.where("id % 3 <> 0"))


def q_missing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.operators.lexicon import missing_sources

    part = table(spark, sf_dir, "part")
    approved = part.select(F.concat_ws(":", "p_brand", "p_type", F.lit("noun")).alias("candidate_id"), F.col("p_brand").alias("term")).distinct()
    entries = part.where("p_partkey % 2 = 0").select(F.col("p_brand").alias("zh"), F.col("p_type").alias("en"), F.lit("noun").alias("part_of_speech"))
    return missing_sources(approved, entries, part.where("p_size = 50").select(F.col("p_brand").alias("zh")))


def q_merge_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _labels(spark, sf_dir).withColumn("annotation_status", F.lit("unreviewed"))
    labels = spread(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") % 2 == 0, "replace").otherwise("keepChinese").alias("decision"), F.lit("w1").alias("candidate_id"), F.lit("noun").alias("part_of_speech"), F.lit(1).alias("ord"))
    return quality.merge_labels(samples, labels).select("id", "annotation_status", "expected_decision", "expected_candidate_id")


def q_promotion_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labels(spark, sf_dir)
    samples = rows.select("split", "expected_decision", "expected_candidate_id", F.col("expected_candidate_id").alias("term"), F.lit("reviewed").alias("annotation_status"), F.when(F.col("id") % 2 == 0, "agree").otherwise("open").alias("review_status"))
    verdicts = table(spark, sf_dir, "nation").select(F.concat(F.lit("w"), F.col("n_nationkey").cast("string")).alias("candidate_id"), F.get(F.array(F.lit("approve"), F.lit("reject"), F.lit("needs-rule")), (F.col("n_nationkey") % 3).cast("int")).alias("verdict"))
    return quality.promotions(samples, verdicts)


def q_candidate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    approved = part.select(F.concat_ws(":", "p_brand", "p_type", F.lit("noun")).alias("candidate_id"))
    policy = part.where("p_size <= 1").select(F.col("p_brand").alias("term"), F.lit("blocked").alias("mode")).distinct()
    entries = part.where("p_partkey % 2 = 0").select(F.col("p_brand").alias("zh"), F.col("p_type").alias("en"), F.lit("noun").alias("part_of_speech"))
    overrides = part.where("p_size = 50").select(F.col("p_brand").alias("zh"))
    return quality.candidate_audit(approved, policy, entries, overrides)


def q_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("book"), F.col("l_linestatus").alias("text"), F.col("l_returnflag").alias("en"))
    return quality.pair_counts(rows, "book").withColumn("rank", F.col("rank").cast("long"))


def q_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).groupBy("split", "category").agg(F.count(F.lit(1)).alias("n"))


def q_group_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("fp"))
    return ordered_digest(docs, ["source"], "fp", out="fingerprint")


def _sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark, sf_dir, "documents")
    return docs.select("doc_id", corpus_dedup.letter_sketch("text").alias("signature"))


def q_bottomk_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sketches(spark, sf_dir).select("doc_id", F.size("signature").alias("n"), F.md5(F.array_join(F.col("signature").cast("array<string>"), ",")).alias("digest"))


def q_near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs between the first files of different sketches, and each other file with the first of its sketch."""
    sketches = Workspace(spark, "sketches").write(_sketches(spark, sf_dir), "sketches")
    return corpus_dedup.near_links(sketches, "doc_id").withColumn("similarity", F.round("similarity", 9))


def q_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    sketches = Workspace(spark, "sketches").write(_sketches(spark, sf_dir), "sketches")
    return corpus_dedup.groups(sketches, "doc_id", corpus_dedup.near_links(sketches, "doc_id"), seed="v2")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    kinds = F.array(*[F.lit(c) for c in sampling.CATEGORIES])
    start = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long")
    return items.select(F.col("l_suppkey").alias("doc_id"), start.alias("start"), (start + 2).alias("end"), F.get(kinds, (F.col("l_partkey") % 8).cast("int")).alias("category"))


def q_systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.systematic(_candidates(spark, sf_dir), ["doc_id"], F.lit(3), ["start"]).select("doc_id", "category", "start", "pick")


def q_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified(_candidates(spark, sf_dir), ["doc_id"], 20, ["start"]).select("doc_id", "category", "start")


def q_hash_ordered_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hash_ordered(_candidates(spark, sf_dir), ["doc_id"], 20, "batch").select("doc_id", "category", "start", "ordinal")


def q_annotation_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _candidates(spark, sf_dir).withColumn("id", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("start").cast("string")))
    return sampling.annotation_pack(pool, 100, ["start", "doc_id"], 8).select("id", "category")


def q_book_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark, sf_dir, "documents")
    path = F.concat(F.lit("/books/"), "source", F.lit(" (new)_"), (F.col("doc_id") % 3).cast("string"), F.lit(".txt"))
    return docs.select("doc_id", sampling.book_group(path).alias("group_id"))


QUERIES = {f.__name__: f for f in (
    q_eval_report, q_eval_by_category, q_wilson, q_genre_report, q_report_levels, q_leak_check, q_top_errors, q_per_candidate, q_predictions, q_missing_sources, q_merge_labels, q_promotion_status, q_candidate_audit, q_pair_counts,
    q_split_counts, q_group_fingerprint, q_bottomk_sketch, q_near_dup_pairs, q_components, q_systematic_sample, q_stratified_sample, q_hash_ordered_sample,
    q_annotation_pack, q_book_groups,
)}

_SPLIT = "CASE WHEN ('0x' || substr(sha256({0}::VARCHAR), 1, 2))::BIGINT % 10 < 6 THEN 'development' WHEN ('0x' || substr(sha256({0}::VARCHAR), 1, 2))::BIGINT % 10 < 8 THEN 'validation' ELSE 'blind' END"
_OUT = f"""
WITH l AS (SELECT doc_id AS id, {_SPLIT.format('doc_id')} AS split, 'c' || doc_id % 5 AS category, CASE WHEN quality = 1 THEN 'replace' ELSE 'keepChinese' END AS ed, 'w' || doc_id % 97 AS ec, CASE WHEN doc_id % 4 <> 0 THEN 'noun' END AS ep FROM labels),
p AS (SELECT doc_id AS id, n_chars % 3 <> 0 AS att, 'w' || (CASE WHEN n_chars % 7 = 0 THEN doc_id + 1 ELSE doc_id END) % 97 AS c, CASE WHEN n_chars % 11 <> 0 THEN 'noun' ELSE 'verb' END AS pos, n_chars % 5 <> 0 AS seg FROM documents),
o AS (SELECT l.*, coalesce(att, FALSE) AS att, ed = 'replace' AS want, coalesce(att AND seg, FALSE) AS exact, coalesce(ed = 'replace' AND att AND seg AND c = ec, FALSE) AS ok, c, pos FROM l LEFT JOIN p USING (id))
"""
_CNT = """count(*)::BIGINT AS total, count(*) FILTER (want)::BIGINT AS expected_replacements, count(*) FILTER (att)::BIGINT AS actual_replacements, count(*) FILTER (ok)::BIGINT AS correct_replacements,
 count(*) FILTER (exact)::BIGINT AS correct_segments, count(*) FILTER (ep IS NOT NULL)::BIGINT AS pos_expected, count(*) FILTER (ep IS NOT NULL AND ok AND pos = ep)::BIGINT AS pos_correct, count(*) FILTER (NOT want AND NOT att)::BIGINT AS correct_keeps"""
_PAIRS = {"segmentation_precision": ("correct_segments", "actual_replacements"), "candidate_accuracy": ("correct_replacements", "expected_replacements"), "part_of_speech_accuracy": ("pos_correct", "pos_expected"), "replacement_precision": ("correct_replacements", "actual_replacements"), "replacement_coverage": ("correct_replacements", "expected_replacements"), "replacement_rate": ("actual_replacements", "total")}
_RATIO = "round(CASE WHEN {1} = 0 THEN 0 ELSE {0}::DOUBLE / {1} END, 9)"
_RATIOS = ", ".join(f"{_RATIO.format(a, b)} AS {n}" for n, (a, b) in _PAIRS.items()) + f", {_RATIO.format('correct_keeps', '(total - expected_replacements)')} AS abstention_accuracy"


def _ci(s: str, n: str, side: str) -> str:
    z2 = "3.8414588206941254::DOUBLE"
    p = f"({s}::DOUBLE / {n})"
    mid, margin = f"({p} + {z2} / (2 * {n})) / (1 + {z2} / {n})", f"1.959963984540054::DOUBLE * sqrt(({p} * (1 - {p}) + {z2} / (4 * {n})) / {n}) / (1 + {z2} / {n})"
    value = f"greatest(0, {mid} - {margin})" if side == "lower" else f"least(1, {mid} + {margin})"
    return f"round(CASE WHEN {n} = 0 THEN 0 ELSE {value} END, 9)"


_CI = ", ".join(f"{_ci(a, b, side)} AS {n}_{side}" for n, (a, b) in _PAIRS.items() for side in ("lower", "upper"))
_CAND = """WITH c AS (SELECT l_suppkey AS doc_id, l_orderkey * 10 + l_linenumber AS start, (l_partkey % 8)::INTEGER + 1 AS c, ['multiple-meaning', 'multiple-pos', 'overlap', 'floating-boundary', 'person-name', 'book-title', 'fixed-phrase', 'single-sense'][(l_partkey % 8)::INTEGER + 1] AS category FROM lineitem)"""
def _power(base: int, exponent: str) -> str:
    """A power modulo 2^32 from the bits of an exponent below 2^26."""
    out = "1::UBIGINT"
    for bit in range(26):
        out = f"(({out} * CASE WHEN {exponent} & {1 << bit} > 0 THEN {pow(base, 1 << bit, 1 << 32)} ELSE 1 END::UBIGINT) & 4294967295::UBIGINT)"
    return out


# Texts of Latin-1 letters are their own NFKC form as far as A-Z, a-z and 0-9 go, but for ª and º.
# A window's sum is a difference of two running sums of c / B^i, times a power of B; B is odd, so it has an inverse.
_SKETCH = f"""WITH RECURSIVE t AS (SELECT doc_id, string_split(regexp_replace(translate(text, 'ªº', 'ao'), '[^A-Za-z0-9]', '', 'g'), '') AS c FROM documents),
u AS (SELECT doc_id, unicode(x)::UBIGINT AS x, i FROM (SELECT doc_id, unnest(c) AS x, unnest(range(1, len(c) + 1)) AS i FROM t WHERE len(c) >= 20)),
v AS (SELECT doc_id, i, (sum((x * {_power(pow(corpus_dedup.BASE, -1, 1 << 32), 'i')}) & 4294967295::UBIGINT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) % 4294967296)::UBIGINT AS w FROM u),
h AS (SELECT DISTINCT doc_id, ((w * {_power(corpus_dedup.BASE, 'i')}) & 4294967295::UBIGINT)::BIGINT AS h FROM v WHERE i >= 20),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY h) AS r FROM h),
k AS (SELECT doc_id, list(h ORDER BY h) AS s FROM o WHERE r <= 256 GROUP BY doc_id)"""
_LINKS = f"""{_SKETCH}, nodes AS (SELECT s, min(doc_id) AS node FROM k GROUP BY s),
e AS (SELECT node, len(s) AS n, unnest(s) AS h FROM nodes),
m AS (SELECT x.node AS a, y.node AS b, count(*)::DOUBLE / min(least(x.n, y.n)) AS similarity FROM e x JOIN e y ON x.h = y.h AND x.node < y.node GROUP BY 1, 2),
links AS (SELECT * FROM m WHERE similarity >= 0.9 UNION ALL SELECT node, doc_id, 1.0::DOUBLE FROM k JOIN nodes USING (s) WHERE node <> doc_id)"""

ORACLES = {
    "q_eval_report": f"{_OUT}, t AS (SELECT {_CNT} FROM o) SELECT *, {_RATIOS}, {_CI} FROM t",
    "q_eval_by_category": f"{_OUT}, t AS (SELECT split, category, {_CNT} FROM o GROUP BY 1, 2) SELECT *, {_RATIOS} FROM t",
    "q_wilson": f"WITH t AS (SELECT doc_id % 37 AS g, count(*)::BIGINT AS trials, sum(quality)::BIGINT AS successes FROM labels GROUP BY 1) SELECT *, {_ci('successes', 'trials', 'lower')} AS lower, {_ci('successes', 'trials', 'upper')} AS upper FROM t",
    "q_genre_report": f"{_OUT}, g AS (SELECT doc_id AS id, lang AS genre FROM documents UNION SELECT doc_id, source FROM documents), t AS (SELECT genre, {_CNT} FROM o JOIN g USING (id) GROUP BY 1) SELECT genre, total, actual_replacements, correct_replacements, {_RATIO.format('correct_replacements', 'actual_replacements')} AS replacement_precision, {_RATIO.format('correct_replacements', 'expected_replacements')} AS replacement_coverage FROM t",
    "q_leak_check": f"SELECT source, count(DISTINCT {_SPLIT.format('doc_id')})::BIGINT AS splits FROM documents GROUP BY 1 HAVING count(DISTINCT {_SPLIT.format('doc_id')}) > 1",
    "q_top_errors": f"{_OUT} SELECT c AS predicted_id, count(*)::BIGINT AS actual, count(*) FILTER (ok)::BIGINT AS correct, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, (count(*) - count(*) FILTER (ok))::BIGINT AS wrong FROM o WHERE att GROUP BY 1 ORDER BY wrong DESC, actual DESC, predicted_id LIMIT 30",
    "q_per_candidate": f"{_OUT} SELECT c AS predicted_id, count(*)::BIGINT AS actual, count(*) FILTER (ok)::BIGINT AS correct, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM o WHERE att GROUP BY 1",
    "q_predictions": f"""{_OUT}, m AS (SELECT id, ed, id % 4 <> 0 AS near, id % 4 <> 0 AND id % 5 <> 0 AS exact, id % 3 <> 0 AS safe FROM l)
SELECT id, CASE WHEN exact AND safe THEN 'replace' ELSE 'keepChinese' END AS decision, CASE WHEN exact THEN 'w' || id END AS candidate_id, CASE WHEN exact THEN 'noun' END AS part_of_speech,
 CASE WHEN ed = 'keepChinese' THEN NOT (near AND safe) ELSE exact END AS segmentation_correct FROM m""",
    "q_missing_sources": "SELECT DISTINCT p_brand || ':' || p_type || ':noun' AS candidate_id, p_brand AS term FROM part WHERE p_brand || p_type NOT IN (SELECT p_brand || p_type FROM part WHERE p_partkey % 2 = 0) AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50)",
    "q_merge_labels": "SELECT l.doc_id AS id, CASE WHEN d.doc_id IS NOT NULL THEN 'reviewed' ELSE 'unreviewed' END AS annotation_status, CASE WHEN d.doc_id IS NULL THEN CASE WHEN quality = 1 THEN 'replace' ELSE 'keepChinese' END WHEN n_chars % 2 = 0 THEN 'replace' ELSE 'keepChinese' END AS expected_decision, CASE WHEN d.doc_id IS NULL THEN 'w' || l.doc_id % 97 ELSE 'w1' END AS expected_candidate_id FROM labels l LEFT JOIN (SELECT * FROM documents WHERE doc_id % 3 = 0) d USING (doc_id)",
    "q_promotion_status": f"""{_OUT}, f AS (SELECT ec AS candidate_id, count(*)::BIGINT AS development_support, count(*) FILTER (id % 2 = 0)::BIGINT AS review_support FROM l WHERE split = 'development' AND ed = 'replace' GROUP BY 1),
a AS (SELECT ec, count(*)::BIGINT AS n FROM l WHERE split = 'validation' AND ed = 'keepChinese' GROUP BY 1),
v AS (SELECT 'w' || n_nationkey AS candidate_id, ['approve', 'reject', 'needs-rule'][n_nationkey::INTEGER % 3 + 1] AS verdict FROM nation)
SELECT f.candidate_id, f.candidate_id AS term, development_support, review_support, coalesce(n, 0)::BIGINT AS conflicts, verdict,
 CASE WHEN development_support < 2 OR coalesce(n, 0) > 0 THEN 'needs-rule-or-more-evidence' WHEN verdict = 'approve' THEN 'approved-for-production-batch' WHEN verdict = 'reject' THEN 'rejected-by-sol' WHEN verdict = 'needs-rule' THEN 'needs-context-rule' ELSE 'pending-sol-review' END AS status
FROM f LEFT JOIN a ON a.ec = f.candidate_id LEFT JOIN v ON v.candidate_id = f.candidate_id""",
    "q_candidate_audit": """
WITH i AS (SELECT p_brand || ':' || p_type || ':noun' AS id, any_value(p_brand) AS term, count(*) AS n, bool_or(p_partkey % 2 = 0) AS k FROM part GROUP BY 1),
r AS (SELECT *, term IN (SELECT p_brand FROM part WHERE p_size <= 1) AS blocked, term IN (SELECT p_brand FROM part WHERE p_size = 50) AS o FROM i)
SELECT count(*) FILTER (NOT blocked)::BIGINT AS effective, coalesce(sum(n - 1), 0)::BIGINT AS duplicates, count(*) FILTER (NOT blocked)::BIGINT AS stable, 0::BIGINT AS contextual, count(*) FILTER (blocked)::BIGINT AS blocked, count(*) FILTER (NOT blocked AND NOT k AND NOT o)::BIGINT AS missing FROM r
""",
    "q_pair_counts": "WITH c AS (SELECT l_suppkey AS book, l_linestatus AS text, l_returnflag AS en, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY book ORDER BY n DESC, text, en) AS rank FROM c QUALIFY rank <= 8",
    "q_split_counts": f"{_OUT} SELECT split, category, count(*)::BIGINT AS n FROM l GROUP BY 1, 2",
    "q_report_levels": f"""{_OUT}, g AS (SELECT doc_id AS id, lang AS genre FROM documents UNION SELECT doc_id, source FROM documents),
t AS (SELECT 'all' AS level, NULL::VARCHAR AS split, NULL::VARCHAR AS category, NULL::VARCHAR AS genre, {_CNT} FROM o
  UNION ALL SELECT 'category', split, category, NULL, {_CNT} FROM o GROUP BY split, category
  UNION ALL SELECT 'genre', NULL, NULL, genre, {_CNT} FROM o JOIN g USING (id) GROUP BY genre)
SELECT *, {_RATIOS}, {_CI} FROM t""",
    "q_group_fingerprint": "SELECT source, sha256(string_agg(sha256(text), chr(10) ORDER BY sha256(text))) AS fingerprint FROM documents GROUP BY 1",
    "q_systematic_sample": f"{_CAND}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY start) - 1 AS r, count(*) OVER (PARTITION BY doc_id, category) AS n FROM c), i AS (SELECT unnest(range(0, 3)) AS i) SELECT doc_id, category, start, min(i)::BIGINT AS pick FROM n JOIN i ON i < n AND r = i * n // 3 GROUP BY ALL",
    "q_hash_ordered_sample": f"""{_CAND}, h AS (SELECT *, sha256(concat_ws(':', 'batch', category, start, start + 2, category)) AS own, sha256(concat_ws(':', 'batch', 'remainder', start, start + 2, category)) AS a FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY own, start) AS r FROM h),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN r <= 2 THEN 0 ELSE 1 END, CASE WHEN r <= 2 THEN c ELSE 0 END, CASE WHEN r <= 2 THEN r ELSE 0 END, a, start) - 1 AS ordinal FROM r)
SELECT doc_id, category, start, ordinal::INTEGER AS ordinal FROM s WHERE ordinal < 20""",
    "q_bottomk_sketch": f"{_SKETCH} SELECT d.doc_id, coalesce(n, 0)::INTEGER AS n, md5(coalesce(digest, '')) AS digest FROM documents d LEFT JOIN (SELECT doc_id, len(s) AS n, array_to_string(s, ',') AS digest FROM k) USING (doc_id)",
    "q_near_dup_pairs": f"{_LINKS} SELECT a, b, round(similarity, 9) AS similarity FROM links",
    "q_components": f"""{_LINKS}, ways AS (SELECT a AS x, b AS y FROM links UNION SELECT b, a FROM links),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, ways.y FROM r JOIN ways ON r.y = ways.x),
c AS (SELECT x AS doc_id, min(y) AS root FROM r GROUP BY 1),
g AS (SELECT root, 'book-' || substr(sha256(string_agg(doc_id::VARCHAR, ':' ORDER BY doc_id::VARCHAR)), 1, 16) AS group_id FROM c GROUP BY 1),
s AS (SELECT *, ('0x' || substr(sha256('v2:' || group_id), 1, 8))::BIGINT % 10 AS h FROM g)
SELECT doc_id, c.root, group_id, CASE WHEN h < 6 THEN 'development' WHEN h < 8 THEN 'validation' ELSE 'blind' END AS split FROM c JOIN s ON c.root = s.root
""",
    "q_stratified_sample": f"""{_CAND}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY start) - 1 AS r, count(*) OVER (PARTITION BY doc_id, category) AS n FROM c),
p AS (SELECT *, CASE WHEN r = 0 THEN 0 WHEN n > 1 AND r = n // 2 THEN 1 END AS pick FROM n),
f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, start ORDER BY pick IS NULL, CASE WHEN pick IS NULL THEN 0 ELSE c END, pick, c) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pick IS NULL, CASE WHEN pick IS NULL THEN 0 ELSE c END, pick, start, c) AS k FROM f)
SELECT doc_id, category, start FROM o WHERE k <= 20""",
    "q_annotation_pack": f"""{_CAND}, n AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY start, doc_id) - 1 AS r, count(*) OVER (PARTITION BY category) AS n FROM c),
p AS (SELECT doc_id, start, category, r, min(i) AS pick FROM n LEFT JOIN (SELECT unnest(range(0, 13)) AS i) ON i < n AND r = i * n // 13 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (ORDER BY pick IS NULL, CASE WHEN pick IS NULL THEN '' ELSE category END, pick, start, doc_id) AS k FROM p)
SELECT doc_id || '-' || start AS id, category FROM o WHERE k <= 100""",
    "q_book_groups": "SELECT doc_id, 'book-' || substr(sha256(source || doc_id % 3), 1, 16) AS group_id FROM documents",
}
