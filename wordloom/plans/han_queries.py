"""Han forms of the documents: what the guards for Chinese texts find, held against SQL.

The tables hold Latin text, in which protected compounds, labels, function
characters and Chinese rules find nothing.  A fixed map turns frequent Latin
words and marks into Han words and marks; both engines make it by literal
replacement, so every document takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.text import FUNCTION_CHARS, boundary_confidence
from wordloom.operators import matching, protected, scan, structure
from wordloom.plans.staging import Workspace

from .inputs import SQL_LOW, low_docs

KEYS = ["doc_id"]
#: Latin pieces and their Han forms, replaced in this order.
FORMS = (
    ("the", "太阳能"), ("and", "研究"), ("ion", "选择"), ("ent", "时间"), ("er", "的"), ("en", "了"), ("an", "人员"), ("re", "问题三："), ("in", "在"), ("es", "太阳"),
    ("th", "生"), ("on", "他"), ("le", "陌生人"), ("ei", "说"), (". ", "。"), (", ", "，"), (" ", ""),
)
TERMS = ("选择", "太阳", "研究", "时间", "陌生")
COMPOUNDS = tuple(c for c in protected.COMPOUNDS if c in ("太阳能", "研究生", "研究人员", "陌生人"))


def han_text(text: Column) -> Column:
    for old, new in FORMS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Workspace(spark, "han").write(low_docs(spark, sf_dir).select("doc_id", han_text(F.col("text")).alias("text")), "docs")


def _matches(docs: DataFrame, reach: int = 14) -> DataFrame:
    """Every occurrence of the terms, with what stands on either side."""
    found = structure.match_spans("|".join(TERMS), reach)(F.col("text"))
    return structure.spans(docs, KEYS, found, context=True)


def q_han_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean sides of every occurrence of the terms, function characters included."""
    rows = _matches(_docs(spark, sf_dir), 1)
    return rows.select("doc_id", "start", "text", boundary_confidence(F.col("left"), F.col("right")).alias("boundary_confidence"))


def q_han_compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed compounds, whose parts are no targets."""
    found = protected.compound_ranges(_docs(spark, sf_dir), KEYS, compounds=list(COMPOUNDS))
    return found.select("doc_id", "start", F.col("end").alias("stop"))


def q_han_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels such as 问题三, which are protected."""
    found = protected.protected_ranges(_docs(spark, sf_dir), KEYS).where("kind = 'label'")
    return found.select("doc_id", "start", F.col("end").alias("stop"))


def q_han_unprotected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of the terms that overlap no compound but their own span and no label."""
    docs = _docs(spark, sf_dir)
    block = scan.width(docs)
    rows = _matches(docs, 0).select("doc_id", "start", "end", "text")
    labels = protected.protected_ranges(docs, KEYS).where("kind = 'label'")
    compounds = protected.compound_ranges(docs, KEYS, compounds=list(COMPOUNDS))
    kept = matching.outside(matching.outside(rows, labels, KEYS, block=block), compounds, KEYS, allow_exact=True, block=block)
    return kept.select("doc_id", "start", "text")


def q_han_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies of every kind of rule: 选择 after 的 or 在 (leftSuffix), 时间 near 了 (contains), 研究 before 生 or 的 (rightPrefix); 陌生 is blocked."""
    rules = {"选择": [("leftSuffix", "的"), ("leftSuffix", "在")], "时间": [("contains", "了")], "研究": [("rightPrefix", "生"), ("rightPrefix", "的")]}
    schema = "term string, mode string, allow array<struct<kind:string,value:string>>"
    policy = spark.createDataFrame([*[(t, "contextual", r) for t, r in rules.items()], ("陌生", "blocked", None)], schema)
    kept = matching.apply_policy(matching.with_boundaries(_matches(_docs(spark, sf_dir))), policy)
    return kept.select("doc_id", "start", "text", "context_evidence")


QUERIES = {f.__name__: f for f in (q_han_boundaries, q_han_compounds, q_han_labels, q_han_unprotected, q_han_rules)}


def _form(text: str) -> str:
    for old, new in FORMS:
        text = f"replace({text}, '{old}', '{new}')"
    return text


_HARD = r"[\s，。！？；：、“”‘’（）《》【】\-—…,.!?;:()\[\]{}\"'']"
_CUT = "|".join(TERMS)
_BASE = f"""WITH {SQL_LOW}, han AS (SELECT doc_id, {_form('text')} AS text FROM low),
hl AS (SELECT doc_id, regexp_extract_all(text, '{_CUT}|[^选太研时陌]+|.', 0, 's') AS l FROM han), hp AS (SELECT doc_id, unnest(l) AS p, unnest(range(1, len(l) + 1)) AS k FROM hl),
hm AS (SELECT doc_id, p AS text, (sum(length(p)) OVER (PARTITION BY doc_id ORDER BY k) - length(p))::INTEGER AS start,
  right(coalesce(string_agg(right(p, 14), '') OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), ''), 14) AS l,
  left(coalesce(string_agg(left(p, 14), '') OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING), ''), 14) AS r FROM hp),
m AS (SELECT doc_id, text, start, (start + length(text))::INTEGER AS "end", l, r FROM hm WHERE text IN ({', '.join(f"'{t}'" for t in TERMS)}))"""
_CLEAN = lambda side: f"CASE WHEN {side} = '' OR regexp_matches({side}, '{_HARD}') OR contains('{FUNCTION_CHARS}', {side}) THEN 1 ELSE 0 END"
_SPLIT = "SELECT doc_id, (sum(length(t)) OVER (PARTITION BY doc_id ORDER BY k) + k * {n})::INTEGER AS start, (sum(length(t)) OVER (PARTITION BY doc_id ORDER BY k) + (k + 1) * {n})::INTEGER AS stop, k, m FROM (SELECT doc_id, len(l) AS m, unnest(l) AS t, unnest(range(0, len(l))) AS k FROM (SELECT doc_id, string_split(text, '{c}') AS l FROM han))"
_COMPOUNDS = " UNION ALL ".join(f"SELECT doc_id, start, stop FROM ({_SPLIT.format(n=len(c), c=c)}) WHERE k < m - 1" for c in COMPOUNDS)
_LABELS = f"SELECT doc_id, start, stop - 1 AS stop FROM ({_SPLIT.format(n=4, c='问题三：')}) WHERE k < m - 1"
ORACLES = {
    "q_han_boundaries": f"{_BASE} SELECT doc_id, start, text, (2 - ({_CLEAN('right(l, 1)')}) - ({_CLEAN('left(r, 1)')}))::INTEGER AS boundary_confidence FROM m",
    "q_han_compounds": f"{_BASE} {_COMPOUNDS}",
    "q_han_labels": f"{_BASE} {_LABELS}",
    "q_han_unprotected": f"""{_BASE}, c AS (SELECT DISTINCT * FROM ({_COMPOUNDS})), b AS ({_LABELS})
SELECT doc_id, start, text FROM m WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = m.doc_id AND b.start < m."end" AND b.stop > m.start)
  AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = m.doc_id AND c.start < m."end" AND c.stop > m.start AND NOT (c.start = m.start AND c.stop = m."end"))""",
    "q_han_rules": f"""{_BASE}, e AS (SELECT *, CASE text WHEN '选择' THEN right(l, 1) IN ('的', '在') WHEN '时间' THEN contains(concat(l, text, r), '了') WHEN '研究' THEN left(r, 1) IN ('生', '的') END AS ok FROM m WHERE text <> '陌生')
SELECT doc_id, start, text, coalesce(ok, FALSE) AS context_evidence FROM e WHERE coalesce(ok, TRUE)""",
}
