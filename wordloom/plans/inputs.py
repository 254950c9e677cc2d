"""Inputs that several queries share: tables, a lexicon derived from the documents, events as reviews.

The tables hold Latin text, so the operators run on words of a-z; the SQL twin
of each derivation stands beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.text import LOWER, UPPER, ascii_lower

from .staging import Workspace

LEAST_DOCS = 8
#: The reference time of every query: 2024-02-01T00:00:00Z.
NOW_MS = 1706745600000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes per core up to which an input counts as small.
SMALL = 8 << 20


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are dealt out to all cores if it is small.

    A small file is often one row group, which is one task; a large table has
    row groups enough and is read as it is, without a shuffle.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    cores, rows = spark.sparkContext.defaultParallelism, table(spark, sf_dir, name)
    return rows.repartition(cores) if size <= cores * SMALL else rows


def millis(name: str) -> Column:
    """Epoch milliseconds of a timestamp column with or without a zone (then UTC)."""
    return F.unix_millis(F.to_utc_timestamp(F.col(name).cast("timestamp"), F.lit("UTC")))


def low_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the text with A-Z lower-cased."""
    return spread(spark, sf_dir, "documents").select("doc_id", "lang", "source", ascii_lower(F.coalesce("text", F.lit(""))).alias("text"))


SQL_LOW = f"low AS (SELECT doc_id, lang, source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents)"
SQL_SEG = """plist AS (SELECT doc_id, regexp_extract_all(text, '[a-z]+|[^a-z]+') AS l FROM low),
parts AS (SELECT doc_id, unnest(l) AS text, unnest(range(1, len(l) + 1)) AS k FROM plist),
placed AS (SELECT doc_id, text, k, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
  coalesce(right(lag(text) OVER o, 1), '') AS lc, left(concat(lead(text) OVER o, lead(text, 2) OVER o), 4) AS nx FROM parts WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
seg AS (SELECT doc_id, text, start::INTEGER AS start, (start + length(text))::INTEGER AS "end", lc, nx, left(nx, 1) AS rc FROM placed WHERE regexp_matches(text, '^[a-z]'))"""


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, term: every run of a-z; one pass, no positions."""
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("term"))


def runs(shortest: int, longest: int) -> Column:
    """The runs of so many letters a-z of the column text."""
    return F.regexp_extract_all("text", F.lit(f"(?<![a-z])[a-z]{{{shortest},{longest}}}(?![a-z])"), F.lit(0))


def widespread(docs: DataFrame, shortest: int, longest: int) -> DataFrame:
    """term: the runs of so many letters a-z in at least LEAST_DOCS documents.

    Where every row has a doc_id of its own, which one look at the ids tells, a
    row counts each of its runs once, and a task sends each run once with its
    sum.  Else pairs of run and doc_id are told apart.
    """
    ids = docs.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    own = docs.select("doc_id", F.explode(F.array_distinct(runs(shortest, longest))).alias("term"))
    held = F.count(F.lit(1)) if ids.rows == ids.ids else F.count_distinct("doc_id")
    return own.groupBy("term").agg(held.alias("docs")).where(F.col("docs") >= LEAST_DOCS).select("term")


def lexicon(docs: DataFrame) -> DataFrame:
    """Entries of the terms of 4 to 8 letters in at least LEAST_DOCS documents.

    Each term has a main sense, and terms of even length a second one that
    needs its right neighbour as evidence.  The terms are written, so that no
    reader of the entries reads the documents for them again.
    """
    found = Workspace(docs.sparkSession, "lexicon").write(widespread(docs, 4, 8), "terms")
    kinds = F.array(*[F.lit(x) for x in ("noun", "verb", "adjective", "adverb")])
    rules = "array<struct<kind:string,value:string>>"
    main = found.select(F.col("term").alias("zh"), F.reverse("term").alias("en"), F.get(kinds, F.pmod(F.length("term") + F.ascii("term"), F.lit(4))).alias("part_of_speech"), F.lit(10).alias("priority"), F.lit(1).alias("ord"), F.array().cast(rules).alias("context_rules"))
    second = found.where(F.length("term") % 2 == 0).select(F.col("term").alias("zh"), F.concat(F.lit("the "), "term").alias("en"), F.lit("noun").alias("part_of_speech"), F.lit(5).alias("priority"), F.lit(2).alias("ord"), F.array(F.struct(F.lit("rightPrefix").alias("kind"), F.lit(" the").alias("value"))).alias("context_rules"))
    both = main.unionByName(second)
    return both.withColumns({"meaning": F.col("en"), "phonetic": F.concat(F.lit("/"), "zh", F.lit("/")), "context_hints": F.array().cast("array<string>")})


SQL_LEX = f"""ftok AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+')) AS term FROM low),
fterm AS (SELECT term FROM ftok WHERE length(term) BETWEEN 4 AND 8 GROUP BY term HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
lex AS (SELECT term AS zh, reverse(term) AS en, ['noun', 'verb', 'adjective', 'adverb'][1 + (length(term) + ascii(term)) % 4] AS part_of_speech, 10 AS priority, 1 AS ord FROM fterm
        UNION ALL SELECT term, 'the ' || term, 'noun', 5, 2 FROM fterm WHERE length(term) % 2 = 0)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reviews: key, at_ms, event_id, quality 0 to 5."""
    events = table(spark, sf_dir, "events")
    quality = F.pmod(F.length("event_type") * 7 + F.col("event_id"), F.lit(6)).cast("int")
    return events.select(F.col("user_id").alias("key"), millis("ts").alias("at_ms"), "event_id", "event_type", "value", quality.alias("quality"))


SQL_REV = "rev AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS at_ms, event_id, event_type, value, ((length(event_type) * 7 + event_id) % 6)::INTEGER AS quality FROM events)"
