"""Exact line dedup across documents (built-in functions only).

A line's key is the line without ASCII white space at both ends and with A-Z
lower-cased.  Keys of at least MIN_CHARS code points that stand in at least
MIN_DOCS documents lose their lines in every document but the one with the
smallest doc_id.  Lines travel as (document, position, 16-byte digest); texts
are joined once more only to be put together again by position.

Defined cases: a null or empty text is one empty line and gives ""; repeated
rows (same doc_id and text) are one document and are treated alike; rows with a
null doc_id neither count nor lose lines; a document that loses every line
keeps an empty text; lines of any length and texts of any number of lines are
treated alike, and what travels of a line is its digest.  Other columns pass
through untouched, whatever their names: where one is named as a count, the
count's name gets underscores in front.  The counts are the last two columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.plans.names import fresh
from wordloom.plans.staging import Workspace

MIN_CHARS, MIN_DOCS = 10, 2


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def line_key(line: Column) -> Column:
    """A text that is equal for two stripped lines just if they are equal with A-Z lower-cased.

    The UTF-8 bytes are read as Latin-1 and lower-cased.  That changes A-Z and
    moves lead bytes C0-DE to E0-FE, but a lead byte's number of following
    bytes still tells which it was, so different lines stay different.
    ``translate`` gives the plain form at some ten times the cost.
    """
    return F.lower(F.decode(F.encode(line, "UTF-8"), "ISO-8859-1"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _put_together(lines: Column, gone: Column) -> Column:
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.get(F.transform(F.array(lines), lambda all_lines: F.array_join(F.transform(stay, lambda i: F.get(all_lines, i)), "\n")), F.lit(0))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, key: str = "doc_id", text: str = "text", counts: tuple[str, str] = ("__n_lines", "__n_dropped")) -> DataFrame:
    """``docs`` with ``text`` cleaned; the numbers of lines before and of lines dropped (long) follow under the names of ``counts``."""
    counts = tuple(fresh(docs.columns, *counts))
    row, gone_at = fresh((*docs.columns, *counts), "__row", "__gone")
    work = Workspace(docs.sparkSession, "lines")
    body, same = F.col(f"`{text}`"), F.xxhash64(F.col(f"`{text}`"))
    named = docs.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("id"), same.alias("row"), F.posexplode(_lines(body)).alias("pos", "line"))
    line = stripped(F.col("line"))
    keyed = named.where(F.length(line) >= min_chars).select("id", "row", "pos", F.substring(F.unhex(F.sha2(line_key(line), 256)), 1, 16).alias("digest"))
    if min_docs == 2:
        shared = keyed.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    else:
        shared = keyed.select("digest", "id").distinct().groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    shared = work.write(shared.select("digest", "first"), "shared")
    gone = keyed.join(shared, "digest").where("id <> first").select("id", "row", "pos").distinct()
    gone = gone.groupBy(F.col("id").alias(key), F.col("row").alias(row)).agg(F.collect_list("pos").alias(gone_at))
    joined = docs.withColumn(row, same).join(gone, [key, row], "left")
    lines, at = _lines(body), F.col(gone_at)
    clean = F.when(at.isNull(), F.coalesce(body, F.lit(""))).otherwise(_put_together(lines, at))
    sizes = [F.size(lines).cast("long").alias(counts[0]), F.coalesce(F.size(at), F.lit(0)).cast("long").alias(counts[1])]
    return joined.select(*[clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], *sizes)
