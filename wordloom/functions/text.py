"""Text expressions: character classes, boundaries, local windows, literal replacement.

Offsets are code points, 0-based and half-open.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from wordloom.plans.workers import in_slices

# Characters that act as a word's boundary.
HARD_BOUNDARY = r"[\s，。！？；：、“”‘’（）《》【】\-—…,.!?;:()\[\]{}\"']"
FUNCTION_CHARS = "的地得了着过是在把被给对向从由和与或而但且这那哪每某不没很更最也又还都我你他她它们一二两三四五六七八九十几上下左右前后里外中来到会能要可说想看让用个些种样点大小多少已将正曾刚"
WINDOW = 14
#: Characters kept on either side of a match: enough for the window and for every guard.
REACH = 18


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the slow ``translate`` is left to texts beyond ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def substr(text: Column, start: Column, length: Column) -> Column:
    """Characters from a 0-based start."""
    return F.substring(text, start + 1, length)


def piece(text: Column, start: Column, end: Column) -> Column:
    return substr(text, start, end - start)


def is_cjk(char: Column) -> Column:
    return F.ascii(char).between(0x4E00, 0x9FFF)


def count_cjk(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^\\u4E00-\\u9FFF]", ""))


def is_boundary(char: Column) -> Column:
    """Whether a neighbouring character (empty at the edge of a text) bounds a word."""
    return (F.coalesce(char, F.lit("")) == "") | char.rlike(HARD_BOUNDARY) | F.lit(FUNCTION_CHARS).contains(char)


def boundary_confidence(left: Column, right: Column) -> Column:
    """0 with two clean sides, 1 with one, 2 with none."""
    return F.lit(2) - is_boundary(left).cast("int") - is_boundary(right).cast("int")


def local_window(text: Column, start: Column, end: Column, reach: int = WINDOW) -> Column:
    """struct<text, targetStart, targetEnd, left, right> around a span."""
    first = F.greatest(F.lit(0), start - reach)
    last = F.least(F.length(text), end + reach)
    return F.struct(
        piece(text, first, last).alias("text"), (start - first).alias("targetStart"), (end - first).alias("targetEnd"),
        piece(text, first, start).alias("left"), piece(text, end, last).alias("right"),
    )


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """Replaces the first occurrence, literally."""
    at = F.when(F.length(old) > 0, F.instr(text, old)).otherwise(0)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))).otherwise(text)


def trim_all(text: Column) -> Column:
    """Trims every Unicode white space and U+FEFF at both ends."""
    return F.regexp_replace(text, "(?U)\\A[\\s\\uFEFF]+|[\\s\\uFEFF]+\\z", "")


def _normal(form: str):
    @in_slices
    def normal(text: pa.Array) -> pa.Array:
        return pa.array([None if x is None else unicodedata.normalize(form, x) for x in text.to_pylist()], pa.string())

    return arrow_udf(normal, StringType())


#: Unicode NFKC and NFC; Spark has no built-in for them.
nfkc, nfc = _normal("NFKC"), _normal("NFC")


def normalize_novel(text: Column) -> Column:
    """NFKC, line ends to LF, no U+FEFF, trimmed."""
    return trim_all(F.replace(F.regexp_replace(nfkc(text), "\\r\\n?", "\n"), F.lit("﻿"), F.lit("")))


def normalize_context(sentence: Column, term: Column) -> Column:
    """A sentence as the key of a correction: target masked, no white space, one kind of quote."""
    masked = F.replace(nfkc(sentence), term, F.lit("{词}"))
    return F.regexp_replace(F.regexp_replace(masked, "(?U)[\\s\\uFEFF]+", ""), "[“”‘’]", '"')


def clean_title(name: Column) -> Column:
    return F.regexp_replace(name, "(?i)\\.(txt|pdf)\\z", "")
