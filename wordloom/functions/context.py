"""Candidate ids, term policies and local context rules."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import fnv_hex
from .text import normalize_context, substr

# Fragments and phrases that are never replaced, and the prefix exceptions.
BLOCKED = (
    "空中", "一阵", "无论", "一般", "一夜", "过去", "的时", "也就", "下来", "一把", "一套", "一大",
    "有礼", "才能", "由于", "令人", "天花", "根据", "出声", "走向", "招呼", "专业", "直升",
)
FRAGMENT_PREFIX, FRAGMENT_ALLOWED = "使", ("使用", "使命", "使劲", "使动")


def candidate_id(zh: Column, en: Column, pos: Column) -> Column:
    return F.concat_ws(":", zh, en, pos)


def is_blocked_term(zh: Column) -> Column:
    listed = zh.isin(*BLOCKED)
    fragment = zh.startswith(FRAGMENT_PREFIX) & ~zh.isin(*FRAGMENT_ALLOWED)
    particle = zh.startswith("的") & (F.length(zh) == 2) & (zh != "的确")
    return listed | fragment | particle


def is_production_entry(zh: Column, en: Column, term_pattern: str = "\\A[\\u4E00-\\u9FFF]{2,8}\\z") -> Column:
    """A whole term of the lexicon's script with a plain translation, not blocked."""
    return zh.rlike(term_pattern) & en.rlike("\\A[A-Za-z][A-Za-z -]*\\z") & ~is_blocked_term(zh)


def rule_matches(kind: Column, value: Column, window: Column) -> Column:
    """One rule against a window.

    ``contains`` rules that name the target must overlap this very occurrence;
    others may stand anywhere in the window.
    """
    text, start, end = window["text"], window["targetStart"], window["targetEnd"]
    target = substr(text, start, end - start)
    size = F.length(value)
    first, last = F.greatest(F.lit(0), start - size + 1), F.least(end - 1, F.length(text) - size)
    touching = (first <= last) & F.exists(F.sequence(first, F.greatest(first, last)), lambda p: substr(text, p, size) == value)
    anywhere = F.when(value.contains(target), touching).otherwise(text.contains(value))
    return F.when(kind == "leftSuffix", window["left"].endswith(value)).when(kind == "rightPrefix", window["right"].startswith(value)).otherwise(anywhere)


def all_rules(rules: Column, hints: Column) -> Column:
    """The rules of an entry, and its older hints as ``contains`` rules."""
    old = F.transform(F.coalesce(hints, F.array().cast("array<string>")), lambda h: F.struct(F.lit("contains").alias("kind"), h.alias("value")))
    return F.concat(F.coalesce(rules, F.array().cast("array<struct<kind:string,value:string>>")), old)


def has_evidence(rules: Column, hints: Column, window: Column) -> Column:
    """Whether any rule or any older hint (a ``contains`` rule) of an entry matches."""
    return F.exists(all_rules(rules, hints), lambda r: rule_matches(r["kind"], r["value"], window))


def correction_key(zh: Column, sentence: Column) -> Column:
    return F.concat_ws(":", zh, fnv_hex(normalize_context(sentence, zh)))


# Surroundings (up to 18 characters before the term, 2 after) in which a term is part of something else.
# TERM stands for the term itself.
TERM = "{词}"
_NUMBER = "零一二三四五六七八九十百千万两几数\\d"
_UNIT = "本个岁米天年人页章件条只张册斤倍层排套种名位"
UNSAFE = (
    ("地点", f"\\{TERM}点头"),
    ("得到", f"不\\{TERM}了"),
    ("后来", f"饭\\{TERM}"),
    ("样子", f"[{_NUMBER}]+(?:[、至到\\-—~～]?[{_NUMBER}]+)?(?:[{_UNIT}]|公里|上下|左右|来|多|余|出头|出头些)?的\\{TERM}"),
    ("样子", f"(?:大概|大约|约有|差不多|上下|左右)[^，。！？；;]{{0,10}}的\\{TERM}"),
    ("样子", f"(?:不久|好久|刚刚|刚才|似乎|可能|估计|仿佛|看起来|像是)[^，。！？；;]{{0,8}}的\\{TERM}"),
)


def is_unsafe_in_context(term: Column, left: Column, right: Column) -> Column:
    """Whether what stands on both sides shows a term to be part of something else."""
    around = F.concat(F.coalesce(left, F.lit("")), F.lit(TERM), F.coalesce(right, F.lit("")))
    found = [(term == word) & around.rlike(pattern) for word, pattern in UNSAFE]
    return F.coalesce(reduce(or_, found), F.lit(False))
