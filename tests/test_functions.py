import math

import pytest
from pyspark.sql import functions as F

from wordloom.functions import context, hashing, numbers, text
from wordloom.operators.learning import first_state, review


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_hashes_match_plain_loops(spark):
    for word in ("", "a", "选择:choose", "The quick brown fox"):
        fnv, poly = 2166136261, 0
        for ch in word:
            fnv = ((fnv ^ ord(ch)) * 16777619) % 2**32
            poly = (poly * 31 + ord(ch)) % 2**32
        assert one(spark, hashing.fnv1a32(F.lit(word))) == fnv
        assert one(spark, hashing.stable_score(F.lit(word))) == poly
    assert one(spark, hashing.fnv1a32(F.lit(None).cast("string"))) is None


def test_splits_are_stable_and_group_names_ignore_order(spark):
    names = [one(spark, hashing.split_name(F.lit(f"g{i}"), 2)) for i in range(6)]
    assert set(names) <= {"development", "validation", "blind"}
    a = one(spark, hashing.group_digest(F.array(F.lit("x"), F.lit("y"))))
    b = one(spark, hashing.group_digest(F.array(F.lit("y"), F.lit("x"))))
    assert a == b and len(a) == 16


@pytest.mark.parametrize(("k", "n", "low", "high"), [(1013, 1018, 98.855, 99.790), (832, 833, 99.323, 99.979), (1013, 1783, 54.503, 59.096), (832, 1481, 53.639, 58.686)])
def test_wilson_intervals(spark, k, n, low, high):
    got = one(spark, numbers.wilson95(F.lit(k), F.lit(n)))
    assert round(got.lower * 100, 3) == low and round(got.upper * 100, 3) == high


def test_wilson_without_trials_and_ratio(spark):
    got = one(spark, numbers.wilson95(F.lit(0), F.lit(0)))
    assert (got.lower, got.upper) == (0.0, 0.0)
    assert one(spark, numbers.ratio(F.lit(3), F.lit(0))) == 0.0


def test_relative_time(spark):
    now = 1_706_745_600_000
    said = [one(spark, numbers.relative_time(F.lit(now - d).cast("long"), F.lit(now).cast("long"))) for d in (0, 60_000, 3_600_000, 86_400_000, 20 * 86_400_000)]
    assert said == ["刚刚", "1 分钟前", "1 小时前", "1 天前", "2024/1/12"]


def window(spark, whole, target, nth=0):
    at = -1
    for _ in range(nth + 1):
        at = whole.index(target, at + 1)
    return text.local_window(F.lit(whole), F.lit(at), F.lit(at + len(target)))


def test_contains_rule_needs_this_occurrence(spark):
    whole = "他成功上位并取得成功。"
    rule = lambda w: context.rule_matches(F.lit("contains"), F.lit("取得成功"), w)
    assert one(spark, rule(window(spark, whole, "成功", 0))) is False
    assert one(spark, rule(window(spark, whole, "成功", 1))) is True
    assert one(spark, context.rule_matches(F.lit("leftSuffix"), F.lit("取得"), window(spark, whole, "成功", 1))) is True
    assert one(spark, context.rule_matches(F.lit("rightPrefix"), F.lit("上位"), window(spark, whole, "成功", 0))) is True
    assert one(spark, context.rule_matches(F.lit("contains"), F.lit("上位"), window(spark, whole, "成功", 1))) is True


def test_blocked_and_production_terms(spark):
    for term, blocked in (("空中", True), ("使惊", True), ("使用", False), ("的时", True), ("的确", False), ("选择", False)):
        assert one(spark, context.is_blocked_term(F.lit(term))) is blocked
    assert one(spark, context.is_production_entry(F.lit("选择"), F.lit("choose"))) is True
    assert one(spark, context.is_production_entry(F.lit("选"), F.lit("choose"))) is False
    assert one(spark, context.is_production_entry(F.lit("选择"), F.lit("1st"))) is False


def test_terms_that_neighbours_make_unsafe(spark):
    cases = (("在地点点头", "地点", 1, True), ("得不得到了", "得到", 2, True), ("饭后来了", "后来", 1, True), ("大约三岁的样子", "样子", 5, True), ("她的样子", "样子", 2, False))
    for whole, term, start, unsafe in cases:
        left, right = whole[max(0, start - 18) : start], whole[start + len(term) :][:2]
        assert one(spark, context.is_unsafe_in_context(F.lit(term), F.lit(left), F.lit(right))) is unsafe, whole


def test_boundaries_and_literal_replacement(spark):
    assert one(spark, text.boundary_confidence(F.lit(""), F.lit("。"))) == 0
    assert one(spark, text.boundary_confidence(F.lit("山"), F.lit("水"))) == 2
    assert one(spark, text.replace_first(F.lit("a.b a.b"), F.lit("."), F.lit("____"))) == "a____b a.b"
    assert one(spark, text.count_cjk(F.lit("a中b文"))) == 2


def test_normalisation(spark):
    assert one(spark, text.normalize_novel(F.lit("﻿ ＡＢ\r\nc\r "))) == "AB\nc"
    same = [one(spark, context.correction_key(F.lit("选择"), F.lit(s))) for s in ("请 选择“它”", "请选择\"它\"")]
    assert same[0] == same[1] and same[0].startswith("选择:")


def sm2(state, q, now):
    q = max(0, min(5, math.floor(q + 0.5)))
    if q < 3:
        return {**state, "repetitions": 0, "interval": 1, "due_at": now + 86_400_000, "updated_at": now}
    reps = state["repetitions"] + 1
    interval = 1 if reps == 1 else 6 if reps == 2 else math.floor(state["interval"] * state["ease"] + 0.5)
    ease = max(1.3, state["ease"] + (0.1 - (5 - q) * (0.08 + (5 - q) * 0.02)))
    return {"ease": ease, "interval": interval, "repetitions": reps, "due_at": now + interval * 86_400_000, "updated_at": now}


def test_review_steps(spark):
    state = {"ease": 2.5, "interval": 0, "repetitions": 0, "due_at": 5, "updated_at": 5}
    expr = first_state(F.lit(5).cast("long"))
    for i, q in enumerate((4, 5, 3, 1, 5, 9, 2.5)):
        now = 1000 * (i + 1)
        state = sm2(state, q, now)
        expr = review(expr, F.lit(float(q)), F.lit(now).cast("long"))
        got = one(spark, expr).asDict()
        assert got.pop("ease") == pytest.approx(state["ease"])
        assert got == {k: v for k, v in state.items() if k != "ease"}
        expr = F.struct(F.lit(state["ease"]).alias("ease"), *[F.lit(state[k]).cast("long").alias(k) for k in ("interval", "repetitions", "due_at", "updated_at")])


def test_han_characters(spark):
    rows = spark.createDataFrame([("中",), ("鿿",), ("一",), ("a",), ("。",), ("",), ("㐀",)], "c string")
    assert [r.x for r in rows.select(text.is_cjk(F.col("c")).alias("x")).collect()] == [True, True, True, False, False, False, False]
