"""Feedback, histories, manifests, baselines; the default policy; stages and helper names."""

import os
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wordloom.operators import automaton, corpus_dedup, learning, lexicon, matching, quality, resolve, sampling, scan
from wordloom.plans.inputs import spread
from wordloom.plans.names import fresh
from wordloom.plans.staging import Workspace, scope
from wordloom.sources import files
from wordloom.streaming.reviews import progress_sink

KEYS = ["doc_id"]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("bounds", [{}, {"most_terms": 5, "most_starts": 20}])
def test_dictionary_search_equals_brute_force(spark, bounds):
    rng = random.Random(4)
    say = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = ["", *[say("ab é中😀", n) for n in (1, 5, 60, 200)], None, "", "abababab" * 20]
    terms = sorted({say("abé中😀", rng.randint(1, 5)) for _ in range(60)} | {"ab", "abab", "abababa", "aba"})
    table, lexicon = docs(spark, *texts), spark.createDataFrame([(t,) for t in [*terms, "ab"]], "zh string")
    want = {(i, s, s + len(x), x, t[max(0, s - 5) : s], t[s + len(x) : s + len(x) + 5]) for i, t in enumerate(texts) if t for x in terms if len(x) > 1 for s in range(len(t)) if t[s] in "ab中" and t.startswith(x, s)}
    rows = lambda found: [(r.doc_id, r.start, r.end, r.text, r.left, r.right) for r in found.collect()]
    got = rows(automaton.find(table, KEYS, lexicon, start_class="[ab中]", reach=5, **bounds))
    assert len(got) == len(want) and set(got) == want
    longest = rows(automaton.find(table, KEYS, lexicon, start_class="[ab中]", reach=5, longest=True, **bounds))
    ends = {}
    for w in want:
        ends[w[:2]] = max(ends.get(w[:2], w), w, key=lambda x: x[2])
    assert len(longest) == len(ends) and set(longest) == set(ends.values())
    assert automaton.find(table, KEYS, lexicon.limit(0), **bounds).count() == 0 and automaton.find(table.limit(0), KEYS, lexicon, **bounds).count() == 0


@pytest.mark.parametrize("bounds", [{}, {"most_terms": 2}])
def test_dictionary_words_equal_brute_force(spark, bounds):
    texts = ["ab", "ab cd,ab", "", None, "xab", "é ab中cd", "ab"]
    lexicon = spark.createDataFrame([("ab",), ("cd",), ("é",), ("",), ("zz",)], "zh string")
    got = {(r.doc_id, r.start, r.end, r.text, r.left, r.right) for r in automaton.find_words(docs(spark, *texts), KEYS, lexicon, reach=2, **bounds).collect()}
    assert got == {(i, m.start(), m.end(), m[0], t[max(0, m.start() - 2) : m.start()], t[m.end() : m.end() + 2]) for i, t in enumerate(texts) if t for m in re.finditer("[a-z]+", t) if m[0] in ("ab", "cd")}


@pytest.mark.parametrize("block", [1, 7, 1 << 18, None])
def test_running_aggregates_equal_windows(spark, block):
    rng = random.Random(9)
    rows = [(rng.randint(0, 3), rng.randint(0, 90), i, rng.choice([None, rng.randint(0, 50)])) for i in range(400)] + [(9, 5, -1, 1)]
    table = spark.createDataFrame(rows, "doc_id long, at int, n int, v int").repartition(5)
    for before in (False, True):
        got = scan.running(table, KEYS, ["at", "n"], {"top": ("max", F.col("v")), "total": ("sum", F.col("v")), "last": ("last", F.col("v"))}, before=before, block=block)
        want = {}
        for d, at, n, v in rows:
            held = [(a, k, x) for e, a, k, x in rows if e == d and ((a, k) < (at, n) if before else (a, k) <= (at, n))]
            known = [x for _, _, x in sorted(held) if x is not None]
            want[d, at, n] = (v, max(known, default=None), sum(known), known[-1] if known else None)
        assert {(r.doc_id, r.at, r.n): (r.v, r.top, r.total or 0, r.last) for r in got.collect()} == want


def test_one_huge_document_is_many_tasks(spark):
    spans = spark.range(300_000).select(F.lit(1).alias("doc_id"), (F.col("id") * 7).cast("int").alias("start"), (F.col("id") * 7 + 3 + F.col("id") % 11).cast("int").alias("end"))
    parts = resolve.overlap_components(spans, KEYS, block=1 << 15).cache()
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    plain = spans.withColumn("new", (reach <= F.col("start")).cast("int")).withColumn("component", F.sum("new").over(order) - 1)
    assert parts.select("start", "end", "component").exceptAll(plain.select("start", "end", "component")).count() == 0 and parts.count() == 300_000
    parts.unpersist()
    tops = spans.select(F.max("end").over(order).alias("top")).agg(F.sum("top")).first()[0]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for tasks in (1, 4, 60):
            spark.conf.set("spark.sql.shuffle.partitions", tasks)
            dealt = scan.running(spans, KEYS, ["start"], {"top": ("max", F.col("end"))}, block=1 << 15)
            got = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum("top").alias("tops")).collect()
            assert len(got) >= min(tasks, 20) and sum(r.n for r in got) == 300_000 and sum(r.tops for r in got) == tops
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("block", [4, None])
@pytest.mark.parametrize("exact", [False, True])
def test_interval_tests_equal_brute_force(spark, exact, block):
    rng = random.Random(6)
    span = lambda: (rng.randint(0, 2), (s := rng.randint(0, 60)), s + rng.randint(1, 6))
    matches, ranges = [span() for _ in range(150)], [span() for _ in range(25)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id int, start int, end int")
    got = sorted(tuple(r) for r in matching.outside(frame(matches), frame(ranges), KEYS, allow_exact=exact, block=block).collect())
    assert got == sorted(m for m in matches if not any(m[0] == d and m[1] < e and m[2] > s and not (exact and (s, e) == m[1:]) for d, s, e in ranges))
    assert matching.outside(frame(matches), frame(ranges).limit(0), KEYS, allow_exact=exact).count() == len(matches)


@pytest.mark.parametrize("block", [3, None])
def test_containment_equals_brute_force(spark, block):
    rng = random.Random(8)
    segments, at = [], 0
    for k in range(40):
        size = rng.randint(1, 10)
        segments.append((rng.randint(0, 1), f"t{size}", at, at + size))
        at += size + rng.randint(0, 2)
    matches = [(d, (s := rng.randint(0, at)), s + rng.randint(1, 6), "m") for d in (0, 1) for _ in range(120)]
    terms = spark.createDataFrame([(f"t{n}",) for n in (3, 5, 6, 9)], "zh string")
    got = matching.not_contained(spark.createDataFrame(matches, "doc_id int, start int, end int, text string"), spark.createDataFrame(segments, "doc_id int, text string, start int, end int"), terms, KEYS, block=block)
    held = [x for x in segments if x[1] in ("t3", "t5", "t6")]
    want = [m for m in matches if not any(d == m[0] and a <= m[1] and e >= m[2] and (a, e) != m[1:3] for d, _, a, e in held)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_default_policy(spark):
    modes = {r.zh: r.mode for r in lexicon.with_mode(spark.createDataFrame([("给小",), ("把手",), ("选择",)], "zh string"), lexicon.default_policy(spark)).collect()}
    assert modes == {"给小": "blocked", "把手": "contextual", "选择": "stable"}
    window = F.struct(F.lit("门把手坏").alias("text"), F.lit(1).alias("targetStart"), F.lit(3).alias("targetEnd"), F.col("left"), F.col("right"))
    rows = spark.createDataFrame([("把手", "车门", "。"), ("把手", "他", "坏了"), ("把手", "他", "很"), ("给小", "", ""), ("选择", "", "")], "text string, left string, right string").withColumn("window", window)
    kept = [(r.text, r.left, r.context_evidence) for r in matching.apply_policy(rows, lexicon.default_policy(spark)).collect()]
    assert sorted(kept) == sorted([("把手", "车门", True), ("把手", "他", True), ("选择", "", False)])
    assert lexicon.floating_terms(spark).where("term = '朋友'").count() == 1
    held = lexicon.fragment_warnings(spark.createDataFrame([("公共", "公共汽车"), ("公共", None), ("公共汽", "公共汽车")], "zh string, meaning string"), ["公共汽车", "外国人"])
    assert [tuple(r) for r in held.collect()] == [("公共", "公共汽车")]
    ids = lexicon.listed_ids(spark.createDataFrame([('  "选择:choose:verb", "no id", "a:b:c",',), (None,)], "text string"))
    assert [r.candidate_id for r in ids.collect()] == ["选择:choose:verb", "a:b:c"]


def test_feedback_and_quiz_history(spark, tmp_path):
    rows = spark.createDataFrame([("选择", "choose", "m", "verb", "他 选择“了”。", "wrong", "  " + "x" * 130), ("选择", "choice", "m", "noun", "选择", "wrong", None)], "text string, en string, meaning string, part_of_speech string, sentence string, reason string, suggestion string")
    got = {r.en: r for r in learning.feedback(rows, F.lit(5)).collect()}
    assert got["choose"].key == '选择:choose:他{词}"了"。' and got["choose"].suggestion == "x" * 120 and got["choice"].suggestion == ""
    assert (got["choose"].status, got["choose"].created_at) == ("pending", 5)
    questions = spark.createDataFrame([(1, 1, "b"), (1, 0, "A"), (2, 0, "c")], "quiz int, number int, answer string")
    answers = spark.createDataFrame([(1, 0, " a "), (1, 1, None)], "quiz int, number int, given string")
    done = learning.quiz_events(questions, answers, ["quiz"], F.lit(9))
    path = str(tmp_path / "history")
    for _ in range(2):
        learning.append(done, path)
    history = spark.read.parquet(path).collect()
    assert [(r.quiz, [q.answer for q in r.questions], r.correct, r.created_at) for r in history] == [(1, ["A", "b"], 1, 9)] * 2
    learning.clear(spark, [path])
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(path).columns == done.columns


def test_orders_queues_and_sessions(spark):
    rows = spark.createDataFrame([("a", 3), ("b", 1), ("c", 2), ("d", 2)], "key string, due_at long")
    assert [r.key for r in learning.by_time(rows, "due_at", "key").collect()] == ["a", "c", "d", "b"]
    assert [r.key for r in learning.review_queue(rows, F.lit(2), "key").collect()] == ["b", "c", "d"]
    stats = learning.session_stats(spark.createDataFrame([(1, 5), (1, 2), (1, 3)], "session int, quality int"), ["session"]).first()
    assert (stats.rated, stats.remembered, stats.forgotten, round(stats.mean_rating, 3)) == (3, 2, 1, 3.333)


def test_manifest_steps(spark):
    pairs = spark.createDataFrame([("p1", "p2")], "left_path string, right_path string")
    known = spark.createDataFrame([("p1", "f1"), ("p2", "f2")], "path string, fingerprint string")
    assert [tuple(r) for r in corpus_dedup.edges_of(pairs, known).collect()] == [("f1", "f2")]
    with pytest.raises(Exception, match="no file for p2"):
        corpus_dedup.edges_of(pairs, known.where("path = 'p1'")).collect()
    spans = spark.createDataFrame([("f" * 64, 100, 102, "x" * 400), ("g" * 64, 0, 2, "abc")], "fingerprint string, start int, end int, text string")
    held = spark.createDataFrame([("f" * 12 + "-100-102",)], "id string")
    assert [r.id for r in sampling.new_candidates(spans, held).collect()] == ["g" * 12 + "-0-2"]
    around = {r.start: (r.context_start, r.context_end, len(r.context)) for r in sampling.with_margin(spans, F.col("text")).collect()}
    assert around == {100: (20, 182, 162), 0: (0, 3, 3)}
    samples = spark.createDataFrame([(1, "development", "old"), (2, "blind", "old")], "doc_id int, split string, note string")
    grouped = spark.createDataFrame([(1, "g1", "blind")], "doc_id int, group_id string, split string")
    assert corpus_dedup.repartitioned(samples.where("doc_id = 1"), grouped, "doc_id").first().split == "blind"
    with pytest.raises(Exception, match="no file for sample"):
        corpus_dedup.repartitioned(samples, grouped, "doc_id").collect()


def test_reports_without_a_gate_and_required_samples(spark):
    rows = [(i, "reviewed", s, c, d, "x", "noun", 0, 2) for i, (s, c, d) in enumerate([("blind", "a", "replace"), ("blind", "b", "replace"), ("blind", "a", "keepChinese"), ("development", "a", "replace"), ("validation", "b", "keepChinese")])]
    samples = spark.createDataFrame(rows, "id int, annotation_status string, split string, category string, expected_decision string, expected_candidate_id string, expected_part_of_speech string, start int, end int")
    matches = spark.createDataFrame([(0, 0, 2, "x", "noun"), (1, 1, 3, "x", "noun"), (2, 0, 2, "x", "noun"), (3, 0, 2, "x", "noun")], "id int, start int, end int, candidate_id string, part_of_speech string")
    r = quality.baseline_report(samples, matches).first()
    assert (r.total, r.expected_replacements, r.actual_replacements, r.correct_replacements, r.pos_expected, r.pos_correct) == (3, 2, 2, 1, 3, 1)
    assert r.replacement_precision == 0.5 and quality.baseline_report(samples.limit(0), matches).first().total == 0
    fine = quality.require_coverage(samples, 5, ["blind", "development", "validation"], ["a", "b"]).first()
    assert fine.reviewed == 5
    for least, splits, kinds in ((6, ["blind", "development", "validation"], ["a"]), (1, ["blind"], ["a"]), (1, ["blind", "development", "validation"], ["z"])):
        with pytest.raises(Exception, match="do not cover"):
            quality.require_coverage(samples, least, splits, kinds).collect()
    shown = spark.createDataFrame([("p",), ("p",), ("q",)], "path string")
    books = spark.createDataFrame([("p", "blind"), ("p", "blind"), ("r", "blind"), ("q", "validation")], "path string, split string")
    assert tuple(quality.corpus_attempts(books, shown, "path").first()) == (2, 2)


def test_names_stages_and_small_inputs(spark, tmp_path, monkeypatch):
    assert fresh(["a", "_B"], "b", "A", "b") == ["b", "_A", "__b"]
    with scope(spark):
        work = Workspace(spark, "gone")
        table = work.write(spark.range(5), "rows")
        assert table.count() == 5
    path = work.path.removeprefix("file:").replace("//", "/")
    assert not os.path.exists(path)
    spark.range(1000).selectExpr("id as doc_id", "cast(id as string) as text").coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    dealt = spread(spark, str(tmp_path), "t")
    assert dealt.count() == 1000 and dealt.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 1
    monkeypatch.setattr("wordloom.plans.inputs.SMALL", 0)
    assert "Exchange" not in spread(spark, str(tmp_path), "t")._jdf.queryExecution().toString()


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1), ("y", None)], "id string, n int")
    files.write_json(rows, str(tmp_path / "rows"))
    assert sorted(map(tuple, files.read_json(spark, str(tmp_path / "rows"), "id string, n int").collect()), key=str) == [("x", 1), ("y", None)]
    (tmp_path / "whole.json").write_text('[{"id": "a",\n "n": 2}]')
    assert files.read_json(spark, str(tmp_path / "whole.json"), "id string, n int").collect() == [("a", 2)]
    pages = spark.createDataFrame([(1, 2, "two"), (1, 1, "one"), (2, 1, " ")], "doc int, page int, text string")
    got = {r.doc: (r.text, r.error) for r in files.pages_to_documents(pages, "doc").collect()}
    assert got == {1: ("one\n\ntwo", None), 2: (" ", "no text layer")}
    assert files.demo_novel(spark).count() == 1
    sink = progress_sink(str(tmp_path / "log"))
    batch = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "key string, updated_at long, place string")
    for epoch in (0, 0):
        sink(batch, epoch)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 2 and learning.latest(log, ["key"], ["updated_at"]).first().place == "b"
    assert files.decode_bytes("中文".encode("gb18030")) == "中文" == files.decode_bytes(b"\xff\xfe" + "中文".encode("utf-16-le")) == files.decode_bytes("中文".encode("gb18030"), lenient=True)
