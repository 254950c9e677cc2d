import itertools
import random

import pytest
from pyspark.sql import functions as F

from wordloom.operators import automaton, corpus_dedup, digests, learning, lexicon, matching, quality, resolve, sampling, selection, structure
from wordloom.operators.components import connected_components
from wordloom.plans.staging import Workspace
from wordloom.sources import files

KEYS = ["doc_id"]
ENTRY = lexicon.ENTRY


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_chapters_with_preface_numerals_and_fallback(spark):
    story = "前言\n第一章 开始\n甲乙\n第 二 章 继续\n丙丁"
    plain = "无标题" * 2000
    got = structure.chapters(docs(spark, story, plain, None, ""), KEYS).orderBy("doc_id", "idx").collect()
    assert [(r.idx, r.title, r.text) for r in got if r.doc_id == 0] == [(0, "第一章 开始", "前言\n\n甲乙"), (1, "第 二 章 继续", "丙丁")]
    assert [len(r.text) for r in got if r.doc_id == 1] == [4500, 1500]
    assert not [r for r in got if r.doc_id in (2, 3)]


def test_sentences_paragraphs_occurrences(spark):
    table = docs(spark, "你好。 再见！？尾", "a\nb\n\n \n\nc", None)
    rows = structure.sentences(table, KEYS).where("doc_id = 0").orderBy("start").collect()
    assert [(r.text, r.start, r.end) for r in rows] == [("你好。", 0, 3), ("再见！？", 3, 8), ("尾", 8, 9)]
    spans = structure.paragraphs(table, KEYS).orderBy("doc_id", "start").collect()
    assert [(r.start, r.end) for r in spans if r.doc_id == 1] == [(0, 3), (8, 9)]
    assert [(r.start, r.end) for r in spans if r.doc_id == 2] == [(0, 0)]
    terms = spark.createDataFrame([(0, "aa"), (0, ".")], "doc_id long, term string")
    found = structure.occurrences(docs(spark, "aaaa.b"), KEYS, terms).orderBy("term", "start").collect()
    assert [(r.term, r.start, r.end) for r in found] == [(".", 4, 5), ("aa", 0, 2), ("aa", 2, 4)]


def entries(spark, *rows):
    full = [(zh, en, pos, en, phonetic, priority, rules, hints, i) for i, (zh, en, pos, phonetic, priority, rules, hints) in enumerate(rows)]
    return spark.createDataFrame(full, ENTRY)


def test_lexicon_rules(spark):
    raw = entries(spark, ("选择", "choose", "verb", "/x/", 1, [], []), ("选择", "choose", "verb", "/y/", 9, [], []), ("空中", "stewardess", "noun", "", 1, [], []), ("组织", "organize", "verb", "/o/", 1, [], []))
    over = entries(spark, ("组织", "organize", "verb", "", 5, [], ["组织活动"]), ("缺席", "absent", "adjective", "", 5, [], []))
    merged = lexicon.with_overrides(raw, over)
    assert {(r.zh, r.phonetic) for r in merged.where("zh = '组织'").collect()} == {("组织", "/o/")}
    assert merged.where("zh = '缺席'").count() == 0
    black = spark.createDataFrame([("organize",)], "term string")
    kept = lexicon.dictionary(merged, black).collect()
    assert [(r.zh, r.phonetic) for r in kept] == [("选择", "/x/")]


def test_sense_selection(spark):
    senses = lexicon.dictionary(entries(
        spark, ("选择", "choice", "noun", "/c/", 1, [("leftSuffix", "的")], []), ("选择", "choose", "verb", "/d/", 3, [("rightPrefix", "了")], []),
        ("目前", "currently", "adverb", "/e/", 1, [], []), ("目前", "present", "noun", "", 2, [], []),
    ))
    text = "我的选择；他选择了；的选择了；选择；目前"
    table = docs(spark, text)
    spans = structure.spans(table, KEYS, structure.match_spans("选择|目前", 14)(F.col("text")), context=True)
    ready = matching.with_boundaries(spans)
    got = {r.start: (r.en, r.reason, r.confidence) for r in matching.select_sense(ready, senses).collect()}
    assert got == {2: ("choice", "context", "high"), 6: ("choose", "context", "high"), 11: ("choose", "ambiguous", "low"), 15: ("choose", "ambiguous", "low"), 18: ("present", "ambiguous", "low")}
    approved = spark.createDataFrame([("目前:currently:adverb",)], "candidate_id string")
    fix = spark.createDataFrame([("k", "choice")], "key string, selected_english string")
    got = {r.start: (r.en, r.reason) for r in matching.select_sense(ready.withColumn("correction_key", F.when(F.col("start") == 15, "k")), senses, fix, approved).collect()}
    assert got[15] == ("choice", "correction") and got[18] == ("currently", "priority")
    policy = spark.createDataFrame([("目前", "contextual", [("leftSuffix", "；")]), ("选择", "blocked", None)], "term string, mode string, allow array<struct<kind:string,value:string>>")
    kept = matching.apply_policy(matching.select_sense(ready, senses), policy).collect()
    assert [(r.text, r.context_evidence) for r in kept] == [("目前", True)]


def test_ranges_and_containment(spark):
    matches = spark.createDataFrame([(0, 0, 2, "ab"), (0, 3, 5, "de"), (0, 6, 8, "gh")], "doc_id long, start int, end int, text string")
    ranges = spark.createDataFrame([(0, 1, 2), (0, 3, 5), (0, 8, 9)], "doc_id long, start int, end int")
    assert {r.start for r in matching.outside(matches, ranges, KEYS).collect()} == {6}
    assert {r.start for r in matching.outside(matches, ranges, KEYS, allow_exact=True).collect()} == {3, 6}
    whole = spark.createDataFrame([(0, 0, 4, "s1"), (0, 4, 9, "s2")], "doc_id long, start int, end int, text string")
    assert {r.start: r.sentence for r in matching.containing(matches, whole, KEYS).collect()} == {0: "s1", 3: "", 6: "s2"}


def test_compounds_and_uncertain_starts(spark):
    terms = spark.createDataFrame([("意大利人",), ("大利",)], "zh string")
    segments = spark.createDataFrame([(0, 0, 3, "意大利"), (0, 3, 4, "人"), (0, 4, 6, "大利")], "doc_id long, start int, end int, text string")
    assert {r.start: r.compound for r in matching.forms_compound(segments, terms, KEYS).collect()}[0] is True
    assert {r.start for r in matching.uncertain_starts(segments, terms, KEYS, 4).collect()} == {0, 1, 2, 3}
    found = automaton.find(docs(spark, "意大利人"), KEYS, terms)
    assert {(r.start, r.text) for r in found.collect()} == {(0, "意大利人"), (1, "大利")}
    held = matching.not_contained(found.where("text IN ('大利')"), segments.withColumn("text", F.lit("意大利人")), terms, KEYS)
    assert held.count() == 0


def best_worth(rows):
    best = 0
    for n in range(len(rows) + 1):
        for pick in itertools.combinations(rows, n):
            if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(pick, 2)):
                best = max(best, sum(x[2] for x in pick))
    return best


def test_resolution_is_optimal_and_disjoint(spark):
    rng = random.Random(7)
    rows = []
    for doc in range(40):
        for k in range(rng.randint(0, 9)):
            a = rng.randint(0, 14)
            rows.append((doc, a, a + rng.randint(1, 5), rng.randint(1, 9), f"{k}"))
    table = spark.createDataFrame(rows, "doc_id long, start int, end int, worth int, text string")
    got = resolve.resolve(table, KEYS).collect()
    for doc in {r[0] for r in rows}:
        mine = [(r.start, r.end, r.worth) for r in got if r.doc_id == doc]
        assert all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(mine, 2))
        assert sum(x[2] for x in mine) == best_worth([(a, b, w) for d, a, b, w, _ in rows if d == doc])


def test_score_and_source_merge(spark):
    row = spark.range(1).select(resolve.score(F.lit("high"), F.lit("both"), F.lit(0), F.lit(2)).alias("a"), resolve.score(F.lit("low"), F.lit("scan"), F.lit(2), F.lit(9)).alias("b")).first()
    assert (row.a, row.b) == (228, 900)
    rows = spark.createDataFrame([(0, 1, 3, "c", "segment", 1), (0, 1, 3, "c", "scan", 2), (0, 4, 6, "d", "scan", 3)], "doc_id long, start int, end int, candidate_id string, source string, x int")
    assert {(r.start, r.source, r.x) for r in resolve.merge_sources(rows, KEYS).collect()} == {(1, "both", 1), (4, "scan", 3)}


def pool(spark):
    rng = random.Random(3)
    rows = [(d, s * 4, s * 4 + 2, rng.choice(["aa", "bb", "cc", "dd"]), "x", f"s{s // 3}", "high", rng.choice(["both", "scan"]), rng.randint(0, 2)) for d in range(5) for s in range(20)]
    return spark.createDataFrame(rows, "doc_id long, start int, end int, text string, en string, sentence string, confidence string, source string, boundary_confidence int")


def test_caps_density_and_round_robin(spark):
    paragraphs = spark.createDataFrame([(d, a, a + 40) for d in range(5) for a in (0, 40)], "doc_id long, start int, end int")
    offered = selection.round_robin(pool(spark), paragraphs, KEYS)
    kept = selection.capped_pool(offered, KEYS)
    rows = kept.collect()
    for d in range(5):
        turns = sorted((r for r in offered.collect() if r.doc_id == d), key=lambda r: r.turn)
        seen_s, seen_t, want = {}, {}, []
        for r in turns:
            if seen_s.get(r.sentence, 0) < 2 and seen_t.get(r.text, 0) < 2:
                seen_s[r.sentence] = seen_s.get(r.sentence, 0) + 1
                seen_t[r.text] = seen_t.get(r.text, 0) + 1
                want.append(r.start)
        assert [r.start for r in sorted((r for r in rows if r.doc_id == d), key=lambda r: r.pool_rank)] == want
        assert {turns[0].paragraph, turns[1].paragraph} == {1, 2}
    shown = {n: {(r.doc_id, r.start) for r in selection.density_prefix(kept, KEYS, selection.density_value(F.lit(n))).collect()} for n in selection.DENSITY}
    assert shown["low"] < shown["medium"] < shown["high"]


def test_render_and_quiz(spark):
    table = docs(spark, "我选择苹果。", "空")
    chosen = spark.createDataFrame([(0, 1, 3, "选择", "choose", "我选择苹果。", 1), (0, 3, 5, "苹果", "apple", "我选择苹果。", 2)], "doc_id long, start int, end int, text string, en string, sentence string, pool_rank int")
    tokens = selection.render(table, chosen, KEYS).orderBy("doc_id", "idx").collect()
    assert [(r.doc_id, r.kind, r.value) for r in tokens] == [(0, "text", "我"), (0, "replacement", "choose"), (0, "replacement", "apple"), (0, "text", "。"), (1, "text", "空")]
    quiz = selection.quiz(chosen, KEYS).collect()
    assert [(q.prompt, q.answer) for q in quiz] == [("我____苹果。", "choose")]
    parts = spark.createDataFrame([(0, 0, "text", "a\n\nb"), (0, 1, "replacement", "w"), (0, 2, "text", "c\n\n\nd")], "doc_id long, idx int, kind string, value string")
    assert [(r.paragraph, r.value) for r in structure.paragraph_tokens(parts, KEYS).orderBy("idx", "part").collect()] == [(0, "a"), (1, "b"), (1, "w"), (1, "c"), (2, "d")]


def test_safety_gate(spark):
    rows = [("a", "high", 1, "priority", "a:x:n"), ("b", "high", 2, "priority", "b:x:n"), ("c", "low", 0, "ambiguous", "c:x:n"), ("d", "high", 0, "correction", "d:x:n"), ("e", "high", 0, "context", "e:x:n"), ("f", "high", 2, "priority", "f:x:n")]
    table = spark.createDataFrame(rows, "text string, confidence string, boundary_confidence int, reason string, candidate_id string").withColumn("context_evidence", F.lit(False))
    approved = spark.createDataFrame([("a:x:n",), ("b:x:n",), ("c:x:n",), ("f:x:n",)], "candidate_id string")
    floating = spark.createDataFrame([("f",)], "term string")
    assert {r.text for r in selection.safe(table, approved, floating).collect()} == {"a", "d", "f"}


def test_upsert_keeps_ids_and_last_row_wins(spark):
    held = spark.createDataFrame([("k1", 5, 1, "old"), ("k2", 9, 1, "keep")], "key string, id long, at long, value string")
    batch = spark.createDataFrame([("k1", None, 2, "a"), ("k1", None, 3, "b"), ("k3", None, 1, "n"), ("k4", None, 1, "m")], "key string, id long, at long, value string")
    got = {r.key: (r.id, r.value) for r in learning.upsert(held, batch, "key", "at").collect()}
    assert got["k1"] == (5, "b") and got["k2"] == (9, "keep")
    assert {got["k3"][0], got["k4"][0]} == {10, 11}
    empty = learning.upsert(held.limit(0), batch, "key", "at").collect()
    assert {r.id for r in empty} == {1, 2, 3}


def test_latest_lookup_setting_completion(spark):
    log = spark.createDataFrame([("a", 1, 1, False), ("a", 2, 2, True), ("b", 1, 3, False)], "key string, at long, v long, deleted boolean")
    assert [r.key for r in learning.latest(log, ["key"], ["at"], "deleted").collect()] == ["b"]
    assert learning.lookup(log, "key", "b").count() == 1
    settings = spark.createDataFrame([("density", "huge")], "key string, value string")
    assert learning.with_setting(settings).first().value == "medium"
    assert learning.with_setting(settings.withColumn("value", F.lit("low"))).first().value == "low"
    scrolls = spark.createDataFrame([("a", 1, 10), ("a", 2, 97), ("a", 3, 99), ("b", 1, 98), ("c", 1, 5)], "key string, at long, percent long")
    assert [(r.key, r.completed_at) for r in learning.completions(scrolls, ["key"], "at").collect()] == [("a", 2)]
    pages = spark.range(1, 10530).select(F.lit(0).alias("k"), F.col("id").alias("page"), F.lit(10529).alias("total"))
    assert learning.progress_changes(pages, ["k"]).count() <= 59


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 230)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    table = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r.node: r.root for r in connected_components(table, Workspace(spark, "test")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert connected_components(table.limit(0), Workspace(spark, "test")).count() == 0


def test_sketches_pairs_and_groups(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefghij") for _ in range(900))
    near = base[:450] + "zz" + base[450:]
    table = docs(spark, base, base, near, "short", None, "".join(rng.choice("klmnopqrst") for _ in range(900)))
    sketches = table.select("doc_id", corpus_dedup.bottom_k(corpus_dedup.letters_only(F.col("text"))).alias("signature"))
    rows = {r.doc_id: r.signature for r in sketches.collect()}
    grams = {sum(ord(c) * pow(16777619, 19 - k, 2**32) for k, c in enumerate(base[i : i + 20])) % 2**32 for i in range(len(base) - 19)}
    assert rows[0] == sorted(grams)[:256] and rows[3] == [] and rows[4] == []
    pairs = {(r.a, r.b) for r in corpus_dedup.near_links(sketches, "doc_id").collect()}
    assert pairs == {(0, 1), (0, 2)}
    groups = {r.doc_id: r.group_id for r in corpus_dedup.groups(table, "doc_id", corpus_dedup.near_links(sketches, "doc_id"), "seed").collect()}
    assert groups[0] == groups[1] == groups[2] and len(set(groups.values())) == 4


def test_systematic_and_stratified_samples(spark):
    rng = random.Random(2)
    rows = [(d, s, s + 2, rng.choice(sampling.CATEGORIES)) for d in range(3) for s in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, start long, end long, category string")
    got = sampling.stratified(table, KEYS, 24, ["start"]).collect()
    for d in range(3):
        chosen, used = [], set()
        for cat in sampling.CATEGORIES:
            bucket = [s for dd, s, _, c in rows if dd == d and c == cat]
            for i in range(min(3, len(bucket))):
                s = bucket[i * len(bucket) // 3]
                if s not in used:
                    chosen.append(s)
                    used.add(s)
        chosen += [s for dd, s, _, c in rows if dd == d and s not in used][: 24 - len(chosen)]
        assert sorted(r.start for r in got if r.doc_id == d) == sorted(chosen)
    assert sampling.annotation_pack(table, 10, ["start", "doc_id"], 8).count() == 10


def test_report_golden(spark):
    labels = spark.createDataFrame([("1", "dev", "a", "replace", "x:y:noun", "noun"), ("2", "dev", "a", "keepChinese", None, None), ("3", "dev", "b", "replace", "p:q:verb", "verb")], "id string, split string, category string, expected_decision string, expected_candidate_id string, expected_part_of_speech string")
    said = spark.createDataFrame([("1", "replace", "x:y:noun", "verb", True, 1), ("3", "replace", "p:z:verb", "verb", False, 1), ("3", "keepChinese", None, None, False, 0)], "id string, decision string, candidate_id string, part_of_speech string, segmentation_correct boolean, ord int")
    outcomes = quality.judged(labels, said)
    r = quality.report(outcomes).first()
    assert (r.actual_replacements, r.correct_replacements, r.replacement_precision, r.part_of_speech_accuracy, r.abstention_accuracy, r.replacement_coverage) == (2, 1, 0.5, 0.0, 1.0, 0.5)
    assert quality.gate(quality.report(outcomes), {"replacement_precision": 0.5}).first().passed is True
    none = quality.report(outcomes.limit(0)).first()
    assert none.total == 0 and none.replacement_precision == 0.0 and none.replacement_rate_upper == 0.0
    assert quality.top_errors(quality.per_candidate(outcomes)).first().predicted_id == "p:z:verb"


def test_reports_of_all_levels_equal_the_single_ones(spark):
    rng = random.Random(4)
    rows = [(str(i), rng.choice(["dev", "blind"]), rng.choice("ab"), rng.choice(["replace", "keepChinese"]), rng.choice(["x:y:noun", None]), rng.choice(["noun", None])) for i in range(80)]
    labels = spark.createDataFrame(rows, "id string, split string, category string, expected_decision string, expected_candidate_id string, expected_part_of_speech string")
    said = spark.createDataFrame([(str(i), rng.choice(["replace", "keepChinese"]), rng.choice(["x:y:noun", "x:z:noun"]), "noun", rng.random() < 0.7, 0) for i in range(0, 80, 2)], "id string, decision string, candidate_id string, part_of_speech string, segmentation_correct boolean, ord int")
    genres = spark.createDataFrame([(str(i), [["war"], ["war", "love", "war"], [], None][i % 4]) for i in range(76)], "id string, genres array<string>")
    outcomes = quality.judged(labels, said)
    got = quality.reports(outcomes, genres, "id").collect()
    figures = lambda r: {k: v for k, v in r.asDict().items() if k not in ("level", "split", "category", "genre")}
    assert [figures(r) for r in got if r.level == "all"] == [quality.report(outcomes).first().asDict()]
    assert {(r.split, r.category): figures(r) for r in got if r.level == "category"} == {(r.split, r.category): figures(r) for r in quality.report(outcomes, ["split", "category"]).collect()}
    assert {r.genre: r.total for r in got if r.level == "genre"} == {r.genre: r.total for r in quality.by_genre(outcomes, genres.where("genres IS NOT NULL"), "id").collect()}


def test_proposals_go_by_sound(spark):
    rows = spark.createDataFrame([("中:a", "t", 5), ("阿:a", "t", 5), ("波:a", "t", 5), ("波:A", "t", 7), ("云:a", "t", 1)], "candidate_id string, term string, development_support long")
    assert [(r.place, r.candidate_id) for r in quality.proposal(rows).collect()] == [(1, "波:A"), (2, "阿:a"), (3, "波:a"), (4, "中:a"), (5, "云:a")]


def test_digests_stream_their_members(spark):
    import hashlib

    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *map(str, range(3000))])) for _ in range(9000)] + [("empty", None)]
    table = spark.createDataFrame(rows, "g string, m string").repartition(5)
    got = {r.g: r.digest for r in digests.ordered_digest(table, ["g"], "m", ":", 16).collect()}
    want = {g: hashlib.sha256(":".join(sorted(m for k, m in rows if k == g and m is not None)).encode()).hexdigest()[:16] for g in {k for k, _ in rows}}
    assert got == want and digests.ordered_digest(table.limit(0), ["g"], "m").count() == 0


def test_pairs_equal_brute_force_and_common_hashes_rarely_probe(spark):
    rng = random.Random(13)
    base = [sorted(rng.sample(range(3000), 40)) for _ in range(6)]
    rows = [(i, sorted({*range(10000, 10030), *[x for x in base[i % 6] if rng.random() > 0.04], *rng.sample(range(5000, 9000), rng.randint(0, 4))})) for i in range(60)] + [(60, []), (61, [1]), (62, [1])]
    sketches = spark.createDataFrame(rows, "doc_id long, signature array<long>")
    got = {(r.a, r.b) for r in corpus_dedup.similar_sketches(sketches, "doc_id", 0.9).collect()}
    want = {(a, b) for a, s in rows for b, t in rows if a < b and s and t and len({*s} & {*t}) / min(len(s), len(t)) >= 0.9}
    assert got == want
    tried = corpus_dedup.candidate_pairs(sketches, "doc_id", 0.9).count()
    assert tried <= 3 * len(want)


def test_predictions_merge_and_promotions(spark):
    samples = spark.createDataFrame([("a", 0, 2, "replace"), ("b", 0, 2, "keepChinese"), ("c", 5, 7, "keepChinese")], "id string, start int, end int, expected_decision string")
    matches = spark.createDataFrame([("a", 0, 2, "w:x:n", "n"), ("b", 1, 3, "w:y:n", "n")], "id string, start int, end int, candidate_id string, part_of_speech string")
    got = {r.id: (r.decision, r.segmentation_correct) for r in quality.predictions(samples, matches, matches).collect()}
    assert got == {"a": ("replace", True), "b": ("keepChinese", False), "c": ("keepChinese", True)}
    held = spark.createDataFrame([("a", "replace", "i", "noun", "unreviewed")], "id string, expected_decision string, expected_candidate_id string, expected_part_of_speech string, annotation_status string")
    bad = spark.createDataFrame([("a", "maybe", None, None, 1)], "id string, decision string, candidate_id string, part_of_speech string, ord int")
    with pytest.raises(Exception, match="bad label"):
        quality.merge_labels(held, bad).collect()
    rows = [("t", "development", "reviewed", "replace", "t:x:n", "agree")] * 2 + [("u", "development", "reviewed", "replace", "u:x:n", "open")] * 2 + [("u", "validation", "reviewed", "keepChinese", None, None)]
    table = spark.createDataFrame(rows, "term string, split string, annotation_status string, expected_decision string, expected_candidate_id string, review_status string")
    verdicts = spark.createDataFrame([("t:x:n", "approve"), ("u:x:n", "approve")], "candidate_id string, verdict string")
    assert {r.candidate_id: r.status for r in quality.promotions(table, verdicts).collect()} == {"t:x:n": "approved-for-production-batch", "u:x:n": "needs-rule-or-more-evidence"}


def test_files_decoding_and_pages(spark, tmp_path):
    assert files.decode_bytes("中文小说".encode("utf-8-sig")) == "中文小说"
    assert files.decode_bytes(b"\xd6\xd0\xce\xc4") == "中文"
    assert files.decode_bytes(b"\xff\xfe" + "中".encode("utf-16-le")) == "中"
    assert files.decode_bytes(b"\xff\xff\xff") is None and files.decode_bytes(None) is None
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.TXT").write_bytes("第一章\r\n好".encode("gb18030"))
    (tmp_path / "b.txt").write_bytes(b"  ")
    (tmp_path / "c.jpg").write_bytes(b"x")
    rows = {r.file_name: r for r in files.read_novels(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.TXT", "b.txt"} and rows["a.TXT"].text == "第一章\n好" and rows["b.txt"].error == "empty file"
    assert rows["a.TXT"].fingerprint.startswith("novel-")
    item = F.array(*[F.struct(F.lit(s).alias("str"), F.lit(e).alias("eol")) for s, e in (("ab", False), ("cd", True), ("中", False), ("x", True))])
    assert spark.range(1).select(files.page_text(item).alias("t")).first().t == "ab cd\n中x"
    recorded = spark.createDataFrame([(rows["a.TXT"].path, "0")], "path string, sha256 string")
    assert files.changed_files(files.read_novels(spark, str(tmp_path)), recorded).count() == 1


def test_review_stream_equals_the_fold(spark, tmp_path):
    from wordloom.streaming.reviews import review_stream

    rng = random.Random(4)
    rows = [(f"k{i % 3}", 1000 * i, i, float(rng.randint(0, 5))) for i in range(40)]
    schema = "key string, at_ms long, event_id long, quality double"
    spark.createDataFrame(rows[:20], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    spark.createDataFrame(rows[20:], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").option("latestFirst", "false").parquet(str(tmp_path / "in"))
    query = review_stream(stream).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = {r.key: r for r in spark.sql("SELECT key, max_by(struct(*), reviews) AS r FROM states GROUP BY key").select("r.*").collect()}
    fold = learning.fold_reviews(spark.createDataFrame(rows, schema), ["key"]).collect()
    for r in fold:
        assert (got[r.key].reviews, got[r.key].interval, got[r.key].repetitions, got[r.key].due_at) == (r.reviews, r.interval, r.repetitions, r.due_at)
        assert got[r.key].ease == pytest.approx(r.ease)


def test_scans_of_whole_documents_equal_brute_force(spark, tmp_path):
    import re
    import random

    from wordloom.plans import catalog

    rng = random.Random(4)
    words = ["able", "stable", "ables", "table", "tab", "unstable", "ab", "tables", "Stab", "abl"]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", ",", "\n"]) for _ in range(rng.randint(0, 40)))) for i in range(40)] + [(40, None), (41, "")]
    spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    low = {i: (t or "").lower() for i, t in rows}
    held = {}
    for i, t in low.items():
        for w in re.findall("[a-z]+", t):
            held.setdefault(w, set()).add(i)
    terms = {w for w, at in held.items() if 4 <= len(w) <= 8 and len(at) >= 8}
    assert len(terms) > 4
    longest, starts = set(), set()
    for i, t in low.items():
        for k in range(len(t)):
            fits = [t[k : k + n] for n in range(4, 9) if t[k : k + n] in terms and k + n <= len(t)]
            if fits:
                longest.add((i, k, fits[-1], k + len(fits[-1])))
        for m in re.finditer("[a-z]+", t):
            if len(m[0]) <= 8 and m[0] not in terms:
                starts |= {(i, k) for k in range(*m.span())}
    got = catalog.QUERIES["q_longest_match_documents"](spark, str(tmp_path)).collect()
    assert len(got) == len(longest) and {(r.doc_id, r.start, r.text, r.stop) for r in got} == longest
    got = catalog.QUERIES["q_uncertain_starts_documents"](spark, str(tmp_path)).collect()
    assert len(got) == len(starts) and {(r.doc_id, r.start) for r in got} == starts
