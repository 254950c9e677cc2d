"""Steps whose figures must grow no faster than the input: what a plan shuffles, and what holds beyond a bound."""

from pyspark.sql import functions as F

from wordloom.functions.context import candidate_id
from wordloom.operators import automaton, lexicon, matching, reader, segmentation, selection, structure
from wordloom.plans import han_queries, inputs


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lexicon_counts_documents_and_reads_the_texts_once(spark):
    rows = [(i, "en", "s", "abcd abcd wxyz abcdefghi" if i < 8 else "wxyz") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    found = inputs.lexicon(docs)
    assert sorted((r.zh, r.ord) for r in found.collect()) == [("abcd", 1), ("abcd", 2), ("wxyz", 1), ("wxyz", 2)]
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    twice = docs.withColumn("doc_id", F.when(F.col("doc_id") == 7, 6).otherwise(F.col("doc_id")))  # one id on two rows is one document
    assert {r.zh for r in inputs.lexicon(twice).collect()} == {"wxyz"}


def test_senses_are_joined_without_a_shuffle_of_the_matches(spark):
    docs = spark.createDataFrame([(i, "en", "s", "abcd the end") for i in range(9)], "doc_id long, lang string, source string, text string")
    entries = lexicon.dictionary(inputs.lexicon(docs), production=F.lit(True))
    rows = docs.select("doc_id", F.lit("abcd").alias("text"), F.lit("").alias("left"), F.lit(" the end").alias("right"), candidate_id(F.lit("a"), F.lit("b"), F.lit("c")).alias("note"))
    chosen = matching.select_sense(matching.with_boundaries(rows), entries)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in _plan(chosen) and "ShuffledHashJoin" not in _plan(chosen)
        assert {(r.en, r.reason) for r in chosen.collect()} == {("the abcd", "context")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_policy_of_few_terms_is_joined_without_a_shuffle_of_the_matches(spark):
    rows = spark.range(40).select("id", F.when(F.col("id") < 30, "选择").otherwise("陌生").alias("text"), F.when(F.col("id") % 2 == 0, "的").otherwise("x").alias("left"), F.lit("").alias("right"))
    policy = spark.createDataFrame([("选择", "contextual", [("leftSuffix", "的")]), ("陌生", "blocked", None)], "term string, mode string, allow array<struct<kind:string,value:string>>")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = matching.apply_policy(matching.with_boundaries(rows), policy)
        plan = _plan(kept)
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        assert sorted(r.id for r in kept.collect()) == list(range(0, 30, 2))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_han_rules_shuffles_no_match(spark, tmp_path):
    texts = [(1, "erion xion es"), (2, "entx en"), (3, "leei ion"), (4, ""), (5, None)]
    spark.createDataFrame([(i, "en", "s", x) for i, x in texts], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = han_queries.q_han_rules(spark, str(tmp_path))
        plan = _plan(kept)
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        assert sorted((r.doc_id, r.start, r.text, r.context_evidence) for r in kept.collect()) == [(1, 1, "选择", True), (1, 6, "太阳", False), (2, 0, "时间", True)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_hits_inside_listed_words_are_left_out_where_the_text_is(spark):
    docs = spark.createDataFrame([(1, "abcdef cdef-xabcdef abcd"), (2, "cdef"), (3, ""), (4, None)], "doc_id long, text string")
    terms = spark.createDataFrame([("abcd",), ("cdef",), ("abcdef",)], "zh string")
    plain = automaton.find(docs, ["doc_id"], terms, start_class="[a-z]")
    slow = matching.not_contained(plain, structure.words(docs, ["doc_id"], reach=0), terms, ["doc_id"], 8)
    want = sorted(slow.collect())
    for most_terms in (100, 1):
        found = automaton.find(docs, ["doc_id"], terms, start_class="[a-z]", whole=8, most_terms=most_terms)
        assert sorted(found.select(slow.columns).collect()) == want and len(want) == 7
    fast = automaton.find(docs, ["doc_id"], terms, start_class="[a-z]", whole=8)
    assert "Exchange" not in _plan(fast)


def test_words_beyond_the_former_bound_are_segmented(spark):
    words = spark.range(250_000).select(F.translate(F.lpad(F.col("id").cast("string"), 6, "0"), "0123456789", "abcdefghij").alias("zh"), F.lit(9).alias("uses"))
    docs = spark.createDataFrame([(1, "acdefgabcdef")], "doc_id long, text string")
    found = segmentation.segments(docs, ["doc_id"], words, uses="uses", script="[a-z]", reach=0)
    assert [r.text for r in found.orderBy("start").collect()] == ["acdefg", "abcdef"]


def test_located_words_and_rendered_tokens(spark):
    docs = spark.createDataFrame([(1, "abcd wxyz, abcd. \n\nAbcd? abcd. abcd"), (2, "none")], "doc_id long, text string")
    terms = spark.createDataFrame([("abcd",), ("wxyz",)], "zh string")
    found = automaton.find_words(docs, ["doc_id"], terms, located=structure.Located("[a-z]+ [a-z]+,", ".!?"))
    rows = sorted((r.start, r.place, r.paragraph) for r in found.collect())
    assert rows == [(11, 0, 1), (25, 24, 2), (31, 30, 2)]
    said = selection.phrased(docs, found, ["doc_id"], ".!?")
    assert sorted((r.start, r.sentence) for r in said.collect()) == [(11, "abcd wxyz, abcd."), (25, "abcd."), (31, "abcd")]
    tokens = selection.render(docs, found.withColumn("en", F.lit("X")), ["doc_id"])
    assert [(r.idx, r.value) for r in tokens.where("doc_id = 1").orderBy("idx").collect()] == [(0, "abcd wxyz, "), (1, "X"), (2, ". \n\nAbcd? "), (3, "X"), (4, ". "), (5, "X")]
    assert [(r.idx, r.value) for r in tokens.where("doc_id = 2").collect()] == [(0, "none")]


def test_turns_read_one_exchange(spark):
    rows = spark.createDataFrame([(1, 5, 1, "abcd"), (1, 9, 1, "abcd"), (1, 20, 2, "wxyz"), (1, 30, None, "wxyz")], "doc_id long, start int, paragraph int, text string")
    ranked = selection.turns(rows, ["doc_id"], [F.col("start")])
    assert [r.start for r in ranked.orderBy("turn").collect()] == [5, 20, 9, 30]
    assert selection.turns(rows, ["doc_id"], [F.col("start")])._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1


def test_the_reader_over_runs_shuffles_no_match_and_equals_the_general_way(spark):
    texts = [
        ("abcd", "abcdwx abcd the end. xabcd cdwxyz; cdwx abcdefghij! no stop abcd"), ("t", "zzabcdzz"), ("none", "nothing here"), ("x", ""), ("y", None), ("cdwx", "cdwx only"),
        ("q", "word " * 2000 + "abcdwxyz xcdwxx " * 2500), ("h", "他按住太阳能。研究人员说：太阳 能 研究 生"), ("阳", "太阳，能，太阳"),
    ]
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, title string, text string").repartition(2)
    words = ("abcd", "cdwx", "wxyz", "abcdwxyz", "bcdw", "abcdefghij", "word", "太阳", "太阳能", "研究", "研究生", "人员", "能太阳")
    entries = spark.createDataFrame([(w, w[::-1], "noun", w, "/x/", 1, [], [], i) for i, w in enumerate(words)] + [("cdwx", "other", "verb", "o", "", 1, [("rightPrefix", " only")], [], 99)], lexicon.ENTRY)
    policy = spark.createDataFrame([("wxyz", "blocked", None), ("bcdw", "contextual", [("rightPrefix", "x")])], "term string, mode string, allow array<struct<kind:string,value:string>>")
    for script, ends in (("[a-z]", ".!?"), (reader.HAN_CLASS, structure.SENTENCE_END)):
        given = dict(title="title", policy=policy, production=F.lit(True), script=script, ends=ends)
        slow = reader.find_terms(docs, ["doc_id"], entries, segments=structure.words(docs, ["doc_id"], pattern=f"(?:{script})+"), **given)
        fast = reader.find_terms(docs, ["doc_id"], entries, by_script=True, **given)
        columns = sorted(slow.columns)
        want = sorted(map(str, slow.select(columns).collect()))
        assert columns == sorted(fast.columns) and len(want) >= 3
        assert sorted(map(str, fast.select(columns).collect())) == want
        last = fast._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in last and "MapInArrow" in last  # the resolutions follow the search without a window or a shuffle of matches


def test_python_columns_come_in_slices_of_bounded_size(spark):
    import pyarrow as pa

    from wordloom.plans import workers

    rows = [b"x" * 400, None, b"", b"x" * 700, b"x" * 3000, b"x"]
    assert [len(part) for part in workers.slices(pa.array(rows), 1000)] == [3, 1, 1, 1]
    assert [len(part) for part in workers.slices(pa.array([], pa.string()))] == [0]
    most = []
    cut = workers.in_slices(lambda part: most.append(part.nbytes) or part)
    batch = pa.array(["y" * 200_000] * 50)
    assert sum(len(x) for x in cut(iter([batch, batch]))) == 100 and len(most) == 20
    docs = spark.createDataFrame([(i, "é́ﬁ" * i, bytearray(("é" * i).encode("gb18030"))) for i in range(300)] + [(300, None, None)], "doc_id long, text string, raw binary")
    from wordloom.functions.text import nfkc
    from wordloom.sources.files import decode_novel

    found = docs.select("doc_id", nfkc("text").alias("n"), decode_novel("raw").alias("t")).orderBy("doc_id").collect()
    assert [r.t for r in found] == [*["é" * i for i in range(300)], None] and found[2].n == "é́fi" * 2 and found[300].n is None


def test_sentences_and_open_starts_are_told_where_the_text_is(spark):
    docs = spark.createDataFrame([(1, "abcd wxyz. abcd!  abcd. Xabcd? abcdefghi ab"), (2, ""), (3, None)], "doc_id long, text string")
    terms = spark.createDataFrame([("abcd",), ("wxyz",)], "zh string")
    found = automaton.find_words(docs, ["doc_id"], terms, located=structure.Located("(?!)", ".!?"))
    slow = matching.containing(found, structure.sentences(docs, ["doc_id"], ends=".!?"), ["doc_id"])
    assert {(r.start, r.letters) for r in found.collect()} == {(r.start, len(r.sentence)) for r in slow.collect()} and found.count() == 5
    starts = automaton.open_starts(docs, ["doc_id"], terms)
    general = matching.uncertain_starts(structure.words(docs, ["doc_id"]), terms, ["doc_id"], 8, script="[a-z]")
    assert sorted(starts.collect()) == sorted(general.select("doc_id", "start").collect()) and starts.count() == 2
    assert "Exchange" not in _plan(starts)
    assert automaton.open_starts(docs, ["doc_id"], terms, most_terms=1) is None


def test_sketches_sort_no_more_than_they_keep(monkeypatch):
    import random

    import numpy as np

    from wordloom.operators import corpus_dedup

    def plain(text, width, size):
        sums = set()
        for i in range(len(text) - width + 1):
            h = 0
            for c in text[i : i + width]:
                h = (h * corpus_dedup.BASE + ord(c)) & 0xFFFFFFFF
            sums.add(h)
        return sorted(sums)[:size]

    rng = random.Random(7)
    texts = ["", "abc", "a" * 500, "ab" * 900, "".join(rng.choice("abc太阳😀") for _ in range(1500)), "".join(rng.choice("abcdefgh") for _ in range(40)) * 30]
    for text in texts:
        for width, size in ((20, 256), (20, 8), (1, 4), (7, 16), (16, 5)):
            assert corpus_dedup.sketch_of(text, width, size).tolist() == plain(text, width, size)
    most, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda x, **more: most.append(len(x)) or unique(x, **more))
    corpus_dedup.sketch_of("".join(chr(97 + rng.randrange(26)) for _ in range(50_000)))
    assert most == [512]


def test_letters_are_told_in_the_pass_that_sketches(spark):
    from wordloom.operators import corpus_dedup

    docs = spark.createDataFrame([(i, x) for i, x in enumerate([None, "", "Ａb1, é́ ﬁ 太阳\n" * 40, "a b-c d_e " * 30, "㐀䷿鿿一" * 12, "short"])], "doc_id long, text string")
    both = docs.select(corpus_dedup.letter_sketch("text").alias("a"), corpus_dedup.bottom_k(corpus_dedup.letters_only(F.col("text"))).alias("b"))
    assert all(r.a == r.b for r in both.collect()) and both.where("size(a) > 0").count() == 3
