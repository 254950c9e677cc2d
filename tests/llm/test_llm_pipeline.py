import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wordloom.llm import bpe, line_dedup, pii
from wordloom.llm.queries import tokenizer_path

DATA = Path("/root/testdata/sf0.01")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, path):
    rng = random.Random(12)
    say = lambda n: " ".join(f"v{rng.randint(0, 5000)}" for _ in range(n))
    base = say(200)
    near = base.split(" ")
    near[50] = "changed"
    rows = {
        0: base, 1: " ".join(near), 2: base, 3: say(120) + "\nThis shared line is long", 4: say(120) + "\nThis shared line is long", 5: "short", 6: None,
        7: "same words again " * 60, 8: say(90) + " bob@mail7.example.com " + say(20), 9: " | ".join(say(100).split()), 10: say(3000),
    }
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows.items()], SCHEMA).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return rows


def test_stages_and_run(spark, tmp_path):
    rows = make(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        out = str(tmp_path / f"stage-{name}")
        docs.write.mode("overwrite").parquet(out)
        docs = spark.read.parquet(out)
        if name != "sequences":
            assert docs.columns == [x.split(" ")[0] for x in SCHEMA.split(", ")]
            seen.append({r.doc_id: r.text for r in docs.collect()})
    good, lined, kept, masked = seen
    assert set(good) == {0, 1, 2, 3, 4, 8, 10} and all(good[i] == rows[i] for i in good)
    assert lined[3] == rows[3] and lined[4] == rows[4].split("\n")[0]
    assert set(lined) == {0, 1, 3, 4, 8, 10} and lined[0] == rows[0] and lined[1] == rows[1]
    assert set(kept) == {0, 3, 4, 8, 10}
    assert all(kept.values())
    assert masked[8] == pii.mask(kept[8], pii.find(kept[8])) and "<EMAIL>" in masked[8] and all(masked[i] == kept[i] for i in kept if i != 8)
    tokenizer = bpe.WordTable(tokenizer_path("byte_bpe_50k.json")).tokenizer
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in masked.items()}
    got = {r.doc_id: r.n for r in docs.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == want
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    run = corpus_pipeline.run(spark, str(tmp_path)).select(columns)
    assert sorted(run.collect()) == sorted(docs.select(columns).collect())
    assert re.match("quality", corpus_pipeline.STAGES[0][0]) and len(corpus_pipeline.STAGES) == 5


def test_lines_lose_no_text(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(f"u{rng.randint(0, 5000)}" for _ in range(n))
    first, second, third, shared = say(60), say(20), say(20), say(60)
    rows = [
        (1, first), (2, first + "\n" + second), (3, second + "\n" + third), (4, third + "\n\nyes"),  # a chain of short rests
        (5, shared), (6, shared + "\n" + say(90)), (9, "\n" + shared + "\n \n"),  # 9 is left without a word
        (7, "short but alone"), (8, None), (None, first),
    ]
    table = spark.createDataFrame([(i, t, 7, 8, 9) for i, t in rows], "doc_id long, text string, __row int, lines_before int, Lines_Dropped int")
    got = {r.doc_id: r for r in corpus_pipeline.lines(spark, table, "").collect()}
    assert {i: r.text for i, r in got.items()} == {1: first, 2: second, 3: third, 4: "\nyes", 5: shared, 6: rows[5][1].split("\n")[1], 7: rows[7][1], 8: "", None: first}
    assert all((r["__row"], r.lines_before, r["Lines_Dropped"]) == (7, 8, 9) for r in got.values())


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_every_line_of_the_corpus_stays_once(spark, tmp_path):
    work = str(tmp_path / "good")
    corpus_pipeline.quality(spark, spark.read.parquet(f"{DATA}/documents.parquet"), str(DATA)).write.parquet(work)
    good = spark.read.parquet(work)
    key = line_dedup.line_key(line_dedup.stripped(F.col("line")))
    keys = lambda docs: {r[0] for r in docs.select(F.explode(F.split("text", "\n")).alias("line")).where(F.length(line_dedup.stripped(F.col("line"))) >= 10).select(key).distinct().collect()}
    assert keys(corpus_pipeline.lines(spark, good, str(DATA))) == keys(good)


def test_near_copies_leave_one_of_a_group(spark, tmp_path):
    rng = random.Random(5)
    say = lambda n: [f"n{rng.randint(0, 5000)}" for _ in range(n)]
    groups = [say(300) for _ in range(5)]
    rows = [(10 * g + i, " ".join("edit" if j == 17 * i else w for j, w in enumerate(words))) for g, words in enumerate(groups) for i in range(1, 5)]
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    lined = stages["lines"](spark, table, "")
    assert lined.count() == 20  # every text is one line of its own
    assert {r.doc_id for r in stages["near_copies"](spark, lined, "").collect()} == {1, 11, 21, 31, 41}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, 11, 21, 31, 41}


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
