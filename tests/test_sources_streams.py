"""Streams with timers and restarts; novels and manifests as data sources."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from wordloom.functions.numbers import DAY_MS
from wordloom.operators import learning
from wordloom.sources import files, manifest_sink, novel_source
from wordloom.streaming import learning_states

REVIEW = "key string, at timestamp, at_ms long, event_id long, quality double"
SCROLL = "reader string, chapter string, at_ms long, event_id long, percent int"


@pytest.fixture
def rocks(spark):
    spark.conf.set(*learning_states.STORE)
    yield spark
    spark.conf.unset(learning_states.STORE[0])


def play(spark, source, schema, batches, query, folder):
    """Every batch as a file and a restart of its own; all rows that came out."""
    os.makedirs(source, exist_ok=True)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = query(spark.readStream.schema(schema).parquet(source))
        out = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/at").outputMode("append").trigger(availableNow=True).start()
        assert out.awaitTermination(120) and out.exception() is None, i
    return spark.read.parquet(f"{folder}/out").collect()


def stamp(at_ms):
    import datetime

    return datetime.datetime.fromtimestamp(at_ms / 1000)


def test_words_are_reviewed_and_fall_due_across_restarts(rocks, tmp_path):
    rng, day = random.Random(3), DAY_MS
    rows, n = [], 0
    for batch in range(3):
        own = []
        for key in "abc":
            for _ in range(rng.randint(1, 2)):
                at, n = (10 + batch) * day + rng.randint(0, day // 2), n + 1
                own.append((key, stamp(at), at, n, float(rng.randint(2, 5))))
        rows.append(sorted(own, key=lambda r: r[2]))
    rows.append([("z", stamp(400 * day), 400 * day, 999, 4.0)])  # moves the watermark past every due time
    rows.append([("z", stamp(401 * day), 401 * day, 1000, 4.0)])
    got = play(rocks, str(tmp_path / "in"), REVIEW, rows, learning_states.due_words, str(tmp_path))
    flat = rocks.createDataFrame([r for own in rows for r in own], REVIEW)
    want = {r.key: (r.reviews, round(r.ease, 9), r.interval, r.repetitions, r.due_at) for r in learning.fold_reviews(flat, ["key"]).collect()}
    state = lambda r: (r.reviews, round(r.ease, 9), r.interval, r.repetitions, r.due_at)
    last = {}
    for r in got:
        if r.kind == "reviewed" and r.reviews >= last.get(r.key, (0,))[0]:
            last[r.key] = state(r)
    assert last == want
    due = [(r.key, state(r)) for r in got if r.kind == "due"]
    assert {k for k, _ in due} >= {"a", "b", "c"} and all(want[k] == s for k, s in due if k in "abc" and s[0] == want[k][0])
    assert sorted(k for k, s in due if k in "abc" and s == want[k]) == ["a", "b", "c"]  # once each, in its last state


def test_chapters_are_completed_once_across_restarts(rocks, tmp_path):
    rng, rows, n = random.Random(5), [], 0
    for batch in range(4):
        own = []
        for reader in "pq":
            for chapter in ("c1", "c2", "c3"):
                for _ in range(rng.randint(0, 3)):
                    n += 1
                    own.append((reader, chapter, batch * 1000 + n, n, rng.choice([3, 50, 95, 96, 100])))
        rows.append(own or [("p", "c9", batch * 1000, n + 500, 10)])
    got = play(rocks, str(tmp_path / "in"), SCROLL, rows, learning_states.completion_stream, str(tmp_path))
    flat = rocks.createDataFrame([r for own in rows for r in own], SCROLL)
    want = learning.completions(flat, ["reader", "chapter"], "at_ms").select("reader", "chapter", "completed_at").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def novels(folder):
    os.makedirs(folder / "deep", exist_ok=True)
    (folder / "a.txt").write_bytes("第一章 雨\r\n雨下了。".encode())
    (folder / "b.TXT").write_bytes("﻿ＡＢＣ 中文".encode("utf-8"))
    (folder / "deep" / "c.txt").write_bytes("中文小说".encode("gb18030"))
    (folder / "deep" / "d.txt").write_bytes(b" \n")
    (folder / "deep" / "e.txt").write_bytes(b"\xff\xff\xff\x00bad")
    (folder / "f.pdf").write_bytes(b"no text")


def test_the_data_source_equals_the_binary_files(spark, tmp_path):
    novels(tmp_path)
    names = ["file_name", "file_size", "modified_ms", "sha256", "text", "fingerprint", "error"]
    want = sorted(map(tuple, files.read_novels(spark, str(tmp_path)).select(names).collect()), key=str)
    for options in ({}, {"bytesPerPartition": "1"}):
        found = novel_source.load_novels(spark, str(tmp_path), **options)
        assert sorted(map(tuple, found.select(names).collect()), key=str) == want and len(want) == 5
        assert found.rdd.getNumPartitions() == (5 if options else 1)
    assert novel_source.load_novels(spark, f"file://{tmp_path}", recursive="false").count() == 2
    os.makedirs(tmp_path / "none")
    assert novel_source.load_novels(spark, str(tmp_path / "none")).count() == 0


def test_the_stream_reads_new_and_changed_files_only(spark, tmp_path):
    folder = tmp_path / "in"
    novels(folder)
    seen = []

    def run():
        before = len(seen)
        query = novel_source.stream_novels(spark, str(folder)).writeStream.foreachBatch(lambda df, i: seen.append({(r.file_name, r.file_size) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "at")).trigger(once=True).start()
        assert query.awaitTermination(120) and query.exception() is None
        return set().union(*seen[before:]) if len(seen) > before else set()

    assert {n for n, _ in run()} == {"a.txt", "b.TXT", "c.txt", "d.txt", "e.txt"}
    (folder / "g.txt").write_text("new")
    (folder / "a.txt").write_text("changed now")
    assert run() == {("g.txt", 3), ("a.txt", 11)}


def test_manifests_are_ordered_and_whole(spark, tmp_path):
    path = str(tmp_path / "m" / "samples.json")
    rows = spark.createDataFrame([(i * 37 % 101, f"名{i}", [i, i + 1], None if i % 3 else "x") for i in range(101)], "id long, name string, span array<int>, note string").repartition(7)
    os.makedirs(tmp_path / "m")
    manifest_sink.write_manifest(rows, path, ["id"], field="samples", head={"schemaVersion": 1, "books": []})
    text = open(path, encoding="utf-8").read()
    want = {"schemaVersion": 1, "books": [], "samples": [r.asDict() for r in rows.orderBy("id").collect()]}
    assert text == json.dumps(want, ensure_ascii=False, indent=2) + "\n" and os.listdir(tmp_path / "m") == ["samples.json"]
    back = files.read_json(spark, path, "schemaVersion int, samples array<struct<id:long,name:string,span:array<int>,note:string>>")
    assert back.select(F.explode("samples").alias("s")).select("s.*").exceptAll(rows).count() == 0
    bad = rows.withColumn("name", F.when(F.col("id") == 50, F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="lost"):
        manifest_sink.write_manifest(bad, path, ["id"], field="samples")
    assert open(path, encoding="utf-8").read() == text and os.listdir(tmp_path / "m") == ["samples.json"]
    manifest_sink.write_manifest(rows.limit(0), path, ["id"])
    assert json.load(open(path, encoding="utf-8")) == []
    split = str(tmp_path / "split")
    manifest_sink.write_manifest(rows.withColumn("side", F.when(F.col("id") < 30, "left").otherwise("right")), split, ["id"], by="side")
    assert sorted(os.listdir(split)) == ["left.json", "right.json"]
    assert [r["id"] for r in json.load(open(f"{split}/left.json", encoding="utf-8"))] == list(range(30))
