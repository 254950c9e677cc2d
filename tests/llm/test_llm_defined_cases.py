"""Clashing names, empty tables, overflow, long records, and finds that are none."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wordloom.llm import license_scan, pii, topk, warc

CLASH = "doc_id long, text string, failed long, n_words long, spans string, digest string, form string, license_id string, kind string, row int"


def clashing(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2, "s", "d", "f", "l", "k", 3) for i, t in enumerate(texts)], CLASH)


def test_clashing_names_and_empty_tables(spark):
    rng = random.Random(1)
    say = " ".join(f"word{rng.randint(0, 900)}" for _ in range(120))
    table = clashing(spark, [say, None, "", f"{say} mail bob@mail7.example.com now", "short"])
    good = corpus_pipeline.quality(spark, table, "")
    assert good.columns == table.columns and sorted(tuple(r)[2:] for r in good.collect()) == [(1, 2, "s", "d", "f", "l", "k", 3)] * 2
    lined = corpus_pipeline.lines(spark, good, "")
    kept = corpus_pipeline.near_copies(spark, lined, "")
    masked = corpus_pipeline.personal_data(spark, kept, "")
    assert lined.columns == kept.columns == masked.columns == table.columns
    assert {r.doc_id: "<EMAIL>" in r.text for r in masked.collect()} == {0: False}  # 3 is a near copy of 0
    assert {r.doc_id: len(r.spans) for r in pii.find_pii(table).collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 0}
    assert {r.doc_id: r.license_id for r in license_scan.scan_licenses(table).collect()} == dict.fromkeys(range(5))
    none = table.limit(0)
    assert license_scan.scan_licenses(none).count() == pii.find_pii(none).count() == pii.redact(none).count() == 0
    assert all(stage(spark, none, "").count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_scores_are_exact_or_raise(spark):
    frame = lambda *rows: spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    every = F.lit(True)
    big = float(1 << 22)
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(frame([big, -big], [big, big], [1.0, 0.0]), every).collect()}
    assert got[0, 1] == 0 and got[0, 2] == 256 * 256 * (1 << 22)
    with pytest.raises(OverflowError, match="exceed 64 bits"):
        topk.top_k(frame([float(1 << 24), 1.0], [1.0, 1.0]), every)
    with pytest.raises(Exception, match="exceeds 62 bits"):
        topk.top_k(frame([1e300, 1.0], [1.0, 1.0]), every)


def test_long_records_come_back_whole(spark, monkeypatch):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefghij<>é\r\n") for _ in range(3_000_000))
    pages = spark.createDataFrame([(1, "http://a.example/1", long), (2, "http://a.example/2", long), (3, "http://a.example/3", "short")], "page_id long, url string, html string")
    back = {warc_id: payload for warc_id, payload in warc.round_trip(pages).select(warc.page_number("record_id"), "payload").collect()}
    assert bytes(back[2]).decode() == long and back[1] is None and bytes(back[3]) == b"short"


@pytest.mark.parametrize("text", [
    "in 2019 Wall Street fell", "On 5 December the road 66 opened", "since 1998, Main Street was closed", "le 3 mai rue fermée", "the road 66 opened", "on 12 may Elm Street closed",
])
def test_dates_are_no_addresses(text):
    assert [x for x in pii.find(text) if x[0] == "address"] == []


@pytest.mark.parametrize("text,want", [
    ("my password is hunter2hunter2.", "hunter2hunter2"), ('api key = "sk-12ab34cd56ef"', "sk-12ab34cd56ef"), ("Passwort: geheim12geheim", "geheim12geheim"), ("access-key: AKIA99ZZ00YY11", "AKIA99ZZ00YY11"),
    ("mot de passe : abc123def456", "abc123def456"), ("token=abcdef123456.", "abcdef123456"),
])
def test_secrets_after_their_usual_cues(text, want):
    assert [text[a:b] for k, a, b in pii.find(text) if k == "secret"] == [want]


@pytest.mark.parametrize("text", ["the secret is nothing at all", "token of appreciation", "password is required"])
def test_cues_without_a_digit_are_no_secrets(text):
    assert [x for x in pii.find(text) if x[0] == "secret"] == []
