import hashlib
import itertools
import random
import re
import string
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import bpe, html_text, jaccard_join, license_scan, line_dedup, packing, partenum, pii, quality_rules, shingles, topk, warc
from wordloom.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def docs(spark, rows):
    """Documents with extra columns whose names operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, rep long, digest string, pos int"
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", 0) for i, t in rows], schema)


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randint(0, words)}" for _ in range(n))


def edited(rng, text, share):
    return " ".join(f"e{rng.randint(0, 9999)}" if rng.random() < share else w for w in text.split(" "))


def corpus(seed):
    rng = random.Random(seed)
    rows = [None, "", " \t\n", "one", "One", "two words", "a b c d", "a b c d e", "a b c d e f", "b c d e f g"]
    for size in (12, 30, 60, 150, 700):
        for _ in range(6):
            base = sentence(rng, size)
            rows += [base, base, base.upper(), edited(rng, base, 0.01), edited(rng, base, 0.02), edited(rng, base, 0.05), base + " tail words here"]
    chain = sentence(rng, 200)
    for _ in range(12):
        chain = edited(rng, chain, 0.012)
        rows.append(chain)
    rng.shuffle(rows)
    return list(enumerate(rows))


def feature_sets(rows):
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        out[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    return out


def linked(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def brute_components(rows):
    sets = feature_sets(rows)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if linked(sets[a], sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(0)
    for size in [*range(4, 40), *range(40, 400, 23), 1500, 6000]:
        for _ in range(12):
            grow = int(rng.integers(0, size // 4 + 1))
            base = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            most = len(base) + grow
            common = -(-4 * most // 5)
            lost = int(rng.integers(0, max(0, len(base) - common) + 1))
            fresh = rng.integers(0, 2**64, most - len(base), dtype=np.uint64)
            other = np.unique(np.concatenate((rng.permutation(base)[lost:], fresh)))
            inter = len(np.intersect1d(base, other))
            if 100 * inter >= 80 * (len(base) + len(other) - inter) and not np.array_equal(base, other):
                assert set(partenum.signatures(base).tolist()) & set(partenum.signatures(other).tolist()), (len(base), len(other), inter)


def test_shingles_of_long_texts_are_cut_at_words(monkeypatch):
    text = " ".join(f"Wörd{i}" for i in range(3000))
    whole = shingles.shingles(text)
    monkeypatch.setattr(shingles, "PIECE", 100)
    assert np.array_equal(whole, shingles.shingles(text)) and len(whole) == 2996
    assert len(shingles.shingles(None)) == len(shingles.shingles(" \n")) == 0 and len(shingles.shingles("a b")) == 1


@pytest.mark.parametrize("block", [4096, 3])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = corpus(11)
    got = jaccard_join.jaccard_components(docs(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    kept = {r.doc_id for r in jaccard_join.keep_one(docs(spark, rows)).collect()}
    assert kept == {i for i, (_, c) in brute_components(rows).items() if i == c}


@pytest.mark.parametrize("block,sample", [(4096, 64), (3, 2)])
def test_links_and_their_numbers_equal_brute_force(spark, monkeypatch, block, sample):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "SAMPLE", sample)
    monkeypatch.setattr(jaccard_join, "HOT_IN_SAMPLE", sample)
    rows = corpus(17)
    sets = feature_sets(rows)
    counts = {i: sum(linked(s, t) for j, t in sets.items() if i != j) for i, s in sets.items() if s}
    table = docs(spark, rows)
    assert {r.doc_id: r.n_links for r in jaccard_join.link_counts(table).collect()} == counts
    pairs, members = jaccard_join.jaccard_links(table)
    of = {r.doc_id: r.set_id for r in members.collect()}
    want = {(max(a, b), min(a, b)) for a, b in itertools.combinations(sorted(set(of.values())), 2) if linked(sets[a], sets[b])}
    assert {(r.a, r.b) for r in pairs.collect()} == want and all(sets[i] == sets[j] for i, j in of.items())
    assert jaccard_join.link_counts(table.limit(0)).count() == 0


def test_a_signature_of_all_sets_is_dealt_out(spark, monkeypatch):
    """All sets share one signature, nothing else; it is hot, and its bucket is cut into blocks."""
    monkeypatch.setattr(jaccard_join, "signatures", lambda found: np.array([7], np.uint64) if len(found) else np.empty(0, np.uint64))
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    monkeypatch.setattr(jaccard_join, "SAMPLE", 1)
    monkeypatch.setattr(jaccard_join, "HOT_IN_SAMPLE", 2)
    rows = corpus(19)[:90]
    got = jaccard_join.jaccard_components(docs(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_components_of_empty_and_repeated_rows(spark):
    table = docs(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (None, "a b c d e f")])
    assert jaccard_join.jaccard_components(table.limit(0)).count() == 0
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(table).collect() if r.doc_id)
    assert got == [(1, 2, 1), (1, 2, 1), (2, 0, 2)]


ODD = ["", None, "Hello  wörld's\n 123", "<|endoftext|>x <|startoftext|>", "é é", "\n\n\n", "a b 　c\x1cd", "x" * 5000, "don't  stop\r\n\tnow", "中文 字", "a\n\nb \n c"]


def test_bpe_equals_the_library(spark):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice(["ab", " ", "\n", ".", "É", "9", "  "]) for _ in range(200)) for _ in range(30)]
    table = docs(spark, list(enumerate(texts)))
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = tokenizer_path(name)
        tokenizer = bpe.WordTable(path).tokenizer
        for r in [*bpe.decode(bpe.encode(table, path), path).collect(), *bpe.encode_decode(table, path).collect()]:
            want = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
            assert r.ids == want and r.decoded == tokenizer.decode(want, skip_special_tokens=False)
    assert bpe.encode(table.limit(0), path).count() == 0


def test_word_table_stays_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_WORDS", 50)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 20)
    table = bpe.WordTable(tokenizer_path("byte_bpe_50k.json"))
    for k in range(20):
        texts = [f"word{k} same again{j}{k}" for j in range(20)]
        ids, sizes = table.encode(texts)
        assert ids.tolist() == [x for t in texts for x in table.tokenizer.encode(t, add_special_tokens=False).ids] and sizes.sum() == len(ids)
        assert len(table.place) < 100


def test_words_enter_the_table_without_their_marks():
    table = bpe.WordTable(tokenizer_path("byte_bpe_50k.json"))
    assert table.cuts_marks and not bpe.WordTable(tokenizer_path("word_bpe_49k.json")).cuts_marks
    marks = ".,;:!?#*$%&|<>()"
    texts = [f"{x} word{m} word{m}{m} café{m}" for x in ("", "a") for m in marks] + ["×. ÷, ¿. é. it's.' a.b,c'd. 1.a,2 x\u00a0y. \n\n z. \t"]
    ids, sizes = table.encode(texts[:-1])
    assert sum(b"word" in w or b"caf" in w for w in table.place) == 2  # without the cut 48
    want = [table.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [x for w in want[:-1] for x in w] and sizes.tolist() == list(map(len, want[:-1]))
    for part in (texts, texts[::-1], [None, " ", "", "x ", " x"]):
        ids, sizes = table.encode(part)
        want = [table.tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]
        assert ids.tolist() == [x for w in want for x in w] and sizes.tolist() == list(map(len, want))


def count_repeats(words):
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    return len({p + k for v in at.values() if len(v) > 1 for p in v for k in range(3)})


def test_quality_measures_equal_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", "a", "a a a a a", "#*$ %&|<>", "x\nx\nx\n \n y"] + ["\n".join(sentence(rng, rng.randint(0, 9), 4) for _ in range(rng.randint(1, 15))) for _ in range(40)]
    got = {r.doc_id: r for r in quality_rules.judge(quality_rules.ledger(docs(spark, list(enumerate(texts))))).collect()}
    for i, t in enumerate(texts):
        words, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), count_repeats(words))
        assert r.base_failed == (len(words) < 50 or 100 * r.n_repeat_words > 50 * len(words)) and (r.kept is False or not r.base_failed)


def test_policies_and_ablation(spark):
    good = " ".join(f"word{i}" for i in range(60))
    table = docs(spark, [(1, good), (2, good.upper()), (3, " | ".join(good.split())), (4, "short")])
    book = quality_rules.ledger(table)
    assert {r.doc_id for r in quality_rules.judge(book).where("kept").collect()} == {1}
    assert {r.doc_id for r in quality_rules.judge(book, "base").where("kept").collect()} == {1, 2, 3}
    each = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in quality_rules.ablate(book).collect()}
    assert each["shouting"] == (1, 1, 2) and each["few_words"][0] == 1
    kept = quality_rules.keep_good(table)
    assert kept.columns == table.columns and kept.count() == 1 and quality_rules.keep_good(table.limit(0)).count() == 0


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(9)
    lines = ["common line of text", " COMMON line of text\t", "Élan vital commun", "élan vital commun", "ÉLAN vital COMMUN", "short", "another shared line", "", "  ", "only once in here"]
    rows = [(5, None), (6, "")] + [(i, "\n".join(rng.choice([*lines, f"own line number {i} {k}"]) for k in range(rng.randint(1, 8)))) for i in range(10, 40)]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(i)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    for i, t in rows:
        every = (t or "").split("\n")
        stay = [x for x in every if len(key(x)) < 10 or len(held[key(x)]) < 2 or i == min(held[key(x)])]
        r = got[i]
        assert (r.text, r["__n_lines"], r["__n_dropped"]) == ("\n".join(stay), len(every), len(every) - len(stay))
        assert (r.rep, r.digest, r.pos) == (1, "x", 0)
    assert line_dedup.dedup_lines(docs(spark, rows).limit(0)).count() == 0
    loose = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, [(1, "a shared long line"), (2, "a shared long line")]), min_docs=3).collect()}
    assert loose == {1: "a shared long line", 2: "a shared long line"}
    none = line_dedup.dedup_lines(docs(spark, [(None, "a shared long line"), (2, "a shared long line"), (3, "a shared long line"), (3, "a shared long line")])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in none) == [(0, "a shared long line"), (2, "a shared long line"), (3, ""), (3, "")]


def test_line_dedup_of_clashing_names_and_long_texts(spark):
    many = "\n".join(f"line number {k} of many" for k in range(20_000)) + "\n" + "long " * 50_000
    table = spark.createDataFrame([(1, many, 5, [1], "a"), (2, many, 6, None, None), (2, many, 6, None, None)], "doc_id long, text string, __row int, __gone array<int>, digest string")
    got = sorted(line_dedup.dedup_lines(table).collect())
    assert [(r.doc_id, r["__row"], r["__gone"], r.digest, r["__n_lines"], r["__n_dropped"]) for r in got] == [(1, 5, [1], "a", 20001, 0), (2, 6, None, None, 20001, 20001), (2, 6, None, None, 20001, 20001)]
    assert got[0].text == many and got[1].text == got[2].text == ""
    odd = line_dedup.dedup_lines(table.withColumnRenamed("digest", "__N_lines"))
    assert odd.columns[-2:] == ["___n_lines", "__n_dropped"] and sorted(r["___n_lines"] for r in odd.collect()) == [20001] * 3
    other = line_dedup.dedup_lines(table.withColumnRenamed("digest", "__n_lines"), counts=("before", "lost"))
    assert sorted(r.lost for r in other.collect()) == [0, 20001, 20001]


def test_defined_cases_of_text_operators(spark):
    """Null, empty, very long and repeated texts, null keys, clashing columns, empty tables."""
    rng = random.Random(31)
    long = " ".join(rng.choice(["alpha", "Beta,", "x@y.example", "12", "é", "|"]) + str(rng.randint(0, 9)) for _ in range(120_000))
    rows = [(1, None), (2, ""), (3, long), (4, "one two\nthree"), (4, "one two\nthree"), (None, "one two\nthree"), (5, "one two\nthree")]
    table = docs(spark, rows)
    words = WORD.findall(long)
    book = quality_rules.judge(quality_rules.ledger(table)).collect()
    by = {r.doc_id: r for r in book}
    assert len(book) == 7 and by[3].n_words == len(words) and by[3].n_repeat_words == count_repeats(words) and by[1].n_words == by[2].n_words == 0
    assert by[4][1:] == by[5][1:] == by[None][1:] and quality_rules.ledger(table.limit(0)).count() == 0
    assert quality_rules.ablate(quality_rules.ledger(table.limit(0))).count() == 0
    found = pii.find_pii(table).collect()
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in found}
    assert len(found) == 7 and [s for s in spans[3] if s[0] in BASE] == base_spans(long) and spans[1] == spans[2] == spans[4] == []
    assert pii.find_pii(table.limit(0)).count() == 0 and pii.redact(table.limit(0)).columns == table.columns
    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = bpe.WordTable(path).tokenizer
    ids = bpe.encode_decode(table, path).collect()
    assert len(ids) == 7 and all(r.ids == tokenizer.encode(dict(rows)[r.doc_id] or "", add_special_tokens=False).ids for r in ids)
    packed = packing.pack(table, tokenizer_path("byte_bpe_50k.json")).collect()
    assert sorted(r.length for r in packed if r.doc_id in (1, 2)) == [1, 1] and len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
    assert sum(r.doc_id == 4 for r in packed) == 2 and sum(r.doc_id is None for r in packed) == 1
    forms = {r.doc_id: r for r in license_scan.scan_licenses(table).collect()}
    assert forms[3].license_id is None and forms[1].digest is None and forms[4].digest == forms[5].digest


def test_components_where_texts_share_an_id(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    table = docs(spark, [(5, a), (5, b), (5, b), (7, a), (3, b + " tail"), (9, b), (8, "one two"), (8, None)])
    got = sorted((r.doc_id, r.n_shingles, r.set_id, r.component_id) for r in jaccard_join.jaccard_components(table).collect())
    assert got == [(3, 37, 3, 3), (5, 36, 5, 3), (5, 36, 5, 3), (5, 36, 5, 5), (7, 36, 5, 5), (8, 0, 8, 8), (8, 1, 8, 8), (9, 36, 5, 3)]
    assert {r.doc_id for r in jaccard_join.keep_one(table).collect()} == {3, 5, 8}


def test_license_scan(spark):
    mit = license_scan.LICENSES["MIT"]
    styled = "The MIT text\nCopyright (c) 2020 Someone\n".split("\n", 1)[1] + mit.lower().replace("software", "Software").replace(" ", "\n  ").replace("sublicense", "sub licence")
    rows = [(1, mit), (2, styled), (3, mit + " more"), (4, None), (5, "?!"), (6, "  released UNDER the MIT licence!")]
    got = {r.doc_id: (r.license_id, r.digest is None) for r in license_scan.scan_licenses(docs(spark, rows)).collect()}
    assert got == {1: ("MIT", False), 2: ("MIT", False), 3: (None, False), 4: (None, True), 5: (None, True), 6: ("notice:MIT", False)}


COMMON = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


def test_license_files_as_they_usually_are(spark):
    mit, isc, bsd2, bsd3 = (license_scan.LICENSES[x] for x in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"))
    stars = re.sub(r" [123][.] (?=Redist|Neither)", "\n\n* ", bsd3)
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 Someone\n\n" + mit, "MIT"),
        (2, "The MIT License (MIT)\n\nCopyright <year> <holder>\n\n" + mit, "MIT"),
        (3, "ISC License\n\nCopyright The X Authors\n\n" + isc, "ISC"),
        (4, "BSD 3-Clause License\n\nCopyright (c) 2020, Someone\nAll rights reserved.\n\n" + stars, "BSD-3-Clause"),
        (5, "(c) 2019 Someone\n" + stars, "BSD-3-Clause"),
        (6, "BSD 2-Clause License\n\n" + bsd2, "BSD-2-Clause"),
        (10, "\n".join(f"# {x}" for x in ["MIT License", "", "Copyright (c) 2020 Someone", "", *mit.split(". ")]).replace("\n# ", ".\n# "), "MIT"),
        (11, "/*\n * Copyright (c) 2020 Someone\n * Copyright The X Authors\n */\n" + isc, "ISC"),
        (12, "Copyright (c) 2021 Some One. " + mit, "MIT"),
        (13, "The MIT License (MIT) Copyright (c) 2021 Some One " + mit, "MIT"),
        (14, license_scan.LICENSES["Unlicense"].replace(". ", ".\n\n"), "Unlicense"),
        (15, "zlib License\n\n(C) 1995 Jean\n\n" + license_scan.LICENSES["Zlib"].replace("1. ", "* ").replace("2. ", "* "), "Zlib"),
        (16, license_scan.LICENSES["BSL-1.0"].replace(" THE SOFTWARE", "\n\nTHE SOFTWARE"), "BSL-1.0"),
        (7, mit + " Except on Sundays.", None),
        (8, "Some text on permission and the BSD 3-Clause License", None),
        (9, None, None),
    ]
    got = {r.doc_id: r.license_id for r in license_scan.scan_licenses(docs(spark, [r[:2] for r in rows])).collect()}
    assert got == {i: want for i, _, want in rows}
    chars = {r.doc_id: r.canonical_chars for r in license_scan.scan_licenses(docs(spark, [(1, "Copyright (c) 2021 X"), (2, "Copyright (c) 2021 X " + "and a long story " * 20), (3, "word " * 300_000)])).collect()}
    assert chars[1] == 0 and chars[2] > 300 and chars[3] == 5 * 300_000 - 1
    twice = license_scan.scan_licenses(docs(spark, [(1, mit), (1, mit)])).collect()
    assert [r.license_id for r in twice] == ["MIT", "MIT"] and license_scan.scan_licenses(docs(spark, rows[:0])).count() == 0


@pytest.mark.skipif(not Path("/usr/share/common-licenses/MPL-2.0").exists(), reason="needs the licence texts of Debian")
def test_long_licenses_match_by_digest(spark):
    texts = [Path("/usr/share/common-licenses", name).read_text() for name in COMMON]
    bare = {"Apache-2.0": "TERMS AND CONDITIONS FOR USE", "GPL-3": "Copyright (C) 2007", "MPL-2.0": "1. Definitions"}
    rows = [*zip(COMMON.values(), texts, strict=True), *((COMMON[n], (t := texts[list(COMMON).index(n)])[t.index(b) :]) for n, b in bare.items())]
    got = {r.doc_id: r.license_id for r in license_scan.scan_licenses(docs(spark, [(i, t) for i, (_, t) in enumerate(rows)])).collect()}
    assert got == {i: name for i, (name, _) in enumerate(rows)}


def test_packing_pieces_and_places(spark):
    rng = random.Random(8)
    texts = [None, "", "a", sentence(rng, 5000), "word " * 2047] + [sentence(rng, rng.randint(1, 900)) for _ in range(60)]
    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = bpe.WordTable(path).tokenizer
    table = docs(spark, list(enumerate(texts)))
    got = packing.pack(table.repartition(3), path, keep_ids=True).collect()
    want, total = set(), 0
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        first = len(ids) % 2048 or 2048
        for k, (a, b) in enumerate(itertools.pairwise([0, *range(first, len(ids) + 1, 2048)])):
            want.add((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-total // 2048) + 2
    assert packing.pack(table.limit(0), path).count() == 0


def test_packing_keeps_every_limit():
    rng = random.Random(3)
    counts = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(40)}
    for measure in ("norm", "dot"):
        limits = packing.Limits(tokens=100, documents=3, attention=6000, weights=(1.0, 0.5, 0.5), measure=measure)
        fit = {k: v for k, v in counts.items() if k * k <= 6000}
        bins = packing.plan(fit, limits)
        placed = {}
        for group in bins:
            assert sum(n * c for n, c in group.items) <= 100 and sum(c for _, c in group.items) <= 3 and sum(n * n * c for n, c in group.items) <= 6000
            for n, c in group.items:
                placed[n] = placed.get(n, 0) + c * group.many
        assert placed == fit
    with pytest.raises(ValueError, match="passes the limits"):
        packing.plan({100: 1}, packing.Limits(tokens=100, documents=3, attention=60))


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "ROW_BLOCK", 30)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(200)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")]), (203, [float("inf")]), (250, [0.5, 0.5]), (None, [1.0]), (251, [])]
    rows += [(i, [0.0] * 40 + [1.0] + [0.0] * 500) for i in (252, 253)] + [(50, rows[50][1]), (254, [3e7, -1e9, 2.5])]
    table = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<float>, qb int, rb int, terms string")
    got = topk.top_k(table, F.col("vec_id") % 50 == 0).collect()
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, own in {x[0]: x[1] for x in good if x[0] % 50 == 0}.items():
        scores = sorted(((sum(a * b for a, b in zip(own, v, strict=False)), i) for i, v in good if i != q), key=lambda x: (-x[0], x[1]))[:5]
        want |= {(q, k, i, s) for k, (s, i) in enumerate(scores, 1)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want and len(got) == len(want)
    assert topk.top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(table.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


PAGE = '<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><a href="/">Menu</a></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>First  line.<br><p>Second\n line &copy; &am</p><!-- x --><div class="comments"><p>Nice!</p></div><ul><li>one<li>two</ul></article><aside>Side</aside><form>Name</form><script>var t="</p>";</script><footer>Foot</footer></body></html>'


KEEP, OPEN, OUT = html_text.KEEP, html_text.OPEN, html_text.OUT


def test_html_main_text():
    assert html_text.blocks(PAGE) == (True, ["A & B", "First line.", "Second line © &am", "one", "two"])
    assert html_text.blocks(None) == (False, []) and html_text.blocks("") == (False, [])
    assert html_text.blocks("plain <p>text") == (False, ["plain", "text"])
    assert html_text.blocks("<article>open <p>end <script>x") == (True, ["open", "end"])


@pytest.mark.parametrize("page,want", [
    ("<article><p>one</p><script>if(a<b){x=1}</script><p>two</p></article>", [(KEEP, "one"), (KEEP, "two")]),
    ('<article><p>one</p><script>var s = "<!-- x"</script><p>two</p></article>', [(KEEP, "one"), (KEEP, "two")]),
    ("<article><p title=it's>one</p><p>two</article>", [(KEEP, "one"), (KEEP, "two")]),
    ("<p title='a > b' class=\"c>d\">one<p>two", [(OPEN, "one"), (OPEN, "two")]),
    ('<p a="x>one<p>two', [(OPEN, "one"), (OPEN, "two")]),
    ("<!--><p>one<!-- <p>gone --!><p>two<!-- open", [(OPEN, "one"), (OPEN, "two")]),
    ("a < b <p>c <3 </ p>d", [(OPEN, "a < b"), (OPEN, "c <3 d")]),
    ("<form><article><p>one</article><p>end</form>", [(KEEP, "one"), (OUT, "end")]),
    ("<form><h1>Title</h1><p>one</form><form>Search</form>", [(OPEN, "Title"), (OPEN, "one"), (OUT, "Search")]),
    ("<article><section id='related-work'><p>one</section><h2 id=comments>On comments</h2><div class=share>two</div></article>", [(OPEN, "one"), (KEEP, "On comments"), (OPEN, "two")]),
    ("<article><p>x <a class='ad'>Buy</a> y</p><aside>z</aside><header>h</header></article>", [(OUT, "Buy"), (KEEP, "x y"), (OUT, "z"), (KEEP, "h")]),
    ("<body class='nav-open'><div class='modal-page'><article>inside</article></div>", [(KEEP, "inside")]),
    ("<div class=side>a</div><div class=share>b</div><p>c", [(OUT, "a"), (OUT, "b"), (OPEN, "c")]),
    ("<article>one</article><div class=comments><article>Nice</article></div>", [(KEEP, "one"), (OUT, "Nice")]),
])
def test_roles_of_lines(page, want):
    assert html_text.page_lines(page)[1] == want


def test_odd_and_very_long_pages_take_no_quadratic_time():
    for page in ("<a " * 200000, '<a x="' * 200000, "<b>" * 100000 + "</i>" * 100000, "<p>" * 50000, "<!--" * 100000, "<script>" * 50000, "<" * 200000, "<div class=ad>" * 30000, "</" * 100000):
        html_text.page_lines(page)
    long = "".join(f"<p>line {k} &amp; more" for k in range(50_000))
    assert html_text.blocks(f"<nav>menu</nav><article>{long}</article>")[1] == [f"line {k} & more" for k in range(50_000)]


def test_html_differencing_and_edge_rows(spark):
    page = lambda body: f"<html><body><div>Site menu</div>{body}<div>About us</div></body></html>"
    rows = [(1, "http://h/a/1", page("<p>first story</p>")), (2, "http://h/a/2", page("<p>second story</p>")), (3, "http://other/x", page("<p>third</p>")), (4, None, None), (5, "http://h/a/3", PAGE), (6, "http://h/a/4", PAGE), (6, "http://h/a/4", PAGE), (None, "bad url", "<p>x"), (7, "http://i/", ""), (8, "http://twin/1", page("<p>the same")), (9, "http://twin/2", page("<p>the same"))]
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "page_id long, url string, html string, mark int, codes string, part int")
    every = html_text.extract(table).collect()
    got = {r.page_id: r for r in every}
    text = {i: r.text for i, r in got.items()}
    assert len(every) == len(rows)
    assert text[1] == "first story" and text[2] == "second story" and text[3] == "Site menu\nthird\nAbout us" and text[4] == text[7] == ""
    assert text[5] == text[6] == "\n".join(html_text.blocks(PAGE)[1]) and text[None] == "x"
    assert text[8] == text[9] == "Site menu\nthe same\nAbout us"  # copies delete nothing of each other
    assert (got[1].n_lines, got[1].n_shared, got[1].n_left_out) == (3, 2, 0) and (got[5].n_lines, got[5].n_shared, got[5].n_left_out) == (12, 0, 7)
    assert html_text.extract(table.limit(0)).count() == 0


def test_article_comes_back_whole_from_made_pages(spark):
    """Pages are made from known blocks and known decoys; marked and unmarked, alone and in hosts."""
    rng = random.Random(21)
    say = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    raw = ["<script>if(a<b && c>d){document.write('<p>x</p>')}</script>", "<style>p > a{content:'<!--'}</style>", "<!-- <article> -->", "<noscript><p>no</p></noscript>", "<svg><text>t</text></svg>"]
    aside = ["<nav><ul><li>Home<li>News</ul></nav>", "<aside><p>More</aside>", "<div class='ad banner'>Buy</div>", "<form action=/s>Find <input name=q></form>", "<div id=\"comments\"><p>Nice</p></div>", "<footer>&copy; x</footer>", "<div class=\"cookie-consent\">OK?</div>"]
    write = [lambda t: f"<p>{t}</p>", lambda t: f"<p title='a>b'>{t}", lambda t: f"<div data-x=it's>{t}</div>", lambda t: f"<ul><li>{t}</ul>", lambda t: f"<h2>{t}</h2>", lambda t: f"<p><b>{t}", lambda t: f"<blockquote>{t.replace(' ', chr(10) + '  ', 1)}</blockquote>", lambda t: f"<p>{t.replace('w1', '&#119;1').replace('w', '&#x77;', 1)}</p>"]
    rows, want = [], {}
    for i in range(150):
        host = rng.choice(["a.example", "b.example"])
        blocks = [say(rng.randint(3, 30)) for _ in range(rng.randint(1, 12) if i else 3000)]
        marked = rng.random() < 0.5
        body = "".join(rng.choice(write)(x) + (rng.choice(raw + aside) if rng.random() < 0.3 else "") for x in blocks)
        menu = "".join(f"<div>{x} of {host}</div>" for x in ("Start", "Archive", "Contact"))
        frame = f"<article>{body}</article>" if marked else body
        page = f"<!DOCTYPE html><html><head><title>T</title>{rng.choice(raw)}</head><body>{rng.choice(aside)}{menu}{frame}{rng.choice(aside)}<div>Imprint of {host}</div></body></html>"
        rows.append((i, f"https://{host}/{rng.choice(['news', 'blog/2024', ''])}/{i}", page))
        want[i] = "\n".join(blocks)
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def paired_texts(rows):
    """Brute force: every page of a host in the order of (path, id), against its nearer neighbour that is no copy."""
    by = {}
    for i, host, path, page in rows:
        by.setdefault(host, []).append((path, i, html_text.page_lines(page)[1]))
    out = {}
    for mine in by.values():
        mine.sort()
        for k, (path, i, lines) in enumerate(mine):
            near = sorted((j for j in (k - 1, k + 1) if 0 <= j < len(mine)), key=lambda j: (-html_text._prefix(path, mine[j][0]), j))
            gone = set()
            for j in near:
                shared = html_text.shared_lines([x for _, x in lines], [x for _, x in mine[j][2]])
                left = [len(x) * (role != OUT) for role, x in lines]
                if sum(left[n] for n in shared) < 0.8 * sum(left):
                    gone = {n for n in shared if lines[n][0] != KEEP}
                    break
            out[i] = ("\n".join(x for n, (role, x) in enumerate(lines) if role != OUT and n not in gone), len(gone))
    return out


@pytest.mark.parametrize("parts", ["1", "4", "60"])
def test_html_partners_are_the_nearest_of_the_host(spark, parts):
    rng = random.Random(12)
    rows = []
    for i in range(420):
        host = rng.choice(["h", "h", "h", "g", f"lone{i}"])
        path = rng.choice([f"/en/{i}/", f"/2024/{rng.randint(1, 9):02}/slug{i}/", f"/flat/{i:04}", "/same"])
        menu = "".join(f"<div>menu {rng.randint(0, 3)} of {host}</div>" for _ in range(3))
        body = f"<p>story {rng.randint(0, i)} of today and tomorrow</p>"
        rows.append((i, host, path, f"<html><body>{menu}{f'<article>{body}</article>' if rng.random() < 0.2 else body}<div>About {host}</div></body></html>"))
    table = spark.createDataFrame([(i, f"http://{h}{p}", x) for i, h, p, x in rows], "page_id long, url string, html string")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [(r.page_id, (r.text, r.n_shared)) for r in html_text.extract(table).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 420 and dict(got) == paired_texts(rows)


@pytest.mark.parametrize("matches", [1 << 20, 3])
def test_common_subsequence_is_longest(monkeypatch, matches):
    monkeypatch.setattr(html_text, "MATCHES", matches)
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        found, rest = sorted(html_text.shared_lines(a, b)), iter(b)
        assert len(found) == best[-1][-1] and all(any(a[i] == y for y in rest) for i in found)


def test_warc_round_trip(spark, monkeypatch):
    big = "é<p>" * 9000
    rows = [(1, "http://a/", "x" * 1500), (2, "http://b/", "x" * 1500), (3, "http://c/\r\n", big), (4, None, None), (5, "http://d/", ""), (6, "http://e/", "small"), (7, "http://e/", "small"), (8, "u", big), (8, "u", big), (None, "u", "x" * 1500)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    back = warc.round_trip(table).withColumn("page_id", warc.page_number("record_id")).collect()
    got = sorted(((r.page_id or 0, r.record_type, int(r.refers_to.split(":")[2]) if r.refers_to else None, r.payload_bytes, None if r.payload is None else bytes(r.payload)) for r in back), key=str)
    raw = lambda t: (t or "").encode()
    want = [(1, "revisit", 2, 1500, None), (2, "response", None, 1500, raw("x" * 1500)), (3, "revisit", 8, len(raw(big)), None), (4, "response", None, 0, b""), (5, "response", None, 0, b""), (6, "response", None, 5, b"small"), (7, "response", None, 5, b"small")]
    want += [(8, "response", None, len(raw(big)), raw(big))] * 2
    assert [x for x in got if x[0]] == sorted(want, key=str) and len(got) == 10
    names = {r.record_id for r in back}
    assert len(names) == 10 and {r.refers_to for r in back if r.refers_to} <= names
    assert all(r.payload_digest == hashlib.sha1(raw(dict((a, c) for a, _, c in rows)[r.page_id])).hexdigest() for r in back)
    assert warc.round_trip(table.limit(0)).count() == 0
    held = spark.createDataFrame(back, warc.round_trip(table).withColumn("page_id", warc.page_number("record_id")).schema)
    full = {(r.page_id or 0): r.payload for r in warc.with_payloads(warc.checked(held)).collect()}
    assert len(full) == 9 and full[1] == raw("x" * 1500) and full[3] == raw(big) and full[6] == b"small"
    for broken in (held.where("page_id <> 8 OR page_id IS NULL"), held.withColumn("payload_bytes", F.expr("IF(page_id = 3, 1, payload_bytes)")), held.withColumn("payload_digest", F.expr("IF(page_id = 2, 'x', payload_digest)"))):
        with pytest.raises(Exception, match="does not agree with its record"):
            warc.checked(broken).collect()
    assert warc.checked(held.where("page_id <> 8 OR page_id IS NULL"), complete=False).count() == 8


def foreign(kind, block, *more, media="application/http; msgtype=response", eol="\r\n"):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}>", f"Content-Type: {media}", *more, f"Content-Length: {len(block)}", "", ""]
    return eol.join(head).encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("pack", ["plain", "member", "members"])
def test_warc_reads_archives_of_others(spark, pack):
    import base64
    import gzip

    body = b"<html>caf\xc3\xa9</html>"
    sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
    every = [
        foreign("warcinfo", b"software: x\r\n", "WARC-Filename: a.warc.gz", media="application/warc-fields"),
        foreign("request", b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", media="application/http; msgtype=request"),
        foreign("response", b"HTTP/1.1 200 OK\r\nServer:x\r\nNo colon here\r\nX-Long: a\r\n b\r\n\r\n" + body, "WARC-Target-URI:http://h/", f"WARC-Payload-Digest: sha1:{sha}"),
        foreign("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", "WARC-Refers-To: <urn:uuid:response>", f"WARC-Payload-Digest: SHA-1:{sha.lower()}"),
        foreign("metadata", b"fetchTimeMs: 1", media="application/warc-fields", eol="\n"),
        foreign("resource", b"\x00\x01\r\n\r\nx", "WARC-Payload-Digest: md5:" + hashlib.md5(b"\x00\x01\r\n\r\nx").hexdigest(), media="image/x"),
        foreign("conversion", b"text", "WARC-Payload-Digest: blake9:zz", media="text/plain"),
    ]
    content = {"plain": b"".join(every), "member": gzip.compress(b"".join(every)), "members": b"".join(map(gzip.compress, every))}[pack]
    table = spark.createDataFrame([(bytearray(content), 1)], "content binary, segment int")
    got = {r.record_type: r for r in warc.read(table).collect()}
    assert len(got) == 7 and bytes(got["response"].payload) == body and got["response"].url == "http://h/" and bytes(got["resource"].payload) == b"\x00\x01\r\n\r\nx"
    assert got["revisit"].payload is None and got["revisit"].payload_bytes is None and got["revisit"].payload_digest == hashlib.sha1(body).hexdigest()
    assert bytes(got["metadata"].payload) == b"fetchTimeMs: 1" and bytes(got["request"].payload) == b""
    assert warc.checked(warc.read(table)).count() == 7
    wrong = content if pack != "plain" else content.replace(b"caf", b"cof")
    if pack == "plain":
        with pytest.raises(Exception, match="digest is wrong"):
            warc.read(spark.createDataFrame([(bytearray(wrong),)], "content binary")).collect()
        with pytest.raises(Exception, match="not a WARC record"):
            warc.read(spark.createDataFrame([(bytearray(b"nonsense"),)], "content binary")).collect()


def test_warc_rejects_lost_segments(spark):
    table = spark.createDataFrame([(1, "u", "y" * 30000)], "page_id long, url string, html string")
    archives = warc.write(warc.resolve(table)).collect()
    parts = list(warc._parse(archives[0].content))
    assert len(parts) > 2 and parts[0][0]["warc-segment-number"] == "1"
    broken = warc.gzip.decompress(archives[0].content).replace(b"WARC-Segment-Number: 2", b"WARC-Segment-Number: 9")
    cut = b"".join(warc.gzip.compress(b"WARC/1.1" + x) for x in broken.split(b"WARC/1.1")[1:])
    with pytest.raises(Exception, match="segments are missing"):
        warc.read(spark.createDataFrame([(bytearray(cut),)], "content binary")).collect()


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    ok = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 16 <= len(re.sub(r"\D", "", s)) <= 19 and pii.luhn(re.sub(r"\D", "", s)), "phone": lambda s: 8 <= len(re.sub(r"\D", "", s)) <= 15}
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if ok[k](m[0])]


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    bits = ["a", "b.c", "@", "@d.e", ".", "1", "23", "255", "256", "1.2.3.4", "+", "+1 (555) 010-", "-", " ", "4111 1111 1111 1111", "(", ")", "é", "\n", "x@y.z", "_%"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert [s for s in pii.find(text) if s[0] in BASE] == base_spans(text), text
    for text in ("9" * 20000, "1." * 20000, "a@" * 20000, "+1" * 20000, "a" * 50000 + "@", "1 " * 30000):
        pii.find(text)


def test_added_spans_and_redaction(spark):
    text = 'See https://x.example.com/a?b. token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" mail bob@mail7.example.com or +1 (017) 555-7713; account no: DE12345678; 12 Elm Street'
    found = {(k, text[a:b]) for k, a, b in pii.find(text)}
    assert {("url", "https://x.example.com/a?b"), ("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962"), ("email", "bob@mail7.example.com"), ("phone", "+1 (017) 555-7713"), ("account", "DE12345678"), ("address", "12 Elm Street")} <= found
    assert not pii.find("The token of account holders, secret: none. A plain text with 3.5 percent and 1999-2004.")
    table = docs(spark, [(1, text), (2, None), (3, "clean text"), (4, "")])
    got = {r.doc_id: r for r in pii.redact(table).collect()}
    assert "<EMAIL>" in got[1].text and "555" not in got[1].text and "example" not in got[1].text
    assert got[2].text is None and got[3].text == "clean text" and got[3].digest == "x"
    spans = {r.doc_id: r.s for r in pii.find_pii(table).select("doc_id", pii.spans_text(F.col("spans"), pii.BASE).alias("s")).collect()}
    assert spans[1] == ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(text)) and spans[2] == spans[4] == ""


@pytest.mark.parametrize("kind,text,want", [
    ("account", "ssn: 123-45-6789.", "123-45-6789"),
    ("account", "My SSN is 123 45 6789, yes", "123 45 6789"),
    ("account", "IBAN: DE89 3704 0044 0532 0130 00 of Anna", "DE89 3704 0044 0532 0130 00"),
    ("account", "iban gb29 nwbk 6016 1331 9268 19", "gb29 nwbk 6016 1331 9268 19"),
    ("account", "IBAN GB29NWBK60161331926819 is mine", "GB29NWBK60161331926819"),
    ("account", "Account number: 1234-5678-9012", "1234-5678-9012"),
    ("account", "Account no. 1234 5678", "1234 5678"),
    ("account", "Passport No: AB 1234567", "AB 1234567"),
    ("account", "account no: DE12345678", "DE12345678"),
    ("address", "Elle vit 12 rue de la Paix à Paris", "12 rue de la Paix"),
    ("address", "12, rue de la paix", "12, rue de la paix"),
    ("address", "Au 3 bis rue du 8 Mai 1945, Lyon", "3 bis rue du 8 Mai 1945"),
    ("address", "5 avenue Foch.", "5 avenue Foch"),
    ("address", "Live at 221 5th Avenue now", "221 5th Avenue"),
    ("address", "1200 Martin Luther King Junior Boulevard", "1200 Martin Luther King Junior Boulevard"),
    ("address", "in der Hauptstraße 12 wohnt", "Hauptstraße 12"),
    ("address", "Karl-Marx-Straße 7a", "Karl-Marx-Straße 7a"),
    ("address", "in der Berliner Straße 12.", "Berliner Straße 12"),
    ("address", "Rue de la Gare 12, Bern", "Rue de la Gare 12"),
    ("address", "12 Elm Street", "12 Elm Street"),
    ("address", "at 12 Main St. today", "12 Main St"),
    ("address", "350 Fifth Ave, New York", "350 Fifth Ave"),
    ("secret", "PassWord: abcd1234efgh", "abcd1234efgh"),
    ("secret", "İ API_Key = abcd1234efgh", "abcd1234efgh"),
    ("account", "iBAN: DE89370400440532013000", "DE89370400440532013000"),
])
def test_usual_forms_after_a_cue(kind, text, want):
    assert [text[a:b] for k, a, b in pii.find(text) if k == kind] == [want]


def test_cues_without_a_value_have_no_span():
    for text in ("an account 1999-2004 of the war", "account: 2020-01-15", "a true story of 5 broad hints", "in 2004 they went down the long and winding road", "IBAN: to be given", "iban: XX00000000", "IBAN DE89370400440532013001", "on 12 May St. Peter came", "12 Main Stations", "5 road signs", "the avenue of the stars"):
        assert not pii.find(text), text
    for text in ("account " * 5000, "iban " + "A1" * 20000, "ssn " + "1-" * 20000, "9 " + "A " * 20000 + "street", "rue de " * 10000, "1 street " * 5000):
        pii.find(text)
