"""Decontamination, ranked search and conversation repair against brute force."""

import hashlib
import itertools
import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import conversation_repair, decontaminate, lexical_rank

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return WORD.findall((text or "").translate(LOW))


def corpus(seed, n=60):
    rng = random.Random(seed)
    letters = ["a", "B", "c1", "é", "漢", "𝒳y", "ÀB", "long" * 5]
    say = lambda k: "".join(rng.choice(letters) + rng.choice([" ", "\n", ", ", "\x00", "—"]) for _ in range(k))
    items = [(str(i) if i % 7 else None, say(k)) for i, k in enumerate([1, 2, 3, 9, 10, 11, 25, 25, 60, 2, 12, 10])]
    items += [("3", items[6][1]), ("10", items[5][1]), ("5", None), ("6", "... !"), ("x", "Only alone"), ("y", "only ALONE")]
    rows = [None, "", " .\n", "a", "only  alone", "Only", say(5000), items[8][1] * 3]
    rows += [say(rng.randint(0, 30)) + rng.choice(items[3:12])[1] + say(rng.randint(0, 40)) if rng.random() < 0.7 else say(rng.randint(1, 80)) for _ in range(n)]
    return [(i if i % 11 else None, t) for i, t in enumerate(rows)] + [(1, "a b"), (1, "a b")], items


def overlaps(text, items, size=10):
    own, hit, found = words(text), set(), set()
    for item, body in items:
        w = words(body)
        k = min(size, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(own) - k + 1) if windows else ():
            if tuple(own[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add(item)
    return len(own), len(hit), sorted(x for x in found if x is not None), hit


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 40])
def test_overlaps_equal_brute_force(spark, block_words):
    rows, items = corpus(3)
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, row int, n_words int, OVERLAP string").repartition(3)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id string, text string, words int")
    got = decontaminate.find_overlaps(docs, bench, block_words=block_words).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "row", "n_words", "overlap"}
    assert sum(r.overlap.n_hit > 0 for r in got) > 20
    for r in got:
        n, n_hit, names, hit = overlaps(r.text, items)
        assert (r.overlap.n_words, r.overlap.n_hit, r.overlap["items"]) == (n, n_hit, names)
        spans = [(m.start(), m.end()) for m in WORD.finditer((r.text or "").translate(LOW))]
        groups = [[j for _, j in g] for _, g in itertools.groupby(enumerate(sorted(hit)), lambda x: x[1] - x[0])]
        assert [tuple(s) for s in r.overlap.spans] == [(spans[g[0]][0], spans[g[-1]][1]) for g in groups]


def test_overlaps_of_empty_tables_and_cuts(spark):
    bench = spark.createDataFrame([(1, "the quick brown Fox"), (2, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "See: THE quick, brown fox! Then the quick brown fox."), (2, None), (3, "")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in decontaminate.cut_overlaps(docs, bench, mark="#").collect()} == {1: "See: #! Then #.", 2: None, 3: ""}
    assert {r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()} == {2, 3}
    assert {r.overlap.n_hit for r in decontaminate.find_overlaps(docs, bench.limit(0)).collect()} == {0}
    assert decontaminate.find_overlaps(docs.limit(0), bench).count() == 0
    assert decontaminate.find_overlaps(docs.limit(0), bench, block_words=1).count() == 0


def test_machine_skips_and_finds_all_occurrences():
    rng = np.random.default_rng(5)
    for size, letters in ((1, 5), (2, 4), (3, 3), (6, 3), (10, 2), (10, 40)):
        symbols = rng.integers(-1, letters, 4000)
        first = np.array([0, 0, 3, 900, 901, 4000])
        patterns = np.unique(np.stack([symbols[i : i + size] for i in rng.integers(901, 3900, 40)]), axis=0)
        patterns = patterns[(patterns >= 0).all(1)]
        if not len(patterns):
            continue
        got = sorted((int(p), int(q)) for ps, qs in decontaminate.WuManber(patterns, letters).search(symbols, first) for p, q in zip(ps, qs, strict=True))
        want = sorted((i + size - 1, q) for lo, hi in itertools.pairwise(first.tolist()) for i in range(lo, hi - size + 1) for q, x in enumerate(patterns) if (symbols[i : i + size] == x).all())
        assert got == want


def ranked(rows, queries, k):
    docs = [(i, Counter(words(t)), len(words(t))) for i, t in rows if words(t)]
    n, total = len(docs), sum(d[2] for d in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for q, text in queries:
        scores = []
        for i, c, size in docs:
            m = 25 + (75 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in words(text) if c[t])
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_terms", [lexical_rank.BLOCK_TERMS, 30])
def test_rank_equals_brute_force(spark, block_terms):
    rng = random.Random(8)
    vocabulary = [f"t{i}" for i in range(60)] + ["É", "漢字"]
    pick = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.08)), 61)] for _ in range(n))
    rows = [(i if i % 50 else None, pick(rng.randint(1, 60)).upper()) for i in range(400)] + [(1000, None), (1001, ""), (1002, "..."), (1003, pick(9000))]
    rows += [(2000 + i, "t1 t2 t3") for i in range(30)] + [(7, "t1 t2 t3")] * 3
    queries = [(i, pick(n)) for i, n in enumerate([1, 3, 8, 40, 200])] + [(5, None), (6, "?"), (7, "nowhere"), (8, "t1 T1 t2"), (8, "t3"), (None, "t2")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, score string").repartition(5)
    asked = spark.createDataFrame([(i, t, 1) for i, t in queries], "item_id long, text string, query int")
    got = [tuple(r) for r in lexical_rank.rank(docs, asked, block_terms=block_terms).collect()]
    assert sorted(got, key=str) == ranked(rows, queries, 10)


def test_rank_of_empty_tables_and_overflow(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_rank.rank(docs.limit(0), asked).count() == 0 and lexical_rank.rank(docs, asked.limit(0)).count() == 0
    assert [tuple(r) for r in lexical_rank.rank(docs, asked).collect()] == ranked([(1, "a b")], [(1, "a")], 10)


def test_shard_walks_skip_but_lose_nothing():
    rng = np.random.default_rng(2)
    rows, n_terms = 3000, 40
    cells = np.unique(rng.integers(0, rows, 30_000) * n_terms + np.minimum(rng.geometric(0.1, 30_000), n_terms) - 1)
    sizes, terms = np.bincount(cells // n_terms, minlength=rows), cells % n_terms
    tfs, lengths = rng.integers(1, 5, len(cells)), rng.integers(5, 300, rows)
    shard = lexical_rank.Shard(sizes, terms, tfs, lengths, rows, int(lengths.sum()), n_terms)
    queries = [(np.sort(rng.choice(n_terms, k, replace=False)), rng.integers(0, 9000, k)) for k in (1, 2, 5, 12, 40)]
    got = {q: list(zip((-s).tolist(), d.tolist(), strict=True)) for q, d, s in shard.search(queries, 10)}
    m = 25 + 75 * lengths * rows // int(lengths.sum())
    doc = cells // n_terms
    impact = 10**9 * tfs // (1000 * tfs + 8 * m[doc])
    for q, (own, weight) in enumerate(queries):
        scores = np.zeros(rows, np.int64)
        for t, w in zip(own, weight, strict=True):
            np.add.at(scores, doc[terms == t], w * impact[terms == t])
        assert sorted(got.get(q, [])) == sorted((-s, d) for d, s in enumerate(scores.tolist()) if s > 0)[:10]


def forwards(rows):
    """Cheapest (cost, audit) by a forward table over (state) of strings; rows are (initial, fault)."""
    step = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    force = {0: "u", 1: "u", 2: "a", 3: "u"}

    def inserted(table):
        for _ in range(3):
            for s, (c, a) in list(table.items()):
                t = step[force[s]][s]
                table[t] = min(table.get(t, (99**9, "")), (c + 3, a + "I"))
        return table

    table = inserted({0: (0, "")})
    for initial, fault in rows:
        after = {}
        for s, (c, a) in table.items():
            moves = [(s, 4, "D")]
            if fault not in (1, 2):
                late = 3 * (fault == 3)
                moves += [(step[force[s]][s], 3 + late, "R")]
                moves += [(step[initial][s], late, "K")] if s in step.get(initial, {}) else []
            for t, cost, letter in moves:
                after[t] = min(after.get(t, (99**9, "")), (c + cost, a + letter))
        table = inserted(after)
    return min(table[s] for s in (0, 3) if s in table)


def test_dial_equals_a_forward_table():
    rng = random.Random(4)
    for _ in range(400):
        rows = [(rng.choice("suuuaaa-"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 12))]
        code = bytes(conversation_repair.INITIALS.index(i) * 4 + f for i, f in rows)
        assert conversation_repair.cheapest(code) == forwards(rows)
        assert conversation_repair.cheapest(code, block=3) == forwards(rows)
    long = bytes(rng.choice([4, 8, 8, 12, 12, 0, 9, 11, 14]) for _ in range(5000))
    assert conversation_repair.cheapest(long, block=500) == conversation_repair.cheapest(long)


def repaired(rows):
    """Book and rows of one conversation's (turn, role, text), nulls told as spaces already, in order."""
    seen, faults, before = set(), [], None
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append(1 if not bare else 2 if (role, text) in seen else 0 if bare[-1] in ".!?" else 3)
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit = forwards([(role[:1], f) for (_, role, _), f in zip(rows, faults, strict=True)])
    out, state, mine = [], 0, iter(rows)
    for letter in audit:
        to = {0: "user", 1: "user", 2: "assistant", 3: "user"}[state]
        _, role, text = ("", "", "") if letter == "I" else next(mine)
        if letter != "D":
            role = role if letter == "K" else to
            out.append((letter, role, text))
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in out).encode()).hexdigest()
    return (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, digest), out


def test_repair_equals_brute_force(spark):
    rng = random.Random(6)
    texts = ["Fine.", "Fine!\n", "cut", "", " \t", None, "Why?  ", "é。", "Again.", "x" * 200_000 + "."]
    rows = []
    for conv in [None, *range(120)]:
        for turn in rng.sample([None, *range(14)], rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "user", "assistant", "assistant", "system", "tool", None, "", "usher"]), rng.choice(texts[: 10 if conv == 3 else 9])))
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, kind string, digest string").repartition(5)
    hurt = {}
    show = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        d, own = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20, hurt.setdefault(conv, [])
        role, text = show(role), show(text)
        if d == 1:
            text = ""
        if d == 2:
            text = re.sub("[.!?]", "", text)
        if d == 4:
            role = "user"
        own += [] if d == 0 else [(turn, role, text)] * (2 if d == 3 else 1)
    damaged = conversation_repair.damage(table)
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair_book(damaged).collect()}
    body = {}
    for r in conversation_repair.repaired_rows(damaged).orderBy("position").collect():
        body.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    assert set(got) == set(hurt)
    for conv, own in hurt.items():
        want, out = repaired(sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())))
        assert got[conv] == want and body.get(conv, []) == out


def test_repair_of_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversation_repair.repair_book(spark.createDataFrame([], schema)).count() == 0
    gone = spark.createDataFrame([(5, 1, "user", "Hi.", True)], schema + ", gone boolean")
    assert [tuple(r) for r in conversation_repair.repair_book(gone).collect()] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversation_repair.repaired_rows(gone).count() == 0
    twice = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Ho.")], schema)
    (row,) = conversation_repair.repair_book(twice).collect()
    assert (row.duplicate, row.cost, row.audit) == (1, 4, "KDK")
    many = spark.range(60_000).select(F.lit(9).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat("id", F.lit(".")).alias("text"))
    (row,) = conversation_repair.repair_book(many).collect()
    assert (row.cost, row.audit) == (0, "K" * 60_000)
