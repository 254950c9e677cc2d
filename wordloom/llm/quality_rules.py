"""Quality rules as a bitmask ledger (built-in functions only).

``ledger`` evaluates every rule once and stores the failure bits beside the
measurements.  Policies are versioned masks over those bits: applying one, or
asking what a rule costs, reads the ledger and never the texts again.

Defined cases: a null or word-less text measures 0 everywhere and fails
``few_words``; repeated rows are judged one by one; an empty table gives an empty
ledger and an empty ablation; all other columns of the
input are left out of the ledger.  The work of a row grows as n log n with its
words, whatever they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS, CAPITALS = "[#*$%&|<>]", "[A-Z]"

#: Bit number -> (name, condition for failure over the measurements).
RULES: dict[int, tuple[str, str]] = {
    0: ("few_words", "n_words < 50"),
    1: ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    2: ("symbols", "100 * n_symbols > 10 * n_words"),
    3: ("repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    4: ("shouting", "100 * n_capitals > 30 * word_chars"),
    5: ("short_words", "word_chars < 2 * n_words"),
    6: ("long_words", "word_chars > 40 * n_words"),
}
BASE_MASK = 0b0000011
#: Version -> mask of the rules that reject.
POLICIES = {"base": BASE_MASK, "v1": 0b1111111, "lenient": 0b0000111}


def _let(value: Column, body) -> Column:
    """Binds a value to a lambda variable, so that it is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def _covered(starts: Column) -> Column:
    """Words in windows of three that start at the given sorted positions."""
    steps = F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - p, F.lit(3))))
    return F.aggregate(steps, F.lit(0), lambda total, step: total + step)


def _repeated_starts(hashes: Column) -> Column:
    """Sorted positions of the windows that occur twice or more."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def marked(rows: Column) -> Column:
        twin = lambda row, k: F.coalesce(F.get(rows, k)["h"] == row["h"], F.lit(False))
        return F.transform(rows, lambda row, k: F.when(twin(row, k + 1) | twin(row, k - 1), row["i"]).otherwise(-1))

    return F.sort_array(F.filter(_let(placed, marked), lambda i: i >= 0))


def repeat_words(words: Column) -> Column:
    """Number of words in three-word windows that the text holds at least twice."""

    def windows(w: Column) -> Column:
        hashes = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.slice(hashes, 1, F.greatest(F.size(w) - 2, F.lit(0)))

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(_repeated_starts(h), _covered))

    return _let(_let(words, windows), count).cast("long")


def _number_of(text: Column, pattern: str) -> Column:
    """Characters of a class; most texts have few, so little is copied."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The measurements of each row; ``n_lines`` counts lines that hold a word."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    facts = F.struct(
        _let(words_of(body), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("c"), repeat_words(w).alias("r"))).alias("w"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("l"),
    )
    out = docs.select(
        F.col(key),
        _number_of(body, SYMBOLS).alias("n_symbols"),
        _number_of(body, CAPITALS).alias("n_capitals"),
        facts.alias("f"),
    )
    return out.select(key, F.col("f.w.n").alias("n_words"), F.col("f.w.c").alias("word_chars"), "n_symbols", "n_capitals", F.col("f.l.n").alias("n_lines"), F.col("f.l.d").alias("n_dup_lines"), F.col("f.w.r").alias("n_repeat_words"))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Measurements and ``failed``, the bits of the rules that each row fails."""
    bits = F.expr(" | ".join(f"IF({condition}, {1 << bit}L, 0L)" for bit, (_, condition) in RULES.items()))
    return measure(docs, key, text).withColumn("failed", bits)


def judge(book: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy."""
    bits = F.col("failed")
    return book.withColumn("base_failed", bits.bitwiseAND(F.lit(BASE_MASK)) != 0).withColumn("kept", bits.bitwiseAND(F.lit(POLICIES[policy] | BASE_MASK)) == 0)


def ablate(book: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: rows that fail it, rows that only it rejects, rows kept without it."""
    mask = POLICIES[policy]
    held = book.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    rules = [F.struct(F.lit(bit).alias("bit"), F.lit(name).alias("rule")) for bit, (name, _) in RULES.items() if mask >> bit & 1]
    each = held.select("failed", "n", F.explode(F.array(*rules)).alias("r")).withColumn("one", F.expr("shiftleft(1L, r.bit)"))
    active = F.col("failed").bitwiseAND(F.lit(mask))
    return each.groupBy(F.col("r.bit").alias("bit"), F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("failed").bitwiseAND(F.col("one")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(active == F.col("one"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(active.bitwiseAND(F.bitwise_not(F.col("one"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def keep_good(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows that a policy keeps, with all their columns; one pass, no shuffle."""
    spare = "__" + "_".join(docs.columns)[:40]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(spare), F.col("text"))
    kept = judge(ledger(packed, spare), policy).where("kept")
    return kept.select(*[F.col(f"`{spare}`")[c].alias(c) for c in docs.columns])
