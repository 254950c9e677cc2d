"""Term matching: segments joined to the dictionary, guards, sense selection.

Interval tests are running aggregates along a document (``scan.running``), never
theta joins.  Per-document keys are carried by every child table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.context import all_rules, rule_matches
from wordloom.functions.text import WINDOW, boundary_confidence
from wordloom.plans.staging import broadcast_if_few

from .scan import BLOCK, running

#: Terms of a lexicon that is broadcast with its senses (some 400 bytes each) or its facts; larger ones are joined by a shuffle.
FEW_TERMS = 500_000


def match_segments(segments: DataFrame, terms: DataFrame, term: str = "zh") -> DataFrame:
    """Segments that are dictionary terms (equi-join on their text)."""
    return segments.join(terms.select(F.col(term).alias("text")).distinct(), "text", "left_semi").withColumn("source", F.lit("segment"))


def _row(rows: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in rows.columns])


def _along(points: DataFrame, at: Column, marks: DataFrame, keys: list[str]) -> DataFrame:
    """Points (with their row as ``__row``) and marks (keys, __at and a struct ``__mark``) on one axis, marks first."""
    asked = points.select(*keys, at.cast("long").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(marks.schema["__mark"].dataType).alias("__mark"), _row(points).alias("__row"))
    return marks.select(*keys, F.col("__at").cast("long").alias("__at"), F.lit(0).alias("__kind"), "__mark", F.lit(None).cast(asked.schema["__row"].dataType).alias("__row")).unionByName(asked)


def outside(matches: DataFrame, ranges: DataFrame, keys: list[str], allow_exact: bool = False, block: int | None = BLOCK) -> DataFrame:
    """Matches that overlap no range; with ``allow_exact``, a range of just the match's span is no hindrance.

    A range overlaps a match if it starts before the match ends and ends after
    the match starts.  So the largest end of all ranges that start before a match
    ends tells it; with ``allow_exact`` the second largest too, which is the
    largest of each range's end and the largest end before it, whichever is less.
    """
    row = F.col("__row")
    mark = F.struct(F.col("end").cast("long").alias("e"), F.col("start").cast("long").alias("s"))
    marks = ranges.where("end > start").select(*keys, F.col("start").alias("__at"), mark.alias("__mark"))
    both = _along(matches, F.col("end") - 1, marks.distinct() if allow_exact else marks, keys).withColumn("__e", F.col("__mark.e"))
    order = ["__at", "__kind", "__e"]
    empty = row["end"] <= row["start"]
    if not allow_exact:
        met = running(both, keys, order, {"__most": ("max", F.col("__mark"))}, block=block)
        return met.where((F.col("__kind") == 1) & (F.col("__most").isNull() | (F.col("__most.e") <= row["start"]) | empty)).select("__row.*")
    led = running(both, keys, order, {"__led": ("max", F.col("__mark"))}, before=True, block=block)
    less = F.when(F.col("__mark").isNotNull() & F.col("__led").isNotNull(), F.least("__mark", "__led"))
    met = running(led.withColumn("__less", less), keys, order, {"__most": ("max", F.col("__mark")), "__next": ("max", F.col("__less"))}, block=block)
    same = (F.col("__most.e") == row["end"]) & (F.col("__most.s") == row["start"])
    other = F.when(same, F.col("__next")).otherwise(F.col("__most"))
    return met.where((F.col("__kind") == 1) & (other.isNull() | (other["e"] <= row["start"]) | empty)).select("__row.*")


def not_contained(matches: DataFrame, segments: DataFrame, terms: DataFrame, keys: list[str], most: int = 8, term: str = "zh", block: int | None = BLOCK) -> DataFrame:
    """Matches that lie strictly inside no dictionary segment of at most so many characters.

    Segments of a document don't overlap, so the last one that starts no later
    than a match is the only one that can hold it.
    """
    long = segments.where(F.col("end") - F.col("start") <= most).join(terms.select(F.col(term).alias("text")).distinct(), "text", "left_semi")
    span = F.struct(F.col("start").cast("int").alias("s"), F.col("end").cast("int").alias("e"))
    placed = running(_along(matches, F.col("start"), long.select(*keys, F.col("start").alias("__at"), span.alias("__mark")), keys), keys, ["__at", "__kind"], {"__seg": ("last", F.col("__mark"))}, block=block)
    inside = (F.col("__seg.e") >= F.col("__row.end")) & ((F.col("__seg.s") < F.col("__row.start")) | (F.col("__seg.e") > F.col("__row.end")))
    return placed.where("__kind = 1").where(~F.coalesce(inside, F.lit(False))).select("__row.*")


def containing(points: DataFrame, intervals: DataFrame, keys: list[str], value: str = "text", out: str = "sentence", block: int | None = BLOCK) -> DataFrame:
    """Adds the interval that holds each point span, or "" (an as-of look-up along the document).

    Intervals of a document don't overlap; one sort serves all spans, instead of
    a theta join.
    """
    span = F.struct(F.col(value).alias("v"), F.col("end").alias("e"))
    both = _along(points, F.col("start"), intervals.select(*keys, F.col("start").alias("__at"), span.alias("__mark")), keys)
    found = running(both, keys, ["__at", "__kind"], {"__iv": ("last", F.col("__mark"))}, block=block).where("__kind = 1")
    empty = F.lit("") if intervals.schema[value].dataType.simpleString() == "string" else F.lit(None)
    return found.select("__row.*", F.when(F.col("__row.end") <= F.col("__iv.e"), F.col("__iv.v")).otherwise(empty).alias(out))


def with_boundaries(matches: DataFrame) -> DataFrame:
    """Adds boundary_confidence and the local window to matches with their left and right context."""
    left, right = F.right(F.coalesce("left", F.lit("")), F.lit(WINDOW)), F.left(F.coalesce("right", F.lit("")), F.lit(WINDOW))
    size = F.length(left)
    window = F.struct(F.concat(left, "text", right).alias("text"), size.alias("targetStart"), (size + F.length("text")).alias("targetEnd"), left.alias("left"), right.alias("right"))
    edges = boundary_confidence(F.right(left, F.lit(1)), F.left(right, F.lit(1)))
    return matches.withColumn("boundary_confidence", edges).withColumn("window", window).drop("left", "right")


def forms_compound(segments: DataFrame, terms: DataFrame, keys: list[str], term: str = "zh", single: str = "[\\u4E00-\\u9FFF]") -> DataFrame:
    """Segments whose one-character neighbour forms a longer term with them, as flag ``compound``."""
    order = Window.partitionBy(*keys).orderBy("start")
    rows = segments.withColumn("__p", F.lag("text").over(order)).withColumn("__n", F.lead("text").over(order))
    pairs = [F.when(F.col(c).rlike(f"\\A{single}\\z"), F.array(F.concat(c, "text"), F.concat("text", c))).otherwise(F.array().cast("array<string>")) for c in ("__p", "__n")]
    tried = rows.select(*keys, "start", F.explode(F.concat(*pairs)).alias("text"))
    hit = tried.join(terms.select(F.col(term).alias("text")).distinct(), "text", "left_semi").select(*keys, "start").distinct().withColumn("compound", F.lit(True))
    return segments.join(hit, [*keys, "start"], "left").withColumn("compound", F.coalesce("compound", F.lit(False)))


def uncertain_starts(segments: DataFrame, terms: DataFrame, keys: list[str], longest: int, ahead: int = 4, term: str = "zh", script: str = "[\\u4E00-\\u9FFF]") -> DataFrame:
    """Starts worth scanning: of segments that form a term with up to four adjacent
    followers, and every offset of short segments that are no term."""
    order = Window.partitionBy(*keys).orderBy("start")
    known = terms.select(F.col(term).alias("__t")).distinct()
    rows = segments.withColumn("__after", F.collect_list(F.struct("text", "start", "end")).over(order.rowsBetween(1, ahead)))
    empty = F.struct(F.col("text").alias("w"), F.col("end").alias("e"), F.lit(True).alias("open"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, seg: Column) -> Column:
        grown = F.concat(state["w"], seg["text"])
        fits = state["open"] & (seg["start"] == state["e"]) & seg["text"].rlike(f"\\A{script}") & (F.length(grown) <= longest)
        out = F.when(fits, F.array_append(state["out"], grown)).otherwise(state["out"])
        return F.struct(F.when(fits, grown).otherwise(state["w"]).alias("w"), F.when(fits, seg["end"]).otherwise(state["e"]).alias("e"), fits.alias("open"), out.alias("out"))

    joined = rows.select(*keys, "start", F.explode(F.aggregate("__after", empty, step, lambda s: s["out"])).alias("__t")).join(known, "__t", "left_semi").select(*keys, "start")
    short = segments.where(F.col("end") - F.col("start") <= 8).join(known.withColumnRenamed("__t", "text"), "text", "left_anti").select(*keys, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("start"))
    return joined.union(short).distinct()


def select_sense(matches: DataFrame, senses: DataFrame, corrections: DataFrame | None = None, approved: DataFrame | None = None, key: str = "correction_key") -> DataFrame:
    """One sense per match, with reason and confidence.

    ``matches`` has text (the term) and window; ``senses`` is a ``dictionary``.
    A correction of the match (column ``key``) wins; then senses with local
    evidence; then the only approved sense without rules that has a phonetic;
    then the best by priority, which is certain only if it is alone.  Ties keep
    input order.  The senses of a term travel as one array, so a match meets
    them in one join and is decided inside its row; within FEW_TERMS terms the
    join is a broadcast, and no match is shuffled for it.
    """
    rated = senses.withColumn("__ok", F.lit(False))
    if approved is not None:
        rated = senses.join(approved.select("candidate_id", F.lit(True).alias("__ok")).distinct(), "candidate_id", "left")
    entry = F.struct("candidate_id", "en", "part_of_speech", "meaning", "phonetic")
    rules = all_rules(F.col("context_rules"), F.col("context_hints"))
    bare = F.size(rules) == 0
    one = F.struct(
        F.coalesce("priority", F.lit(0)).alias("p"), (-F.col("ord")).alias("o"), entry.alias("e"), bare.alias("bare"),
        (bare & F.coalesce("__ok", F.lit(False)) & (F.coalesce("phonetic", F.lit("")) != "")).alias("lexical"), rules.alias("rules"),
    )

    def best(pool: Column) -> Column:
        return F.array_max(F.transform(pool, lambda s: F.struct(s["p"].alias("p"), s["o"].alias("o"), s["e"].alias("e"))))["e"]

    def verdict(pool: Column, reason: str, confidence: str) -> Column:
        return F.struct(best(pool).alias("e"), F.lit(reason).alias("reason"), F.lit(confidence).alias("confidence"))

    every = F.col("senses")
    generic, lexical = F.filter(every, lambda s: s["bare"]), F.filter(every, lambda s: s["lexical"])
    # what holds without evidence is the term's own, so it is decided once a term; only senses with rules are asked in a match
    plain = (
        F.when(F.size(lexical) == 1, verdict(lexical, "priority", "high"))
        .when(F.size(generic) == 1, verdict(generic, "priority", "high")).when(F.size(generic) > 1, verdict(generic, "ambiguous", "low"))
        .when(F.size(every) == 1, verdict(every, "priority", "high")).otherwise(verdict(every, "ambiguous", "low"))
    )
    terms = rated.groupBy(F.col("zh").alias("text")).agg(F.collect_list(one).alias("senses")).withColumn("__plain", plain).withColumn("__ruled", F.filter("senses", lambda s: ~s["bare"]))
    terms = terms.select("text", "__plain", "__ruled", *(["senses"] if corrections is not None else []))
    rows = matches.join(broadcast_if_few(terms, FEW_TERMS), "text")
    window, evident = F.col("window"), F.col("__evident")
    met = F.filter("__ruled", lambda s: F.exists(s["rules"], lambda r: rule_matches(r["kind"], r["value"], window)))
    rows = rows.withColumn("__evident", F.when(F.size("__ruled") > 0, met))
    step = F.when(F.size(evident) == 1, verdict(evident, "context", "high")).when(F.size(evident) > 1, verdict(evident, "ambiguous", "low")).otherwise(F.col("__plain"))
    if corrections is not None:
        chosen = corrections.groupBy(F.col("key").alias(key)).agg(F.max("selected_english").alias("__chosen"))
        rows = rows.join(chosen, key, "left")
        corrected = F.filter(every, lambda s: s["e"]["en"] == F.col("__chosen"))
        first = F.array_max(F.transform(corrected, lambda s: F.struct(s["o"].alias("o"), s["e"].alias("e"))))["e"]
        step = F.when(F.col("__chosen").isNotNull() & (F.size(corrected) > 0), F.struct(first.alias("e"), F.lit("correction").alias("reason"), F.lit("high").alias("confidence"))).otherwise(step)
    return rows.withColumn("s", step).select(*matches.columns, "s.e.*", "s.reason", "s.confidence")


def apply_policy(matches: DataFrame, policy: DataFrame, flag: str | None = None) -> DataFrame:
    """Drops matches of blocked terms and of contextual terms without evidence; adds context_evidence.

    ``policy`` has term, mode and allow (array of rules).  With ``flag`` all
    matches stay, and a column of that name tells which are to be kept.
    """
    rows = matches.join(broadcast_if_few(policy.select(F.col("term").alias("text"), "mode", "allow"), FEW_TERMS), "text", "left")
    allowed = F.col("allow").isNull() | F.exists("allow", lambda r: rule_matches(r["kind"], r["value"], F.col("window")))
    rows = rows.withColumn("context_evidence", (F.coalesce("mode", F.lit("stable")) == "contextual") & F.coalesce(allowed, F.lit(True)))
    keep = (F.coalesce("mode", F.lit("stable")) == "stable") | F.col("context_evidence")
    return (rows.where(keep) if flag is None else rows.withColumn(flag, keep)).drop("mode", "allow")
