"""Conversation structure repair by Dial's bucket-queue shortest paths.

A repair reads a conversation's rows in order and keeps, re-roles or deletes each,
or inserts an empty turn, so that the roles' initials become (s?(ua)+)?.  Nodes
are (rows read, state of that pattern), arcs are edits with small integer costs.
Distances to the end are recorded backwards with a ring of buckets, one for each
cost; then the tight arcs are walked from the start, the least letter first,
which gives the least audit among the cheapest (no audit is a prefix of another,
as an insertion always costs).

Spark does the rows: faults are found by built-in functions, a text seen before by
a pre-aggregated minimum of its turns, and light rows (no texts) go by
conversation, in order, to the paths.  The audits then meet the texts in a second
ordered pass, which gives the repaired rows or streams them through SHA-256.

Memory: a conversation takes a byte a row for its faults and one for its audit,
as long as the audit that its result row holds; distances are kept at the borders
of blocks of rows and made again for the walk; texts are never held.  One
conversation's rows go through one task in order, since a SHA-256 has to; the
minimum of turns is taken before that and spread over all tasks.

Defined cases: a null role, text, turn or conv_id is one space where a string is
asked for; rows are ordered by turn (nulls first), then role, then the SHA-256 of
their text, so repeated rows are adjacent and the second is a duplicate; a null
conv_id is a conversation of its own; an empty role has no initial and can't be
kept; a conversation without rows gives zeros, an empty audit and the digest of
an empty string; an empty table gives no rows.  Other columns are not read, so
their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Rows whose distances are held at once.
BLOCK = 1 << 14
KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
UNFINISHED = 3
_RING = 1 + max(COST.values()) + UNFINISHED
_FAR = 1 << 60

#: States of (s?(ua)+)?: start, after s, after u, after a. Where each initial leads (-1: nowhere), and the role that may be put there.
START, ENDS = 0, (0, 3)
NEXT = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
ROLE = ("user", "user", "assistant", "user")
AFTER = tuple(NEXT[ROLE[s][0]][s] for s in range(4))
INITIALS = "-sua"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)


def arcs(state: int, row: int | None) -> list[tuple[str, int, int, int]]:
    """Edits (letter, cost, rows read, next state) at a state before a row (code initial * 4 + fault; None at the end), by letter."""
    insert = (INSERT, COST[INSERT], 0, AFTER[state])
    if row is None:
        return [insert]
    initial, fault = INITIALS[row >> 2], row & 3
    out = [(DELETE, COST[DELETE], 1, state), insert]
    if fault not in (BLANK, DUPLICATE):
        late = UNFINISHED * (fault == TRUNCATED)
        kept = NEXT[initial][state] if initial in NEXT else -1
        if kept >= 0:
            out.append((KEEP, COST[KEEP] + late, 1, kept))
        out.append((REROLE, COST[REROLE] + late, 1, AFTER[state]))
    return out


_ARCS = {(state, row): arcs(state, row) for state in range(4) for row in (*range(16), None)}
_BACK = {row: [[(letter, cost, s) for s in range(4) for letter, cost, step, to in _ARCS[s, row] if to == state and step] for state in range(4)] for row in range(16)}
_INSERTED = [[s for s in range(4) if AFTER[s] == state] for state in range(4)]


def distances(rows: bytes, last: list[int]) -> list[list[int]]:
    """Dial: each layer's distances to the end, given those behind the last row."""
    n = len(rows)
    far = [[_FAR] * 4 for _ in range(n)] + [[_FAR] * 4]
    ring: list[list[tuple[int, int]]] = [[] for _ in range(_RING)]
    waiting = sorted((d, s) for s, d in enumerate(last) if d < _FAR)
    cost, held = (waiting[0][0] if waiting else 0), 0
    while held or waiting:
        if not held:
            cost = max(cost, waiting[0][0])
        while waiting and waiting[0][0] == cost:
            d, s = waiting.pop(0)
            if d < far[n][s]:
                far[n][s] = d
                ring[cost % _RING].append((n, s))
                held += 1
        bucket = ring[cost % _RING]
        while bucket:
            at, state = bucket.pop()
            held -= 1
            if far[at][state] != cost:
                continue
            for s in _INSERTED[state]:
                if cost + COST[INSERT] < far[at][s]:
                    far[at][s] = cost + COST[INSERT]
                    ring[far[at][s] % _RING].append((at, s))
                    held += 1
            if at:
                before = far[at - 1]
                for _, price, s in _BACK[rows[at - 1]][state]:
                    if cost + price < before[s]:
                        before[s] = cost + price
                        ring[before[s] % _RING].append((at - 1, s))
                        held += 1
        cost += 1
    return far


def cheapest(rows: bytes, block: int = BLOCK) -> tuple[int, str]:
    """Cost and least audit of the cheapest repair."""
    borders = [[0 if s in ENDS else _FAR for s in range(4)]]
    cuts = list(range(0, len(rows), block)) or [0]
    for lo in reversed(cuts):
        far = distances(rows[lo : lo + block], borders[-1])
        borders.append(far[0])
    cost, state, audit = borders.pop()[START], START, bytearray()
    for lo in cuts:
        end, last = borders.pop(), lo + block >= len(rows)
        own = rows[lo : lo + block]
        if len(cuts) > 1:
            far = distances(own, end)
        at = 0
        while at < len(own) or (last and far[at][state]):
            row = own[at] if at < len(own) else None
            letter, _, step, state = next(a for a in _ARCS[state, row] if a[1] + far[at + a[2]][a[3]] == far[at][state])
            audit += letter.encode()
            at += step
    return cost, audit.decode()


def damage(rows: DataFrame) -> DataFrame:
    """``conversations`` with faults: crc32 of conv_id:turn, modulo 20, drops (column ``gone``), empties, unpunctuates, repeats or re-roles a row."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))), F.lit(20))
    body = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    each = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    each = each.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return each.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"), (F.col("kind") == 0).alias("gone"))


def _ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone, digest: the rows with nulls as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    gone = F.coalesce("gone", F.lit(False)) if "gone" in rows.columns else F.lit(False)
    return rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), gone.alias("gone")).withColumn("digest", F.sha2("text", 256))


def _state(text: Column) -> Column:
    """FINE, BLANK or TRUNCATED."""
    bare = F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)


_BOOK = StructType([StructField("conv_id", LongType()), *[StructField(n, LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], StructField("audit", StringType())])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Rows of sorted batches, (conversation, its rows) one after the other; each conversation's rows have to be used up."""
    from itertools import groupby

    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return groupby(rows, key=lambda r: r[0])


class _Faults:
    """Counts of a conversation's faults and the codes of its rows, from rows in order."""

    def __init__(self):
        self.codes, self.count, self.illegal = bytearray(), [0] * 4, 0
        self.turns, self.least, self.turn = 0, None, None
        self.before, self.initial = None, None

    def add(self, turn: int | None, role: str, digest: str, fault: int, seen: bool) -> None:
        if turn is not None and turn != self.turn:
            self.turns, self.least, self.turn = self.turns + 1, turn if self.least is None else self.least, turn
        if fault != BLANK and (seen or self.before == (turn, role, digest)):
            fault = DUPLICATE
        self.before = (turn, role, digest)
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        self.count[fault] += 1
        self.codes.append((INITIALS.index(initial) if initial in NEXT else 0) * 4 + fault)

    def result(self) -> tuple:
        gaps = self.turn - self.least + 1 - self.turns if self.turns else 0
        cost, audit = cheapest(bytes(self.codes))
        return gaps, self.count[BLANK], self.count[DUPLICATE], self.count[TRUNCATED], self.illegal, cost, audit


def _book(rows: DataFrame) -> DataFrame:
    """The audit book of ``_ordered`` rows."""
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    own = ["conv_id", "role", "digest"]
    first = rows.where("NOT gone").groupBy(*own).agg(F.min(turn).alias("first"))
    light = rows.select(*own, "turn", "gone", _state(F.col("text")).alias("fault"), turn.alias("at"))
    a, b = light.alias("a"), first.alias("b")
    met = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.digest") == F.col("b.digest")), "left")
    sent = met.select("a.conv_id", "a.turn", "a.role", "a.digest", "a.gone", "a.fault", (F.col("b.first") < F.col("a.at")).alias("seen"))
    kind = rows.schema["conv_id"].dataType
    schema = StructType([StructField("conv_id", kind), *_BOOK.fields[1:]])

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        names = schema.names
        types = None

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        def typed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal types
            for batch in source:
                types = types or [batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string()]
                yield batch

        for conv, own_rows in _grouped(typed(batches)):
            faults = _Faults()
            for _, turn_, role, digest, gone, fault, seen in own_rows:
                if not gone:
                    faults.add(turn_, role, digest, fault, bool(seen))
            out.append((conv, *faults.result()))
            if len(out) >= 1024:
                yield flush()
                out.clear()
        if out:
            yield flush()

    ordered = sent.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest")
    return ordered.mapInArrow(repair, schema)


def _edits(audit: str, rows: Iterator[tuple]) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of every edit but deletions, as the audit is walked over the rows."""
    state, mine = START, iter(rows)
    for letter in audit:
        if letter == INSERT:
            yield letter, ROLE[state], ""
            state = AFTER[state]
            continue
        role, text = next(mine)
        if letter == REROLE:
            yield letter, ROLE[state], text
            state = AFTER[state]
        elif letter == KEEP:
            yield letter, role, text
            state = NEXT[role[:1]][state]


def _walked(rows: DataFrame, book: DataFrame) -> DataFrame:
    """Each conversation's book entry, then its rows with their texts, in order."""
    entry = F.struct(*[F.col(c) for c in book.columns[1:]])
    heads = book.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("digest"), entry.alias("entry"))
    body = rows.where("NOT gone").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "digest", F.lit(None).cast(heads.schema["entry"].dataType).alias("entry"))
    both = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "digest")
    return both.select("conv_id", "role", "text", "entry")


def repair_book(rows: DataFrame) -> DataFrame:
    """One row a conversation: gaps, blank, duplicate, truncated, illegal, cost (long), audit, repaired_sha256.

    ``rows`` has conv_id, turn (long), role and text; rows flagged in a column
    ``gone`` count for nothing but that their conversation has a result.
    """
    ready = _ordered(rows)
    book = _book(ready)
    schema = StructType([*book.schema.fields, StructField("repaired_sha256", StringType())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None

        def typed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kinds
            for batch in source:
                kinds = kinds or [batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
                yield batch

        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], schema.names)

        for conv, own in _grouped(typed(batches)):
            entry, sha, lead = next(own)[3], hashlib.sha256(), b""
            for _, role, text in _edits(entry["audit"], ((r[1], r[2]) for r in own)):
                sha.update(lead + role.encode() + b":" + text.encode())
                lead = b"\n"
            out.append((conv, *entry.values(), sha.hexdigest()))
            if len(out) >= 1024:
                yield flush()
                out.clear()
        if out:
            yield flush()

    return _walked(ready, book).mapInArrow(digest, schema)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (long, from 0), edit (K, R or I), role, text."""
    ready = _ordered(rows)
    schema = StructType([ready.schema["conv_id"], StructField("position", LongType()), *[StructField(n, StringType()) for n in ("edit", "role", "text")]])

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def typed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in source:
                kind = kind or batch.schema.field("conv_id").type
                yield batch

        for conv, own in _grouped(typed(batches)):
            edits, at = _edits(next(own)[3]["audit"], ((r[1], r[2]) for r in own)), 0
            while part := [x for _, x in zip(range(1024), edits, strict=False)]:
                arrays = [pa.array([conv] * len(part), kind), pa.array(range(at, at + len(part)), pa.int64()), *[pa.array(c, pa.string()) for c in zip(*part, strict=True)]]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)
                at += len(part)

    return _walked(ready, _book(ready)).mapInArrow(repaired, schema)
