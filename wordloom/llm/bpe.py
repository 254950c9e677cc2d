"""BPE encoding and decoding through distinct-word tables.

Texts are split at points where no vocabulary of the kind in use can join what
stands on both sides; the points come from one look at all bytes of a slice, and
Arrow tells its distinct words.  Each worker keeps a table of the distinct words
that it has met; a word is encoded by the library once, when it enters the table,
and every occurrence gets its ids by position from there (one gather per slice).
Decoding goes the other way: ids are joined to their pieces by position.

The table is bounded: once it holds TABLE_WORDS words it is cut to the
KEPT_WORDS used most, so memory does not grow with the corpus.  A table for the whole corpus
with a shuffle of positions was ruled out by measure; see README.

Defined cases: null and empty texts have no ids and decode to ""; null id
arrays decode to ""; unknown ids raise; repeated rows are encoded one by one; an
empty table gives no rows; a text is encoded whole, however long, in memory of
some 20 times its size; ``encode`` and ``encode_decode`` read key and text alone,
so other columns can't clash.
"""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from wordloom.plans.workers import lean

TABLE_WORDS, KEPT_WORDS = 200_000, 100_000
#: Words are looked up for about so many characters of text at once.
SLICE = 1 << 19

#: White space beyond ASCII (and separators that look like it): such texts, and
#: texts with an added token, are not cut for byte-level vocabularies.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _class(members: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(members))


_SPACE, _LETTER = _class(b"\x20\x09\x0a\x0b\x0c\x0d"), _class(string.ascii_letters.encode())
#: Marks that byte-level vocabularies never join to a letter before them.
_MARK = _class(b".,;:!?#*$%&|<>()")
#: Second bytes, after C3, of the letters from U+00C0 to U+00FF.
_SECOND = _class(bytes(b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)))

#: A word of letters (an optional space first), then perhaps closing marks.
_PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
_PROBES = ("the", " the", "Word", " Straße,", "école.", " ÉCOLE", "ndwhst...", " thouinor", "a", " I", "Ñandú!?", "thhetionWHEN;")
_MARKED = tuple(f"{word}{chr(mark)}{tail}" for word in ("the", " Straße", "é") for mark in np.flatnonzero(_MARK).tolist() for tail in ("", chr(mark), "next", " next", "'s", "1"))


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for byte in range(256):
        letters.append(chr(byte if byte in printable else spare))
        spare += byte not in printable
    return letters


_BYTE_LETTERS = _byte_letters()


class _Places(dict):
    """Word -> place in the table; a new word takes the next place and is noted as fresh."""

    def __init__(self, items=()):
        super().__init__(items)
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        self.fresh.append(word)
        return place


class WordTable:
    """Ids of distinct words under one vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Vocabularies whose words drop white space split there; byte-level ones keep it in the words.
        self.drops_space = self.tokenizer.encode("a a", add_special_tokens=False).ids == 2 * self.tokenizer.encode("a", add_special_tokens=False).ids
        self.model = self.tokenizer.model
        self.has_plain = self.cuts_marks = False
        self.clear()
        try:  # the short way is taken only if it agrees with the library
            probes = [w for w in _PROBES if not (self.drops_space and w[0] == " ")]
            self.has_plain = self._plain(probes) == [self.tokenizer.encode(w, add_special_tokens=False).ids for w in probes]
        except Exception:
            self.has_plain = False
        if self.has_plain and not self.drops_space:
            self.cuts_marks = True
            self.cuts_marks = all(self.encode([x])[0].tolist() == self.tokenizer.encode(x, add_special_tokens=False).ids for x in _MARKED)
            self.clear()

    def clear(self) -> None:
        self.place = _Places()
        self.start, self.count, self.uses = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(4096, np.int32), 0

    def _shrink(self) -> None:
        """Keeps the words used most, the later of equals going first; uses count half from then on."""
        keep = np.sort(np.argsort(-self.uses[: len(self.place)], kind="stable")[: KEPT_WORDS])
        words = list(self.place)
        self.place = _Places(zip([words[i] for i in keep], range(len(keep)), strict=True))
        sizes = self.count[keep]
        ends = np.cumsum(sizes)
        self.flat = self.flat[np.repeat(self.start[keep] - (ends - sizes), sizes) + np.arange(ends[-1])]
        self.start, self.count, self.uses, self.used = ends - sizes, sizes, self.uses[keep] // 2, len(self.flat)

    def _fill(self) -> None:
        """Encodes the words that entered the table since the last call."""
        words, self.place.fresh = self.place.fresh, []
        n = len(self.place) - len(words)
        while len(self.place) > len(self.start):
            self.start, self.count, self.uses = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.count, self.uses))
        for lo in range(0, len(words), 20_000):
            part = words[lo : lo + 20_000]
            ids = self._encode_words([w.decode("utf-8", "replace") for w in part])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            total = int(sizes.sum())
            while self.used + total > len(self.flat):
                self.flat = np.concatenate((self.flat, self.flat))
            self.start[n + lo : n + lo + len(part)] = self.used + np.cumsum(sizes) - sizes
            self.count[n + lo : n + lo + len(part)] = sizes
            self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.int32, total)
            self.used += total

    def _encode_words(self, words: list[str]) -> list[list[int]]:
        ids = self._plain(words) if self.has_plain else [None] * len(words)
        rest = [w for w, x in zip(words, ids, strict=True) if x is None]
        found = iter(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else ())
        return [next(found).ids if x is None else x for x in ids]

    def _plain(self, words: list[str]) -> list[list[int] | None]:
        """Ids of letters and closing marks straight from the merge model; None for other words.

        A run of letters and a closing run of marks are two pre-tokens under
        either kind of vocabulary, so the library's splitting can be left out.
        """
        out: list[list[int] | None] = []
        match, merge, lower, ends = _PLAIN.fullmatch, self.model.tokenize, self.drops_space, {"": []}
        for word in words:
            m = match(word)
            if m is None:
                out.append(None)
                continue
            letters, marks = m.groups()
            if lower:
                letters = letters.lower()
            if not letters.isascii():
                letters = "".join([_BYTE_LETTERS[b] for b in letters.encode()])
            elif letters[0] == " ":
                letters = _BYTE_LETTERS[32] + letters[1:]
            if marks not in ends:
                ends[marks] = [t.id for t in merge(marks)]
            out.append([t.id for t in merge(letters)] + ends[marks])
        return out

    def _units(self, texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
        """The units of the texts one after the other, and how many each text has.

        Vocabularies that drop white space get the words between it.  For others
        a unit is a word with the space before it, or a run of white space less
        the last character if a word follows; that one is a unit of its own
        unless it is the word's space.
        """
        parts = [x.encode("utf-8", "replace") if x else b"" for x in texts]
        data = b"".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        starts = np.concatenate(([0], ends))[: len(ends)]
        codes = np.frombuffer(data, np.uint8)
        space, edge = _SPACE[codes], np.zeros(len(codes) + 1, bool)
        if self.drops_space:  # bytes split at ASCII white space alone
            edge[1:-1] = space[1:] != space[:-1]
        else:
            edge[: max(len(codes) - 1, 0)] = space[:-1] & ~space[1:]
            edge[(ends - 1)[ends > starts]] = False  # white space that ends a text is one unit
            edge[1:-1] |= (space[1:] & ~space[:-1]) | (~space[1:] & space[:-1] & (codes[:-1] != 0x20))
            if self.cuts_marks:
                letter = _LETTER[codes]
                letter[1:] |= _SECOND[codes[1:]] & (codes[:-1] == 0xC3)
                edge[1:-1] |= letter[:-1] & _MARK[codes[1:]]
            for i, text in enumerate(texts):
                if text and ((not text.isascii() and _ODD.search(text)) or any(x in text for x in self.added)):
                    edge[starts[i] : ends[i]] = False  # such a text is one unit
        edge[starts] = edge[-1] = True
        at = np.flatnonzero(edge)
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])
        first = at[:-1]
        if self.drops_space:
            word = ~space[first]
            units, first = units.filter(pa.array(word)), first[word]
        return units, np.searchsorted(first, ends) - np.searchsorted(first, starts)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each text has."""
        units, held = self._units(texts)
        if len(self.place) > TABLE_WORDS:
            self._shrink()
        met = units.dictionary_encode()
        here, words = met.indices.to_numpy(), met.dictionary.to_numpy(zero_copy_only=False).tolist()
        places = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        if self.place.fresh:
            self._fill()
        self.uses[places] += np.bincount(here, minlength=len(words))
        sizes = self.count[places][here]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(here) else 0
        ids = self.flat[np.repeat(self.start[places][here] - (ends - sizes), sizes) + np.arange(total)]
        bounds = np.concatenate(([0], ends))[np.cumsum([0, *held])]
        return ids, np.diff(bounds)


_tables: dict[str, WordTable] = {}


def table_for(path: str) -> WordTable:
    if path not in _tables:
        _tables[path] = WordTable(path)
    return _tables[path]


def slices(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a column in parts of about SLICE characters, each with its first row."""
    start = 0
    while start < len(column):
        part, held = [], 0
        for i in range(start, len(column)):
            part.append(column[i].as_py())
            held += len(part[-1] or "")
            if held >= SLICE:
                break
        yield start, part
        start += len(part)


def _lists(ids: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ids array<int>) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch[1]):
                yield pa.RecordBatch.from_arrays([batch[0].slice(at, len(texts)), _lists(*table_for(path).encode(texts))], [key, "ids"])

    source = docs.select(F.col(key), F.col(text))
    return source.mapInArrow(lean(run), f"`{key}` {source.schema[0].dataType.simpleString()}, ids array<int>")


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ids array<int>, decoded string): both ways in one worker, so ids need not travel in between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = Pieces(path)
        for batch in batches:
            for at, texts in slices(batch[1]):
                ids, sizes = table_for(path).encode(texts)
                yield pa.RecordBatch.from_arrays([batch[0].slice(at, len(texts)), _lists(ids, sizes), back.decode(np.split(ids, np.cumsum(sizes)[:-1]))], [key, "ids", "decoded"])

    source = docs.select(F.col(key), F.col(text))
    return source.mapInArrow(lean(run), f"`{key}` {source.schema[0].dataType.simpleString()}, ids array<int>, decoded string")


def pieces_of(path: str) -> tuple[list[str], bool]:
    """The piece of every id, and whether decoding is joining pieces with spaces (a file without a decoder)."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    named = content["model"]["vocab"] | {t["content"]: t["id"] for t in content["added_tokens"]}
    pieces = [""] * (max(named.values(), default=-1) + 1)
    for piece, number in named.items():
        pieces[number] = piece
    return pieces, content.get("decoder") is None


class Pieces:
    """Decoding by joining every id to its piece."""

    def __init__(self, path: str):
        pieces, self.plain = pieces_of(path)
        self.path, self.pieces = path, np.array(pieces, object)

    def decode(self, rows: Iterable[np.ndarray]) -> pa.Array:
        """One text per row of ids; an id outside the vocabulary raises."""
        if self.plain:
            return pa.array([" ".join(self.pieces[row]) for row in rows], pa.string())
        return pa.array([table_for(self.path).tokenizer.decode(list(map(int, row)), skip_special_tokens=False) for row in rows], pa.string())


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids, special tokens included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = Pieces(path)
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                rows = (np.array(row.as_py() or [], np.int64) for row in batch[ids])
                yield pa.RecordBatch.from_arrays([*batch.columns, back.decode(rows)], [*batch.schema.names, out])

    return encoded.mapInArrow(lean(run), StructType([*encoded.schema.fields]).add(out, StringType()))
