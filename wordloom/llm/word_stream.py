"""The words of many texts as flat arrays: one table look-up a byte, no per-word Python.

A word is a run of ASCII letters, digits and characters beyond ASCII, with A-Z
lower-cased and nothing else changed.  Bytes of characters beyond ASCII are all
0x80 or more, so words are cut on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Java's form of the class, for small tables that stay in the JVM.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that are cut at once; a longer text is cut alone, which takes some 30 times its size.
SLICE = 4 << 20

_LOW = np.zeros(256, np.uint8)
_LOW[0x80:] = np.arange(0x80, 256)
for _a, _b in (("0", "9"), ("a", "z")):
    _LOW[ord(_a) : ord(_b) + 1] = np.arange(ord(_a), ord(_b) + 1)
_LOW[ord("A") : ord("Z") + 1] = _LOW[ord("a") : ord("z") + 1]


class Words:
    """All words of an array of texts: ``words`` (Arrow strings), ``first`` (each text's first word, one more at the end)."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        held = texts.buffers()[2]
        self.bytes = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and len(texts) else np.zeros(0, np.uint8)
        self.at = offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)
        low = _LOW[self.bytes]
        inside = low > 0
        edge = np.zeros(len(low) + 1, bool)  # a text begins here
        edge[self.at] = True
        before = np.concatenate([[False], inside])[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.concatenate([inside, [False]])[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        ends = np.concatenate([[0], np.cumsum(self.end - self.start)])
        self.words = pa.LargeStringArray.from_buffers(len(self.start), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(low[inside]))
        self.first = np.searchsorted(self.start, self.at)

    def symbols(self, vocabulary: pa.Array) -> np.ndarray:
        """Each word's place in a vocabulary, -1 for others."""
        return pc.fill_null(pc.index_in(self.words, vocabulary.cast(pa.large_string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def characters(self, places: np.ndarray, text: int) -> np.ndarray:
        """Byte places as code points of one text."""
        lo = self.at[text]
        begins = np.concatenate([[0], np.cumsum((self.bytes[lo : self.at[text + 1]] & 0xC0) != 0x80)])
        return begins[places - lo]


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts in runs of at most SLICE bytes, or one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for hi, size in enumerate(sizes.tolist()):
        if hi > lo and held + size > SLICE:
            yield texts.slice(lo, hi - lo)
            lo, held = hi, 0
        held += size
    if len(sizes) > lo:
        yield texts.slice(lo)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after the other."""
    total = int(sizes.sum())
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(total) if total else np.zeros(0, np.int64)
