"""Word shingles of a text as sorted 64-bit hashes (numpy, one text at a time).

Words are maximal runs of characters outside space, tab, LF, VT, FF and CR of
the text with A-Z lower-cased.  The features of a text are its distinct runs of
five words; a text of one to four words has its whole word sequence as its only
feature; a text without words has none.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5
_U = np.uint64
_BASE, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, *range(9, 14)]] = True
#: Texts are hashed in pieces of about so many bytes, cut at separators.
PIECE = 1 << 20
_powers = {"n": 0, "up": None, "down": None}
_SLOT = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of the public SplitMix64 generator."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and their inverses."""
    if _powers["n"] < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def _words_of(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    inside = np.empty(len(raw) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(_SEPARATOR[raw], out=inside[1:-1].view(bool))
    edge = np.flatnonzero(np.diff(inside))
    start, end = edge[::2], edge[1::2]
    up, down = _scales(len(raw))
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum((raw.astype(_U) + _U(1)) * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash per word, in order."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    if len(data) <= PIECE:
        return _words_of(data) if data else np.empty(0, _U)
    parts, at = [], 0
    while at < len(data):
        to = at + PIECE
        while to < len(data) and not _SEPARATOR[data[to]]:
            to += 1
        parts.append(_words_of(data[at:to]))
        at = to
    return np.concatenate(parts)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct feature hashes of a text."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return words
    if n < WIDTH:
        return mix((words * _SLOT[:n]).sum(dtype=_U).reshape(1) + _U(n))
    found = words[: n - WIDTH + 1] * _SLOT[0]
    for k in range(1, WIDTH):
        found += words[k : n - WIDTH + 1 + k] * _SLOT[k]
    found = mix(found)
    found.sort()
    return found[np.concatenate(([True], found[1:] != found[:-1]))]
