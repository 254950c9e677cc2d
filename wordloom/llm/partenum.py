"""PartEnum signatures of feature sets for Jaccard similarity of 0.8 or more.

Two sets of sizes a and b with J >= 4/5 differ in at most (a + b) / 9 features,
and b <= 5a/4.  Sizes fall into bands; a set signs in its own band, and in the
next one if a partner may lie there.  A band partitions the feature domain (by
the top bits of the hash).  Small bands use one level: of n parts, every subset
of n - k is signed, and two sets that differ in k features agree on one of
them.  Larger bands use two levels: of floor(k/2) + 1 groups of three parts at
least one group holds at most one difference, so one of its three two-part
subsets agrees.  A set signs only the first groups that its own k asks for.

In the two-level bands, empty subsets would be shared by nearly everyone, so
they are not signed.  A set signs groups in order until floor(k/2) + 1 of them
had no empty subset; of the two sets of a pair, the one that stops first so
keeps an agreeing subset that holds a feature.  A set that runs out of groups
also signs a common key of its band, needed only between two such sets.  Every
pair of J >= 4/5 shares a signature.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

from .shingles import mix

_U = np.uint64
RATIO_UP = (5, 4)  # the largest partner of a set, as a multiple of its size


def most_different(size: int) -> int:
    """The most features in which a set of this size differs from a partner."""
    return (size + size * RATIO_UP[0] // RATIO_UP[1]) // 9


def _bands() -> list[int]:
    lows = [4]
    while lows[-1] < 1 << 40:
        lows.append(max(lows[-1] + 1, lows[-1] * 3 // 2))
    return lows


LOWS = _bands()
_PAIR_A, _PAIR_B = np.array([0, 0, 1]), np.array([1, 2, 2])


#: Bands whose sets differ in at most so many features use one level.
ONE_LEVEL = 12


@lru_cache(None)
def _subsets(parts: int, size: int) -> np.ndarray:
    return np.array(list(combinations(range(parts), size)))


def _key(values: np.ndarray, *salt: int) -> np.ndarray:
    for x in salt:
        values = mix(values + _U((x * 0x9E3779B97F4A7C15 + 1) & ((1 << 64) - 1)))
    return values


def _sums(features: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of mixed features and number of features of each part of the domain."""
    cuts = (np.arange(1, parts, dtype=np.uint64) << _U(32)) // _U(parts)
    at = np.concatenate(([0], np.searchsorted(features >> _U(32), cuts), [len(features)]))
    run = np.concatenate((np.zeros(1, _U), np.cumsum(mix(features + _U(0x1234567)), dtype=_U)))
    return run[at[1:]] - run[at[:-1]], np.diff(at)


def _band(features: np.ndarray, band: int) -> np.ndarray:
    size, top = len(features), LOWS[band + 1] - 1
    k = max(2 * top // 9, 1)
    if k <= ONE_LEVEL:
        parts = 2 * k + 1 if k < 3 else k + (3 if k == 3 else 2)
        sums, _ = _sums(features, parts)
        chosen = _subsets(parts, parts - k)
        salted = mix(sums + np.arange(1, parts + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95))
        return _key(salted[chosen].sum(axis=1, dtype=_U) + np.arange(len(chosen), dtype=np.uint64), 7, band)
    groups = (k // 2 + 1) * 8 // 7 + 1
    needed = min(most_different(size), k) // 2 + 1
    sums, counts = _sums(features, groups * 3)
    sums, counts = sums.reshape(groups, 3), counts.reshape(groups, 3)
    filled = (counts[:, _PAIR_A] + counts[:, _PAIR_B]) > 0
    whole = np.cumsum(filled.all(axis=1))
    use = int(np.searchsorted(whole, needed)) + 1
    sums, filled = sums[:use], filled[:use]
    salt = (np.arange(len(sums), dtype=np.uint64)[:, None] * _U(3) + np.arange(3, dtype=np.uint64)) * _U(0x9E3779B97F4A7C15)
    keys = mix(mix(sums[:, _PAIR_A]) * _U(3) + sums[:, _PAIR_B] + salt)[filled]
    if use > groups:
        keys = np.concatenate((keys, np.zeros(1, _U)))
    return _key(keys, 11, band)


def signatures(features: np.ndarray) -> np.ndarray:
    """Signature keys of a sorted array of distinct feature hashes.

    Sets of fewer than four features have none: their only partners are equal.
    """
    size = len(features)
    if size < LOWS[0]:
        return np.empty(0, _U)
    band = int(np.searchsorted(LOWS, size, side="right")) - 1
    keys = _band(features, band)
    if size * RATIO_UP[0] // RATIO_UP[1] >= LOWS[band + 1]:
        keys = np.concatenate((keys, _band(features, band + 1)))
    return keys
