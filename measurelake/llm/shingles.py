"""Word shingles of whole texts as 64-bit hashes, and b-bit minwise signatures."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5  # words in a shingle

_CACHE_WORDS = 300_000  # word hashes a Python worker keeps; beyond it starts over
_hashes: dict[bytes, int] = {}


def _constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers from a seed."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_STEPS = _constants(WORDS + 1, 5)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word."""
    if len(_hashes) > _CACHE_WORDS:
        _hashes.clear()
    try:
        return np.array([_hashes[w] for w in words], np.uint64)
    except KeyError:
        for w in set(words).difference(_hashes):
            _hashes[w] = xxhash.xxh64_intdigest(w)
        return np.array([_hashes[w] for w in words], np.uint64)


def shingle_set(text: bytes | None, size: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``size`` words, 5 at most, of a UTF-8 text.

    A-Z count as a-z; words are runs of characters other than ASCII white
    space.  A text of fewer words has one shingle, all its words; a text without
    words, and null, have none.
    """
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    if n < size:
        return _mix((h * _STEPS[:n]).sum(keepdims=True) + np.array([n], np.uint64) * _STEPS[WORDS])
    total = h[: n - size + 1] * _STEPS[0]
    for i in range(1, size):
        total += h[i : n - size + 1 + i] * _STEPS[i]
    return np.unique(_mix(total))


def signature(shingles: np.ndarray, slots: int = 64) -> np.ndarray:
    """The low 16 bits of the minimum of each of ``slots`` random orders of the set."""
    factors = _constants(slots, 7)
    least = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = np.multiply.outer(factors, shingles[at : at + 4096])
        np.minimum(least, part.min(axis=1), out=least)
    return (_mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
