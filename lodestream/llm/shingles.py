"""Word shingles as 64-bit fingerprints, and circulant MinHash signatures of them.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text with A-Z lower-cased, which is
how ``bytes.lower().split()`` cuts it. Two different shingles share a 64-bit
fingerprint with odds of 2**-64.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import xxhash

WIDTH = 5
#: Bytes of a text after which its words are cut anew, so that they aren't all held at once.
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: log2 of the number of places that the two permutations act on.
PLACES = 20

_U = np.uint64
_ROW = np.array([0x9E3779B97F4A7C15 + 2 * i * 0x632BE59BD9B4E019 & (1 << 64) - 1 | 1 for i in range(64)], dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _word_hashes(text: bytes) -> np.ndarray:
    """A fingerprint of each word; a long text is cut into words piece by piece."""
    parts, at = [], 0
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        found = words(text[at:end])
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=_U, count=len(found)))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, dtype=_U)


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct fingerprints of all ``width``-word shingles; of fewer words, of the whole sequence; of none, empty."""
    h = _word_hashes(text or b"")
    n = len(h)
    if not n:
        return np.empty(0, dtype=_U)
    if n < width:
        return mix((h * _ROW[:n]).sum(dtype=_U, keepdims=True) + _U(n))
    s = h[: n - width + 1] * _ROW[0]
    for i in range(1, width):
        s += h[i : n - width + 1 + i] * _ROW[i]
    return np.unique(mix(s + _U(width)))


def set_key(shingles: np.ndarray) -> bytes:
    """A 128-bit key of a set."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b|, for sorted distinct arrays."""
    if not len(a) or not len(b):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


@functools.lru_cache(maxsize=4)
def _permutations(seed: int, shifts: int) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and a view whose row ``i`` holds the second one's values at places i, i+1, ... around the circle."""
    rng = np.random.default_rng(seed)
    first = rng.permutation(1 << PLACES).astype(np.uint32)
    second = rng.permutation(1 << PLACES).astype(np.uint32)
    round_ = np.concatenate([second, second[:shifts]])
    return first, np.lib.stride_tricks.sliding_window_view(round_, shifts)


def circulant_signature(shingles: np.ndarray, shifts: int, seed: int) -> np.ndarray:
    """Coordinate k: the least value, over the set, of the second permutation shifted by k at the first one's place."""
    first, second = _permutations(seed, shifts)
    places = first[(shingles >> _U(64 - PLACES)).astype(np.int64)]
    out = np.full(shifts, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(places), 1024):
        np.minimum(out, second[places[at : at + 1024]].min(axis=0), out=out)
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A signed 64-bit key for each band of ``rows`` coordinates; keys of different bands differ."""
    bands = signature.reshape(-1, rows).astype(_U) + _U(1)
    keys = (bands * _ROW[:rows]).sum(axis=1, dtype=_U)
    return mix(mix(keys) + np.arange(len(bands), dtype=_U) * _ROW[8]).view(np.int64)
