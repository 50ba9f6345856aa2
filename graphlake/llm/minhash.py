"""Word shingles and MinHash signatures in numpy.

A text's words are its runs without white space; its shingles are the runs of
``width`` consecutive words, or the whole text where it has fewer words but at
least one. A shingle is hashed as a substring of the text with single spaces:
one prefix sum of bytes times powers gives the hash of every substring.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

#: Bytes of text whose powers a worker keeps; those of longer texts are made anew.
KEPT_POWERS = 1 << 18


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    made = _powers(KEPT_POWERS) if n <= KEPT_POWERS else _powers.__wrapped__(n)
    return made[0][:n], made[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    raw = np.frombuffer(" ".join(text.split()).encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    power, inverse = _powers_to(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    spaces = np.flatnonzero(raw == 32)
    starts = np.concatenate([[0], spaces + 1])
    stops = np.concatenate([spaces, [len(raw)]])
    n = max(1, len(starts) - width + 1)
    starts, stops = starts[:n], stops[-n:]
    return np.unique(mix((sums[stops] - sums[starts]) * inverse[starts]))


class Permutations:
    """``count`` universal hash functions h(x) = (a x + b) >> 32 on 64-bit x."""

    def __init__(self, count: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, count, dtype=np.uint64)

    def signature(self, sh: np.ndarray, chunk: int = 2048) -> np.ndarray:
        """The least value of each function over the shingles, as uint32; all
        ones where there are none."""
        low = np.full(len(self.a), (1 << 32) - 1, np.uint64)
        for i in range(0, len(sh), chunk):
            h = self.a[:, None] * sh[None, i : i + chunk]
            h += self.b[:, None]
            np.minimum(low, h.min(axis=1) >> np.uint64(32), out=low)
        return low.astype(np.uint32)


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """The least number of bands of ``rows`` rows that finds a pair of similarity
    ``threshold`` with probability ``recall`` at least."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


def band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit hash per band of ``rows`` values; the band's number is part of it."""
    parts = signature.reshape(-1, rows).astype(np.uint64)
    h = np.arange(1, len(parts) + 1, dtype=np.uint64) * np.uint64(BASE)
    for k in range(rows):
        h = mix(h ^ parts[:, k]) + np.uint64(k + 1)
    return mix(h)
