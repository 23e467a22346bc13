"""Word shingles, MinHash signatures and posterior bounds in numpy; no Spark here."""

from __future__ import annotations

import math

import numpy as np
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(29)


class WordHashes(dict):
    """64-bit hash of each word seen, kept up to a bound and then started anew."""

    bound = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of bytes other than space and 0x09-0x0D, with A-Z in lower case."""
    return [] if not text else text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles.

    A text with fewer words than ``width`` has one shingle, its whole sequence; one without words none.
    """
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    out *= _MIX
    for k in range(size):
        out ^= codes[k : len(codes) - size + 1 + k]
        out *= _MIX
        out ^= out >> _TURN
    return np.unique(out)


def digest(shingles: np.ndarray) -> bytes:
    """128-bit fingerprint of a set."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def multipliers(count: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(20_240_601))
    return rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Minimum of each multiplicative hash over a set that is not empty."""
    mixed = shingles ^ (shingles >> np.uint64(31))
    low = None
    for at in range(0, len(mixed), 512):
        part = np.multiply.outer(odd, mixed[at : at + 512]).min(1)
        low = part if low is None else np.minimum(low, part)
    return low


def banding(threshold: float, miss: float, most_bands: int = 40) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which a pair at the threshold is missed with at most ``miss``."""
    best = None
    for rows in range(1, 33):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(miss) / math.log1p(-hit))
        if bands <= most_bands:
            best = (bands, rows)
    return best or (most_bands, 1)


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Signed 64-bit hash of each band."""
    part = sig[: bands * rows].reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64) * _MIX
    for k in range(rows):
        out = (out ^ part[:, k]) * _MIX
        out ^= out >> _TURN
    return out.view(np.int64)


def least_matches(batches: list[int], threshold: float, miss: float) -> list[int]:
    """For each number of compared hashes, the fewest matches that keep a pair alive.

    With a uniform prior the similarity of a pair with m of n equal hashes is Beta(m+1, n-m+1), so
    P(similarity >= t | m, n) = P(Bin(n+1, t) <= m). A pair is pruned where that is below ``miss``.
    """
    out = []
    for n in batches:
        total, m = 0.0, -1
        while m < n:
            total += math.comb(n + 1, m + 1) * threshold ** (m + 1) * (1 - threshold) ** (n - m)
            if total >= miss:
                break
            m += 1
        out.append(m + 1)
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
