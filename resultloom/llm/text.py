"""Vectorised text steps over UTF-8 bytes: hashes of any span in constant time, and words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits (one to one)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


@lru_cache(maxsize=8)
def _byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 64, 256, dtype=np.uint64)


class Spans:
    """64-bit hashes of spans of one buffer: equal bytes give equal hashes, wherever they stand.

    They are sums modulo a power of two, which certain spans of 1024 bytes and more share whatever the factors are: compare long spans by their bytes.
    """

    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, buf: np.ndarray, seed: int = 1):
        n = len(buf)
        if len(Spans._powers) <= n:
            size = 1 << int(n).bit_length()
            for name, base in (("_powers", _BASE), ("_inverse", _BASE_INV)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(Spans, name, np.cumprod(steps, dtype=np.uint64))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_byte_values(seed)[buf] * Spans._powers[:n], dtype=np.uint64, out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * Spans._inverse[start] + (end - start).astype(np.uint64))


LONG_WORD = 256   # bytes beyond which a word has a hash of another kind


def lookup_table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: ASCII letters to lower case, other bytes as they are
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
BLANKS = lookup_table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: neither ASCII letters and digits nor part of a character beyond ASCII
NO_WORD = lookup_table(bytes(c for c in range(128) if not chr(c).isalnum()))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def words_of(texts: list[bytes], separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts in one array, and where each text's words begin (one entry more than texts)."""
    buf = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    start, end = runs(~separators[buf])
    ends = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.concatenate(([0], np.searchsorted(start, ends)))
    hashes = Spans(buf).hashes(start, end)
    for k in np.flatnonzero(end - start > LONG_WORD).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(buf[start[k]:end[k]].tobytes())
    return hashes, bounds
