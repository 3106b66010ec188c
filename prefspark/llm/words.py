"""Words of a batch of UTF-8 texts as 64-bit hashes, in numpy passes over the bytes."""

from __future__ import annotations

import numpy as np

#: Bytes that separate words (the white space of the contracts).
BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that separate terms: ASCII without letters and digits; other alphabets' bytes belong to terms.
NO_TERM = np.ones(256, bool)
NO_TERM[128:] = False
NO_TERM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = -(-n // 65536) * 65536
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


class Substrings:
    """Hashes of any substrings of one byte array."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))


def word_hashes(raw: np.ndarray, offs: np.ndarray, separators: np.ndarray = BLANKS):
    """Hashes of the lower-cased words of consecutive rows, and each row's first word number.

    Returns (hashes, first) with first[r]:first[r + 1] the words of row r."""
    data = LOWER[raw]
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(separators[data], out=inside[:-1])
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    ends = inside[:-1] & ~inside[1:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(begins)
    stop = np.flatnonzero(ends) + 1
    return Substrings(data).hashes(start, stop), np.searchsorted(start, offs)
