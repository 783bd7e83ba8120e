"""Words of many texts at once: places and 64-bit hashes by array operations, without a loop over words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Base of the hash of a word's letters; odd, so that it has an inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
#: Letters handled at once: powers of the base are kept for so many.
LETTERS = 1 << 20


@lru_cache(maxsize=1)
def _lowered() -> np.ndarray:
    """By code point: the lower-cased one of a word character, 0 of any other."""
    points = map(chr, range(0x110000))
    made = (ord(c.lower()) if len(c.lower()) == 1 else ord(c) if c.isalnum() or c == "_" else 0 for c in points)
    out = np.fromiter(made, dtype=np.uint32, count=0x110000)
    out[[not (chr(n).isalnum() or chr(n) == "_") for n in range(0x110000)]] = 0
    return out


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    with np.errstate(over="ignore"):
        one = np.ones(1, dtype=np.uint64)
        up, down = (
            np.cumprod(np.concatenate([one, np.full(LETTERS, b, dtype=np.uint64)])) for b in (BASE, pow(BASE, -1, 1 << 64))
        )
    return up, down


def hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of a text: runs of letters, digits and underscores, lower-cased letter by letter."""
    starts, found = [], []
    low = 0
    while low < len(text):
        high = min(len(text), low + LETTERS)
        if high < len(text):
            # never inside a word; one of LETTERS letters and more is cut
            back = next((n for n in range(high, max(low, high - 4096), -1) if not (text[n - 1].isalnum() or text[n - 1] == "_")), high)
            high = back
        a, h = _block(text[low:high])
        starts.append(a + low)
        found.append(h)
        low = high
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(starts), np.concatenate(found)


def _block(text: str) -> tuple[np.ndarray, np.ndarray]:
    letters = _lowered()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    inside = np.concatenate([[False], letters > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers()
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(letters * up[: len(letters)], dtype=np.uint64)])
    made = (sums[ends] - sums[starts]) * down[starts]
    # mixed, so that low bits depend on all letters
    made ^= made >> np.uint64(29)
    made *= np.uint64(0xBF58476D1CE4E5B9)
    made ^= made >> np.uint64(32)
    return starts, made
