"""Hashes of many stretches or words of a byte string at once, from running sums of weighted bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Bytes that are hashed in one go: what their sums take fits a processor's cache.
STEP = 1 << 18
_rng = np.random.default_rng(20240101)
BYTE_WORDS = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The same for texts whose A-Z count as a-z.
FOLDED_WORDS = BYTE_WORDS[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
#: The ASCII white space of the contracts, [\x20\x09-\x0D].
IS_BLANK = np.array([b in b" \t\n\x0b\x0c\r" for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, base, np.uint64))])


def _sums(words: np.ndarray, up: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=out[1:])
    return out


def stretch_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each position on."""
    out = np.empty(max(0, len(data) - size + 1), np.uint64)
    up, down = powers(BASE, STEP + size), powers(UNBASE, STEP)
    for at in range(0, len(out), STEP):
        end = min(at + STEP, len(out))
        sums = _sums(BYTE_WORDS[data[at : end + size - 1]], up)
        out[at:end] = (sums[size:] - sums[:-size]) * down[: end - at]
    return mix(out)


def folded_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a byte string begin, and a 64-bit hash of each with A-Z as a-z. Words are what stands between blanks; the data end with a blank."""
    blank = IS_BLANK[data]
    edge = np.empty(len(data), bool)
    edge[0] = not blank[0]
    np.not_equal(blank[1:], blank[:-1], out=edge[1:])
    edges = np.flatnonzero(edge)
    begins, ends = edges[::2], edges[1::2]
    out = np.empty(len(begins), np.uint64)
    up, down = powers(BASE, STEP), powers(UNBASE, STEP)
    k = 0
    while k < len(begins):
        base = begins[k]
        to = int(np.searchsorted(ends, base + STEP, "right"))
        if to > k:
            sums = _sums(FOLDED_WORDS[data[base : ends[to - 1]]], up)
            out[k:to] = (sums[ends[k:to] - base] - sums[begins[k:to] - base]) * down[begins[k:to] - base]
            k = to
        else:  # a word longer than a step, piece by piece
            out[k] = sum(int(_sums(FOLDED_WORDS[data[at : min(at + STEP, ends[k])]], up)[-1]) * pow(BASE, int(at - base), 1 << 64) for at in range(base, ends[k], STEP)) % (1 << 64)
            k += 1
    return begins, mix(out)
