"""Vectorised hashing of word sequences (unsigned 64-bit, wrapping arithmetic)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

U64 = np.uint64
#: Odd multipliers of the two rolling hashes, and their inverses modulo 2 ** 64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the output."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    def run(b: int) -> np.ndarray:
        p = np.full(size, b, U64)
        p[0] = 1
        return np.multiply.accumulate(p)

    return run(base), run(pow(base, -1, 1 << 64))


def prefix(h: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums from which :func:`span` takes the hash of any run."""
    size = 1 << max(10, int(len(h) + 1).bit_length())
    up, _ = _powers(BASES[which], size)
    out = np.zeros(len(h) + 1, U64)
    np.cumsum(h * up[: len(h)], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, stop: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the runs [start, stop): equal runs have equal hashes wherever they stand."""
    size = 1 << max(10, int(len(sums)).bit_length())
    _, down = _powers(BASES[which], size)
    return mix((sums[stop] - sums[start]) * down[start])


def runs(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hashes of all runs of k words."""
    start = np.arange(max(0, len(h) - k + 1))
    return span(prefix(h, which), start, start + k, which)


def sliding(x: np.ndarray, w: int, pick=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of each w neighbours, by doubling."""
    if len(x) < w:
        return x[:0]
    out, have = x, 1
    while 2 * have <= w:
        out, have = pick(out[: len(out) - have], out[have:]), 2 * have
    return pick(out[: len(x) - w + 1], out[w - have :]) if have < w else out
