"""Sets of word shingles as sorted 64-bit hashes, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240229)
# a random number for each byte; capitals A-Z share those of small letters
BYTE = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64)
BYTE[65:91] = BYTE[97:123]
ROOT = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CHUNK_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


def _sets(texts: list[bytes], width: int, up: np.ndarray, down: np.ndarray) -> list[np.ndarray]:
    data = np.frombuffer(b"".join(t + b" " for t in texts), dtype=np.uint8)
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE[data] * up[:n], out=sums[1:])
    space = SPACE[data]
    begin = np.flatnonzero(~space & np.append(True, space[:-1]))
    end = np.flatnonzero(space & np.append(False, ~space[:-1]))
    word = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    first = np.searchsorted(begin, ends - [len(t) + 1 for t in texts])
    last = np.searchsorted(begin, ends)
    whole = np.zeros(len(word), dtype=np.uint64)
    for i in range(width):
        whole = whole * np.uint64(0xD6E8FEB86659FD93)
        whole[: max(0, len(word) - i)] += word[i:]
    whole = mix(whole)
    out = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            h = np.uint64(0x1234567)
            for w in word[a:b]:
                h = mix(np.array([h ^ w]))[0] + np.uint64(b - a)
            out.append(np.array([h], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def shingle_sets(texts: list[bytes], width: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of `width` words, ascending; a shorter text is one shingle, one without words none."""
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) < CHUNK_BYTES):
            size += len(texts[upto]) + 1
            upto += 1
        up, down = _powers(size, ROOT), _powers(size, INVERSE)
        with np.errstate(over="ignore"):
            yield from _sets(texts[at:upto], width, up, down)
        at = upto
