"""Burrows-Wheeler transforms of string collections, and their merge by interleave refinement.

A collection is a list of byte strings. Every string is closed by a terminator that is below all bytes. All orders are by
the first `depth` symbols; suffixes that agree on them are one class. A suffix that ends earlier is never in one class
with a longer one; how equal short ones are arranged does not matter.

`transform` orders the suffixes of one shard. `merge` takes several transformed shards and never sorts their suffixes
by content: it starts from the shards laid end to end (the interleave of depth 0) and refines which shard each place of
the merged order comes from. A step looks at the classes that are still mixed; inside such a class every shard
contributes a run that is already in order, and the class of the suffix `h` symbols further on (found through the
shard's inverse order, its LF mapping applied h times) says how the runs interleave. A step doubles the common prefix,
so `depth` 400 takes seven steps instead of four hundred. Borders that appear in the last step or before are where
common prefixes end; what lies between two borders is a repeated interval.
"""

from __future__ import annotations

import numpy as np

FIRST = 7  # nine-bit symbols that fit into one 63-bit key


class Shard:
    """One transformed shard: symbols, suffix order, and the transform itself."""

    def __init__(self, strings: list[bytes], depth: int):
        self.lengths = np.array([len(s) for s in strings], dtype=np.int64)
        closed = np.frombuffer(b"".join(s + b"\0" for s in strings), dtype=np.uint8)
        self.symbols = closed.astype(np.uint16) + 1
        self.ends = np.cumsum(self.lengths + 1) - 1
        self.symbols[self.ends] = 0
        self.order = _order(self.symbols, depth)

    @property
    def transform(self) -> np.ndarray:
        """The symbol before each suffix, in suffix order."""
        return self.symbols[self.order - 1]


def _packed(symbols: np.ndarray) -> np.ndarray:
    padded = np.concatenate([symbols, np.zeros(FIRST, dtype=np.uint16)])
    n = len(symbols)
    key = np.zeros(n, dtype=np.int64)
    live = np.ones(n, dtype=bool)
    for i in range(FIRST):
        symbol = padded[i : i + n]
        key <<= 9
        key += np.where(live, symbol, 0)
        live &= symbol != 0  # nothing behind a terminator counts
    return key


def _steps(depth: int):
    """(prefix known, offset of the next class): doubling, the last step ends exactly at `depth`."""
    h = FIRST
    while h < depth:
        step = min(h, depth - h)
        yield h, step
        h += step


def _starts(fresh: np.ndarray) -> np.ndarray:
    """For flags of group starts, the place of the start of each entry's group."""
    places = np.arange(len(fresh))
    return np.maximum.accumulate(np.where(fresh, places, 0))


def _refine(order: np.ndarray, key: np.ndarray, depth: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Refine an order whose classes agree on FIRST symbols until they agree on `depth`; also the class of each suffix."""
    n = len(order)
    arranged = key[order]
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = arranged[1:] != arranged[:-1]
    places = _starts(fresh)
    rank = np.zeros(n + depth, dtype=np.int64)
    rank[order] = places + 1
    active = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    for _, step in _steps(depth):
        if not len(active):
            break
        suffixes = order[active]
        pair = (rank[suffixes] << 32) | rank[suffixes + step]
        to = np.argsort(pair, kind=kind)
        suffixes, pair = suffixes[to], pair[to]
        order[active] = suffixes
        fresh = np.ones(len(active), dtype=bool)
        fresh[1:] = pair[1:] != pair[:-1]
        rank[suffixes] = active[_starts(fresh)] + 1
        active = active[~(fresh & np.append(fresh[1:], True))]
    return order, rank[:n]


def _order(symbols: np.ndarray, depth: int) -> np.ndarray:
    key = _packed(symbols)
    order = np.argsort(key, kind="stable")
    return _refine(order, key, depth, "quicksort")[0]


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merged order of all suffixes, the class of every suffix on `depth` symbols, and the interleave.

    Suffixes are numbered through the shards laid end to end; the interleave names the shard of each place.
    """
    offsets = np.cumsum([0] + [len(s.symbols) for s in shards])
    key = np.concatenate([_packed(s.symbols) for s in shards])
    laid = np.concatenate([s.order + o for s, o in zip(shards, offsets)])
    order = laid[np.argsort(key[laid], kind="stable")]  # runs of ordered shards: a merge, not a sort
    order, classes = _refine(order, key, depth, "stable")
    source = np.searchsorted(offsets, order, side="right") - 1
    return order, classes, source


def repeated_starts(strings: list[bytes], weights: np.ndarray, depth: int, shard_bytes: int = 1 << 19) -> list[np.ndarray]:
    """For each string, a flag per start of a `depth`-byte substring: does it also start anywhere else?

    A string of weight two or more stands for that many equal strings, so it repeats by itself.
    """
    total = sum(len(s) + 1 for s in strings)
    count = max(1, min(64, -(-total // shard_bytes), len(strings)))
    members = [list(range(i, len(strings), count)) for i in range(count)]
    shards = [Shard([strings[j] for j in m], depth) for m in members]
    _, classes, _ = merge(shards, depth)
    owner = np.concatenate([np.repeat(np.asarray(m), s.lengths + 1) for m, s in zip(members, shards)])
    length = np.concatenate([np.repeat(s.lengths, s.lengths + 1) for s in shards])
    begin = np.concatenate([np.repeat(s.ends - s.lengths, s.lengths + 1) + o for s, o in
                            zip(shards, np.cumsum([0] + [len(s.symbols) for s in shards])[:-1])])
    within = np.arange(len(owner)) - begin
    whole = within <= length - depth
    held = np.bincount(classes[whole], weights=np.asarray(weights)[owner[whole]], minlength=len(owner) + 2)
    flag = held[classes] >= 2
    out: list[np.ndarray] = [None] * len(strings)  # type: ignore[list-item]
    at = 0
    for m, s in zip(members, shards):
        for j, n in zip(m, s.lengths):
            out[j] = flag[at : at + max(0, n - depth + 1)]
            at += n + 1
    return out
