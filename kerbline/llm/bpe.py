"""Byte-level BPE with given ranks: encoding by a segment tree over byte positions, and decoding.

A piece of text starts as one token per byte. Leaf i of the tree holds the rank of the pair that starts at byte i
together with i, or infinity when no token starts there or the pair has no rank; a node holds the least of its children.
The root is therefore the leftmost pair of least rank. A merge changes three leaves: the merged place, its live
neighbour to the left, and the place that died; each change climbs one path. A piece of n bytes takes O(n log n).

Short pieces of one padded length are merged side by side, one merge of every piece per step, on arrays. Long pieces use
the same tree one by one, so a piece of any length works.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE_BY_SIDE = 64  # bytes of the longest piece that is merged together with others
CACHED_PIECES = 250_000  # per worker; a full cache starts over
CACHED_PIECE_CHARS = 64
TEXT_BYTES = 2 << 20  # of text that is encoded at a time
NONE = np.int64(1) << np.int64(60)


class Vocabulary:
    """Token bytes by id, and the rank of each mergeable pair of ids."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            self.tokens[i] = token
        pairs = {}
        for token, i in self.ids.items():
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = i
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        self.bytes = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int64)
        self.packed = {piece: np.int32(i).tobytes() for piece, i in self.ids.items()}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids (which is also the id it merges to), NONE where there is none."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_together(v: Vocabulary, pieces: list[bytes]) -> list[np.ndarray]:
    """Ids of pieces of at most SIDE_BY_SIDE bytes (and at least one)."""
    lengths = np.array([len(p) for p in pieces])
    out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
    width = 2
    while width <= SIDE_BY_SIDE:
        low = width // 2 if width > 2 else 0
        rows = np.flatnonzero((lengths > low) & (lengths <= width))
        step = 400_000 // width
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            _encode_width(v, pieces, some, lengths[some], width, out)
        width *= 2
    return out


def _encode_width(v: Vocabulary, pieces: list[bytes], rows: np.ndarray, lengths: np.ndarray, width: int, out: list) -> None:
    m = len(rows)
    raw = np.frombuffer(b"".join(pieces[r].ljust(width, b"\0") for r in rows), dtype=np.uint8).reshape(m, width)
    place = np.arange(width)
    live = place < lengths[:, None]
    token = np.where(live, v.bytes[raw], -1)
    after = np.where(place + 1 < lengths[:, None], place + 1, width)  # width: no live neighbour
    before = np.broadcast_to(place - 1, (m, width)).copy()
    tree = np.full((m, 2 * width), NONE, dtype=np.int64)
    follows = place[:-1] + 1 < lengths[:, None]
    rank = np.full((m, width - 1), NONE, dtype=np.int64)
    rank[follows] = v.ranks(token[:, :-1][follows], token[:, 1:][follows])
    tree[:, width : 2 * width - 1] = np.where(rank < NONE, rank << 8 | place[:-1], NONE)
    for node in range(width - 1, 0, -1):
        tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
    active = np.flatnonzero(tree[:, 1] < NONE)

    def put(r: np.ndarray, p: np.ndarray, value: np.ndarray) -> None:
        node = p + width
        tree[r, node] = value
        while width > 1 and node[0] > 1:  # all leaves are equally deep
            node = node >> 1
            tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

    def pair(r: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The value of leaf p: the rank of its pair and p, where it has a live neighbour."""
        q = after[r, p]
        value = np.full(len(r), NONE, dtype=np.int64)
        some = np.flatnonzero(q < width)
        found = v.ranks(token[r[some], p[some]], token[r[some], q[some]])
        value[some] = np.where(found < NONE, found << 8 | p[some], NONE)
        return value

    while len(active):
        top = tree[active, 1]
        p = top & 255
        gone = after[active, p]
        token[active, p] = top >> 8
        token[active, gone] = -1
        follower = after[active, gone]
        after[active, p] = follower
        has = np.flatnonzero(follower < width)
        before[active[has], follower[has]] = p[has]
        put(active, gone, np.full(len(active), NONE, dtype=np.int64))
        put(active, p, pair(active, p))
        left = before[active, p]
        has = np.flatnonzero(left >= 0)
        if len(has):
            put(active[has], left[has], pair(active[has], left[has]))
        active = active[tree[active, 1] < NONE]
    for r, line in zip(rows.tolist(), token):
        out[r] = line[line >= 0]


def encode_long(v: Vocabulary, piece: bytes) -> np.ndarray:
    """Ids of one piece of any length."""
    n = len(piece)
    width = 1 << max(1, (n - 1).bit_length())
    token: list[int] = v.bytes[np.frombuffer(piece, dtype=np.uint8)].tolist()
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    none, pairs = (1 << 62, 0), v.pairs
    tree = [none] * (2 * width)

    def leaf(p: int) -> tuple[int, int]:
        q = after[p]
        rank = pairs.get(token[p] << 20 | token[q]) if q >= 0 else None
        return none if rank is None else (rank, p)

    def put(p: int, value: tuple[int, int]) -> None:
        node = p + width
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a <= b else b
            if tree[node] == least:
                return
            tree[node] = least
            node >>= 1

    for p in range(n - 1):
        tree[width + p] = leaf(p)
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    while tree[1] != none:
        rank, p = tree[1]
        gone = after[p]
        token[p], token[gone] = rank, -1
        after[p] = after[gone]
        if after[p] >= 0:
            before[after[p]] = p
        put(gone, none)
        put(p, leaf(p))
        if before[p] >= 0:
            put(before[p], leaf(before[p]))
    return np.array([t for t in token if t >= 0], dtype=np.int64)


class Encoder:
    """Encodes texts piece by piece and remembers pieces that came before."""

    def __init__(self, path: str, pattern: str):
        self.v = vocabulary(path)
        self.pieces = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def learn(self, new: list[str]) -> None:
        """Fill the cache with pieces that it lacks."""
        short, spelled = [], []
        for piece in new:
            data = piece.encode()
            whole = self.v.packed.get(data)
            if whole is not None:
                self.known[piece] = whole
            elif len(data) <= SIDE_BY_SIDE:
                short.append(piece)
                spelled.append(data)
            else:
                self.known[piece] = encode_long(self.v, data).astype(np.int32).tobytes()
        if short:
            for piece, ids in zip(short, encode_together(self.v, spelled)):
                self.known[piece] = ids.astype(np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHED_PIECES:
            self.known = {}
        cut = [self.pieces.findall(t) for t in texts]
        new: set[str] = set()
        for pieces in cut:
            new.update(pieces)
        new.difference_update(self.known)
        self.learn(list(new))
        known = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(known, pieces)), dtype=np.int32) for pieces in cut]
        for piece in new:
            if len(piece) > CACHED_PIECE_CHARS:
                del self.known[piece]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.v.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _by_size(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about TEXT_BYTES together."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= TEXT_BYTES:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` (default: all but the text) with ids (array of int) and decoded (binary, from those ids).

    Ids are those of the rank file at `path`, which every executor must have; every match of `pattern` is encoded by
    itself and there are no special tokens, so strings that look like one are ordinary text. A null or empty text has no
    ids. Row order and equal rows do not matter. `carry` may hold columns called ids or decoded: they come back in a
    struct named `_row` when the names clash, else flat.
    """
    names = [c for c in docs.columns if c != text] if carry is None else carry
    data = docs.select(F.struct(*[F.col(f"`{c}`") for c in names] or [F.lit(0).alias("_none")]).alias("_row"),
                       F.coalesce(F.col(text), F.lit("")).alias("_text"))
    row = data.schema["_row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for a, b in _by_size(texts):
                ids = e.encode(texts[a:b])
                ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
                values = pa.array(np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row").slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), values),
                     pa.array([e.decode(x) for x in ids], type=pa.binary())], names=["_row", "ids", "decoded"])

    out = data.mapInArrow(run, f"_row {row}, ids array<int>, decoded binary")
    clash = {"ids", "decoded"} & {c.lower() for c in names}
    return out if clash or not names else out.select("_row.*", "ids", "decoded")
