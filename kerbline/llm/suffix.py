"""Suffix-array dedup: remove every byte covered by a long string that starts anywhere else as well.

Only places that can repeat are ever ordered, in three jobs:

1. *Anchors.* A 16-byte string is an anchor when its hash says so (one in 64 for strings of 400 bytes). Anchors depend on their own bytes only, so
   equal strings hold equal anchors. Occurrences are counted over the corpus; a 400-byte string with an anchor that
   occurs once cannot repeat. (Strings without any anchor use their own least hash instead, so none is overlooked.)
2. *Contexts.* Each remaining start belongs to the rarest anchor inside its 400 bytes. Starts of one anchor that follow
   each other form a context: their bytes and the 399 after them. Equal contexts are combined, with a weight, in the task
   that finds them, before anything is shuffled; a passage that a third of all documents share has only its common
   anchors inside, so it collapses to one context per task.
3. *Transforms.* Contexts meet by anchor. A task orders its contexts in shards, merges their Burrows-Wheeler transforms
   by interleave refinement (`bwt.py`) and reads off the intervals that share 400 bytes. An interval of weight two or
   more is a repeated string.

Equal strings have the same rarest anchor, so they meet in one task and nothing is missed; different strings are told
apart by their bytes, so nothing is removed by a hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.bwt import repeated_starts
from kerbline.llm.work import row_key, stored

GRAM = 16
PER_REPEAT = 6  # anchors in the length of a repeat, on average, at least
HELD_BYTES = 16 << 20  # contexts a map task combines before it passes them on
SLICE_ROWS = 500  # documents that a map task looks at before it passes their places on
BATCH_BYTES = 1 << 20  # contexts that are ordered together; a single anchor's contexts stay together
CONTEXT_PARTITION = 2 << 20  # bytes of contexts for which one reduce partition is planned
UNHINTED = np.uint64(1) << np.uint64(63)


def anchor_rate(length: int) -> int:
    """One place in so many is an anchor: a power of two that suits the length of repeats (64 for 400 bytes, 32 for 200)."""
    return 1 << max(0, (length // PER_REPEAT).bit_length() - 1)


def _hashes(data: bytes) -> np.ndarray:
    """A hash of the 16 bytes at every place (the last places run into padding)."""
    held = np.frombuffer(data + b"\0" * GRAM, dtype=np.uint8)
    low = np.ndarray((len(data),), "<u8", buffer=held, strides=(1,))
    high = np.ndarray((len(data),), "<u8", buffer=held, offset=8, strides=(1,))
    h = low * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += high
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _gap_places(h: np.ndarray, first: int, last: int, span: int) -> np.ndarray:
    """For every window of `span` hashes that starts in first..last, the place of its least hash, each place once."""
    found = []
    for at in range(first, last + 1, 4096):
        upto = min(last, at + 4095)
        view = np.lib.stride_tricks.sliding_window_view(h[at : upto + span], span)
        found.append(np.unique(view.argmin(axis=1) + np.arange(at, upto + 1)))
    return np.unique(np.concatenate(found))


def doc_anchors(h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a document's anchors and their keys. `h` holds its hashes, `length` is the length of repeats.

    Keys of stand-in anchors have the top bit set, those of ordinary ones do not.
    """
    n = len(h)
    span = length - GRAM + 1  # places whose 16 bytes lie within a window
    usable = h[: n - GRAM + 1]
    places = np.flatnonzero((usable & np.uint64(anchor_rate(length) - 1)) == 0)
    keys = usable[places] >> np.uint64(1)
    edges = np.concatenate([[-1], places, [n - GRAM + 1]])
    gaps = np.flatnonzero(np.diff(edges) > span)
    if len(gaps):
        extra = np.unique(np.concatenate([_gap_places(usable, int(edges[g]) + 1, int(edges[g + 1]) - span, span) for g in gaps]))
        places = np.concatenate([places, extra])
        keys = np.concatenate([keys, (usable[extra] >> np.uint64(1)) | UNHINTED])
        to = np.argsort(places)
        places, keys = places[to], keys[to]
    return places, keys


def doc_contexts(n: int, places: list[int], keys: list[int], counts: list[int], length: int) -> list[tuple[int, int, int, bool]]:
    """Runs of starts by their rarest anchor, where that anchor repeats: (first start, last start, anchor, several places).

    `places` holds every anchor of the document; a count of one marks an anchor that occurs nowhere else.
    """
    reach = length - GRAM
    rank = [(k >> 63, 0 if k >> 63 else c, k) for k, c in zip(keys, counts)]
    m = len(places)
    after, before, stack = [n] * m, [-1] * m, []
    for i in range(m):
        while stack and rank[stack[-1]] > rank[i]:
            after[stack.pop()] = places[i]
        if stack:
            top = stack[-1]
            before[i] = places[top] if rank[top] < rank[i] else before[top]
        stack.append(i)
    runs: list[tuple[int, int, int, bool]] = []
    for i in range(m):
        if counts[i] < 2:
            continue
        a = max(before[i] + 1, places[i] - reach, 0)
        b = min(places[i], after[i] - reach - 1, n - length)
        if a > b:
            continue
        if runs and runs[-1][2] == keys[i] and a <= runs[-1][1] + 1:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]), keys[i], True)
        else:
            runs.append((a, b, keys[i], False))
    return runs


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)


def _find_anchors(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            ka, kb, texts = frame["_ka"].to_numpy(), frame["_kb"].to_numpy(), frame["_bytes"].tolist()
            rows, at = [], []
            size = 0

            def flush():
                data = b"".join(bytes(texts[j]) for j in at)
                h = _hashes(data)
                begin = 0
                for j in at:
                    n = len(texts[j])
                    places, keys = doc_anchors(h[begin : begin + n], length)
                    begin += n
                    if len(places):
                        rows.append((np.full(len(places), j), places, keys))

            for j, text in enumerate(texts):
                if len(text) < length:
                    continue
                at.append(j)
                size += len(text)
                if size > 1 << 20:
                    flush()
                    at, size = [], 0
            if at:
                flush()
            if rows:
                who = np.concatenate([r[0] for r in rows])
                yield pd.DataFrame({"_ka": ka[who], "_kb": kb[who], "place": np.concatenate([r[1] for r in rows]).astype(np.int32),
                                    "anchor": _signed(np.concatenate([r[2] for r in rows]))})

    return run


CONTEXTS = pa.schema([("kind", pa.string()), ("anchor", pa.int64()), ("digest", pa.binary()), ("bytes", pa.binary()), ("weight", pa.int64()),
                      ("several", pa.bool_()), ("_ka", pa.int64()), ("_kb", pa.int64()), ("start", pa.int32())])


def _find_contexts(length: int):
    """Rows of two kinds: contexts with the weight found so far in this task, and where each context occurs.

    Anchors stay in Arrow and batches are taken in slices, so a worker holds little beside the contexts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0

        def rows(kind: str, n: int, **columns) -> pa.RecordBatch:
            given = {"kind": [kind] * n, "bytes": [None] * n, "several": [False] * n} | columns
            return pa.RecordBatch.from_arrays([pa.array(given.get(f.name, np.zeros(n, np.int64)), f.type) for f in CONTEXTS], schema=CONTEXTS)

        def release() -> Iterator[pa.RecordBatch]:
            if held:
                anchors, contexts, weights, several = zip(*held.values())
                yield rows("context", len(held), anchor=anchors, digest=list(held), bytes=contexts, weight=weights, several=several)
                held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                lists = part.column("anchors")
                bounds = lists.offsets.to_numpy()
                found = lists.values
                at_place, at_count = (found.field(c).to_numpy(zero_copy_only=False) for c in ("place", "n"))
                ka, kb, digests, starts = [], [], [], []
                for i, (a, b) in enumerate(zip(part.column("_ka").to_pylist(), part.column("_kb").to_pylist())):
                    text = part.column("_bytes")[i].as_py()
                    places, keys = doc_anchors(_hashes(text), length)
                    of = slice(bounds[i], bounds[i + 1])
                    known = dict(zip(at_place[of].tolist(), at_count[of].tolist()))
                    counts = [known.get(p, 1) for p in places.tolist()]
                    for first, last, key, several in doc_contexts(len(text), places.tolist(), keys.tolist(), counts, length):
                        context = text[first : last + length]
                        digest = hashlib.blake2b(key.to_bytes(8, "little") + context, digest_size=16).digest()
                        ka.append(a), kb.append(b), digests.append(digest), starts.append(first)
                        if digest in held:
                            held[digest][2] += 1
                        else:
                            held[digest] = [key - (1 << 64) if key >> 63 else key, context, 1, several]
                            size += len(context) + 200
                    if size > HELD_BYTES:
                        yield from release()
                        size = 0
                if ka:
                    yield rows("place", len(ka), digest=digests, _ka=ka, _kb=kb, start=starts)
        yield from release()

    return run


def covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that strings of `length` at the given sorted starts cover, as (begin, end)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.concatenate([cut, [len(starts) - 1]])] + length).tolist()))


def _find_repeats(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: dict[bytes, list] = {}
        ready_size = 0
        anchor, group = None, {}

        def ordered():
            digests = list(ready)
            flags = repeated_starts([ready[d][0] for d in digests], np.array([ready[d][1] for d in digests]), length)
            spans = [covered(np.flatnonzero(f), length) for f in flags]
            keep = [i for i, s in enumerate(spans) if s]
            yield pd.DataFrame({"digest": [digests[i] for i in keep],
                                "spans": [[{"begin": b, "end": e} for b, e in spans[i]] for i in keep]})

        def close():
            nonlocal ready_size
            # a lone context of weight one whose anchor occurs once in it cannot repeat
            if len(group) > 1 or any(v[1] > 1 or v[2] for v in group.values()):
                ready.update(group)
                ready_size += sum(len(v[0]) for v in group.values())

        for frame in batches:
            for key, digest, context, weight, several in zip(frame["anchor"], frame["digest"], frame["bytes"], frame["weight"], frame["several"]):
                if key != anchor:
                    close()
                    anchor, group = key, {}
                    if ready_size > BATCH_BYTES:
                        yield from ordered()
                        ready.clear()
                        ready_size = 0
                digest = bytes(digest)
                if digest in group:
                    group[digest][1] += weight
                else:
                    group[digest] = [bytes(context), weight, several]
        close()
        if ready:
            yield from ordered()

    return run


def repeated_spans(docs: DataFrame, row_id: str = "doc_id", text: str = "text", length: int = 400) -> DataFrame:
    """(_ka, _kb, spans): for every row with repeated bytes, the byte ranges of its text that are repeated (may overlap)."""
    data = docs.select(*row_key(row_id, text), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_bytes"))
    long_rows = data.where(F.length("_bytes") >= length)
    anchors = stored(long_rows.mapInPandas(_find_anchors(length), "_ka long, _kb long, place int, anchor long"), "anchors")
    # written, so that the join has a plain exchange on either side and Spark can split an anchor that many places share
    counts = stored(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    known = (anchors.join(counts, "anchor").groupBy("_ka", "_kb")
             .agg(F.collect_set(F.struct("place", F.least("n", F.lit(2_000_000_000)).cast("int").alias("n"))).alias("anchors")))
    found = stored(long_rows.join(known, ["_ka", "_kb"]).mapInArrow(
        _find_contexts(length), "kind string, anchor long, digest binary, bytes binary, weight long, several boolean, "
        "_ka long, _kb long, start int"), "contexts", ["kind"])
    contexts = found.where("kind = 'context'").select("anchor", "digest", "bytes", "weight", "several")
    size = contexts.agg(F.sum(F.length("bytes"))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // CONTEXT_PARTITION))
    repeats = (contexts.repartition(int(parts), "anchor").sortWithinPartitions("anchor")
               .mapInPandas(_find_repeats(length), "digest binary, spans array<struct<begin:int,end:int>>"))
    return (found.where("kind = 'place'").select("digest", "_ka", "_kb", "start").join(repeats, "digest")
            .select("_ka", "_kb", F.transform("spans", lambda s: F.struct(
                (s["begin"] + F.col("start")).alias("begin"), (s["end"] + F.col("start")).alias("end"))).alias("spans"))
            .groupBy("_ka", "_kb").agg(F.flatten(F.collect_set("spans")).alias("spans")))


def merged(spans) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as maximal ones, in order."""
    out: list[list[int]] = []
    for b, e in sorted((int(s["begin"]), int(s["end"])) for s in spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


def _cut(as_text: bool):
    kind = pa.string() if as_text else pa.binary()
    ranges_kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, removed, ranges = [], [], [], []
            for data, spans in zip(batch.column("_bytes").to_pylist(), batch.column("spans").to_pylist()):
                cuts = merged(spans) if spans is not None else []
                at, parts = 0, []
                for b, e in cuts:
                    parts.append(data[at:b])
                    at = e
                parts.append(data[at:])
                left = b"".join(parts) if cuts else data
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
                sizes.append(len(data))
                removed.append(sum(e - b for b, e in cuts))
                ranges.append([{"begin": b, "end": e} for b, e in cuts])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(ranges, ranges_kind), pa.array(kept, kind)],
                names=["_row", "n_bytes", "n_removed", "removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, row_id: str = "doc_id", text: str = "text", length: int = 400,
                   carry: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """The rows of `docs` without the bytes that lie in a `length`-byte string which also starts anywhere else.

    Returns the columns `carry` (default: the id), n_bytes, n_removed, removed (maximal ranges of bytes) and kept (the
    bytes that remain). A range may begin or end within a character; with `as_text`, kept is a string without the parts of
    such characters. A null text counts as empty; texts shorter than `length`
    stay whole; equal rows count as different places and lose the same bytes; a null id is an id like any other; other
    columns, whatever their names, are not looked at. An empty table gives an empty table.
    """
    names = [row_id] if carry is None else carry
    data = docs.select(*row_key(row_id, text), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"),
                       F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_bytes"))
    spans = repeated_spans(docs, row_id, text, length)
    joined = data.join(spans, ["_ka", "_kb"], "left").select("_row", "_bytes", "spans")
    row = joined.schema["_row"].dataType.simpleString()
    out = joined.mapInArrow(_cut(as_text), f"_row {row}, n_bytes long, n_removed long, removed array<struct<begin:int,end:int>>, "
                            f"kept {'string' if as_text else 'binary'}")
    return out.select("_row.*", "n_bytes", "n_removed", "removed", "kept")
