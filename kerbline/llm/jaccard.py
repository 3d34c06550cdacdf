"""N-gram Jaccard self-join by prefixes under several global token orders.

Two sets with similarity 0.8 or more share tokens in their prefixes under *any* order of all tokens. The job has four steps:

1. *Survivors.* Under the first order (by hash) a set looks at its first n - ceil(0.8 n) + k tokens, k = n/10. A partner
   shares about k of them, and has them in its own prefix. Tokens are counted over all prefixes, and a document whose
   prefix holds too few repeated tokens leaves the join: most do, also those that merely share a passage.
2. *Orders.* Survivors with equal sets become one class. Over the classes, every token's frequency is counted; the orders
   put rare tokens first and differ in how equally frequent ones are arranged. A token is in the prefix of a class under
   none, some or all of them.
3. *Clusters.* Classes that share a prefix token under the first order are one cluster (a star around the smallest class
   of each token, so a token in any number of classes costs one edge for each).
4. *Candidates and verification.* Clusters are cut into blocks of about BLOCK classes, and blocks meet in pairs. Inside a
   pair of blocks, candidates are the pairs of classes that share prefix tokens under every order; only they are verified,
   with exact counts. Of the links found, a pair of blocks returns a spanning forest and, where links are counted, each
   class's number of linked rows, never all pairs.
   To count links, a class goes to every block with a class that shares a prefix token, so each link is seen once. Where
   only components are asked for, large clusters first meet along the chain of their blocks; blocks that turn out to lie
   in one component do not meet again.

Tokens travel as packed arrays by bucket: each task sends a token once with its count, so frequent tokens cost one entry a
task. Nothing is capped: what does not fit one block meets in more pairs of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.shingles import mix, shingle_sets
from kerbline.llm.work import WORD, components, row_key, stored

BLOCK = 512  # classes
BATCH_TOKENS = 500_000  # whose counts a map task sends at a time
BUCKET_TOKENS = 500_000  # that one counting task is planned for
ORDERS = 3
ROWS = 256  # texts that a map task takes out of a batch at a time
SPREAD = 32  # tokens in more sets of a block than this are counted by matrix products, others by lists


def least_overlap(n: np.ndarray | int, percent: int = 80):
    """ceil(n * percent / 100): so many tokens of a set of n are in any set that links with it."""
    return -(-n * percent // 100)


def _planes(a: np.ndarray) -> bytes:
    """The bytes of an array, first bytes first, so that equal high bytes compress."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def pack(*arrays: np.ndarray) -> bytes:
    return b"".join(_planes(a) for a in arrays)


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    n = len(data) // sum(sizes)
    out, at = [], 0
    for kind, size in zip(kinds, sizes):
        plane = np.frombuffer(data, dtype=np.uint8, count=n * size, offset=at).reshape(size, n)
        out.append(np.ascontiguousarray(plane.T).reshape(-1).view(kind))
        at += n * size
    return out


def _short(tokens: np.ndarray) -> bytes:
    """48-bit tokens in six bytes each, packed."""
    return np.ascontiguousarray(tokens.view(np.uint8).reshape(len(tokens), 8)[:, :6].T).tobytes()


def _short_with(data: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """48-bit tokens and the array packed behind them."""
    n = len(data) // (6 + np.dtype(kind).itemsize)
    tokens = np.zeros((n, 8), dtype=np.uint8)
    tokens[:, :6] = np.frombuffer(data, dtype=np.uint8, count=6 * n).reshape(6, n).T
    return tokens.view("<u8")[:, 0], unpack(data[6 * n :], kind)[0]


def _by_bucket(tokens: np.ndarray, buckets: int, bits: int = 64) -> Iterator[tuple[int, slice]]:
    """Slices of ascending tokens by bucket; a bucket is a range of tokens."""
    width = (1 << bits) // buckets + 1
    edges = np.searchsorted(tokens, np.array([i * width for i in range(1, buckets)], dtype=np.uint64))
    edges = [0, *edges.tolist(), len(tokens)]
    for b in range(buckets):
        if edges[b] < edges[b + 1]:
            yield b, slice(edges[b], edges[b + 1])


def _name(s: np.ndarray) -> int:
    """A set's class: 64 bits of a digest."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


FIRST = "kind string, block long, idx int, _ka long, _kb long, n int, c long, have int, bucket int, payload binary"
FIRST_ARROW = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("idx", pa.int32()), ("_ka", pa.int64()), ("_kb", pa.int64()),
                         ("n", pa.int32()), ("c", pa.int64()), ("have", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])


def _batch(schema: pa.Schema, rows: int, **columns) -> pa.RecordBatch:
    arrays = []
    for field in schema:
        value = columns.get(field.name)
        if value is None:
            arrays.append(pa.nulls(rows, field.type))
        elif isinstance(value, (str, int)):
            arrays.append(pa.array([value] * rows, field.type))
        else:
            arrays.append(pa.array(value, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _counted(owner: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct tokens, their counts, some owner of each, and for each entry the place of its token."""
    to = np.argsort(tokens, kind="stable")
    arranged = tokens[to]
    fresh = np.append(True, arranged[1:] != arranged[:-1]) if len(arranged) else np.zeros(0, dtype=bool)
    begin = np.flatnonzero(fresh)
    counts = np.diff(np.append(begin, len(arranged)))
    place = np.empty(len(tokens), dtype=np.int64)
    place[to] = np.cumsum(fresh) - 1
    return arranged[begin], counts, owner[to[begin]], place


def _prefix_counts(buckets: int, width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        held: list[tuple] = []  # (ka, kb, n, class, prefix)
        waiting = 0

        def release():
            nonlocal block
            owner = np.repeat(np.arange(len(held)), [len(h[4]) for h in held])
            # 48 bits do here: tokens that fall together only let a document stay that could have left
            tokens = np.concatenate([h[4] for h in held]) >> np.uint64(16)
            distinct, counts, some, place = _counted(owner, tokens)
            have = np.bincount(owner, weights=counts[place] > 1, minlength=len(held)).astype(np.int64)
            yield _batch(FIRST_ARROW, len(held), kind="doc", block=block, idx=np.arange(len(held)), _ka=[h[0] for h in held],
                         _kb=[h[1] for h in held], n=[h[2] for h in held], c=[h[3] for h in held], have=have)
            # a token that this block repeats needs no answer: its owner is left open
            who = np.where(counts > 1, 0xFFFFFFFF, some).astype(np.uint32)
            asks = [(b, _short(distinct[s]) + pack(who[s])) for b, s in _by_bucket(distinct, buckets, 48)]
            yield _batch(FIRST_ARROW, len(asks), kind="ask", block=block, bucket=[a[0] for a in asks], payload=[a[1] for a in asks])
            block += 1
            held.clear()

        for batch in _slices(batches):
            texts = [t.encode() for t in batch.column("_text").to_pylist()]
            for ka, kb, s in zip(batch.column("_ka").to_pylist(), batch.column("_kb").to_pylist(), shingle_sets(texts, width)):
                n = len(s)
                prefix = s[: min(n, n - least_overlap(n, percent) + max(1, n // 10))].copy()
                held.append((ka, kb, n, _name(s), prefix))
                waiting += len(prefix)
                if waiting > BATCH_TOKENS:
                    yield from release()
                    waiting = 0
        if held:
            yield from release()

    return run


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Runs of rows with one key, from batches in order of the key."""
    now, rows = None, []
    for batch in batches:
        for row in (r for at in range(0, batch.num_rows, 64) for r in batch.slice(at, 64).to_pylist()):
            if row[key] != now and rows:
                yield now, rows
                rows = []
            now = row[key]
            rows.append(row)
    if rows:
        yield now, rows


def _answer_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Back to each block, packed: how many tokens of its documents occur in other blocks (and not twice in their own)."""
    schema = pa.schema([("block", pa.int64()), ("payload", pa.binary())])
    for _, rows in _grouped(batches, "bucket"):
        parts = [_short_with(r["payload"], "<u4") for r in rows]
        _, counts, _, place = _counted(np.zeros(sum(len(p[0]) for p in parts), dtype=np.int8), np.concatenate([p[0] for p in parts]))
        again = counts[place] > 1
        out, at = [], 0
        for r, p in zip(rows, parts):
            who = p[1][again[at : at + len(p[1])]]
            at += len(p[1])
            who, n = np.unique(who[who != 0xFFFFFFFF], return_counts=True)
            if len(who):
                out.append((r["block"], pack(who, n.astype(np.uint32))))
        yield _batch(schema, len(out), block=[o[0] for o in out], payload=[o[1] for o in out])


def _sum_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The answers of all buckets to a block, added up by document."""
    schema = pa.schema([("block", pa.int64()), ("idx", pa.int32()), ("more", pa.int32())])
    for block, rows in _grouped(batches, "block"):
        parts = [unpack(r["payload"], "<u4", "<u4") for r in rows]
        total = np.bincount(np.concatenate([p[0] for p in parts]), weights=np.concatenate([p[1] for p in parts]))
        some = np.flatnonzero(total)
        yield _batch(schema, len(some), block=block, idx=some.astype(np.int32), more=total[some].astype(np.int32))


SECOND = "kind string, block long, c long, n int, bucket int, payload binary"
SECOND_ARROW = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("c", pa.int64()), ("n", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])


def _class_counts(buckets: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        held: list[tuple[int, np.ndarray]] = []
        waiting = 0

        def release():
            nonlocal block
            tokens = np.concatenate([s for _, s in held])
            distinct, counts, _, _ = _counted(np.zeros(len(tokens), dtype=np.int8), tokens)
            yield _batch(SECOND_ARROW, len(held), kind="set", block=block, c=[c for c, _ in held], n=[len(s) for _, s in held],
                         payload=[s.tobytes() for _, s in held])
            asks = [(b, pack(distinct[s], counts[s].astype(np.uint32))) for b, s in _by_bucket(distinct, buckets)]
            yield _batch(SECOND_ARROW, len(asks), kind="ask", block=block, bucket=[a[0] for a in asks], payload=[a[1] for a in asks])
            block += 1
            held.clear()

        for batch in _slices(batches):
            texts = [t.encode() for t in batch.column("_text").to_pylist()]
            for c, s in zip(batch.column("c").to_pylist(), shingle_sets(texts, width)):
                held.append((c, s))
                waiting += len(s)
                if waiting > BATCH_TOKENS:
                    yield from release()
                    waiting = 0
        if held:
            yield from release()

    return run


def _answer_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Back to each block: its tokens that occur in more than one class, with their frequency."""
    for _, rows in _grouped(batches, "bucket"):
        parts = [unpack(r["payload"], "<u8", "<u4") for r in rows]
        tokens = np.concatenate([p[0] for p in parts])
        distinct, _, _, place = _counted(np.zeros(len(tokens), dtype=np.int8), tokens)
        total = np.bincount(place, weights=np.concatenate([p[1] for p in parts]).astype(np.float64), minlength=len(distinct))[place]
        total = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
        out, at = [], 0
        for r, p in zip(rows, parts):
            f = total[at : at + len(p[0])]
            at += len(p[0])
            if (f > 1).any():
                out.append((r["block"], pack(p[0][f > 1], f[f > 1])))
        if out:
            yield _batch(SECOND_ARROW, len(out), kind="frequency", block=[o[0] for o in out], payload=[o[1] for o in out])


THIRD = "kind string, token long, c long, n int, tokens binary"
THIRD_ARROW = pa.schema([("kind", pa.string()), ("token", pa.int64()), ("c", pa.int64()), ("n", pa.int32()), ("tokens", pa.binary())])


def _prefixes(percent: int, orders: int):
    """Per class, its repeated tokens with the orders whose prefix holds them; and the prefix tokens of the first order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, "block"):
            known = [unpack(r["payload"], "<u8", "<u4") for r in rows if r["kind"] == "frequency"]
            if not known:
                continue
            token = np.concatenate([k[0] for k in known])
            to = np.argsort(token)
            token, frequency = token[to], np.concatenate([k[1] for k in known])[to]
            classes, post_token, post_class, post_n = [], [], [], []
            for r in rows:
                if r["kind"] != "set":
                    continue
                s = np.frombuffer(r["payload"], dtype=np.uint64)
                at = np.minimum(np.searchsorted(token, s), len(token) - 1)
                f = np.where(token[at] == s, frequency[at], 1)
                flags = np.zeros(len(s), dtype=np.uint8)
                length = r["n"] - int(least_overlap(r["n"], percent)) + 1
                for k in range(orders):
                    arranged = np.lexsort((s if k == 0 else mix(s + np.uint64(k)), f))
                    flags[arranged[:length]] |= 1 << k
                again = f > 1
                if least_overlap(r["n"], percent) > again.sum():
                    continue  # too few tokens that any other class has
                classes.append((r["c"], r["n"], pack(s[again], flags[again])))
                first = s[again & (flags & 1 > 0)]
                post_token.append(first)
                post_class.append(np.full(len(first), r["c"]))
                post_n.append(np.full(len(first), r["n"]))
            if classes:
                yield _batch(THIRD_ARROW, len(classes), kind="class", c=[x[0] for x in classes], n=[x[1] for x in classes], tokens=[x[2] for x in classes])
                t = np.concatenate(post_token)
                yield _batch(THIRD_ARROW, len(t), kind="post", token=t.view(np.int64), c=np.concatenate(post_class), n=np.concatenate(post_n))

    return run


def overlaps(token: np.ndarray, owner: np.ndarray, m: int) -> np.ndarray:
    """m x m counts of common tokens, for (token, owner) entries."""
    out = np.zeros((m, m), dtype=np.float32)
    to = np.lexsort((owner, token))
    token, owner = token[to], owner[to].astype(np.int64)
    fresh = np.append(True, token[1:] != token[:-1])
    begin = np.flatnonzero(fresh)
    size = np.diff(np.append(begin, len(token)))
    group = np.cumsum(fresh) - 1
    often = size > SPREAD
    wide = often[group]
    if wide.any():
        column = (np.cumsum(often) - 1)[group[wide]]
        row = owner[wide]
        for low in range(0, int(column[-1]) + 1, 4096):
            some = (column >= low) & (column < low + 4096)
            held = np.zeros((m, int(column[some][-1]) - low + 1), dtype=np.float32)
            held[row[some], column[some] - low] = 1
            out += held @ held.T
    group, owner = group[~wide], owner[~wide]
    flat = np.zeros(m * m, dtype=np.int64)
    for shift in range(1, SPREAD):
        if shift >= len(group):
            break
        same = group[shift:] == group[:-shift]
        if not same.any():
            break
        flat += np.bincount(owner[:-shift][same] * m + owner[shift:][same], minlength=m * m)
    upper = flat.reshape(m, m)
    out += upper + upper.T
    return out


def links_of(sets: list[tuple[int, bytes]], side: np.ndarray, percent: int, orders: int) -> np.ndarray:
    """Matrix of links between sets (size, packed tokens and flags); where two sides meet, only across."""
    m = len(sets)
    parts = [unpack(t, "<u8", "u1") for _, t in sets]
    owner = np.repeat(np.arange(m), [len(p[0]) for p in parts])
    token, flags = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    n = np.array([s for s, _ in sets], dtype=np.int64)
    wanted = np.minimum.outer(n, n) * 100 >= np.maximum.outer(n, n) * percent
    np.fill_diagonal(wanted, False)
    if side.any() and not side.all():
        wanted &= side[:, None] != side[None, :]
    for k in range(orders):
        inside = (flags >> k & 1) > 0
        if not wanted.any():
            return wanted
        wanted &= overlaps(token[inside], owner[inside], m) > 0
    if not wanted.any():
        return wanted
    some = wanted.any(axis=1)
    at = some[owner]
    common = overlaps(token[at], owner[at], m)
    return wanted & (100 * common >= percent * (n[:, None] + n[None, :] - common))


def forest(links: np.ndarray, names: list[int]) -> list[tuple[int, int]]:
    """Edges that connect what the links connect."""
    edges = []
    left = links.any(axis=1)
    while left.any():
        root = int(np.flatnonzero(left)[0])
        left[root] = False
        reached = [root]
        while reached:
            at = reached.pop()
            new = np.flatnonzero(links[at] & left)
            left[new] = False
            edges += [(names[at], names[j]) for j in new.tolist()]
            reached += new.tolist()
    return edges


def _meet(percent: int, orders: int):
    """Edges (a, b) of a forest; with b null, the rows that a class `a` links with here, by the weights w if there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
        edges: list[tuple[int, int]] = []
        counts: list[tuple[int, int]] = []
        for _, rows in _grouped(batches, "meeting"):
            rows = list({(r["c"], r["second"]): r for r in rows}.values())
            found = links_of([(r["n"], r["tokens"]) for r in rows], np.array([r["second"] for r in rows]), percent, orders)
            edges += forest(found, [r["c"] for r in rows])
            if rows[0]["w"] is not None:
                linked = found @ np.array([r["w"] for r in rows], dtype=np.int64)
                counts += [(rows[i]["c"], int(linked[i])) for i in np.flatnonzero(linked).tolist()]
        yield _batch(schema, len(edges), a=[e[0] for e in edges], b=[e[1] for e in edges])
        yield _batch(schema, len(counts), a=[c[0] for c in counts], links=[c[1] for c in counts])

    return run


def _meetings(members: DataFrame, classes: DataFrame, pairs: Column, percent: int, orders: int, weight: int) -> DataFrame:
    """Links of the block pairs that each member goes to: `pairs` is an array of (meeting, second)."""
    go = members.select("c", F.explode(pairs).alias("p")).select("c", F.xxhash64("p.meeting").alias("meeting"), F.col("p.second").alias("second"))
    parts = max(members.sparkSession.sparkContext.defaultParallelism, -(-weight // 2_000))
    full = go.join(classes, "c").repartition(int(parts), "meeting").sortWithinPartitions("meeting")
    return stored(full.select("meeting", "second", "c", "n", "w", "tokens").mapInArrow(_meet(percent, orders), "a long, b long, links long"), "links")


def linked_classes(docs: DataFrame, row_id: str, text: str, width: int, percent: int, orders: int,
                   counted: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows: _ka, _kb, n, c for each document; roots: node, root for classes that link).

    `counted`: roots also holds classes of several rows (root null if they link with no other), and n_links: how many other
    rows each row of the class links with, those of its own class included.
    """
    spark = docs.sparkSession
    data = docs.select(*row_key(row_id, text), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = int(max(1, -(-size // 20 // BUCKET_TOKENS)))  # a word takes six bytes or so, a prefix three tenths of the words
    first = stored(data.mapInArrow(_prefix_counts(buckets, width, percent), FIRST), "prefixes", ["kind"])
    rows = first.where("kind = 'doc'").select("block", "idx", "_ka", "_kb", "n", "c", "have")
    answers = (first.where("kind = 'ask'").select("bucket", "block", "payload").repartition(buckets, "bucket").sortWithinPartitions("bucket")
               .mapInArrow(_answer_documents, "block long, payload binary").repartition("block").sortWithinPartitions("block")
               .mapInArrow(_sum_answers, "block long, idx int, more int"))
    need = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100.0) / 10))
    survivors = (rows.where("n > 0").join(answers, ["block", "idx"], "left")
                 .where(F.col("have") + F.coalesce("more", F.lit(0)) >= need).groupBy("c").agg(F.min(F.struct("_ka", "_kb")).alias("k")))
    texts = (data.join(survivors.select("c", "k.*"), ["_ka", "_kb"]).select("c", "_text"))
    second = stored(texts.mapInArrow(_class_counts(buckets, width), SECOND), "classes", ["kind"])
    sets = second.where("kind = 'set'").select("kind", "block", "c", "n", "bucket", "payload")
    frequencies = (second.where("kind = 'ask'").select("bucket", "block", "payload").repartition(buckets, "bucket").sortWithinPartitions("bucket")
                   .mapInArrow(_answer_frequencies, SECOND))
    third = stored(sets.unionByName(frequencies).repartition("block").sortWithinPartitions("block")
                   .mapInArrow(_prefixes(percent, orders), THIRD), "orders", ["kind"])
    classes = third.where("kind = 'class'").select("c", "n", "tokens").dropDuplicates(["c"])
    posts = third.where("kind = 'post'").select("token", "c")
    # a star around the smallest class of each token; written, so that Spark can split a token that many classes share
    centers = stored(posts.groupBy("token").agg(F.min("c").alias("center"), F.max("c").alias("_last")).where("center < _last").drop("_last"), "centers")
    stars = posts.join(centers, "token")
    clusters = stored(components(stars.select("c", "center"), "c", "center"), "clusters")
    sizes = clusters.groupBy("root").agg(F.count("*").alias("of"))
    members = stored(clusters.join(sizes, "root").select(
        F.col("node").alias("c"), "root", F.ceil(F.col("of") / BLOCK).cast("int").alias("blocks")).withColumn(
        "block", F.pmod(F.xxhash64(F.lit(21), "c"), F.col("blocks")).cast("int")), "members")
    weight = members.count()
    # a member of block i meets its own block and, in larger clusters, the one before and the one after
    meet = lambda i, j, second: F.struct(F.struct(F.col("root"), i.alias("i"), j.alias("j")).alias("meeting"), (second if isinstance(second, Column) else F.lit(second)).alias("second"))
    b = F.col("block")
    chain = F.when(F.col("blocks") == 1, F.array(meet(b, b, False))).otherwise(F.array(
        meet(b, b, False), meet(b, b + 1, False), meet(b - 1, b, True)))
    if counted:
        several = stored(rows.where("n > 0").groupBy("c").agg(F.count("*").alias("w")).where("w > 1"), "several")
        weighed = classes.join(several, "c", "left").withColumn("w", F.coalesce("w", F.lit(1).cast("long")))
        # a class of a larger cluster meets each block that holds one of its prefix tokens; its partner there comes as well
        held = stored(posts.join(members.where("blocks > 1"), "c").select("token", "c", "root", "block"), "held")
        holders = stored(held.select("token", F.col("block").alias("other")).distinct(), "holders")
        visits = held.join(holders, "token").select("c", "root", "block", "other").distinct()
        travel = stored(visits.select("c", F.array(meet(F.least(b, "other"), F.greatest(b, "other"), b > F.col("other"))).alias("pairs")).unionByName(
            members.where("blocks = 1").select("c", F.array(meet(b, b, False)).alias("pairs"))), "travel")
        links = _meetings(travel, weighed, F.col("pairs"), percent, orders, travel.count())
        numbers = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        more = several.select(F.col("c").alias("node"), (F.col("w") - 1).alias("same"))
        return rows, stored(components(links.where("b is not null")).join(numbers, "node", "full").join(more, "node", "full").select(
            "node", "root", (F.coalesce("links", F.lit(0)) + F.coalesce("same", F.lit(0))).alias("n_links")), "roots")
    classes = classes.withColumn("w", F.lit(None).cast("long"))
    links = _meetings(members, classes, chain, percent, orders, 3 * weight)
    large = members.where("blocks > 2")
    if large.isEmpty():
        return rows, components(links)
    # after the chain: members of one component that fill blocks of their own stay among themselves
    near = stored(components(links), "near").select(F.col("node").alias("c"), F.col("root").alias("part"))
    placed = large.drop("block", "blocks").join(near, "c", "left").withColumn("part", F.coalesce("part", "c"))
    counts = placed.groupBy("root", "part").agg(F.count("*").alias("of"))
    own = F.col("of") >= BLOCK
    counts = counts.withColumn("group", F.when(own, F.col("part"))).groupBy("root", "group").agg(
        F.sum("of").alias("of"), F.collect_set(F.when(~own, F.col("part"))).alias("_few")).drop("_few")
    joined = placed.join(placed.groupBy("root", "part").agg(F.count("*").alias("size")), ["root", "part"]).withColumn(
        "group", F.when(F.col("size") >= BLOCK, F.col("part")))
    again = joined.join(counts.select(F.col("root").alias("r2"), F.col("group").alias("g2"), F.ceil(F.col("of") / BLOCK).cast("int").alias("blocks")),
                        (F.col("root") == F.col("r2")) & F.col("group").eqNullSafe(F.col("g2")))
    again = stored(again.withColumn("block", F.xxhash64("root", F.coalesce("group", F.lit(0)), F.pmod(F.xxhash64(F.lit(22), "c"), F.col("blocks")))).select(
        "c", "root", "group", "block"), "again")
    blocks = again.select("root", "group", "block").distinct()
    other = blocks.select("root", F.col("group").alias("g2"), F.col("block").alias("b2"))
    pairs = blocks.join(other, "root").where((F.col("block") <= F.col("b2")) & ~F.coalesce(F.col("group") == F.col("g2"), F.lit(False)))
    goes = pairs.select("block", F.col("block").alias("i"), F.col("b2").alias("j"), F.lit(False).alias("second")).unionByName(
        pairs.where("block <> b2").select(F.col("b2").alias("block"), F.col("block").alias("i"), F.col("b2").alias("j"), F.lit(True).alias("second")))
    travel = again.join(goes, "block").select("c", F.array(F.struct(F.struct("i", "j").alias("meeting"), "second")).alias("pairs"))
    travel = stored(travel, "travel")
    rest = _meetings(travel, classes, F.col("pairs"), percent, orders, travel.count())
    return rows, components(links.unionByName(rest))


def near_duplicates(docs: DataFrame, row_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80,
                    orders: int = ORDERS, carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` (default: the id) with n_shingles, class_id (rows with equal sets share it), component_id and n_links.

    A set holds the distinct shingles of `width` words (A-Z lower-cased; words are runs of anything but ASCII white space);
    fewer words make one shingle. Sets link when 100 * intersection >= percent * union. component_id is the smallest id of
    the rows that links reach, n_links the number of other rows that a row links with. A text that is null or has no words has no shingles, no class and links with nothing.
    Equal rows are rows of one class. A null id takes part; component_id is null only where all reachable ids are. An
    empty table gives no rows. Other columns are not looked at.
    """
    names = [row_id] if carry is None else carry
    rows, roots = linked_classes(docs, row_id, text, width, percent, orders, counted=True)
    sets = rows.select("_ka", "_kb", "n", "c").dropDuplicates(["_ka", "_kb"])
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(row_id).alias("_id"), *row_key(row_id, text))
    known = (base.join(sets, ["_ka", "_kb"]).join(roots.select(F.col("node").alias("c"), "root", "n_links"), "c", "left")
             .select("_row", "_id", "n", "c", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n") > 0, F.coalesce("root", "c")).alias("root")))
    known = stored(known, "rows")
    least = stored(known.where("n > 0").groupBy("root").agg(F.min("_id").alias("least")), "least")
    out = known.join(least, "root", "left")
    return out.select("_row.*", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("c")).alias("class_id"),
                      F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("_id")).alias("component_id"), "n_links")


def representatives(docs: DataFrame, row_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80,
                    orders: int = ORDERS) -> DataFrame:
    """`docs` with one row of every component: the one of the smallest id (null last; of equal ids one by hash).

    Rows without words link with nothing and all stay. Of equal rows one stays.
    """
    rows, roots = linked_classes(docs, row_id, text, width, percent, orders)
    sets = rows.where("n > 0").select("_ka", "_kb", "c").dropDuplicates(["_ka", "_kb"])
    ids = docs.select(F.col(row_id).alias("_id"), *row_key(row_id, text))
    chosen = (ids.join(sets, ["_ka", "_kb"]).join(roots.select(F.col("node").alias("c"), "root"), "c", "left")
              .groupBy(F.coalesce("root", "c").alias("_root"))
              .agg(F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), "_ka", "_kb")).alias("k")).select("k._ka", "k._kb"))
    worded = F.coalesce(F.col(text).rlike(WORD), F.lit(False))
    first = docs.where(worded).withColumns(dict(zip(("_ka", "_kb"), row_key(row_id, text)))).join(stored(chosen, "chosen"), ["_ka", "_kb"], "left_semi")
    return first.dropDuplicates(["_ka", "_kb"]).drop("_ka", "_kb").unionByName(docs.where(~worded))
