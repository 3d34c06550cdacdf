"""Conversation prefix trie by adaptive radix trees over fixed-width turn ids.

A turn's id is the first 16 bytes of a digest of its role and text; a conversation's key is the sequence of its ids as bytes,
most significant first. Keys are put in order over all tasks, and each task builds an adaptive radix tree of its range: nodes
hold 4, 16, 48 or 256 children and grow as needed, and a chain of single children is one node with a compressed path.
Walking the tree, only depths that are multiples of 16 bytes become nodes of the trie.

A node may have members in several ranges. So that every measure is a plain sum over the ranges, each tree also holds the
last key of the range before and the first key of the range after, without members: a node counts as new where the key
before does not run through it, a leaf as a leaf where the key after does not end in it. Only nodes on the paths of those
two keys are merged with their other parts; all others are finished in their task.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.work import stored

WIDTH = 16  # bytes of a turn id
TURNS = 65_536  # turns that a range is meant to hold
ROOT = bytes(WIDTH)


def sequences(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, ids, sizes): the turns of every conversation in order, as ids in hexadecimal and UTF-8 sizes of their texts.

    Turns are ordered by `turn` (null first), equal ones by role and text; equal rows are turns of their own. Null roles and
    texts count as empty. Rows without a conversation take no part. Texts are not kept: a conversation is one row of some
    forty bytes a turn.
    """
    t = rows.where(F.col(conversation).isNotNull()).select(
        F.col(conversation).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    said = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")
    ids = t.select("conv_id", place.alias("place"), F.substring(F.sha2(said, 256), 1, 2 * WIDTH).alias("id"), F.octet_length("text").cast("long").alias("size"))
    turns = ids.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "id", "size"))).alias("turns"))
    return turns.select("conv_id", F.transform("turns", lambda x: x["id"]).alias("ids"), F.transform("turns", lambda x: x["size"]).alias("sizes"))


def rebuilt(talks: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Conversation c as the first h turns of conversation c - c % `group` and its own turns after its first h.

    h is crc32 of the decimal id modulo `most`. Of a shorter conversation all turns are taken, of one that is not there none.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    base = talks.select(F.col("conv_id").alias("base"), F.slice("ids", 1, most - 1).alias("base_ids"), F.slice("sizes", 1, most - 1).alias("base_sizes"))
    mine = talks.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(base, "base", "left")

    def joined(first: str, own: str):
        begin = F.coalesce(F.slice(first, F.lit(1), F.col("h")), F.slice(own, 1, 0))
        return F.concat(begin, F.slice(own, F.col("h") + 1, F.greatest(F.size(own) - F.col("h"), F.lit(0))))

    return mine.select("conv_id", joined("base_ids", "ids").alias("ids"), joined("base_sizes", "sizes").alias("sizes"))


# --- the tree ---------------------------------------------------------------------------------------------------

class Few:
    """Up to 4 or 16 children: their bytes in order, and the children beside them."""

    __slots__ = ("bytes", "kids", "room")

    def __init__(self, room: int = 4):
        self.bytes, self.kids, self.room = bytearray(), [], room

    def find(self, byte: int):
        at = self.bytes.find(byte)
        return None if at < 0 else self.kids[at]

    def add(self, byte: int, kid):
        """The layout that holds the new child too: this one, or a larger one."""
        if len(self.kids) == self.room:
            larger = Few(16) if self.room == 4 else Indexed()
            for b, k in self.items():
                larger = larger.add(b, k)
            return larger.add(byte, kid)
        at = bisect_left(self.bytes, byte)
        self.bytes.insert(at, byte)
        self.kids.insert(at, kid)
        return self

    def items(self):
        return zip(self.bytes, self.kids)


class Indexed:
    """Up to 48 children: 256 bytes say which of them a byte leads to, 0 for none."""

    __slots__ = ("index", "kids")

    def __init__(self):
        self.index, self.kids = bytearray(256), []

    def find(self, byte: int):
        at = self.index[byte]
        return self.kids[at - 1] if at else None

    def add(self, byte: int, kid):
        if len(self.kids) == 48:
            larger = Direct()
            for b, k in self.items():
                larger.kids[b] = k
            return larger.add(byte, kid)
        self.kids.append(kid)
        self.index[byte] = len(self.kids)
        return self

    def items(self):
        return ((b, self.kids[at - 1]) for b, at in enumerate(self.index) if at)


class Direct:
    """A place for each of the 256 bytes."""

    __slots__ = ("kids",)

    def __init__(self):
        self.kids = [None] * 256

    def find(self, byte: int):
        return self.kids[byte]

    def add(self, byte: int, kid):
        self.kids[byte] = kid
        return self

    def items(self):
        return ((b, k) for b, k in enumerate(self.kids) if k is not None)


class Node:
    """The bytes below the parent's branch that all keys here share, the children, and the number of the key that ends here."""

    __slots__ = ("path", "kids", "end", "before", "after")

    def __init__(self, path: bytes, kids=None, end: int = -1):
        self.path, self.kids, self.end, self.before, self.after = path, kids, end, False, False


class Tree:
    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, number: int) -> Node:
        """The node where the key ends; a key that is there already keeps its number."""
        node, at = self.root, 0
        while True:
            path = node.path
            if not key.startswith(path, at):
                same = next((i for i, (a, b) in enumerate(zip(path, key[at : at + len(path)])) if a != b), len(key) - at)
                lower = Node(path[same + 1 :], node.kids, node.end)
                node.path, node.kids, node.end = path[:same], Few().add(path[same], lower), -1
                path = node.path
            at += len(path)
            if at == len(key):
                if node.end < 0:
                    node.end = number
                return node
            kid = node.kids.find(key[at]) if node.kids is not None else None
            if kid is None:
                kid = Node(key[at + 1 :], end=number)
                node.kids = (node.kids or Few()).add(key[at], kid)
                return kid
            node, at = kid, at + 1

    def along(self, key: bytes) -> Iterator[Node]:
        """The nodes from the root to the end of a key that is in the tree."""
        node, at = self.root, 0
        while True:
            yield node
            at += len(node.path)
            if at == len(key):
                return
            node, at = node.kids.find(key[at]), at + 1

    def aligned(self) -> Iterator[tuple]:
        """(depth, number of the parent in this order, turn id, key that ends here, before, after), parents first.

        Depths are multiples of the width of an id; the root has no turn id.
        """
        count, waiting = 0, [(self.root, b"", 0, -1)]
        while waiting:
            node, begun, depth, parent = waiting.pop()
            path, at = begun + node.path, 0
            if node is self.root:
                yield 0, -1, b"", node.end if not path else -1, node.before, node.after
                parent, count = 0, 1
            while len(path) - at >= WIDTH:
                at += WIDTH
                depth += 1
                yield depth, parent, path[at - WIDTH : at], node.end if at == len(path) else -1, node.before, node.after
                parent, count = count, count + 1
            if node.kids is not None:
                rest = path[at:]
                waiting += [(kid, rest + bytes((byte,)), depth, parent) for byte, kid in node.kids.items()]


PARTIAL = ("part int, kind int, depth int, node binary, parent binary, conv long, parent_conv long, n long, children long, leaves long, "
           "saved long, open boolean, parent_open boolean")
_PARTIAL = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("depth", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()), ("conv", pa.int64()),
                      ("parent_conv", pa.int64()), ("n", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()),
                      ("open", pa.bool_()), ("parent_open", pa.bool_())])


def measured(keys: list[bytes], members: list[list[int]], sizes: dict[bytes, int], before: bytes | None, after: bytes | None) -> list[list]:
    """The columns of PARTIAL from `kind` on, for one range: kind 0 a node with members, kind 1 a member and where it ends.

    `keys` are distinct, `members` their conversations, `sizes` the bytes of a turn's text; `before` and `after` are the
    neighbouring ranges' nearest keys.
    """
    tree = Tree()
    for number, key in enumerate(keys):
        tree.insert(key, number)
    if before is not None:
        tree.insert(before, len(keys))  # a number without members, unless the key is in the range itself
    stops = tree.insert(after, len(keys) + 1).end if after is not None else None
    for key, mark in ((before, "before"), (after, "after")):
        if key is not None:
            for node in tree.along(key):
                setattr(node, mark, True)
    rows = list(tree.aligned())
    many = len(rows)
    names, n, least, children, leaves, saved, inner = [ROOT] * many, [0] * many, [None] * many, [0] * many, [0] * many, [0] * many, [False] * many
    out: list[list] = [[] for _ in range(12)]
    for r, (_, parent, turn, _, _, _) in enumerate(rows):
        if r:
            names[r] = hashlib.blake2b(names[parent] + turn, digest_size=WIDTH).digest()
    for r in range(many - 1, -1, -1):
        _, parent, turn, end, seen, ahead = rows[r]
        if 0 <= end < len(keys):
            n[r] += len(members[end])
            low = min(members[end])
            least[r] = low if least[r] is None else min(least[r], low)
        if n[r]:
            new = not seen
            leaves[r] += not inner[r] and (end < 0 or end != stops)
            saved[r] += (n[r] - new) * (sizes[turn] if r else 0)
            if r:
                n[parent] += n[r]
                least[parent] = least[r] if least[parent] is None else min(least[parent], least[r])
                children[parent] += new
                leaves[parent] += leaves[r]
                saved[parent] += saved[r]
        if r:
            inner[parent] = True
    for r, (depth, parent, _, end, seen, ahead) in enumerate(rows):
        if n[r]:
            up = rows[parent] if r else None
            for column, value in zip(out, (0, depth, names[r], names[parent] if r else None, least[r], least[parent] if r else None, n[r], children[r],
                                           leaves[r], saved[r], seen or ahead, bool(r) and (up[4] or up[5]))):
                column.append(value)
        if 0 <= end < len(keys):
            for conv in members[end]:
                for column, value in zip(out, (1, depth, names[r], None, conv, None, None, None, None, None, None, None)):
                    column.append(value)
    return out


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range and key; neighbours' keys are marked by `edge`."""
    part, keys, members, sizes, edges = None, [], [], {}, {}

    def finished() -> Iterator[pa.RecordBatch]:
        columns = measured(keys, members, sizes, edges.get(-1), edges.get(1))
        columns = [[part] * len(columns[0]), *columns]
        table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PARTIAL)], schema=_PARTIAL)
        yield from table.to_batches(max_chunksize=20_000)

    for batch in batches:
        for p, edge, key, conv, size in zip(*(batch.column(c).to_pylist() for c in ("part", "edge", "key", "conv_id", "sizes"))):
            if p != part:
                if keys:
                    yield from finished()
                part, keys, members, sizes, edges = p, [], [], {}, {}
            key = bytes.fromhex(key)
            if edge:
                edges[edge] = key
                continue
            if not keys or keys[-1] != key:
                keys.append(key)
                members.append([])
                for at, bytes_ in enumerate(size):
                    sizes[key[at * WIDTH : (at + 1) * WIDTH]] = bytes_
            members[-1].append(conv)
    if keys:
        yield from finished()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends_sha256) from rows sorted by node and conversation; nothing but the running digest is kept."""
    schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
    node, running = None, None
    for batch in batches:
        out = []
        for name, conv in zip(batch.column("node").to_pylist(), batch.column("conv").to_pylist()):
            if name != node:
                if node is not None:
                    out.append((node, running.hexdigest()))
                node, running = name, hashlib.sha256(str(conv).encode())
            else:
                running.update(b",%d" % conv)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([running.hexdigest()])], schema=schema)


def nodes(talks: DataFrame, turns: int = TURNS) -> DataFrame:
    """The nodes of the prefix trie over (conv_id, ids, sizes), one row for each distinct sequence of first turns.

    Columns: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves (nodes without
    children in the subtree), saved_tokens (over the subtree, members but one times bytes of the last text), ends_sha256
    (digest of the ids of members that end here, ascending, joined by commas). Conversations without turns end at the root.
    A table without conversations has no nodes. Ids must be distinct. `turns` bounds what a task's tree is meant to hold. The
    digest of a node where many conversations end is one task's stream: SHA-256 has no other order; it keeps no list.
    """
    spark = talks.sparkSession
    rows = stored(talks.select("conv_id", F.array_join("ids", "").alias("key"), "sizes"), "sequences")
    total, many = rows.agg(F.count("*"), F.sum(F.size("sizes"))).first()
    parts = int(max(1, -(-(total + (many or 0)) // turns)))
    placed = stored(rows.repartitionByRange(parts, "key", "conv_id").withColumn("part", F.spark_partition_id()), "ranges")
    edges = stored(placed.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last")), "edges")
    used = sorted(r["part"] for r in edges.select("part").collect())
    beside = spark.createDataFrame(list(zip(used, used[1:])) or [], "part int, after int")
    nothing = (F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("array<long>").alias("sizes"))
    last = edges.join(beside, "part").select(F.col("after").alias("part"), F.lit(-1).alias("edge"), F.col("last").alias("key"), *nothing)
    first = edges.join(beside.select(F.col("part").alias("before"), F.col("after").alias("part")), "part").select(
        F.col("before").alias("part"), F.lit(1).alias("edge"), F.col("first").alias("key"), *nothing)
    both = placed.select("part", F.lit(0).alias("edge"), "key", "conv_id", "sizes").unionByName(last).unionByName(first)
    partial = stored(both.repartition(parts, "part").sortWithinPartitions("part", "key", "conv_id").mapInArrow(_ranges, PARTIAL), "partial")

    found = partial.where("kind = 0")
    shared = found.where("open")
    # a node of several ranges keeps the last of them as its place: there its parent is shared too
    merged = stored(shared.groupBy("node").agg(
        F.max("part").alias("part"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.min("conv").alias("conv"), F.sum("n").alias("n"),
        F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("parent_open").alias("parent_open")), "merged")
    columns = ["part", "depth", "node", "parent", "conv", "n", "children", "leaves", "saved", "parent_open"]
    whole = found.where("not open").select(*columns, "parent_conv").unionByName(merged.select(*columns, F.lit(None).cast("long").alias("parent_conv")))
    # every range has its own row of a shared node, so the children of a frequent one are dealt by range
    places = shared.select("part", "node").join(merged.select("node", F.col("conv").alias("shared_conv")), "node")
    known = whole.join(places.select("part", F.col("node").alias("parent"), "shared_conv"), ["part", "parent"], "left")
    ends = partial.where("kind = 1").select("node", "conv").repartition("node").sortWithinPartitions("node", "conv").mapInArrow(_digests, "node binary, ends_sha256 string")
    out = known.join(ends, "node", "left")
    return out.select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long"), F.coalesce("shared_conv", "parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
