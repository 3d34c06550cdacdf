"""Sharding by histogram sort: exact byte counts below probed keys, refined until the splitters fit; then one exchange.

The key of a row puts equal texts side by side: its upper 38 bits are a hash of the text, its lower 24 bits a hash of the
row and of its number among equal rows. A group of copies of any size can therefore be split, between its rows. In each round every splitter that has not
met the tolerance has an interval of keys that holds it; evenly spaced probes cut the intervals, one aggregate counts the
bytes in each piece over all rows, and the piece around the wanted count becomes the next interval. A round brings a few
thousand counts to the driver whatever the size of the data. A splitter is done when a border of its interval misses the
wanted count by no more than the tolerance, or when a single key is left.

Everything is built-in expressions. Keys are found in a sorted array of borders by a binary search inside `aggregate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.work import stored, with_ordinal

KEY_BITS = 62
PROBES = 4096  # in a round, over all intervals
PART_ROWS = 4_000  # rows that one sorting task is planned for
MOST_PARTS = 4_096
TOLERANCE = 1e-3  # of a shard's bytes


def shard_key(group: Column, row: Column, ordinal: Column) -> Column:
    """From the hashes of a row's text and of the whole row, and the row's number among equal ones."""
    upper = F.shiftleft(F.shiftrightunsigned(group, 64 - (KEY_BITS - 24)), 24)
    return upper.bitwiseOR(F.shiftrightunsigned(F.when(ordinal == 0, row).otherwise(F.xxhash64(row, ordinal)), 40))


def place_among(key: Column, borders: list[int]) -> Column:
    """How many of the sorted borders are at or below the key."""
    if not borders:
        return F.lit(0)
    array = F.lit(borders).cast("array<long>")
    steps = F.lit([1 << i for i in reversed(range(len(borders).bit_length()))]).cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(
        (at + s <= len(borders)) & (F.coalesce(F.get(array, at + s - 1), F.lit(0)) <= key), at + s).otherwise(at))


def find_splitters(rows: DataFrame, wanted: list[float], tolerance: float, probes: int = PROBES) -> list[int]:
    """For each wanted count (ascending), a key below which the rows (key, size) have about so many bytes."""
    whole = (0, 1 << KEY_BITS, 0.0)
    intervals = {i: whole for i in range(len(wanted))}
    found: dict[int, int] = {}
    while intervals:
        apart = sorted(set(intervals.values()))
        each = max(2, probes // len(apart))
        steps = [max(1, -(-(hi - lo) // each)) for lo, hi, _ in apart]
        # disjoint intervals: one lies at or below a key last
        at = place_among(F.col("key"), [lo for lo, _, _ in apart]) - 1
        take = lambda values: F.get(F.lit(values).cast("array<long>"), F.col("i"))
        pieces = (rows.select("key", "size", at.alias("i")).where("i >= 0").where(F.col("key") < take([hi for _, hi, _ in apart]))
                  .select("i", "size", (F.col("key") - take([lo for lo, _, _ in apart])).alias("past"), take(steps).alias("step"))
                  .select("i", "size", F.expr("past div step").alias("piece"))
                  .groupBy("i", "piece").agg(F.sum("size").alias("size")).collect())
        counts: list[dict[int, int]] = [{} for _ in apart]
        for r in pieces:
            counts[r["i"]][r["piece"]] = r["size"]
        following = {}
        for s, interval in intervals.items():
            i = apart.index(interval)
            lo, hi, below = interval
            # the last border at or below the wanted count, and the next one
            cut, above = lo, below
            end = hi
            for piece in sorted(counts[i]):
                if above + counts[i][piece] > wanted[s]:
                    cut, end = lo + piece * steps[i], min(hi, lo + (piece + 1) * steps[i])
                    over = above + counts[i][piece]
                    break
                above += counts[i][piece]
            else:
                found[s] = hi
                continue
            if wanted[s] - above <= tolerance or over - wanted[s] <= tolerance or end - cut <= 1:
                found[s] = cut if wanted[s] - above <= over - wanted[s] else end
            else:
                following[s] = (cut, end, above)
        intervals = following
    return [found[i] for i in range(len(wanted))]


def into_shards(docs: DataFrame, shards: int = 24, row_id: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE,
                carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` (default: the id) with size, text_crc32, shard and slot; shards have nearly equal bytes.

    Size is the text's bytes and 8 (a null text has none). Slots number a shard's rows from 0 in order of key, so equal texts
    stand side by side, split at most where a shard ends. Rows equal in id and text have one key and stay together in one
    shard. A null id is an id. An empty table gives no rows.
    """
    names = [row_id] if carry is None else carry
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    t, i = F.col(text), F.col(row_id)
    read = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.monotonically_increasing_id().alias("uid"),
                              F.xxhash64(t, t.isNull()).alias("group"), F.xxhash64(F.lit(1), i, i.isNull(), t, t.isNull()).alias("row"),
                              (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32")), "shard-texts")
    rows = stored(with_ordinal(read, ["group", "row"]).select("_row", shard_key(F.col("group"), F.col("row"), F.col("_ord")).alias("key"), "size", "text_crc32"), "shard-rows")
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    per_shard = max(1, min(MOST_PARTS // shards, -(-n // (shards * PART_ROWS))))
    parts = shards * per_shard
    wanted = [total * i / parts for i in range(1, parts)]
    splitters = find_splitters(rows, wanted, tolerance * total / shards)
    placed = rows.withColumn("part", place_among(F.col("key"), splitters))
    counts = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    offsets, at = [], 0
    for part in range(parts):
        at = 0 if part % per_shard == 0 else at
        offsets.append(at)
        at += counts.get(part, 0)
    order = F.row_number().over(Window.partitionBy("part").orderBy("key", "text_crc32", "size"))
    slot = order - 1 + F.get(F.lit(offsets).cast("array<long>"), F.col("part"))
    return placed.select("_row.*", "size", "text_crc32", F.floor(F.col("part") / per_shard).cast("int").alias("shard"), slot.cast("long").alias("slot"))
