"""Exact top-k search by inner product over a forest of M-trees.

Components become integers floor(scale * x). For vectors of norm at most R, appending sqrt(R² - |x|²) to a vector and 0 to a
query turns the largest inner product into the smallest Euclidean distance, which is a metric: |q - x|² = |q|² + R² - 2 q·x.

Spark deals the vectors to their nearest seed (seeds are a bounded draw), and to several trees where a seed has many. Equal
vectors score alike, so of each group of equal ones only the k + 1 smallest ids can be among the first k of another row; the
others are left out by a rank that is cut before the shuffle. Each tree is loaded bottom-up into pages: a leaf page holds
vectors with their distance to the page's routing vector, an inner page holds routing vectors with covering radius, distance
to their own parent and number of the page below. Every leaf has the same depth. Pages are rows of a written table.

A query looks for its first k in the trees of its nearest seed, and then in the trees of all seeds that its k-th score does
not exclude. In a tree pages are opened in the order of their least possible distance. Before any distance is computed, the
stored distance to the parent rules entries out: |d(q, parent) - d(entry, parent)| - radius is a lower bound. Bounds are in
double precision with some slack; scores are exact integers, and a bound never excludes an equal score.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.work import stored

PAGE = 64  # entries of a page
TREE = 8_192  # vectors that a tree is meant to hold
SEEDS = 1_024  # seeds at most, all in one closure: half a megabyte at 64 dimensions
PER_SEED = 4_096  # vectors a seed is drawn for
QUERIES = 2_048  # queries that visit a tree together
SLACK = 1e-6  # relative to the largest norm
EXACT = 2.0**53
ENDS = 10**38 - 1  # scores travel in 38 digits


def floored(raw: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles where these hold every sum of products, else as Python integers."""
    with np.errstate(over="ignore"):
        out = np.floor(raw * scale)
    top = np.abs(out).max(initial=0.0)
    if np.isfinite(top) and top * top * max(1, raw.shape[-1]) < EXACT:
        return out
    whole = [math.floor(x * scale) if abs(x) < 2.0**900 else int(x) * scale for x in raw.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(raw.shape)


def scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles while these are exact, else Python integers."""
    if rows.dtype != object and query.dtype != object:
        if np.abs(rows).max(initial=0.0) * np.abs(query).max(initial=0.0) * max(1, len(query)) < EXACT:
            return rows @ query
    a, b = (np.array([int(x) for x in m.ravel().tolist()], dtype=object).reshape(m.shape) for m in (rows, query))
    return (a * b).sum(axis=1) if a.shape[1] else np.zeros(len(a), dtype=object)


class Space:
    """The metric: coordinates divided by `unit`, one more coordinate that brings every vector to the norm `reach`."""

    def __init__(self, scale: int, unit: float, reach: float):
        self.scale, self.unit, self.reach = scale, unit, reach
        self.slack = SLACK * max(reach, 1e-9)

    def of(self, raw: np.ndarray, query: bool = False) -> np.ndarray:
        with np.errstate(over="ignore"):
            v = np.floor(raw * self.scale) / self.unit
        huge = ~np.isfinite(v)
        if huge.any():
            v[huge] = (raw[huge] / self.unit) * self.scale
        rest = np.zeros(len(v)) if query else np.sqrt(np.maximum(0.0, self.reach**2 - np.einsum("ij,ij->i", v, v)))
        return np.hstack([v, rest[:, None]])

    def within(self, norm2: float, score) -> float:
        """No vector whose inner product with a query of squared norm `norm2` is `score` or more is further away."""
        if score is None:
            return math.inf
        s = float(score) / self.unit / self.unit if abs(score) < 2**1000 else float(Fraction(int(score)) / Fraction(self.unit) ** 2)
        return math.sqrt(max(0.0, norm2 + self.reach**2 - 2 * (s - abs(s) * 1e-12))) + self.slack


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, np.einsum("ij,ij->i", a - b, a - b)))


def gather(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows in groups of at most `most`, near ones together."""
    done, open_ = [], [np.arange(len(points))]
    while open_:
        mine = open_.pop()
        if len(mine) <= most:
            done.append(mine)
            continue
        fan = min(16, -(-len(mine) // (most // 2)))
        here = points[mine]
        heads = here[np.linspace(0, len(mine) - 1, fan).astype(int)]
        nearest = (np.einsum("ij,ij->i", heads, heads) - 2 * here @ heads.T).argmin(axis=1)
        parts = [mine[nearest == i] for i in range(fan)]
        if max(len(p) for p in parts) > 0.9 * len(mine):  # hardly to be told apart: by distance, in equal parts
            order = np.argsort(_far(here, heads[:1]), kind="stable")
            parts = [mine[p] for p in np.array_split(order, fan)]
        open_ += [p for p in parts if len(p)]
    return done


def build(space: Space, raw: np.ndarray) -> list[dict]:
    """Pages of a tree over the rows of `raw`; the last one is the root. A page names rows (leaf) or pages by number."""
    level = space.of(raw)
    radius, names, leaf, pages = np.zeros(len(raw)), np.arange(len(raw)), True, []
    while True:
        routes, radii, numbers = [], [], []
        for group in gather(level, PAGE):
            middle = level[group].mean(axis=0)
            route = level[group[_far(level[group], middle[None]).argmin()]]
            parent = _far(level[group], route[None])
            numbers.append(len(pages))
            pages.append({"leaf": leaf, "names": names[group], "parent": parent, "radius": radius[group],
                          "route": np.empty((0, level.shape[1])) if leaf else level[group]})
            routes.append(route)
            radii.append((parent + radius[group]).max())
        if len(pages) and len(numbers) == 1:
            return pages
        level, radius, names, leaf = np.array(routes), np.array(radii), np.array(numbers), False


class Best:
    """The first k so far, by score and then id; a null id comes last."""

    def __init__(self, k: int, least: float | None):
        self.k, self.least, self.rows = k, least, []

    def add(self, score, uid: int, row_id: int | None) -> None:
        self.rows.append((-score, row_id is None, row_id or 0, uid))
        if len(self.rows) >= 4 * self.k:
            self.trim()

    def trim(self) -> None:
        self.rows = sorted(self.rows)[: self.k]
        if len(self.rows) == self.k:
            kth = -self.rows[-1][0]
            self.least = kth if self.least is None else max(self.least, kth)


def search(space: Space, pages: list[dict], raw: np.ndarray, uids: np.ndarray, ids: list, query: np.ndarray, own: int, k: int,
           least=None, seen: list[int] | None = None) -> list[tuple]:
    """[(-score, id is null, id, uid)], the first k of a tree, without row `own` and with scores of at least `least`."""
    asked, whole = space.of(query[None], query=True)[0], floored(query, space.scale)
    norm2 = float(asked @ asked)
    best = Best(k, least)

    waiting = [(0.0, len(pages) - 1, None)]
    while waiting:
        bound, number, from_parent = heapq.heappop(waiting)
        within = space.within(norm2, best.least)
        if bound > within:
            break
        page = pages[number]
        some = np.arange(len(page["names"]))
        if from_parent is not None:
            some = some[np.abs(from_parent - page["parent"]) - page["radius"] <= within]
        if seen is not None:
            seen[0] += len(some)
        if not len(some):
            continue
        if page["leaf"]:
            rows = page["names"][some]
            got = scores(page["whole"][some], whole)
            keep = np.arange(len(got)) if best.least is None else np.flatnonzero(got >= best.least)
            for i in keep.tolist():
                if uids[rows[i]] != own:
                    best.add(int(got[i]), int(uids[rows[i]]), ids[rows[i]])
            best.trim()
        else:
            far = _far(page["route"][some], asked[None])
            for i, d in zip(some.tolist(), far.tolist()):
                low = max(0.0, d - page["radius"][i])
                if low <= within:
                    heapq.heappush(waiting, (max(bound, low), int(page["names"][i]), d))
    best.trim()
    return best.rows


# --- Spark ------------------------------------------------------------------------------------------------------

PAGES = "tree long, width int, page int, data binary"
_PAGES = pa.schema([("tree", pa.int64()), ("width", pa.int32()), ("page", pa.int32()), ("data", pa.binary())])
FOUND = "q long, score decimal(38,0), uid long, id long"


def _table(page: dict, raw: np.ndarray, uids: np.ndarray, ids: list) -> bytes:
    """A page as bytes: an Arrow record batch, leaf pages with their vectors."""
    mine = page["names"]
    wide = raw[mine] if page["leaf"] else page["route"]
    batch = pa.RecordBatch.from_pydict({
        "leaf": pa.array([page["leaf"]] * len(mine)), "name": pa.array([int(x) for x in (uids[mine] if page["leaf"] else mine)], pa.int64()),
        "id": pa.array([ids[i] for i in mine] if page["leaf"] else [None] * len(mine), pa.int64()), "parent": pa.array(page["parent"]),
        "radius": pa.array(page["radius"]), "vector": pa.array(list(wide), pa.list_(pa.float64()))})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _read(space: Space, data: list[bytes]) -> tuple[list[dict], np.ndarray, list]:
    """Pages, uids and ids of a tree from its bytes; leaf pages name positions in both lists."""
    pages, uids, ids = [], [], []
    for one in data:
        b = pa.ipc.open_stream(one).read_all().to_batches()[0]
        leaf, name = b.column("leaf")[0].as_py(), b.column("name").to_numpy()
        vector = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        page = {"leaf": leaf, "parent": b.column("parent").to_numpy(), "radius": b.column("radius").to_numpy()}
        if leaf:
            page |= {"names": np.arange(len(ids), len(ids) + len(name)), "whole": floored(vector, space.scale)}
            uids.append(name)
            ids += b.column("id").to_pylist()
        else:
            page |= {"names": name, "route": vector}
        pages.append(page)
    return pages, np.concatenate(uids), ids


def _vectors(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x) for x in column.to_pylist()]


def _nearest(space: Space, seeds: dict[int, tuple[np.ndarray, np.ndarray]]):
    """The row with the seed of its width that is nearest to it, -1 where there is none, and the distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _vectors(batch.column("vector"))
            seed, far = np.full(len(rows), -1), np.zeros(len(rows))
            widths = np.array([len(r) for r in rows])
            for width in set(widths.tolist()) & set(seeds):
                at = np.flatnonzero(widths == width)
                heads, numbers = seeds[width]
                mine = space.of(np.array([rows[i] for i in at]))
                d = (np.einsum("ij,ij->i", heads, heads) - 2 * mine @ heads.T).argmin(axis=1)
                seed[at], far[at] = numbers[d], _far(mine, heads[d])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seed, pa.int64()), pa.array(far)], names=[*batch.schema.names, "seed", "far"])

    return run


def _grow(space: Space):
    """Trees from rows that come sorted by tree: each tree's pages, one tree for each width in it."""

    def pages(tree: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        by_width: dict[int, list[tuple]] = {}
        for row in rows:
            by_width.setdefault(len(row[2]), []).append(row)
        for width, mine in by_width.items():
            raw = np.frombuffer(b"".join(r[2] for r in mine)).reshape(len(mine), -1)
            uids, ids = np.array([r[0] for r in mine]), [r[1] for r in mine]
            out = [(tree, width // 8, n, _table(p, raw, uids, ids)) for n, p in enumerate(build(space, raw))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PAGES)], schema=_PAGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, held = None, []
        for batch in batches:
            for t, *row in zip(*(batch.column(c).to_pylist() for c in ("tree", "uid", "id", "vector"))):
                if t != tree and held:
                    yield from pages(tree, held)
                    held = []
                tree = t
                held.append(row)
        if held:
            yield from pages(tree, held)

    return run


def _visit(space: Space, k: int):
    """Queries against the trees they meet: rows come sorted by tree and block, pages before queries."""
    schema = pa.schema([("q", pa.int64()), ("score", pa.decimal128(38, 0)), ("uid", pa.int64()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, data, trees = None, {}, {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if place != (row["tree"], row["block"]):
                    place, data, trees = (row["tree"], row["block"]), {}, {}
                if row["page"] is not None:
                    data.setdefault(row["width"], []).append(row["vector"])
                    continue
                width = len(row["vector"]) // 8
                if width not in trees:
                    trees[width] = _read(space, data.pop(width)) if width in data else None
                if trees[width] is None:
                    continue
                pages, uids, ids = trees[width]
                least = None if row["least"] is None else int(row["least"])
                for score, none, row_id, uid in search(space, pages, None, uids, ids, np.frombuffer(row["vector"]), row["q"], k, least):
                    out.append((row["q"], max(-ENDS, min(ENDS, -score)), uid, None if none else row_id))
            if out:
                q, score, uid, row_id = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array([Decimal(s) for s in score], pa.decimal128(38, 0)), pa.array(uid, pa.int64()),
                                                  pa.array(row_id, pa.int64())], schema=schema)

    return run


def _beyond(space: Space, seeds: dict[int, tuple[np.ndarray, np.ndarray]], radius: dict[int, float], strays: bool):
    """(q, seed) for every seed but the query's own whose vectors may score at least what the query has already."""
    schema = pa.schema([("q", pa.int64()), ("seed", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                raw = np.frombuffer(row["vector"])
                if strays and row["seed"] != -1:
                    out.append((row["q"], -1))
                if len(raw) not in seeds:
                    continue
                heads, numbers = seeds[len(raw)]
                asked = space.of(raw[None], query=True)
                within = space.within(float(asked[0] @ asked[0]), None if row["least"] is None else int(row["least"]))
                far = _far(heads, asked)
                out += [(row["q"], int(s)) for s, d in zip(numbers, far) if s != row["seed"] and s in radius and d - radius[s] <= within]
            if out:
                q, seed = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(seed, pa.int64())], schema=schema)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, row_id: str = "vec_id", vector: str = "embedding", scale: int = 1024,
          tree: int = TREE) -> DataFrame:
    """(query_id, rank, row_id, score): for every row where `is_query` holds its k best other rows by inner product.

    Vectors count as floor(scale * x) in double precision; scores are exact. One that no long can hold is given as the nearest
    long, but ranked by its own value (beyond 38 digits such values tie). Ties go to the smaller id, null last, then to one row of equal ones. A query is not its own candidate, but a repeated row
    is another row, and every repeated query row has its own answer. Rows whose vector is null or empty, or holds nulls or values that are
    not finite, take no part; vectors of different lengths do not meet.
    With fewer candidates than k all are returned; an empty table gives no rows. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    x = F.col(vector).cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    packed = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(row_id).cast("long").alias("id"),
                            F.coalesce(is_query, F.lit(False)).alias("asks"), x.alias("x")).where((F.size("x") > 0) & finite)
    rows = stored(packed.mapInArrow(_pack, "uid long, id long, asks boolean, vector binary, top double, norm double"), "vectors")
    n, top = rows.agg(F.count("*"), F.max("top")).first()
    empty = spark.createDataFrame([], f"query_id long, rank int, {row_id} long, score long")
    if not n:
        return empty
    unit = 2.0 ** math.floor(math.log2(max(1.0, top))) * (scale if top < 2.0**900 else 1.0)
    # the largest norm of the floored vectors, in units: floor moves a component by less than one
    reach = float(rows.agg(F.max(F.col("norm") * (F.col("top") / (unit / scale)) + F.sqrt(F.octet_length("vector") / 8) / unit)).first()[0]) * (1 + 1e-9)
    space = Space(scale, unit, reach)

    drawn = rows.orderBy(F.xxhash64("uid"), "uid").limit(int(min(SEEDS, -(-n // PER_SEED)))).select("vector").collect()
    by_width: dict[int, list[np.ndarray]] = {}
    for r in drawn:
        by_width.setdefault(len(r["vector"]) // 8, []).append(np.frombuffer(bytes(r["vector"])))
    seeds, number = {}, 0
    for width, heads in by_width.items():
        seeds[width] = (space.of(np.array(heads)), np.arange(number, number + len(heads)))
        number += len(heads)

    kept = "uid long, id long, asks boolean, vector binary, seed long, far double"
    placed = stored(rows.drop("top", "norm").mapInArrow(_nearest(space, seeds), kept), "placed")
    # of equal vectors the k + 1 smallest ids; the rank is cut before rows are dealt, so a frequent vector stays small
    rank = F.row_number().over(Window.partitionBy("vector").orderBy(F.asc_nulls_last("id"), "uid"))
    distinct = placed.select("uid", "id", "vector", "seed", "far", rank.alias("_rank")).where(F.col("_rank") <= k + 1).drop("_rank")
    distinct = stored(distinct, "distinct")
    groups = {r["seed"]: (r["n"], r["radius"]) for r in distinct.groupBy("seed").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}
    parts = {s: max(1, -(-m // tree)) for s, (m, _) in groups.items()}
    first, total = {}, 0
    for s in sorted(parts):
        first[s], total = total, total + parts[s]
    # one row a seed: seeds are bounded
    dealt = F.broadcast(spark.createDataFrame([(s, first[s], parts[s]) for s in sorted(parts)], "seed long, first long, parts long"))

    planted = distinct.join(dealt, "seed").select((F.col("first") + F.pmod(F.xxhash64("uid"), F.col("parts"))).alias("tree"), "uid", "id", "vector")
    pages = stored(planted.repartition(int(total), "tree").sortWithinPartitions("tree").mapInArrow(_grow(space), PAGES), "pages")

    asked = stored(placed.where("asks").select(F.col("uid").alias("q"), "id", "vector", "seed"), "queries")
    blocks = int(max(1, -(-asked.count() // QUERIES)))
    block = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block")

    def visit(queries: DataFrame, name: str) -> DataFrame:
        """Queries (q, vector, seed, least) against all trees of their seeds."""
        to = queries.join(dealt, "seed").select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("tree"), "q", "vector", "least", block)
        needed = stored(to, f"{name}-visits")
        meetings = needed.select("tree", "block").distinct()
        there = pages.join(meetings, "tree").select("tree", "block", "page", "width", F.col("data").alias("vector"), F.lit(None).cast("long").alias("q"),
                                                    F.lit(None).cast("decimal(38,0)").alias("least"))
        asks = needed.select("tree", "block", F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("width"), "vector", "q", "least")
        both = there.unionByName(asks).repartition(int(total * blocks), "tree", "block")
        # nulls last: pages come before the queries, in their order
        return stored(both.sortWithinPartitions("tree", "block", F.asc_nulls_last("page"), "q").mapInArrow(_visit(space, k), FOUND), name)

    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"), "uid")
    near = visit(asked.select("q", "vector", "seed", F.lit(None).cast("decimal(38,0)").alias("least")), "near")
    kth = near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == k).where(F.col("score") > F.lit(Decimal(-ENDS))).select("q", F.col("score").alias("least"))
    bounded = stored(asked.join(kth, "q", "left").select("q", "vector", "seed", "least"), "bounded")
    radius = {s: r for s, (_, r) in groups.items() if s >= 0}
    more = bounded.mapInArrow(_beyond(space, seeds, radius, -1 in groups), "q long, seed long")
    far = visit(bounded.drop("seed").join(more, "q").select("q", "vector", "seed", "least"), "far")
    all_found = near.unionByName(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    low, high = -(2**63), 2**63 - 1
    score = F.greatest(F.lit(low).cast("decimal(38,0)"), F.least(F.lit(high).cast("decimal(38,0)"), F.col("score"))).cast("long")
    names = asked.select("q", F.col("id").alias("query_id"))
    return all_found.join(names, "q").select("query_id", F.col("rank").cast("int"), F.col("id").alias(row_id), score.alias("score"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes, with the largest component and the norm in units of it, which never overflows."""
    for batch in batches:
        data, tops, norms = [], [], []
        for values in batch.column("x").to_pylist():
            v = np.array(values, dtype=np.float64)
            v[v == 0] = 0.0  # one zero
            top = float(np.abs(v).max(initial=0.0))
            data.append(v.tobytes())
            tops.append(top)
            norms.append(float(np.linalg.norm(v / top)) if top else 0.0)
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("id"), batch.column("asks"), pa.array(data, pa.binary()),
                                          pa.array(tops, pa.float64()), pa.array(norms, pa.float64())],
                                         names=["uid", "id", "asks", "vector", "top", "norm"])
