"""Point-in-polygon joins.

Polygons are covered by cells of a quadtree: a polygon starts at a level that suits its size, and border cells with many
edges are cut further. A cell row holds only the edges that come into it; of all edges further east, which a ray from a
point would cross, it keeps their parity and the few latitudes where that changes. So the edges of a cell are bounded
whatever the polygon, and the test gives the same answer as one against all edges.

A point joins the polygons of its own cell, at each level in use, by equality; only border cells need the exact test. The
points, which are the large side, are never shuffled while the cells fit a broadcast. Beyond it, cells that hold a large
share of the points are found by a sketch and spread over several tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.functions import geometry as geo
from kerbline.operators.lookup import HOT_ROWS, Salts, measured_salts
from kerbline.operators.union_borders import inner_borders
from kerbline.session import shared_dir

# A power of two, so that cell borders are exact doubles and a point never falls between cell and border.
CELLS_PER_DEGREE = 16
# Largest total of cells and edges held by cells that is still broadcast (an edge takes about 50 bytes).
BROADCAST_ITEMS = 2_000_000
# A polygon starts at the finest level at which its box has no more cells than this; smaller numbers are tried before the
# cells are shuffled. Levels are STEP apart, so that few are in use.
START_CELLS = (4096, 1024, 256, 64)
STEP, COARSEST = 2, -4
# Border cells with more edges are cut into 4^STEP cells, at most so many times.
CELL_EDGES, CUTS = 64, 4
# Up to so many edges in all, one task finds what of the borders is inside the union.
ONE_TASK_EDGES = 20_000

INNER_TYPE = "array<struct<x1: double, y1: double, x2: double, y2: double>>"


def width(level: int | str) -> str:
    """Cells per degree of a level, exactly."""
    return f"{2.0 ** level!r}d" if isinstance(level, int) else f"pow(2d, {level})"


def cell_of(lon: str, lat: str, level: int | str) -> tuple[str, str]:
    n = width(level)
    return f"cast(floor({lon} * {n}) as int)", f"cast(floor({lat} * {n}) as int)"


def code_of(level: str, x: str, y: str) -> Column:
    return F.expr(f"xxhash64({level}, {x}, {y})")


@dataclass(frozen=True)
class Grid:
    """Polygons cut into cells.

    `cells` has `key` (the polygon's id column), `_level`, `_cell_x`, `_cell_y`, `_covered` (the whole cell is inside),
    `_edges`, `_odd` and `_turns` (parity of the edges beyond, and where it changes), `_inner` (pieces of border inside the
    union of all polygons) and the box of the polygon. `box` encloses all polygons; None when there is no polygon.
    """

    cells: DataFrame
    key: str
    box: tuple[float, float, float, float] | None
    broadcast: bool
    levels: tuple[int, ...]
    union: bool = False
    hot_rows: int = HOT_ROWS

    def near(self, lon: str, lat: str) -> Column:
        """Cheap test that reaches the file reader: is the point in the box of all polygons?"""
        if self.box is None:
            return F.lit(False)
        west, south, east, north = self.box
        return F.col(lon).between(west, east) & F.col(lat).between(south, north)

    def at(self, level: int) -> DataFrame:
        return self.cells if len(self.levels) == 1 else self.cells.where(F.col("_level") == level)

    def per_polygon(self, rows: DataFrame) -> DataFrame:
        """Rows of which there is at most one per polygon: where the cells fit a broadcast, so do these."""
        return F.broadcast(rows) if self.broadcast else rows

    def test(self, lon: str, lat: str, rule=geo.within, of: str = "") -> str:
        """Is the point inside the polygon of a cell that it lies in? `of` prefixes the columns of the cell."""
        odd = f"({of}_odd <> (size(filter({of}_turns, turn -> turn > {lat})) % 2 = 1))"
        inside = rule(f"{of}_edges", lon, lat, odd)
        if self.union:
            inside = f"({inside} or {geo.on_piece(f'{of}_inner', lon, lat)})"
        return f"({of}_covered or {inside})"

    def match(self, lon: str, lat: str, rule=geo.within, level: int | str | None = None) -> str:
        """Join condition: the cell of the point, and the point inside the polygon by the rule.

        The box test is cheap, and it keeps the condition bound to both sides of the join.
        """
        x, y = cell_of(lon, lat, self.levels[0] if level is None else level)
        return f"""_cell_x = {x} and _cell_y = {y} and ({lon} between _west and _east and {lat} between _south and _north
            and {self.test(lon, lat, rule)})"""

    def salts(self, points: DataFrame, lon: str, lat: str, level: int | str) -> Salts:
        """How far to spread the cells that hold many of the points."""
        x, y = cell_of(lon, lat, level)
        return measured_salts(points, code_of(str(level), x, y), self.hot_rows)


# --- cutting ----------------------------------------------------------------------------------------------------

def _parity(values: str, condition: str) -> str:
    return f"(size(filter({values}, v -> {condition})) % 2 = 1)"


# Latitudes that occur an odd number of times, in order.
_UNPAIRED = """aggregate(array_sort(_ys), named_struct('kept', cast(array() as array<double>), 'last', cast(null as double), 'odd', false),
    (a, y) -> case when a.odd and a.last = y then named_struct('kept', a.kept, 'last', y, 'odd', false)
        else named_struct('kept', case when a.odd then concat(a.kept, array(a.last)) else a.kept end, 'last', y, 'odd', true) end,
    a -> case when a.odd then concat(a.kept, array(a.last)) else a.kept end)"""


def _cut(cells: DataFrame, pad: float) -> DataFrame:
    """The edges of a cell that come into it (or its surroundings), the others as parity; a second time changes nothing.

    An edge that does not come into the cell passes its rows on one side only. East of it, it is crossed by rays from
    latitudes between its ends, so the parity of such edges changes at their ends; ends that chains of edges share cancel.
    """
    n = width("_level")
    centre, half = (f"((_cell_x + 0.5d) / {n})", f"((_cell_y + 0.5d) / {n})"), f"(0.5d / {n} + {pad!r}d)"
    low, high = f"(_cell_y / {n})", f"((_cell_y + 1) / {n})"
    middle = f"(greatest(least(e.y1, e.y2), {low}) + least(greatest(e.y1, e.y2), {high})) / 2"
    east = f"""e.y1 <> e.y2 and greatest(e.y1, e.y2) > {low} and least(e.y1, e.y2) < {high}
        and e.x1 + ({middle} - e.y1) / (e.y2 - e.y1) * (e.x2 - e.x1) > {centre[0]}"""
    meets = geo.meets_box("array(e)", *centre, half)
    keep = [c for c in cells.columns if c not in ("_edges", "_odd", "_turns", "_inner")]
    parted = cells.selectExpr(
        *keep, "_odd", f"filter(_inner, e -> {meets}) as _inner", f"filter(_edges, e -> {meets}) as _edges",
        f"concat(_turns, flatten(transform(filter(_edges, e -> {east} and not {meets}), e -> array(e.y1, e.y2)))) as _ys")
    counted = parted.selectExpr(*keep, "_edges", "_inner", f"_odd <> {_parity('_ys', f'v >= {high}')} as _odd", f"filter(_ys, v -> v > {low} and v < {high}) as _ys")
    return counted.where("size(_edges) > 0 or _odd").selectExpr(*keep, "_edges", "_odd", f"case when size(_ys) = 0 then _ys else {_UNPAIRED} end as _turns", "_inner")


def _cut_further(cells: DataFrame, pad: float, edges: int) -> DataFrame:
    """Cells with more edges than that replaced by their parts."""
    side = 1 << STEP
    parts = f"""case when size(_edges) > {edges} then transform(sequence(0, {side * side - 1}), i -> named_struct(
            'l', _level + {STEP}, 'x', _cell_x * {side} + i % {side}, 'y', _cell_y * {side} + cast(floor(i / {side}) as int)))
        else array(named_struct('l', _level, 'x', _cell_x, 'y', _cell_y)) end"""
    opened = cells.withColumn("_part", F.explode(F.expr(parts)))
    keep = [c for c in cells.columns if c not in ("_level", "_cell_x", "_cell_y", "_covered")]
    moved = opened.selectExpr(*keep, "_part.l as _level", "_part.x as _cell_x", "_part.y as _cell_y")
    return _cut(moved, pad).selectExpr("*", "size(_edges) = 0 as _covered")


def build_grid(polygons: DataFrame, key: str = "zone_id", rings: str = "rings", per_degree: int = CELLS_PER_DEGREE, margin: float = 0.0,
               broadcast_items: int = BROADCAST_ITEMS, union: bool = False, cell_edges: int = CELL_EDGES, hot_rows: int = HOT_ROWS) -> Grid:
    """Cover the polygons by cells. A small job over the polygons measures them first.

    `per_degree` is where small polygons start; larger ones start coarser, all of them where that makes the cells fit a
    broadcast; the result of a join is the same. Only border cells with more than `cell_edges` edges are cut further; then
    the cells are written and read back. With a `margin` (in degrees) the cells also cover the surroundings, and hold the
    edges within the margin. With `union` the polygons count as one area, so that a border between two of them is inside.
    """
    if per_degree < 1 or per_degree & (per_degree - 1):
        raise ValueError("cells per degree must be a power of two")
    pad = float(margin)
    shapes = (polygons.where(F.col(rings).isNotNull())
              .select(key, geo.polygon_edges(rings).alias("_edges"))
              .selectExpr(key, "_edges", f"array_min(_edges.x1) - {pad!r}d as _west", f"array_min(_edges.y1) - {pad!r}d as _south",
                          f"array_max(_edges.x1) + {pad!r}d as _east", f"array_max(_edges.y1) + {pad!r}d as _north")
              .where("_west is not null"))
    finest = per_degree.bit_length() - 1
    starts = list(range(finest, COARSEST - 1, -STEP))

    def columns(level: int | str) -> str:
        return f"(floor(_east * {width(level)}) - floor(_west * {width(level)}) + 1)"

    def rows(level: int | str) -> str:
        return f"(floor(_north * {width(level)}) - floor(_south * {width(level)}) + 1)"

    def start(most: int) -> str:
        fits = " ".join(f"when {columns(s)} * {rows(s)} <= {most} then {s}" for s in starts[:-1])
        return f"case {fits} else {starts[-1]} end" if fits else str(starts[-1])

    # an edge comes into one cell, and one more for every line it crosses
    walked = "aggregate(_edges, 0d, (total, e) -> total + abs(e.x1 - e.x2) + abs(e.y1 - e.y2))"

    def measured(most: int):
        """Box, number of edges, and with polygons starting at `most` cells: items and levels."""
        sized = shapes.selectExpr("_west", "_south", "_east", "_north", "size(_edges) as _count", f"{walked} as _walked", f"{start(most)} as _start")
        return sized.selectExpr(
            "min(_west)", "min(_south)", "max(_east)", "max(_north)", "max(_count) as edges", "sum(_count) as all_edges", "count(*) as polygons",
            f"sum({columns('_start')} * {rows('_start')} + (_walked + 4 * _count * {pad!r}d) * {width('_start')} + 3 * _count) as items",
            "collect_set(_start) as levels").first()

    chosen = START_CELLS[0]
    found = first = measured(chosen)
    for most in START_CELLS[1:]:
        if (found["items"] or 0) <= broadcast_items or broadcast_items <= 0:
            break
        found, chosen = measured(most), most
    if (found["items"] or 0) > broadcast_items:
        found, chosen = first, START_CELLS[0]
    box = tuple(found)[:4]
    if box[0] is None:
        return Grid(_cells(shapes, key, pad, str(finest), None), key, None, True, (finest,), union, hot_rows)
    fits = found["items"] <= broadcast_items
    inner = None
    if union and found["polygons"] > 1:
        # the few edges of a request need no shuffle among themselves
        inner = inner_borders(polygons.coalesce(1) if found["all_edges"] <= ONE_TASK_EDGES else polygons, key, rings, per_degree)
    cells = _cells(shapes, key, pad, start(chosen), inner)
    levels = tuple(sorted(found["levels"]))
    if found["edges"] <= cell_edges:
        return Grid(cells, key, box, fits, levels, union, hot_rows)
    for _ in range(CUTS):
        cells = _cut_further(cells, pad, cell_edges)
    path = shared_dir(polygons.sparkSession, "cells")
    cells.write.parquet(path)
    cells = polygons.sparkSession.read.schema(cells.schema).parquet(path)
    levels, total = cells.selectExpr("array_sort(collect_set(_level))", "sum(1 + size(_edges))").first()
    return Grid(cells, key, box, total <= broadcast_items, tuple(levels), union, hot_rows)


def _cells(shapes: DataFrame, key: str, pad: float, level: str, inner: DataFrame | None) -> DataFrame:
    n, none = width("_level"), f"cast(array() as {INNER_TYPE})"
    box = ["_west", "_south", "_east", "_north"]
    placed = shapes.selectExpr("*", f"cast({level} as int) as _level")
    placed = placed.selectExpr("*", f"{none} as _inner") if inner is None else placed.join(inner, key, "left").selectExpr(
        key, "_edges", *box, "_level", f"coalesce(_inner, {none}) as _inner")
    # First the edges of a row of cells, then those that come into a cell.
    by_row = placed.selectExpr("*", f"explode(sequence(cast(floor(_south * {n}) as int), cast(floor(_north * {n}) as int))) as _cell_y").selectExpr(
        key, *box, "_level", "_inner", "_cell_y", f"explode(sequence(cast(floor(_west * {n}) as int), cast(floor(_east * {n}) as int))) as _cell_x",
        f"""filter(_edges, e -> greatest(e.y1, e.y2) >= _cell_y / {n} - {pad!r}d
            and least(e.y1, e.y2) <= (_cell_y + 1) / {n} + {pad!r}d) as _edges""", "false as _odd", "cast(array() as array<double>) as _turns")
    return _cut(by_row, pad).selectExpr(key, "_level", "_cell_x", "_cell_y", "_edges", "_odd", "_turns", "_inner", *box, "size(_edges) = 0 as _covered")


# --- joins ------------------------------------------------------------------------------------------------------

def _joined(points: DataFrame, grid: Grid, condition: str, how: str, level: int | str, lon: str, lat: str) -> DataFrame:
    """Join with the cells of a level: broadcast, or spread where cells hold many points."""
    cells = grid.at(level) if isinstance(level, int) else grid.cells
    if grid.broadcast:
        return points.join(F.broadcast(cells), F.expr(condition), how)
    salts = grid.salts(points, lon, lat, level)
    if not salts.by_code:
        return points.join(cells, F.expr(condition), how)
    x, y = cell_of(lon, lat, level)
    left = salts.spread(points, code_of(str(level), x, y))
    return left.join(salts.repeat(cells, code_of("_level", "_cell_x", "_cell_y"), "_cell_salt"), F.expr(f"{condition} and _cell_salt = _salt"), how).drop("_salt", "_cell_salt")


def at_levels(points: DataFrame, grid: Grid) -> tuple[DataFrame, int | str]:
    """The points once for every level in use, and how to name the level in a join."""
    if len(grid.levels) == 1:
        return points, grid.levels[0]
    return points.withColumn("_at_level", F.explode(F.array(*map(F.lit, grid.levels)))), "_at_level"


def containing_polygons(points: DataFrame, grid: Grid, lon: str = "lon", lat: str = "lat", rule=geo.within) -> DataFrame:
    """Inner join: every point once per polygon that contains it, with the polygon's key added."""
    left, level = at_levels(points.where(grid.near(lon, lat)), grid)
    same = "" if isinstance(level, int) else "_level = _at_level and "
    return _joined(left, grid, same + grid.match(lon, lat, rule, level), "inner", level, lon, lat).select(*points.columns, grid.key)


def _in_any(rows: DataFrame, grid: Grid, ends: list[tuple[str, str]], rule) -> DataFrame:
    """Rows with at least one of the points inside at least one polygon, once.

    While the cells are broadcast, one pass asks for all points and levels. Otherwise each point and level is a semi join
    of what none before has found: these shuffle by cell, and a skewed one can be split.
    """
    passes = [(lon, lat, level) for level in grid.levels for lon, lat in ends]
    if grid.broadcast and len(passes) > 1:
        tests = [f"exists (select 1 from {{cells{grid.levels.index(level)}}} where {grid.match(lon, lat, rule, level)})" for lon, lat, level in passes]
        cells = {f"cells{i}": F.broadcast(grid.at(level)) for i, level in enumerate(grid.levels)}
        return rows.sparkSession.sql(f"select * from {{rows}} where {' or '.join(tests)}", rows=rows, **cells)
    found = []
    for lon, lat, level in passes:
        here = rows.where(grid.near(lon, lat)) if len(passes) == 1 else rows
        condition = grid.match(lon, lat, rule, level)
        found.append(_joined(here, grid, condition, "left_semi", level, lon, lat))
        if len(found) < len(passes):
            rows = _joined(rows, grid, condition, "left_anti", level, lon, lat)
    return reduce(DataFrame.unionByName, found)


def in_any_polygon(points: DataFrame, grid: Grid, lon: str = "lon", lat: str = "lat", rule=geo.within) -> DataFrame:
    """Semi join: every point inside at least one polygon, once."""
    return _in_any(points.where(grid.near(lon, lat)), grid, [(lon, lat)], rule).select(*points.columns)


def either_in_any_polygon(rows: DataFrame, grid: Grid, first: tuple[str, str], second: tuple[str, str],
                          rule=geo.within) -> DataFrame:
    """Rows with at least one of two points inside at least one polygon, once."""
    return _in_any(rows.where(grid.near(*first) | grid.near(*second)), grid, [first, second], rule).select(*rows.columns)


def first_polygon(points: DataFrame, grid: Grid, keys: list[str], lon: str = "lon", lat: str = "lat",
                  rule=geo.within) -> DataFrame:
    """Every row whose point lies in a polygon, once, with the lowest polygon key. `keys` identify a point.

    Rows that share their keys (and so their point) stay apart: there are as many afterwards as before. While the
    cells fit a broadcast, all polygons of a cell are one row and no shuffle of the points is needed.
    """
    if not grid.broadcast:
        # Rows of one point meet the same polygons, so the lowest one is met by all of them.
        found = containing_polygons(points, grid, lon, lat, rule).groupBy(*keys, grid.key).agg(F.count("*").alias("_n"))
        lowest = found.groupBy(*keys).agg(F.min(F.struct(grid.key, "_n")).alias("_lowest"))
        return (lowest.select(*keys, f"_lowest.{grid.key}", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_lowest._n"))))
                .select(*keys, grid.key))
    near = points.where(grid.near(lon, lat))
    lowest = []
    for i, level in enumerate(grid.levels):
        # The measured total of the cells bounds every one of these lists.
        lists = grid.at(level).groupBy("_cell_x", "_cell_y").agg(F.collect_list(F.struct(
            F.col(grid.key).alias("key"), "_covered", "_edges", "_odd", "_turns", "_inner")).alias(f"_polygons{i}"))
        x, y = cell_of(lon, lat, level)
        lists = lists.withColumnsRenamed({"_cell_x": f"_x{i}", "_cell_y": f"_y{i}"})
        near = near.join(F.broadcast(lists), F.expr(f"_x{i} = {x} and _y{i} = {y}"), "left" if len(grid.levels) > 1 else "inner")
        lowest.append(f"array_min(transform(filter(_polygons{i}, p -> {grid.test(lon, lat, rule, 'p.')}), p -> p.key))")
    first = F.expr(lowest[0] if len(lowest) == 1 else f"least({', '.join(lowest)})")
    return near.select(*keys, first.alias(grid.key)).where(F.col(grid.key).isNotNull())
