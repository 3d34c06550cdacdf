import math
import random

import pytest
from pyspark.sql import functions as F

from kerbline.functions import geometry as geo
from kerbline.operators.spatial import (build_grid, containing_polygons, either_in_any_polygon, first_polygon,
                                        in_any_polygon)
from tests.shapes import inside, points, polygons, square


def _star(rng, x, y, radius, corners):
    ring = []
    for i in range(corners):
        angle, reach = 2 * math.pi * i / corners, radius * rng.uniform(0.3, 1.0)
        ring.append((x + reach * math.cos(angle), y + reach * math.sin(angle)))
    return [*ring, ring[0]]


@pytest.fixture(scope="module")
def world(spark):
    """Irregular overlapping polygons, one with a hole, one in two parts; a third of the points on one spot."""
    rng = random.Random(7)
    shapes = {f"z{i}": [_star(rng, rng.uniform(4, 6), rng.uniform(51, 53), rng.uniform(0.05, 0.8), rng.randint(3, 40))]
              for i in range(12)}
    shapes["z20"] = [square(4.5, 51.5, 0.5), square(4.6, 51.6, 0.2)]
    shapes["z21"] = [square(3.0, 50.5, 0.25), square(5.0, 50.5, 0.25)]
    spots = [(rng.uniform(2.9, 6.5), rng.uniform(50.4, 53.5)) for _ in range(1400)] + [(4.55, 51.55)] * 700
    expected = {(i, int(name[1:])) for i, (x, y) in enumerate(spots) for name, rings in shapes.items()
                if inside(rings, x, y)}
    return polygons(spark, **shapes), points(spark, *spots).repartition(5), spots, expected


# broadcast, and shuffled with salted cells
WAYS = {"broadcast": {}, "salted": {"broadcast_items": 0, "hot_rows": 50}, "shuffled": {"broadcast_items": 0}, "coarse": {"per_degree": 1},
        "fine": {"per_degree": 64}, "cut": {"per_degree": 4, "cell_edges": 3}, "cut salted": {"per_degree": 4, "cell_edges": 5, "broadcast_items": 0, "hot_rows": 50}}


@pytest.mark.parametrize("way", WAYS)
def test_join_equals_brute_force(world, way):
    shapes, spots, _, expected = world
    grid = build_grid(shapes, **WAYS[way])
    assert grid.broadcast == ("broadcast_items" not in WAYS[way]) and ("cut" not in way or len(grid.levels) > 1)
    found = containing_polygons(spots, grid).select("pid", "zone_id").collect()
    assert len(found) == len(expected)
    assert {tuple(r) for r in found} == expected


@pytest.mark.parametrize("way", ["broadcast", "salted", "cut", "cut salted"])
def test_semi_join_gives_every_point_once(world, way):
    shapes, spots, _, expected = world
    found = [r["pid"] for r in in_any_polygon(spots, build_grid(shapes, **WAYS[way])).collect()]
    assert sorted(found) == sorted({pid for pid, _ in expected})


@pytest.mark.parametrize("way", ["broadcast", "salted", "cut", "cut salted"])
def test_either_point_keeps_repeated_rows(spark, world, way):
    shapes, _, spots, expected = world
    hit = {pid for pid, _ in expected}
    count = len(spots)
    rows = [(*spots[i], *spots[(i * 7 + 3) % count]) for i in range(count)] * 2
    trips = spark.createDataFrame(rows, "a_lon double, a_lat double, b_lon double, b_lat double")
    found = either_in_any_polygon(trips, build_grid(shapes, **WAYS[way]), ("a_lon", "a_lat"), ("b_lon", "b_lat"))
    assert found.columns == trips.columns
    assert found.count() == 2 * sum(i in hit or (i * 7 + 3) % count in hit for i in range(count))


@pytest.mark.parametrize("way", ["broadcast", "salted", "cut", "cut salted"])
def test_first_polygon_is_the_lowest(world, way):
    shapes, spots, _, expected = world
    lowest = {}
    for pid, zone in expected:
        lowest[pid] = min(zone, lowest.get(pid, zone))
    found = first_polygon(spots, build_grid(shapes, **WAYS[way]), ["pid"]).collect()
    assert len(found) == len(lowest)
    assert {r["pid"]: r["zone_id"] for r in found} == lowest


def test_border_rules(spark):
    grid = build_grid(polygons(spark, z1=[square(4, 52)], z2=[square(5, 52)]))
    spots = points(spark, (4.5, 52.5), (5.0, 52.5), (4.0, 52.0), (6.0, 53.0), (4.25, 52.0))
    assert {tuple(r) for r in containing_polygons(spots, grid).select("pid", "zone_id").collect()} == {(0, 1)}
    both = containing_polygons(spots, grid, rule=geo.intersects).select("pid", "zone_id").collect()
    assert {tuple(r) for r in both} == {(0, 1), (1, 1), (1, 2), (2, 1), (3, 2), (4, 1)}


def test_inner_cells_need_no_test(spark):
    cells = build_grid(polygons(spark, z1=[square(4.03, 52.03, 1.0)])).cells
    covered = cells.where("_covered")
    assert covered.count() == 15 * 15
    assert covered.where("size(_edges) > 0 or size(_turns) > 0").count() == 0
    assert cells.where("not _covered").agg(F.max(F.size("_edges"))).first()[0] <= 2


def test_a_long_diagonal_leaves_covered_cells(spark):
    diamond = [(4.0, 52.0), (5.0, 51.0), (6.0, 52.0), (5.0, 53.0), (4.0, 52.0)]
    cells = build_grid(polygons(spark, z1=[diamond])).cells
    assert cells.where("_covered").count() > cells.where("not _covered").count()


def test_no_polygons_and_no_geometry(spark):
    none = polygons(spark, z1=[square(4, 52)]).where("zone_id > 5")
    grid = build_grid(none)
    assert containing_polygons(points(spark, (4.5, 52.5)), grid).count() == 0
    assert in_any_polygon(points(spark, (4.5, 52.5)), grid).count() == 0
    empty = none.unionByName(spark.sql("select 9L as zone_id, cast(null as array<array<struct<x:double,y:double>>>) as rings"))
    assert build_grid(empty).box is None


def test_unknown_position_is_nowhere(spark):
    df = points(spark, (4.5, 52.5)).unionByName(spark.sql("select 9L as pid, cast(null as double) as lon, 52d as lat"))
    assert [r["pid"] for r in in_any_polygon(df, build_grid(polygons(spark, z1=[square(4, 52)]))).collect()] == [0]


def test_large_areas_get_coarser_cells_before_the_join_is_shuffled(world):
    shapes, spots, _, expected = world
    grid = build_grid(shapes, broadcast_items=2000, cell_edges=1000)
    assert grid.broadcast and min(grid.levels) < 4
    assert {tuple(r) for r in containing_polygons(spots, grid).select("pid", "zone_id").collect()} == expected


def test_cells_per_degree_must_be_a_power_of_two(spark):
    with pytest.raises(ValueError):
        build_grid(polygons(spark, z1=[square(4, 52)]), per_degree=10)


def test_result_does_not_depend_on_partitions(world):
    shapes, spots, _, expected = world
    for count in (1, 13):
        found = containing_polygons(spots.repartition(count), build_grid(shapes)).select("pid", "zone_id")
        assert {tuple(r) for r in found.collect()} == expected


def test_edges_of_a_cell_are_bounded(spark):
    """A coast of 4000 edges beside small areas: cells where many come together are cut, the others stay large."""
    rng = random.Random(2)
    coast = _star(rng, 10.0, 50.0, 3.0, 4000)
    shapes = polygons(spark, z1=[coast], z2=[square(7.0, 50.0, 0.1)], z3=[square(9.0, 49.0, 2.0)])
    grid = build_grid(shapes, cell_edges=32)
    largest, finest = grid.cells.selectExpr("max(size(_edges))", "max(_level)").first()
    assert largest <= 32 and finest == max(grid.levels) and len(grid.levels) > 1
    rings = {1: [coast], 2: [square(7.0, 50.0, 0.1)], 3: [square(9.0, 49.0, 2.0)]}
    spots = [(rng.uniform(6.5, 13.5), rng.uniform(46.5, 53.5)) for _ in range(800)]
    spots += [(x, y) for x, y in coast[:200]]
    expected = {(i, z) for i, (x, y) in enumerate(spots[:800]) for z, r in rings.items() if inside(r, x, y)}
    found = {tuple(r) for r in containing_polygons(points(spark, *spots), grid).select("pid", "zone_id").collect()}
    assert {f for f in found if f[0] < 800} == expected and not any(pid >= 800 and z == 1 for pid, z in found)


def test_turns_of_edges_beyond_the_cell(spark):
    """Shapes with ends of chains at every height east of a cell: parity of full rays, in all cells."""
    comb = [(0.0, 0.0), (3.0, 0.0)]
    for i in range(30):
        comb += [(3.0, 0.02 + i * 0.03), (1.0 + (i % 7) * 0.2, 0.03 + i * 0.03)]
    comb += [(3.0, 0.97), (0.0, 0.97), (0.0, 0.0)]
    rng = random.Random(6)
    spots = [(rng.uniform(-0.1, 3.1), rng.uniform(-0.1, 1.1)) for _ in range(1500)]
    expected = {(i, 1) for i, (x, y) in enumerate(spots) if inside([comb], x, y)}
    for way in ({"per_degree": 64}, {"per_degree": 4, "cell_edges": 2}):
        found = containing_polygons(points(spark, *spots), build_grid(polygons(spark, z1=[comb]), **way)).select("pid", "zone_id")
        assert {tuple(r) for r in found.collect()} == expected


def test_half_of_the_points_in_one_cell_go_to_many_tasks(spark):
    rng = random.Random(1)
    spots = [(4.55 + rng.uniform(0, 1e-3), 51.55) for _ in range(1000)] + [(rng.uniform(4, 6), rng.uniform(51, 53)) for _ in range(1000)]
    df = points(spark, *spots)
    grid = build_grid(polygons(spark, z1=[square(4, 51, 2)]), broadcast_items=0, hot_rows=100)
    salts = grid.salts(df, "lon", "lat", grid.levels[0])
    (share,) = salts.by_code.values()
    assert share >= 2
    spread = salts.spread(df.where("pid < 1000"), F.lit(next(iter(salts.by_code)))).groupBy("_salt").count().collect()
    assert len(spread) == share and max(r["count"] for r in spread) < 2 * 1000 / share
    assert containing_polygons(df, grid).count() == sum(4 < x < 6 and 51 < y < 53 for x, y in spots)
    # cells without many points are not repeated
    assert salts.repeat(grid.cells, F.expr("xxhash64(_level, _cell_x, _cell_y)")).count() == grid.cells.count() + share - 1


def test_either_end_beyond_the_bound_needs_no_existence_join(spark, world):
    shapes, spots, _, _ = world
    rows = spots.selectExpr("lon as a_lon", "lat as a_lat", "lon + 1 as b_lon", "lat as b_lat")
    plan = either_in_any_polygon(rows, build_grid(shapes, broadcast_items=0), ("a_lon", "a_lat"), ("b_lon", "b_lat"))._jdf.queryExecution().executedPlan().toString()
    assert "ExistenceJoin" not in plan and "LeftSemi" in plan and "LeftAnti" in plan


# --- the union of several polygons --------------------------------------------------------------------------------

def _union_holds(spark, shapes, spots, **how):
    found = in_any_polygon(points(spark, *spots), build_grid(polygons(spark, **shapes), union=True, **how))
    return {r["pid"] for r in found.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_rectangles_on_a_lattice_are_one_area(spark, seed):
    """Points on and between lattice lines against what covers them from all four sides."""
    rng = random.Random(seed)
    boxes = {}
    for i in range(14):
        x, y = rng.randrange(6), rng.randrange(6)
        boxes[f"z{i}"] = (x, y, x + rng.randint(1, 3), y + rng.randint(1, 3))
    shapes = {}
    for i, (name, (x1, y1, x2, y2)) in enumerate(boxes.items()):
        ring = [(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]
        shapes[name] = [ring if i % 2 else ring[::-1]]
    spots = [(i / 2, j / 2) for i in range(-1, 20) for j in range(-1, 20)]

    def covered(x, y):
        return any(x1 < x < x2 and y1 < y < y2 for x1, y1, x2, y2 in boxes.values())

    expected = {i for i, (x, y) in enumerate(spots) if all(covered(x + a, y + b) for a in (-0.1, 0.1) for b in (-0.1, 0.1))}
    assert _union_holds(spark, shapes, spots) == expected
    assert _union_holds(spark, shapes, spots, broadcast_items=0) == expected


def test_borders_of_slanted_and_partly_shared_edges(spark):
    """Triangles around a corner, an edge shared in part, a polygon in the hole of another, and one corner short of closed."""
    fan = [(2.0, 0.0), (1.0, 2.0), (-2.0, 1.0), (-1.0, -2.0), (1.0, -1.0)]
    shapes = {f"z{i}": [[(0.0, 0.0), fan[i], fan[(i + 1) % 5], (0.0, 0.0)]] for i in range(5)}
    shapes["z10"] = [[(10.0, 0.0), (14.0, 4.0), (10.0, 8.0), (10.0, 0.0)]]  # its slanted edge is shared from (11, 1) to (13, 3)
    shapes["z11"] = [[(13.0, 3.0), (11.0, 1.0), (14.0, 0.0), (13.0, 3.0)]]
    shapes["z20"] = [square(20.0, 0.0, 4.0), square(21.0, 1.0, 2.0)]
    shapes["z21"] = [square(21.0, 1.0, 2.0)]
    spots = [(0.0, 0.0), (1.0, 0.0), (0.5, 1.0), (-1.0, 0.5), (2.0, 0.0), (12.0, 2.0), (11.0, 1.0), (10.5, 0.5), (13.0, 3.0), (13.5, 3.5),
             (21.0, 2.0), (22.0, 1.0), (21.0, 1.0), (20.0, 2.0), (22.0, 2.0)]
    assert _union_holds(spark, shapes, spots) == {0, 1, 2, 3, 5, 10, 11, 12, 14}
    del shapes["z2"]
    assert _union_holds(spark, shapes, spots) & {0, 1, 2, 3} == {1, 2}
