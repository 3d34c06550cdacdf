import json
import math

import pytest
from pyspark.sql import functions as F

from kerbline.functions import geometry as geo
from tests.shapes import points, square

OUTER, HOLE = square(0, 0, 4), square(1, 1, 2)
CASES = {
    "inside": (0.5, 0.5), "in the hole": (2.0, 2.0), "outside": (5.0, 1.0), "left edge": (0.0, 2.0),
    "right edge": (4.0, 2.0), "bottom edge": (2.0, 0.0), "top edge": (2.0, 4.0), "corner": (0.0, 0.0),
    "far corner": (4.0, 4.0), "edge of hole": (1.0, 2.0), "level with a corner": (-1.0, 4.0), "right of hole": (3.5, 2.0),
}
BORDER = {"left edge", "right edge", "bottom edge", "top edge", "corner", "far corner", "edge of hole"}
STRICT = {"inside", "right of hole"}


def _text(*rings):
    return json.dumps({"type": "Polygon", "coordinates": [[list(p) for p in ring] for ring in rings]})


@pytest.fixture(scope="module")
def tested(spark):
    df = points(spark, *CASES.values()).withColumn("rings", geo.rings_from_geojson(F.lit(_text(OUTER, HOLE))))
    df = df.withColumn("edges", geo.polygon_edges("rings"))
    literal = geo.within_polygon(F.col("lon"), F.col("lat"), geo.parse_polygon(_text(OUTER, HOLE)))
    rows = df.select(F.expr(geo.within("edges", "lon", "lat")).alias("within"),
                     F.expr(geo.intersects("edges", "lon", "lat")).alias("intersects"),
                     literal.alias("literal"), "pid").orderBy("pid").collect()
    return dict(zip(CASES, rows))


@pytest.mark.parametrize("name", CASES)
def test_within_rejects_the_border_and_intersects_accepts_it(tested, name):
    row = tested[name]
    assert row["within"] == (name in STRICT)
    assert row["literal"] == (name in STRICT)
    assert row["intersects"] == (name in STRICT | BORDER)


def test_open_rings_are_closed(spark):
    text = json.dumps({"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]})
    (row,) = spark.range(1).select(geo.rings_from_geojson(F.lit(text)).alias("r")).collect()
    assert [(p["x"], p["y"]) for p in row["r"][0]] == [(0, 0), (1, 0), (1, 1), (0, 0)]
    assert geo.parse_polygon(text)[0][-1] == (0.0, 0.0)


def test_multipolygon_has_the_rings_of_all_parts(spark):
    text = json.dumps({"type": "MultiPolygon", "coordinates": [[square(0, 0)], [square(5, 5)]]})
    df = spark.range(1).select(geo.rings_from_geojson(F.lit(text)).alias("rings")).select(
        geo.polygon_edges("rings").alias("edges"))
    found = df.selectExpr(geo.within("edges", "0.5d", "0.5d"), geo.within("edges", "5.5d", "5.5d"),
                          geo.within("edges", "3d", "3d")).first()
    assert tuple(found) == (True, True, False)


def test_other_geojson_is_refused(spark):
    (row,) = spark.range(1).select(geo.rings_from_geojson(F.lit('{"type":"Point","coordinates":[1,2]}'))).collect()
    assert row[0] is None
    with pytest.raises(ValueError):
        geo.parse_polygon({"type": "Point", "coordinates": [1, 2]})


def test_geojson_round_trip(spark):
    df = spark.range(1).select(geo.rings_from_geojson(F.lit(_text(OUTER, HOLE))).alias("rings"))
    document = json.loads(df.select(geo.geojson_from_rings("rings")).first()[0])
    assert document == {"type": "Polygon", "coordinates": [[list(map(float, p)) for p in r] for r in (OUTER, HOLE)]}


def test_distances(spark):
    columns = [F.lit(v) for v in (4.9, 52.37, 4.48, 51.92)]
    row = spark.range(1).select(geo.sphere_metres(*columns).alias("sphere"),
                                geo.travelled_metres(*columns).alias("plane")).first()
    a = math.sin(math.radians(51.92 - 52.37) / 2) ** 2 + math.cos(math.radians(52.37)) * math.cos(
        math.radians(51.92)) * math.sin(math.radians(4.48 - 4.9) / 2) ** 2
    assert row["sphere"] == pytest.approx(2 * 6371008.7714 * math.asin(math.sqrt(a)))
    y = [6378137 * math.log(math.tan(math.pi / 4 + math.radians(v) / 2)) for v in (52.37, 51.92)]
    x = [6378137 * math.radians(v) for v in (4.9, 4.48)]
    assert row["plane"] == pytest.approx(math.hypot(x[0] - x[1], y[0] - y[1]) * math.cos(math.radians(52.37)))


def test_unknown_position_has_no_distance(spark):
    null = F.lit(None).cast("double")
    assert spark.range(1).select(geo.sphere_metres(null, null, F.lit(1.0), F.lit(1.0))).first()[0] is None


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (250.0,), (350.0,)], "m double")
    rows = df.select(geo.whole_metres(F.col("m")), geo.hundreds_of_metres(F.col("m"))).collect()
    assert [r[0] for r in rows] == [0, 2, 2, 250, 350]
    assert [r[1] for r in rows][3:] == [200, 400]


def test_compiled_and_joined_forms_agree_on_small_grids(spark):
    """Repeated corners, level edges, and points level with corners or on edges."""
    import random

    rng = random.Random(9)
    points = spark.createDataFrame([(float(x) / 2, float(y) / 2) for x in range(-1, 11) for y in range(-1, 11)], "lon double, lat double")
    for _ in range(12):
        corners = [(float(rng.randrange(5)), float(rng.randrange(5))) for _ in range(rng.randrange(3, 6))]
        ring = [c for c in corners for _ in range(rng.randrange(1, 3))]
        ring.append(ring[0])
        shape = json.dumps({"type": "Polygon", "coordinates": [[list(c) for c in ring]]})
        rings = geo.parse_polygon(shape)
        compiled = points.where(geo.within_polygon(F.col("lon"), F.col("lat"), rings))
        drawn = points.withColumn("rings", geo.rings_from_geojson(F.lit(shape))).withColumn("edges", geo.polygon_edges("rings"))
        joined = drawn.where(F.expr(geo.within("edges", "lon", "lat"))).select("lon", "lat")
        assert sorted(map(tuple, compiled.collect())) == sorted(map(tuple, joined.collect())), corners
