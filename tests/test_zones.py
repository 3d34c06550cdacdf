import json
import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from kerbline.filters import Filter
from kerbline.model import RINGS, SCHEMAS
from kerbline.plans import zones as plan
from kerbline.sources import dimensions
from tests.shapes import inside, points, square, zones


@pytest.fixture(scope="module")
def table(spark):
    return zones(spark, (1, "municipality", "GM1", [square(4, 52), square(4.4, 52.4, 0.2)]),
                 (2, "municipality", "GM2", [square(5, 52)]), (3, "custom", "GM1", [square(4, 52, 0.5)]),
                 (4, "residential_area", "GM1", [square(4.5, 52, 0.5)]))


def test_list_drops_retired_zones_and_keeps_unmatched_ones(spark, table):
    geographies = spark.createDataFrame([(1, None), (4, date(2023, 1, 1))], SCHEMAS["geographies"])
    f = Filter(municipalities=("GM1",))
    assert {r["zone_id"] for r in plan.zone_list(table, geographies, f).collect()} == {1, 3}
    assert {r["zone_id"] for r in plan.zone_list(table, geographies, f, include_custom=False).collect()} == {1}
    assert plan.zone_list(table, geographies, Filter()).count() == 0


def test_filters_on_zones_are_both_applied(table):
    rows = plan.zones_with_geometry(table, Filter(zone_ids=(1, 2), municipalities=("GM1",))).collect()
    assert [r["zone_id"] for r in rows] == [1]
    assert len(json.loads(rows[0]["geojson"])["coordinates"]) == 2
    assert plan.zones_with_geometry(table, Filter()).count() == 4


def test_municipality_of_points(spark, table):
    found = plan.municipality_at(points(spark, (4.2, 52.2), (5.0, 52.5), (4.5, 52.5), (9.0, 9.0)), table, ["pid"])
    assert {r["pid"]: r["zone_id"] for r in found.collect()} == {0: 1, 1: 1}
    beyond = points(spark, (5.5, 52.5))
    assert plan.municipality_at(beyond, table, ["pid"]).first()["zone_id"] == 2


def test_area_without_geometry_is_absent(spark):
    areas = spark.createDataFrame([("GM1", [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0},
                                             {"x": 0.0, "y": 0.0}]]), ("GM2", None)], SCHEMAS["municipalities"])
    assert plan.municipality_area(areas, "GM1").count() == 1
    assert plan.municipality_area(areas, "GM2").count() == 0


def _requests(spark, *rings, municipality="GM1"):
    data = [(i + 1, f"drawn {i}", municipality, [[{"x": float(x), "y": float(y)} for x, y in ring]])
            for i, ring in enumerate(rings)]
    return spark.createDataFrame(data, f"request_id bigint, name string, municipality string, rings {RINGS.simpleString()}")


def test_drawn_zones_may_stick_out_a_little(spark, table):
    requests = _requests(spark, square(4.1, 52.1, 0.2), square(3.99, 52.1, 0.2), square(3.97, 52.1, 0.2),
                         square(7, 52), square(4.41, 52.41, 0.18))
    found = {r["request_id"]: r["is_valid"] for r in plan.check_zone_requests(requests, table).collect()}
    # the border of the last one is within the tolerance everywhere, but it holds the middle of the municipality's hole
    assert found == {1: True, 2: True, 3: False, 4: False, 5: False}


def test_drawn_zones_in_and_around_small_holes(spark):
    area = zones(spark, (1, "municipality", "GM1", [square(4, 52), square(4.4, 52.4, 0.03), square(4.7, 52.7, 0.2)]))
    requests = _requests(spark, square(4.3, 52.3, 0.2), square(4.6, 52.6, 0.35), square(4.705, 52.705, 0.01), square(4.78, 52.78, 0.01))
    found = {r["request_id"]: r["is_valid"] for r in plan.check_zone_requests(requests, area).collect()}
    # a hole narrower than the tolerance on both sides does not matter
    assert found == {1: True, 2: False, 3: True, 4: False}


def test_slivers_and_corners_at_the_tolerance(spark, table):
    """What lies between any two points of a border counts, to the last bit of the tolerance."""
    def spike(x, y, reach, half):
        return [(4.2, 52.2), (x, y - half), (x - reach, y), (x, y + half), (4.2, 52.8), (4.2, 52.2)]

    requests = _requests(spark, spike(4.0, 52.5, 0.0199, 1e-6), spike(4.0, 52.5, 0.0201, 1e-6), spike(4.0, 52.5, 0.02, 1e-7),
                         # at a corner of the municipality the border goes round in a circle
                         [(4.1, 52.1), (4.0 - 0.014, 52.0 - 0.014), (4.2, 52.1), (4.1, 52.1)],
                         [(4.1, 52.1), (4.0 - 0.0145, 52.0 - 0.0145), (4.2, 52.1), (4.1, 52.1)],
                         # right through the neighbour, ends well inside
                         [(4.9, 52.5), (4.9, 53.5), (4.8, 52.6), (4.9, 52.5)])
    found = {r["request_id"]: r["is_valid"] for r in plan.check_zone_requests(requests, table).collect()}
    assert found == {1: True, 2: False, 3: True, 4: True, 5: False, 6: False}


def test_containment_equals_fine_sampling(spark):
    """Random drawn zones against a concave municipality, by points a hundredth of the tolerance apart."""
    rng = random.Random(12)
    coast = []
    for i in range(60):
        angle, reach = 2 * math.pi * i / 60, 0.4 + rng.uniform(-0.05, 0.05)
        coast.append((4.5 + reach * math.cos(angle), 52.5 + reach * math.sin(angle)))
    coast.append(coast[0])
    area = zones(spark, (1, "municipality", "GM1", [coast]))
    drawn = []
    for _ in range(40):
        angle, far = rng.uniform(0, 2 * math.pi), rng.uniform(0.33, 0.42)
        x, y = 4.5 + far * math.cos(angle), 52.5 + far * math.sin(angle)
        drawn.append([(x, y), (x + rng.uniform(-0.05, 0.05), y + rng.uniform(-0.05, 0.05)), (4.5, 52.5), (x, y)])

    def away(x, y):
        best = 9.0
        for (x1, y1), (x2, y2) in zip(coast, coast[1:]):
            t = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
            best = min(best, math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1)))
        return best

    def excess(ring):
        out = 0.0
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            for i in range(1500):
                x, y = x1 + (x2 - x1) * i / 1500, y1 + (y2 - y1) * i / 1500
                if not inside([coast], x, y):
                    out = max(out, away(x, y))
        return out

    found = {r["request_id"]: r["is_valid"] for r in plan.check_zone_requests(_requests(spark, *drawn), area).collect()}
    reach = {i + 1: excess(ring) for i, ring in enumerate(drawn)}
    clear = {i for i, r in reach.items() if abs(r - 0.02) > 1e-4}
    assert {i: found[i] for i in clear} == {i: reach[i] <= 0.02 for i in clear} and len(set(found.values())) == 2


def test_unknown_municipality_is_refused(spark, table):
    created, refused = plan.create_zones(table, _requests(spark, square(4.1, 52.1, 0.2), municipality="GM9"))
    assert created.count() == 0 and refused.count() == 1


def test_created_zones_are_custom_and_numbered_after_the_last(spark, table):
    created, refused = plan.create_zones(table, _requests(
        spark, square(4.1, 52.1, 0.2), square(7, 52), square(4.2, 52.1, 0.1)))
    rows = created.orderBy("zone_id").collect()
    assert [(r["request_id"], r["zone_id"], r["zone_type"]) for r in rows] == [(1, 5, "custom"), (3, 6, "custom")]
    assert [r["request_id"] for r in refused.collect()] == [2]
    assert table.unionByName(created.drop("request_id")).count() == 6


def test_numbers_are_consecutive_over_runs(spark):
    df = spark.range(0, 5000, 7).withColumnRenamed("id", "request_id")
    numbered = plan.number_rows(df, "request_id", "zone_id", 100, run_bits=6).orderBy("request_id")
    assert [r["zone_id"] for r in numbered.collect()] == list(range(101, 101 + df.count()))


def test_only_custom_zones_are_deleted(table):
    remaining, deleted = plan.delete_zones(table, [1, 3])
    assert [r["zone_id"] for r in deleted.collect()] == [3]
    assert {r["zone_id"] for r in remaining.collect()} == {1, 2, 4}


def test_static_tables(spark):
    assert dimensions.operators(spark).count() == 21
    public = dimensions.public_zones(spark)
    assert public.count() == 17 and public.where(F.col("capacity").isNull()).count() == 7
