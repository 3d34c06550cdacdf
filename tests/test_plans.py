"""What the plans look like: pruned scans, no nested loops, no repeated work."""

import re
from datetime import datetime

import pytest

from checks.queries import ALL_ZONES, CHOSEN_ZONES, POLYGON, QUERIES
from kerbline.filters import Filter
from kerbline.operators.spatial import build_grid, containing_polygons, either_in_any_polygon
from kerbline.plans import park, trips
from kerbline.session import shared_dir
from kerbline.sources import tables
from kerbline.sources.fixtures import Fixtures

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    """The derived tables as Parquet, as a deployment has them."""
    fixtures, found = Fixtures(spark, FOLDER), {}
    for name in ("park_events", "trips", "zones", "vehicle_type"):
        path = shared_dir(spark, name)
        df = fixtures.table(name)
        df.coalesce(1).write.parquet(path)
        found[name] = tables.load(spark, name, path)
    return found


AT = Filter(timestamp=datetime(2001, 6, 15, 12), zone_ids=(1, 7), operators=("op_1",))


def _scan(text, column):
    (line,) = {line for line in text.splitlines() if "FileScan" in line and f"{column}#" in line}
    return line


def test_filters_and_columns_reach_the_reader(stored):
    df = park.park_event_stats(stored["park_events"], stored["vehicle_type"], stored["zones"], AT)
    line = _scan(plan(df), "start_time")
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", line).group(1)
    for part in ("LessThan(start_time", "Or(GreaterThan(end_time", "EqualTo(system_id,op_1)",
                 "GreaterThanOrEqual(lon", "LessThanOrEqual(lat"):
        assert part in pushed, (part, pushed)
    schema = line.split("ReadSchema:")[1]
    assert "bike_id" not in schema and "vehicle_type_id" not in schema and "start_time" in schema


def test_a_drawn_polygon_is_compiled_and_its_box_pushed(stored):
    f = Filter(timestamp=AT.timestamp, geojson=POLYGON)
    text = plan(park.park_count(stored["park_events"], stored["vehicle_type"], f))
    line = _scan(text, "start_time")
    assert "GreaterThanOrEqual(lon,4.1)" in line and "LessThanOrEqual(lat,52.3)" in line
    assert "aggregate(" not in text


def test_either_end_reads_the_trips_once(stored):
    f = Filter.from_args({"start_time": "1998-01-01", "end_time": "1999-12-31", **CHOSEN_ZONES})
    text = plan(trips.trips(stored["trips"], stored["vehicle_type"], stored["zones"], f))
    assert len([line for line in text.splitlines() if "FileScan" in line and "start_lon" in line]) == 1
    assert text.count("ExistenceJoin") == 2 and "NestedLoop" not in text


def test_zone_counts_shuffle_counts_only(stored):
    f = Filter.from_args({"start_time": "1998-01-01", "end_time": "1999-12-31", **ALL_ZONES})
    text = plan(trips.trip_stats(stored["trips"], stored["zones"], f))
    assert len([line for line in text.splitlines() if "FileScan" in line and "start_lon" in line]) == 1
    assert text.count("Exchange hashpartitioning(zone_id") == 1
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text


def test_points_are_shuffled_only_beyond_the_limit(spark, stored):
    points = stored["park_events"].select("lon", "lat")
    small = plan(containing_polygons(points, build_grid(stored["zones"])))
    assert "BroadcastHashJoin" in small and "Exchange hashpartitioning" not in small
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = plan(containing_polygons(points, build_grid(stored["zones"], broadcast_items=10)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning(_cell_x" in large and "Broadcast" not in large and "NestedLoop" not in large


def test_either_end_beyond_the_limit_joins_by_cell(stored):
    grid = build_grid(stored["zones"], broadcast_items=10)
    text = plan(either_in_any_polygon(stored["trips"], grid, trips.START, trips.END))
    assert "ExistenceJoin" not in text and "NestedLoop" not in text and text.count("LeftAnti") == 1


def test_detections_are_shuffled_once_per_slice(spark):
    df = QUERIES["movements"](spark, FOLDER)
    df.collect()
    assert "ReusedExchange" in plan(df)
