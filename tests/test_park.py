import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kerbline.filters import Filter
from kerbline.plans import park
from kerbline.session import shared_dir
from kerbline.sources import sinks
from tests.shapes import park_events, square, vehicle_types, zones

AT = datetime(2024, 3, 20, 12)


def _parked(number, age=timedelta(hours=1), lon=4.5, lat=52.5, kind=0, operator="a", bike="b"):
    return (number, operator, bike, kind, lon, lat, AT - age, None)


@pytest.fixture(scope="module")
def areas(spark):
    return zones(spark, (1, "residential_area", "GM1", [square(4, 52)]), (2, "custom", "GM1", [square(4.25, 52.25)]),
                 (3, "custom", "GM1", [square(9, 50)]))


def test_age_limits(spark, areas):
    second = timedelta(seconds=1)
    ages = [timedelta(days=d) + delta for d in (2, 4, 7, 14) for delta in (-second, timedelta(0))]
    events = park_events(spark, *(_parked(i, age, 4.1, 52.1) for i, age in enumerate(ages)))
    f = Filter(timestamp=AT, zone_ids=(1,))
    (row,) = park.park_event_stats(events, vehicle_types(spark), areas, f).collect()
    assert row["stats"] == [1, 2, 2, 2, 1]


def test_histogram_counts_a_vehicle_in_every_zone_and_keeps_empty_zones(spark, areas):
    events = park_events(spark, _parked(1), _parked(2, lon=4.1), _parked(3, kind=None))
    f = Filter(timestamp=AT, zone_ids=(1, 2, 3))
    found = {r["zone_id"]: r["stats"] for r in park.park_event_stats(events, vehicle_types(spark), areas, f).collect()}
    assert found == {1: [3, 0, 0, 0, 0], 2: [2, 0, 0, 0, 0], 3: [0, 0, 0, 0, 0]}


def test_histogram_without_zones_is_empty(spark, areas):
    events = park_events(spark, _parked(1))
    assert park.park_event_stats(events, vehicle_types(spark), areas, Filter(timestamp=AT)).count() == 0


def test_unmatched_types_pass_only_as_unknown(spark, areas):
    events = park_events(spark, _parked(1, kind=0), _parked(2, kind=9), _parked(3, kind=None))
    def found(*names):
        f = Filter(timestamp=AT, form_factors=names)
        return park.park_events_at(events, vehicle_types(spark), areas, f).count()
    assert (found("bicycle"), found("bicycle", "unknown"), found("unknown"), found()) == (1, 3, 2, 3)


def test_overlapping_zones_give_one_document(spark, areas):
    events = park_events(spark, _parked(1))
    f = Filter(timestamp=AT, zone_ids=(1, 2))
    (row,) = park.park_events_at(events, vehicle_types(spark), areas, f).collect()
    assert (row["location"]["latitude"], row["location"]["longitude"]) == (52.5, 4.5)


def test_public_document_hides_the_vehicle(spark, areas):
    found = park.public_vehicles(park_events(spark, _parked(1)), vehicle_types(spark), areas, Filter(), AT)
    assert found.columns == ["system_id", "location", "form_factor"] and found.count() == 1


@pytest.mark.parametrize("corners", [1000, 2])
def test_count_in_a_drawn_polygon(spark, monkeypatch, corners):
    """Compiled into the filter, and joined as a zone."""
    monkeypatch.setattr(park, "COMPILED_CORNERS", corners)
    events = park_events(spark, _parked(1), _parked(2, kind=1), _parked(3, kind=9), _parked(4, kind=None),
                         _parked(5, bike=None), _parked(6, lon=4.0), _parked(7, lon=8.0))
    shape = json.dumps({"type": "Polygon", "coordinates": [square(4, 52)]})
    rows = park.park_count(events, vehicle_types(spark), Filter(timestamp=AT, geojson=shape)).collect()
    assert {r["form_factor"]: r["number_of_parked_vehicles"] for r in rows} == {"bicycle": 1, "moped": 1, None: 2}


def test_occupancy_nests_operators_and_keeps_empty_zones(spark, areas):
    events = park_events(spark, _parked(1, operator="b"), _parked(2, operator="a"), _parked(3, operator="a"),
                         (4, "a", "b", 0, 4.5, 52.5, AT, AT))
    public = spark.createDataFrame([(1, "one", 10), (3, "three", None)], "zone_id bigint, name string, capacity bigint")
    rows = {r["zone_id"]: r for r in park.zone_occupancy(events, areas, public).collect()}
    assert [tuple(o) for o in rows[1]["operators"]] == [("a", 2), ("b", 1)] and rows[1]["capacity"] == 10
    assert rows[3]["operators"] == [] and rows[3]["capacity"] is None
    assert json.loads(rows[1]["geojson"])["coordinates"] == [[list(p) for p in square(4.0, 52.0)]]


def test_date_index_finds_the_same_events(spark):
    rows = [(i * 40_000, "a", "b", 0, 4.0, 52.0, AT - timedelta(hours=i), None if i % 3 else AT + timedelta(hours=i - 5))
            for i in range(60)]
    events, f = park_events(spark, *rows), Filter(timestamp=AT)
    index = park.build_date_index(events, AT + timedelta(days=3))
    direct = {r[0] for r in events.where(f.parked_at_instant()).select("park_event_id").collect()}
    assert {r[0] for r in park.events_by_date_index(events, index, f).select("park_event_id").collect()} == direct
    for row in index.collect():
        assert all(i >> park.INDEX_RUN_BITS == row["chunk"] for i in row["park_event_ids"])


def test_day_index_prunes_the_days_of_a_stored_table(spark):
    rows = [(i, "a", "b", 0, 4.0, 52.0, AT - timedelta(days=i), AT - timedelta(days=i) + timedelta(hours=1) if i % 7 else None)
            for i in range(1, 40)]
    rows += [(100, "a", "b", 0, 4.0, 52.0, AT + timedelta(days=90), None),  # open, after the horizon
             (101, "a", "b", 0, 4.0, 52.0, AT, AT - timedelta(days=2))]  # ends before it starts
    events, f = park_events(spark, *rows), Filter(timestamp=AT)
    until = AT + timedelta(days=3)
    assert park.build_date_index(events, until).where("exists(park_event_ids, x -> x >= 100)").count() == 0
    days, path = park.build_day_index(events, until), shared_dir(spark, "by-day")
    sinks.export_by_date(events, path)
    found = park.park_events_through_days(spark.read.parquet(path), days, f)
    assert {r["park_event_id"] for r in found.collect()} == {7, 14, 21, 28, 35}
    scan = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line]
    assert any("dynamicpruning" in line for line in scan)


def test_bitmap_index_finds_the_same_events(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        start = AT - timedelta(minutes=rng.randrange(-20_000, 300_000))
        rows.append((i * 997 % 100_000, "a", "b", 0, 4.0, 52.0, start, None if i % 7 == 0 else start + timedelta(minutes=int(2 ** rng.uniform(0, 18)))))
    rows.append((100_001, "a", "b", 0, 4.0, 52.0, AT, AT - timedelta(days=2)))
    events, until = park_events(spark, *rows), AT + timedelta(days=40)
    path = shared_dir(spark, "bitmaps")
    park.build_bitmap_index(events, until).write.partitionBy("level").parquet(path)
    index = spark.read.parquet(path)
    # a bitmap a bucket and block, however many days an event touches
    assert index.where("bucket is null or octet_length(ids) <> 4096").count() == 0
    lists = park.build_date_index(events, until)
    for days in (0, -30, -100, 10, 39, 500):
        f = Filter(timestamp=AT + timedelta(days=days))
        found = sorted(r["park_event_id"] for r in park.events_by_bitmap_index(events, index, f).collect())
        assert found == sorted(r["park_event_id"] for r in park.events_by_date_index(events, lists, f).collect())
        assert found == sorted(r["park_event_id"] for r in park.events_by_bitmap_index(events, index, f, max_bitmaps=0).collect())
    used = park.build_bitmap_index(events.limit(1), until).agg(F.bitmap_or_agg("ids")).count()
    assert used == 1


def test_blocks_of_an_event_are_its_days(spark):
    """Every day that an event touches is in exactly one of its blocks, and there are few."""
    rng = random.Random(8)
    rows = [(i + 1, "a", "b", 0, 4.0, 52.0, AT + timedelta(days=rng.randrange(-30_000, 0)), None) for i in range(50)]
    rows = [(*r[:7], r[6] + timedelta(days=rng.choice([0, 1, 5, 100, 9000]))) for r in rows]
    blocks = {}
    index = park.build_bitmap_index(park_events(spark, *rows), AT + timedelta(days=90_000))
    for r in index.collect():
        assert r["bucket"] == 1  # where the first positive ids are
        for i in range(50):
            if r["ids"][i // 8] >> i % 8 & 1:
                blocks.setdefault(i, []).append((r["level"], r["block"]))
    for i, *_, start, end in ((r[0], r[6], r[7]) for r in rows):
        days = [d for level, block in blocks[i] for d in range(block << level, (block + 1) << level)]
        first, last = ((t.date() - datetime(1970, 1, 1).date()).days for t in (start, end))
        assert sorted(days) == list(range(first, last + 1)) and len(blocks[i]) <= 2 * max(1, (last - first + 1).bit_length())
