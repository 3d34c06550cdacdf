"""The interval index: every instant finds what a scan finds, and reads few folders."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kerbline.filters import Filter
from kerbline.model import SCHEMAS
from kerbline.operators.intervals import BEGIN, LENGTH, load_intervals, may_hold, store_intervals, with_interval_keys
from kerbline.plans import park
from kerbline.session import shared_dir
from tests.shapes import park_events, square, vehicle_types, zones

AT = datetime(2024, 3, 20, 12)
DAY = timedelta(days=1)


@pytest.fixture(scope="module")
def stored(spark):
    """Two years of intervals from minutes to months, some open, some that end before they begin."""
    rng = random.Random(3)
    rows = []
    for i in range(600):
        start = AT + timedelta(minutes=rng.randrange(-600 * 1440, 130 * 1440))
        length = timedelta(minutes=int(2 ** rng.uniform(0, 19)))
        end = None if i % 23 == 0 else start - length if i % 29 == 0 else start + length
        rows.append((i, "a", f"b{i}", i % 4, 4.1 + i % 7, 52.5, start, end))
    rows += [(1000 + c, "a", "x", 0, 4.5, 52.5, AT - DAY * 2**c, AT + d) for c in range(9) for d in (timedelta(0), timedelta(microseconds=1))]
    rows += [(2000, "a", "x", 0, 4.5, 52.5, None, None), (2001, "a", "x", 0, 4.5, 52.5, None, AT)]
    events = park_events(spark, *rows)
    path = shared_dir(spark, "intervals")
    store_intervals(events, path)
    return events, load_intervals(spark, path, SCHEMAS["park_events"])


def test_classes_and_buckets(spark):
    at = datetime(1970, 1, 9)
    rows = [(1, at, at + DAY), (2, at, at + DAY + timedelta(microseconds=1)), (3, at, at + 2 * DAY), (4, at, at + 3 * DAY), (5, at, None), (6, at, at - DAY),
            (7, at - 20 * DAY, at + 20 * DAY)]
    df = with_interval_keys(spark.createDataFrame(rows, "id int, start_time timestamp_ntz, end_time timestamp_ntz"))
    assert {r["id"]: (r[LENGTH], r[BEGIN]) for r in df.collect()} == {1: (0, 0), 2: (1, 0), 3: (1, 0), 4: (2, 0), 5: (-1, 0), 6: (0, 0), 7: (6, -1)}


@pytest.mark.parametrize("shift", [timedelta(0), -DAY * 300, timedelta(days=131), timedelta(hours=-12), timedelta(days=-1000)])
def test_every_instant_finds_what_a_scan_finds(spark, stored, shift):
    events, history = stored
    f = Filter(timestamp=AT + shift)
    none = zones(spark)
    direct, indexed = (sorted(map(str, park.park_events_at(t, vehicle_types(spark), none, f).collect())) for t in (events, history))
    assert direct == indexed


def test_few_folders_are_read(stored):
    _, history = stored
    at = AT - 200 * DAY
    plan = park._parked(history, Filter(timestamp=at))._jdf.queryExecution().executedPlan().toString()
    partition = plan.split("PartitionFilters: [")[1].split("], PushedFilters")[0]
    assert f"({LENGTH}#" in partition and f"{BEGIN}#" in partition
    # the filter is on the keys alone, so what passes it is what is read
    read = history.where(may_hold(at)).select(LENGTH, BEGIN).distinct().collect()
    every = history.where(F.col(LENGTH) >= 0).select(LENGTH, BEGIN).distinct().count()
    closed = [r for r in read if r[LENGTH] >= 0]
    assert len(closed) <= 2 * len({r[LENGTH] for r in closed}) and 0 < len(closed) < every / 4


def test_the_age_of_the_instant_chooses_the_table(spark, stored):
    events, history = stored
    ago = Filter(timestamp=AT)
    assert park.source_at(events, history, ago, AT + park.RECENT) is events
    assert park.source_at(events, history, ago, AT + park.RECENT + timedelta(seconds=1)) is history


def test_count_and_histogram_from_the_history(spark, stored):
    events, history = stored
    areas = zones(spark, (1, "custom", "GM1", [square(4, 52)]), (2, "custom", "GM1", [square(6, 52, 2)]))
    f = Filter(timestamp=AT, zone_ids=(1, 2), form_factors=("bicycle", "unknown"))
    one, two = (sorted(park.park_event_stats(t, vehicle_types(spark), areas, f).collect()) for t in (events, history))
    assert one == two and sum(one[0]["stats"]) > 0
    f = Filter(timestamp=AT, geojson='{"type": "Polygon", "coordinates": [[[4, 52], [9, 52], [9, 53], [4, 53], [4, 52]]]}')
    one, two = (sorted(map(str, park.park_count(t, vehicle_types(spark), f).collect())) for t in (events, history))
    assert one == two
