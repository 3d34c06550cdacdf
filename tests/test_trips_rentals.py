from datetime import datetime, timedelta

import pytest

from kerbline.filters import Filter
from kerbline.model import SCHEMAS
from kerbline.plans import rentals, trips
from tests.shapes import park_events, square, vehicle_types, zones

DAY = datetime(2024, 3, 20)
F_DAY = Filter(start_time=DAY, end_time=DAY + timedelta(days=1), zone_ids=(1, 2))
IN_1, IN_2, OUT = (4.5, 52.5), (6.5, 52.5), (8.0, 50.0)


@pytest.fixture(scope="module")
def areas(spark):
    return zones(spark, (1, "custom", "GM1", [square(4, 52)]), (2, "custom", "GM1", [square(6, 52)]))


def _trips(spark, *ends, at=DAY + timedelta(hours=1)):
    rows = [(i, "a", "b", 0, *start, *end, at, at + timedelta(minutes=9)) for i, (start, end) in enumerate(ends)]
    return spark.createDataFrame(rows, SCHEMAS["trips"])


def test_a_trip_counts_when_either_end_is_inside(spark, areas):
    found = _trips(spark, (IN_1, OUT), (OUT, IN_2), (OUT, OUT), (IN_1, IN_2))
    rows = trips.trips(found, vehicle_types(spark), areas, F_DAY).collect()
    assert sorted(r["trip_id"] for r in rows) == [0, 1, 3]
    assert [r["trip_id"] for r in rows if r["start_location"]["longitude"] == 8.0] == [1]


def test_trips_must_lie_within_the_period(spark, areas):
    late = _trips(spark, (IN_1, IN_1), at=DAY + timedelta(hours=23, minutes=55))
    exact = _trips(spark, (IN_1, IN_1), at=DAY + timedelta(hours=23, minutes=51))
    assert trips.trips(late, vehicle_types(spark), areas, F_DAY).count() == 0
    assert trips.trips(exact, vehicle_types(spark), areas, F_DAY).count() == 1


def test_origins_and_destinations_hide_the_vehicle(spark, areas):
    found = _trips(spark, (IN_1, OUT), (OUT, IN_2))
    (origin,) = trips.trip_origins(found, vehicle_types(spark), areas, F_DAY).collect()
    (destination,) = trips.trip_destinations(found, vehicle_types(spark), areas, F_DAY).collect()
    assert origin["location"]["longitude"] == 4.5 and destination["location"]["longitude"] == 6.5
    assert "bike_id" not in origin and origin["distance_in_meters"] % 100 == 0
    assert destination["event_time"] - origin["event_time"] == timedelta(minutes=9)


def test_zones_where_trips_only_end_keep_their_count(spark, areas):
    rows = trips.trip_stats(_trips(spark, (OUT, IN_2), (OUT, IN_2)), areas, F_DAY).collect()
    assert {r["zone_id"]: r["number_of_trips"] for r in rows} == {1: [0, 0], 2: [0, 2]}
    assert rows[0]["zone"]["zone_type"] == "custom"


def _events(spark):
    hour = timedelta(hours=1)
    return park_events(spark, (1, "a", "b", 0, *IN_1, DAY - hour, DAY + hour), (2, "a", "b", 0, *IN_1, DAY + hour, None),
                       (3, "a", "b", 0, *IN_1, DAY, DAY + 2 * hour), (4, "a", "b", 0, *OUT, DAY, DAY + hour))


def test_rentals_start_where_parking_ends(spark, areas):
    starts = rentals.rental_starts(_events(spark), areas, F_DAY).collect()
    ends = rentals.rental_ends(_events(spark), areas, F_DAY).collect()
    assert sorted(r["departure_time"] for r in starts) == [DAY - timedelta(hours=1), DAY]
    assert sorted((r["arrival_time"] for r in ends), key=str) == [DAY + timedelta(hours=2), None]


def test_rental_stats_are_zero_not_null(spark, areas):
    rows = rentals.rental_zone_stats(_events(spark), areas, F_DAY).collect()
    assert {r["zone_id"]: r["number_of_trips"] for r in rows} == {1: [2, 2], 2: [0, 0]}
