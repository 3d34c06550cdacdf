from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kerbline.filters import Filter
from kerbline.functions.calendar import LEVELS, calendar, days_in_period, hours_between, level
from kerbline.model import SCHEMAS
from kerbline.operators.gapfill import gap_fill
from kerbline.plans import series, statistics

T = datetime(2024, 2, 29, 23, 17, 42)


@pytest.mark.parametrize("name,expected", [
    ("5m", datetime(2024, 2, 29, 23, 15)), ("15m", datetime(2024, 2, 29, 23, 15)), ("hour", datetime(2024, 2, 29, 23)),
    ("day", datetime(2024, 2, 29)), ("week", datetime(2024, 2, 26)), ("month", datetime(2024, 2, 1))])
def test_buckets_of_columns_and_constants_agree(spark, name, expected):
    df = spark.createDataFrame([(T,)], "t timestamp_ntz")
    assert df.select(LEVELS[name].bucket(F.col("t"))).first()[0] == expected
    assert df.select(LEVELS[name].floor(T)).first()[0] == expected


def test_unknown_level_is_an_error():
    for call in (lambda: level("year"), lambda: level("hour", ("day", "week", "month"))):
        with pytest.raises(ValueError):
            call()


def test_calendar_has_both_ends(spark):
    rows = [r[0] for r in calendar(spark, date(2024, 2, 28), date(2024, 3, 1)).collect()]
    assert rows == [date(2024, 2, 28), date(2024, 2, 29), date(2024, 3, 1)]
    assert days_in_period(date(2024, 2, 28), date(2024, 3, 1)) == 3


def test_whole_hours(spark):
    df = spark.createDataFrame([(T, T + timedelta(minutes=119))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(hours_between(F.col("a"), F.col("b"))).first()[0] == 1


def test_gaps_before_between_and_after(spark):
    rows = [("a", datetime(2024, 1, 3), 5), ("a", datetime(2024, 1, 5), 7), ("b", datetime(2024, 1, 1), 1)]
    df = spark.createDataFrame(rows, "k string, bucket timestamp_ntz, v bigint")
    unit = LEVELS["day"]
    filled = gap_fill(df, ["k"], "bucket", unit.floor(datetime(2024, 1, 1)), unit.floor(datetime(2024, 1, 6)),
                      unit.interval(), {"v": None})
    assert filled.count() == 12
    assert [r["v"] for r in filled.where("k = 'a'").orderBy("bucket").collect()] == [None, None, 5, None, 7, None]


@pytest.mark.parametrize("name,buckets", [("month", 4), ("week", 14), ("hour", 2136 + 13)])
def test_rental_series_fills_calendar_buckets(spark, name, buckets):
    rows = [(datetime(2024, 1, 31, 5), 1, "a", "car", 3, 1), (datetime(2024, 4, 2), 1, "a", "car", 1, 2),
            (datetime(2024, 3, 1), 9, "z", "car", 1, 2)]
    df = spark.createDataFrame(rows, SCHEMAS["stats_number_of_trips"])
    f = Filter(zone_ids=(1,), start_time=datetime(2024, 1, 5), end_time=datetime(2024, 4, 3, 12, 30))
    found = series.rental_series(df, f, name)
    assert found.count() == buckets
    total = found.agg(F.sum("number_of_trips_started"), F.sum("number_of_trips_ended")).first()
    assert tuple(total) == (4, 3)


def _parked(spark):
    t = datetime(2024, 1, 1)
    rows = [(t, 1, "a", "car", 2), (t + timedelta(minutes=3), 1, "a", "car", 4), (t, 1, "a", "moped", 10),
            (t + timedelta(minutes=10), 2, "b", "car", 1), (t, 3, "c", "car", 99)]
    return spark.createDataFrame(rows, SCHEMAS["stats_number_of_vehicles_parked"])


F_PARKED = Filter(zone_ids=(1, 2), start_time=datetime(2024, 1, 1), end_time=datetime(2024, 1, 1, 0, 12))


@pytest.mark.parametrize("function,amount", [("MIN", 12), ("MAX", 14), ("AVG", 13)])
def test_operator_series_adds_up_modalities(spark, function, amount):
    found = series.availability_series(_parked(spark), F_PARKED, "5m", function, "operator")
    assert {(r["bucket"].minute, r["name"]): r["amount"] for r in found.collect()} == {(0, "a"): amount, (10, "b"): 1}
    last = series.availability_document(found).orderBy("time").collect()[-1]
    assert last["time"].minute == 10 and last["values"] == {"b": 1}


def test_modality_series_has_null_gaps(spark):
    found = series.availability_series(_parked(spark), F_PARKED, "5m", "MAX", "modality").orderBy("name", "bucket")
    assert [(r["name"], r["amount"]) for r in found.collect()] == [
        ("car", 4), ("car", None), ("car", 1), ("moped", 10), ("moped", None), ("moped", None)]


def test_series_arguments_are_checked(spark):
    for arguments in (("5m", "SUM", "operator"), ("5m", "MIN", "zone"), ("year", "MIN", "operator")):
        with pytest.raises(ValueError):
            series.availability_series(_parked(spark), F_PARKED, *arguments)
    with pytest.raises(ValueError):
        series.rental_series(_parked(spark), Filter(zone_ids=(1,)), "hour")


def test_rental_document_keeps_the_last_bucket(spark):
    t = datetime(2024, 1, 1)
    rows = [(t, 1, "a", "car", 1, 2), (t + timedelta(hours=1), 1, "b", "moped", 3, 4)]
    df = spark.createDataFrame(rows, SCHEMAS["stats_number_of_trips"])
    f = Filter(zone_ids=(1,), start_time=t, end_time=t + timedelta(hours=1))
    documents = series.rental_document(series.rental_series(df, f, "hour")).orderBy("time").collect()
    assert len(documents) == 2
    assert documents[1]["values"]["b"]["moped"].asDict() == {"rentals_started": 3, "rentals_ended": 4}
    assert documents[1]["values"]["a"]["car"].asDict() == {"rentals_started": 0, "rentals_ended": 0}


# --- daily statistics -------------------------------------------------------------------------------------------

def _daily(spark, *rows):
    return spark.createDataFrame([(date(2024, 1, day), ref, kind, operator, value)
                                  for day, ref, kind, operator, value in rows], SCHEMAS["stats_pre_process"])


def _zones(spark):
    return spark.createDataFrame([(1, "r1"), (2, "r2"), (3, "r1")], "zone_id bigint, stats_ref string")


F_DAYS = Filter(start_time=datetime(2024, 1, 1), end_time=datetime(2024, 1, 14))
AVAILABLE, STARTED = "number_of_vehicles_available", "number_of_trip_started"


def test_mean_ignores_days_without_rows_and_rounds_half_up(spark):
    stats = _daily(spark, (1, "r2", AVAILABLE, "a", 2), (2, "r2", AVAILABLE, "a", 3), (2, "r2", AVAILABLE, "", 50),
                   (9, "r2", AVAILABLE, "b", 7), (20, "r2", AVAILABLE, "a", 99))
    found = statistics.available_vehicles(stats, _zones(spark), F_DAYS, "week")
    assert {(r["time_period"].day, r["system_id"]): r["value"] for r in found.collect()} == {
        (1, "a"): 3, (8, "a"): 0, (1, "b"): 0, (8, "b"): 7}


def test_zones_that_share_a_reference_repeat_its_values(spark):
    stats = _daily(spark, (1, "r1", STARTED, "a", 5))
    (row,) = statistics.rentals_started(stats, _zones(spark), F_DAYS, "month").collect()
    assert row["value"] == 10


def test_all_periods_survive_the_pivot(spark):
    stats = _daily(spark, (1, "r2", STARTED, "a", 5), (14, "r2", STARTED, "b", 6))
    values = statistics.rentals_started(stats, _zones(spark), F_DAYS, "day")
    assert statistics.pivot_by_operator(values).count() == 14
    last = statistics.pivot_columns(values, ["a", "b"]).orderBy(F.desc("start_interval")).first()
    assert (last["a"], last["b"]) == (0, 6)


def test_missing_days_are_safe_against_null_dates(spark):
    stats = _daily(spark, (3, "r2", STARTED, "a", 5)).unionByName(
        spark.createDataFrame([(None, "r2", STARTED, "a", 1)], SCHEMAS["stats_pre_process"]))
    f = Filter(start_time=datetime(2024, 1, 2), end_time=datetime(2024, 1, 4))
    assert sorted(r[0].day for r in statistics.missing_days(spark, stats, f, STARTED).collect()) == [2, 4]


def test_daily_table_from_rows(spark):
    rows = spark.createDataFrame([(date(2024, 1, 1), "r1", "a", 2), (date(2024, 1, 1), "r1", "a", 3)],
                                 "date date, zone_ref string, system_id string, value bigint")
    (row,) = statistics.aggregate_daily(rows, STARTED).collect()
    assert row["value"] == 5 and row["stat_description"] == STARTED
