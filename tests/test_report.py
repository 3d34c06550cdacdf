from datetime import date, datetime

import pytest

from kerbline import model
from kerbline.filters import Filter
from kerbline.model import SCHEMAS
from kerbline.plans import report

F_REPORT = Filter(gm_code="GM1", start_time=datetime(2024, 1, 1), end_time=datetime(2024, 1, 10))


@pytest.fixture(scope="module")
def tables(spark):
    zones = spark.createDataFrame([
        (1, "town", None, "GM1", "municipality", "m", None), (2, "east", None, "GM1", "residential_area", "e", None),
        (3, "west", None, "GM1", "residential_area", "w", None), (4, "drawn", None, "GM1", "custom", None, None),
        (5, "other", None, "GM2", "municipality", "x", None)], SCHEMAS["zones"])
    day = date(2024, 1, 5)
    stats = spark.createDataFrame([
        (day, "m", model.VEHICLES_AVAILABLE, "a", 40), (date(2024, 1, 6), "m", model.VEHICLES_AVAILABLE, "a", 60),
        (day, "m", model.TRIPS_STARTED, "a", 20), (day, "m", model.TRIPS_ENDED, "a", 4),
        (day, "m", model.TRIP_DURATION, "a", 1200), (day, "m", model.LONGER_THAN_24_HOURS, "a", 50),
        (day, "m", model.LONGER_THAN_4_DAYS, "a", 25), (day, "m", model.LONGER_THAN_7_DAYS, "a", 10),
        (day, "e", model.TRIPS_STARTED, "b", 7), (day, "w", model.TRIPS_STARTED, "", 9),
        (day, "x", model.TRIPS_STARTED, "c", 9), (date(2024, 2, 1), "m", model.TRIPS_STARTED, "d", 9)],
        SCHEMAS["stats_pre_process"])
    return stats, zones


def test_formulas(tables):
    row = report.indicators(*tables, F_REPORT).where("zone_ref = 'm' and system_id = 'a'").first()
    assert [row[letter] for letter in "abcdefghij"] == pytest.approx([10, 2, 0.2, 5, 0.5, 2.5, 0.25, 1, 0.1, 5])


def test_ratios_without_divisor_are_zero(tables):
    row = report.indicators(*tables, F_REPORT).where("zone_ref = 'e'").first()
    assert row["b"] == pytest.approx(0.7) and [row[letter] for letter in "acegij"] == [0] * 6


def test_report_has_every_report_zone_for_every_active_operator(tables):
    rows = report.sheet_order(report.report(*tables, F_REPORT)).collect()
    assert [(r["system_id"], r["name"]) for r in rows] == [
        (operator, name) for operator in ("", "a", "b") for name in ("town", "east", "west")]
    assert [r["name"] for r in rows if r["b"] is not None] == ["west", "town", "east"]


def test_operator_filter_keeps_the_row_of_all_operators(tables):
    f = Filter(**{**F_REPORT.__dict__, "operators": ("b",)})
    assert {r[0] for r in report.active_operators(*tables, f).collect()} == {"b", ""}
    assert {r["system_id"] for r in report.report_triples(*tables, f).collect()} == {"b", ""}


def test_triples(tables):
    row = report.report_triples(*tables, F_REPORT).where(f"stat_description = '{model.VEHICLES_AVAILABLE}'").first()
    assert (row["avg"], row["count"], row["sum"]) == (50.0, 2, 100)


def test_file_name():
    assert report.file_name(F_REPORT) == "report_2024-01-01_2024-01-10_GM1"
