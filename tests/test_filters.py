import json
from datetime import datetime

import pytest

from kerbline.filters import Filter, in_box, keep, operator_present


def test_arguments_are_parsed():
    f = Filter.from_args({"zone_ids": "1,2,101", "operators": "a,b", "form_factors": "moped,unknown",
                          "timestamp": "2001-06-15T12:00:00Z", "start_time": "2024-01-02",
                          "end_time": "2024-01-09T02:00:00+02:00", "gm_code": "GM0001"})
    assert f.zone_ids == (1, 2, 101) and f.operators == ("a", "b")
    assert f.timestamp == datetime(2001, 6, 15, 12)
    assert f.period() == (datetime(2024, 1, 2), datetime(2024, 1, 9))
    assert f.municipalities == ("GM0001",)


def test_explicit_municipalities_replace_the_implied_one():
    f = Filter.from_args({"gm_code": "GM0001", "municipalities": "GM0002,GM0003"})
    assert f.gm_code == "GM0001" and f.municipalities == ("GM0002", "GM0003")


def test_missing_parts_are_errors():
    for part in (Filter().instant, Filter().period, Filter().days):
        with pytest.raises(ValueError):
            part()
    with pytest.raises(ValueError):
        Filter.from_args({"timestamp": "2001-06-15"})
    with pytest.raises(ValueError):
        Filter.from_args({"zone_ids": "1,x"})


def test_json_has_sorted_keys():
    keys = list(json.loads(Filter.from_args({"timestamp": "2001-06-15T12:00:00Z"}).to_json()))
    assert keys == sorted(keys)


def test_absent_parts_do_not_restrict(spark):
    df = spark.createDataFrame([("a", None), (None, "x"), ("", "y")], "system_id string, form_factor string")
    f = Filter()
    assert keep(df, f.by_operator(), f.by_form_factor("form_factor"), f.by_zone()).count() == 3
    assert df.where(operator_present()).count() == 1


def test_unknown_form_factor_means_null(spark):
    df = spark.createDataFrame([("moped",), ("car",), (None,)], "form_factor string")
    def count(names):
        return keep(df, Filter(form_factors=names).by_form_factor()).count()
    assert count(("moped",)) == 1
    assert count(("moped", "unknown")) == 2
    assert count(("unknown",)) == 1


def test_all_operators_row_passes_report_filter(spark):
    df = spark.createDataFrame([("a",), ("b",), ("",)], "system_id string")
    assert keep(df, Filter(operators=("a",)).by_operator_or_all()).count() == 2
    assert keep(df, Filter().by_operator_or_all()).count() == 3


def test_instant_is_strict_on_both_ends(spark):
    df = spark.sql("""SELECT * FROM VALUES
        (1, timestamp_ntz'2001-06-15 12:00:00', cast(null as timestamp_ntz)),
        (2, timestamp_ntz'2001-06-15 11:59:59', timestamp_ntz'2001-06-15 12:00:00'),
        (3, timestamp_ntz'2001-06-15 11:59:59', timestamp_ntz'2001-06-15 12:00:01'),
        (4, timestamp_ntz'2001-06-01 00:00:00', cast(null as timestamp_ntz)) AS t(id, start_time, end_time)""")
    f = Filter(timestamp=datetime(2001, 6, 15, 12))
    assert {r["id"] for r in df.where(f.parked_at_instant()).collect()} == {3, 4}


def test_periods_include_both_ends(spark):
    df = spark.sql("""SELECT * FROM VALUES
        (1, timestamp_ntz'2024-01-02 00:00:00', timestamp_ntz'2024-01-03 00:00:00'),
        (2, timestamp_ntz'2024-01-01 23:59:59', timestamp_ntz'2024-01-03 00:00:00'),
        (3, timestamp_ntz'2024-01-02 00:00:00', timestamp_ntz'2024-01-03 00:00:01') AS t(id, start_time, end_time)""")
    f = Filter(start_time=datetime(2024, 1, 2), end_time=datetime(2024, 1, 3))
    assert {r["id"] for r in df.where(f.contained_in_period()).collect()} == {1}
    assert {r["id"] for r in df.where(f.in_period("end_time")).collect()} == {1, 2}
    assert {r["id"] for r in df.where(f.in_period("start_time")).collect()} == {1, 3}


def test_box_includes_its_edges(spark):
    df = spark.createDataFrame([(4.0, 50.0), (5.0, 51.0), (5.1, 51.0)], "lon double, lat double")
    assert df.where(in_box(4.0, 50.0, 5.0, 51.0)).count() == 2
