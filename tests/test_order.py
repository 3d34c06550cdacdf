"""Results whose order is part of the answer: rows as they are returned."""

from checks.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def _rows(spark, name, *columns):
    return [tuple(r[c] for c in columns) for r in QUERIES[name](spark, FOLDER).collect()]


def test_series_come_by_bucket_and_name(spark):
    for name, columns in (("rental_series_hour", ("bucket", "system_id", "modality")), ("availability_by_operator", ("bucket", "name")),
                          ("availability_by_modality", ("bucket", "name"))):
        rows = _rows(spark, name, *columns)
        assert len(rows) > 10 and rows == sorted(rows)


def test_periods_come_with_their_operators(spark):
    for name in ("available_vehicles_week", "rentals_month"):
        rows = _rows(spark, name, "time_period", "system_id")
        assert len(rows) > 2 and rows == sorted(rows)


def test_municipalities_come_by_name(spark):
    names = [r[0] for r in _rows(spark, "municipalities", "name")]
    assert len(names) == 5 and names == sorted(names)


def test_report_triples_come_by_mean(spark):
    rows = _rows(spark, "report_triples", "avg", "zone_ref", "stat_description", "system_id")
    assert len(rows) > 2 and rows == sorted(rows)
