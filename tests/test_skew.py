"""Keys that hold a third of all rows, and how the work is spread."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window, functions as F

from kerbline.model import SCHEMAS
from kerbline.operators.lookup import fits_broadcast, lookup_join, measured_salts, row_salt, spread_join
from kerbline.operators.skew import latest, with_previous
from kerbline.plans import detections
from tests.shapes import square, zones


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(1500):
        bike = "hot" if i % 3 == 0 else f"bike_{rng.randint(0, 60)}"
        at = start + timedelta(seconds=rng.choice((rng.randint(0, 8), rng.randint(0, 400_000))))
        rows.append((i, bike, "a", rng.uniform(4, 4.1), rng.uniform(52, 52.1), at, False, False))
    return spark.createDataFrame(rows, SCHEMAS["bike_detection"]).repartition(6)


@pytest.mark.parametrize("cut", ["minute", "hour", "day", "year"])
def test_previous_row_equals_a_plain_lag(skewed, cut):
    window = Window.partitionBy("bike_id").orderBy("last_time_imported", "sample_id")
    plain = skewed.select("sample_id", F.lag("lon").over(window).alias("lon"), F.lag("lat").over(window).alias("lat"))
    sliced = with_previous(skewed, "bike_id", ["last_time_imported", "sample_id"], ["lon", "lat"],
                           F.date_trunc(cut, "last_time_imported")).select("sample_id", "previous_lon", "previous_lat")
    assert sorted(map(tuple, sliced.collect())) == sorted(map(tuple, plain.collect()))


def test_latest_takes_the_higher_sample_on_a_tie(spark):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, "b", "a", 1.0, 1.0, at, False, False), (2, "b", "a", 2.0, 2.0, at, False, False),
                                (3, "b", "a", 3.0, 3.0, at - timedelta(1), False, False)], SCHEMAS["bike_detection"])
    (row,) = latest(df, "bike_id", "last_time_imported", "sample_id").collect()
    assert row["sample_id"] == 2


def test_latest_equals_a_ranking_in_both_forms(spark, skewed):
    odd = spark.createDataFrame([(9001, None, "a", 4.0, 52.0, datetime(2024, 1, 1), True, None), (9002, None, "a", 4.0, 52.0, datetime(1960, 1, 1), True, None),
                                 (9003, "untimed", "a", 4.0, 52.0, None, None, None), (9003, "untimed", "a", 4.0, 52.0, None, None, None)], skewed.schema)
    rows = skewed.unionByName(odd)
    window = Window.partitionBy("bike_id").orderBy(F.desc_nulls_last("last_time_imported"), F.desc("sample_id"))
    ranked = rows.withColumn("r", F.row_number().over(window)).where("r = 1").drop("r")
    expected = sorted(map(str, ranked.collect()))
    small = latest(rows, "bike_id", "last_time_imported", "sample_id")
    assert sorted(map(str, small.collect())) == expected and "SortAggregate" not in small._jdf.queryExecution().executedPlan().toString()
    large = latest(rows, "bike_id", "last_time_imported", "sample_id", max_keys=5)
    assert sorted(map(str, large.collect())) == expected


def test_movements_compare_one_vehicle_only(spark):
    at = datetime(2024, 1, 1)
    rows = [(1, "a", "s", 4.0, 52.0, at, False, False), (2, "b", "s", 5.0, 52.0, at + timedelta(1), False, False),
            (3, "a", "s", 4.001, 52.0, at + timedelta(2), False, False),
            (4, "a", "s", 4.01, 52.0, at + timedelta(3), False, False)]
    found = detections.movements(spark.createDataFrame(rows, SCHEMAS["bike_detection"])).collect()
    assert [r["sample_id"] for r in found] == [4]
    assert found[0]["distance"] == pytest.approx(616, abs=1)


def test_municipality_filter_comes_before_the_ranking(spark):
    at = datetime(2024, 1, 1)
    rows = [(1, "a", "s", 4.5, 52.5, at, False, False), (2, "a", "s", 9.0, 52.5, at + timedelta(1), False, False)]
    df = spark.createDataFrame(rows, SCHEMAS["bike_detection"])
    areas = zones(spark, (1, "municipality", "GM1", [square(4, 52)])).selectExpr("municipality as gm_code", "rings")
    assert [r["last_time_imported"] for r in detections.latest_positions(df, areas, "GM1").collect()] == [at]
    assert detections.positions_in_municipality(detections.snapshot(df), areas, "GM1").count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_a_plain_join(spark, skewed, how):
    other = spark.createDataFrame([("hot", 1), ("bike_3", 2), ("bike_3", 3), ("absent", 4)], "bike_id string, v int")
    def rows(df):
        return sorted(map(str, df.select(sorted(df.columns)).collect()))
    plain = rows(skewed.join(other, "bike_id", how))
    assert measured_salts(skewed, F.xxhash64("bike_id"), 100).by_code
    assert rows(spread_join(skewed, other, "bike_id", how, hot_rows=100)) == plain
    assert rows(spread_join(skewed, other, "bike_id", how)) == plain
    assert rows(lookup_join(skewed, other, "bike_id", how)) == plain
    assert rows(lookup_join(skewed, other, "bike_id", how, max_rows=1)) == plain


def test_a_hot_key_goes_to_many_tasks(skewed):
    hot = skewed.where("bike_id = 'hot'")
    sizes = [r["count"] for r in hot.groupBy(row_salt(hot, 8)).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * hot.count() / 8


def test_the_size_check(spark):
    assert fits_broadcast(spark.range(10), 10) and not fits_broadcast(spark.range(11), 10)
