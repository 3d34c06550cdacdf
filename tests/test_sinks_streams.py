import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kerbline.filters import Filter
from kerbline.model import SCHEMAS
from kerbline.plans import exports, feeds, park, rentals
from kerbline.plans.series import rental_series
from kerbline.session import shared_dir
from kerbline.sources import sinks, tables
from kerbline.streaming import streams
from tests.shapes import vehicle_types

NOW = datetime(2024, 1, 30, 12)


def _visits(spark, *rows):
    return spark.createDataFrame(list(rows), "user_id string, role string, visited_at timestamp_ntz")


def test_active_users_are_stored_once_per_day(spark):
    path = shared_dir(spark, "users")
    day = datetime(2024, 1, 1, 9)
    rows = exports.active_users(_visits(spark, ("a", "admin", day), ("a", "admin", day + timedelta(hours=1)),
                                        ("", None, day), (None, None, day), ("b", None, day)), ":salt")
    sinks.append(rows, path, "active_on")
    january = (date(2024, 1, 1), date(2024, 1, 31))
    assert sinks.append_if_absent(rows, path, ["user_hash", "active_on"], "active_on", *january) == 0
    later = exports.active_users(_visits(spark, ("a", "admin", day), ("a", "admin", day + timedelta(days=1))), ":salt")
    assert sinks.append_if_absent(later, path, ["user_hash", "active_on"], "active_on", *january) == 1
    with pytest.raises(Exception, match="another day"):
        sinks.append_if_absent(later, path, ["user_hash", "active_on"], "active_on", date(2024, 1, 2), date(2024, 1, 31))
    assert sinks.days_of(later, "active_on") == (date(2024, 1, 1), date(2024, 1, 2)) and sinks.days_of(later.where("false"), "active_on") is None
    stored = spark.read.parquet(path)
    assert stored.count() == 3
    import hashlib
    expected = hashlib.sha1(b"a:salt").hexdigest()
    assert stored.where(F.col("user_hash") == expected).count() == 2


def test_audit_rows_hold_the_filter_as_sorted_json(spark):
    requests = spark.createDataFrame([("u", "/raw", "1,2", None)], "user_id string, raw_api_call string, zones string, operators string")
    (row,) = exports.audit_rows(requests, NOW).collect()
    assert row["timestamp_accessed"] == NOW and json.loads(row["filter_active"]) == {"zones": "1,2"}


def test_export_by_date_prunes_partitions(spark):
    path = shared_dir(spark, "export")
    rows = [(i, "a", "b", 0, 4.0, 52.0, datetime(2024, 1, 1 + i % 3), None) for i in range(30)]
    sinks.export_by_date(spark.createDataFrame(rows, SCHEMAS["park_events"]), path)
    back = spark.read.parquet(path)
    assert back.count() == 30 and set(back.columns) == {*SCHEMAS["park_events"].fieldNames(), "start_date"}
    for plan in (rentals.rental_ends(back, None, Filter(start_time=datetime(2024, 1, 2), end_time=datetime(2024, 1, 2))),
                 park.park_events_at(back, vehicle_types(spark), None, Filter(timestamp=datetime(2024, 1, 2, 5)))):
        assert "PartitionFilters: [isnotnull(start_date" in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count() == 20
    one = back.where(F.col("start_date") == F.lit("2024-01-02").cast("date"))
    assert one.count() == 10
    assert "PartitionFilters: [isnotnull(start_date" in one._jdf.queryExecution().executedPlan().toString()


def test_sheets_per_operator(spark):
    path = shared_dir(spark, "sheets")
    df = spark.createDataFrame([("", 1), ("a", 2), ("a", 3)], "system_id string, a int")
    sinks.export_sheets(df, path)
    assert {(r["sheet"], r["n"]) for r in spark.read.parquet(path).groupBy("sheet").agg(F.count("*").alias("n")).collect()} == {
        ("all", 1), ("a", 2)}


def test_tables_are_read_with_their_schema(spark):
    path = shared_dir(spark, "feeds")
    row = (1, "a", "gbfs", NOW, True, True)
    spark.createDataFrame([row], SCHEMAS["feeds"]).write.parquet(path)
    assert tables.load(spark, "feeds", path).schema.fieldNames() == SCHEMAS["feeds"].fieldNames()
    with pytest.raises(ValueError):
        tables.load(spark, "nothing", path)
    spark.createDataFrame([row], SCHEMAS["feeds"]).createOrReplaceTempView("feeds")
    assert tables.load_table(spark, "feeds").first()["feed_type"] == "gbfs"


def test_geojson_source_and_unnest(spark):
    text = '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}'
    df = tables.with_rings(spark.createDataFrame([(1, text)], "zone_id bigint, geojson string"))
    assert df.columns == ["zone_id", "rings"] and len(df.first()["rings"][0]) == 4
    assert tables.unnest(spark.sql("select 1 as k, array(1, 2) as ids"), "ids", "id").count() == 2


def test_feeds_are_up_for_five_minutes(spark):
    rows = [(i, "a", "gbfs", None if age is None else NOW - timedelta(minutes=age), True, imports)
            for i, (age, imports) in enumerate(((4, True), (5, True), (None, True), (1, False)))]
    df = spark.createDataFrame(rows, SCHEMAS["feeds"])
    assert {r["feed_id"]: r["up"] for r in feeds.active_feeds(df, NOW).collect()} == {0: True, 1: False, 2: False}
    pages = feeds.feed_pages(df, NOW, page_ids=2).orderBy("page").collect()
    assert [[f["feed_id"] for f in json.loads(p["feeds"])] for p in pages] == [[0, 1], [2]]
    (page,) = feeds.feed_pages(df.where("feed_id > 9"), NOW).collect()
    assert page["feeds"] == "[]"


# --- streams ----------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def series_folder(spark):
    """Four files in order of time, read one per batch."""
    path = shared_dir(spark, "series")
    start = datetime(2024, 1, 1)
    for part in range(4):
        rows = [(start + timedelta(minutes=part * 60 + i), i % 3, f"op_{i % 2}", "car", i % 5, i % 7) for i in range(90)]
        spark.createDataFrame(rows, SCHEMAS["stats_number_of_trips"]).coalesce(1).write.mode("append").parquet(path)
    return path


def _stream(spark, folder, schema):
    return streams.read_stream(spark, folder, SCHEMAS[schema], files_per_trigger=1)


def test_stream_totals_equal_batch_totals(spark, series_folder):
    keys = ["bucket", "system_id", "modality"]
    found = streams.run_updates(streams.rental_buckets(_stream(spark, series_folder, "stats_number_of_trips")), keys)
    batch = spark.read.parquet(series_folder).groupBy(
        F.window(F.col("time").cast("timestamp"), "15 minutes")["start"].alias("bucket"), "system_id", "modality").agg(
        F.sum("number_of_trips_started").alias("number_of_trips_started"),
        F.sum("number_of_trips_ended").alias("number_of_trips_ended"))
    columns = [*keys, "number_of_trips_started", "number_of_trips_ended"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))


def test_parked_stream(spark):
    path = shared_dir(spark, "parked")
    t = datetime(2024, 1, 1)
    for value in (3, 5):
        spark.createDataFrame([(t, 1, "a", "car", value)], SCHEMAS["stats_number_of_vehicles_parked"]).write.mode(
            "append").parquet(path)
    stream = _stream(spark, path, "stats_number_of_vehicles_parked")
    (row,) = streams.run_updates(streams.parked_buckets(stream), ["bucket", "system_id", "modality"]).collect()
    assert (row["min"], row["max"], row["avg"]) == (3, 5, 4.0)


def test_active_user_stream_gives_a_user_once_per_day(spark):
    path = shared_dir(spark, "visits")
    day = datetime(2024, 1, 1, 9)
    for at in (day, day + timedelta(hours=2), day + timedelta(days=1)):
        _visits(spark, ("a", "operator" if at == day else "admin", at), ("a", None, at), (None, "admin", at), ("", None, at)).write.mode(
            "append").parquet(path)
    stream = streams.read_stream(spark, path, "user_id string, role string, visited_at timestamp_ntz", files_per_trigger=1)
    found = streams.run_updates(streams.active_users(stream, ":s"), ["user_hash", "active_on"])
    batch = exports.active_users(spark.read.parquet(path), ":s")
    assert sorted(map(tuple, found.select(batch.columns).collect())) == sorted(map(tuple, batch.collect()))
    assert sorted((r["active_on"], r["role"]) for r in found.collect()) == [(date(2024, 1, 1), "admin"), (date(2024, 1, 2), "admin")]


def test_active_users_with_bounded_state(spark):
    """Twelve days of visits, a file a day and one out of order: late visits are kept aside, state covers two days."""
    path, t = shared_dir(spark, "many-visits"), datetime(2024, 1, 1, 8)
    for day in [*range(8), 2, *range(8, 12)]:
        rows = [(f"u{u}", ("admin", "operator", None)[(u + h) % 3], t + timedelta(days=day, hours=h)) for u in range(20) for h in (0, 5, 9)]
        _visits(spark, *rows, ("", "admin", t + timedelta(days=day))).coalesce(1).write.mode("append").parquet(path)
    stream = streams.read_stream(spark, path, "user_id string, role string, visited_at timestamp_ntz", files_per_trigger=1)
    users, late, held = streams.run_active_users(stream, ":s", "2 days", files_per_trigger=1)
    assert late.count() == 61 and users.count() == 240
    whole = users.unionByName(exports.active_users(late, ":s")).groupBy("user_hash", "active_on").agg(F.min("role").alias("role"))
    batch = exports.active_users(spark.read.parquet(path), ":s")
    assert sorted(map(tuple, whole.select(batch.columns).collect())) == sorted(map(tuple, batch.collect()))
    assert 0 < held <= 60 * 5  # of 780 rows


def test_gap_filled_buckets_come_when_the_watermark_passes(spark):
    path, t = shared_dir(spark, "gaps"), datetime(2024, 1, 1)
    first, last = t + timedelta(minutes=7), t + timedelta(hours=9)
    at = [[10, 50, 20], [200], [190, 500], [500, 539, 541], [20 * 60]]  # minutes, one list a file; the last one moves the watermark only
    for n, file in enumerate(at):
        rows = [(t + timedelta(minutes=m), 1, f"op_{m % 2}", "car", m, 1) for m in file]
        spark.createDataFrame(rows, SCHEMAS["stats_number_of_trips"]).coalesce(1).write.mode("append").parquet(path)
    out, held = streams.run_appends(streams.filled_rental_buckets(_stream(spark, path, "stats_number_of_trips"), first, last, "30 minutes"))
    keys = ["system_id", "modality", "bucket"]
    got = {(r["system_id"], r["bucket"]): (r["number_of_trips_started"], r["number_of_trips_ended"]) for r in out.collect()}
    series = rental_series(spark.read.parquet(path), Filter(start_time=first, end_time=last, zone_ids=(1,)), "15m").collect()
    assert got == {(r["system_id"], r["bucket"]): (r["number_of_trips_started"], r["number_of_trips_ended"]) for r in series}
    assert len(got) == out.count() == 2 * 37 and held == 2 and keys == out.columns[:3]


def test_files_out_of_order_lose_nothing_and_late_rows_are_kept_aside(spark):
    path, t = shared_dir(spark, "late"), datetime(2024, 1, 20)
    for days, n in ((0, 10), (0, 20), (-10, 30), (0, 5), (-10, 35)):
        spark.createDataFrame([(t + timedelta(days=days), 1, "a", "car", n, 1)], SCHEMAS["stats_number_of_trips"]).coalesce(1).write.mode(
            "append").parquet(path)
    keys = ["bucket", "system_id", "modality"]
    for files in (1, 2, 1000):
        stream = streams.read_stream(spark, path, SCHEMAS["stats_number_of_trips"], files_per_trigger=files)
        found = streams.run_updates(streams.rental_buckets(stream), keys).agg(F.sum("number_of_trips_started")).first()[0]
        assert found == 100
    stream = _stream(spark, path, "stats_number_of_trips")
    in_time, late = streams.split_late(stream, "time", "1 day", shared_dir(spark, "parts"))
    assert (in_time.count() + late.count(), late.agg(F.sum("number_of_trips_started")).first()[0]) == (5, 65)
    assert in_time.columns == late.columns == stream.columns


def test_an_export_replaces_what_its_folder_held(spark):
    path = shared_dir(spark, "again")
    rows = [(i, "a", "b", 0, 4.0, 52.0, datetime(2024, 1, 1 + i), None) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMAS["park_events"])
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    sinks.export_by_date(df, path)
    sinks.export_by_date(df.where("park_event_id = 2"), path)
    assert [r["park_event_id"] for r in spark.read.parquet(path).collect()] == [2]
    sinks.export_by_date(df.where("false"), path)
    assert spark.read.schema(df.schema).parquet(path).count() == 0
    sheets = shared_dir(spark, "sheets-again")
    sinks.export_sheets(df, sheets)
    sinks.export_sheets(df.withColumn("system_id", F.lit("z")), sheets)
    assert {r["sheet"] for r in spark.read.parquet(sheets).collect()} == {"z"}


def test_working_folders_leave_the_session_as_it_is(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    shared_dir(spark, "x")
    assert spark.conf.get("spark.checkpoint.dir", None) == before


def test_latest_position_stream_keeps_the_newest(spark):
    path = shared_dir(spark, "positions")
    t = datetime(2024, 1, 1)
    for sample, (bike, at) in enumerate((("a", t), ("b", t + timedelta(1)), ("a", t + timedelta(2)), ("a", t + timedelta(1)))):
        spark.createDataFrame([(sample, bike, "s", 4.0, 52.0, at, False, False)], SCHEMAS["bike_detection"]).write.mode(
            "append").parquet(path)
    found = streams.run_updates(streams.latest_positions(_stream(spark, path, "bike_detection")), ["bike_id"]).collect()
    assert {r["bike_id"]: r["sample_id"] for r in found} == {"a": 2, "b": 1}


def test_a_cluster_must_name_its_shared_folder(spark):
    class Cluster:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError):
        shared_dir(Cluster, "x")
