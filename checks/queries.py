"""The registered queries: every operator of the package over the derived tables of a star-schema folder."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from kerbline.filters import Filter
from kerbline.functions import geometry as geo
from kerbline.model import SCHEMAS, TRIPS_ENDED, VEHICLES_AVAILABLE
from kerbline.operators.intervals import load_intervals, store_intervals
from kerbline.operators.spatial import build_grid, containing_polygons, either_in_any_polygon, first_polygon, in_any_polygon
from kerbline.plans import access, detections, exports, feeds, park, rentals, report, series, statistics, trips, zones
from kerbline.session import apply_runtime_conf, shared_dir
from kerbline.sources import dimensions, sinks, tables
from kerbline.sources.fixtures import INDEX_HORIZON, LEFT_OUT, RAW_SCHEMAS, SNAPPED, Fixtures, boxed, notched
from kerbline.streaming import streams

POLYGON = ('{"type": "Polygon", "coordinates": [[[4.1, 50.1], [5.9, 50.2], [5.8, 52.3], [4.2, 52.2], [4.1, 50.1]]]}')
_CORNERS = [[4.1, 50.1], [5.9, 50.2], [5.8, 52.3], [4.2, 52.2], [4.1, 50.1]]
REPEATED_CORNER = json.dumps({"type": "Polygon", "coordinates": [[c for c in _CORNERS for _ in (0, 1)]]})
MANY_CORNERS = json.dumps({"type": "Polygon", "coordinates": [[*(
    [a[0] + (b[0] - a[0]) * i / 4, a[1] + (b[1] - a[1]) * i / 4] for a, b in zip(_CORNERS, _CORNERS[1:]) for i in range(4)), _CORNERS[0]]]})
PARKED = {"timestamp": "2001-06-15T12:00:00Z"}
CHOSEN_ZONES = {"zone_ids": "1,2,7,13,18,101,103"}
PERIOD = {"start_time": "1998-01-01", "end_time": "1999-12-31"}
EXPORT_PERIOD = {"start_time": "1998-01-01", "end_time": "1998-03-31"}
SERIES_PERIOD = {"start_time": "2024-01-03T00:00:00Z", "end_time": "2024-01-12T18:00:00Z"}
STATS_PERIOD = {"start_time": "2024-01-02", "end_time": "2024-01-25"}
REPORT_PERIOD = {"start_time": "2024-01-02", "end_time": "2024-01-25", "gm_code": "GM0001"}
SERIES_ZONES = {"zone_ids": "1,2,3,7,11,13,18,21"}
ALL_ZONES = {"zone_ids": ",".join(str(z) for z in [*range(1, 26), *range(101, 106)])}
CALENDAR = {"start_time": "2023-12-25", "end_time": "2024-02-05"}
NOW = datetime(2024, 1, 30, 12)
SALT = ":active-users"
EXPORT_USER = "Customer#000000020"
INDEX_UNTIL = datetime.fromisoformat(INDEX_HORIZON)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(Fixtures(apply_runtime_conf(spark), folder))

    QUERIES[function.__name__] = run
    return function


def _filter(*parts: dict, **more: str) -> Filter:
    args: dict = {}
    for part in (*parts, more):
        args.update(part)
    return Filter.from_args(args)


def _flat(df: DataFrame, *locations: str) -> DataFrame:
    """Spread location structs over two columns each."""
    for name in locations:
        prefix = name.replace("location", "")
        df = df.select(*(c for c in df.columns if c != name),
                       F.col(f"{name}.latitude").alias(f"{prefix}latitude"),
                       F.col(f"{name}.longitude").alias(f"{prefix}longitude"))
    return df


def _pair(df: DataFrame, first: str, second: str) -> DataFrame:
    count = F.col("number_of_trips")
    return df.select("zone_id", F.col("zone.name").alias("name"), F.col("zone.zone_type").alias("zone_type"),
                     count[0].alias(first), count[1].alias(second))


# --- parked vehicles ------------------------------------------------------------------------------------------

@query
def park_count_in_polygon(t: Fixtures) -> DataFrame:
    return park.park_count(t.table("park_events"), t.table("vehicle_type"), _filter(PARKED, geojson=POLYGON))


@query
def park_count_in_polygon_many_corners(t: Fixtures) -> DataFrame:
    """The same area with more corners than are compiled: it is joined as a zone."""
    return park.park_count(t.table("park_events"), t.table("vehicle_type"), _filter(PARKED, geojson=MANY_CORNERS))


@query
def park_count_in_polygon_repeated_corner(t: Fixtures) -> DataFrame:
    return park.park_count(t.table("park_events"), t.table("vehicle_type"), _filter(PARKED, geojson=REPEATED_CORNER))


@query
def park_events_at(t: Fixtures) -> DataFrame:
    f = _filter(PARKED, CHOSEN_ZONES, operators="op_1,op_3,op_4", form_factors="moped,car,unknown")
    found = park.park_events_at(t.table("park_events"), t.table("vehicle_type"), t.table("zones"), f)
    return _flat(found, "location")


@query
def park_events_everywhere(t: Fixtures) -> DataFrame:
    found = park.park_events_at(t.table("park_events"), t.table("vehicle_type"), t.table("zones"), _filter(PARKED))
    return _flat(found, "location")


@query
def public_vehicles(t: Fixtures) -> DataFrame:
    found = park.public_vehicles(t.table("park_events"), t.table("vehicle_type"), t.table("zones"),
                                 _filter(CHOSEN_ZONES), datetime(2001, 7, 1, 8))
    return _flat(found, "location")


@query
def park_age_histogram(t: Fixtures) -> DataFrame:
    f = _filter(PARKED, ALL_ZONES)
    stats = park.park_event_stats(t.table("park_events"), t.table("vehicle_type"), t.table("zones"), f)
    return stats.select("zone_id", "name", "municipality", "zone_type",
                        *(F.col("stats")[i].alias(f"bucket_{i}") for i in range(5)))


@query
def park_age_histogram_filtered(t: Fixtures) -> DataFrame:
    f = _filter(PARKED, CHOSEN_ZONES, operators="op_0,op_2", form_factors="bicycle,unknown")
    stats = park.park_event_stats(t.table("park_events"), t.table("vehicle_type"), t.table("zones"), f)
    return stats.select("zone_id", "name", "municipality", "zone_type",
                        *(F.col("stats")[i].alias(f"bucket_{i}") for i in range(5)))


@query
def park_event_date_index(t: Fixtures) -> DataFrame:
    index = park.build_date_index(t.table("park_events"), INDEX_UNTIL)
    return index.select("on_date", "chunk", F.size("park_event_ids").cast("bigint").alias("number_of_ids"),
                        F.array_join("park_event_ids", ",").alias("park_event_ids"))


@query
def park_events_by_date_index(t: Fixtures) -> DataFrame:
    """From the stored index of bitmaps."""
    events, path = t.table("park_events"), shared_dir(t.spark, "bitmap-index")
    park.build_bitmap_index(events, INDEX_UNTIL).write.parquet(path)
    return park.events_by_bitmap_index(events, t.spark.read.parquet(path), _filter(PARKED)).select(
        "park_event_id", "system_id", "bike_id", "start_time", "end_time")


@query
def park_events_by_id_lists(t: Fixtures) -> DataFrame:
    """From the lists of ids by date."""
    events = t.table("park_events")
    return park.events_by_date_index(events, park.build_date_index(events, INDEX_UNTIL), _filter(PARKED)).select(
        "park_event_id", "system_id", "bike_id", "start_time", "end_time")


@query
def park_events_through_day_index(t: Fixtures) -> DataFrame:
    """From a stored table by day, reading the days that the stored index names."""
    path, index = shared_dir(t.spark, "events-by-day"), shared_dir(t.spark, "day-index")
    events = t.table("park_events")
    sinks.export_by_date(events, path)
    park.build_day_index(events, INDEX_UNTIL).write.parquet(index)
    stored = t.spark.read.parquet(path)
    return park.park_events_through_days(stored, t.spark.read.parquet(index), _filter(PARKED)).select(
        "park_event_id", "system_id", "bike_id", "start_time", "end_time")


_HISTORIES: dict[tuple[str, str], str] = {}


def _history(t: Fixtures) -> str:
    """The folder of the stored history, written once for an application and a folder of tables."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _HISTORIES:
        path = shared_dir(t.spark, "park-history")
        store_intervals(t.table("park_events"), path)
        _HISTORIES[key] = path
    return _HISTORIES[key]


def _routed(t: Fixtures, f: Filter) -> DataFrame:
    """The stored history for an instant long before NOW; the current table holds what is still parked only."""
    history = load_intervals(t.spark, _history(t), SCHEMAS["park_events"])
    return park.source_at(t.table("park_events").where(F.col("end_time").isNull()), history, f, NOW)


@query
def park_events_historic(t: Fixtures) -> DataFrame:
    f = _filter(PARKED, CHOSEN_ZONES, operators="op_1,op_3,op_4", form_factors="moped,car,unknown")
    return _flat(park.park_events_at(_routed(t, f), t.table("vehicle_type"), t.table("zones"), f), "location")


@query
def park_count_historic(t: Fixtures) -> DataFrame:
    f = _filter(PARKED, geojson=POLYGON)
    return park.park_count(_routed(t, f), t.table("vehicle_type"), f)


@query
def park_age_histogram_historic(t: Fixtures) -> DataFrame:
    f = _filter(PARKED, ALL_ZONES)
    stats = park.park_event_stats(_routed(t, f), t.table("vehicle_type"), t.table("zones"), f)
    return stats.select("zone_id", "name", "municipality", "zone_type",
                        *(F.col("stats")[i].alias(f"bucket_{i}") for i in range(5)))


# The joins as they run when the cells outgrow a broadcast.
def _shuffled(t: Fixtures):
    return build_grid(t.table("zones"), broadcast_items=0, hot_rows=500)


@query
def zones_of_events_shuffled(t: Fixtures) -> DataFrame:
    found = containing_polygons(t.table("park_events"), _shuffled(t))
    return found.groupBy("zone_id").agg(F.count("*").alias("number_of_events"))


@query
def events_in_zones_shuffled(t: Fixtures) -> DataFrame:
    return in_any_polygon(t.table("park_events"), _shuffled(t)).select("park_event_id")


@query
def trips_in_zones_shuffled(t: Fixtures) -> DataFrame:
    rows = t.table("trips").where(_filter(PERIOD).contained_in_period())
    return either_in_any_polygon(rows, _shuffled(t), trips.START, trips.END).select("trip_id")


@query
def municipality_of_repeated_points(t: Fixtures) -> DataFrame:
    """Every detection twice under one key, in both forms."""
    once = t.table("bike_detection").select(F.col("sample_id").alias("point"), "lon", "lat")
    points = once.unionByName(once)
    areas = t.table("zones").where(F.col("zone_type") == "municipality")
    forms = [first_polygon(points, build_grid(areas, broadcast_items=items), ["point"], rule=geo.intersects).select(
        F.lit(form).alias("form"), "point", "zone_id") for form, items in (("broadcast", 2_000_000), ("shuffled", 0))]
    return forms[0].unionByName(forms[1])


@query
def events_in_joined_boxes(t: Fixtures) -> DataFrame:
    """Chosen boxes share sides and corners; most events are moved onto those, where only the union of boxes holds them."""
    areas = boxed(t.table("zones").where((F.col("zone_type") != "municipality") & ~F.col("zone_id").isin(*LEFT_OUT)))
    events = t.table("park_events").select("park_event_id", *(F.expr(e).alias(n) for n, e in SNAPPED.items()))
    return in_any_polygon(events, build_grid(areas, union=True)).select("park_event_id")


@query
def public_zone_occupancy(t: Fixtures) -> DataFrame:
    return park.zone_occupancy(t.table("park_events"), t.table("zones"), _public_zones(t)).select(
        "zone_id", "name", "capacity", F.explode_outer("operators").alias("o")).select(
        "zone_id", "name", "capacity", "o.system_id", "o.number_of_vehicles")


@query
def public_zone_occupancy_listed(t: Fixtures) -> DataFrame:
    """The fixed list of public zones; the first zones of the table stand for them."""
    ids = F.array(*(F.lit(row[0]).cast("bigint") for row in dimensions.PUBLIC_ZONES))
    listed = F.col("zone_id") <= len(dimensions.PUBLIC_ZONES)
    areas = t.table("zones").withColumn("zone_id", F.when(listed, F.element_at(ids, F.least("zone_id", F.size(ids)).cast("int"))).otherwise(F.col("zone_id")))
    return park.zone_occupancy(t.table("park_events"), areas, dimensions.public_zones(t.spark)).select(
        "zone_id", "name", "capacity", F.explode_outer("operators").alias("o")).select(
        "zone_id", "name", "capacity", "o.system_id", "o.number_of_vehicles")


@query
def park_events_loaded(t: Fixtures) -> DataFrame:
    """From stored files with the schema of the model."""
    path = shared_dir(t.spark, "park-events")
    t.table("park_events").write.parquet(path)
    found = park.park_events_at(tables.load(t.spark, "park_events", path), t.table("vehicle_type"), t.table("zones"), _filter(PARKED))
    return _flat(found, "location")


@query
def events_in_notched_zones(t: Fixtures) -> DataFrame:
    """Concave zones with a hole and a second part, next to each other."""
    areas = notched(t.table("zones").where(F.col("zone_type") != "municipality"))
    found = containing_polygons(t.table("park_events"), build_grid(areas))
    return found.groupBy("zone_id").agg(F.count("*").alias("number_of_events"))


def _public_zones(t: Fixtures) -> DataFrame:
    zone = t.table("zones").where(F.col("zone_type") != "municipality")
    return zone.select("zone_id", "name", F.when(F.col("zone_id") % 3 != 0, F.col("zone_id") * 10).alias("capacity"))


# --- trips and rentals ------------------------------------------------------------------------------------------

@query
def trips_in_zones(t: Fixtures) -> DataFrame:
    f = _filter(PERIOD, CHOSEN_ZONES, operators="op_1,op_2,op_5", form_factors="moped,kick_scooter,unknown")
    return _flat(trips.trips(t.table("trips"), t.table("vehicle_type"), t.table("zones"), f),
                 "start_location", "end_location")


@query
def trips_everywhere(t: Fixtures) -> DataFrame:
    return _flat(trips.trips(t.table("trips"), t.table("vehicle_type"), t.table("zones"), _filter(PERIOD)),
                 "start_location", "end_location")


@query
def trip_origins(t: Fixtures) -> DataFrame:
    f = _filter(PERIOD, CHOSEN_ZONES, operators="op_1,op_2,op_5", form_factors="moped,kick_scooter,unknown")
    return _flat(trips.trip_origins(t.table("trips"), t.table("vehicle_type"), t.table("zones"), f), "location")


@query
def trip_destinations(t: Fixtures) -> DataFrame:
    f = _filter(PERIOD, CHOSEN_ZONES, operators="op_1,op_2,op_5", form_factors="moped,kick_scooter,unknown")
    return _flat(trips.trip_destinations(t.table("trips"), t.table("vehicle_type"), t.table("zones"), f), "location")


@query
def trip_zone_stats(t: Fixtures) -> DataFrame:
    f = _filter(PERIOD, ALL_ZONES, operators="op_0,op_1,op_2,op_3")
    return _pair(trips.trip_stats(t.table("trips"), t.table("zones"), f), "started", "ended")


@query
def rental_starts(t: Fixtures) -> DataFrame:
    f = _filter(PERIOD, CHOSEN_ZONES, operators="op_1,op_2,op_5")
    return _flat(rentals.rental_starts(t.table("park_events"), t.table("zones"), f), "location")


@query
def rental_ends(t: Fixtures) -> DataFrame:
    f = _filter(PERIOD, CHOSEN_ZONES, operators="op_1,op_2,op_5")
    return _flat(rentals.rental_ends(t.table("park_events"), t.table("zones"), f), "location")


@query
def rental_zone_stats(t: Fixtures) -> DataFrame:
    return _pair(rentals.rental_zone_stats(t.table("park_events"), t.table("zones"), _filter(PERIOD, ALL_ZONES)),
                 "ended", "started")


# --- statistics and series --------------------------------------------------------------------------------------

def _statistic(t: Fixtures, plan, aggregation: str, **more: str) -> DataFrame:
    return plan(t.table("stats_pre_process"), t.table("zones"), _filter(STATS_PERIOD, SERIES_ZONES, **more), aggregation)


def _register_periods() -> None:
    for aggregation in ("day", "week", "month"):
        def available(t: Fixtures, aggregation=aggregation) -> DataFrame:
            return _statistic(t, statistics.available_vehicles, aggregation)

        def started(t: Fixtures, aggregation=aggregation) -> DataFrame:
            return _statistic(t, statistics.rentals_started, aggregation, operators="op_0,op_1,op_4")

        available.__name__, started.__name__ = f"available_vehicles_{aggregation}", f"rentals_{aggregation}"
        query(available)
        query(started)
    for aggregation in ("5m", "15m", "hour", "day", "week", "month"):
        def rental(t: Fixtures, aggregation=aggregation) -> DataFrame:
            return series.rental_series(t.table("stats_number_of_trips"), _filter(SERIES_PERIOD, SERIES_ZONES),
                                        aggregation)

        rental.__name__ = f"rental_series_{aggregation}"
        query(rental)


_register_periods()


def _availability(t: Fixtures, aggregation: str, function: str, group_by: str) -> DataFrame:
    found = series.availability_series(t.table("stats_number_of_vehicles_parked"), _filter(SERIES_PERIOD, SERIES_ZONES),
                                       aggregation, function, group_by)
    return found.withColumn("amount", F.round(F.col("amount").cast("double"), 6))


@query
def availability_by_operator(t: Fixtures) -> DataFrame:
    return _availability(t, "15m", "AVG", "operator")


@query
def availability_by_operator_max(t: Fixtures) -> DataFrame:
    return _availability(t, "hour", "MAX", "operator")


@query
def availability_by_modality(t: Fixtures) -> DataFrame:
    return _availability(t, "hour", "AVG", "modality")


@query
def availability_by_modality_min(t: Fixtures) -> DataFrame:
    return _availability(t, "5m", "MIN", "modality")


@query
def availability_document(t: Fixtures) -> DataFrame:
    document = series.availability_document(_availability(t, "hour", "AVG", "operator"))
    return document.select("time", F.explode("values").alias("name", "amount"))


@query
def rental_document(t: Fixtures) -> DataFrame:
    values = series.rental_series(t.table("stats_number_of_trips"), _filter(SERIES_PERIOD, SERIES_ZONES), "hour")
    document = series.rental_document(values)
    return (document.select("time", F.explode("values").alias("system_id", "modalities"))
            .select("time", "system_id", F.explode("modalities").alias("modality", "counts"))
            .select("time", "system_id", "modality", "counts.rentals_started", "counts.rentals_ended"))


@query
def period_pivot(t: Fixtures) -> DataFrame:
    values = _statistic(t, statistics.rentals_started, "week")
    return statistics.pivot_columns(values, [f"op_{i}" for i in range(6)])


@query
def period_map(t: Fixtures) -> DataFrame:
    document = statistics.pivot_by_operator(_statistic(t, statistics.available_vehicles, "week"))
    return document.select("start_interval", F.explode("values").alias("system_id", "value"))


@query
def missing_days(t: Fixtures) -> DataFrame:
    return statistics.missing_days(t.spark, t.table("stats_pre_process"), _filter(CALENDAR), TRIPS_ENDED)


@query
def period_operator_grid(t: Fixtures) -> DataFrame:
    return statistics.period_operator_grid(t.table("stats_pre_process"), t.table("zones"),
                                           _filter(STATS_PERIOD, SERIES_ZONES))


@query
def daily_statistics(t: Fixtures) -> DataFrame:
    parked = t.table("stats_number_of_vehicles_parked").select(
        F.col("time").cast("date").alias("date"), F.concat(F.lit("cbs:"), F.col("zone_id").cast("string")).alias("zone_ref"),
        "system_id", F.col("number_of_vehicles_parked").alias("value"))
    return statistics.aggregate_daily(parked, VEHICLES_AVAILABLE)


# --- report -----------------------------------------------------------------------------------------------------

def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if dict(df.dtypes)[c] == "double" else F.col(c) for c in df.columns))


@query
def report_triples(t: Fixtures) -> DataFrame:
    f = _filter(REPORT_PERIOD, operators="op_1,op_2,op_3")
    return _rounded(report.report_triples(t.table("stats_pre_process"), t.table("zones"), f))


@query
def report_operators(t: Fixtures) -> DataFrame:
    f = _filter(REPORT_PERIOD, operators="op_1,op_2,op_3")
    return report.active_operators(t.table("stats_pre_process"), t.table("zones"), f)


@query
def report_indicators(t: Fixtures) -> DataFrame:
    found = report.indicators(t.table("stats_pre_process"), t.table("zones"), _filter(REPORT_PERIOD))
    return _rounded(found.drop("municipality"))


@query
def report_full(t: Fixtures) -> DataFrame:
    return _rounded(report.report(t.table("stats_pre_process"), t.table("zones"), _filter(REPORT_PERIOD)))


@query
def report_export(t: Fixtures) -> DataFrame:
    """Written as one sheet per operator, then read back."""
    path = shared_dir(t.spark, "report")
    sinks.export_sheets(report.report(t.table("stats_pre_process"), t.table("zones"), _filter(REPORT_PERIOD)), path)
    return _rounded(t.spark.read.parquet(path).drop("sheet"))


# --- zones ------------------------------------------------------------------------------------------------------

@query
def zone_list(t: Fixtures) -> DataFrame:
    return zones.zone_list(t.table("zones"), t.table("geographies"), _filter(municipalities="GM0000,GM0001,GM0003"))


@query
def zone_list_without_custom(t: Fixtures) -> DataFrame:
    return zones.zone_list(t.table("zones"), t.table("geographies"),
                           _filter(municipalities="GM0000,GM0001,GM0002,GM0003,GM0004"), include_custom=False)


@query
def zones_by_filter(t: Fixtures) -> DataFrame:
    f = _filter(ALL_ZONES, municipalities="GM0001,GM0002,GM0004")
    found = zones.zones_with_geometry(t.table("zones"), f)
    corners = F.element_at(geo.rings_from_geojson(F.col("geojson")), 1)
    return found.select(*zones.ZONE_COLUMNS, *(F.round(corners[i][axis], 6).alias(f"{axis}{i}")
                                               for i in range(5) for axis in ("x", "y")))


@query
def municipalities(t: Fixtures) -> DataFrame:
    return zones.municipalities(t.table("zones"))


@query
def municipality_area(t: Fixtures) -> DataFrame:
    found = zones.municipality_area(t.table("municipalities"), "GM0002")
    corners = F.element_at(geo.rings_from_geojson(F.col("geojson")), 1)
    return found.select("gm_code", *(F.round(corners[i][axis], 6).alias(f"{axis}{i}")
                                     for i in range(5) for axis in ("x", "y")))


@query
def municipality_at(t: Fixtures) -> DataFrame:
    return zones.municipality_at(t.table("bike_detection"), t.table("zones"), ["sample_id"])


@query
def zone_request_check(t: Fixtures) -> DataFrame:
    return zones.check_zone_requests(t.table("zone_requests"), t.table("zones"))


@query
def zone_create(t: Fixtures) -> DataFrame:
    created, _ = zones.create_zones(t.table("zones"), t.table("zone_requests"))
    return created.drop("rings")


@query
def zone_delete(t: Fixtures) -> DataFrame:
    all_zones = t.table("zones").drop("rings")
    remaining, deleted = zones.delete_zones(all_zones, [3, 7, 22, 24, 25, 101])
    return remaining.withColumn("deleted", F.lit(False)).unionByName(deleted.withColumn("deleted", F.lit(True)))


# --- feeds and detections ---------------------------------------------------------------------------------------

@query
def active_feeds(t: Fixtures) -> DataFrame:
    return feeds.active_feeds(t.table("feeds"), NOW)


@query
def feeds_json(t: Fixtures) -> DataFrame:
    pages = feeds.feed_pages(t.table("feeds"), NOW)
    kind = ("array<struct<feed_id: bigint, system_id: string, feed_type: string, "
            "last_time_succesfully_imported: timestamp_ntz, up: boolean>>")
    return pages.select(F.inline(F.from_json("feeds", kind)))


@query
def last_detections(t: Fixtures) -> DataFrame:
    return detections.all_positions(detections.snapshot(t.table("bike_detection")))


@query
def vehicles_in_bbox(t: Fixtures) -> DataFrame:
    return detections.positions_in_box(detections.snapshot(t.table("bike_detection")), 4.5, 50.5, 5.75, 51.75)


@query
def vehicles_in_municipality(t: Fixtures) -> DataFrame:
    return detections.positions_in_municipality(detections.snapshot(t.table("bike_detection")),
                                                t.table("municipalities"), "GM0001")


@query
def latest_positions(t: Fixtures) -> DataFrame:
    return detections.latest_positions(t.table("bike_detection"), t.table("municipalities"), "GM0002")


@query
def movements(t: Fixtures) -> DataFrame:
    return _rounded(detections.movements(t.table("bike_detection")).select(
        "sample_id", "bike_id", "last_time_imported", "distance"))


# --- access -----------------------------------------------------------------------------------------------------

def _access(t: Fixtures) -> access.AccessTables:
    return access.AccessTables(t.table("user_account"), t.table("organisation"), t.table("view_data_access"),
                               t.table("zones"))


@query
def acl_municipalities(t: Fixtures) -> DataFrame:
    return access.effective_municipalities(_access(t))


@query
def acl_zones(t: Fixtures) -> DataFrame:
    return access.effective_zones(_access(t))


@query
def acl_operators(t: Fixtures) -> DataFrame:
    return access.effective_operators(_access(t))


@query
def acl_decisions(t: Fixtures) -> DataFrame:
    return access.decide(t.table("requests"), _access(t))


@query
def acl_municipality_decisions(t: Fixtures) -> DataFrame:
    return access.decide_municipality(t.table("requests"), _access(t))


@query
def acl_export_decisions(t: Fixtures) -> DataFrame:
    return access.decide_export(t.table("requests"), _access(t))


@query
def acl_summary(t: Fixtures) -> DataFrame:
    """The lists of the summary as text, so that they compare as values."""
    summary = access.user_summary(_access(t), t.table("municipalities_with_data"), dimensions.operators(t.spark))

    def text(name: str, code: str) -> Column:
        return F.array_join(F.transform(name, lambda i: F.concat_ws("=", i[code], i["name"])), ";").alias(name)

    return summary.select("user_id", "type_of_organisation", "is_admin", "is_contact_person_municipality",
                          "filter_municipality", "filter_operator", text("municipalities", "gm_code"), text("operators", "system_id"))


@query
def public_filter_values(t: Fixtures) -> DataFrame:
    listed = zones.zone_list(t.table("zones"), t.table("geographies"), _filter(gm_code="GM0001"), include_custom=False)
    return access.public_filter_values(t.table("municipalities_with_data"), t.table("zones"),
                                       dimensions.operators(t.spark), listed)


@query
def acl_filtered_trips(t: Fixtures) -> DataFrame:
    f = _filter(PERIOD)
    scope = access.scope_of(_access(t), EXPORT_USER, f)
    return exports.visible_trips(t.table("trips"), scope, f)


# --- sinks ------------------------------------------------------------------------------------------------------

@query
def raw_export_of_user(t: Fixtures) -> DataFrame:
    """Rights, log entry and both tables; an export of other days and all zones went to the same folder before. Both, read back."""
    folder, audit = shared_dir(t.spark, "raw-export"), shared_dir(t.spark, "raw-audit")
    earlier = F.col("start_time").between(F.lit("1997-12-01").cast("timestamp_ntz"), F.lit("1998-01-31").cast("timestamp_ntz"))
    for name in ("trips", "park_events"):
        sinks.export_by_date(t.table(name).where(earlier), f"{folder}/{name}")
    paths = exports.raw_export(t.table("trips"), t.table("park_events"), _access(t), EXPORT_USER, _filter(PERIOD), folder, audit,
                               "/raw_data", NOW)
    if t.spark.read.parquet(audit).count() != 1:
        raise AssertionError("one log entry expected")
    read = {name: t.spark.read.schema(SCHEMAS[name]).parquet(paths[name]).drop("start_date") for name in ("trips", "park_events")}
    return _both_exports(read["trips"], read["park_events"])


def _both_exports(trip_rows: DataFrame, event_rows: DataFrame) -> DataFrame:
    """One table: of a park event the place and id stand in the columns of a trip's start."""
    events = event_rows.select(F.lit("park_event").alias("kind"), F.col("park_event_id").alias("id"), "system_id", "bike_id", "vehicle_type_id",
                               F.col("lon").alias("start_lon"), F.col("lat").alias("start_lat"), F.lit(None).cast("double").alias("end_lon"),
                               F.lit(None).cast("double").alias("end_lat"), "start_time", "end_time")
    return trip_rows.select(F.lit("trip").alias("kind"), F.col("trip_id").alias("id"), *events.columns[2:]).unionByName(events)


@query
def raw_export_trips(t: Fixtures) -> DataFrame:
    """Written partitioned by day, then read back."""
    f = _filter(EXPORT_PERIOD, CHOSEN_ZONES, operators="op_1,op_2")
    path = shared_dir(t.spark, "trips")
    scope = access.Scope(t.table("zones").where(f.by_zone()), access.operator_names(t.spark, f.operators))
    sinks.export_by_date(exports.visible_trips(t.table("trips"), scope, f), path)
    return t.spark.read.schema(SCHEMAS["trips"]).parquet(path).drop("start_date")


@query
def raw_export_park_events(t: Fixtures) -> DataFrame:
    """Written partitioned by day, then read back."""
    f = _filter(EXPORT_PERIOD, CHOSEN_ZONES, operators="op_1,op_2")
    path = shared_dir(t.spark, "park-events")
    scope = access.Scope(t.table("zones").where(f.by_zone()), access.operator_names(t.spark, f.operators))
    sinks.export_by_date(exports.visible_park_events(t.table("park_events"), scope, f), path)
    return t.spark.read.schema(SCHEMAS["park_events"]).parquet(path).drop("start_date")


def _visits_of(events: DataFrame) -> DataFrame:
    """Some visits have no name, and a user comes in several roles."""
    kind, user = F.col("event_id") % 4, F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    return events.select(
        F.when(F.col("event_id") % 11 == 0, "").when(F.col("event_id") % 13 != 0, user).alias("user_id"),
        F.when(kind == 0, "municipality").when(kind == 1, "operator").when(kind == 2, "admin").alias("role"),
        F.col("ts").alias("visited_at"))


def _visits(t: Fixtures) -> DataFrame:
    return _visits_of(t.raw("events"))


@query
def active_users_daily(t: Fixtures) -> DataFrame:
    """Registered twice: the second time adds nothing."""
    path = shared_dir(t.spark, "active-users")
    rows = exports.active_users(_visits(t), SALT)
    sinks.append(rows.where(F.col("active_on") < F.lit("2024-01-10").cast("date")), path, "active_on")
    days = sinks.days_of(rows, "active_on")
    if days:
        sinks.append_if_absent(rows, path, ["user_hash", "active_on"], "active_on", *days)
    return t.spark.read.schema(rows.schema).parquet(path)


@query
def audit_rows(t: Fixtures) -> DataFrame:
    path = shared_dir(t.spark, "audit")
    asked = t.table("requests").select("user_id", F.concat(F.lit("/raw_data?request="), F.col("request_id").cast(
        "string")).alias("raw_api_call"), F.array_join("zone_ids", ",").alias("zones"),
        F.array_join("operators", ",").alias("operators"))
    sinks.append(exports.audit_rows(asked, NOW), path)
    return t.spark.read.parquet(path)


# --- streams ----------------------------------------------------------------------------------------------------

def _event_stream(t: Fixtures) -> DataFrame:
    """The events in files that are not in order of time, a file a batch; Spark cuts each part into as many as it likes."""
    path = shared_dir(t.spark, "event-files")
    for part in (3, 0, 4, 1, 2):
        # days 1-6 of the month come in the fourth file, days 19-24 in the first one, and so on
        some = t.raw("events").where(F.least(F.floor((F.dayofmonth("ts") - 1) / 6), F.lit(4)) == part)
        some.write.mode("append").parquet(path)
    return streams.read_stream(t.spark, path, RAW_SCHEMAS["events"], files_per_trigger=1)


@query
def stream_rental_buckets(t: Fixtures) -> DataFrame:
    rows = t.select_from("stats_number_of_trips", _event_stream(t))
    found = streams.run_updates(streams.rental_buckets(rows), ["bucket", "system_id", "modality"])
    return found.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query
def stream_parked_buckets(t: Fixtures) -> DataFrame:
    rows = t.select_from("stats_number_of_vehicles_parked", _event_stream(t))
    found = streams.run_updates(streams.parked_buckets(rows, "1 hour"), ["bucket", "system_id", "modality"])
    return _rounded(found.withColumn("bucket", F.col("bucket").cast("timestamp_ntz")))


@query
def stream_active_users(t: Fixtures) -> DataFrame:
    return streams.run_updates(streams.active_users(_visits_of(_event_stream(t)), SALT), ["user_hash", "active_on"])


@query
def stream_rental_buckets_in_time(t: Fixtures) -> DataFrame:
    """With a lateness: what came in time from the stream, and what came later from the table beside it, per bucket."""
    folder = shared_dir(t.spark, "late-rentals")
    rows = t.select_from("stats_number_of_trips", _event_stream(t))
    _, late = streams.split_late(rows, "time", "5 days", folder)
    kept = (t.spark.readStream.schema(T.StructType([*rows.schema.fields, T.StructField("late", T.BooleanType())]))
            .option("recursiveFileLookup", True).parquet(f"{folder}/rows").where(~F.col("late")).drop("late"))
    keys, measures = ["bucket", "system_id", "modality"], ("number_of_trips_started", "number_of_trips_ended")
    in_time = streams.run_updates(streams.rental_buckets(kept, lateness="5 days"), keys)
    both = in_time.unionByName(streams.rental_buckets(late).select(in_time.columns)).groupBy("bucket", "system_id", "modality").agg(*(F.sum(m).alias(m) for m in measures))
    return both.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query
def stream_rental_series(t: Fixtures) -> DataFrame:
    """Gaps filled by timers: the same series as in a batch."""
    f = _filter(SERIES_PERIOD, SERIES_ZONES)
    path = shared_dir(t.spark, "rental-files")
    rows = t.table("stats_number_of_trips").where(f.by_zone())
    rows.write.parquet(path)
    # once all rows are in, a row far ahead lets the watermark pass the period
    ahead = t.spark.createDataFrame([(datetime(2030, 1, 1), 0, None, None, 0, 0)], SCHEMAS["stats_number_of_trips"])
    ahead.write.mode("append").parquet(path)
    stream = streams.read_stream(t.spark, path, SCHEMAS["stats_number_of_trips"], files_per_trigger=1)
    out, _ = streams.run_appends(streams.filled_rental_buckets(stream, *f.period(), lateness="60 days"))
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query
def stream_active_users_bounded(t: Fixtures) -> DataFrame:
    """With a lateness of two days; visits that came later are added from the table beside it."""
    users, late, _ = streams.run_active_users(_visits_of(_event_stream(t)), SALT, "2 days")
    both = users.unionByName(exports.active_users(late, SALT))
    return both.groupBy("user_hash", "active_on").agg(F.min("role").alias("role")).select("user_hash", "role", "active_on")


@query
def stream_latest_positions(t: Fixtures) -> DataFrame:
    rows = t.select_from("bike_detection", _event_stream(t))
    return streams.run_updates(streams.latest_positions(rows), ["bike_id"])
