"""Trips and where they begin and end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.filters import Filter, keep, prune_days
from kerbline.functions.geometry import hundreds_of_metres, travelled_metres, whole_metres
from kerbline.operators.lookup import lookup_join
from kerbline.operators.spatial import build_grid, containing_polygons, either_in_any_polygon, in_any_polygon
from kerbline.plans.park import location
from kerbline.plans.zones import ZONE_COLUMNS

START, END = ("start_lon", "start_lat"), ("end_lon", "end_lat")


def _metres() -> Column:
    return travelled_metres(*(F.col(c) for c in (*START, *END)))


def _in_period(trips: DataFrame, f: Filter) -> DataFrame:
    return keep(prune_days(trips, *f.period()), f.contained_in_period(), f.by_operator())


def _typed(trips: DataFrame, vehicle_types: DataFrame, f: Filter) -> DataFrame:
    return keep(lookup_join(trips, vehicle_types, "vehicle_type_id", "left"), f.by_form_factor())


def trips(trips: DataFrame, vehicle_types: DataFrame, zones: DataFrame, f: Filter) -> DataFrame:
    """Trips within the period that begin or end in one of the zones."""
    found = _in_period(trips, f)
    if f.zone_ids:
        found = either_in_any_polygon(found, build_grid(keep(zones, f.by_zone()), union=True), START, END)
    return _typed(found, vehicle_types, f).select(
        "system_id", "bike_id", location(*START, name="start_location"), location(*END, name="end_location"),
        "start_time", "end_time", "trip_id", "form_factor", whole_metres(_metres()).alias("distance_in_meters"))


def _trip_ends(trips: DataFrame, vehicle_types: DataFrame, zones: DataFrame, f: Filter, end: tuple[str, str],
               time: str) -> DataFrame:
    found = _in_period(trips, f)
    if f.zone_ids:
        found = in_any_polygon(found, build_grid(keep(zones, f.by_zone()), union=True), *end)
    return _typed(found, vehicle_types, f).select(
        "system_id", location(*end), F.col(time).alias("event_time"), "form_factor",
        hundreds_of_metres(_metres()).alias("distance_in_meters"))


def trip_origins(trips: DataFrame, vehicle_types: DataFrame, zones: DataFrame, f: Filter) -> DataFrame:
    """Where trips begin, without the vehicle, distance rounded to hundreds of metres."""
    return _trip_ends(trips, vehicle_types, zones, f, START, "start_time")


def trip_destinations(trips: DataFrame, vehicle_types: DataFrame, zones: DataFrame, f: Filter) -> DataFrame:
    """Where trips end; as `trip_origins`. The distance is still scaled at the start latitude."""
    return _trip_ends(trips, vehicle_types, zones, f, END, "end_time")


def trip_stats(trips: DataFrame, zones: DataFrame, f: Filter) -> DataFrame:
    """Number of trips that begin and that end in each zone: all zones in one pass over the trips."""
    chosen = zones.where(f.by_zone() if f.zone_ids else F.lit(False))
    ends = F.array(*(F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"), F.lit(kind).alias("is_start"))
                     for (x, y), kind in ((START, True), (END, False))))
    grid = build_grid(chosen)
    # Before both ends become rows, so that the box reaches the reader.
    points = _in_period(trips, f).where(grid.near(*START) | grid.near(*END)).select(F.inline(ends))
    counts = (containing_polygons(points, grid).groupBy("zone_id")
              .agg(F.count_if("is_start").alias("started"), F.count_if(~F.col("is_start")).alias("ended")))
    return with_zone_counts(chosen, grid.per_polygon(counts), "started", "ended")


def with_zone_counts(zones: DataFrame, counts: DataFrame, first: str, second: str) -> DataFrame:
    """The zones with two counts as `number_of_trips`, zero where nothing was counted."""
    pair = F.array(*(F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in (first, second)))
    return (zones.join(counts, "zone_id", "left")
            .select("zone_id", pair.alias("number_of_trips"), F.struct(*ZONE_COLUMNS).alias("zone")))
