"""Rentals, taken from the edges of parking intervals: a rental starts where an interval ends, and ends where
an interval starts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kerbline.filters import Filter, keep, prune_days
from kerbline.operators.spatial import build_grid, containing_polygons, in_any_polygon
from kerbline.plans.park import location
from kerbline.plans.trips import with_zone_counts


def _located_in_zones(events: DataFrame, zones: DataFrame, f: Filter) -> DataFrame:
    if not f.zone_ids:
        return events
    return in_any_polygon(events, build_grid(keep(zones, f.by_zone()), union=True))


def rental_starts(events: DataFrame, zones: DataFrame, f: Filter) -> DataFrame:
    """Rentals that start in the period. As in the source system the reported time is the start of the interval."""
    ended = keep(prune_days(events, last=f.period()[1]), f.in_period("end_time"), f.by_operator())
    found = _located_in_zones(ended, zones, f)
    return found.select("system_id", "bike_id", location(), F.col("start_time").alias("departure_time"))


def rental_ends(events: DataFrame, zones: DataFrame, f: Filter) -> DataFrame:
    """Rentals that end in the period; the reported time is the end of the interval, which may still be open."""
    begun = keep(prune_days(events, *f.period()), f.in_period("start_time"), f.by_operator())
    found = _located_in_zones(begun, zones, f)
    return found.select("system_id", "bike_id", location(), F.col("end_time").alias("arrival_time"))


def rental_zone_stats(events: DataFrame, zones: DataFrame, f: Filter) -> DataFrame:
    """Number of rentals that end and that start in each zone, in this order, in one pass over the events."""
    chosen = zones.where(f.by_zone() if f.zone_ids else F.lit(False))
    ends, starts = f.in_period("start_time"), f.in_period("end_time")
    edges = keep(prune_days(events, last=f.period()[1]), ends | starts, f.by_operator()).select(
        "lon", "lat", F.coalesce(ends, F.lit(False)).alias("is_end"), F.coalesce(starts, F.lit(False)).alias("is_start"))
    grid = build_grid(chosen)
    counts = (containing_polygons(edges, grid).groupBy("zone_id")
              .agg(F.count_if("is_end").alias("ended"), F.count_if("is_start").alias("started")))
    return with_zone_counts(chosen, grid.per_polygon(counts), "ended", "started")
