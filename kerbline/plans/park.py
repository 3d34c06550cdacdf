"""Parked vehicles at an instant."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.filters import START_DATE, Filter, keep, parked_now, prune_days
from kerbline.functions.calendar import moment
from kerbline.functions.geometry import geojson_from_rings, parse_polygon, rings_from_geojson, within_polygon
from kerbline.operators.intervals import LENGTH, may_hold
from kerbline.operators.lookup import lookup_join
from kerbline.operators.spatial import build_grid, containing_polygons, in_any_polygon

# A drawn polygon with more corners than this is joined as a zone instead of compiled into the filter: beyond it
# the generated method gets too large for the JVM to optimise.
COMPILED_CORNERS = 12

# Instants further back than this are looked up in the stored history instead of the current table.
RECENT = timedelta(hours=36)

AGE_LIMITS_DAYS = (2, 4, 7, 14)
NO_EVENTS = [0] * (len(AGE_LIMITS_DAYS) + 1)

# The date index stores ids in runs of 2^16 consecutive ids, which bounds every array.
INDEX_RUN_BITS = 16


def location(lon: str = "lon", lat: str = "lat", name: str = "location") -> Column:
    return F.struct(F.col(lat).alias("latitude"), F.col(lon).alias("longitude")).alias(name)


def _parked(events: DataFrame, f: Filter) -> DataFrame:
    """Parked at the instant; of tables stored by day or by interval only what can hold it is read."""
    if LENGTH in events.columns:
        events = events.where(may_hold(f.instant()))
    return keep(prune_days(events, last=f.instant()), f.parked_at_instant())


def source_at(current: DataFrame, history: DataFrame, f: Filter, now: datetime) -> DataFrame:
    """The table that answers for the filter's instant: the history (`load_intervals`) for what is older than RECENT.

    Each of the plans below takes either table and gives the same rows for it.
    """
    return history if f.instant() < now - RECENT else current


def _with_form_factor(events: DataFrame, vehicle_types: DataFrame, f: Filter) -> DataFrame:
    """The filter comes after the outer join, because it may ask for vehicles without a form factor."""
    return keep(lookup_join(events, vehicle_types, "vehicle_type_id", "left"), f.by_form_factor())


def _in_zones(events: DataFrame, zones: DataFrame, f: Filter) -> DataFrame:
    if not f.zone_ids:
        return events
    return in_any_polygon(events, build_grid(keep(zones, f.by_zone()), union=True))


def park_events_at(events: DataFrame, vehicle_types: DataFrame, zones: DataFrame, f: Filter) -> DataFrame:
    """Vehicles parked at the filter's timestamp, one document per parking interval."""
    parked = keep(_parked(events, f), f.by_operator())
    found = _with_form_factor(_in_zones(parked, zones, f), vehicle_types, f)
    return found.select("system_id", "bike_id", location(), "start_time", "end_time", "form_factor")


def public_vehicles(events: DataFrame, vehicle_types: DataFrame, zones: DataFrame, f: Filter,
                    now: datetime) -> DataFrame:
    """Vehicles parked now, without what would identify a vehicle."""
    current = park_events_at(events, vehicle_types, zones, replace(f, timestamp=now))
    return current.select("system_id", "location", "form_factor")


# --- counts -------------------------------------------------------------------------------------------------

def park_count(events: DataFrame, vehicle_types: DataFrame, f: Filter) -> DataFrame:
    """Vehicles parked inside a drawn polygon, by form factor. Events without a vehicle id are not counted."""
    rings = parse_polygon(f.geojson)
    parked = _parked(events, f)
    if sum(len(ring) for ring in rings) <= COMPILED_CORNERS:
        inside = parked.where(within_polygon(F.col("lon"), F.col("lat"), rings))
    else:
        drawn = events.sparkSession.range(1).select(
            F.lit(0).cast("bigint").alias("zone_id"), rings_from_geojson(F.lit(f.geojson)).alias("rings"))
        inside = in_any_polygon(parked, build_grid(drawn))
    # Counting per vehicle type first makes the lookup join tiny.
    per_type = inside.groupBy("vehicle_type_id").agg(F.count("bike_id").alias("n"))
    return (lookup_join(per_type, vehicle_types, "vehicle_type_id", "left")
            .groupBy("form_factor").agg(F.sum("n").alias("number_of_parked_vehicles")))


def age_bucket(start_time: Column, at: Column) -> Column:
    """0 … 4 for an age below 2, 4, 7 and 14 days, and from there on."""
    age = at - start_time
    bucket = F.lit(len(AGE_LIMITS_DAYS))
    for index in reversed(range(len(AGE_LIMITS_DAYS))):
        limit = F.expr(f"interval '{AGE_LIMITS_DAYS[index]}' day")
        bucket = F.when(age < limit, F.lit(index)).otherwise(bucket)
    return bucket


def park_event_stats(events: DataFrame, vehicle_types: DataFrame, zones: DataFrame, f: Filter) -> DataFrame:
    """Number of parked vehicles per zone and age bucket, as an array of five; zones without events have zeros."""
    chosen = zones.where(f.by_zone() if f.zone_ids else F.lit(False))
    parked = keep(_parked(events, f), f.by_operator())
    if f.form_factors:
        parked = _with_form_factor(parked, vehicle_types, f)
    bucket = age_bucket(F.col("start_time"), moment(f.instant()))
    grid = build_grid(chosen)
    found = containing_polygons(parked, grid).withColumn("bucket", bucket)
    counts = [F.count_if(F.col("bucket") == i) for i in range(len(NO_EVENTS))]
    stats = found.groupBy("zone_id").agg(F.array(*counts).alias("stats"))
    return (chosen.join(grid.per_polygon(stats), "zone_id", "left")
            .select("zone_id", "name", "municipality", "zone_type",
                    F.coalesce("stats", F.array(*(F.lit(n).cast("bigint") for n in NO_EVENTS))).alias("stats")))


def zone_occupancy(events: DataFrame, zones: DataFrame, public_zones: DataFrame) -> DataFrame:
    """Vehicles parked now per public zone and operator, nested per zone; zones without vehicles stay."""
    shapes = zones.join(public_zones.select("zone_id"), "zone_id", "left_semi").select("zone_id", "rings")
    grid = build_grid(shapes)
    found = containing_polygons(events.where(parked_now()), grid)
    counts = found.groupBy("zone_id", "system_id").agg(F.count("*").alias("number_of_vehicles"))
    # One item per operator: the counts above bound the list.
    nested = counts.groupBy("zone_id").agg(F.sort_array(F.collect_list(
        F.struct("system_id", "number_of_vehicles"))).alias("operators"))
    no_operators = F.array().cast("array<struct<system_id: string, number_of_vehicles: bigint>>")
    return (public_zones.join(grid.per_polygon(nested), "zone_id", "left").join(shapes, "zone_id", "left")
            .select("zone_id", "name", "capacity", F.coalesce("operators", no_operators).alias("operators"),
                    geojson_from_rings("rings").alias("geojson")))


# --- the index of events by date --------------------------------------------------------------------------------

def _touched_days(events: DataFrame, horizon: datetime, *columns: str) -> DataFrame:
    """The events once per date they touch. An open event counts up to the horizon; one that starts after it, or ends
    before it starts, touches no date."""
    until = F.coalesce("end_time", moment(horizon))
    first, last = F.col("start_time").cast("date"), until.cast("date")
    days = F.when(first <= last, F.sequence(first, last, F.expr("interval 1 day")))
    return events.where(F.col("start_time") <= until).select(*columns, F.explode(days).alias("on_date"))


def build_date_index(events: DataFrame, horizon: datetime) -> DataFrame:
    """Ids of the events that touch a date, and on which days those events start.

    One array holds ids of one run of consecutive ids only, however many events a date has.
    """
    run = F.shiftright("park_event_id", INDEX_RUN_BITS).alias("chunk")
    return (_touched_days(events, horizon, "park_event_id").groupBy("on_date", run)
            .agg(F.sort_array(F.collect_list("park_event_id")).alias("park_event_ids")))


# An event is in at most two blocks of days a level, so levels for all days there can be are enough.
INDEX_LEVELS = range(22)


def build_bitmap_index(events: DataFrame, horizon: datetime) -> DataFrame:
    """(level, block, bucket, ids): bitmaps of the events that touch every day of a block of 2^level days.

    The days of an event are the union of a few blocks, at most two a level, so building writes a row or two for a short
    event and some twenty for one of a thousand days. A bitmap holds the ids of one bucket of 32 768 and has a fixed size;
    tasks merge bitmaps before they shuffle them. Events touch dates as in `build_date_index`.
    """
    until = F.coalesce("end_time", moment(horizon))
    touched = events.where(F.col("start_time") <= until).select(
        "park_event_id", F.unix_date(F.col("start_time").cast("date")).alias("first"), (F.unix_date(until.cast("date")) + 1).alias("end"))
    blocks = F.expr(f"""aggregate(sequence(0, {INDEX_LEVELS[-1]}),
        named_struct('a', first, 'b', end, 'blocks', cast(array() as array<struct<level: int, block: int>>)),
        (s, k) -> case when s.a >= s.b then s else named_struct('a', shiftright(s.a + (s.a & 1), 1), 'b', shiftright(s.b - (s.b & 1), 1),
            'blocks', concat(s.blocks, case when s.a & 1 = 1 then array(named_struct('level', k, 'block', s.a)) else array() end,
                case when s.b & 1 = 1 then array(named_struct('level', k, 'block', s.b - 1)) else array() end)) end,
        s -> s.blocks)""")
    return (touched.select("park_event_id", F.inline(blocks))
            .groupBy("level", "block", F.bitmap_bucket_number("park_event_id").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("park_event_id")).alias("ids")))


def events_by_bitmap_index(events: DataFrame, index: DataFrame, f: Filter, max_bitmaps: int = 4096) -> DataFrame:
    """Events parked at the timestamp, found through the bitmaps of its date: one block a level, merged by bucket.

    A bitmap is never unfolded: an event asks for its bit. Up to `max_bitmaps` of 4 KB are broadcast.
    """
    day = (f.instant().date() - date(1970, 1, 1)).days
    on_date = F.lit(False)
    for level in INDEX_LEVELS:
        on_date |= (F.col("level") == level) & (F.col("block") == day >> level)
    merged = index.where(on_date).groupBy("bucket").agg(F.bitmap_or_agg("ids").alias("ids"))
    candidates = keep(_parked(events, f), f.by_operator())
    bit = """cast(conv(hex(substring(ids, cast(bitmap_bit_position(park_event_id) div 8 as int) + 1, 1)), 16, 10) as int)
        & shiftleft(1, cast(bitmap_bit_position(park_event_id) % 8 as int)) <> 0"""
    found = lookup_join(candidates.withColumn("bucket", F.bitmap_bucket_number("park_event_id")), merged, "bucket", max_rows=max_bitmaps)
    return found.where(bit).select(*events.columns)


def build_day_index(events: DataFrame, horizon: datetime) -> DataFrame:
    """(on_date, start_date): the days on which events start that touch a date. A few rows a day, whatever the data."""
    started = F.col("start_time").cast("date").alias("start_date")
    return _touched_days(events.select("start_time", "end_time", started), horizon, "start_date").distinct().select("on_date", "start_date")


def park_events_through_days(events: DataFrame, days: DataFrame, f: Filter) -> DataFrame:
    """Events parked at the timestamp, from a table stored by `start_date`: only the days that the index names are read.

    The join is on the partition column, so days without an event that touches the date are pruned when the query runs.
    """
    at = F.lit(f.instant().date().isoformat()).cast("date")
    wanted = days.where(F.col("on_date") == at).select(START_DATE)
    candidates = keep(_parked(events, f), f.by_operator())
    # one row a day of history at most
    return candidates.join(F.broadcast(wanted), START_DATE, "left_semi").select(*events.columns)


def events_by_date_index(events: DataFrame, index: DataFrame, f: Filter) -> DataFrame:
    """Events parked at the timestamp, found through the index of its date."""
    day = F.lit(f.instant().date().isoformat()).cast("date")
    ids = index.where(F.col("on_date") == day).select(F.explode("park_event_ids").alias("park_event_id"))
    candidates = keep(_parked(events, f), f.by_operator())
    return candidates.join(ids, "park_event_id", "left_semi")
