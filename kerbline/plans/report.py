"""The period report of a municipality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kerbline import model
from kerbline.filters import Filter, keep
from kerbline.functions.calendar import days_in_period
from kerbline.operators.lookup import lookup_join

REPORT_ZONE_TYPES = ("municipality", "residential_area")
LETTERS = tuple("abcdefghij")


def _facts(stats: DataFrame, zones: DataFrame, f: Filter) -> DataFrame:
    """Statistics of the municipality in the period. Rows of all operators together pass every operator filter."""
    refs = (zones.where((F.col("municipality") == f.gm_code) & F.col("stats_ref").isNotNull())
            .select("municipality", F.col("stats_ref").alias("zone_ref")).distinct())
    return lookup_join(keep(stats, f.in_days("date"), f.by_operator_or_all()), refs, "zone_ref")


def report_triples(stats: DataFrame, zones: DataFrame, f: Filter) -> DataFrame:
    """Mean, count and sum of every statistic per zone and operator, by mean."""
    return (_facts(stats, zones, f).groupBy("zone_ref", "stat_description", "system_id")
            .agg(F.avg("value").alias("avg"), F.count("value").alias("count"), F.sum("value").alias("sum"))
            .orderBy("avg", "zone_ref", "stat_description", "system_id"))


def active_operators(stats: DataFrame, zones: DataFrame, f: Filter) -> DataFrame:
    return _facts(stats, zones, f).select("system_id").distinct()


def _ratio(top: Column, bottom: Column) -> Column:
    """The quotient, or 0 where the divisor is not positive."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def indicators(stats: DataFrame, zones: DataFrame, f: Filter) -> DataFrame:
    """Indicators a to j per municipality, zone reference and operator. NULL as operator counts as all operators together."""
    days = F.lit(float(days_in_period(*f.days())))
    names = {
        "available": model.VEHICLES_AVAILABLE, "started": model.TRIPS_STARTED, "ended": model.TRIPS_ENDED,
        "duration": model.TRIP_DURATION, "over_day": model.LONGER_THAN_24_HOURS,
        "over_4_days": model.LONGER_THAN_4_DAYS, "over_7_days": model.LONGER_THAN_7_DAYS,
    }
    sums = [F.sum(F.when(F.col("stat_description") == description, F.col("value")).otherwise(0))
            .cast("double").alias(name) for name, description in names.items()]
    s = (_facts(stats, zones, f).withColumn("system_id", F.coalesce("system_id", F.lit("")))
         .groupBy("municipality", "zone_ref", "system_id").agg(*sums))
    c = {name: F.col(name) for name in names}
    a, b = c["available"] / days, c["started"] / days
    formulas = {
        "a": a, "b": b, "c": _ratio(b, a),
        "d": c["over_day"] / days, "e": _ratio(c["over_day"], c["available"]),
        "f": c["over_4_days"] / days, "g": _ratio(c["over_4_days"], c["available"]),
        "h": c["over_7_days"] / days, "i": _ratio(c["over_7_days"], c["available"]),
        "j": _ratio(c["duration"], c["ended"]) / 60.0,
    }
    return s.select("municipality", "zone_ref", "system_id", *(formulas[letter].alias(letter) for letter in LETTERS))


def report(stats: DataFrame, zones: DataFrame, f: Filter) -> DataFrame:
    """One row per active operator and report zone of the municipality; indicators are NULL without statistics.

    The indicators of an operator travel as a map over the zones of one municipality, which bounds it, so the
    statistics are read once for the active operators and their values.
    """
    values = F.struct(*LETTERS).alias("values")
    per_operator = (indicators(stats, zones, f).groupBy("municipality", "system_id")
                    .agg(F.map_from_entries(F.collect_list(F.struct("zone_ref", values))).alias("by_zone")))
    rows = zones.where((F.col("municipality") == f.gm_code) & F.col("zone_type").isin(*REPORT_ZONE_TYPES)).select(
        "municipality", "zone_type", "name", "stats_ref")
    found = F.try_element_at(F.col("by_zone"), F.col("stats_ref"))
    return (lookup_join(per_operator, rows, "municipality")
            .select("system_id", "zone_type", "name", "stats_ref",
                    *(found[letter].alias(letter) for letter in LETTERS)))


def sheet_order(rows: DataFrame) -> DataFrame:
    """The order of the lines of a report: per operator, zone type and name."""
    return rows.orderBy("system_id", "zone_type", "name")


def file_name(f: Filter, prefix: str = "report") -> str:
    start, end = f.days()
    return f"{prefix}_{start.isoformat()}_{end.isoformat()}_{f.gm_code}"
