"""Daily statistics per operator and period, and checks on their completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kerbline.filters import Filter, keep, operator_present
from kerbline.functions.calendar import PERIODS, calendar, level
from kerbline.model import TRIPS_STARTED, VEHICLES_AVAILABLE
from kerbline.operators.gapfill import gap_fill
from kerbline.operators.lookup import lookup_join


def _facts(stats: DataFrame, zones: DataFrame, f: Filter, description: str) -> DataFrame:
    """Daily values of one statistic in the period. Zones that share a reference repeat its values."""
    refs = keep(zones, f.by_zone()).select(F.col("stats_ref").alias("zone_ref"))
    chosen = keep(stats, f.in_days("date"), F.col("stat_description") == description, f.by_operator(),
                  operator_present())
    return lookup_join(chosen.select("date", "zone_ref", "system_id", "value"), refs, "zone_ref")


def _densified(values: DataFrame, f: Filter, aggregation: str) -> DataFrame:
    """One row per period of the calendar for every operator found, 0 where it has no value."""
    unit = level(aggregation, PERIODS)
    start, end = f.period()
    return gap_fill(values, ["system_id"], "time_period", unit.floor(start), unit.floor(end), unit.interval(),
                    {"value": F.lit(0).cast("bigint")}).orderBy("time_period", "system_id")


def available_vehicles(stats: DataFrame, zones: DataFrame, f: Filter, aggregation: str) -> DataFrame:
    """Mean over the days of a period of the vehicles available in the zones, rounded half up."""
    unit = level(aggregation, PERIODS)
    daily = (_facts(stats, zones, f, VEHICLES_AVAILABLE).groupBy("date", "system_id")
             .agg(F.sum("value").alias("value")))
    mean = (daily.groupBy("system_id", unit.bucket(F.col("date")).alias("time_period"))
            .agg(F.round(F.avg("value")).cast("bigint").alias("value")))
    return _densified(mean, f, aggregation)


def rentals_started(stats: DataFrame, zones: DataFrame, f: Filter, aggregation: str) -> DataFrame:
    """Rentals started in the zones per period."""
    unit = level(aggregation, PERIODS)
    total = (_facts(stats, zones, f, TRIPS_STARTED)
             .groupBy("system_id", unit.bucket(F.col("date")).alias("time_period"))
             .agg(F.sum("value").alias("value")))
    return _densified(total, f, aggregation)


def period_operator_grid(stats: DataFrame, zones: DataFrame, f: Filter, aggregation: str = "month",
                         description: str = TRIPS_STARTED) -> DataFrame:
    """Sum of a statistic per operator and period.

    A calendar of all (day, operator) pairs joined with the facts on both, then restricted by the facts, leaves
    exactly the facts; so the pairs are not built. Rows of all operators together (empty operator) stay.
    """
    unit = level(aggregation, PERIODS)
    refs = keep(zones, f.by_zone()).select(F.col("stats_ref").alias("zone_ref"))
    chosen = keep(stats, f.in_days("date"), F.col("stat_description") == description, f.by_operator(),
                  F.col("system_id").isNotNull())
    return (lookup_join(chosen, refs, "zone_ref")
            .groupBy("system_id", unit.bucket(F.col("date")).alias("time_period"))
            .agg(F.sum("value").alias("value")))


def pivot_by_operator(values: DataFrame, period: str = "time_period") -> DataFrame:
    """One record per period: its start and a map of operator → value. The number of operators bounds the map."""
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("system_id", "value"))))
    return values.groupBy(F.col(period).alias("start_interval")).agg(entries.alias("values")).orderBy("start_interval")


def pivot_columns(values: DataFrame, operators: list[str], period: str = "time_period") -> DataFrame:
    """As `pivot_by_operator` for known operators: one column each."""
    return (values.groupBy(F.col(period).alias("start_interval")).pivot("system_id", operators).agg(F.first("value"))
            .orderBy("start_interval"))


def missing_days(spark: SparkSession, stats: DataFrame, f: Filter, description: str) -> DataFrame:
    """Days of the period without any value of the statistic."""
    start, end = f.days()
    known = stats.where((F.col("stat_description") == description) & f.in_days("date")).select("date").distinct()
    return calendar(spark, start, end, "date").join(known, "date", "left_anti")


def aggregate_daily(stats_rows: DataFrame, description: str, value: str = "value") -> DataFrame:
    """Rows of (date, zone_ref, system_id) → the daily statistics table."""
    return (stats_rows.groupBy("date", "zone_ref", "system_id").agg(F.sum(value).cast("bigint").alias("value"))
            .select("date", "zone_ref", F.lit(description).alias("stat_description"), "system_id", "value"))
