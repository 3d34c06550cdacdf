"""Time series of parked vehicles and rentals in buckets of five minutes up to a month."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kerbline.filters import Filter, keep
from kerbline.functions.calendar import level
from kerbline.operators.gapfill import gap_fill

# The accepted aggregate functions.
FUNCTIONS = {"MIN": F.min, "MAX": F.max, "AVG": F.avg}
GROUPINGS = ("operator", "modality")


# Documents have no key for a missing name; the flat series keeps it as NULL.
NO_NAME = "unknown"


def _named(column: str):
    return F.coalesce(F.col(column), F.lit(NO_NAME))


def _chosen(series: DataFrame, f: Filter) -> DataFrame:
    return keep(series, f.in_period("time"), f.by_zone() if f.zone_ids else F.lit(False))


def availability_series(series: DataFrame, f: Filter, aggregation: str, function: str, group_by: str) -> DataFrame:
    """Parked vehicles per bucket and operator or modality, as `bucket, name, amount`.

    By operator: the aggregate per modality, added up. By modality: gaps are filled with NULL.
    """
    if function not in FUNCTIONS:
        raise ValueError(f"aggregation function must be one of {', '.join(FUNCTIONS)}, got {function!r}")
    if group_by not in GROUPINGS:
        raise ValueError(f"group_by must be one of {', '.join(GROUPINGS)}, got {group_by!r}")
    unit = level(aggregation)
    bucket = unit.bucket(F.col("time")).alias("bucket")
    amount = FUNCTIONS[function]("number_of_vehicles_parked").alias("amount")
    chosen = _chosen(series, f)
    if group_by == "operator":
        per_modality = chosen.groupBy(bucket, "system_id", "modality").agg(amount)
        return (per_modality.groupBy("bucket", F.col("system_id").alias("name"))
                .agg(F.sum("amount").alias("amount")).orderBy("bucket", "name"))
    start, end = f.period()
    per_modality = chosen.groupBy(bucket, F.col("modality").alias("name")).agg(amount)
    return gap_fill(per_modality, ["name"], "bucket", unit.floor(start), unit.floor(end), unit.interval(),
                    {"amount": None}).select("bucket", "name", "amount").orderBy("bucket", "name")


def rental_series(series: DataFrame, f: Filter, aggregation: str) -> DataFrame:
    """Rentals started and ended per bucket, operator and modality; gaps are filled with 0."""
    unit = level(aggregation)
    start, end = f.period()
    measures = ("number_of_trips_started", "number_of_trips_ended")
    zero = F.lit(0).cast("bigint")
    totals = (_chosen(series, f).groupBy("system_id", "modality", unit.bucket(F.col("time")).alias("bucket"))
              .agg(*(F.coalesce(F.sum(m), zero).alias(m) for m in measures)))
    return gap_fill(totals, ["system_id", "modality"], "bucket", unit.floor(start), unit.floor(end),
                    unit.interval(), {m: zero for m in measures}).orderBy("bucket", "system_id", "modality")


def availability_document(values: DataFrame) -> DataFrame:
    """One row per bucket: `time` and a map of name → amount. The number of names bounds the map.

    A missing name is `unknown`; where that name exists as well, the amounts are added up.
    """
    values = values.groupBy("bucket", _named("name").alias("name")).agg(F.sum("amount").alias("amount"))
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "amount"))))
    return values.groupBy(F.col("bucket").alias("time")).agg(entries.alias("values")).orderBy("time")


def rental_document(values: DataFrame) -> DataFrame:
    """One row per bucket: `time` and a map of operator → modality → started and ended; a missing name is `unknown`."""
    measures = ("number_of_trips_started", "number_of_trips_ended")
    values = values.groupBy("bucket", _named("system_id").alias("system_id"), _named("modality").alias("modality")).agg(
        *(F.sum(m).alias(m) for m in measures))
    counts = F.struct(F.col("number_of_trips_started").alias("rentals_started"),
                      F.col("number_of_trips_ended").alias("rentals_ended"))
    per_operator = values.groupBy("bucket", "system_id").agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("modality", counts.alias("counts"))))).alias("modalities"))
    return per_operator.groupBy(F.col("bucket").alias("time")).agg(F.map_from_entries(
        F.collect_list(F.struct("system_id", "modalities"))).alias("values")).orderBy("time")
