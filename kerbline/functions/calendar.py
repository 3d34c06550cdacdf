"""Buckets, periods and calendars."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def moment(value: datetime) -> Column:
    """A constant instant without time zone."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


@dataclass(frozen=True)
class Level:
    """A bucket width: how to truncate to it and how to step to the next bucket."""

    name: str
    label: str
    step: str
    unit: str | None = None
    window: str | None = None

    def bucket(self, time: Column) -> Column:
        """Start of the bucket that holds `time`. Weeks start on Monday."""
        start = F.window(time, self.window)["start"] if self.window else F.date_trunc(self.unit, time)
        return start.cast("timestamp_ntz")

    def interval(self) -> Column:
        return F.expr(f"interval {self.step}")

    def floor(self, value: datetime) -> Column:
        """The bucket of a constant, as a constant."""
        if self.window:
            width = int(self.window.split()[0])
            return moment(value.replace(minute=value.minute // width * width, second=0, microsecond=0))
        return F.date_trunc(self.unit, moment(value)).cast("timestamp_ntz")


# The accepted names of aggregation levels and the text they stand for.
LEVELS = {
    "5m": Level("5m", "5 minutes", "5 minutes", window="5 minutes"),
    "15m": Level("15m", "15 minutes", "15 minutes", window="15 minutes"),
    "hour": Level("hour", "1 hour", "1 hour", unit="hour"),
    "day": Level("day", "1 day", "1 day", unit="day"),
    "week": Level("week", "1 week", "7 days", unit="week"),
    "month": Level("month", "1 month", "1 month", unit="month"),
}
PERIODS = ("day", "week", "month")


def level(name: str, allowed: tuple[str, ...] = tuple(LEVELS)) -> Level:
    if name not in allowed:
        raise ValueError(f"aggregation level must be one of {', '.join(allowed)}, got {name!r}")
    return LEVELS[name]


def calendar(spark: SparkSession, start: date, end: date, column: str = "stat_date") -> DataFrame:
    """One row per day, both ends included."""
    days = F.sequence(F.lit(start.isoformat()).cast("date"), F.lit(end.isoformat()).cast("date"),
                      F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(days).alias(column))


def days_in_period(start: date, end: date) -> int:
    """Number of days, both ends included."""
    return (end - start).days + 1


def hours_between(start: Column, end: Column) -> Column:
    """Whole hours from start to end."""
    return F.timestamp_diff("HOUR", start, end)
