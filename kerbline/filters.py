"""The request filter: parsed once, then turned into Column predicates."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.functions.calendar import moment

TIMESTAMP_FORMAT = "%Y-%m-%dT%H:%M:%SZ"
UNKNOWN_FORM_FACTOR = "unknown"
# Partition column of fact tables that are stored by day.
START_DATE = "start_date"


def _items(args: Mapping, key: str) -> tuple[str, ...]:
    return tuple(args[key].split(",")) if args.get(key) else ()


def _time(text: str | datetime | None) -> datetime | None:
    """ISO date or timestamp → naive UTC; text without an offset is taken as UTC."""
    if text is None or text == "":
        return None
    value = text if isinstance(text, datetime) else datetime.fromisoformat(text)
    return value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value


@dataclass(frozen=True)
class Filter:
    zone_ids: tuple[int, ...] = ()
    operators: tuple[str, ...] = ()
    form_factors: tuple[str, ...] = ()
    municipalities: tuple[str, ...] = ()
    gm_code: str | None = None
    timestamp: datetime | None = None
    start_time: datetime | None = None
    end_time: datetime | None = None
    geojson: str | None = None

    @classmethod
    def from_args(cls, args: Mapping) -> Filter:
        """Read request arguments. An explicit list of municipalities replaces the one that `gm_code` implies."""
        gm_code = args.get("gm_code") or None
        stamp, shape = args.get("timestamp"), args.get("geojson")
        return cls(
            zone_ids=tuple(int(z) for z in _items(args, "zone_ids")),
            operators=_items(args, "operators"),
            form_factors=_items(args, "form_factors"),
            municipalities=_items(args, "municipalities") or ((gm_code,) if gm_code else ()),
            gm_code=gm_code,
            timestamp=datetime.strptime(stamp, TIMESTAMP_FORMAT) if stamp else None,
            start_time=_time(args.get("start_time")),
            end_time=_time(args.get("end_time")),
            geojson=(shape if isinstance(shape, str) else json.dumps(shape)) if shape else None,
        )

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, default=lambda v: v.isoformat())

    # --- required parts ---------------------------------------------------------------------------------------

    def instant(self) -> datetime:
        if self.timestamp is None:
            raise ValueError("the filter needs a timestamp")
        return self.timestamp

    def period(self) -> tuple[datetime, datetime]:
        if self.start_time is None or self.end_time is None:
            raise ValueError("the filter needs a start_time and an end_time")
        return self.start_time, self.end_time

    def days(self) -> tuple[date, date]:
        start, end = self.period()
        return start.date(), end.date()

    # --- predicates; None stands for "no restriction" -----------------------------------------------------------

    def by_operator(self, column: str = "system_id") -> Column | None:
        return F.col(column).isin(*self.operators) if self.operators else None

    def by_operator_or_all(self, column: str = "system_id") -> Column | None:
        """As `by_operator`, and the rows that stand for all operators together pass as well."""
        return F.col(column).isin(*self.operators, "") if self.operators else None

    def by_zone(self, column: str = "zone_id") -> Column | None:
        return F.col(column).isin(*self.zone_ids) if self.zone_ids else None

    def by_municipality(self, column: str = "municipality") -> Column | None:
        return F.col(column).isin(*self.municipalities) if self.municipalities else None

    def by_form_factor(self, column: str = "form_factor") -> Column | None:
        """`unknown` stands for vehicles whose type has no form factor."""
        if not self.form_factors:
            return None
        named = F.col(column).isin(*self.form_factors)
        return (named | F.col(column).isNull()) if UNKNOWN_FORM_FACTOR in self.form_factors else named

    def parked_at_instant(self) -> Column:
        at = moment(self.instant())
        return (F.col("start_time") < at) & ((F.col("end_time") > at) | F.col("end_time").isNull())

    def contained_in_period(self) -> Column:
        start, end = self.period()
        return (F.col("start_time") >= moment(start)) & (F.col("end_time") <= moment(end))

    def in_period(self, column: str) -> Column:
        start, end = self.period()
        return F.col(column).between(moment(start), moment(end))

    def in_days(self, column: str) -> Column:
        start, end = self.days()
        return F.col(column).between(F.lit(start.isoformat()).cast("date"), F.lit(end.isoformat()).cast("date"))


def keep(df: DataFrame, *predicates: Column | None) -> DataFrame:
    """Apply the predicates that are there."""
    for predicate in predicates:
        if predicate is not None:
            df = df.where(predicate)
    return df


def prune_days(df: DataFrame, first: datetime | None = None, last: datetime | None = None) -> DataFrame:
    """Skip whole days of a table that is stored by the day of `start_time`; other tables pass as they are.

    Rows of such a table never end before they start.
    """
    if START_DATE not in df.columns:
        return df
    day = F.col(START_DATE)
    return keep(df, None if first is None else day >= F.lit(first.date().isoformat()).cast("date"),
                None if last is None else day <= F.lit(last.date().isoformat()).cast("date"))


def parked_now() -> Column:
    return F.col("end_time").isNull()


def operator_present(column: str = "system_id") -> Column:
    return F.col(column).isNotNull() & (F.col(column) != "")


def in_box(west: float, south: float, east: float, north: float, lon: str = "lon", lat: str = "lat") -> Column:
    """Bounding box; a point on its edge counts."""
    return F.col(lon).between(west, east) & F.col(lat).between(south, north)
