"""The tables of the model, derived from a star schema of orders, line items and events.

Every table is a select list in SQL text that Spark and any ANSI engine read alike, so that the same text also
serves an independent check. `rings` differ between engines and are added on the Spark side.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from kerbline.model import SCHEMAS
from kerbline.sources.dimensions import literal_table


@dataclass(frozen=True)
class Select:
    source: str
    columns: dict[str, str]
    where: str | None = None
    group_by: tuple[str, ...] = ()

    def sql(self) -> str:
        items = ", ".join(f"{expr} AS {name}" for name, expr in self.columns.items())
        text = f"SELECT {items} FROM {self.source}"
        if self.where:
            text += f" WHERE {self.where}"
        if self.group_by:
            text += " GROUP BY " + ", ".join(self.columns[g] for g in self.group_by)
        return text


def lon(key: str) -> str:
    return f"4e0 + (({key} * 7919) % 10007) / 10007e0 * 2.5e0"


def lat(key: str) -> str:
    return f"50e0 + (({key} * 104729) % 10009) / 10009e0 * 2.5e0"


def operator(key: str) -> str:
    return f"concat('op_', cast({key} % 6 as string))"


def bike(key: str) -> str:
    return f"concat('bike_', cast({key} as string))"


_PARK_START = "o_orderdate + (o_custkey % 1440) * interval '1' minute"
_SERIES = {
    "time": "ts",
    "zone_id": "cast(user_id % 25 + 1 as bigint)",
    "system_id": operator("user_id"),
    "modality": "case event_type when 'click' then 'bicycle' when 'view' then 'moped' else 'car' end",
}

# The derivation of every table.
DERIVATIONS: dict[str, tuple[Select, ...]] = {
    "park_events": (Select("orders", {
        "park_event_id": "o_orderkey",
        "system_id": operator("o_custkey"),
        "bike_id": bike("o_custkey"),
        "vehicle_type_id": "cast(o_orderkey % 7 as int)",
        "lon": lon("o_orderkey"),
        "lat": lat("o_orderkey"),
        "start_time": _PARK_START,
        "end_time": "case when o_orderstatus = 'O' and o_orderdate >= cast('2001-06-01' as timestamp) then null "
                    f"else {_PARK_START} + (cast(floor(o_totalprice) as bigint) % 480) * interval '1' hour end",
    }),),
    "trips": (Select("lineitem", {
        "trip_id": "l_orderkey * 8 + l_linenumber",
        "system_id": operator("l_suppkey"),
        "bike_id": bike("l_suppkey"),
        "vehicle_type_id": "cast(l_linenumber as int)",
        "start_lon": lon("l_partkey"),
        "start_lat": lat("l_partkey"),
        "end_lon": lon("l_orderkey"),
        "end_lat": lat("l_orderkey"),
        "start_time": "l_shipdate + (l_partkey % 1440) * interval '1' minute",
        "end_time": "l_shipdate + (l_partkey % 1440 + cast(floor(l_quantity) as bigint)) * interval '1' minute",
    }),),
    "zones": (
        Select("nation", {
            "zone_id": "cast(n_nationkey + 1 as bigint)",
            "name": "n_name",
            "owner": "cast(null as string)",
            "municipality": "concat('GM000', cast(n_regionkey as string))",
            "zone_type": "case when n_nationkey >= 20 then 'custom' else 'residential_area' end",
            "stats_ref": "concat('cbs:', cast(n_nationkey + 1 as string))",
            "cx": "4.25e0 + 0.5e0 * (n_nationkey % 5)",
            "cy": "50.25e0 + 0.5e0 * floor(n_nationkey / 5e0)",
            "hw": "0.25e0",
            "hh": "0.2e0",
        }),
        Select("region", {
            "zone_id": "cast(r_regionkey + 101 as bigint)",
            "name": "r_name",
            "owner": "cast(null as string)",
            "municipality": "concat('GM000', cast(r_regionkey as string))",
            "zone_type": "'municipality'",
            "stats_ref": "concat('cbs:', cast(r_regionkey + 101 as string))",
            "cx": "4.25e0 + 0.5e0 * r_regionkey",
            "cy": "51.25e0",
            "hw": "0.25e0",
            "hh": "2.6e0",
        }),
    ),
    "stats_pre_process": (Select("events", {
        "date": "cast(ts as date)",
        "zone_ref": "case when event_id % 3 = 0 then concat('cbs:', cast(user_id % 5 + 101 as string)) "
                    "else concat('cbs:', cast(user_id % 25 + 1 as string)) end",
        "stat_description": "case event_id % 7 when 0 then 'number_of_vehicles_available' "
                            "when 1 then 'number_of_trip_started' when 2 then 'number_of_trips_ended' "
                            "when 3 then 'sum_of_trip_duration' "
                            "when 4 then 'number_of_vehicles_available_longer_then_24_hours' "
                            "when 5 then 'number_of_vehicles_available_longer_then_4_days' "
                            "else 'number_of_vehicles_available_longer_then_7_days' end",
        "system_id": "case when user_id % 7 = 0 then '' else concat('op_', cast(user_id % 6 as string)) end",
        "value": "cast(floor(sum(value)) as bigint)",
    }, group_by=("date", "zone_ref", "stat_description", "system_id")),),
    "stats_number_of_vehicles_parked": (Select("events", {
        **_SERIES, "number_of_vehicles_parked": "cast(floor(value) as bigint)"}),),
    "stats_number_of_trips": (Select("events", {
        **_SERIES, "number_of_trips_started": "cast(floor(value) as bigint) % 7",
        "number_of_trips_ended": "cast(floor(value) as bigint) % 5"}),),
    "bike_detection": (Select("events", {
        "sample_id": "event_id",
        "bike_id": bike("user_id"),
        "system_id": operator("user_id"),
        "lon": lon("event_id"),
        "lat": lat("event_id"),
        "last_time_imported": "ts",
        "is_check_in": "event_type = 'signup'",
        "is_check_out": "event_type = 'purchase'",
    }),),
    "feeds": (Select("supplier", {
        "feed_id": "s_suppkey",
        "system_id": operator("s_suppkey"),
        "feed_type": "case when s_suppkey % 2 = 0 then 'gbfs' else 'tomp' end",
        "last_time_succesfully_imported": "case when s_suppkey % 10 = 9 then null else "
                                          "cast('2024-01-30 12:00:00' as timestamp) "
                                          "- (s_suppkey % 9) * interval '1' minute end",
        "is_active": "s_suppkey % 5 <> 0",
        "import_vehicles": "s_suppkey % 4 <> 0",
    }),),
    "geographies": (Select("nation", {
        "zone_id": "cast(n_nationkey + 1 as bigint)",
        "retire_date": "case when n_nationkey % 6 = 0 then cast('2023-06-01' as date) else null end",
    }, where="n_nationkey % 4 <> 3"),),
    "municipalities_with_data": (Select("region", {
        "municipality": "concat('GM000', cast(r_regionkey as string))",
        "name": "r_name",
    }, where="r_regionkey <> 4"),),
    "municipalities": (Select("region", {
        "gm_code": "concat('GM000', cast(r_regionkey as string))",
        "cx": "case when r_regionkey = 4 then null else 4.25e0 + 0.5e0 * r_regionkey end",
        "cy": "51.25e0",
        "hw": "0.25e0",
        "hh": "2.6e0",
    }),),
    "user_account": (Select("customer", {
        "user_id": "c_name",
        "organisation_id": "cast(c_nationkey as bigint)",
        "privileges": "case when c_custkey % 10 = 0 then 'DOWNLOAD_RAW_DATA' "
                      "when c_custkey % 10 = 1 then 'ORGANISATION_ADMIN,DOWNLOAD_RAW_DATA' else '' end",
    }),),
    "organisation": (Select("nation", {
        "organisation_id": "cast(n_nationkey as bigint)",
        "type_of_organisation": "case n_nationkey % 5 when 0 then 'ADMIN' when 1 then 'MUNICIPALITY' "
                                "when 4 then 'OTHER' else 'OPERATOR' end",
        "data_owner_of_municipalities": "case when n_nationkey % 5 = 1 then "
                                        "concat('GM000', cast(cast(floor(n_nationkey / 5e0) as int) as string)) "
                                        "else '' end",
        "data_owner_of_operators": "case when n_nationkey % 5 in (2, 3) then "
                                   "concat('op_', cast(n_nationkey % 6 as string)) else '' end",
    }),),
    "view_data_access": (Select("supplier", {
        "owner_organisation_id": "cast(s_nationkey as bigint)",
        "granted_organisation_id": "case when s_suppkey % 3 = 0 then cast(s_suppkey % 25 as bigint) else null end",
        "granted_user": "case when s_suppkey % 3 = 1 then "
                        "concat('Customer#', lpad(cast(s_suppkey as string), 9, '0')) else null end",
    }),),
    # One request per user account, so that every rule of the access decision occurs.
    "requests": (Select("customer", {
        "request_id": "c_custkey",
        "user_id": "c_name",
        "gm_code": "concat('GM000', cast(c_custkey % 5 as string))",
        "zone_ids": "case c_custkey % 4 when 0 then '' when 1 then concat(cast(c_nationkey + 1 as string), ',101') "
                    "when 2 then '2,7,102' else '102' end",
        "operators": "case when c_custkey % 3 = 0 then '' when c_custkey % 3 = 1 then "
                     "concat('op_', cast(c_nationkey % 6 as string)) else 'op_2,op_3' end",
    }),),
    # One drawn zone per supplier; some stick out of their municipality by more than the tolerance.
    "zone_requests": (Select("supplier", {
        "request_id": "s_suppkey",
        "name": "s_name",
        "municipality": "concat('GM000', cast(s_suppkey % 5 as string))",
        "cx": "4.25e0 + 0.5e0 * (s_suppkey % 5) + ((s_suppkey * 31) % 41 - 20) / 100e0",
        "cy": "50.5e0 + ((s_suppkey * 17) % 151) / 100e0",
        "hw": "0.04e0",
        "hh": "0.03e0",
    }),),
}

# Columns of the star schema that the derivations use.
RAW_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
}

# Vehicle types. Ids from 5 on occur in the facts and are unmatched on purpose.
VEHICLE_TYPES = ((0, "bicycle"), (1, "moped"), (2, "cargo_bicycle"), (3, "car"), (4, "kick_scooter"))

# An open parking interval counts for the date index up to this day.
INDEX_HORIZON = "2001-08-19"

_TEXT_ARRAYS = {"user_account": ("privileges",),
                "organisation": ("data_owner_of_municipalities", "data_owner_of_operators"),
                "requests": ("zone_ids", "operators")}


def _diamond(df: DataFrame) -> DataFrame:
    point = "named_struct('x', cx {0} hw, 'y', cy)", "named_struct('x', cx, 'y', cy {0} hh)"
    left, right = point[0].format("-"), point[0].format("+")
    bottom, top = point[1].format("-"), point[1].format("+")
    ring = F.expr(f"array(array({left}, {bottom}, {right}, {top}, {left}))")
    return df.withColumn("rings", F.when(F.col("cx").isNotNull(), ring)).drop("cx", "cy", "hw", "hh")


# The corners of a second shape of the small zones, by half widths and heights from the centre: a box with a
# notch from the east, a hole in its west, and a box of its own inside the notch. Boxes of neighbours share a border.
NOTCHED = (
    ((-1.0, -1.0), (1.0, -1.0), (0.0, 0.0), (1.0, 1.0), (-1.0, 1.0), (-1.0, -1.0)),
    ((-0.75, -0.25), (-0.5, -0.25), (-0.5, 0.25), (-0.75, 0.25), (-0.75, -0.25)),
    ((0.75, -0.125), (0.875, -0.125), (0.875, 0.125), (0.75, 0.125), (0.75, -0.125)),
)


def notched(zones: DataFrame, half_width: float = 0.25, half_height: float = 0.2) -> DataFrame:
    """The small zones with the second shape around the centre of their diamond."""
    diamond = F.element_at("rings", 1)
    cx, cy = F.element_at(diamond, 2)["x"], F.element_at(diamond, 1)["y"]

    def corner(x: float, y: float):
        return F.struct((cx + F.lit(half_width * x)).alias("x"), (cy + F.lit(half_height * y)).alias("y"))

    return zones.withColumn("rings", F.array(*(F.array(*(corner(*c) for c in ring)) for ring in NOTCHED)))


# Small zones that are left out where the others are joined, and where events are moved: onto the lines between boxes along
# one axis, onto their crossings, or nowhere.
LEFT_OUT = (1, 13, 19, 23)
SNAPPED = {"lon": "case when park_event_id % 4 < 3 then floor(lon * 4 + 0.5e0) / 4e0 else lon end",
           "lat": "case when park_event_id % 4 < 2 then floor(lat * 4 + 0.5e0) / 4e0 else lat end"}


def boxed(zones: DataFrame, half: float = 0.25) -> DataFrame:
    """The small zones as boxes that share all their sides."""
    diamond = F.element_at("rings", 1)
    cx, cy = F.element_at(diamond, 2)["x"], F.element_at(diamond, 1)["y"]
    corners = ((-half, -half), (half, -half), (half, half), (-half, half), (-half, -half))
    return zones.withColumn("rings", F.array(F.array(*(F.struct((cx + x).alias("x"), (cy + y).alias("y")) for x, y in corners))))


class Fixtures:
    """Tables of the model over a folder of star-schema Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    def select_from(self, name: str, source: DataFrame) -> DataFrame:
        """A table of one ungrouped select over another source with the same columns, such as a stream."""
        (part,) = DERIVATIONS[name]
        return source.selectExpr(*(f"{expr} AS {column}" for column, expr in part.columns.items()))

    def _select(self, part: Select) -> DataFrame:
        source = self.raw(part.source)
        if part.where:
            source = source.where(part.where)
        if not part.group_by:
            return source.selectExpr(*(f"{expr} AS {name}" for name, expr in part.columns.items()))
        keys = [F.expr(part.columns[g]).alias(g) for g in part.group_by]
        values = [F.expr(e).alias(n) for n, e in part.columns.items() if n not in part.group_by]
        return source.groupBy(*keys).agg(*values)

    def table(self, name: str) -> DataFrame:
        if name == "vehicle_type":
            return literal_table(self.spark, VEHICLE_TYPES, SCHEMAS["vehicle_type"])
        df = reduce(DataFrame.unionByName, (self._select(part) for part in DERIVATIONS[name]))
        if "cx" in df.columns:
            df = _diamond(df)
        for column in _TEXT_ARRAYS.get(name, ()):
            df = df.withColumn(column, F.filter(F.split(column, ","), lambda item: item != ""))
        for field in SCHEMAS.get(name, ()):
            if field.dataType.simpleString() == "timestamp_ntz":
                df = df.withColumn(field.name, F.col(field.name).cast("timestamp_ntz"))
        return df
