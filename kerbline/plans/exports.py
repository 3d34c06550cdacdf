"""Raw-data export and the log tables around it."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from kerbline.filters import Filter, prune_days
from kerbline.functions.calendar import moment
from kerbline.operators.lookup import lookup_join
from kerbline.operators.spatial import build_grid, either_in_any_polygon, in_any_polygon
from kerbline.plans.access import AccessTables, Scope, decide_export, scope_of
from kerbline.plans.trips import END, START
from kerbline.session import shared_dir
from kerbline.sources.sinks import append, export_by_date


def _by_operator(facts: DataFrame, scope: Scope) -> DataFrame:
    return facts if scope.operators is None else lookup_join(facts, scope.operators, "system_id", "left_semi")


def _area(zones: DataFrame) -> DataFrame:
    """The zones of a scope, worked out once: covering them by cells looks at them several times."""
    path = shared_dir(zones.sparkSession, "scope-zones")
    shapes = zones.select("zone_id", "rings")
    shapes.write.parquet(path)
    return zones.sparkSession.read.schema(shapes.schema).parquet(path)


def visible_trips(trips: DataFrame, scope: Scope, f: Filter) -> DataFrame:
    """Trips of the period within the scope, all columns."""
    found = _by_operator(prune_days(trips, *f.period()).where(f.contained_in_period()), scope)
    if scope.zones is not None:
        found = either_in_any_polygon(found, build_grid(_area(scope.zones), union=True), START, END)
    return found.select(*trips.columns)


def visible_park_events(events: DataFrame, scope: Scope, f: Filter) -> DataFrame:
    """Park events that start in the period within the scope, all columns."""
    found = _by_operator(prune_days(events, *f.period()).where(f.in_period("start_time")), scope)
    if scope.zones is not None:
        found = in_any_polygon(found, build_grid(_area(scope.zones), union=True))
    return found.select(*events.columns)


def raw_export(trips: DataFrame, events: DataFrame, tables: AccessTables, user_id: str, f: Filter, folder: str,
               audit: str, raw_api_call: str, now: datetime) -> dict[str, str]:
    """Check the rights of a user, log the request, and write both tables by day; returns the folders.

    The user's grants are added to the filter first; what was asked on top of them must be granted as well.
    """
    f.period()
    spark = trips.sparkSession
    request = spark.createDataFrame([(1, user_id, [str(z) for z in f.zone_ids], list(f.operators))],
                                    "request_id bigint, user_id string, zone_ids array<string>, operators array<string>")
    asking = replace(tables, users=tables.users.where(F.col("user_id") == user_id))  # the filter reaches the reader
    refused = decide_export(request, asking).where(~F.col("allowed")).first()
    if refused is not None:
        raise PermissionError(refused["reason"])
    scope = scope_of(tables, user_id, f, decided=True)
    entry = spark.createDataFrame([(user_id, raw_api_call, f.to_json())], "user_id string, raw_api_call string, filter string")
    append(audit_rows(entry, now), audit)
    paths = {"trips": f"{folder}/trips", "park_events": f"{folder}/park_events"}
    export_by_date(visible_trips(trips, scope, f), paths["trips"])
    export_by_date(visible_park_events(events, scope, f), paths["park_events"])
    return paths


def audit_rows(requests: DataFrame, at: datetime) -> DataFrame:
    """Log rows of requests `user_id, raw_api_call` and their filter columns, the filter as JSON, keys sorted."""
    keys = sorted(c for c in requests.columns if c not in ("user_id", "raw_api_call", "request_id"))
    return requests.select(
        F.col("user_id").alias("username"), moment(at).alias("timestamp_accessed"), "raw_api_call",
        F.to_json(F.struct(*keys)).alias("filter_active"))


def named_visits(visits: DataFrame, salt: str) -> DataFrame:
    """(user_hash, role, active_on) of visits `user_id, role, visited_at`; visits without a name are left out.

    The name is stored as a salted hash only.
    """
    return visits.where(F.col("user_id").isNotNull() & (F.col("user_id") != "")).select(
        F.sha1(F.concat("user_id", F.lit(salt))).alias("user_hash"), "role",
        F.col("visited_at").cast("date").alias("active_on"))


def active_users(visits: DataFrame, salt: str) -> DataFrame:
    """One row per user and day; the least role where a day has several. Serves batches and streams alike."""
    return named_visits(visits, salt).groupBy("user_hash", "active_on").agg(F.min("role").alias("role")).select(
        "user_hash", "role", "active_on")


def role_of(filter_municipality: str = "filter_municipality", filter_operator: str = "filter_operator",
            is_admin: str = "is_admin"):
    """The role of a user summary: administrator first, then operator, then municipality."""
    return (F.when(F.col(is_admin), "admin").when(F.col(filter_operator), "operator")
            .when(F.col(filter_municipality), "municipality"))
