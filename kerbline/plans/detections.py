"""Vehicle detections: last positions and movements."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kerbline.filters import in_box
from kerbline.functions.geometry import sphere_metres
from kerbline.operators.skew import latest, with_previous
from kerbline.operators.spatial import build_grid, in_any_polygon

POSITION_COLUMNS = ("last_time_imported", "bike_id", "lat", "lon", "system_id", "is_check_in", "is_check_out")
MOVED_METRES = 200.0
# Detections of one vehicle are compared hour by hour first, so that no vehicle is one task.
TIMELINE_SLICE = "hour"


def snapshot(detections: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Latest detection per vehicle; the higher sample id where two share the time. `rows` may hold more than `detections`."""
    return latest(detections, "bike_id", "last_time_imported", "sample_id", rows)


def all_positions(positions: DataFrame) -> DataFrame:
    return positions.select(*POSITION_COLUMNS)


def positions_in_box(positions: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    return positions.where(in_box(west, south, east, north)).select(*POSITION_COLUMNS)


def _inside_municipality(points: DataFrame, areas: DataFrame, gm_code: str) -> DataFrame:
    # One area, and the same each time it is evaluated: of several the least one.
    area = (areas.where((F.col("gm_code") == gm_code) & F.col("rings").isNotNull())
            .groupBy("gm_code").agg(F.min("rings").alias("rings")))
    return in_any_polygon(points, build_grid(area, "gm_code"))


def positions_in_municipality(positions: DataFrame, areas: DataFrame, gm_code: str) -> DataFrame:
    return _inside_municipality(positions, areas, gm_code).select(*POSITION_COLUMNS)


def latest_positions(detections: DataFrame, areas: DataFrame, gm_code: str) -> DataFrame:
    """Latest detection per vehicle among those inside the municipality."""
    inside = _inside_municipality(detections, areas, gm_code)
    return snapshot(inside, detections).select("bike_id", "last_time_imported", "lat", "lon")


def movements(detections: DataFrame, threshold: float = MOVED_METRES) -> DataFrame:
    """Detections further than the threshold from the previous one of the same vehicle. Without an id there is no vehicle."""
    columns = ["sample_id", "bike_id", "last_time_imported", "lon", "lat"]
    compared = with_previous(detections.where(F.col("bike_id").isNotNull()).select(*columns), "bike_id", ["last_time_imported", "sample_id"],
                             ["last_time_imported", "lon", "lat"],
                             F.date_trunc(TIMELINE_SLICE, "last_time_imported"))
    metres = sphere_metres(F.col("previous_lon"), F.col("previous_lat"), F.col("lon"), F.col("lat"))
    return compared.withColumn("distance", metres).where(F.col("distance") > threshold)
