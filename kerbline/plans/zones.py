"""Zones: listing, export, changes, and finding the municipality of a point."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kerbline.filters import Filter, keep
from kerbline.functions import geometry as geo
from kerbline.operators.lookup import lookup_join
from kerbline.operators.spatial import build_grid, containing_polygons, first_polygon
from kerbline.session import shared_dir

ZONE_COLUMNS = ("zone_id", "name", "owner", "municipality", "zone_type")
CUSTOM, MUNICIPALITY = "custom", "municipality"

# A drawn zone may stick out of its municipality by this many degrees.
BORDER_TOLERANCE = 0.02


def zone_list(zones: DataFrame, geographies: DataFrame, f: Filter, include_custom: bool = True) -> DataFrame:
    """Zones of the municipalities that are not retired; a zone without a geography counts as not retired."""
    wanted = zones.where(f.by_municipality() if f.municipalities else F.lit(False))
    if not include_custom:
        wanted = wanted.where(F.col("zone_type") != CUSTOM)
    return (lookup_join(wanted.select(*ZONE_COLUMNS), geographies.select("zone_id", "retire_date"), "zone_id", "left")
            .where(F.col("retire_date").isNull()).select(*ZONE_COLUMNS))


def zones_with_geometry(zones: DataFrame, f: Filter) -> DataFrame:
    """Zones by id and municipality, with their area as GeoJSON text."""
    return (keep(zones, f.by_zone(), f.by_municipality())
            .select(*ZONE_COLUMNS, geo.geojson_from_rings("rings").alias("geojson")))


def municipalities(zones: DataFrame) -> DataFrame:
    return zones.where(F.col("zone_type") == MUNICIPALITY).select(*ZONE_COLUMNS).orderBy("name")


def municipality_area(areas: DataFrame, gm_code: str) -> DataFrame:
    """The area of a municipality as GeoJSON text."""
    return (areas.where((F.col("gm_code") == gm_code) & F.col("rings").isNotNull())
            .groupBy("gm_code").agg(F.min("rings").alias("rings"))
            .select("gm_code", geo.geojson_from_rings("rings").alias("geojson")))


def municipality_at(points: DataFrame, zones: DataFrame, keys: list[str], lon: str = "lon",
                    lat: str = "lat") -> DataFrame:
    """The municipality zone of every point, border points included; the lowest zone id where several match."""
    areas = zones.where(F.col("zone_type") == MUNICIPALITY)
    found = first_polygon(points, build_grid(areas), keys, lon, lat, geo.intersects)
    return lookup_join(found, areas.select(*ZONE_COLUMNS), "zone_id").select(*keys, *ZONE_COLUMNS)


# --- changes ------------------------------------------------------------------------------------------------

def _border_pieces(requests: DataFrame, levels: DataFrame) -> DataFrame:
    """The borders of drawn zones, cut where they leave a cell of their municipality's level.

    A piece is `x1 + t * dx, y1 + t * dy` for t from `t0` to `t1`, within the cell `_x, _y`.
    """
    edges = lookup_join(requests.select("request_id", "municipality", F.explode(geo.polygon_edges("rings")).alias("e")), levels, "municipality", "left")
    lines = edges.where("e.x1 <> e.x2 or e.y1 <> e.y2").selectExpr(
        "request_id", "municipality as _wanted", "pow(2d, coalesce(_level, 0)) as n", "e.x1", "e.y1", "e.x2 - e.x1 as dx", "e.y2 - e.y1 as dy")

    def crossings(at: str, by: str) -> str:
        low, high = f"floor(least({at}, {at} + {by}) * n)", f"floor(greatest({at}, {at} + {by}) * n)"
        return f"case when {by} <> 0 and {high} > {low} then transform(sequence({low} + 1, {high}), k -> (k / n - {at}) / {by}) else array() end"

    stops = f"array_sort(array_distinct(filter(concat(array(0d, 1d), {crossings('x1', 'dx')}, {crossings('y1', 'dy')}), t -> t between 0 and 1)))"
    cut = lines.withColumn("_stops", F.expr(stops)).withColumn(
        "_piece", F.expr("explode(zip_with(slice(_stops, 1, size(_stops) - 1), slice(_stops, 2, size(_stops) - 1), (a, b) -> named_struct('t0', a, 't1', b)))"))
    return cut.selectExpr("request_id", "_wanted", "x1", "y1", "dx", "dy", "_piece.t0", "_piece.t1",
                          "cast(floor((x1 + (_piece.t0 + _piece.t1) / 2 * dx) * n) as int) as _x",
                          "cast(floor((y1 + (_piece.t0 + _piece.t1) / 2 * dy) * n) as int) as _y")


def _uncovered_holes(requests: DataFrame, areas: DataFrame, tolerance: float) -> DataFrame:
    """(request_id) of drawn zones around a place that their municipality lacks: further than the tolerance from its border.

    A border that stays inside can still go around a hole. Places are tried a quarter of the tolerance apart, within holes only.
    """
    step = f"{tolerance / 4!r}d"
    holes = areas.where("size(rings) > 1").withColumn("_all", geo.polygon_edges("rings")).selectExpr("municipality", "_all", "explode(rings) as ring")
    def steps(axis: str) -> str:
        return f"explode(sequence(cast(floor(array_min(ring.{axis}) / {step}) as bigint), cast(floor(array_max(ring.{axis}) / {step}) as bigint)))"

    columns = holes.selectExpr("municipality", "_all", "ring", f"{steps('x')} as i").selectExpr("*", f"{steps('y')} as j")
    inside = columns.selectExpr("municipality", "_all", f"i * {step} as lon", f"j * {step} as lat", "array(ring) as _own").withColumn("_ring", geo.polygon_edges("_own"))
    # inside this ring, outside the area, and away from every edge
    along = "((lon - e.x1) * (e.x2 - e.x1) + (lat - e.y1) * (e.y2 - e.y1))"
    length = "((e.x2 - e.x1) * (e.x2 - e.x1) + (e.y2 - e.y1) * (e.y2 - e.y1))"
    share = f"least(greatest(case when {length} > 0 then {along} / {length} else 0d end, 0d), 1d)"
    away = f"forall(_all, e -> pow(lon - (e.x1 + {share} * (e.x2 - e.x1)), 2) + pow(lat - (e.y1 + {share} * (e.y2 - e.y1)), 2) > {tolerance * tolerance!r}d)"
    lacking = inside.where(f"{geo.parity('_ring', 'lon', 'lat')} and not {geo.parity('_all', 'lon', 'lat')} and {away}").selectExpr("municipality as _of", "lon", "lat")
    met = containing_polygons(lacking, build_grid(requests.select("request_id", "rings"), "request_id"))
    return met.join(requests.select("request_id", F.col("municipality").alias("_of")), ["request_id", "_of"], "left_semi").select("request_id").distinct()


def check_zone_requests(requests: DataFrame, zones: DataFrame, tolerance: float = BORDER_TOLERANCE) -> DataFrame:
    """`is_valid` per drawn zone: does it stay inside its municipality, give or take the tolerance?

    The border is taken apart by the cells of the municipality. In a cell every edge of the municipality accounts for the
    part of a piece that is near it; what is left of the piece crosses no edge, so one point tells whether it is inside.
    """
    # A municipality has one area; the lowest zone id where the data holds several.
    areas = (zones.where(F.col("zone_type") == MUNICIPALITY)
             .groupBy("municipality").agg(F.min_by("rings", "zone_id").alias("rings")))
    # whole areas have one level each, so that a piece meets one cell
    grid = build_grid(areas, "municipality", margin=tolerance, cell_edges=2**31 - 1)
    pieces = _border_pieces(requests, grid.cells.groupBy("municipality").agg(F.first("_level").alias("_level")))
    met = pieces.join(grid.per_polygon(grid.cells), F.expr("_wanted = municipality and _x = _cell_x and _y = _cell_y"), "left")
    spans = f"array_sort({geo.near_span('_edges', tolerance)})"
    walked = f"""aggregate(_spans, named_struct('at', t0, 'gaps', cast(array() as array<struct<a: double, b: double>>)),
        (w, s) -> named_struct('at', greatest(w.at, s.high), 'gaps', case when s.low - w.at > 1e-12d and w.at < t1
            then concat(w.gaps, array(named_struct('a', w.at, 'b', least(s.low, t1)))) else w.gaps end),
        w -> case when t1 - w.at > 1e-12d then concat(w.gaps, array(named_struct('a', w.at, 'b', t1))) else w.gaps end)"""
    lon, lat = "(x1 + (g.a + g.b) / 2 * dx)", "(y1 + (g.a + g.b) / 2 * dy)"
    odd = f"(_odd <> (size(filter(_turns, turn -> turn > {lat})) % 2 = 1))"
    good = f"municipality is not null and (_covered or forall({walked}, g -> {odd} <> {geo.parity('_edges', lon, lat)}))"
    checked = met.withColumn("_spans", F.expr(spans)).select("request_id", F.expr(good).alias("good"))
    border = checked.groupBy("request_id").agg(F.bool_and("good").alias("_border"))
    around = _uncovered_holes(requests, areas, tolerance).withColumn("_around", F.lit(True))
    return border.join(around, "request_id", "left").select("request_id", (F.col("_border") & F.col("_around").isNull()).alias("is_valid"))


def number_rows(df: DataFrame, key: str, column: str, start: int, run_bits: int = 16) -> DataFrame:
    """Consecutive numbers in the order of a unique integer key.

    Numbers are given within runs of the key, and runs within blocks of 2^16 runs, and blocks within blocks of those:
    no task sorts all rows or all runs, however sparse the keys are.
    """
    levels = [F.shiftright(key, min(63, run_bits + 16 * i)) for i in range(4)]
    runs = df.select("*", *(level.alias(f"_run{i}") for i, level in enumerate(levels)))
    rank = F.row_number().over(Window.partitionBy("_run0").orderBy(key))
    numbered = runs.withColumn("_rank", rank)
    totals = runs.groupBy(*(f"_run{i}" for i in range(4))).agg(F.count("*").alias("_n"))
    before = F.lit(0)
    for i in range(4):
        inside = [f"_run{i + 1}"] if i < 3 else []
        window = Window.partitionBy(*inside, F.lit(0)).orderBy(f"_run{i}").rowsBetween(Window.unboundedPreceding, -1)
        counted = totals.groupBy(*(f"_run{j}" for j in range(i, 4))).agg(F.sum("_n").alias("_n"))
        offsets = counted.select(f"_run{i}", F.coalesce(F.sum("_n").over(window), F.lit(0)).alias(f"_before{i}"))
        numbered = numbered.join(offsets, f"_run{i}")
        before = before + F.col(f"_before{i}")
    number = (F.lit(start) + before + F.col("_rank")).cast("bigint")
    return numbered.select(*df.columns, number.alias(column))


def create_zones(zones: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new custom zones with their ids, refused requests).

    `requests` has `request_id, name, municipality, rings`. The caller appends the new zones to the table.
    """
    checked = requests.join(check_zone_requests(requests, zones), "request_id", "left")
    path = shared_dir(zones.sparkSession, "checked-requests")  # numbering looks at the rows several times
    checked.write.parquet(path)
    checked = zones.sparkSession.read.schema(checked.schema).parquet(path)
    valid = F.coalesce("is_valid", F.lit(False))
    last = zones.agg(F.max("zone_id")).first()[0] or 0
    numbered = number_rows(checked.where(valid), "request_id", "zone_id", last)
    created = numbered.select(
        "request_id", "zone_id", "name", F.lit(None).cast("string").alias("owner"), "municipality",
        F.lit(CUSTOM).alias("zone_type"), F.lit(None).cast("string").alias("stats_ref"), "rings")
    refused = checked.where(~valid).select(
        "request_id", F.lit("Zone is outside municipality borders.").alias("reason"))
    return created, refused


def delete_zones(zones: DataFrame, zone_ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """(remaining zones, deleted zones). Only custom zones can be deleted."""
    goes = F.col("zone_id").isin(*zone_ids) & (F.col("zone_type") == CUSTOM)
    return zones.where(~F.coalesce(goes, F.lit(False))), zones.where(goes)
