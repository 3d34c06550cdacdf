"""Planar and spherical geometry as Column expressions.

A point is a pair of doubles (lon, lat). A polygon is `rings`: array<array<struct<x, y>>>, every ring closed.
An edge is struct<x1, y1, x2, y2>. A point is inside when a ray to the east crosses the edges of all rings an
odd number of times, which also covers holes and multipolygons.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

WEB_MERCATOR_RADIUS = 6378137.0
MEAN_EARTH_RADIUS = 6371008.7714

GEOJSON_POLYGON = "type string, coordinates array<array<array<double>>>"
GEOJSON_MULTIPOLYGON = "type string, coordinates array<array<array<array<double>>>>"


# The tests against arrays of edges are SQL text with the names of their inputs filled in: they serve in Column
# expressions as well as in correlated subqueries.

# --- polygons -------------------------------------------------------------------------------------------------

def polygon_edges(rings: str) -> Column:
    """All edges of all rings as one array."""
    return F.expr(f"""flatten(transform({rings}, ring -> zip_with(
        slice(ring, 1, size(ring) - 1), slice(ring, 2, size(ring) - 1),
        (a, b) -> named_struct('x1', a.x, 'y1', a.y, 'x2', b.x, 'y2', b.y))))""")


def rings_from_geojson(text: Column) -> Column:
    """GeoJSON text of type Polygon or MultiPolygon → closed rings; NULL for any other text."""
    single, multi = F.from_json(text, GEOJSON_POLYGON), F.from_json(text, GEOJSON_MULTIPOLYGON)
    kind = F.get_json_object(text, "$.type")
    raw = F.when(kind == "Polygon", single["coordinates"]).when(kind == "MultiPolygon", F.flatten(multi["coordinates"]))

    def closed(ring: Column) -> Column:
        points = F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
        first = F.slice(points, 1, 1)
        return F.when(first == F.slice(points, -1, 1), points).otherwise(F.concat(points, first))

    return F.transform(raw, closed)


def geojson_from_rings(rings: str) -> Column:
    """Rings → GeoJSON text of type Polygon; NULL stays NULL."""
    return F.expr(f"""case when {rings} is not null then to_json(named_struct('type', 'Polygon', 'coordinates',
        transform({rings}, ring -> transform(ring, p -> array(p.x, p.y))))) end""")


# --- point against polygon ------------------------------------------------------------------------------------

def parity(edges: str, lon: str, lat: str) -> str:
    """Does a ray from the point to the east cross an odd number of edges?"""
    return f"""aggregate({edges}, false, (odd, e) -> odd <> (case when (e.y1 > {lat}) <> (e.y2 > {lat})
        then {lon} < (e.x2 - e.x1) * ({lat} - e.y1) / (e.y2 - e.y1) + e.x1 else false end))"""


def on_border(edges: str, lon: str, lat: str) -> str:
    """Does the point lie on an edge?"""
    return f"""exists({edges}, e -> (e.x2 - e.x1) * ({lat} - e.y1) = (e.y2 - e.y1) * ({lon} - e.x1)
        and {lat} between least(e.y1, e.y2) and greatest(e.y1, e.y2)
        and {lon} between least(e.x1, e.x2) and greatest(e.x1, e.x2))"""


def on_piece(edges: str, lon: str, lat: str) -> str:
    """Does the point lie on an edge, but not at its ends? An edge without length is its one point."""
    return f"""exists({edges}, e -> (e.x2 - e.x1) * ({lat} - e.y1) = (e.y2 - e.y1) * ({lon} - e.x1)
        and (({lat} > least(e.y1, e.y2) and {lat} < greatest(e.y1, e.y2)) or ({lon} > least(e.x1, e.x2) and {lon} < greatest(e.x1, e.x2))
            or (e.x1 = e.x2 and e.y1 = e.y2 and {lon} = e.x1 and {lat} = e.y1)))"""


def meets_box(edges: str, x: str, y: str, half: str) -> str:
    """Does an edge come into the square around (x, y)? Rounding may only err towards yes."""
    return f"""exists({edges}, e -> least(e.x1, e.x2) <= {x} + {half} and greatest(e.x1, e.x2) >= {x} - {half}
        and least(e.y1, e.y2) <= {y} + {half} and greatest(e.y1, e.y2) >= {y} - {half}
        and abs((e.x2 - e.x1) * ({y} - e.y1) - (e.y2 - e.y1) * ({x} - e.x1))
            <= (abs(e.x2 - e.x1) + abs(e.y2 - e.y1)) * {half} * 1.000001d)"""


# `odd` is the parity of crossed edges that are not in the array, for arrays that hold only the edges near the point.

def within(edges: str, lon: str, lat: str, odd: str = "false") -> str:
    """Strictly inside: a border point does not count."""
    return f"({odd} <> {parity(edges, lon, lat)} and not {on_border(edges, lon, lat)})"


def intersects(edges: str, lon: str, lat: str, odd: str = "false") -> str:
    """Inside or on the border."""
    return f"({odd} <> {parity(edges, lon, lat)} or {on_border(edges, lon, lat)})"


def near_span(edges: str, degrees: float) -> str:
    """Which part of the segment `x1 + t * dx, y1 + t * dy` is no further than this many degrees from each edge?

    An array of (low, high) in t, one for each edge that comes so near. What is near an edge is convex, so its part of a
    line is one span: the hull of the spans of both end discs and of the band between them.
    """
    r = f"{float(degrees)!r}d"
    moved = f"""transform({edges}, e -> named_struct('px', x1 - e.x1, 'py', y1 - e.y1, 'qx', x1 - e.x2, 'qy', y1 - e.y2,
        'ux', e.x2 - e.x1, 'uy', e.y2 - e.y1))"""
    terms = f"""transform({moved}, v -> named_struct('a', dx * dx + dy * dy,
        'b1', v.px * dx + v.py * dy, 'c1', v.px * v.px + v.py * v.py - {r} * {r}, 'b2', v.qx * dx + v.qy * dy, 'c2', v.qx * v.qx + v.qy * v.qy - {r} * {r},
        's0', v.px * v.ux + v.py * v.uy, 's1', dx * v.ux + dy * v.uy, 'l', v.ux * v.ux + v.uy * v.uy,
        'p0', v.ux * v.py - v.uy * v.px, 'p1', v.ux * dy - v.uy * dx))"""

    def disc(i: int) -> str:
        root = f"sqrt(v.b{i} * v.b{i} - v.a * v.c{i})"
        return f"case when v.b{i} * v.b{i} >= v.a * v.c{i} then named_struct('low', (-v.b{i} - {root}) / v.a, 'high', (-v.b{i} + {root}) / v.a) end"

    def bound(take: str, start: str, slope: str, low: str, high: str) -> str:
        """The least or greatest t with low <= start + slope * t <= high; an empty span where no t has it."""
        free, none = ("-1e300d", "1e300d") if take == "least" else ("1e300d", "-1e300d")
        return (f"case when {slope} <> 0 then {take}(({low} - {start}) / {slope}, ({high} - {start}) / {slope}) "
                f"when {start} between {low} and {high} then {free} else {none} end")

    along, across = ("v.s0", "v.s1", "0d", "v.l"), ("v.p0", "v.p1", f"-{r} * sqrt(v.l)", f"{r} * sqrt(v.l)")
    band = (f"named_struct('low', greatest({bound('least', *along)}, {bound('least', *across)}), "
            f"'high', least({bound('greatest', *along)}, {bound('greatest', *across)}))")
    spans = f"filter(array({disc(1)}, {disc(2)}, {band}), s -> s.low <= s.high)"
    return f"""filter(transform({terms}, v -> named_struct('low', array_min({spans}.low), 'high', array_max({spans}.high))), s -> s.low is not null)"""


# --- a polygon known when the plan is built ---------------------------------------------------------------------

def parse_polygon(geojson: dict | str) -> list[list[tuple[float, float]]]:
    """A GeoJSON polygon of a request → closed rings of (x, y)."""
    document = json.loads(geojson) if isinstance(geojson, str) else geojson
    kind, coordinates = document.get("type"), document.get("coordinates")
    if kind == "MultiPolygon":
        coordinates = [ring for polygon in coordinates for ring in polygon]
    elif kind != "Polygon":
        raise ValueError(f"expected a Polygon or MultiPolygon, got {kind!r}")
    rings = [[(float(p[0]), float(p[1])) for p in ring] for ring in coordinates]
    closed = [ring if ring[0] == ring[-1] else [*ring, ring[0]] for ring in rings]
    # A corner given twice in a row makes an edge without length; it bounds nothing.
    return [[p for i, p in enumerate(ring) if i == 0 or p != ring[i - 1]] for ring in closed]


def _balanced(operator, terms: Sequence[Column]) -> Column:
    """Combine terms pairwise, so that the expression tree stays shallow."""
    terms = list(terms)
    while len(terms) > 1:
        paired = [operator(a, b) for a, b in zip(terms[::2], terms[1::2])]
        terms = paired + ([terms[-1]] if len(terms) % 2 else [])
    return terms[0]


def within_polygon(lon: Column, lat: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """`within` for a drawn polygon. Literals only, so it compiles, and its box reaches the Parquet reader."""
    xs, ys = [x for ring in rings for x, _ in ring], [y for ring in rings for _, y in ring]
    box = lon.between(min(xs), max(xs)) & lat.between(min(ys), max(ys))
    crossed, touched = [], []
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if y1 != y2:
                meets = lon < F.lit(x2 - x1) * (lat - F.lit(y1)) / F.lit(y2 - y1) + F.lit(x1)
                crossed.append(((F.lit(y1) > lat) != (F.lit(y2) > lat)) & meets)
            # On the line through both corners, and between them along both axes.
            touched.append((F.lit(x2 - x1) * (lat - F.lit(y1)) == F.lit(y2 - y1) * (lon - F.lit(x1)))
                           & lat.between(min(y1, y2), max(y1, y2)) & lon.between(min(x1, x2), max(x1, x2)))
    if not crossed:
        return F.lit(False)
    return box & _balanced(lambda a, b: a != b, crossed) & ~_balanced(lambda a, b: a | b, touched)


# --- distances ------------------------------------------------------------------------------------------------

def _mercator_x(lon: Column) -> Column:
    return F.lit(WEB_MERCATOR_RADIUS) * F.radians(lon)


def _mercator_y(lat: Column) -> Column:
    return F.lit(WEB_MERCATOR_RADIUS) * F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2.0))


def travelled_metres(start_lon: Column, start_lat: Column, end_lon: Column, end_lat: Column) -> Column:
    """Straight-line distance on the Web Mercator plane, scaled back by the cosine of the start latitude."""
    dx = _mercator_x(start_lon) - _mercator_x(end_lon)
    dy = _mercator_y(start_lat) - _mercator_y(end_lat)
    return F.sqrt(dx * dx + dy * dy) * F.cos(F.radians(start_lat))


def whole_metres(metres: Column) -> Column:
    """Half to even, as rounding of a double is defined in the source database."""
    return F.rint(metres)


def hundreds_of_metres(metres: Column) -> Column:
    return F.rint(metres / 100.0) * 100.0


def sphere_metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine distance on a sphere of mean earth radius."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2.0)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2.0)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # Rounding may lift the chord of opposite points above 1; NULL stays NULL.
    return F.lit(2.0 * MEAN_EARTH_RADIUS) * F.asin(F.sqrt(F.when(chord > 1, F.lit(1.0)).otherwise(chord)))
