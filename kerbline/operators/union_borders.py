"""Where borders of several polygons are inside their union.

A point strictly inside one polygon is inside the union anyway. What else is inside lies on borders only:

* pieces of edges that two polygons share, walked with their insides on opposite sides: such a piece bounds nothing. The
  edges may overlap in part.
* corners around which the polygons that meet there leave no gap.

Both are found among the polygons, before any fact is looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from kerbline.functions import geometry as geo

# Directions at a corner that differ by less (in radians) count as one; edges meet by directions rounded to ANGLES a half turn.
SAME = 5e-10
ANGLES = 100_000


def _edges(polygons: DataFrame, key: str, rings: str) -> DataFrame:
    """(key, edge, inside is on its left), one row for each edge of each ring."""
    ring = polygons.where(F.col(rings).isNotNull()).select(key, F.col(rings).alias("_rings"), F.posexplode(rings).alias("_at", "_ring")).where("size(_ring) > 1")
    area = """aggregate(sequence(1, size(_ring) - 1), 0d, (a, i) -> a + (_ring[i - 1].x - _ring[0].x) * (_ring[i].y - _ring[0].y)
        - (_ring[i].x - _ring[0].x) * (_ring[i - 1].y - _ring[0].y))"""
    others = geo.polygon_edges("_others")
    one = (ring.withColumn("_area", F.expr(area)).withColumn("_others", F.expr("filter(_rings, (r, i) -> i <> _at)")).withColumn("_others", others)
           .withColumn("_own", F.array("_ring")).select(key, "_area", "_others", F.explode(geo.polygon_edges("_own")).alias("e")))
    nested = """aggregate(_others, false, (odd, o) -> odd <> (case when (o.y1 > (e.y1 + e.y2) / 2) <> (o.y2 > (e.y1 + e.y2) / 2)
        then (e.x1 + e.x2) / 2 < (o.x2 - o.x1) * ((e.y1 + e.y2) / 2 - o.y1) / (o.y2 - o.y1) + o.x1 else false end))"""
    return one.where("_area <> 0 and (e.x1 <> e.x2 or e.y1 <> e.y2)").select(key, "e", F.expr(f"(_area > 0) <> {nested}").alias("_left"))


def _placed(polygons: DataFrame, key: str, rings: str, per_degree: int) -> DataFrame:
    """The edges by the cells of a grid that they come into, all walked one way along their line."""
    n = f"{float(per_degree)!r}d"
    turn = f"((atan2(e.y2 - e.y1, e.x2 - e.x1) + {2 * math.pi!r}d) % {math.pi!r}d)"
    walks_up = "(e.x2 > e.x1 or (e.x2 = e.x1 and e.y2 > e.y1))"
    # edges in one sense along their line, so that the side of the inside can be compared
    one_way = f"""case when {walks_up} then e else named_struct('x1', e.x2, 'y1', e.y2, 'x2', e.x1, 'y2', e.y1) end as e"""
    edges = _edges(polygons, key, rings).selectExpr(
        key, one_way, f"_left = {walks_up} as _left", f"cast(floor({turn} / {math.pi!r}d * {ANGLES}) as int) as _angle",
        f"""explode(sequence(cast(floor(least(e.x1, e.x2) * {n}) as int), cast(floor(greatest(e.x1, e.x2) * {n}) as int))) as _x""")
    return edges.selectExpr("*", f"explode(sequence(cast(floor(least(e.y1, e.y2) * {n}) as int), cast(floor(greatest(e.y1, e.y2) * {n}) as int))) as _y").where(
        geo.meets_box("array(e)", f"((_x + 0.5d) / {n})", f"((_y + 0.5d) / {n})", f"(0.5d / {n})"))


def shared_pieces(placed: DataFrame, key: str) -> DataFrame:
    """(key, piece): where an edge of one polygon lies on an edge of another, with their insides on opposite sides."""
    a = placed.selectExpr(f"{key} as _ka", "e as a", "_left as _la", "_x", "_y", f"explode(array({', '.join(f'pmod(_angle + {d}, {ANGLES})' for d in (-1, 0, 1))})) as _angle")
    b = placed.selectExpr(f"{key} as _kb", "e as b", "_left as _lb", "_x", "_y", "_angle")
    on_line = " and ".join(f"(a.x2 - a.x1) * (b.y{i} - a.y1) = (a.y2 - a.y1) * (b.x{i} - a.x1)" for i in (1, 2))
    met = a.join(b, ["_x", "_y", "_angle"]).where(f"_ka < _kb and _la <> _lb and {on_line}")
    # both run the same way along one line: the later begin and the earlier end
    later = "case when struct(a.x1, a.y1) >= struct(b.x1, b.y1) then struct(a.x1 as x, a.y1 as y) else struct(b.x1 as x, b.y1 as y) end as p"
    sooner = "case when struct(a.x2, a.y2) <= struct(b.x2, b.y2) then struct(a.x2 as x, a.y2 as y) else struct(b.x2 as x, b.y2 as y) end as q"
    pieces = met.selectExpr(f"_ka as {key}", later, sooner).where("struct(p.x, p.y) < struct(q.x, q.y)")
    # the ends of a piece are corners, which have a rule of their own
    return pieces.selectExpr(key, "named_struct('x1', p.x, 'y1', p.y, 'x2', q.x, 'y2', q.y) as piece").distinct()


def closed_corners(placed: DataFrame, polygons: DataFrame, key: str, rings: str, per_degree: int) -> DataFrame:
    """(key, piece): corners around which all directions are inside some polygon, as pieces without length."""
    n = f"{float(per_degree)!r}d"
    shapes = polygons.where(F.col(rings).isNotNull())
    corners = shapes.select(F.explode(F.flatten(rings)).alias("p")).select("p.x", "p.y").distinct().selectExpr(
        "x", "y", f"cast(floor(x * {n}) as int) as _x", f"cast(floor(y * {n}) as int) as _y")
    touches = geo.on_border("array(e)", "x", "y")
    met = placed.select(key, "e", "_x", "_y").join(corners, ["_x", "_y"]).where(touches).select("x", "y", key).distinct().join(
        shapes.select(key, geo.polygon_edges(rings).alias("_all")), key)
    here = "(e.x2 - e.x1) * (y - e.y1) = (e.y2 - e.y1) * (x - e.x1) and y between least(e.y1, e.y2) and greatest(e.y1, e.y2) and x between least(e.x1, e.x2) and greatest(e.x1, e.x2)"
    away = lambda i: f"case when e.x{i} <> x or e.y{i} <> y then array(atan2(e.y{i} - y, e.x{i} - x)) else array() end"
    seen = met.withColumn("_here", F.expr(f"filter(_all, e -> {here})")).withColumn("_rest", F.expr(f"filter(_all, e -> not ({here}))"))
    # directions from just above east, all the way round to east itself
    angles = f"transform(flatten(transform(_here, e -> concat({away(1)}, {away(2)}))), d -> case when d <= {SAME!r}d then d + {2 * math.pi!r}d else d end)"
    around = seen.selectExpr(key, "x", "y", f"named_struct('inside', {geo.parity('_rest', 'x', 'y')}, 'angles', {angles}) as s")
    # as many polygons as meet at a corner
    at = around.groupBy("x", "y").agg(F.min(key).alias(key), F.collect_list("s").alias("all"))
    inside = f"exists(all, s -> s.inside <> (size(filter(s.angles, d -> d <= c + {SAME!r}d)) % 2 = 1))"
    closed = at.where(f"forall(concat(array(0d), filter(flatten(all.angles), d -> d < {2 * math.pi - SAME!r}d)), c -> {inside})")
    return closed.selectExpr(key, "named_struct('x1', x, 'y1', y, 'x2', x, 'y2', y) as piece")


def inner_borders(polygons: DataFrame, key: str, rings: str, per_degree: int) -> DataFrame:
    """(key, _inner): what of a polygon's border is inside the union of all polygons, as far as it is on a border of each."""
    placed = _placed(polygons, key, rings, per_degree)
    pieces = shared_pieces(placed, key).unionByName(closed_corners(placed, polygons, key, rings, per_degree))
    return pieces.groupBy(key).agg(F.collect_list("piece").alias("_inner"))
