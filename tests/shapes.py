"""Small tables for hand-computed cases."""

from kerbline.model import RINGS, SCHEMAS


def square(x, y, size=1.0):
    return [(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]


def zones(spark, *rows):
    """Rows of (zone_id, zone_type, municipality, rings as lists of (x, y))."""
    data = [(zone_id, f"zone {zone_id}", None, municipality, kind, f"ref:{zone_id}",
             [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings] if rings else None)
            for zone_id, kind, municipality, rings in rows]
    return spark.createDataFrame(data, SCHEMAS["zones"])


def polygons(spark, **by_id):
    schema = "zone_id bigint, rings " + RINGS.simpleString()
    data = [(int(name.strip("z")), [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings])
            for name, rings in by_id.items()]
    return spark.createDataFrame(data, schema)


def points(spark, *rows):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rows)],
                                 "pid bigint, lon double, lat double")


def inside(rings, x, y):
    """Edge counting in Python, for brute force."""
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def park_events(spark, *rows):
    """Rows of (id, operator, bike, type, lon, lat, start, end)."""
    return spark.createDataFrame(list(rows), SCHEMAS["park_events"])


def vehicle_types(spark):
    return spark.createDataFrame([(0, "bicycle"), (1, "moped"), (2, "car")], SCHEMAS["vehicle_type"])
