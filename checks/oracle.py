"""Independent SQL for the registered queries: other methods than the package uses, over the same derived tables.

Polygons are tested by counting crossed edges in rows, gaps by joining a generated grid, previous rows by `lag`.
"""

from __future__ import annotations

from checks import queries as q
from kerbline.sources.dimensions import OPERATORS, PUBLIC_ZONES
from kerbline.sources.fixtures import DERIVATIONS, INDEX_HORIZON, LEFT_OUT, NOTCHED, SNAPPED, VEHICLE_TYPES

ORACLE: dict[str, str] = {}


def _values(rows, names: str) -> str:
    items = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {items}) AS v({names})"


def _edges(source: str, key: str) -> str:
    corners = (("cx - hw", "cy"), ("cx", "cy - hh"), ("cx + hw", "cy"), ("cx", "cy + hh"), ("cx - hw", "cy"))
    return " UNION ALL ".join(
        f"SELECT {key}, {x1} AS x1, {y1} AS y1, {x2} AS x2, {y2} AS y2 FROM {source}"
        for (x1, y1), (x2, y2) in zip(corners, corners[1:]))


CROSSINGS = ("sum(case when ((e.y1 > p.lat) <> (e.y2 > p.lat)) and "
             "p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / (e.y2 - e.y1) + e.x1 then 1 else 0 end) % 2 = 1")
TOUCHES = ("sum(case when p.lat between least(e.y1, e.y2) and greatest(e.y1, e.y2) and p.lon between "
           "least(e.x1, e.x2) and greatest(e.x1, e.x2) and (e.x2 - e.x1) * (p.lat - e.y1) = "
           "(e.y2 - e.y1) * (p.lon - e.x1) then 1 else 0 end)")


def hits(points: str, zones: str = "zones", edges: str = "zone_edges", key: str = "zone_id",
         border_counts: bool = False) -> str:
    """(pid, key): polygons that contain the points `pid, lon, lat`."""
    border = f"OR {TOUCHES} > 0" if border_counts else f"AND {TOUCHES} = 0"
    return (f"SELECT p.pid, e.{key} FROM {points} p JOIN {zones} z ON p.lon BETWEEN z.cx - z.hw AND z.cx + z.hw "
            f"AND p.lat BETWEEN z.cy - z.hh AND z.cy + z.hh JOIN {edges} e ON e.{key} = z.{key} "
            f"GROUP BY p.pid, e.{key} HAVING ({CROSSINGS}) {border}")


def _arrays(text: str) -> str:
    return f"list_filter(string_split({text}, ','), lambda e: e <> '')"


BASE = {name: " UNION ALL ".join(part.sql() for part in parts) for name, parts in DERIVATIONS.items()}
BASE["vehicle_type"] = _values(VEHICLE_TYPES, "vehicle_type_id, form_factor")
BASE["operators"] = _values(OPERATORS, "system_id, name")
BASE["zone_edges"] = _edges("zones", "zone_id")
BASE["municipality_edges"] = _edges("municipalities", "gm_code")


def oracle(name: str, uses: str, body: str, **ctes: str) -> None:
    """`uses` names derived tables in order of dependency, `ctes` further steps."""
    steps = [f"{t} AS ({BASE[t]})" for t in uses.split()] + [f"{n} AS ({text})" for n, text in ctes.items()]
    ORACLE[name] = f"WITH {', '.join(steps)} {body}"


def _ids(zones: dict) -> str:
    return zones["zone_ids"]


PARKED_AT = "timestamp '2001-06-15 12:00:00'"
CHOSEN, SERIES_IDS, ALL_IDS = _ids(q.CHOSEN_ZONES), _ids(q.SERIES_ZONES), _ids(q.ALL_ZONES)


def parked(at: str) -> str:
    return f"start_time < {at} AND (end_time > {at} OR end_time IS NULL)"


# --- parked vehicles ------------------------------------------------------------------------------------------

_RING = [(4.1, 50.1), (5.9, 50.2), (5.8, 52.3), (4.2, 52.2), (4.1, 50.1)]
_RING_EDGES = ", ".join(f"({x1}e0, {y1}e0, {x2}e0, {y2}e0)" for (x1, y1), (x2, y2) in zip(_RING, _RING[1:]))

oracle("park_count_in_polygon", "vehicle_type park_events",
       "SELECT form_factor, count(bike_id) AS number_of_parked_vehicles FROM inside LEFT JOIN vehicle_type v "
       "ON v.vehicle_type_id = inside.vehicle_type_id GROUP BY form_factor",
       edges=f"SELECT * FROM (VALUES {_RING_EDGES}) AS e(x1, y1, x2, y2)",
       inside=f"SELECT p.park_event_id, p.bike_id, p.vehicle_type_id FROM park_events p, edges e WHERE "
              f"{parked(PARKED_AT)} GROUP BY ALL HAVING ({CROSSINGS}) AND {TOUCHES} = 0")

ORACLE["park_count_in_polygon_many_corners"] = ORACLE["park_count_in_polygon_repeated_corner"] = ORACLE["park_count_in_polygon"]

_EVENT = "p.system_id, p.bike_id, p.start_time, p.end_time, v.form_factor, p.lat AS latitude, p.lon AS longitude"
_TYPED = "LEFT JOIN vehicle_type v ON v.vehicle_type_id = p.vehicle_type_id"

oracle("park_events_everywhere", "vehicle_type park_events",
       f"SELECT {_EVENT} FROM park_events p {_TYPED} WHERE {parked(PARKED_AT)}")
oracle("park_events_at", "vehicle_type park_events zones zone_edges",
       f"SELECT {_EVENT} FROM park_events p {_TYPED} WHERE {parked(PARKED_AT)} AND p.system_id IN ('op_1', 'op_3', "
       f"'op_4') AND (v.form_factor IN ('moped', 'car') OR v.form_factor IS NULL) AND EXISTS (SELECT 1 FROM hits h "
       f"WHERE h.pid = p.park_event_id AND h.zone_id IN ({CHOSEN}))",
       points="SELECT park_event_id AS pid, lon, lat FROM park_events", hits=hits("points"))
oracle("public_vehicles", "vehicle_type park_events zones zone_edges",
       f"SELECT p.system_id, v.form_factor, p.lat AS latitude, p.lon AS longitude FROM park_events p {_TYPED} WHERE "
       f"{parked(chr(39).join(['timestamp ', '2001-07-01 08:00:00', '']))} AND EXISTS (SELECT 1 FROM hits h "
       f"WHERE h.pid = p.park_event_id AND h.zone_id IN ({CHOSEN}))",
       points="SELECT park_event_id AS pid, lon, lat FROM park_events", hits=hits("points"))

_AGE = f"({PARKED_AT} - p.start_time)"
_LIMITS = ("interval '0' day", "interval '2' day", "interval '4' day", "interval '7' day", "interval '14' day")


def _buckets() -> str:
    parts = []
    for i, low in enumerate(_LIMITS):
        test = f"{_AGE} >= {low}" + (f" AND {_AGE} < {_LIMITS[i + 1]}" if i < 4 else "")
        parts.append(f"coalesce(sum(case when {test} then 1 else 0 end), 0)::bigint AS bucket_{i}")
    return ", ".join(parts)


def _histogram(name: str, ids: str, condition: str) -> None:
    oracle(name, "vehicle_type park_events zones zone_edges",
           f"SELECT z.zone_id, z.name, z.municipality, z.zone_type, {_buckets()} FROM zones z LEFT JOIN hits h "
           f"ON h.zone_id = z.zone_id LEFT JOIN points p ON p.pid = h.pid WHERE z.zone_id IN ({ids}) "
           f"GROUP BY ALL",
           points=f"SELECT park_event_id AS pid, lon, lat, start_time FROM park_events p {_TYPED} WHERE "
                  f"{parked(PARKED_AT)}{condition}", hits=hits("points"))


_histogram("park_age_histogram", ALL_IDS, "")
_histogram("park_age_histogram_filtered", CHOSEN,
           " AND p.system_id IN ('op_0', 'op_2') AND (v.form_factor = 'bicycle' OR v.form_factor IS NULL)")

for _form in ("park_events_historic", "park_count_historic", "park_age_histogram_historic"):
    ORACLE[_form] = ORACLE[{"park_events_historic": "park_events_at", "park_count_historic": "park_count_in_polygon",
                            "park_age_histogram_historic": "park_age_histogram"}[_form]]

_TOUCHED = ("SELECT park_event_id, cast(unnest(generate_series(cast(cast(start_time as date) as timestamp), "
            f"cast(cast(coalesce(end_time, timestamp '{INDEX_HORIZON} 00:00:00') as date) as timestamp), "
            "interval 1 day)) as date) AS on_date FROM park_events")
oracle("park_event_date_index", "park_events",
       "SELECT on_date, park_event_id >> 16 AS chunk, count(*) AS number_of_ids, "
       "string_agg(cast(park_event_id as string), ',' ORDER BY park_event_id) AS park_event_ids FROM touched "
       "GROUP BY on_date, park_event_id >> 16", touched=_TOUCHED)
oracle("park_events_by_date_index", "park_events",
       f"SELECT park_event_id, system_id, bike_id, start_time, end_time FROM park_events WHERE {parked(PARKED_AT)} "
       f"AND park_event_id IN (SELECT park_event_id FROM touched WHERE on_date = date '2001-06-15')",
       touched=_TOUCHED)
ORACLE["park_events_by_id_lists"] = ORACLE["park_events_by_date_index"]
ORACLE["park_events_through_day_index"] = ORACLE["park_events_by_date_index"]
_EVENT_HITS = {"points": "SELECT park_event_id AS pid, lon, lat FROM park_events", "hits": hits("points")}
oracle("zones_of_events_shuffled", "park_events zones zone_edges",
       "SELECT zone_id, count(*) AS number_of_events FROM hits GROUP BY zone_id", **_EVENT_HITS)
oracle("events_in_zones_shuffled", "park_events zones zone_edges",
       "SELECT DISTINCT pid AS park_event_id FROM hits", **_EVENT_HITS)
# Points a little to all four sides must be covered, each by some box.
oracle("events_in_joined_boxes", "park_events zones",
       "SELECT pid AS park_event_id FROM points p CROSS JOIN (VALUES (-1e-7, -1e-7), (-1e-7, 1e-7), (1e-7, -1e-7), (1e-7, 1e-7)) AS d(dx, dy) "
       "WHERE EXISTS (SELECT 1 FROM boxes b WHERE abs(p.lon + d.dx - b.cx) < 0.25e0 AND abs(p.lat + d.dy - b.cy) < 0.25e0) GROUP BY pid HAVING count(*) = 4",
       boxes=f"SELECT cx, cy FROM zones WHERE zone_type <> 'municipality' AND zone_id NOT IN {LEFT_OUT}",
       points=f"SELECT park_event_id AS pid, {SNAPPED['lon']} AS lon, {SNAPPED['lat']} AS lat FROM park_events")
_LISTED = ", ".join(f"({i}, {z}, '{name}', {'NULL' if cap is None else cap})" for i, (z, name, cap) in enumerate(PUBLIC_ZONES, 1))
oracle("public_zone_occupancy_listed", "park_events zones zone_edges",
       "SELECT cast(l.id as bigint) AS zone_id, l.name, cast(l.capacity as bigint) AS capacity, c.system_id, c.number_of_vehicles "
       f"FROM (VALUES {_LISTED}) AS l(n, id, name, capacity) LEFT JOIN counts c ON c.zone_id = l.n",
       points="SELECT park_event_id AS pid, lon, lat, system_id FROM park_events WHERE end_time IS NULL", hits=hits("points"),
       counts="SELECT h.zone_id, p.system_id, count(*) AS number_of_vehicles FROM hits h JOIN points p "
              "ON p.pid = h.pid GROUP BY h.zone_id, p.system_id")
ORACLE["park_events_loaded"] = ORACLE["park_events_everywhere"]
_NOTCHED_EDGES = " UNION ALL ".join(
    f"SELECT zone_id, cx + hw * {a}e0 AS x1, cy + hh * {b}e0 AS y1, cx + hw * {c}e0 AS x2, cy + hh * {d}e0 AS y2 FROM zones "
    "WHERE zone_type <> 'municipality'" for ring in NOTCHED for (a, b), (c, d) in zip(ring, ring[1:]))
oracle("events_in_notched_zones", "park_events zones",
       "SELECT zone_id, count(*) AS number_of_events FROM hits GROUP BY zone_id", notched_edges=_NOTCHED_EDGES,
       points="SELECT park_event_id AS pid, lon, lat FROM park_events", hits=hits("points", edges="notched_edges"))
oracle("public_zone_occupancy", "park_events zones zone_edges",
       "SELECT z.zone_id, z.name, case when z.zone_id % 3 <> 0 then z.zone_id * 10 end AS capacity, c.system_id, "
       "c.number_of_vehicles FROM zones z LEFT JOIN counts c ON c.zone_id = z.zone_id "
       "WHERE z.zone_type <> 'municipality'",
       points="SELECT park_event_id AS pid, lon, lat, system_id FROM park_events WHERE end_time IS NULL",
       hits=hits("points"),
       counts="SELECT h.zone_id, p.system_id, count(*) AS number_of_vehicles FROM hits h JOIN points p "
              "ON p.pid = h.pid GROUP BY h.zone_id, p.system_id")

# --- trips and rentals ------------------------------------------------------------------------------------------

_TRIP_PERIOD = "start_time >= timestamp '1998-01-01' AND end_time <= timestamp '1999-12-31'"
_MX, _MY = "6378137e0 * radians({0})", "6378137e0 * ln(tan(0.7853981633974483e0 + radians({0}) / 2e0))"
_METRES = ("sqrt(pow({0} - ({1}), 2) + pow({2} - ({3}), 2)) * cos(radians(p.start_lat))".format(
    _MX.format("p.start_lon"), _MX.format("p.end_lon"), _MY.format("p.start_lat"), _MY.format("p.end_lat")))
_NUMBERED = f"SELECT row_number() OVER () AS pid, * FROM trips WHERE {_TRIP_PERIOD}"
_TRIP_FILTER = ("p.system_id IN ('op_1', 'op_2', 'op_5') AND (v.form_factor IN ('moped', 'kick_scooter') "
                "OR v.form_factor IS NULL)")
_TRIP = ("p.system_id, p.bike_id, p.start_time, p.end_time, p.trip_id, v.form_factor, "
         f"round_even({_METRES}, 0) AS distance_in_meters, p.start_lat AS start_latitude, "
         "p.start_lon AS start_longitude, p.end_lat AS end_latitude, p.end_lon AS end_longitude")
_TRIP_STEPS = {
    "numbered": _NUMBERED,
    "start_points": "SELECT pid, start_lon AS lon, start_lat AS lat FROM numbered",
    "end_points": "SELECT pid, end_lon AS lon, end_lat AS lat FROM numbered",
    "start_hits": hits("start_points"), "end_hits": hits("end_points"),
}


def _hit(which: str) -> str:
    return f"EXISTS (SELECT 1 FROM {which}_hits h WHERE h.pid = p.pid AND h.zone_id IN ({CHOSEN}))"


oracle("trips_everywhere", "vehicle_type trips",
       f"SELECT {_TRIP} FROM trips p {_TYPED} WHERE {_TRIP_PERIOD}")
oracle("trips_in_zones", "vehicle_type trips zones zone_edges",
       f"SELECT {_TRIP} FROM numbered p {_TYPED} WHERE {_TRIP_FILTER} AND ({_hit('start')} OR {_hit('end')})",
       **_TRIP_STEPS)
oracle("trips_in_zones_shuffled", "trips zones zone_edges",
       "SELECT trip_id FROM numbered p WHERE pid IN (SELECT pid FROM start_hits) OR pid IN (SELECT pid FROM end_hits)", **_TRIP_STEPS)
for _name, _which in (("trip_origins", "start"), ("trip_destinations", "end")):
    oracle(_name, "vehicle_type trips zones zone_edges",
           f"SELECT p.system_id, p.{_which}_time AS event_time, v.form_factor, round_even({_METRES} / 100e0, 0) * 100e0 "
           f"AS distance_in_meters, p.{_which}_lat AS latitude, p.{_which}_lon AS longitude "
           f"FROM numbered p {_TYPED} WHERE {_TRIP_FILTER} AND {_hit(_which)}", **_TRIP_STEPS)


def _counts(first: str, second: str) -> str:
    return ("SELECT z.zone_id, z.name, z.zone_type, "
            f"coalesce((SELECT count(*) FROM {first}_hits h WHERE h.zone_id = z.zone_id), 0) AS {first}ed, "
            f"coalesce((SELECT count(*) FROM {second}_hits h WHERE h.zone_id = z.zone_id), 0) AS {second}ed "
            f"FROM zones z WHERE z.zone_id IN ({ALL_IDS})")


oracle("trip_zone_stats", "trips zones zone_edges", _counts("start", "end"),
       **{**_TRIP_STEPS, "numbered": _NUMBERED + " AND system_id IN ('op_0', 'op_1', 'op_2', 'op_3')"})

_EDGE = "BETWEEN timestamp '1998-01-01' AND timestamp '1999-12-31'"
_RENTAL_STEPS = {
    "start_points": f"SELECT park_event_id AS pid, * FROM park_events WHERE end_time {_EDGE}",
    "end_points": f"SELECT park_event_id AS pid, * FROM park_events WHERE start_time {_EDGE}",
    "start_hits": hits("start_points"), "end_hits": hits("end_points"),
}
for _name, _which, _time in (("rental_starts", "start", "p.start_time AS departure_time"),
                             ("rental_ends", "end", "p.end_time AS arrival_time")):
    oracle(_name, "park_events zones zone_edges",
           f"SELECT p.system_id, p.bike_id, {_time}, p.lat AS latitude, p.lon AS longitude FROM {_which}_points p "
           f"WHERE p.system_id IN ('op_1', 'op_2', 'op_5') AND {_hit(_which)}", **_RENTAL_STEPS)
oracle("rental_zone_stats", "park_events zones zone_edges", _counts("end", "start"), **_RENTAL_STEPS)

# --- statistics and series --------------------------------------------------------------------------------------

_DAYS = "date BETWEEN date '2024-01-02' AND date '2024-01-25'"
_CALENDAR = ("SELECT cast(unnest(generate_series(timestamp '2024-01-02', timestamp '2024-01-25', interval 1 day)) as date)"
             " AS stat_date")


def _facts(description: str, operators: str = "") -> str:
    limit = f" AND system_id IN ({operators})" if operators else ""
    return (f"SELECT s.date, s.system_id, s.value FROM stats_pre_process s JOIN zones z ON z.stats_ref = s.zone_ref "
            f"WHERE {_DAYS} AND stat_description = '{description}' AND z.zone_id IN ({SERIES_IDS}){limit}")


_DENSE = ("SELECT p.time_period, o.system_id, coalesce(s.value, 0) AS value FROM periods p CROSS JOIN "
          "(SELECT DISTINCT system_id FROM stats) o LEFT JOIN stats s ON s.time_period = p.time_period "
          "AND s.system_id = o.system_id WHERE o.system_id IS NOT NULL AND o.system_id <> ''")


def _periods(aggregation: str) -> str:
    return f"SELECT DISTINCT cast(date_trunc('{aggregation}', stat_date) as timestamp) AS time_period FROM calendar"


def _available(aggregation: str) -> dict[str, str]:
    return {
        "calendar": _CALENDAR, "facts": _facts("number_of_vehicles_available"),
        "daily": "SELECT date, system_id, sum(value) AS value FROM facts GROUP BY date, system_id",
        "stats": f"SELECT system_id, cast(date_trunc('{aggregation}', date) as timestamp) AS time_period, "
                 "cast(round(avg(value)) as bigint) AS value FROM daily GROUP BY ALL",
        "periods": _periods(aggregation)}


def _started(aggregation: str) -> dict[str, str]:
    return {
        "calendar": _CALENDAR, "facts": _facts("number_of_trip_started", "'op_0', 'op_1', 'op_4'"),
        "stats": f"SELECT system_id, cast(date_trunc('{aggregation}', date) as timestamp) AS time_period, "
                 "cast(sum(value) as bigint) AS value FROM facts GROUP BY ALL",
        "periods": _periods(aggregation)}


for _level in ("day", "week", "month"):
    oracle(f"available_vehicles_{_level}", "zones stats_pre_process", _DENSE, **_available(_level))
    oracle(f"rentals_{_level}", "zones stats_pre_process", _DENSE, **_started(_level))
oracle("period_map", "zones stats_pre_process",
       "SELECT time_period AS start_interval, system_id, value FROM dense", **_available("week"), dense=_DENSE)
oracle("period_pivot", "zones stats_pre_process",
       "SELECT time_period AS start_interval, " + ", ".join(
           f"max(case when system_id = 'op_{i}' then value end) AS op_{i}" for i in range(6))
       + " FROM dense GROUP BY time_period",
       **{**_started("week"), "facts": _facts("number_of_trip_started")}, dense=_DENSE)
oracle("missing_days", "stats_pre_process",
       "SELECT date FROM calendar EXCEPT SELECT date FROM stats_pre_process "
       "WHERE stat_description = 'number_of_trips_ended'",
       calendar="SELECT cast(unnest(generate_series(timestamp '2023-12-25', timestamp '2024-02-05', interval 1 day)) "
                "as date) AS date")
oracle("period_operator_grid", "zones stats_pre_process",
       "SELECT g.system_id, cast(date_trunc('month', g.stat_date) as timestamp) AS time_period, "
       "cast(sum(s.value) as bigint) AS value FROM grid g LEFT JOIN stats_pre_process s ON s.date = g.stat_date "
       "AND s.system_id = g.system_id JOIN zones z ON z.stats_ref = s.zone_ref "
       f"WHERE {_DAYS} AND z.zone_id IN ({SERIES_IDS}) AND s.stat_description = 'number_of_trip_started' GROUP BY ALL",
       calendar=_CALENDAR,
       grid=f"SELECT stat_date, system_id FROM calendar CROSS JOIN (SELECT DISTINCT system_id FROM stats_pre_process "
            f"WHERE {_DAYS} AND stat_description = 'number_of_trip_started') o")
oracle("daily_statistics", "stats_number_of_vehicles_parked",
       "SELECT cast(time as date) AS date, concat('cbs:', cast(zone_id as string)) AS zone_ref, "
       "'number_of_vehicles_available' AS stat_description, system_id, "
       "cast(sum(number_of_vehicles_parked) as bigint) AS value FROM stats_number_of_vehicles_parked GROUP BY ALL")

_FROM, _TO = "timestamp '2024-01-03 00:00:00'", "timestamp '2024-01-12 18:00:00'"
_STEPS = {"5m": "5 minutes", "15m": "15 minutes", "hour": "1 hour", "day": "1 day", "week": "7 days", "month": "1 month"}


def _bucket(aggregation: str, time: str = "time") -> str:
    if aggregation in ("5m", "15m"):
        return f"time_bucket(interval '{_STEPS[aggregation]}', {time})"
    return f"cast(date_trunc('{aggregation}', {time}) as timestamp)"


def _spine(aggregation: str) -> str:
    return (f"SELECT unnest(generate_series({_bucket(aggregation, _FROM)}, {_bucket(aggregation, _TO)}, "
            f"interval '{_STEPS[aggregation]}')) AS bucket")


def _rental(aggregation: str) -> dict[str, str]:
    return {
        "found": f"SELECT system_id, modality, {_bucket(aggregation)} AS bucket, sum(number_of_trips_started) AS s, "
                 f"sum(number_of_trips_ended) AS e FROM stats_number_of_trips WHERE time BETWEEN {_FROM} AND {_TO} "
                 f"AND zone_id IN ({SERIES_IDS}) GROUP BY ALL",
        "spine": _spine(aggregation),
        "filled": "SELECT g.system_id, g.modality, b.bucket, cast(coalesce(f.s, 0) as bigint) AS number_of_trips_started, "
                  "cast(coalesce(f.e, 0) as bigint) AS number_of_trips_ended FROM (SELECT DISTINCT system_id, modality "
                  "FROM found) g CROSS JOIN spine b LEFT JOIN found f ON f.system_id = g.system_id "
                  "AND f.modality = g.modality AND f.bucket = b.bucket"}


for _level in _STEPS:
    oracle(f"rental_series_{_level}", "stats_number_of_trips", "SELECT * FROM filled", **_rental(_level))
oracle("rental_document", "stats_number_of_trips",
       "SELECT bucket AS time, system_id, modality, number_of_trips_started AS rentals_started, "
       "number_of_trips_ended AS rentals_ended FROM filled", **_rental("hour"))


def _by_operator(aggregation: str, function: str) -> dict[str, str]:
    return {
        "per_modality": f"SELECT system_id, modality, {_bucket(aggregation)} AS bucket, "
                        f"{function}(number_of_vehicles_parked) AS amount FROM stats_number_of_vehicles_parked "
                        f"WHERE time BETWEEN {_FROM} AND {_TO} AND zone_id IN ({SERIES_IDS}) GROUP BY ALL",
        "summed": "SELECT bucket, system_id AS name, round(cast(sum(amount) as double), 6) AS amount "
                  "FROM per_modality GROUP BY ALL"}


def _by_modality(aggregation: str, function: str) -> dict[str, str]:
    return {
        "found": f"SELECT modality, {_bucket(aggregation)} AS bucket, {function}(number_of_vehicles_parked) AS amount "
                 f"FROM stats_number_of_vehicles_parked WHERE time BETWEEN {_FROM} AND {_TO} "
                 f"AND zone_id IN ({SERIES_IDS}) GROUP BY ALL",
        "spine": _spine(aggregation)}


_FILLED_MODALITY = ("SELECT b.bucket, g.modality AS name, round(cast(f.amount as double), 6) AS amount "
                    "FROM (SELECT DISTINCT modality FROM found) g CROSS JOIN spine b "
                    "LEFT JOIN found f ON f.modality = g.modality AND f.bucket = b.bucket")
_PARKED_SERIES = "stats_number_of_vehicles_parked"
oracle("availability_by_operator", _PARKED_SERIES, "SELECT * FROM summed", **_by_operator("15m", "avg"))
oracle("availability_by_operator_max", _PARKED_SERIES, "SELECT * FROM summed", **_by_operator("hour", "max"))
oracle("availability_by_modality", _PARKED_SERIES, _FILLED_MODALITY, **_by_modality("hour", "avg"))
oracle("availability_by_modality_min", _PARKED_SERIES, _FILLED_MODALITY, **_by_modality("5m", "min"))
oracle("availability_document", _PARKED_SERIES, "SELECT bucket AS time, name, amount FROM summed",
       **_by_operator("hour", "avg"))

# --- report -----------------------------------------------------------------------------------------------------

_REPORT_FACTS = (f"SELECT * FROM stats_pre_process WHERE {_DAYS} AND zone_ref IN "
                 "(SELECT stats_ref FROM zones WHERE municipality = 'GM0001')")
_REPORT_CHOSEN = _REPORT_FACTS + " AND system_id IN ('op_1', 'op_2', 'op_3', '')"
oracle("report_triples", "zones stats_pre_process",
       "SELECT zone_ref, stat_description, system_id, round(avg(value), 6) AS avg, count(value) AS count, "
       "cast(sum(value) as bigint) AS sum FROM facts GROUP BY ALL", facts=_REPORT_CHOSEN)
oracle("report_operators", "zones stats_pre_process", "SELECT DISTINCT system_id FROM facts", facts=_REPORT_CHOSEN)

_N = 24


def _sum(description: str) -> str:
    return f"(cast(coalesce(sum(value) FILTER (stat_description = '{description}'), 0) as double))"


_A, _B = _sum("number_of_vehicles_available"), _sum("number_of_trip_started")
_LONG = {s: _sum(f"number_of_vehicles_available_longer_then_{s}") for s in ("24_hours", "4_days", "7_days")}
_E, _T = _sum("number_of_trips_ended"), _sum("sum_of_trip_duration")
_INDICATORS = {
    "a": f"{_A} / {_N}", "b": f"{_B} / {_N}", "c": f"case when {_A} > 0 then {_B} / {_A} else 0 end",
    "d": f"{_LONG['24_hours']} / {_N}", "e": f"case when {_A} > 0 then {_LONG['24_hours']} / {_A} else 0 end",
    "f": f"{_LONG['4_days']} / {_N}", "g": f"case when {_A} > 0 then {_LONG['4_days']} / {_A} else 0 end",
    "h": f"{_LONG['7_days']} / {_N}", "i": f"case when {_A} > 0 then {_LONG['7_days']} / {_A} else 0 end",
    "j": f"case when {_E} > 0 then {_T} / {_E} / 60 else 0 end",
}
_INDICATOR_SQL = ("SELECT zone_ref, system_id, " + ", ".join(
    f"round({expr}, 6) AS {letter}" for letter, expr in _INDICATORS.items()) + " FROM facts GROUP BY ALL")
oracle("report_indicators", "zones stats_pre_process", _INDICATOR_SQL, facts=_REPORT_FACTS)
_REPORT = ("SELECT o.system_id, z.zone_type, z.name, z.stats_ref, i.a, i.b, i.c, i.d, i.e, i.f, i.g, i.h, i.i, i.j "
           "FROM zones z CROSS JOIN (SELECT DISTINCT system_id FROM facts) o LEFT JOIN indicators i "
           "ON i.zone_ref = z.stats_ref AND i.system_id = o.system_id WHERE z.municipality = 'GM0001' "
           "AND z.zone_type IN ('municipality', 'residential_area')")
for _name in ("report_full", "report_export"):
    oracle(_name, "zones stats_pre_process", _REPORT, facts=_REPORT_FACTS, indicators=_INDICATOR_SQL)

# --- zones ------------------------------------------------------------------------------------------------------

_ZONE = "z.zone_id, z.name, z.owner, z.municipality, z.zone_type"
_LISTED = f"SELECT {_ZONE} FROM zones z LEFT JOIN geographies g ON g.zone_id = z.zone_id WHERE g.retire_date IS NULL"
oracle("zone_list", "zones geographies", _LISTED + " AND z.municipality IN ('GM0000', 'GM0001', 'GM0003')")
oracle("zone_list_without_custom", "zones geographies", _LISTED + " AND z.zone_type <> 'custom'")
oracle("municipalities", "zones", f"SELECT {_ZONE} FROM zones z WHERE zone_type = 'municipality' ORDER BY name")

_CORNERS = [("cx - hw", "cy"), ("cx", "cy - hh"), ("cx + hw", "cy"), ("cx", "cy + hh"), ("cx - hw", "cy")]
_CORNER_SQL = ", ".join(f"round({x}, 6) AS x{i}, round({y}, 6) AS y{i}" for i, (x, y) in enumerate(_CORNERS))
oracle("zones_by_filter", "zones",
       f"SELECT {_ZONE}, {_CORNER_SQL} FROM zones z WHERE municipality IN ('GM0001', 'GM0002', 'GM0004')")
oracle("municipality_area", "municipalities", f"SELECT gm_code, {_CORNER_SQL} FROM municipalities WHERE gm_code = 'GM0002'")
oracle("municipality_at", "zones zone_edges bike_detection",
       f"SELECT f.pid AS sample_id, {_ZONE} FROM (SELECT pid, min(zone_id) AS zone_id FROM hits GROUP BY pid) f "
       "JOIN zones z ON z.zone_id = f.zone_id",
       areas="SELECT * FROM zones WHERE zone_type = 'municipality'",
       points="SELECT sample_id AS pid, lon, lat FROM bike_detection",
       hits=hits("points", zones="areas", border_counts=True))

oracle("municipality_of_repeated_points", "zones zone_edges bike_detection",
       "SELECT form, p.pid AS point, f.zone_id FROM repeated p JOIN (SELECT pid, min(zone_id) AS zone_id FROM hits GROUP BY pid) f "
       "ON f.pid = p.pid CROSS JOIN (VALUES ('broadcast'), ('shuffled')) AS forms(form)",
       areas="SELECT * FROM zones WHERE zone_type = 'municipality'",
       repeated="SELECT sample_id AS pid FROM bike_detection UNION ALL SELECT sample_id FROM bike_detection",
       points="SELECT sample_id AS pid, lon, lat FROM bike_detection",
       hits=hits("points", zones="areas", border_counts=True))

_SHARE = "((p.lon - e.x1) * (e.x2 - e.x1) + (p.lat - e.y1) * (e.y2 - e.y1)) / (pow(e.x2 - e.x1, 2) + pow(e.y2 - e.y1, 2))"
_AT = f"least(greatest({_SHARE}, 0e0), 1e0)"
_NEAR = (f"min(pow(p.lon - (e.x1 + {_AT} * (e.x2 - e.x1)), 2) + pow(p.lat - (e.y1 + {_AT} * (e.y2 - e.y1)), 2)) "
         "<= 0.02e0 * 0.02e0")
_CHECK = {
    "areas": "SELECT * FROM zones WHERE zone_type = 'municipality'",
    "area_edges": _edges("areas", "municipality"),
    "drawn_edges": _edges("zone_requests", "request_id, municipality"),
    "stepped": "SELECT *, n.i AS i, m.n AS n FROM (SELECT *, cast(greatest(ceil(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) "
               "/ 0.001e0), 1) as bigint) AS n FROM drawn_edges) m, LATERAL (SELECT unnest(generate_series(0, m.n - 1)) "
               "AS i) n",
    "points": "SELECT request_id, municipality, x1 + (x2 - x1) * (i / n) AS lon, y1 + (y2 - y1) * (i / n) AS lat "
              "FROM stepped",
    "tested": f"SELECT p.request_id, p.lon, p.lat, ({CROSSINGS}) OR ({_NEAR}) AS good FROM points p JOIN area_edges e "
              "ON e.municipality = p.municipality GROUP BY p.request_id, p.lon, p.lat",
    "checked": "SELECT request_id, bool_and(good) AS is_valid FROM tested GROUP BY request_id",
}
oracle("zone_request_check", "zones zone_requests", "SELECT request_id, is_valid FROM checked", **_CHECK)
oracle("zone_create", "zones zone_requests",
       "SELECT r.request_id, (SELECT max(zone_id) FROM zones) + row_number() OVER (ORDER BY r.request_id) AS zone_id, "
       "r.name, cast(null as string) AS owner, r.municipality, 'custom' AS zone_type, cast(null as string) AS stats_ref "
       "FROM zone_requests r JOIN checked c ON c.request_id = r.request_id WHERE c.is_valid", **_CHECK)
oracle("zone_delete", "zones",
       f"SELECT {_ZONE}, z.stats_ref, zone_type = 'custom' AND zone_id IN (3, 7, 22, 24, 25, 101) AS deleted FROM zones z")

# --- feeds and detections ---------------------------------------------------------------------------------------

for _name in ("active_feeds", "feeds_json"):
    oracle(_name, "feeds",
           "SELECT feed_id, system_id, feed_type, cast(last_time_succesfully_imported as timestamp) AS "
           "last_time_succesfully_imported, last_time_succesfully_imported IS NOT NULL AND "
           "last_time_succesfully_imported > timestamp '2024-01-30 12:00:00' - interval '5' minute AS up "
           "FROM feeds WHERE is_active AND import_vehicles")

_POSITION = "s.last_time_imported, s.bike_id, s.lat, s.lon, s.system_id, s.is_check_in, s.is_check_out"


def _last(source: str) -> str:
    return (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bike_id ORDER BY last_time_imported DESC, "
            f"sample_id DESC) AS rank FROM {source}) WHERE rank = 1")


oracle("last_detections", "bike_detection", f"SELECT {_POSITION} FROM snapshot s", snapshot=_last("bike_detection"))
oracle("vehicles_in_bbox", "bike_detection",
       f"SELECT {_POSITION} FROM snapshot s WHERE lon >= 4.5 AND lon <= 5.75 AND lat >= 50.5 AND lat <= 51.75",
       snapshot=_last("bike_detection"))
_AREA_HITS = hits("points", zones="municipalities", edges="municipality_edges", key="gm_code")
oracle("vehicles_in_municipality", "bike_detection municipalities municipality_edges",
       f"SELECT {_POSITION} FROM snapshot s WHERE sample_id IN (SELECT pid FROM hits WHERE gm_code = 'GM0001')",
       snapshot=_last("bike_detection"), points="SELECT sample_id AS pid, lon, lat FROM snapshot", hits=_AREA_HITS)
oracle("latest_positions", "bike_detection municipalities municipality_edges",
       "SELECT bike_id, last_time_imported, lat, lon FROM last",
       points="SELECT sample_id AS pid, lon, lat FROM bike_detection", hits=_AREA_HITS,
       inside="SELECT * FROM bike_detection WHERE sample_id IN (SELECT pid FROM hits WHERE gm_code = 'GM0002')",
       last=_last("inside"))
oracle("movements", "bike_detection",
       "SELECT sample_id, bike_id, last_time_imported, round(distance, 6) AS distance FROM moved WHERE distance > 200",
       previous="SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0 FROM bike_detection WINDOW w AS "
                "(PARTITION BY bike_id ORDER BY last_time_imported, sample_id)",
       moved="SELECT *, 2 * 6371008.7714e0 * asin(sqrt(pow(sin(radians(lat - lat0) / 2e0), 2) + cos(radians(lat0)) * "
             "cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2e0), 2))) AS distance FROM previous")

# --- access -----------------------------------------------------------------------------------------------------


def _granted(column: str, item: str) -> str:
    return (f"SELECT DISTINCT user_id, unnest({_arrays(column)}) AS {item} FROM user_account u, organisation o WHERE "
            "o.organisation_id = u.organisation_id OR o.organisation_id IN (SELECT owner_organisation_id FROM "
            "view_data_access g WHERE g.granted_organisation_id = u.organisation_id OR g.granted_user = u.user_id)")


_ACCESS = "zones user_account organisation view_data_access"
_GRANTS = {
    "granted": _granted("data_owner_of_municipalities", "municipality"),
    "my_municipalities": "SELECT DISTINCT g.user_id, g.municipality, z.name FROM granted g JOIN zones z "
                         "ON z.municipality = g.municipality WHERE z.zone_type = 'municipality'",
    "my_zones": "SELECT m.user_id, z.zone_id FROM (SELECT DISTINCT user_id, municipality FROM my_municipalities) m "
                "JOIN zones z ON z.municipality = m.municipality",
    "my_operators": _granted("data_owner_of_operators", "system_id"),
}
oracle("acl_municipalities", _ACCESS, "SELECT user_id, municipality, name FROM my_municipalities", **_GRANTS)
oracle("acl_zones", _ACCESS, "SELECT user_id, zone_id FROM my_zones", **_GRANTS)
oracle("acl_operators", _ACCESS, "SELECT user_id, system_id FROM my_operators", **_GRANTS)

_ASKED = ("SELECT request_id, user_id, unnest(list) AS item, unnest(range(1, len(list) + 1)) AS position FROM "
          "(SELECT request_id, user_id, {0} AS list FROM requests)")
_DECISION = {
    **_GRANTS,
    "asked_zones": _ASKED.format(_arrays("zone_ids")),
    "asked_operators": _ASKED.format(_arrays("operators")),
    "bad_zone": "SELECT request_id, arg_min(item, position) AS item FROM asked_zones a WHERE NOT EXISTS (SELECT 1 FROM "
                "my_zones m WHERE m.user_id = a.user_id AND cast(m.zone_id as string) = a.item) GROUP BY request_id",
    "bad_operator": "SELECT request_id, arg_min(item, position) AS item FROM asked_operators a WHERE NOT EXISTS (SELECT 1 "
                    "FROM my_operators m WHERE m.user_id = a.user_id AND m.system_id = a.item) GROUP BY request_id",
    "facts": "SELECT r.*, o.type_of_organisation = 'ADMIN' AS is_admin, o.type_of_organisation = 'ADMIN' OR "
             "u.privileges LIKE '%DOWNLOAD_RAW_DATA%' AS may_export, EXISTS (SELECT 1 FROM my_municipalities m "
             "WHERE m.user_id = r.user_id) AS has_m, EXISTS (SELECT 1 FROM my_operators m WHERE m.user_id = r.user_id) "
             "AS has_o, z.item AS zone, b.item AS operator FROM requests r JOIN user_account u ON u.user_id = r.user_id "
             "JOIN organisation o ON o.organisation_id = u.organisation_id LEFT JOIN bad_zone z "
             "ON z.request_id = r.request_id LEFT JOIN bad_operator b ON b.request_id = r.request_id",
}


def _decided(asks_itself: str) -> str:
    """Without a list of its own a request is refused only where no grants are added to it."""
    return ("SELECT *, case when not is_admin and not has_m and not has_o then 'There should be at least a filter on "
               "municipalities or operators.' when has_m and " + asks_itself + " and zone_ids = '' then 'No zone filter was specified, but user "
               "doesn''t have access to all zones.' when has_m and zone is not null then "
               "concat('User is not allowed to access data within zone ', zone) when has_o and " + asks_itself + " and operators = '' then "
               "'No operator filter was specified, but user doesn''t have access to all operators.' when has_o and "
               "operator is not null then concat('User is not allowed to access operator ', operator) end AS reason "
               "FROM facts")


oracle("acl_decisions", _ACCESS + " requests",
       "SELECT request_id, user_id, reason IS NULL AS allowed, reason, may_export FROM decided", **_DECISION,
       decided=_decided("true"))
oracle("acl_export_decisions", _ACCESS + " requests",
       "SELECT request_id, user_id, reason IS NULL AND may_export AS allowed, case when reason is not null then reason "
       "when not may_export then 'This user is not admin and doesn''t have raw data rights.' end AS reason FROM decided",
       **_DECISION, decided=_decided("is_admin"))
oracle("acl_municipality_decisions", _ACCESS + " requests",
       "SELECT request_id, user_id, reason IS NULL AS allowed, reason FROM decided", **_GRANTS,
       decided="SELECT request_id, user_id, case when user_id in (select user_id from my_municipalities) and not exists "
               "(select 1 from my_municipalities m where m.user_id = r.user_id and m.municipality = r.gm_code) then "
               "'User is not allowed to access this municipality.' end AS reason FROM requests r")

_TEXT = "string_agg(concat({0}, '=', name), ';' ORDER BY {0}) AS t"
oracle("acl_summary", _ACCESS + " municipalities_with_data operators",
       "SELECT u.user_id, o.type_of_organisation, o.type_of_organisation = 'ADMIN' AS is_admin, "
       "u.privileges LIKE '%ORGANISATION_ADMIN%' AS is_contact_person_municipality, m.t IS NOT NULL AS "
       "filter_municipality, s.t IS NOT NULL AS filter_operator, case when m.t is not null and s.t is null then m.t "
       "else (select t from all_m) end AS municipalities, case when s.t is not null and m.t is null then s.t else "
       "(select t from all_o) end AS operators FROM user_account u JOIN organisation o ON o.organisation_id = "
       "u.organisation_id LEFT JOIN own_m m ON m.user_id = u.user_id LEFT JOIN own_o s ON s.user_id = u.user_id",
       **_GRANTS,
       own_m=f"SELECT user_id, {_TEXT.format('municipality')} FROM my_municipalities GROUP BY user_id",
       own_o="SELECT user_id, string_agg(concat(system_id, '=', upper(system_id[1]), lower(system_id[2:])), ';' "
             "ORDER BY system_id) AS t FROM my_operators GROUP BY user_id",
       all_m="SELECT string_agg(concat(d.municipality, '=', d.name), ';' ORDER BY d.municipality) AS t "
             "FROM municipalities_with_data d JOIN zones z ON z.municipality = d.municipality "
             "WHERE z.zone_type = 'municipality'",
       all_o=f"SELECT {_TEXT.format('system_id')} FROM operators")
oracle("public_filter_values", "zones geographies municipalities_with_data operators",
       "SELECT 'municipality' AS kind, d.municipality AS code, d.name, z.zone_id FROM municipalities_with_data d "
       "JOIN zones z ON z.municipality = d.municipality WHERE z.zone_type = 'municipality' UNION ALL "
       "SELECT 'operator', system_id, name, cast(null as bigint) FROM operators UNION ALL "
       "SELECT 'zone', cast(zone_id as string), name, zone_id FROM listed",
       listed=_LISTED + " AND z.zone_type <> 'custom' AND z.municipality = 'GM0001'")
oracle("acl_filtered_trips", _ACCESS + " trips zone_edges",
       "SELECT trip_id, system_id, bike_id, vehicle_type_id, start_lon, start_lat, end_lon, end_lat, start_time, end_time "
       "FROM numbered p WHERE (NOT EXISTS (SELECT 1 FROM ops) OR system_id IN (SELECT system_id FROM ops)) AND "
       "(NOT EXISTS (SELECT 1 FROM zs) OR pid IN (SELECT pid FROM start_hits WHERE zone_id IN (SELECT zone_id FROM zs)) "
       "OR pid IN (SELECT pid FROM end_hits WHERE zone_id IN (SELECT zone_id FROM zs)))",
       **_GRANTS, **_TRIP_STEPS,
       ops=f"SELECT system_id FROM my_operators WHERE user_id = '{q.EXPORT_USER}'",
       zs=f"SELECT zone_id FROM my_zones WHERE user_id = '{q.EXPORT_USER}'")

_MAY = ("(NOT EXISTS (SELECT 1 FROM ops) OR system_id IN (SELECT system_id FROM ops)) AND (NOT EXISTS (SELECT 1 FROM zs) OR ")
oracle("raw_export_of_user", _ACCESS + " trips park_events zone_edges",
       "SELECT 'trip' AS kind, trip_id AS id, system_id, bike_id, vehicle_type_id, start_lon, start_lat, end_lon, end_lat, start_time, end_time "
       f"FROM numbered p WHERE {_MAY}pid IN (SELECT pid FROM start_hits WHERE zone_id IN (SELECT zone_id FROM zs)) "
       "OR pid IN (SELECT pid FROM end_hits WHERE zone_id IN (SELECT zone_id FROM zs))) UNION ALL "
       "SELECT 'park_event', pid, system_id, bike_id, vehicle_type_id, lon, lat, cast(null as double), cast(null as double), start_time, end_time "
       f"FROM event_points WHERE {_MAY}pid IN (SELECT pid FROM event_hits WHERE zone_id IN (SELECT zone_id FROM zs)))",
       **_GRANTS, **_TRIP_STEPS,
       event_points=f"SELECT park_event_id AS pid, * FROM park_events WHERE start_time {_EDGE}", event_hits=hits("event_points"),
       ops=f"SELECT system_id FROM my_operators WHERE user_id = '{q.EXPORT_USER}'",
       zs=f"SELECT zone_id FROM my_zones WHERE user_id = '{q.EXPORT_USER}'")

# --- sinks ------------------------------------------------------------------------------------------------------

_QUARTER = "timestamp '1998-01-01' AND {0} <= timestamp '1998-03-31'"
oracle("raw_export_trips", "trips zones zone_edges",
       "SELECT trip_id, system_id, bike_id, vehicle_type_id, start_lon, start_lat, end_lon, end_lat, start_time, end_time "
       f"FROM numbered p WHERE system_id IN ('op_1', 'op_2') AND ({_hit('start')} OR {_hit('end')})",
       **{**_TRIP_STEPS, "numbered": "SELECT row_number() OVER () AS pid, * FROM trips WHERE start_time >= "
                                     + _QUARTER.format("end_time")})
oracle("raw_export_park_events", "park_events zones zone_edges",
       "SELECT park_event_id, system_id, bike_id, vehicle_type_id, lon, lat, start_time, end_time FROM points p "
       f"WHERE system_id IN ('op_1', 'op_2') AND EXISTS (SELECT 1 FROM hits h WHERE h.pid = p.pid "
       f"AND h.zone_id IN ({CHOSEN}))",
       points="SELECT park_event_id AS pid, * FROM park_events WHERE start_time >= " + _QUARTER.format("start_time"),
       hits=hits("points"))
_ACTIVE = ("SELECT sha1(concat('user_', cast(user_id as string), ':active-users')) AS user_hash, "
           "min(case event_id % 4 when 0 then 'municipality' when 1 then 'operator' when 2 then 'admin' end) AS role, "
           "cast(ts as date) AS active_on FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 GROUP BY 1, 3")
ORACLE["active_users_daily"] = ORACLE["stream_active_users"] = ORACLE["stream_active_users_bounded"] = _ACTIVE
oracle("audit_rows", "requests",
       "SELECT user_id AS username, timestamp '2024-01-30 12:00:00' AS timestamp_accessed, "
       "concat('/raw_data?request=', cast(request_id as string)) AS raw_api_call, "
       "concat('{\"operators\":\"', operators, '\",\"zones\":\"', zone_ids, '\"}') AS filter_active FROM requests")

# --- streams: the same result as a batch ------------------------------------------------------------------------

oracle("stream_rental_buckets", "stats_number_of_trips",
       "SELECT time_bucket(interval '15 minutes', time) AS bucket, system_id, modality, "
       "cast(sum(number_of_trips_started) as bigint) AS number_of_trips_started, "
       "cast(sum(number_of_trips_ended) as bigint) AS number_of_trips_ended FROM stats_number_of_trips GROUP BY ALL")
ORACLE["stream_rental_buckets_in_time"] = ORACLE["stream_rental_buckets"]
ORACLE["stream_rental_series"] = ORACLE["rental_series_15m"]
oracle("stream_parked_buckets", "stats_number_of_vehicles_parked",
       "SELECT cast(date_trunc('hour', time) as timestamp) AS bucket, system_id, modality, "
       "min(number_of_vehicles_parked) AS min, max(number_of_vehicles_parked) AS max, "
       "round(avg(number_of_vehicles_parked), 6) AS avg FROM stats_number_of_vehicles_parked GROUP BY ALL")
oracle("stream_latest_positions", "bike_detection",
       "SELECT bike_id, sample_id, system_id, lon, lat, last_time_imported, is_check_in, is_check_out FROM last",
       last=_last("bike_detection"))
