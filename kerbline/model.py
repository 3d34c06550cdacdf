"""Schemas of the tables the plans read."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG, INT = T.StringType(), T.LongType(), T.IntegerType()
DOUBLE, DATE, TIME, BOOL = T.DoubleType(), T.DateType(), T.TimestampNTZType(), T.BooleanType()

POINT = T.StructType([T.StructField("x", DOUBLE), T.StructField("y", DOUBLE)])
RINGS = T.ArrayType(T.ArrayType(POINT))


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SCHEMAS: dict[str, T.StructType] = {
    "park_events": _schema(park_event_id=LONG, system_id=STRING, bike_id=STRING, vehicle_type_id=INT,
                           lon=DOUBLE, lat=DOUBLE, start_time=TIME, end_time=TIME),
    "vehicle_type": _schema(vehicle_type_id=INT, form_factor=STRING),
    "park_event_on_date": _schema(on_date=DATE, chunk=LONG, park_event_ids=T.ArrayType(LONG)),
    "trips": _schema(trip_id=LONG, system_id=STRING, bike_id=STRING, vehicle_type_id=INT,
                     start_lon=DOUBLE, start_lat=DOUBLE, end_lon=DOUBLE, end_lat=DOUBLE,
                     start_time=TIME, end_time=TIME),
    "zones": _schema(zone_id=LONG, name=STRING, owner=STRING, municipality=STRING, zone_type=STRING,
                     stats_ref=STRING, rings=RINGS),
    "geographies": _schema(zone_id=LONG, retire_date=DATE),
    "municipalities": _schema(gm_code=STRING, rings=RINGS),
    "municipalities_with_data": _schema(municipality=STRING, name=STRING),
    "stats_pre_process": _schema(date=DATE, zone_ref=STRING, stat_description=STRING, system_id=STRING, value=LONG),
    "stats_number_of_vehicles_parked": _schema(time=TIME, zone_id=LONG, system_id=STRING, modality=STRING,
                                               number_of_vehicles_parked=LONG),
    "stats_number_of_trips": _schema(time=TIME, zone_id=LONG, system_id=STRING, modality=STRING,
                                     number_of_trips_started=LONG, number_of_trips_ended=LONG),
    "bike_detection": _schema(sample_id=LONG, bike_id=STRING, system_id=STRING, lon=DOUBLE, lat=DOUBLE,
                              last_time_imported=TIME, is_check_in=BOOL, is_check_out=BOOL),
    "feeds": _schema(feed_id=LONG, system_id=STRING, feed_type=STRING, last_time_succesfully_imported=TIME,
                     is_active=BOOL, import_vehicles=BOOL),
    "user_account": _schema(user_id=STRING, organisation_id=LONG, privileges=T.ArrayType(STRING)),
    "organisation": _schema(organisation_id=LONG, type_of_organisation=STRING,
                            data_owner_of_municipalities=T.ArrayType(STRING),
                            data_owner_of_operators=T.ArrayType(STRING)),
    "view_data_access": _schema(owner_organisation_id=LONG, granted_organisation_id=LONG, granted_user=STRING),
    "audit_log": _schema(username=STRING, timestamp_accessed=TIME, raw_api_call=STRING, filter_active=STRING),
    "active_user_stats": _schema(user_hash=STRING, role=STRING, active_on=DATE),
}
# The snapshot of last known positions has the columns of the detections it is taken from.
SCHEMAS["last_detection_bike"] = SCHEMAS["bike_detection"]
SCHEMAS["last_detection_cycle"] = SCHEMAS["bike_detection"]

# Names of the daily statistics.
VEHICLES_AVAILABLE = "number_of_vehicles_available"
TRIPS_STARTED = "number_of_trip_started"
TRIPS_ENDED = "number_of_trips_ended"
TRIP_DURATION = "sum_of_trip_duration"
LONGER_THAN_24_HOURS = "number_of_vehicles_available_longer_then_24_hours"
LONGER_THAN_4_DAYS = "number_of_vehicles_available_longer_then_4_days"
LONGER_THAN_7_DAYS = "number_of_vehicles_available_longer_then_7_days"
