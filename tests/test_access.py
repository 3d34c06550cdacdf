from datetime import datetime

import pytest

from kerbline.filters import Filter
from kerbline.model import SCHEMAS
from kerbline.plans import access, exports
from kerbline.session import shared_dir
from kerbline.sources import dimensions
from tests.shapes import square, zones


@pytest.fixture(scope="module")
def tables(spark):
    users = spark.createDataFrame([
        ("root", 1, []), ("city", 2, ["DOWNLOAD_RAW_DATA"]), ("firm", 3, ["ORGANISATION_ADMIN"]), ("guest", 4, []),
        ("both", 5, []), ("friend", 4, [])], SCHEMAS["user_account"])
    organisations = spark.createDataFrame([
        (1, "ADMIN", [], []), (2, "MUNICIPALITY", ["GM1", "GM9"], []), (3, "OPERATOR", [], ["op_a"]),
        (4, "OTHER", [], []), (5, "OTHER", [], [])], SCHEMAS["organisation"])
    grants = spark.createDataFrame([(2, 5, None), (3, 5, None), (2, None, "friend"), (2, None, "friend")],
                                   SCHEMAS["view_data_access"])
    areas = zones(spark, (1, "municipality", "GM1", [square(4, 52)]), (2, "custom", "GM1", [square(4, 52, 0.5)]),
                  (3, "municipality", "GM2", [square(6, 52)]), (4, "custom", "GM9", [square(8, 52)]))
    return access.AccessTables(users, organisations, grants, areas)


def test_effective_grants(tables):
    municipalities = {(r[0], r[1]) for r in access.effective_municipalities(tables).collect()}
    assert municipalities == {("city", "GM1"), ("both", "GM1"), ("friend", "GM1")}
    operators = {tuple(r) for r in access.effective_operators(tables).collect()}
    assert operators == {("firm", "op_a"), ("both", "op_a")}
    zones_found = [tuple(r) for r in access.effective_zones(tables).collect()]
    assert sorted(zones_found) == sorted((u, z) for u in ("city", "both", "friend") for z in (1, 2))


CASES = [
    ("root", [], [], None), ("root", ["3"], ["op_b"], None), ("guest", ["1"], ["op_a"], access.NO_GRANTS),
    ("city", [], [], access.ZONES_REQUIRED), ("city", ["1", "2"], [], None),
    ("city", ["1", "4", "3"], [], access.ZONE_REFUSED + "4"), ("city", ["x"], [], access.ZONE_REFUSED + "x"),
    ("firm", [], [], access.OPERATORS_REQUIRED), ("firm", [], ["op_a"], None),
    ("firm", ["3"], ["op_a", "op_b"], access.OPERATOR_REFUSED + "op_b"),
    ("both", ["1"], [], access.OPERATORS_REQUIRED), ("both", ["3"], ["op_b"], access.ZONE_REFUSED + "3"),
    ("friend", ["2"], [], None), ("nobody", ["1"], [], access.UNKNOWN_USER),
]


def test_decisions(spark, tables):
    requests = spark.createDataFrame([(i, user, zone_ids, operators) for i, (user, zone_ids, operators, _) in
                                      enumerate(CASES)],
                                     "request_id bigint, user_id string, zone_ids array<string>, operators array<string>")
    rows = access.decide(requests, tables).orderBy("request_id").collect()
    assert [(r["reason"], r["allowed"]) for r in rows] == [(reason, reason is None) for *_, reason in CASES]
    exports_allowed = sorted(r["request_id"] for r in access.decide_export(requests, tables).collect() if r["allowed"])
    assert exports_allowed == [0, 1, 3, 4]  # the grants of 3 stand in for its missing list


def test_municipality_decisions(spark, tables):
    requests = spark.createDataFrame([(1, "city", "GM1"), (2, "city", "GM2"), (3, "firm", "GM2"), (4, "nobody", "GM1")],
                                     "request_id bigint, user_id string, gm_code string")
    rows = access.decide_municipality(requests, tables).orderBy("request_id").collect()
    assert [r["reason"] for r in rows] == [None, access.MUNICIPALITY_REFUSED, None, access.UNKNOWN_USER]


def _seen(tables, user, **f):
    scope = access.scope_of(tables, user, Filter(**f))
    ids = None if scope.zones is None else sorted(r["zone_id"] for r in scope.zones.select("zone_id").collect())
    names = None if scope.operators is None else sorted(r[0] for r in scope.operators.collect())
    return ids, names


def test_scope_is_the_filter_within_the_grants(tables):
    assert _seen(tables, "root") == (None, None)
    assert _seen(tables, "root", zone_ids=(3,), operators=("op_x",)) == ([3], ["op_x"])
    assert _seen(tables, "city") == ([1, 2], None)
    assert _seen(tables, "city", zone_ids=(2, 3)) == ([2], None)
    assert _seen(tables, "both", operators=("op_a", "op_b")) == ([1, 2], ["op_a"])
    assert access.scope_of(tables, "city", Filter(zone_ids=(2,)), decided=True).zones.count() == 2
    for user in ("nobody", "guest"):
        with pytest.raises(PermissionError):
            access.scope_of(tables, user, Filter())


def test_visible_trips_follow_the_scope(spark, tables):
    day = datetime(2024, 1, 1)
    rows = [(i, operator, "b", 0, x, 52.5, x, 52.5, day, day) for i, (operator, x) in enumerate(
        (("op_a", 4.5), ("op_b", 4.5), ("op_a", 6.5)))]
    trips = spark.createDataFrame(rows, SCHEMAS["trips"])
    f = Filter(start_time=day, end_time=day)
    def seen(user):
        found = exports.visible_trips(trips, access.scope_of(tables, user, f), f)
        return sorted(r["trip_id"] for r in found.collect())
    assert (seen("root"), seen("city"), seen("firm"), seen("both")) == ([0, 1, 2], [0, 1], [0, 2], [0])


def test_summary_shows_own_lists_only_without_the_other_kind(spark, tables):
    with_data = spark.createDataFrame([("GM1", "One"), ("GM2", "Two")], SCHEMAS["municipalities_with_data"])
    rows = {r["user_id"]: r for r in access.user_summary(tables, with_data, dimensions.operators(spark)).collect()}
    def codes(user):
        return [m["gm_code"] for m in rows[user]["municipalities"]], len(rows[user]["operators"])
    assert codes("city") == (["GM1"], 21)
    assert codes("firm") == (["GM1", "GM2"], 1) and rows["firm"]["operators"][0]["name"] == "Op_a"
    assert codes("both") == (["GM1", "GM2"], 21) == codes("guest")
    assert rows["root"]["is_admin"] and rows["firm"]["is_contact_person_municipality"]
    roles = {r["user_id"]: r["role"] for r in access.user_summary(tables, with_data, dimensions.operators(spark)).select(
        "user_id", exports.role_of().alias("role")).collect()}
    assert [(m["gm_code"], m["name"], m["zone_id"] is not None) for m in rows["guest"]["municipalities"]] == [
        ("GM1", "One", True), ("GM2", "Two", True)]
    swapped = spark.createDataFrame([("GM1", "Z"), ("GM2", "A")], SCHEMAS["municipalities_with_data"])
    guest = {r["user_id"]: r for r in access.user_summary(tables, swapped, dimensions.operators(spark)).collect()}["guest"]
    assert [m["name"] for m in guest["municipalities"]] == ["A", "Z"]
    assert roles == {"root": "admin", "city": "municipality", "friend": "municipality", "firm": "operator",
                     "both": "operator", "guest": None}


def test_public_values(spark, tables):
    with_data = spark.createDataFrame([("GM1", "One"), ("GM7", "Nowhere")], SCHEMAS["municipalities_with_data"])
    kinds = [r["kind"] for r in access.public_filter_values(with_data, tables.zones, dimensions.operators(spark)).collect()]
    assert (kinds.count("municipality"), kinds.count("operator"), kinds.count("zone")) == (1, 21, 0)


def test_raw_export_checks_logs_and_writes(spark, tables):
    day = datetime(2024, 1, 1)
    trips = spark.createDataFrame([(i, "op_a", "b", 0, x, 52.5, x, 52.5, day, day) for i, x in enumerate((4.5, 6.5))],
                                  SCHEMAS["trips"])
    events = spark.createDataFrame([(1, "op_a", "b", 0, 4.5, 52.5, day, None)], SCHEMAS["park_events"])
    folder, audit = shared_dir(spark, "raw"), shared_dir(spark, "audit")
    def export(user, **f):
        return exports.raw_export(trips, events, tables, user, Filter(start_time=day, end_time=day, **f), folder, audit,
                                  "/raw_data?x=1", day)
    paths = export("city")
    assert [r["trip_id"] for r in spark.read.parquet(paths["trips"]).collect()] == [0]
    assert spark.read.parquet(paths["park_events"]).count() == 1
    for user, f in (("guest", {}), ("friend", {}), ("city", {"zone_ids": (3,)}), ("nobody", {})):
        with pytest.raises(PermissionError):
            export(user, **f)
    (row,) = spark.read.parquet(audit).collect()
    assert row["username"] == "city" and row["raw_api_call"] == "/raw_data?x=1"


def test_items_are_made_distinct_before_users_meet_them(tables):
    """A task must not hold every item of every user: the distinct rows are by list of sources."""
    for df in (access.effective_operators(tables), access.effective_municipalities(tables), access.user_grants(tables)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        by = [line for line in plan.splitlines() if "Aggregate [" in line and "user_id" in line]
        assert by and not any("item" in line for line in by)


def test_grants_of_repeated_users_and_missing_keys(spark, tables):
    """A user in two organisations sees both; unknown organisations and owners grant nothing; users without a name stay."""
    users = spark.createDataFrame([("a", 2, []), ("a", 2, []), ("a", 3, []), (None, 3, []), ("lost", None, []), ("c", 9, [])],
                                  SCHEMAS["user_account"])
    organisations = spark.createDataFrame([
        (2, "MUNICIPALITY", ["GM1", "GM1"], ["op_a"]), (2, "OTHER", [], ["op_b"]), (3, "OPERATOR", [], ["op_a", None]),
        (None, "OPERATOR", ["GM1"], ["op_z"])], SCHEMAS["organisation"])
    grants = spark.createDataFrame([(2, None, "lost"), (None, None, "c"), (None, 9, None), (3, None, "nobody"), (2, None, "a"), (3, 9, "c")],
                                   SCHEMAS["view_data_access"])
    odd = access.AccessTables(users, organisations, grants, tables.zones)
    rows = [tuple(r) for r in access.effective_operators(odd).collect()]
    both = [(u, o) for u in ("a", None, "c") for o in ("op_a", None)]
    assert sorted(rows, key=repr) == sorted([*both, ("a", "op_b"), ("lost", "op_a"), ("lost", "op_b")], key=repr)
    assert sorted(tuple(r)[:2] for r in access.effective_municipalities(odd).collect()) == [("a", "GM1"), ("lost", "GM1")]
    lists = {(r["user_id"], tuple(sorted(r["granted_operators"]))) for r in access.user_grants(odd).collect()}
    assert lists == {("a", ("op_a", "op_b")), (None, ())}  # the others have no known organisation


def test_raw_export_decides_for_its_user_only(spark, tables, monkeypatch):
    """The grants of all others are not worked out for one request."""
    class Decided(Exception):
        pass

    def decide(request, given):
        assert [tuple(r) for r in given.users.select("user_id").collect()] == [("city",)] and request.first()["user_id"] == "city"
        raise Decided

    monkeypatch.setattr(exports, "decide_export", decide)
    trips = spark.createDataFrame([], SCHEMAS["trips"])
    with pytest.raises(Decided):
        exports.raw_export(trips, trips, tables, "city", Filter.from_args({"start_time": "1998-01-01", "end_time": "1998-01-02"}),
                           "", "", "/raw_data", datetime(2024, 1, 1))
