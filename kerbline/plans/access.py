"""Row-level access: what users may see, and whether their requests are allowed. For all users at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kerbline.filters import Filter, keep
from kerbline.operators.lookup import lookup_join, spread_join
from kerbline.plans.zones import MUNICIPALITY

# Names of organisation types and privileges.
ADMIN = "ADMIN"
ORGANISATION_ADMIN = "ORGANISATION_ADMIN"
DOWNLOAD_RAW_DATA = "DOWNLOAD_RAW_DATA"

# The reasons of a refusal.
NO_GRANTS = "There should be at least a filter on municipalities or operators."
ZONES_REQUIRED = "No zone filter was specified, but user doesn't have access to all zones."
ZONE_REFUSED = "User is not allowed to access data within zone "
OPERATORS_REQUIRED = "No operator filter was specified, but user doesn't have access to all operators."
OPERATOR_REFUSED = "User is not allowed to access operator "
MUNICIPALITY_REFUSED = "User is not allowed to access this municipality."
RAW_DATA_REFUSED = "This user is not admin and doesn't have raw data rights."
UNKNOWN_USER = "Unknown user."

# Rows by lists of sources are broadcast up to this number; such a list can be as long as there are organisations.
SOURCE_ROWS = 50_000


@dataclass(frozen=True)
class AccessTables:
    users: DataFrame
    organisations: DataFrame
    grants: DataFrame
    zones: DataFrame

    def known_users(self) -> DataFrame:
        """Users with the type of their organisation."""
        types = self.organisations.select("organisation_id", "type_of_organisation")
        return lookup_join(self.users, types, "organisation_id")

    def municipality_zones(self) -> DataFrame:
        return self.zones.where(F.col("zone_type") == MUNICIPALITY)


def _owned(tables: AccessTables) -> DataFrame:
    """(owner_organisation_id, kind, item); only municipalities that exist as a zone."""
    def exploded(kind: str, array: str) -> DataFrame:
        return tables.organisations.select(F.col("organisation_id").alias("owner_organisation_id"),
                                           F.lit(kind).alias("kind"), F.explode(array).alias("item"))

    existing = tables.municipality_zones().select(F.col("municipality").alias("item")).distinct()
    municipalities = lookup_join(exploded("municipality", "data_owner_of_municipalities"), existing, "item", "left_semi")
    return municipalities.unionByName(exploded("operator", "data_owner_of_operators"))


def _sources(tables: AccessTables) -> DataFrame:
    """(user_id, sources): one row per user; the own organisations, and the owners that granted to the user (`direct`), sorted.

    The number of organisations bounds a list. Users with the same sources see the same.
    """
    def source(direct: bool, organisation: str) -> Column:
        return F.struct(F.lit(direct).alias("direct"), F.col(organisation).alias("organisation_id")).alias("source")

    own = tables.users.select("user_id", source(False, "organisation_id"))
    directly = tables.grants.where(F.col("granted_user").isNotNull()).select(
        F.col("granted_user").alias("user_id"), source(True, "owner_organisation_id"))
    lists = own.unionByName(directly).groupBy("user_id").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    # Whoever has no account has no organisation, not even an unknown one; sorted, it would come first.
    return lists.where(~F.element_at("sources", 1)["direct"])


def _granted(tables: AccessTables, sources: DataFrame) -> DataFrame:
    """(sources, kind, item): what the users with these sources see, once for all of them."""
    items = _owned(tables)
    own = tables.organisations.select("organisation_id", F.col("organisation_id").alias("owner_organisation_id"))
    to_organisation = tables.grants.where(F.col("granted_organisation_id").isNotNull()).select(
        F.col("granted_organisation_id").alias("organisation_id"), "owner_organisation_id")
    through_organisation = (spread_join(own.unionByName(to_organisation).distinct(), items, "owner_organisation_id")
                            .select(F.lit(False).alias("direct"), "organisation_id", "kind", "item").distinct())
    directly = items.select(F.lit(True).alias("direct"), F.col("owner_organisation_id").alias("organisation_id"), "kind", "item")
    lists = sources.select("sources").distinct().select("sources", F.inline("sources"))
    return lookup_join(lists, through_organisation.unionByName(directly), ["direct", "organisation_id"]).select(
        "sources", "kind", "item").distinct()


def effective_grants(tables: AccessTables) -> DataFrame:
    """(user_id, kind, item): what the own organisation owns, and what owners granted to it or to the user.

    Items are made distinct per list of sources. Users, far more than such lists, meet them at the end only.
    """
    sources = _sources(tables)
    return lookup_join(sources, _granted(tables, sources), "sources", max_rows=SOURCE_ROWS).select("user_id", "kind", "item")


def _of_kind(tables: AccessTables, kind: str, name: str) -> DataFrame:
    return effective_grants(tables).where(F.col("kind") == kind).select("user_id", F.col("item").alias(name))


def effective_municipalities(tables: AccessTables) -> DataFrame:
    """(user_id, municipality, name)."""
    names = tables.municipality_zones().select("municipality", "name").distinct()
    return lookup_join(_of_kind(tables, "municipality", "municipality"), names, "municipality").select(
        "user_id", "municipality", "name")


def effective_zones(tables: AccessTables) -> DataFrame:
    """(user_id, zone_id): all zones of the municipalities of a user."""
    zones = tables.zones.select("zone_id", "municipality")
    return lookup_join(_of_kind(tables, "municipality", "municipality"), zones, "municipality").select("user_id", "zone_id")


def effective_operators(tables: AccessTables) -> DataFrame:
    """(user_id, system_id)."""
    return _of_kind(tables, "operator", "system_id")


def raw_data_right(organisation_type: Column, privileges: Column) -> Column:
    return (organisation_type == ADMIN) | F.array_contains(privileges, DOWNLOAD_RAW_DATA)


# --- decisions ----------------------------------------------------------------------------------------------

def user_grants(tables: AccessTables) -> DataFrame:
    """One row per known user: role, export right, and the lists of granted municipalities and operators.

    The number of municipalities and of operators bounds the lists.
    """
    def items(kind: str) -> Column:
        return F.collect_list(F.when(F.col("kind") == kind, F.col("item")))

    sources = _sources(tables)
    lists = _granted(tables, sources).groupBy("sources").agg(
        items("municipality").alias("municipalities"), items("operator").alias("granted_operators"))
    nothing = F.array().cast("array<string>")
    known = tables.known_users().join(sources, "user_id", "left")
    return lookup_join(known, lists, "sources", "left", max_rows=SOURCE_ROWS).select(
        "user_id", (F.col("type_of_organisation") == ADMIN).alias("is_admin"),
        raw_data_right(F.col("type_of_organisation"), F.col("privileges")).alias("may_export"),
        F.coalesce("municipalities", nothing).alias("municipalities"),
        F.coalesce("granted_operators", nothing).alias("granted_operators"))


def decide(requests: DataFrame, tables: AccessTables, grants_added: bool = False) -> DataFrame:
    """(request_id, user_id, allowed, reason, may_export) for requests `request_id, user_id, zone_ids, operators`.

    With `grants_added` the grants of a user who is not an administrator count as asked for on top.

    A zone is granted when its municipality is, so zones are looked up once instead of listed per user. Of the
    refused items the first in the order of asking is named.
    """
    zone_of = tables.zones.select(F.col("zone_id").cast("string").alias("asked"), "municipality")
    asked = lookup_join(requests.select("request_id", F.posexplode("zone_ids").alias("position", "asked")),
                        zone_of, "asked", "left")
    # As long as the list of the request.
    asked_zones = asked.groupBy("request_id").agg(F.sort_array(F.collect_list(
        F.struct("position", "asked", "municipality"))).alias("asked_zones"))
    known = spread_join(requests.select("request_id", "user_id", "zone_ids", "operators").join(
        asked_zones, "request_id", "left"), user_grants(tables), "user_id", "left")

    def first_refused(items: str, refused) -> Column:
        return F.get(F.filter(items, refused), F.lit(0))

    refused_zone = first_refused("asked_zones", lambda z: ~F.coalesce(
        F.array_contains(F.col("municipalities"), z["municipality"]), F.lit(False)))["asked"]
    refused_operator = first_refused("operators", lambda o: ~F.array_contains(F.col("granted_operators"), o))
    by_zone, by_operator = F.size("municipalities") > 0, F.size("granted_operators") > 0
    asks_itself = F.col("is_admin") | F.lit(not grants_added)
    reason = (F.when(F.col("is_admin").isNull(), UNKNOWN_USER)
              .when(~F.col("is_admin") & ~by_zone & ~by_operator, NO_GRANTS)
              .when(by_zone & asks_itself & (F.size("zone_ids") == 0), ZONES_REQUIRED)
              .when(by_zone & refused_zone.isNotNull(), F.concat(F.lit(ZONE_REFUSED), refused_zone))
              .when(by_operator & asks_itself & (F.size("operators") == 0), OPERATORS_REQUIRED)
              .when(by_operator & refused_operator.isNotNull(), F.concat(F.lit(OPERATOR_REFUSED), refused_operator)))
    return known.select("request_id", "user_id", reason.isNull().alias("allowed"), reason.alias("reason"),
                        F.coalesce("may_export", F.lit(False)).alias("may_export"))


def decide_municipality(requests: DataFrame, tables: AccessTables) -> DataFrame:
    """(request_id, user_id, allowed, reason) for requests that name one municipality in `gm_code`."""
    known = spread_join(requests.select("request_id", "user_id", "gm_code"), user_grants(tables), "user_id", "left")
    granted = (F.size("municipalities") == 0) | F.array_contains(F.col("municipalities"), F.col("gm_code"))
    reason = F.when(F.col("is_admin").isNull(), UNKNOWN_USER).when(~granted, MUNICIPALITY_REFUSED)
    return known.select("request_id", "user_id", reason.isNull().alias("allowed"), reason.alias("reason"))


def decide_export(requests: DataFrame, tables: AccessTables) -> DataFrame:
    """As `decide` for raw data: grants are added to the request, and a right of its own is needed."""
    reason = F.when(~F.col("allowed"), F.col("reason")).when(~F.col("may_export"), RAW_DATA_REFUSED)
    decided = decide(requests, tables, grants_added=True)
    return decided.select("request_id", "user_id", reason.isNull().alias("allowed"), reason.alias("reason"))


# --- the rows of one user -------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Scope:
    """What limits the rows of one user; None stands for no limit."""

    zones: DataFrame | None
    operators: DataFrame | None


def _items_of(tables: AccessTables, user_id: str, organisation_id: int, owned: str, item: str) -> DataFrame:
    """What one user was granted; the filters on the grants reach the reader."""
    owners = tables.grants.where((F.col("granted_organisation_id") == organisation_id)
                                 | (F.col("granted_user") == user_id)).select(
        F.col("owner_organisation_id").alias("organisation_id"))
    granted = tables.organisations.join(owners, "organisation_id", "left_semi")
    own = tables.organisations.where(F.col("organisation_id") == organisation_id)
    return own.select(F.explode(owned).alias(item)).unionByName(granted.select(F.explode(owned).alias(item))).distinct()


def scope_of(tables: AccessTables, user_id: str, f: Filter, decided: bool = False) -> Scope:
    """What the filter leaves of the user's grants; for an administrator the filter alone.

    Without a filter on zones (operators) a user sees all that was granted. What was asked for but not granted is
    left out. A user without any grant is refused. With `decided` the request has passed `decide_export`, by which the
    grants are added to what was asked for.
    """
    account = tables.users.where(F.col("user_id") == user_id).join(
        tables.organisations, "organisation_id").select("organisation_id", "type_of_organisation").first()
    if account is None:
        raise PermissionError(UNKNOWN_USER)
    zones = keep(tables.zones, f.by_zone()) if f.zone_ids else None
    operators = operator_names(tables.zones.sparkSession, f.operators) if f.operators else None
    if account["type_of_organisation"] == ADMIN:
        return Scope(zones, operators)

    mine = (tables, user_id, account["organisation_id"])
    known = tables.municipality_zones().select("municipality")
    municipalities = _items_of(*mine, "data_owner_of_municipalities", "municipality").join(
        known, "municipality", "left_semi")
    granted_operators = _items_of(*mine, "data_owner_of_operators", "system_id")
    by_zone, by_operator = not municipalities.isEmpty(), not granted_operators.isEmpty()
    if not by_zone and not by_operator:
        raise PermissionError(NO_GRANTS)
    if by_zone:
        granted = tables.zones.join(municipalities, "municipality", "left_semi").select(*tables.zones.columns)
        zones = granted if decided else keep(granted, f.by_zone())
    if by_operator:
        operators = granted_operators if decided else keep(granted_operators, f.by_operator())
    return Scope(zones, operators)


def operator_names(spark: SparkSession, names: tuple[str, ...]) -> DataFrame:
    """The operators of a request as a table."""
    return spark.range(1).select(F.explode(F.array(*(F.lit(n) for n in names))).alias("system_id"))


# --- what a user is shown -----------------------------------------------------------------------------------

def default_municipalities(with_data: DataFrame, zones: DataFrame) -> DataFrame:
    """Municipalities shown when a user is not limited to some, by name."""
    areas = zones.where(F.col("zone_type") == MUNICIPALITY).select("municipality", "zone_id")
    return lookup_join(with_data, areas, "municipality").select(
        F.col("municipality").alias("gm_code"), "name", "zone_id").orderBy("name", "gm_code")


def capitalised(name: Column) -> Column:
    return F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, F.lit(2), F.length(name))))


def user_summary(tables: AccessTables, with_data: DataFrame, all_operators: DataFrame) -> DataFrame:
    """One row per user: role flags, visible municipalities and visible operators.

    The own list is shown only when the user has no list of the other kind. The number of municipalities and of
    operators bounds the lists.
    """
    areas = tables.municipality_zones().groupBy("municipality").agg(F.min("zone_id").alias("zone_id"))
    own_municipalities = lookup_join(effective_municipalities(tables), areas, "municipality").groupBy("user_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("municipality").alias("gm_code"), "name", "zone_id"))).alias("own_municipalities"))
    own_operators = effective_operators(tables).groupBy("user_id").agg(F.sort_array(F.collect_list(
        F.struct("system_id", capitalised(F.col("system_id")).alias("name")))).alias("own_operators"))
    # The default lists are the same for all users: two scalar subqueries.
    by_name = default_municipalities(with_data, tables.zones).agg(F.sort_array(F.collect_list(
        F.struct("name", "gm_code", "zone_id"))).alias("list"))
    default_list = by_name.select(F.transform("list", lambda m: F.struct(
        m["gm_code"].alias("gm_code"), m["name"].alias("name"), m["zone_id"].alias("zone_id")))).scalar()
    default_operators = all_operators.agg(F.sort_array(F.collect_list(F.struct("system_id", "name")))).scalar()
    shown = tables.known_users().join(own_municipalities, "user_id", "left").join(own_operators, "user_id", "left")
    only_municipalities = F.col("own_municipalities").isNotNull() & F.col("own_operators").isNull()
    only_operators = F.col("own_operators").isNotNull() & F.col("own_municipalities").isNull()
    return shown.select(
        "user_id", "type_of_organisation", "privileges",
        (F.col("type_of_organisation") == ADMIN).alias("is_admin"),
        F.array_contains("privileges", ORGANISATION_ADMIN).alias("is_contact_person_municipality"),
        F.col("own_municipalities").isNotNull().alias("filter_municipality"),
        F.col("own_operators").isNotNull().alias("filter_operator"),
        F.when(only_municipalities, F.col("own_municipalities")).otherwise(default_list).alias("municipalities"),
        F.when(only_operators, F.col("own_operators")).otherwise(default_operators).alias("operators"))


def public_filter_values(with_data: DataFrame, zones: DataFrame, all_operators: DataFrame,
                         listed_zones: DataFrame | None = None) -> DataFrame:
    """What a visitor can filter on, as rows `kind, code, name, zone_id`; zones only for a chosen municipality."""
    no_zone = F.lit(None).cast("bigint").alias("zone_id")
    values = default_municipalities(with_data, zones).select(
        F.lit("municipality").alias("kind"), F.col("gm_code").alias("code"), "name", "zone_id").unionByName(
        all_operators.select(F.lit("operator").alias("kind"), F.col("system_id").alias("code"), "name", no_zone))
    if listed_zones is None:
        return values
    return values.unionByName(listed_zones.select(
        F.lit("zone").alias("kind"), F.col("zone_id").cast("string").alias("code"), "name", "zone_id"))
