"""Small tables that are part of the program."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def literal_table(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType) -> DataFrame:
    """A table written out in the plan; it needs no job and no file."""
    def literal(value: object) -> str:
        if value is None:
            return "null"
        return "'" + value.replace("'", "\\'") + "'" if isinstance(value, str) else str(value)

    values = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(schema.fieldNames())})")
    return table.select(*(F.col(f.name).cast(f.dataType) for f in schema))


# Operators that are shown when a user is not restricted to some, with their display names.
OPERATORS = (
    ("cykl", "Cykl"),
    ("donkey", "Donkey Republic"),
    ("greenwheels", "Greenwheels"),
    ("mobike", "Mobike"),
    ("mywheels", "MyWheels"),
    ("htm", "HTM"),
    ("gosharing", "GO Sharing"),
    ("check", "CHECK"),
    ("felyx", "Felyx"),
    ("deelfietsnederland", "Deelfiets Nederland"),
    ("keobike", "Keobike"),
    ("lime", "Lime"),
    ("baqme", "BAQME"),
    ("cargoroo", "Cargoroo"),
    ("uwdeelfiets", "uwdeelfiets"),
    ("hely", "Hely"),
    ("tier", "TIER"),
    ("bolt", "Bolt"),
    ("bondi", "bondi"),
    ("dott", "Dott"),
    ("moveyou", "GoAbout"),
)

# Zones whose occupancy is public, with their capacity where one is known.
PUBLIC_ZONES = (
    (51184, "Eind Zwarte Pad", 114),
    (51186, "Midden Zwarte Pad", 84),
    (51185, "Begin Zwarte Pad", 66),
    (51225, "Korte Zeekant", 110),
    (51200, "Strandweg (Seinpostduin)", 84),
    (51199, "Keerlus Tramlijn 11", 22),
    (51193, "Visserhavenweg", 40),
    (51198, "Biesieklette Noordelijk Havenhoofd", 24),
    (51197, "Strandslag 12", 60),
    (51215, "Biesieklette Kijkduin", 40),
    (51209, "Parking Strand", None),
    (51214, "Rand servicegebied Keizerstraat", None),
    (51213, "Rand servicegebied Badhuisweg", None),
    (51212, "Rand servicegebied Duinstraat", None),
    (51211, "Rand servicegebied Vissershavenweg", None),
    (16810, "Den Haag Centraal", None),
    (16776, "nabij HS", None),
)

OPERATOR_SCHEMA = T.StructType([T.StructField("system_id", T.StringType()), T.StructField("name", T.StringType())])
PUBLIC_ZONE_SCHEMA = T.StructType([T.StructField("zone_id", T.LongType()), T.StructField("name", T.StringType()),
                                   T.StructField("capacity", T.LongType())])


def operators(spark: SparkSession) -> DataFrame:
    return literal_table(spark, OPERATORS, OPERATOR_SCHEMA)


def public_zones(spark: SparkSession) -> DataFrame:
    return literal_table(spark, PUBLIC_ZONES, PUBLIC_ZONE_SCHEMA)
