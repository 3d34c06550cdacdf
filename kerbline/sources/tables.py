"""Reading the tables of the model from files, a catalog or a relational database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kerbline.functions.geometry import rings_from_geojson
from kerbline.model import SCHEMAS


def load(spark: SparkSession, name: str, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A model table from files. The schema is given, so nothing is inferred; partition columns are kept."""
    if name not in SCHEMAS:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.format(fmt).options(**options).schema(SCHEMAS[name]).load(path)


def load_table(spark: SparkSession, name: str, database: str | None = None) -> DataFrame:
    """A model table from the session catalog, columns in model order."""
    source = spark.table(f"{database}.{name}" if database else name)
    return source.select(*(F.col(f.name).cast(f.dataType) for f in SCHEMAS[name]))


def load_jdbc(spark: SparkSession, url: str, query: str, partition_column: str, lower: int, upper: int,
              partitions: int, **options: str) -> DataFrame:
    """A query on a relational database, read in parallel ranges of a numeric column."""
    return (spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) AS source")
            .option("partitionColumn", partition_column).option("lowerBound", str(lower))
            .option("upperBound", str(upper)).option("numPartitions", str(partitions)).options(**options).load())


def with_rings(df: DataFrame, geojson: str = "geojson") -> DataFrame:
    """Replace a GeoJSON text column by `rings`."""
    return df.withColumn("rings", rings_from_geojson(F.col(geojson))).drop(geojson)


def unnest(df: DataFrame, array: str, item: str) -> DataFrame:
    """One row per array item."""
    return df.select(*(c for c in df.columns if c != array), F.explode(array).alias(item))
