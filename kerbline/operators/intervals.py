"""An index for "which intervals hold this instant?".

Intervals are stored by the power of two of days that their length needs (class 0: up to a day, class 1: up to two, …) and,
within a class, by buckets as wide as the class is long, but no narrower than 2^FINEST days, which keeps folders few; files
are sorted by begin, so that the reader skips what is far from the instant. An interval of class c that holds an instant has begun in the
instant's bucket or the one before, so a lookup reads two folders a class, however long the history is. Intervals without
an end are a class of their own, by the day they begin; all that began before the instant hold it.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from kerbline.sources.sinks import WHOLE_FOLDER

LENGTH, BEGIN = "length_class", "begin_bucket"
OPEN = -1
# Days between the first and the last timestamp there can be need 22 bits.
CLASSES = range(23)
FINEST = 5
KEYS = T.StructType([T.StructField(LENGTH, T.IntegerType()), T.StructField(BEGIN, T.IntegerType())])


def with_interval_keys(rows: DataFrame, start: str = "start_time", end: str = "end_time") -> DataFrame:
    """The rows with their class and bucket. One that ends before it begins holds no instant; it goes to class 0."""
    length = F.col(end) - F.col(start)
    longer = sum((F.when(length > F.expr(f"interval '{1 << c}' day"), 1).otherwise(0) for c in CLASSES), F.lit(0))
    day = f"unix_date(cast(`{start}` as date))"
    return (rows.withColumn(LENGTH, F.when(F.col(end).isNull(), F.lit(OPEN)).otherwise(longer).cast("int"))
            .withColumn(BEGIN, F.expr(f"cast(shiftright({day}, greatest({LENGTH}, {FINEST})) as int)")))


def store_intervals(rows: DataFrame, path: str, start: str = "start_time", end: str = "end_time") -> None:
    """Write the index; what the folder held before is gone. Rows without a start hold no instant and are left out."""
    keyed = with_interval_keys(rows.where(F.col(start).isNotNull()), start, end).hint("rebalance", LENGTH, BEGIN).sortWithinPartitions(LENGTH, BEGIN, start)
    keyed.write.mode("overwrite").option(*WHOLE_FOLDER).partitionBy(LENGTH, BEGIN).parquet(path)


def load_intervals(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The stored rows with the columns of `schema` and the keys."""
    return spark.read.schema(T.StructType([*schema.fields, *KEYS.fields])).parquet(path)


def may_hold(instant: datetime) -> Column:
    """Which folders can have intervals that hold the instant: a condition on the keys only, so all others are pruned."""
    day = (instant.date() - date(1970, 1, 1)).days
    condition = (F.col(LENGTH) == OPEN) & (F.col(BEGIN) <= day >> FINEST)
    for c in CLASSES:
        bucket = day >> max(c, FINEST)
        condition |= (F.col(LENGTH) == c) & F.col(BEGIN).isin(bucket - 1, bucket)
    return condition
