"""Per-key order without one task per key."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from kerbline.operators.lookup import BROADCAST_ROWS, fits_broadcast
from kerbline.session import shared_dir


def with_previous(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], slice_of: Column,
                  prefix: str = "previous_") -> DataFrame:
    """`lag(columns)` over `partition by key order by order`, for keys of any size.

    `slice_of` cuts the timeline (it must not decrease along `order`). Within a slice the previous row is found
    directly. Only the first and the last row of each slice meet again per key, so the largest group that one
    task ever sorts is one slice, or two rows per slice.
    """
    sliced = df.withColumn("_slice", slice_of)
    inner = Window.partitionBy(key, "_slice").orderBy(*order)
    outer = Window.partitionBy(key).orderBy("_slice", *order)
    payload = F.struct(*columns)
    rows = (sliced.withColumn("_previous", F.lag(payload).over(inner))
            .withColumn("_is_first", F.row_number().over(inner) == 1)
            .withColumn("_is_last", F.lead(F.lit(1)).over(inner).isNull()))
    edge = F.col("_is_first") | F.col("_is_last")
    middle = rows.where(~edge)
    edges = (rows.where(edge).withColumn("_across", F.lag(payload).over(outer))
             .withColumn("_previous", F.when(F.col("_is_first"), F.col("_across")).otherwise(F.col("_previous")))
             .drop("_across"))
    joined = middle.unionByName(edges)
    return joined.select(*df.columns, *(F.col(f"_previous.{c}").alias(f"{prefix}{c}") for c in columns))


# Numbers of up to 64 bits, moved up so that none is negative, in the lower digits of one decimal.
_DIGITS, _UP = 19, 1 << 62


def latest(df: DataFrame, key: str, time: str, number: str, rows: DataFrame | None = None, max_keys: int = BROADCAST_ROWS) -> DataFrame:
    """The last row per key by time, the higher number where two share it; number and time tell rows of a key apart.

    Both make one decimal, whose maximum is kept in a hash table, without a sort, and stored. The rows are then fetched from
    `rows`, a table that holds those of `df` and is cheaper to read, as long as the maxima fit a broadcast; beyond that,
    whole rows are compared in one pass, so that the table is not shuffled. A null key is a key of its own; a null time
    comes first.
    """
    micros = F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(-_UP))
    order = (micros.cast("decimal(38,0)") * F.lit(Decimal(10**_DIGITS)) + F.coalesce(F.col(number), F.lit(-_UP)).cast("decimal(20,0)") + F.lit(_UP)).cast("decimal(38,0)")
    path = shared_dir(df.sparkSession, "newest")
    newest = df.groupBy(F.col(key).alias("_key")).agg(F.max(order).alias("_newest"))
    newest.write.parquet(path)
    newest = df.sparkSession.read.schema(newest.schema).parquet(path)
    if fits_broadcast(newest, max_keys):
        same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_order") == F.col("_newest"))
        # repeated rows are one
        return (df if rows is None else rows).withColumn("_order", order).join(F.broadcast(newest), same, "left_semi").select(*df.columns).distinct()
    whole = F.max_by(F.struct(*df.columns), F.struct(time, number)).alias("_row")
    return df.groupBy(F.col(key).alias("_key")).agg(whole).select("_row.*")
