"""Filling the gaps of a bucketed series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def gap_fill(series: DataFrame, keys: Sequence[str], bucket: str, first: Column, last: Column, step: Column,
             fill: Mapping[str, Column | None]) -> DataFrame:
    """For every group found, one row per bucket from `first` to `last`.

    `series` is already aggregated: at most one row per group and bucket, all between the bounds. Each row also
    produces the empty buckets up to its successor, and the first row of a group those before it. So the series
    is computed once, and no grid of groups and buckets is joined. `fill` names the measures and what an empty
    bucket gets; None stands for NULL. A group has at most as many rows as there are buckets.
    """
    order = Window.partitionBy(*keys).orderBy(bucket)
    begin = F.when(F.lag(bucket).over(order).isNull(), first).otherwise(F.col(bucket))
    end = F.coalesce(F.lead(bucket).over(order) - step, last)
    spread = (series.withColumn("_begin", begin).withColumn("_end", end)
              .withColumn("_bucket", F.explode(F.sequence("_begin", "_end", step))))
    same = F.col("_bucket") == F.col(bucket)
    measures = []
    for name, empty in fill.items():
        value = F.when(same, F.col(name))
        measures.append((value if empty is None else F.coalesce(value, empty)).alias(name))
    return spread.select(*keys, F.col("_bucket").alias(bucket), *measures)
