"""The naturally incremental operators as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from kerbline.plans import exports
from kerbline.session import shared_dir

def read_stream(spark: SparkSession, folder: str, schema: T.StructType | str, files: str = "*.parquet",
                files_per_trigger: int = 1000) -> DataFrame:
    """A folder of Parquet files as a stream; `files` selects by name."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", files)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(folder))


def with_event_time(stream: DataFrame, time: str, lateness: str | None) -> DataFrame:
    """The time as an instant; with a lateness, a watermark that lets old buckets go.

    Without one nothing is ever dropped, and the state keeps every bucket: right for a run to the end of the data. With
    one, rows later than that after the newest one seen are dropped; `split_late` tells and keeps which ones.
    """
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    return timed if lateness is None else timed.withWatermark(time, lateness)


def rental_buckets(stream: DataFrame, width: str = "15 minutes", lateness: str | None = None) -> DataFrame:
    """Rentals started and ended per bucket, operator and modality."""
    totals = with_event_time(stream, "time", lateness).groupBy(F.window("time", width), "system_id", "modality").agg(
        F.sum("number_of_trips_started").alias("number_of_trips_started"),
        F.sum("number_of_trips_ended").alias("number_of_trips_ended"))
    return totals.select(F.col("window.start").alias("bucket"), "system_id", "modality",
                         "number_of_trips_started", "number_of_trips_ended")


def parked_buckets(stream: DataFrame, width: str = "15 minutes", lateness: str | None = None) -> DataFrame:
    """Least, most and mean number of parked vehicles per bucket, operator and modality."""
    parked = F.col("number_of_vehicles_parked")
    found = with_event_time(stream, "time", lateness).groupBy(F.window("time", width), "system_id", "modality").agg(
        F.min(parked).alias("min"), F.max(parked).alias("max"), F.avg(parked).alias("avg"))
    return found.select(F.col("window.start").alias("bucket"), "system_id", "modality", "min", "max", "avg")


def filled_rental_buckets(stream: DataFrame, first: datetime, last: datetime, lateness: str, minutes: int = 15) -> DataFrame:
    """Rentals per bucket, operator and modality from `first` to `last`, with zeros for empty buckets: for append mode.

    A bucket comes out once, when the watermark has passed its end; a timer of its group brings out those that nothing
    fell into. A group begins with the first bucket as soon as it is seen. State is what one group still waits for: the
    buckets within the lateness, and where to go on. Rows outside the period only move the watermark.
    """
    width = minutes * 60_000_000
    begin, stop = (_micros(t) // width * width for t in (first, last))
    timed = with_event_time(stream, "time", lateness).where(F.unix_micros("time").between(_micros(first), _micros(last))).select(
        "system_id", "modality", "time", (F.floor(F.unix_micros("time") / width) * width).alias("bucket"), "number_of_trips_started", "number_of_trips_ended")

    def step(key, batches, state):
        at, waiting = begin, {}
        if state.exists:
            at, buckets, started, ended = state.get
            waiting = {b: [s, e] for b, s, e in zip(buckets, started, ended)}
        for batch in batches:
            for b, s, e in zip(batch["bucket"], batch["number_of_trips_started"].fillna(0), batch["number_of_trips_ended"].fillna(0)):
                if b >= at:  # else the bucket is out already
                    total = waiting.setdefault(int(b), [0, 0])
                    total[0] += int(s)
                    total[1] += int(e)
        passed = state.getCurrentWatermarkMs() * 1000
        out = []
        while at <= stop and at + width <= passed:
            out.append((*key, at, *waiting.pop(at, (0, 0))))
            at += width
        state.update((at, list(waiting), [v[0] for v in waiting.values()], [v[1] for v in waiting.values()]))
        if at <= stop:
            state.setTimeoutTimestamp(max((at + width) // 1000, passed // 1000 + 1))
        yield pd.DataFrame(out, columns=["system_id", "modality", "bucket", "number_of_trips_started", "number_of_trips_ended"])

    filled = timed.groupBy("system_id", "modality").applyInPandasWithState(
        step, "system_id string, modality string, bucket long, number_of_trips_started long, number_of_trips_ended long",
        "at long, buckets array<long>, started array<long>, ended array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return filled.withColumn("bucket", F.timestamp_micros("bucket"))


def _micros(value: datetime) -> int:
    return (value - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def distinct_visits(stream: DataFrame, salt: str, lateness: str) -> DataFrame:
    """Each user, day and role of visits once, with state for no longer than the lateness: for append mode.

    With a lateness of a day or more a row comes once; with less it may come again later the same day. `active_users` over
    what was stored gives one row per user and day.
    """
    timed = with_event_time(stream, "visited_at", lateness)
    named = timed.where(F.col("user_id").isNotNull() & (F.col("user_id") != "")).select(
        F.sha1(F.concat("user_id", F.lit(salt))).alias("user_hash"), "role", F.col("visited_at").cast("date").alias("active_on"), "visited_at")
    return named.dropDuplicatesWithinWatermark(["user_hash", "active_on", "role"]).select("user_hash", "role", "active_on")


def active_users(stream: DataFrame, salt: str) -> DataFrame:
    """One row per user and day of visits `user_id, role, visited_at`, as in the batch form: for update mode."""
    return exports.active_users(stream, salt)


def latest_positions(stream: DataFrame) -> DataFrame:
    """Latest detection per vehicle."""
    columns = [c for c in stream.columns if c != "bike_id"]
    newest = F.max_by(F.struct(*columns), F.struct("last_time_imported", "sample_id")).alias("newest")
    return stream.groupBy("bike_id").agg(newest).select("bike_id", "newest.*")


# --- running to the end of what is there ------------------------------------------------------------------------

def _run_batches(stream: DataFrame, mode: str, folder: str, write) -> StreamingQuery:
    query = (stream.writeStream.outputMode(mode).foreachBatch(write)
             .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def run_updates(result: DataFrame, keys: Sequence[str], folder: str | None = None) -> DataFrame:
    """Run a query in update mode over the data at hand; the last version of every row.

    Each batch goes to a folder of its own that a repeated batch overwrites, so results survive a restart.
    """
    spark = result.sparkSession
    folder = folder or shared_dir(spark, "stream")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    _run_batches(result, "update", folder, write)
    schema = T.StructType([*result.schema.fields, T.StructField("batch", T.IntegerType())])
    written = spark.read.schema(schema).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
    values = [c for c in result.columns if c not in keys]
    newest = F.max_by(F.struct(*values), "batch").alias("_values")
    return written.groupBy(*keys).agg(newest).select(*keys, *(F.col(f"_values.{c}").alias(c) for c in values))


def run_appends(result: DataFrame, folder: str | None = None) -> tuple[DataFrame, int]:
    """Run a query in append mode over the data at hand: (its rows, the most rows of state that it held after a batch).

    Each batch goes to a folder of its own that a repeated batch overwrites.
    """
    spark = result.sparkSession
    folder = folder or shared_dir(spark, "stream")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    query = _run_batches(result, "append", folder, write)
    held = max((op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]), default=0)
    rows = spark.read.schema(result.schema).option("recursiveFileLookup", True).parquet(f"{folder}/rows")
    return rows, held


def run_active_users(stream: DataFrame, salt: str, lateness: str, folder: str | None = None, files_per_trigger: int = 1000) -> tuple[DataFrame, DataFrame, int]:
    """(active users of visits in time, visits that came later than the lateness, most rows of state): state stays bounded.

    Late visits are kept aside before the watermark sees the rest, so both together are all visits.
    """
    spark = stream.sparkSession
    folder = folder or shared_dir(spark, "users")
    _, late = split_late(stream, "visited_at", lateness, f"{folder}/parted")
    kept = T.StructType([*stream.schema.fields, T.StructField("late", T.BooleanType())])
    in_time = (spark.readStream.schema(kept).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True)
               .parquet(f"{folder}/parted/rows").where(~F.col("late")).drop("late"))
    rows, held = run_appends(distinct_visits(in_time, salt, lateness), f"{folder}/distinct")
    users = rows.groupBy("user_hash", "active_on").agg(F.min("role").alias("role")).select("user_hash", "role", "active_on")
    return users, late, held


def split_late(stream: DataFrame, time: str, lateness: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """Run over the data at hand and part it: (rows in time, rows later than `lateness` after the newest one before).

    A row counts as late by the newest time of the batches before its own, as a watermark sees it. Both parts are
    stored below `folder`, one folder for each batch that a repeated batch overwrites, together with the newest time so
    far; the count of the second part is what a watermark would have lost.
    """
    spark = stream.sparkSession
    instant = F.col(time).cast("timestamp")

    def write(batch: DataFrame, batch_id: int) -> None:
        # the mark of a batch is the newest time of all batches up to it
        newest = None
        if batch_id > 0:
            newest = spark.read.schema("newest timestamp").parquet(f"{folder}/marks/{batch_id - 1}").first()[0]
        mark = F.lit(newest).cast("timestamp")
        late = F.coalesce(instant < mark - F.expr(f"interval {lateness}"), F.lit(False))
        batch.withColumn("late", late).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")
        batch.agg(F.greatest(F.max(instant), mark).alias("newest")).write.mode("overwrite").parquet(f"{folder}/marks/{batch_id}")

    _run_batches(stream, "append", folder, write)
    schema = T.StructType([*stream.schema.fields, T.StructField("late", T.BooleanType())])
    rows = spark.read.schema(schema).option("basePath", f"{folder}/rows").option("recursiveFileLookup", True).parquet(f"{folder}/rows")
    return rows.where(~F.col("late")).drop("late"), rows.where("late").drop("late")
