"""Writing results."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Observation, functions as F

# An export replaces all that its folder held, whatever the session's mode: days or sheets of an earlier, wider export
# must not survive it.
WHOLE_FOLDER = ("partitionOverwriteMode", "static")


def append(df: DataFrame, path: str, *days: str) -> None:
    """Append, stored by the columns named."""
    df.write.mode("append").partitionBy(*days).parquet(path)


def append_if_absent(rows: DataFrame, path: str, keys: list[str], day: str, first: date, last: date) -> int:
    """Append the rows whose keys the table does not hold yet; returns how many. All must be of the days first to last.

    The table must exist. It is stored by `day`, one of the keys, and only these days of it are read. The rows are
    computed once. If some are of other days or have none, the write fails before anything is committed.
    """
    days = F.col(day).between(F.lit(first.isoformat()).cast("date"), F.lit(last.isoformat()).cast("date"))
    target = rows.sparkSession.read.schema(rows.schema).parquet(path).where(days).select(*keys)
    added = Observation("added")
    refused = F.raise_error(F.concat(F.lit(f"a row of another day than {first} to {last}: "), F.coalesce(F.col(day).cast("string"), F.lit("none"))))
    checked = rows.withColumn(day, F.when(F.coalesce(days, F.lit(False)), F.col(day)).otherwise(refused.cast("date")))
    fresh = (checked.join(target, keys, "left_anti").select(*rows.columns)
             .observe(added, F.count(F.lit(1)).alias("rows")))
    fresh.write.mode("append").partitionBy(day).parquet(path)
    return added.get["rows"]


def days_of(rows: DataFrame, day: str) -> tuple[date, date] | None:
    """The first and the last day of rows, None without any."""
    first, last = rows.agg(F.min(day), F.max(day)).first()
    return None if first is None else (first, last)


def export_by_date(df: DataFrame, path: str, time: str = "start_time", date: str = "start_date",
                   fmt: str = "parquet") -> None:
    """Write partitioned by day; what the folder held before is gone. The rebalance merges small files and splits a day that is too large for one task."""
    dated = df.withColumn(date, F.col(time).cast("date")).hint("rebalance", date)
    dated.write.mode("overwrite").option(*WHOLE_FOLDER).partitionBy(date).format(fmt).save(path)


def export_sheets(df: DataFrame, path: str, sheet: str = "system_id", fmt: str = "parquet") -> None:
    """Write partitioned by sheet, the rows of a sheet together; what the folder held before is gone. The empty sheet name is written as `all`."""
    named = df.withColumn("sheet", F.when(F.col(sheet) == "", F.lit("all")).otherwise(F.col(sheet)))
    named.hint("rebalance", "sheet").write.mode("overwrite").option(*WHOLE_FOLDER).partitionBy("sheet").format(fmt).save(path)
