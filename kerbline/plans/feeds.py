"""Data feeds of operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from kerbline.functions.calendar import moment

ALIVE_MINUTES = 5
# A page of the JSON export holds the feeds of one run of this many ids, so no page grows without bound.
PAGE_IDS = 1000


def active_feeds(feeds: DataFrame, now: datetime) -> DataFrame:
    """Active feeds that import vehicles; `up` when imported within the last five minutes."""
    last = F.col("last_time_succesfully_imported")
    limit = moment(now) - F.expr(f"interval {ALIVE_MINUTES} minutes")
    return feeds.where(F.col("is_active") & F.col("import_vehicles")).select(
        "feed_id", "system_id", "feed_type", "last_time_succesfully_imported",
        (last.isNotNull() & (last > limit)).alias("up"))


def feed_pages(feeds: DataFrame, now: datetime, page_ids: int = PAGE_IDS) -> DataFrame:
    """The active feeds as JSON arrays ordered by id, one per page of ids; without active feeds one page `[]`."""
    rows = active_feeds(feeds, now)
    page = F.floor(F.col("feed_id") / F.lit(page_ids)).alias("page")
    feeds_of_page = F.sort_array(F.collect_list(F.struct(*rows.columns)))
    pages = rows.groupBy(page).agg(F.to_json(feeds_of_page).alias("feeds"))
    empty = feeds.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("page"), F.lit("[]").alias("feeds"))
    none = empty.where(rows.agg(F.count("*")).scalar() == 0)
    return pages.unionByName(none).orderBy("page")
