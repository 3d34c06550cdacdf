"""Joins of a large table with a lookup table: broadcast when the lookup is small, spread by measured salts when it is not."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

# A lookup of at most this many rows is broadcast. Lookups are narrow, so this stays well below 100 MB.
BROADCAST_ROWS = 500_000
# Keys that the sketch reports, and keys it tracks while it counts.
REPORTED, TRACKED = 64, 8192
# No key is spread before one task would get this many rows of it.
HOT_ROWS = 200_000
MOST_SALTS = 1024


def fits_broadcast(lookup: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Count no further than the limit, so that the check itself stays cheap. A table of literals needs no job."""
    plan = lookup._jdf.queryExecution().optimizedPlan()
    if plan.getClass().getSimpleName() == "LocalRelation":
        return plan.data().size() <= max_rows
    return lookup.limit(max_rows + 1).count() <= max_rows


# Columns of the model that tell rows apart and are needed anyway; hashing them keeps the others out of the scan.
TELLING = ("park_event_id", "trip_id", "sample_id", "start_time", "time", "last_time_imported", "bike_id")


def row_salt(df: DataFrame, salts: Column | int) -> Column:
    """A salt that depends on the row only, so that a task that runs again gives the same one."""
    telling = [c for c in TELLING if c in df.columns][:2]
    return F.pmod(F.xxhash64(*(telling or df.columns)), F.lit(salts) if isinstance(salts, int) else salts).cast("int")


@dataclass(frozen=True)
class Salts:
    """How many tasks each frequent key is spread over, by the hash of the key; all other keys go to one."""

    by_code: dict[int, int] = field(default_factory=dict)

    def of(self, code: Column) -> Column:
        if not self.by_code:
            return F.lit(1)
        table = F.create_map(*(F.lit(x) for pair in sorted(self.by_code.items()) for x in pair))
        return F.coalesce(F.element_at(table, code), F.lit(1))

    def spread(self, facts: DataFrame, code: Column) -> DataFrame:
        """The large side with a `_salt` for its key."""
        return facts.withColumn("_salt", row_salt(facts, self.of(code)) if self.by_code else F.lit(0))

    def repeat(self, other: DataFrame, code: Column, column: str = "_salt") -> DataFrame:
        """The other side once for every salt that its key has."""
        if not self.by_code:
            return other.withColumn(column, F.lit(0))
        return other.withColumn(column, F.explode(F.sequence(F.lit(0), self.of(code) - 1)))


def measured_salts(facts: DataFrame, code: Column, hot_rows: int = HOT_ROWS) -> Salts:
    """The frequent keys of a table and how far to spread them.

    One pass with a heavy-hitter sketch per task, merged by an aggregate; the driver gets at most REPORTED counts. A key
    that fills less than a fair share of the tasks, or fewer than `hot_rows`, stays whole.
    """
    found = facts.select(code.alias("code")).where("code is not null").agg(
        F.expr(f"approx_top_k(code, {REPORTED}, {TRACKED})").alias("top"), F.count("*").alias("n")).first()
    tasks = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fair = max(hot_rows, -(-(found["n"] or 0) // tasks))
    hot = {r["item"]: min(MOST_SALTS, -(-r["count"] // fair)) for r in found["top"] or () if r["count"] > fair}
    return Salts(hot)


def lookup_join(facts: DataFrame, lookup: DataFrame, on: str | list[str], how: str = "inner",
                max_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join with a table that is cheap to count: broadcast when it fits, else spread.

    A key that holds a large share of the facts never lands in one task.
    """
    if fits_broadcast(lookup, max_rows):
        return facts.join(F.broadcast(lookup), [on] if isinstance(on, str) else list(on), how)
    return spread_join(facts, lookup, on, how, hot_rows)


def spread_join(facts: DataFrame, other: DataFrame, on: str | list[str], how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join with a table of any size, without counting it: frequent keys of the facts go to several tasks.

    Only the rows that such a key meets in the other table are repeated; without frequent keys this is a plain join.
    """
    keys = [on] if isinstance(on, str) else list(on)
    code = F.xxhash64(*keys)
    salts = measured_salts(facts, code, hot_rows)
    if not salts.by_code:
        return facts.join(other, keys, how)
    return salts.spread(facts, code).join(salts.repeat(other, code), [*keys, "_salt"], how).drop("_salt")
