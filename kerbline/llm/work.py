"""Shared helpers: written intermediate tables, row keys, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbline.session import shared_dir

WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, purpose: str, by: list[str] | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends, and a lost executor costs only its own tasks."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(row_id: str | Column, text: str | Column) -> tuple[Column, Column]:
    """Two hashes that name a row by its id and whole text; rows equal in both are copies with equal results."""
    i = F.col(row_id) if isinstance(row_id, str) else row_id
    t = F.col(text) if isinstance(text, str) else text
    return (F.xxhash64(i, i.isNull(), t, t.isNull()).alias("_ka"),
            F.xxhash64(F.lit(7), t, t.isNull(), i, i.isNull()).alias("_kb"))


def documents(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_ordinal(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that have a stored `uid` (of monotonically_increasing_id) with `_ord`, their number from 0 among rows equal in `keys`.

    Numbers are given within what one task once wrote, which bounds a group of any size, and moved by the counts of the tasks
    before. Which of equal rows gets which number depends on how rows were dealt; the numbers do not.
    """
    cut = rows.withColumn("_chunk", F.shiftrightunsigned("uid", 33))
    counts = cut.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    moved = counts.select(*keys, "_chunk", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy("uid")) - 1
    return cut.withColumn("_place", place).join(moved, [*keys, "_chunk"]).withColumn("_ord", F.col("_place") + F.col("_before")).select(*rows.columns, "_ord")


def drawn(rows: DataFrame, label: str, order: list[str], most: int) -> DataFrame:
    """At most `most` rows of each label, the first in `order`, whose first column must be a uniform 64-bit hash.

    Labels are few: one count of each reaches the driver. Large labels are thinned by their hash to some four times `most`
    rows before they meet, so no task sees more than that of a label.
    """
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    share = F.lit(None)
    for value, n in counts.items():
        if n > 4 * most:
            share = F.when(F.col(label) == F.lit(value), F.lit((4 * most + 100) / n)).otherwise(share)
    uniform = F.shiftrightunsigned(F.col(order[0]), 11) / float(1 << 53)
    rank = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    return rows.where(F.coalesce(uniform < share, F.lit(True))).withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def nth(rows: DataFrame, column: str, rank: int, few: int = 4_096) -> float:
    """The exact value of a rank (from 1) in the ascending order of a column of finite doubles.

    Values are counted by cells between the least and the largest; the cell with the rank is divided again until it holds
    few values or one. The driver sees counts of cells and at most `few` values.
    """
    value = F.col(column)
    low, high, n = rows.agg(F.min(value), F.max(value), F.count(value)).first()
    below = 0
    while low < high and n > few:
        cell = F.least(F.lit(few - 1), F.floor((value - low) / (high - low) * few))
        cells = (rows.where(value.between(low, high)).groupBy(cell.alias("cell"))
                 .agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n")).orderBy("cell").collect())
        for c in cells:
            if rank <= below + c["n"]:
                break
            below += c["n"]
        low, high, n = c["low"], c["high"], c["n"]
    if low == high:
        return low
    return sorted(r[0] for r in rows.where(value.between(low, high)).select(value).collect())[rank - below - 1]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by randomised contraction: (node long, root long), one row per node that has an edge.

    In each round every node joins the neighbour (or itself) that comes first in an order drawn anew for the round, and
    edges are rewritten to the joined nodes. The expected number of nodes shrinks by a constant factor whatever the
    shape, so long chains and huge stars take a logarithmic number of rounds. The only values that reach the driver are
    edge counts. `root` is some node of the component, not the smallest. Null and looping edges are ignored.
    """
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    e = stored(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    salt = 0
    while not e.isEmpty():
        salt += 1
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        drawn = lambda c: F.struct(F.xxhash64(F.lit(salt), F.col(c)).alias("h"), F.col(c).alias("n"))
        first = both.groupBy("a").agg(F.min(drawn("b")).alias("m"))
        step = stored(first.select(F.col("a").alias("node"), F.least(drawn("a"), "m")["n"].alias("to")), "step")
        steps.append(step)
        e = (e.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
             .join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
             .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        e = stored(e, "edges")
    if not steps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[-1].select("node", F.col("to").alias("root"))
    for step in reversed(steps[:-1]):
        # nodes of a later round are targets of this one; a target without a later row is a root already
        out = (step.join(out.select(F.col("node").alias("to"), F.col("root").alias("later")), "to", "left")
               .select("node", F.coalesce("later", "to").alias("root")))
    return out
