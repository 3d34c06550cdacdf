"""Mixing sources to target weights by pivotal dependent rounding.

A source of S words with target T gives each of its rows T/S copies: a whole number, the same for all, and a fraction. The
fractions are rounded so that the source's words stay at its target: two rows with fractions trade mass (words, that is
fraction times size) at random until one of them is 0 or 1; the other carries on. Groups of about BUCKET rows trade
first, each leaves at most one row undecided, and the rest meet in groups of a higher level, in a tree that gets BUCKET
times narrower with every level. At the root at most one row of a source is undecided and is rounded by its fraction, so a
source misses its target by less than one row. Each row is taken with the probability of its fraction.

Random numbers are hashes of the row, so a rerun takes the same rows. Everything is built-in expressions: a trade is a
step of `aggregate` over a group's array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.work import WORD, stored, with_ordinal

BUCKET = 32  # rows that meet in one group on average


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[int], share: float, limit: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): share of the total by weight, at most `limit` times the size.

    Weights repeat over the sources in order of code point, null last. What a source cannot take goes to the others by
    weight, until none is above: sources fill up in order of size per weight, so sorting finds the level at once. There
    is one row a source; sources are few beside rows.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    nth = F.row_number().over(by_name) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (nth % len(weights) + 1).cast("int"))
    all_rows = Window.partitionBy(F.lit(1))
    full_first = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    t = sizes.withColumn("w", w).withColumn("goal", F.sum("source_size").over(all_rows) * share)
    before = full_first.rowsBetween(Window.unboundedPreceding, -1)
    after = full_first.rowsBetween(0, Window.unboundedFollowing)
    # the level if all before this one are full and the others share by weight
    level = (F.col("goal") - limit * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(after)
    t = t.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= limit * F.col("source_size"))
    t = t.withColumn("place", F.row_number().over(full_first))
    t = t.withColumn("held", F.min(F.when(F.col("open"), F.struct("place", "level"))).over(all_rows)["level"])
    target = F.least(limit * F.col("source_size"), F.coalesce(F.col("held") * F.col("w"), limit * F.col("source_size")))
    return t.select(*sizes.columns, target.cast("double").alias("target"))


def _uniform(salt: int, *parts: Column) -> Column:
    """0 (included) to 1 (excluded), the same for the same parts."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), *parts), 11).cast("double") / float(1 << 53)


DONE = "array<struct<ka:long,kb:long,extra:int>>"


def _trade(level: int):
    """How the undecided row `a` of a group so far and its next row `b` trade; afterwards one of them is decided."""

    def move(x: Column) -> Column:
        a, b = x["a"], x["b"]
        up = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])  # words that b can hand to a
        down = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])
        words = F.when(_uniform(level + 1, a["ka"], b["ka"]) * (up + down) < down, up).otherwise(-down)
        return F.struct(a.alias("a"), b.alias("b"), (a["p"] + words / a["size"]).alias("pa"), (b["p"] - words / b["size"]).alias("pb"))

    def settle(x: Column) -> Column:
        first = F.least(x["pa"], 1 - x["pa"]) <= F.least(x["pb"], 1 - x["pb"])  # the one at its end, within rounding
        rest = lambda r, p: F.struct(r["draw"].alias("draw"), r["ka"].alias("ka"), r["kb"].alias("kb"), r["size"].alias("size"),
                                     F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)).alias("p"))
        done = lambda r, p: F.struct(r["ka"].alias("ka"), r["kb"].alias("kb"), (p > 0.5).cast("int").alias("extra"))
        return F.struct(F.when(first, rest(x["b"], x["pb"])).otherwise(rest(x["a"], x["pa"])).alias("open"),
                        F.when(first, done(x["a"], x["pa"])).otherwise(done(x["b"], x["pb"])).alias("done"))

    return move, settle


def _round_group(items: Column, level: int) -> Column:
    """(open: the row that is still undecided, done: the decisions) of a group."""
    move, settle = _trade(level)
    start = F.struct(F.element_at(items, 1).alias("open"), F.array().cast(DONE).alias("done"))

    def step(state: Column, b: Column) -> Column:
        # transforms of one-element arrays, so that every value is worked out once
        traded = F.transform(F.transform(F.array(F.struct(state["open"].alias("a"), b.alias("b"))), move), settle)
        return F.element_at(F.transform(traded, lambda t: F.struct(
            t["open"].alias("open"), F.concat(state["done"], F.array(t["done"])).alias("done"))), 1)

    return F.aggregate(F.slice(items, F.lit(2), F.size(items)), start, step)


def round_fractions(rows: DataFrame, levels: int) -> DataFrame:
    """(ka, kb, extra) for rows (source, draw, ka, kb, size > 0, 0 < p < 1, groups): 1 with probability p, else 0.

    `ka` draws, `kb` names the row.
    """
    decided = []
    for level in range(levels):
        width = F.greatest(F.lit(1.0), F.col("groups") / float(BUCKET) ** level).cast("long")
        groups = (rows.groupBy("source", F.pmod("draw", width).alias("group"), "groups")
                  .agg(F.sort_array(F.collect_list(F.struct("draw", "ka", "kb", "size", "p"))).alias("items")))
        solved = stored(groups.select("source", "groups", _round_group(F.col("items"), level).alias("r")), f"mix-{level}")
        decided.append(solved.select(F.explode("r.done").alias("d")).select("d.*"))
        rows = solved.select("source", "groups", "r.open.*")
    out = rows.select("ka", "kb", (_uniform(99, F.col("ka")) < F.col("p")).cast("int").alias("extra"))
    for part in decided:
        out = out.unionByName(part)
    return out


def mixture(docs: DataFrame, row_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2),
            share: float = 1.5, limit: float = 2.0, carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` (default: the id) with size, source_size, target and copies: how often the mix takes the row.

    Sizes are words; a null text has none. Copies are whole and at most `limit`. Rows without words weigh nothing and are
    taken as often as the whole part of their source's rate. A null source is a source. Rows equal in id, text and source
    are rounded one by one, like any others. Empty tables give no rows. `carry` may hold any columns of `docs`, except ones called like
    those that are added.
    """
    names = [row_id] if carry is None else carry
    parts = [F.col(row_id), F.col(row_id).isNull(), F.col(text), F.col(text).isNull(), F.col(source), F.col(source).isNull()]
    sized = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.monotonically_increasing_id().alias("uid"),
                               F.xxhash64(*parts).alias("ka"), F.xxhash64(F.lit(7), *parts).alias("kb"), F.col(source).alias("source"),
                               words(F.col(text)).alias("size")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("units"))
    goal = targets(sources, list(weights), share, limit)
    # one row a source; Spark broadcasts it while it is small
    rated = stored(goal.select(F.col("source").alias("s2"), "source_size", "target", (F.col("units") / BUCKET).alias("groups"), F.when(
        F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate")), "targets")
    most = (rated.agg(F.max("groups")).first()[0] or 0) * BUCKET
    levels = 1
    while BUCKET**levels < most:
        levels += 1
    fraction = F.col("rate") - F.floor("rate")
    # copies of a row draw by their number among them
    units = with_ordinal(sized.select("uid", "ka", "kb", "source", "size").where("size > 0"), ["ka", "kb"])
    draws = F.when(F.col("_ord") == 0, F.col("ka")).otherwise(F.xxhash64("ka", "_ord"))
    known = units.withColumn("ka", draws).join(rated, F.col("source").eqNullSafe(F.col("s2"))).where(fraction > 0)
    loose = known.select("source", F.shiftrightunsigned("ka", 1).alias("draw"), "ka", F.col("uid").alias("kb"), F.col("size").cast("double").alias("size"),
                         fraction.alias("p"), "groups")
    extra = round_fractions(loose, levels)
    out = sized.join(extra.select(F.col("kb").alias("uid"), "extra"), "uid", "left").join(rated, F.col("source").eqNullSafe(F.col("s2")))
    copies = F.floor("rate").cast("int") + F.coalesce("extra", F.lit(0))
    return out.select("_row.*", "size", F.col("source_size").cast("long"), "target", copies.alias("copies"))
