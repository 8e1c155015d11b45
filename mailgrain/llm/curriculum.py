"""Mixing sources to target weights with a time-varying curriculum (DataFrame functions only).

Every source has a weight schedule over training time 0 to 1, given as knots of
a piecewise linear curve.  Its integral is the source's weight and decides how
many words the source gives; inverting the integral tells when each of its words
is due, so every copy of a document gets a training position, by which the
documents are range-sorted.

Documents of a source are taken in the order of a hash.  The running sum that
this needs is made of sums over ranges of that hash and sums within one
range, so that a source with a third of all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailgrain.llm.ordering import spread_order

# Integrals 5, 2 and 1: early, steady and late sources in turn.
SCHEDULES = (((0.0, 7.5), (1.0, 2.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)))
MOST_REPEATS = 3
ROWS_PER_RANGE = 2048


def area(knots) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))


def pieces(knots) -> Column:
    """The normalised integral of a schedule, as an array of its linear pieces."""
    total, done, out = area(knots), 0.0, []
    for (t, w), (t2, w2) in zip(knots, knots[1:]):
        slope = (w2 - w) / (t2 - t)
        out.append(F.struct(*(F.lit(float(v)).alias(n) for n, v in (
            ("u", done / total), ("t", t), ("w", w), ("slope", slope), ("total", total)))))
        done += (t2 - t) * (w + w2) / 2
    return F.array(*out)


def due(share: Column, schedule: Column) -> Column:
    """The time at which that share of a source's words is used up: the inverse integral."""
    piece = F.element_at(F.filter(schedule, lambda p: p["u"] <= share), -1)
    rest = (share - piece["u"]) * piece["total"]
    root = F.sqrt(F.greatest(piece["w"] * piece["w"] + 2 * piece["slope"] * rest, F.lit(0.0)))
    return piece["t"] + F.coalesce(F.try_divide(2 * rest, piece["w"] + root), F.lit(0.0))


def targets(sources: DataFrame, schedules, most: int) -> DataFrame:
    """Adds target and schedule to rows of (source, source_size).

    Sources by code point, null last, take the schedules in turn.  Targets share
    the sum of sizes by weight, stop at ``most`` times the size, and the excess
    is shared again: with sources in the order of size over weight, the first
    ones stop, and the rest share what those leave.
    """
    turn = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(schedules)
    weight, plan = F.lit(None).cast("double"), F.lit(None)
    for i, knots in enumerate(schedules):
        weight = F.when(turn == i, F.lit(float(area(knots)))).otherwise(weight)
        plan = F.when(turn == i, pieces(knots)).otherwise(plan)
    rows = sources.withColumns({"weight": weight, "schedule": plan, "most": F.col("source_size") * most})
    before = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(
        F.sum("most").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shared = F.sum("weight").over(before.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", left / shared)
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(everything)
    return rows.withColumn(
        "target", F.least(F.col("most").cast("double"), level * F.col("weight"))
    ).select("source", "source_size", "target", "schedule")


def mix(
    docs: DataFrame, size_col: str = "size", id_col: str = "doc_id", source_col: str = "source",
    schedules=SCHEDULES, most: int = MOST_REPEATS, rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """All rows and columns plus source_size, target, copies, taken and positions.

    A document is taken whole, ``copies`` times (0 to ``most``), so that the words
    its source gives differ from the target by less than a document's size.
    ``positions`` has the training time of each copy.

    A null size counts as 0; rows without source are a source of their own.  Rows
    that repeat an id are taken one after the other (equal rows are
    interchangeable), rows without id in the order of a hash of their other columns;
    rows of a source without any word are taken once.  A column of docs that has
    the name of an added one is replaced.  An empty table gives no rows.
    """
    hidden = {n: f"_mix_{n}" for n in ("order", "range", "key", "missing", "before", "within")}
    order, range_, key, missing, before, within = hidden.values()
    ranges = max(1, -(-docs.count() // rows_per_range))
    own = docs.drop("source_size", "target", "copies", "taken", "positions")
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    rows = own.withColumns({
        order: spread_order(own, id_col),
        key: F.coalesce(F.col(source_col), F.lit("")), missing: F.col(source_col).isNull(),
    }).withColumn(range_, F.floor(
        F.conv(F.substring(order, 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("long"))
    sums = rows.groupBy(key, missing, range_).agg(F.sum(size).alias("n"))
    sources = targets(
        sums.groupBy(key, missing).agg(F.sum("n").alias("source_size")).withColumn(
            "source", F.when(~F.col(missing), F.col(key))), schedules, most)
    sources = sources.select(
        F.coalesce("source", F.lit("")).alias(key), F.col("source").isNull().alias(missing),
        "source_size", "target", "schedule")
    earlier = Window.partitionBy(key, missing).orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(before, F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n").join(
        sources, [key, missing])
    inside = Window.partitionBy(key, missing, range_).orderBy(order, id_col, size).rowsBetween(
        Window.unboundedPreceding, -1)
    middle = F.col(before) + F.col(within) + size / 2
    copies = F.floor(F.try_divide(F.col("target") - middle, F.col("source_size"))).cast("int") + 1
    return (
        rows.withColumn(within, F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .join(sums, [key, missing, range_])
        .withColumn("copies", F.greatest(F.coalesce(copies, F.lit(1)), F.lit(0)))
        .withColumn("taken", F.col("copies") * size)
        .withColumn("positions", F.when(F.col("copies") > 0, F.transform(
            F.sequence(F.lit(0), F.col("copies") - 1),
            lambda j: due(F.coalesce(F.try_divide(j * F.col("source_size") + middle, F.col("target")), F.lit(0.0)),
                          F.col("schedule")))).otherwise(F.array().cast("array<double>")))
        .drop(*hidden.values(), "schedule"))


def training_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per copy, range-sorted by training position (column position)."""
    return mixed.withColumn("position", F.explode("positions")).drop("positions").orderBy("position", id_col)
