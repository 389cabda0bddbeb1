"""Places in an order of all rows, without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many rows are numbered in one window; more are cut into ranges first.
ONE_WINDOW = 100_000
RANGES, SAMPLED = 64, 6_400


def _ranges(rows: DataFrame, order: list[Column]) -> DataFrame | None:
    """Rows with _key and _range, a number that ascends with the order; None if they are few enough for one window."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    keyed = rows.withColumn("_key", key)
    if rows.limit(ONE_WINDOW + 1).count() <= ONE_WINDOW:
        return keyed.withColumn("_range", F.lit(0))
    sample = keyed.select("_key").orderBy(F.xxhash64("_key")).limit(SAMPLED)
    step = SAMPLED // RANGES
    listed = sample.agg(F.sort_array(F.collect_list("_key")).alias("all"))
    bounds = listed.select(F.filter(F.transform("all", lambda x, i: F.when(i % step == step - 1, x)), lambda x: x.isNotNull()).alias("_bounds"))
    below = F.size(F.filter("_bounds", lambda b: b < F.col("_key")))
    return keyed.join(F.broadcast(bounds)).withColumn("_range", below).drop("_bounds")  # one row of RANGES keys


def cumulated(rows: DataFrame, order: list[Column], weight: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Adds `out`, the sum of a weight over the rows up to each in the ascending order of some columns (negate numbers to descend), of all rows or of each group `by`.

    Of many rows a sample tells the bounds of ranges; sums are taken within a range and moved on by
    those of the ranges before it. The bounds only decide how rows are dealt out, so a group with a third of all rows
    is added up in many tasks. Rows that are equal in the order come in any order.
    """
    by = by or []
    dealt = _ranges(rows, order)
    totals = dealt.groupBy(*by, "_range").agg(F.sum(weight).alias("_sum"))  # RANGES rows a group at most
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*by, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    bases = bases if by else F.broadcast(bases)
    within = F.sum(weight).over(Window.partitionBy(*by, "_range").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_within", within).join(bases, [*by, "_range"]).withColumn(out, F.col("_within") + F.col("_base")).select(*rows.columns, out)


def globally(rows: DataFrame, order: list[Column], out: str, by: list[str] | None = None) -> DataFrame:
    """Adds `out`, each row's place from 1 on in the order of some columns, of all rows or of each group `by`; as cumulated()."""
    return cumulated(rows.withColumn("_one", F.lit(1).cast("long")), order, "_one", out, by).drop("_one")
