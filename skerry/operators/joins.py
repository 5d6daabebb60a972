"""Joins that Spark lacks: as-of and range, as unions, windows and equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of both sides for each span of time that an as-of join is cut into.
SPAN_ROWS = 4_000_000


def _spans(both: DataFrame, spans: int) -> Column:
    """The span of time of a row, from 0: cuts at approximate quantiles of all times."""
    if spans < 2:
        return F.lit(0)
    cuts = both.select(F.unix_micros(F.col("__at").cast("timestamp")).cast("double").alias("t")).approxQuantile("t", [i / spans for i in range(1, spans)], 0.25 / spans)
    at = F.unix_micros(F.col("__at").cast("timestamp")).cast("double")
    return F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= at)) if cuts else F.lit(0)


def as_of(left: DataFrame, right: DataFrame, left_on: str, right_on: str, left_by: str, right_by: str, order: str | None = None, spans: int | None = None) -> DataFrame:
    """Each left row with the last right row of its key at or before its time (nulls if there is none).

    Both sides are one stream sorted by (key, time): the last right row seen is carried along, so a key with
    many rows on both sides makes no pairs.  Time is cut into spans (one for each SPAN_ROWS rows unless given), so that
    a key of a third of all rows is as many pieces of work; the last right row of a key's earlier spans is
    carried over, from one row a key and span.  order breaks ties of the right side, the greatest last.
    A null key matches other null keys; a null time comes before all others.
    """
    there = right.select(F.col(right_by).alias("__key"), F.col(right_on).alias("__at"), F.lit(0).alias("__side"), F.struct(*[F.col(c) for c in right.columns]).alias("__right"))
    here = left.select(F.col(left_by).alias("__key"), F.col(left_on).alias("__at"), F.lit(1).alias("__side"), F.struct(*[F.col(c) for c in left.columns]).alias("__left"))
    both = there.unionByName(here, allowMissingColumns=True)
    spans = 1 + (left.count() + right.count()) // SPAN_ROWS if spans is None else spans
    keys = ["__at", "__side"] + ([F.col("__right")[order]] if order else [])
    seen = lambda *by: Window.partitionBy(*by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    if spans == 1:
        carried = both.withColumn("__last", F.last("__right", ignorenulls=True).over(seen("__key")))
    else:
        both = both.withColumn("__span", _spans(both, spans))
        rank = F.struct(F.col("__at"), *([F.col("__right")[order]] if order else []))
        # one row a key and span; a span without right rows hands on what came to it
        asked = both.groupBy("__key", "__span").agg(F.max_by("__right", F.when(F.col("__side") == 0, rank)).alias("__end"))
        before = F.last("__end", ignorenulls=True).over(Window.partitionBy("__key").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1))
        handed = asked.select(F.col("__key").alias("__k"), F.col("__span").alias("__s"), before.alias("__before"))
        inside = both.withColumn("__last", F.last("__right", ignorenulls=True).over(seen("__key", "__span"))).filter("__side = 1")
        carried = inside.join(handed, F.col("__key").eqNullSafe(F.col("__k")) & (F.col("__span") == F.col("__s")), "left").withColumn("__last", F.coalesce("__last", "__before"))
    carried = carried.filter("__side = 1")
    return carried.select("__left.*", *[F.col("__last")[c].alias(c) for c in right.columns if c not in left.columns])


def within(left: DataFrame, right: DataFrame, low: str, high: str, at: str, width: int, left_by: str | None = None, right_by: str | None = None) -> DataFrame:
    """Pairs with low <= at < high (times): intervals go to the cells of `width` seconds they touch, rows to their own cell, cells are joined."""
    cell = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (width * 1_000_000))
    spread = left.withColumn("__cell", F.explode(F.sequence(cell(low), cell(high))))
    placed = right.withColumn("__cell", cell(at))
    on = [spread["__cell"] == placed["__cell"]] + ([spread[left_by] == placed[right_by]] if left_by else [])
    return spread.join(placed, on).filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__cell")
