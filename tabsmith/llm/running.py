"""Places of rows in one order over everything, where equal rows are counted instead of carried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.operators.slices import SLICE, broadcast_if_small, fit_slicer

#: Copies of one row that are written out at a time.
CHUNK = 4096


def first_places(rows: DataFrame, axis: Column, tie: Column, order: list[Column], copies: str = "copies") -> DataFrame:
    """Add `first`: the place (from 1) of the first copy of each row in `order`.

    `rows` holds every distinct row once, with its number of copies. `axis` (a number, never NULL) must
    lead the order and `tie` (a number) come next: the order is cut into slices along the axis, and a very
    frequent value of it along the tie, so that no task orders everything. Slices are balanced by a
    sketch; places are exact whatever it says. `rows` is read several times: store it first.
    """
    slicer = fit_slicer(rows, axis, tie)
    sliced = slicer.add(rows, axis, tie)
    totals = sliced.groupBy(SLICE).agg(F.sum(copies).alias("_total"))
    # at most one row a slice, whose number is bounded
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    base = broadcast_if_small(totals.select(SLICE, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base")))
    inside = Window.partitionBy(SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.withColumn("_local", F.coalesce(F.sum(copies).over(inside), F.lit(0)))
    return local.join(base, SLICE).withColumn("first", F.col("_base") + F.col("_local") + 1).drop(SLICE, "_base", "_local")


def each_copy(rows: DataFrame, copies: str = "copies", name: str = "copy") -> DataFrame:
    """One row for each copy, numbered from 0 as `name`; many copies are written out by many tasks."""
    few = rows.filter(F.col(copies) <= CHUNK).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1)))
    chunks = rows.filter(F.col(copies) > CHUNK).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / CHUNK)))
    )
    low = F.col("_chunk") * CHUNK
    many = chunks.repartition("_chunk").withColumn(name, F.explode(F.sequence(low, F.least(low + CHUNK, F.col(copies)) - 1)))
    return few.unionByName(many.drop("_chunk")).drop(copies)
