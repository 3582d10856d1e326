"""Ordered computation without one big sort group.

Spark rows have no order and a window without a key is a single task, as is a window whose key
holds a third of the table. The helpers here cut an ordered axis into slices of about equal row
count at cut points taken from a quantile sketch. A row's slice depends only on its value, so
slices are stable under retries and need no stored partition ids. Work runs per (key, slice);
what carries over from earlier slices comes from a small (key, slice) table. The sketch only
balances the slices: results are exact whatever its error.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.scalars import order_axis

FIRST_SLICES = 1024
MAX_SLICES = 16_384
ROWS_PER_SLICE = 500_000
MIN_SLICES = 8
SKETCH_SHARE = 0.02
SLICE = "_slice"


@dataclass
class Slicer:
    """Cut points on the main axis, plus cuts on a tie-break axis for very frequent values."""

    cuts: list[float]
    heavy: list[float] = field(default_factory=list)
    tie_cuts: list[float] = field(default_factory=list)

    @property
    def width(self) -> int:
        return len(self.tie_cuts) + 1 if self.heavy else 1

    def add(self, df: DataFrame, axis: Column, tie: Column | None = None) -> DataFrame:
        """Add the slice number; rows without `axis` form the first slice, -1."""
        out = _cut(df.withColumn("_axis", axis), "_axis", self.cuts, SLICE)
        if self.heavy and tie is not None:
            out = _cut(out.withColumn("_tie", tie), "_tie", self.tie_cuts, "_sub")
            sub = F.when(F.col("_axis").isin(self.heavy), F.col("_sub")).otherwise(F.lit(0))
            out = out.withColumn(SLICE, F.col(SLICE) * self.width + sub).drop("_tie", "_sub")
        return out.withColumn(SLICE, F.when(F.col("_axis").isNull(), F.lit(-1)).otherwise(F.col(SLICE))).drop("_axis")


def cut_index(name: str, cuts: list, base: int = 0) -> str:
    """SQL text: number of cut points at or below a column, as a balanced CASE (binary search).

    One text instead of many column calls keeps plan building fast.
    """
    if not cuts:
        return str(base)
    mid = len(cuts) // 2
    cut = f"{cuts[mid]!r}D" if isinstance(cuts[mid], float) else f"{cuts[mid]}L"
    low = cut_index(name, cuts[:mid], base)
    high = cut_index(name, cuts[mid + 1 :], base + mid + 1)
    return f"CASE WHEN {name} < {cut} THEN {low} ELSE {high} END"


def _cut(df: DataFrame, name: str, cuts: list[float], out: str) -> DataFrame:
    """Number of cut points at or below the value: binary search, compiled for short lists."""
    if len(cuts) <= 64:
        return df.withColumn(out, F.expr(f"cast({cut_index(name, cuts)} as int)"))
    splits = [-math.inf, *cuts, math.inf]
    cutter = Bucketizer(splits=splits, inputCol=name, outputCol="_cut", handleInvalid="keep")
    return cutter.transform(df).withColumn(out, F.col("_cut").cast("int")).drop("_cut")


def _sketch(name: str, parts: int) -> Column:
    """Approximate quantiles at i/parts; as one SQL text, since a long literal list is slow to build."""
    fractions = ", ".join(str(i / parts) for i in range(1, parts))
    return F.expr(f"percentile_approx({name}, array({fractions}), {4 * parts})")


def _draw(df: DataFrame, axis: Column, tie: Column | None, parts: int, share: float):
    drawn = F.rand(11) < share
    cols = [axis.alias("_a"), F.when(drawn, axis).alias("_d")]
    wanted = [F.count("_a").alias("n"), _sketch("_d", parts).alias("q")]
    if tie is not None:
        cols.append(F.when(drawn, tie).alias("_t"))
        wanted.append(_sketch("_t", 64).alias("t"))
    return df.select(*cols).agg(*wanted).first()


def fit_slicer(
    df: DataFrame, axis: Column, tie: Column | None = None, least: int = MIN_SLICES
) -> Slicer:
    """One aggregate over a thin random sample of the axis plus an exact row count.

    Only cut points (at most MAX_SLICES) reach the driver. Sampling affects how even the slices
    are, never a result. A table too large for FIRST_SLICES is sketched again, more finely.
    """
    row = _draw(df, axis, tie, FIRST_SLICES, SKETCH_SHARE)
    if not row["q"]:
        return Slicer([])
    slices = min(MAX_SLICES, max(least, row["n"] // ROWS_PER_SLICE))
    parts = FIRST_SLICES
    if slices > FIRST_SLICES:
        parts = slices
        row = _draw(df, axis, tie, parts, min(SKETCH_SHARE, 2_000 * parts / row["n"]))
    step = parts / slices
    picked = [row["q"][min(len(row["q"]) - 1, int(step * i) - 1)] for i in range(1, slices)]
    heavy = sorted({a for a, b in zip(picked, picked[1:]) if a == b})
    cuts = set(picked)
    for v in heavy:
        cuts.add(math.nextafter(v, math.inf))
    ties = sorted(set(row["t"] or [])) if tie is not None and heavy else []
    return Slicer(sorted(cuts), heavy if ties else [], ties)


BROADCAST_ROWS = 20_000


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Evaluate a summary table once when it has at most `limit` rows and mark it for broadcast.

    Beyond the limit the frame is returned as it is and the join shuffles.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def _matching(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    return cond


def join_null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match; the keys of `a` are kept."""
    extra = [c for c in b.columns if c not in keys]
    return (
        a.alias("a")
        .join(b.alias("b"), _matching(a, b, keys), how)
        .select("a.*", *[F.col(f"b.`{c}`") for c in extra])
    )


def running_offsets(sliced: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows of a key in earlier slices, per (key, slice)."""
    w = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    counted = sliced.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(w), F.lit(0))
    return broadcast_if_small(counted.select(*keys, SLICE, before.alias(name)))


def with_position(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    name: str = "rn",
    base: DataFrame | None = None,
) -> DataFrame:
    """Row number (from 1) per key in the given order, exact, with no single-task key.

    The order columns must identify a row within its key. The first must be a number, date or
    timestamp; rows without it come first, as in a window. `base` is a cheaper frame with the same
    rows of those columns, for the slice counts.
    """
    if not order:
        raise ValueError("an explicit order is required")
    axis = order_axis(df, order[0])
    tie = None
    if len(order) > 1:
        try:
            tie = order_axis(df, order[1])
        except TypeError:
            tie = None
    plain = df if base is None else base
    slicer = fit_slicer(plain, axis, tie)
    sliced = slicer.add(df, axis, tie)
    by = [*keys, SLICE]
    local = F.row_number().over(Window.partitionBy(*by).orderBy(*[F.col(f"`{o}`") for o in order]))
    offsets = running_offsets(slicer.add(plain, axis, tie), keys, "_before")
    numbered = sliced.withColumn("_local", local)
    joined = join_null_safe(numbered, offsets, by)
    return joined.withColumn(name, (F.col("_local") + F.col("_before")).cast("long")).drop(
        SLICE, "_local", "_before"
    )


def with_history(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    reach: int,
    build: Callable[[object], dict[str, Column]],
    chunk: int = 100_000,
    position: str = "rn",
) -> DataFrame:
    """Window columns that look back at most `reach` rows, on keys of any size.

    Each key is cut into chunks of consecutive rows; the last `reach` rows of a chunk are copied
    into the next as a halo, so every frame is complete within its chunk. `build` receives the
    ordered window and returns the columns to add.
    """
    chunk = max(chunk, reach + 1)
    # A frame that already carries the position is not numbered again.
    placed = df if position in df.columns else with_position(df, keys, order, position)
    at = F.col(position) - 1
    home = F.floor(at / chunk).cast("long")
    lent = F.when(at % chunk >= chunk - reach, F.array(home, home + 1)).otherwise(F.array(home))
    spread = placed.withColumn("_home", home).withColumn("_chunk", F.explode(lent))
    w = Window.partitionBy(*keys, "_chunk").orderBy(position)
    return (
        spread.withColumns(build(w))
        .where(F.col("_home") == F.col("_chunk"))
        .drop("_home", "_chunk")
    )
