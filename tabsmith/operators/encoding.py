"""Categorical codes, dummy columns and bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.scalars import number, present
from tabsmith.operators.order_stats import quantile_values
from tabsmith.operators.slices import SLICE, broadcast_if_small, fit_slicer, order_axis, running_offsets

MAX_LEVELS = 100


def label_map(df: DataFrame, column: str, order: str) -> DataFrame:
    """(value, code) with codes 0, 1, 2... by first appearance along `order` (a unique key).

    The level table is numbered in slices of the first-seen key, so a column with very many
    levels does not meet in one task.
    """
    levels = (
        df.where(present(df, column).isNotNull())
        .groupBy(F.col(f"`{column}`").alias("value"))
        .agg(F.min(order).alias("_first"))
    )
    axis = order_axis(levels, "_first")
    slicer = fit_slicer(df.select(F.col(f"`{order}`").alias("_first")), axis)
    sliced = slicer.add(levels, axis)
    local = F.row_number().over(Window.partitionBy(SLICE).orderBy("_first"))
    offsets = running_offsets(sliced, [], "_before")
    return (
        sliced.withColumn("_local", local)
        .join(offsets, SLICE)
        .select("value", (F.col("_local") + F.col("_before") - 1).cast("long").alias("code"))
    )


def label_encode(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Replace levels by first-appearance codes; blanks stay NULL."""
    out = df
    for c in columns:
        codes = label_map(df, c, order).withColumnRenamed("value", "_lv").withColumnRenamed("code", "_lc")
        out = (
            out.join(broadcast_if_small(codes), F.col(f"`{c}`") == F.col("_lv"), "left")
            .drop("_lv", c)
            .withColumnRenamed("_lc", c)
        )
    return out.select(*df.columns)


def levels_of(df: DataFrame, column: str, max_levels: int = MAX_LEVELS) -> list[str] | None:
    """Sorted levels, or None when there are more than `max_levels`."""
    rows = (
        df.where(present(df, column).isNotNull())
        .select(F.col(f"`{column}`").cast("string").alias("v"))
        .distinct()
        .limit(max_levels + 1)
        .collect()
    )
    if len(rows) > max_levels:
        return None
    return sorted(r["v"] for r in rows)


def one_hot(df: DataFrame, columns: list[str], max_levels: int | None = None) -> DataFrame:
    """Dummy columns `<column>_<level>`, all levels kept.

    A limit given on purpose leaves wider columns as they are. Without one, more than MAX_LEVELS levels
    are an error: so many dummy columns need a limit of their own, or label codes.
    """
    new = {}
    replaced = []
    for c in columns:
        levels = levels_of(df, c, max_levels or MAX_LEVELS)
        if levels is None and max_levels is None:
            raise ValueError(f"column {c!r} has more than {MAX_LEVELS} levels")
        if levels is None:
            continue
        replaced.append(c)
        for v in levels:
            hit = F.col(f"`{c}`").cast("string") == F.lit(v)
            new[f"{c}_{v}"] = F.coalesce(hit, F.lit(False)).cast("int")
    return df.withColumns(new).drop(*replaced)


def case_chain(x: Column, cuts: list[float], labels: list) -> Column:
    """Left-closed bins: the first label below the first cut, the last at or above the last."""
    out = F.when(x.isNull(), F.lit(None))
    for cut, label in zip(cuts, labels):
        out = out.when(x < F.lit(cut), F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def equal_width_bins(df: DataFrame, column: str, bins: int, name: str = "bin") -> DataFrame:
    """Bin number 1..bins over the column's range; the maximum falls in the last bin."""
    x = number(df, column)
    fit = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).select(F.struct("*")).scalar()
    placed = df.withColumn("_fit", fit)
    lo, hi = F.col("_fit.lo"), F.col("_fit.hi")
    raw = F.floor((x - lo) / (hi - lo) * bins) + 1
    b = F.when(x.isNotNull(), F.when(hi > lo, F.least(raw, F.lit(bins))).otherwise(F.lit(1)))
    return placed.withColumn(name, b.cast("int")).drop("_fit")


def quantile_cuts(df: DataFrame, columns: list[str], bins: int) -> dict[str, list[float]]:
    """Cut points at element floor(n*i/bins), duplicates removed."""
    picks = {f"c{i}": (i / bins, "floor") for i in range(1, bins)}
    found = quantile_values(df, columns, picks)
    return {c: sorted(set(found[c].values())) if c in found else [] for c in columns}


def bin_labels(cuts: list[float]) -> list[str]:
    """Level names with their ranges."""
    if not cuts:
        return ["all"]
    tags = {1: ["low", "high"], 2: ["low", "mid", "high"]}.get(
        len(cuts), [f"seg{i + 1}" for i in range(len(cuts) + 1)]
    )
    ends = [f"<{cuts[0]:.2f}"]
    ends += [f"{a:.2f}~{b:.2f}" for a, b in zip(cuts, cuts[1:])]
    ends.append(f">={cuts[-1]:.2f}")
    return [f"{t}({e})" for t, e in zip(tags, ends)]


def quantile_bins(df: DataFrame, columns: list[str], bins: int = 3) -> DataFrame:
    """Columns `<column>_bin` with the label of the quantile bin; NULL cells stay NULL."""
    cuts = quantile_cuts(df, columns, bins)
    return df.withColumns(
        {f"{c}_bin": case_chain(number(df, c), cuts[c], bin_labels(cuts[c])) for c in columns}
    )
