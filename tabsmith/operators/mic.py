"""Maximal information coefficient over equal-frequency grids.

Every row gets its exact position on both axes once. The cut positions of all grid sizes together
split an axis into a few dozen intervals, so rows are first counted per pair of intervals (at most
a few thousand cells whatever the row count) and every grid is summed from those cells.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.scalars import number
from tabsmith.operators import cleaning
from tabsmith.operators.slices import cut_index, with_position
from tabsmith.session import materialize

MIN_ROWS = 6


def grid_shapes(n: int, alpha: float, clamp: int) -> list[tuple[int, int]]:
    """All (a, b) with 2 <= a, b <= clamp and a*b within the budget."""
    budget = min(n**alpha, clamp * clamp)
    return [
        (a, b)
        for a in range(2, min(clamp, int(budget // 2)) + 1)
        for b in range(2, min(clamp, int(budget // a)) + 1)
    ]


def _cut_positions(n: int, sizes: set[int]) -> list[int]:
    """0-based positions at which some grid starts a new bin: ceil(k*n/a)."""
    shares = {Fraction(k, a) for a in sizes for k in range(1, a)}
    return sorted({-((-f.numerator * n) // f.denominator) for f in shares})


def mic_pairs(
    df: DataFrame, columns: list[str], order: list[str], alpha: float = 0.6, clamp: int = 15,
    impute: str = "drop", target: str | None = None,
) -> DataFrame:
    """MIC, Pearson r and nonlinearity per pair; equal values are ordered by the key columns."""
    if impute in ("mean", "median"):
        fill = cleaning.fill_mean if impute == "mean" else cleaning.fill_median
        df = fill(df, columns)
    full = df.select(*order, *[number(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    full = full.dropna(subset=[f"v{i}" for i in range(len(columns))])
    n = full.count()
    pairs = [
        (i, j)
        for i, j in combinations(range(len(columns)), 2)
        if target is None or target in (columns[i], columns[j])
    ]
    spark = df.sparkSession
    empty = "a string, b string, mic double, pearson double, nonlinearity double"
    shapes = grid_shapes(n, alpha, clamp) if n >= MIN_ROWS else []
    if not shapes:
        rows = [(columns[i], columns[j], 0.0, 0.0, 0.0) for i, j in pairs]
        return spark.createDataFrame(rows, empty)
    cuts = _cut_positions(n, {s for ab in shapes for s in ab})
    placed = full
    for i in range(len(columns)):
        placed = with_position(placed, [], [f"v{i}", *order], f"_p{i}", full)
        at = cut_index(f"(_p{i} - 1)", cuts)
        placed = placed.withColumn(f"_k{i}", F.expr(at)).drop(f"_p{i}")
    pair = F.explode(
        F.array(
            *[
                F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"),
                         F.col(f"_k{i}").alias("ka"), F.col(f"_k{j}").alias("kb"))
                for i, j in pairs
            ]
        )
    )
    cells = materialize(
        placed.select(pair.alias("p"))
        .groupBy("p.a", "p.b", "p.ka", "p.kb")
        .agg(F.count(F.lit(1)).alias("c")),
        "cells",
    )
    first = f"array({', '.join(f'{s}L' for s in [0, *cuts])})"
    shape = F.expr(
        "explode(array(" + ", ".join(f"named_struct('ga', {a}, 'gb', {b})" for a, b in shapes) + "))"
    )
    binned = cells.withColumn("s", shape).select(
        "a", "b", "s.ga", "s.gb", "c",
        F.expr(f"element_at({first}, ka + 1) * s.ga div {n}L").alias("ba"),
        F.expr(f"element_at({first}, kb + 1) * s.gb div {n}L").alias("bb"),
    )
    grid = ["a", "b", "ga", "gb"]
    joint = binned.groupBy(*grid, "ba", "bb").agg(F.sum("c").alias("c"))
    # A grid has at most clamp^2 bins, so these windows stay small.
    ra = F.sum("c").over(Window.partitionBy(*grid, "ba"))
    rb = F.sum("c").over(Window.partitionBy(*grid, "bb"))
    p = F.col("c") / F.lit(float(n))
    mi = F.sum(p * F.ln(F.col("c") * F.lit(float(n)) / (F.col("ra").cast("double") * F.col("rb"))))
    scored = joint.withColumns({"ra": ra, "rb": rb}).groupBy(*grid).agg(mi.alias("mi"))
    best = scored.groupBy("a", "b").agg(
        F.max(F.col("mi") / F.ln(F.least("ga", "gb").cast("double"))).alias("mic")
    )
    r = full.agg(*[F.corr(f"v{i}", f"v{j}").alias(f"r{i}_{j}") for i, j in pairs])
    r = r.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"),
                             F.coalesce(F.col(f"r{i}_{j}"), F.lit(0.0)).alias("pearson"))
                    for i, j in pairs
                ]
            )
        ).alias("p")
    ).select("p.*")
    capped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("mic")))
    out = best.join(r, ["a", "b"]).withColumn("mic", capped)
    return out.withColumn(
        "nonlinearity", F.greatest(F.lit(0.0), F.col("mic") - F.col("pearson") * F.col("pearson"))
    ).select("a", "b", "mic", "pearson", "nonlinearity")


def relation_type(mic: Column, nonlinearity: Column) -> Column:
    return (
        F.when(mic < 0.1, "none")
        .when(nonlinearity > 0.15, "nonlinear")
        .when(nonlinearity > 0.05, "mixed")
        .when(mic > 0.3, "linear")
        .otherwise("weak")
    )


def mic_relation_type(pairs: DataFrame, top: int | None = 15) -> DataFrame:
    """Pairs with clear nonlinearity, strongest first, with their class; None as `top` returns all."""
    out = (
        pairs.where("nonlinearity > 0.05")
        .withColumn("relation", relation_type(F.col("mic"), F.col("nonlinearity")))
        .orderBy(F.desc("nonlinearity"), "a", "b")
    )
    return out if top is None else out.limit(top)
