"""Exact order statistics for many columns and groups at once.

Values are sliced (see slices.py), slices are counted, and only the slices that hold a wanted
rank are read again and ordered. No group's values meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.scalars import number
from tabsmith.operators.slices import SLICE, broadcast_if_small, fit_slicer, join_null_safe

# Rules that turn (n, p) into the 0-based ranks to read.
RULES = ("linear", "midpoint", "floor", "low", "high")


def _ranks(rule: str, p: float) -> tuple[str, str, str]:
    """SQL for the lower rank, the upper rank and the weight of the upper value, over column n."""
    # 1e-9 guards products such as 0.07 * 100 against binary noise.
    p = f"{float(p)!r}D"
    if rule == "linear":
        lo = f"floor((n - 1) * {p} + 1e-9D)"
        return lo, f"ceil((n - 1) * {p} - 1e-9D)", f"greatest((n - 1) * {p} - {lo}, 0D)"
    if rule == "floor":
        k = f"least(floor(n * {p} + 1e-9D), n - 1)"
        return k, k, "0D"
    if rule == "low":
        k = f"floor({p} * (n - 1) + 1e-9D)"
        return k, k, "0D"
    if rule == "high":
        k = f"ceil({p} * (n - 1) - 1e-9D)"
        return k, k, "0D"
    if rule == "midpoint":
        # The k-th element for fractional k = n*p; for whole k the mean of k and k+1 when n is
        # even, else element k+1 (1-based).
        whole = f"abs(n * {p} - round(n * {p})) < 1e-9D"
        at, up = f"cast(round(n * {p}) as bigint)", f"ceil(n * {p} - 1e-9D) - 1"
        lo = f"CASE WHEN {whole} THEN {at} - CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END ELSE {up} END"
        hi = f"CASE WHEN {whole} THEN {at} ELSE {up} END"
        return (
            f"greatest(least({lo}, n - 1), 0)",
            f"greatest(least({hi}, n - 1), 0)",
            f"CASE WHEN {whole} AND n % 2 = 0 THEN 0.5D ELSE 0D END",
        )
    raise ValueError(f"unknown rule {rule}; one of {RULES}")


def melt(df: DataFrame, columns: list[str], group: list[str] = ()) -> DataFrame:
    """Long form (group..., column, value) of the numeric cells, NULLs dropped."""
    names = [f"_m{i}" for i in range(len(columns))]
    wide = df.select(*group, *[number(df, c).alias(m) for c, m in zip(columns, names)])
    parts = ", ".join(f"'{c}', {m}" for c, m in zip(columns, names))
    keys = [f"`{g}`" for g in group]
    return wide.selectExpr(
        *keys, f"stack({len(columns)}, {parts}) as (column, value)"
    ).where(F.col("value").isNotNull())


def quantile_table(
    df: DataFrame,
    columns: list[str],
    picks: dict[str, tuple[float, str]],
    group: list[str] = (),
) -> DataFrame:
    """One row per (group, column): n and the named quantiles, exact.

    `picks` maps an output name to (p, rule); see RULES.
    """
    group = list(group)
    by = [*group, "column"]
    long = melt(df, columns, group)
    # Many narrow slices: only those that hold a wanted rank are read again.
    slicer = fit_slicer(long, F.col("value"), least=64)
    sliced = slicer.add(long, F.col("value"))
    w = Window.partitionBy(*by)
    before = F.coalesce(
        F.sum("_c").over(w.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    counted = (
        sliced.groupBy(*by, SLICE)
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_before", before)
        .withColumn("n", F.sum("_c").over(w))
    )
    ranks = {k: _ranks(rule, p) for k, (p, rule) in picks.items()}
    texts = dict.fromkeys(f"cast({r} as bigint)" for lo, hi, _ in ranks.values() for r in (lo, hi))
    wanted = F.expr(f"array({', '.join(texts)})")
    here = F.filter(
        F.array_distinct("_ranks"),
        lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_c")),
    )
    holding = (
        counted.withColumn("_ranks", wanted)
        .withColumn("_ranks", here)
        .where(F.size("_ranks") > 0)
        .select(*by, SLICE, "_before", "n", "_ranks")
    )
    holding = broadcast_if_small(holding)
    near = join_null_safe(sliced, holding.select(*by, SLICE), [*by, SLICE])
    runs = near.groupBy(*by, SLICE, "value").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(
        Window.partitionBy(*by, SLICE).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    )
    ends = join_null_safe(runs.withColumn("_upto", upto), holding, [*by, SLICE])
    end = F.col("_before") + F.col("_upto")
    inside = F.filter("_ranks", lambda r: (r >= end - F.col("_c")) & (r < end))
    hits = ends.select(*by, "n", "value", F.explode(inside).alias("_rank"))
    # At most two entries per pick and group.
    found = hits.groupBy(*by, "n").agg(
        F.map_from_entries(F.collect_list(F.struct("_rank", "value"))).alias("_at")
    )

    def blended(lo: str, hi: str, weight: str) -> Column:
        low = f"element_at(_at, cast({lo} as bigint))"
        if lo == hi:
            return F.expr(low)
        return F.expr(f"{low} + {weight} * (element_at(_at, cast({hi} as bigint)) - {low})")

    return found.select(
        *by,
        F.col("n").cast("long").alias("n"),
        *[blended(*r).alias(k) for k, r in ranks.items()],
    )


def quantile_values(
    df: DataFrame, columns: list[str], picks: dict[str, tuple[float, str]]
) -> dict[str, dict[str, float]]:
    """The same as a small dict, one entry per column, for use as literals in later plans."""
    rows = quantile_table(df, columns, picks).collect()
    return {r["column"]: {k: r[k] for k in picks} for r in rows}


def cumulative_counts(
    df: DataFrame, value: str, measures: dict[str, Column], group: list[str] = ()
) -> DataFrame:
    """Per distinct value: the measures, and `<m>_before`, their sum over smaller values."""
    group = list(group)
    src = df.where(F.col(f"`{value}`").isNotNull())
    runs = src.groupBy(*group, value).agg(*[c.alias(k) for k, c in measures.items()])
    slicer = fit_slicer(src, F.col(f"`{value}`").cast("double"))
    return running_before(runs, value, list(measures), group, slicer)


def running_before(
    runs: DataFrame, value: str, measures: list[str], group: list[str], slicer
) -> DataFrame:
    """Running sums of `measures` over strictly smaller values, sliced; values are distinct."""
    sliced = slicer.add(runs, F.col(f"`{value}`").cast("double"))
    by = [*group, SLICE]
    inner = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*group).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    per = sliced.groupBy(*by).agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
    offs = per.select(
        *by, *[F.coalesce(F.sum(f"_s_{m}").over(outer), F.lit(0)).alias(f"_o_{m}") for m in measures]
    )
    local = sliced.withColumns(
        {f"_l_{m}": F.coalesce(F.sum(m).over(inner), F.lit(0)) for m in measures}
    )
    joined = join_null_safe(local, broadcast_if_small(offs), by)
    return joined.withColumns(
        {f"{m}_before": F.col(f"_l_{m}") + F.col(f"_o_{m}") for m in measures}
    ).drop(SLICE, *[f"_l_{m}" for m in measures], *[f"_o_{m}" for m in measures])


def rank_table(df: DataFrame, value: str, group: list[str] = ()) -> DataFrame:
    """Distinct values with their count, dense start rank and tie-averaged rank."""
    t = cumulative_counts(df, value, {"n": F.count(F.lit(1))}, group)
    return t.withColumn("avg_rank", F.col("n_before") + (F.col("n") + 1) / 2.0)
