"""Correlation and association measures. All numeric pairs of a request share one scan."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.scalars import is_numeric, number, numbers, present
from tabsmith.functions.tails import t_p_value
from tabsmith.operators.order_stats import quantile_values
from tabsmith.operators.pairwise import pair_moments
from tabsmith.session import materialize

STRENGTH_CUTS = (0.1, 0.3, 0.5, 0.7)
STRENGTH_NAMES = ("very weak", "weak", "moderate", "strong", "very strong")


def pairs_of(columns: list[str], focus: str | None = None) -> list[tuple[str, str]]:
    if focus:
        return [(focus, c) for c in columns if c != focus]
    return list(combinations(columns, 2))


def _pair_rows(wide: DataFrame, pairs: list[tuple[str, str]], fields: list[str]) -> DataFrame:
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("a"), F.lit(b).alias("b"),
                *[F.col(f"_{i}_{f}").alias(f) for f in fields],
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return wide.select(F.explode(rows).alias("p")).select("p.*")


def t_of_r(r: Column, n: Column) -> Column:
    return F.when(n > 2, r * F.sqrt((n - 2) / F.greatest(F.lit(1e-12), 1 - r * r)))


def corr_pearson(
    df: DataFrame, columns: list[str], focus: str | None = None, p_values: bool = True
) -> DataFrame:
    """r, n, t and two-sided p over pairwise-complete rows, all pairs in one scan."""
    if focus:
        pairs, aggs = pairs_of(columns, focus), []
        for i, (a, b) in enumerate(pairs):
            aggs += [F.corr(a, b).alias(f"_{i}_r"), F.regr_count(b, a).alias(f"_{i}_n")]
        out = _pair_rows(numbers(df, columns).agg(*aggs), pairs, ["r", "n"])
    else:
        out = pair_moments(numbers(df, columns), columns).select("a", "b", "r", "n")
    out = out.withColumn("t", t_of_r(F.col("r"), F.col("n")))
    if p_values:
        out = out.withColumn("p", t_p_value(F.col("t"), (F.col("n") - 2).cast("double")))
    return out


def covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    return pair_moments(numbers(df, columns), columns).select("a", "b", "cov")


def corr_spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson on tie-averaged ranks of the complete pairs.

    Equal pairs are counted first, so ranks are joined to distinct pairs only.
    """
    both = df.select(number(df, a).alias("x"), number(df, b).alias("y")).where(
        "x is not null and y is not null"
    )
    points = materialize(both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w")), "points")
    ranked = weighted_ranks(weighted_ranks(points, "x", "rx"), "y", "ry")
    return weighted_corr(ranked, "rx", "ry", "w").select(
        F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("r"), F.col("n")
    )


def weighted_ranks(points: DataFrame, value: str, name: str, weight: str = "w") -> DataFrame:
    from tabsmith.operators.order_stats import running_before
    from tabsmith.operators.slices import fit_slicer

    levels = points.groupBy(value).agg(F.sum(weight).alias("c"))
    slicer = fit_slicer(points, F.col(value))
    run = running_before(levels, value, ["c"], [], slicer)
    ranks = run.select(
        F.col(value).alias("_v"), (F.col("c_before") + (F.col("c") + 1) / 2.0).alias(name)
    )
    return points.join(ranks, F.col(value) == F.col("_v")).drop("_v")


def weighted_corr(df: DataFrame, x: str, y: str, w: str) -> DataFrame:
    """Correlation of weighted points; sums are centred on the weighted means."""
    c = df.agg(
        F.sum(w).alias("n"),
        (F.sum(F.col(x) * F.col(w)) / F.sum(w)).alias("mx"),
        (F.sum(F.col(y) * F.col(w)) / F.sum(w)).alias("my"),
    ).select(F.struct("*"))
    d = df.withColumn("_c", c.scalar())
    dx, dy = F.col(x) - F.col("_c.mx"), F.col(y) - F.col("_c.my")
    s = d.agg(
        F.sum(dx * dy * F.col(w)).alias("sxy"), F.sum(dx * dx * F.col(w)).alias("sxx"),
        F.sum(dy * dy * F.col(w)).alias("syy"), F.sum(w).alias("n"),
    )
    r = F.coalesce(F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx")) * F.sqrt(F.col("syy"))), F.lit(0.0))
    return s.select(r.alias("r"), F.col("n").cast("long").alias("n"))


def corr_bicor(df: DataFrame, columns: list[str]) -> DataFrame:
    """Biweight midcorrelation per pair over rows complete in all columns."""
    full = numbers(df, columns).dropna()
    med = quantile_values(full, columns, {"m": (0.5, "linear")})
    dev = full.select(*[F.abs(F.col(c) - F.lit(med[c]["m"])).alias(c) for c in columns])
    mad = quantile_values(dev, columns, {"m": (0.5, "linear")})

    def damped(c: str) -> Column:
        d = F.col(c) - F.lit(med[c]["m"])
        u = d / F.lit(9 * (mad[c]["m"] or 1e-8))
        return F.when(F.abs(u) < 1, d * (1 - u * u) * (1 - u * u)).otherwise(F.lit(0.0)).alias(c)

    return corr_pearson(full.select(*[damped(c) for c in columns]), columns, p_values=False).drop("t")


def corr_winsor(df: DataFrame, columns: list[str], alpha: float = 0.05) -> DataFrame:
    """Pearson after clamping each column at its alpha tails."""
    full = numbers(df, columns).dropna()
    q = quantile_values(full, columns, {"lo": (alpha, "low"), "hi": (1 - alpha, "high")})
    clamped = full.select(
        *[F.greatest(F.lit(q[c]["lo"]), F.least(F.lit(q[c]["hi"]), F.col(c))).alias(c) for c in columns]
    )
    return corr_pearson(clamped, columns, p_values=False).drop("t")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cell counts with row, column and grand totals, over complete pairs."""
    cells = (
        df.where(present(df, a).isNotNull() & present(df, b).isNotNull())
        .groupBy(F.col(a).cast("string").alias("row_level"), F.col(b).cast("string").alias("column_level"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rows = cells.groupBy("row_level").agg(F.sum("n").alias("row_n"))
    cols = cells.groupBy("column_level").agg(F.sum("n").alias("column_n"))
    return (
        cells.join(rows, "row_level")
        .join(cols, "column_level")
        .withColumn("total", cells.agg(F.sum("n")).scalar())
    )


def chi_statistics(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2, degrees of freedom, n and level counts of a contingency table.

    The sum of n_ij^2/(r_i c_j) over filled cells gives chi2, so empty cells need no rows.
    """
    t = contingency(df, a, b)
    part = F.col("n") * F.col("n") / (F.col("row_n").cast("double") * F.col("column_n"))
    s = t.agg(
        F.sum(part).alias("_s"), F.max("total").alias("n"),
        F.count_distinct("row_level").alias("rows"), F.count_distinct("column_level").alias("columns"),
    )
    return s.select(
        F.greatest(F.col("n") * (F.col("_s") - 1), F.lit(0.0)).alias("chi2"),
        ((F.col("rows") - 1) * (F.col("columns") - 1)).alias("df"),
        "n", "rows", "columns",
    )


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    c = chi_statistics(df, a, b)
    k = F.least("rows", "columns")
    v = F.coalesce(F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * (k - 1))), F.lit(0.0))
    return c.select(F.lit(a).alias("a"), F.lit(b).alias("b"), v.alias("v"), "n")


def corr_ratio(df: DataFrame, category: str, value: str) -> DataFrame:
    """eta: share of the numeric variance between categories, square-rooted."""
    x = number(df, value)
    g = (
        df.where(present(df, category).isNotNull() & x.isNotNull())
        .groupBy(category)
        .agg(F.count(F.lit(1)).alias("c"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    )
    centre = g.agg((F.sum(F.col("c") * F.col("m")) / F.sum("c")).alias("g")).scalar()
    s = g.withColumn("_g", centre).agg(
        F.sum(F.col("c") * (F.col("m") - F.col("_g")) * (F.col("m") - F.col("_g"))).alias("ssb"),
        F.sum(F.col("c") * F.col("v")).alias("ssw"),
        F.sum("c").alias("n"),
    )
    eta2 = F.coalesce(F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw")), F.lit(0.0))
    return s.select(
        F.lit(category).alias("a"), F.lit(value).alias("b"),
        F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), eta2))).alias("eta"), "n",
    )


def strength(v: Column) -> Column:
    out = F.when(F.abs(v) < STRENGTH_CUTS[0], STRENGTH_NAMES[0])
    for cut, name in zip(STRENGTH_CUTS[1:], STRENGTH_NAMES[1:-1]):
        out = out.when(F.abs(v) < cut, name)
    return out.otherwise(STRENGTH_NAMES[-1])


def mixed_assoc(df: DataFrame, columns: list[str], focus: str | None = None) -> DataFrame:
    """The fitting measure per pair: Pearson, Cramer's V or correlation ratio, with its strength."""
    numeric = {c for c in columns if is_numeric(df, c)}
    parts = []
    num_pairs = [p for p in pairs_of(columns, focus) if set(p) <= numeric]
    if num_pairs:
        r = corr_pearson(df, [c for c in columns if c in numeric], p_values=False)
        r = r.select("a", "b", F.lit("pearson").alias("measure"), F.col("r").alias("value"), "n")
        keep = {frozenset(p) for p in num_pairs}
        cond = F.lit(False)
        for a, b in (tuple(k) for k in keep):
            cond = cond | (F.col("a").isin(a, b) & F.col("b").isin(a, b))
        parts.append(r.where(cond))
    for a, b in pairs_of(columns, focus):
        if {a, b} <= numeric:
            continue
        if a not in numeric and b not in numeric:
            c = cramers_v(df, a, b).select("a", "b", F.lit("cramers_v").alias("measure"), F.col("v").alias("value"), "n")
        else:
            cat, num = (a, b) if b in numeric else (b, a)
            c = corr_ratio(df, cat, num).select(
                F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit("eta").alias("measure"), F.col("eta").alias("value"), "n"
            )
        parts.append(c)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    direction = F.when(F.col("measure") != "pearson", "none").when(F.col("value") > 0, "positive").when(
        F.col("value") < 0, "negative"
    ).otherwise("none")
    return out.withColumns({"strength": strength(F.col("value")), "direction": direction})


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def corr_sym_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Symmetric matrix, one row per variable, cells `r` with stars; the diagonal is 1."""
    r = corr_pearson(df, columns)
    cell = F.concat(F.format_string("%.3f", "r"), stars(F.col("p")))
    long = r.select("a", "b", cell.alias("cell"))
    flipped = long.select(F.col("b").alias("a"), F.col("a").alias("b"), "cell")
    return (
        long.unionByName(flipped)
        .groupBy(F.col("a").alias("variable"))
        .pivot("b", columns)
        .agg(F.first("cell"))
        .na.fill("1.000")
    )


def corr_threshold(df: DataFrame, columns: list[str], threshold: float = 0.8) -> DataFrame:
    return corr_pearson(df, columns, p_values=False).where(F.abs("r") > threshold).select("a", "b", "r")


def correlation_matrix(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, int]:
    """k x k matrix over rows complete in all columns, and their number."""
    full = numbers(df, columns).dropna()
    m, n, at = np.eye(len(columns)), 0, {c: i for i, c in enumerate(columns)}
    for row in pair_moments(full, columns).collect():  # k (k - 1) / 2 rows
        n, j, k = row["n"], at[row["a"]], at[row["b"]]
        m[j, k] = m[k, j] = row["r"] if row["r"] is not None else 0.0
    return m, n


def partial_matrix(corr: np.ndarray) -> np.ndarray:
    """Partial correlations from the inverse; a singular matrix uses the pseudo-inverse."""
    try:
        inv = np.linalg.inv(corr)
    except np.linalg.LinAlgError:
        inv = np.linalg.pinv(corr)
    d = np.sqrt(np.maximum(np.outer(np.diag(inv), np.diag(inv)), 1e-12))
    out = -inv / d
    np.fill_diagonal(out, 1.0)
    return out


def partial_corr(df: DataFrame, columns: list[str], top: int | None = 20) -> DataFrame:
    """Strongest partial-correlation edges (None as `top`: all) with the degree of their end nodes."""
    rho = partial_matrix(correlation_matrix(df, columns)[0])
    edges = [
        (columns[i], columns[j], float(rho[i, j]))
        for i in range(len(columns))
        for j in range(i + 1, len(columns))
    ]
    edges = sorted(edges, key=lambda e: -abs(e[2]))[:top]
    degree = {c: sum(c in e[:2] for e in edges) for c in columns}
    rows = [(a, b, r, "+" if r >= 0 else "-", degree[a], degree[b]) for a, b, r in edges]
    return df.sparkSession.createDataFrame(
        rows, "a string, b string, rho double, sign string, degree_a int, degree_b int"
    )
