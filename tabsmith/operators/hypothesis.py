"""Hypothesis tests, normality, reliability and validity as small aggregates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.normal import coarse_cdf, coarse_quantile, norm_quantile
from tabsmith.functions.scalars import number, present
from tabsmith.functions.tails import chi2_p_value, f_p_value, kolmogorov_p_value, t_p_value
from tabsmith.operators.association import chi_statistics, correlation_matrix, partial_matrix
from tabsmith.operators.order_stats import cumulative_counts
from tabsmith.operators.slices import broadcast_if_small, join_null_safe, with_position
from tabsmith.session import materialize


def _moments(x: Column) -> list[Column]:
    return [
        F.count(x).cast("double").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"),
    ]


def ttest_one(df: DataFrame, column: str, mu: float = 0.0) -> DataFrame:
    s = df.agg(*_moments(number(df, column)))
    t = F.try_divide(F.col("mean") - F.lit(mu), F.col("sd") / F.sqrt("n"))
    out = s.select("n", "mean", "sd", t.alias("t"), (F.col("n") - 1).alias("df"))
    return out.withColumn("p", t_p_value("t", "df"))


def ttest_paired(df: DataFrame, a: str, b: str) -> DataFrame:
    diff = df.select((number(df, a) - number(df, b)).alias("d"))
    return ttest_one(diff, "d", 0.0)


def ttest_two(df: DataFrame, group: str, column: str, levels: tuple | None = None) -> DataFrame:
    """Pooled and Welch t between two groups, one row each.

    Without `levels` the group must have exactly two.
    """
    g = df.where(present(df, group).isNotNull()).groupBy(F.col(group).alias("g")).agg(
        *_moments(number(df, column))
    )
    if levels:
        g = g.where(F.col("g").isin(*levels))
    first, second = (F.lit(v) for v in levels) if levels else (None, None)
    if levels is None:
        ends = g.agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count(F.lit(1)).alias("k"))
        tag = g.withColumn("_e", ends.select(F.struct("*")).scalar())
        first, second = F.col("_e.lo"), F.col("_e.hi")
        check = F.when(F.col("_e.k") != 2, F.raise_error(F.lit("a two-sample test needs two groups"))).otherwise(True)
        g = tag.where(check)
    parts = []
    for name, level in (("1", first), ("2", second)):
        for f in ("n", "mean", "sd"):
            parts.append(F.max(F.when(F.col("g") == level, F.col(f))).alias(f"{f}{name}"))
    s = g.agg(*parts)
    v1, v2 = F.col("sd1") * F.col("sd1"), F.col("sd2") * F.col("sd2")
    n1, n2 = F.col("n1"), F.col("n2")
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    diff = F.col("mean1") - F.col("mean2")
    e1, e2 = v1 / n1, v2 / n2
    rows = F.array(
        F.struct(
            F.lit("pooled").alias("method"),
            F.try_divide(diff, F.sqrt(pooled * (1 / n1 + 1 / n2))).alias("t"),
            (n1 + n2 - 2).alias("df"),
        ),
        F.struct(
            F.lit("welch").alias("method"),
            F.try_divide(diff, F.sqrt(e1 + e2)).alias("t"),
            F.try_divide((e1 + e2) * (e1 + e2), e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1)).alias("df"),
        ),
    )
    out = s.select(diff.alias("mean_difference"), F.explode(rows).alias("r")).select(
        "r.method", "mean_difference", "r.t", "r.df"
    )
    return out.withColumn("p", t_p_value("t", "df"))


def _groups(df: DataFrame, factor: str, column: str) -> DataFrame:
    x = number(df, column)
    return (
        df.where(present(df, factor).isNotNull() & x.isNotNull())
        .groupBy(F.col(factor).cast("string").alias("level"))
        .agg(F.count(x).cast("double").alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("v"))
    )


def anova_oneway(df: DataFrame, factor: str, column: str) -> DataFrame:
    """Sums of squares, degrees of freedom, mean squares, F and p; one row per source."""
    g = _groups(df, factor, column)
    grand = g.agg(F.sum(F.col("n") * F.col("mean")) / F.sum("n")).scalar()
    s = g.withColumn("_g", grand).agg(
        F.sum(F.col("n") * (F.col("mean") - F.col("_g")) * (F.col("mean") - F.col("_g"))).alias("ssb"),
        F.sum(F.col("n") * F.col("v")).alias("ssw"),
        (F.count(F.lit(1)) - 1).cast("double").alias("dfb"),
        (F.sum("n") - F.count(F.lit(1))).alias("dfw"),
    )
    msb = F.try_divide(F.col("ssb"), F.col("dfb"))
    msw = F.try_divide(F.col("ssw"), F.col("dfw"))
    f = F.coalesce(F.try_divide(msb, msw), F.lit(0.0))
    s = s.withColumns({"msb": msb, "msw": msw, "f": f})
    s = s.withColumn("p", f_p_value("f", "dfb", "dfw"))
    none = F.lit(None).cast("double")
    rows = F.array(
        F.struct(F.lit("between").alias("source"), F.col("ssb").alias("ss"), F.col("dfb").alias("df"),
                 F.col("msb").alias("ms"), F.col("f").alias("f"), F.col("p").alias("p")),
        F.struct(F.lit("within").alias("source"), F.col("ssw").alias("ss"), F.col("dfw").alias("df"),
                 F.col("msw").alias("ms"), none.alias("f"), none.alias("p")),
        F.struct(F.lit("total").alias("source"), (F.col("ssb") + F.col("ssw")).alias("ss"),
                 (F.col("dfb") + F.col("dfw")).alias("df"), none.alias("ms"), none.alias("f"), none.alias("p")),
    )
    return s.select(F.explode(rows).alias("r")).select("r.*")


def anova_posthoc(df: DataFrame, factor: str, column: str) -> DataFrame:
    """Mean difference and t from the pooled mean square for each pair of levels."""
    g = _groups(df, factor, column)
    msw = g.agg(F.sum(F.col("n") * F.col("v")) / (F.sum("n") - F.count(F.lit(1))))
    a = g.select(F.col("level").alias("a"), F.col("n").alias("na"), F.col("mean").alias("ma"))
    b = g.select(F.col("level").alias("b"), F.col("n").alias("nb"), F.col("mean").alias("mb"))
    pair = a.join(b, F.col("a") < F.col("b")).withColumn("_ms", msw.scalar())
    diff = F.col("ma") - F.col("mb")
    se = F.sqrt(F.col("_ms") / F.col("na") + F.col("_ms") / F.col("nb"))
    return pair.select("a", "b", diff.alias("mean_difference"), F.try_divide(diff, se).alias("t"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    s = chi_statistics(df, a, b)
    return s.select("chi2", "df", "n").withColumn("p", chi2_p_value(F.col("chi2"), F.col("df").cast("double")))


def _run_block(df: DataFrame, block: int) -> DataFrame:
    """Split each run of equal values, positions n_before+1 .. n_before+n, into bounded blocks."""
    last = F.col("n_before") + F.col("n")
    starts = F.explode(F.sequence(F.col("n_before") + 1, last, F.lit(block).cast("long")))
    cut = df.withColumn("_last", last).withColumn("_from", starts)
    return cut.withColumn("_to", F.least(F.col("_from") + (block - 1), F.col("_last")))


def _blom_scores(df: DataFrame, column: str, block: int = 100_000) -> DataFrame:
    """Per distinct value: the sums of its expected normal scores and of their squares.

    Long runs are cut into blocks and spread over the cluster before they are expanded.
    """
    t = cumulative_counts(df.select(number(df, column).alias("x")), "x", {"n": F.count(F.lit(1))})
    t = t.withColumn("_total", df.agg(F.count(number(df, column))).scalar())
    blocks = _run_block(t, block).repartition("x", "_from")
    rank = F.explode(F.sequence("_from", "_to")).alias("i")
    m = coarse_quantile((F.col("i") - 0.375) / (F.col("_total") + 0.25))
    return blocks.select("x", rank, "_total").select("x", m.alias("m"))


#: Sample sizes for which the approximation of the p-value holds.
SHAPIRO_ROWS = (5, 5000)


def shapiro_francia(df: DataFrame, column: str) -> DataFrame:
    """W' from Blom scores and Royston's normal approximation of its p-value.

    ln(1 - W') is about normal with a mean and a deviation that depend on ln n and ln ln n. The
    approximation holds for 5 to 5000 rows: beyond, W' is given and p is NULL (`ks_normal` has no such
    bound).
    """
    x = number(df, column)
    base = df.agg(F.count(x).cast("double").alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("v"))
    scores = _blom_scores(df, column)
    mean = df.agg(F.avg(x)).scalar()
    s = scores.withColumn("_mu", mean).agg(
        F.sum(F.col("m") * (F.col("x") - F.col("_mu"))).alias("mx"), F.sum(F.col("m") * F.col("m")).alias("mm")
    )
    return _royston(base.withColumn("_s", s.select(F.struct("*")).scalar()), [])


def shapiro_francia_by(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """`shapiro_francia` for each key: keys, n, w, p. Ranks within a key are counted over slices of the
    values, so a key of any size is spread over tasks."""
    rows = df.select(*keys, number(df, column).alias("x"), F.monotonically_increasing_id().alias("_row")).where("x is not null")
    ranked = with_position(materialize(rows, "ranks"), keys, ["x", "_row"], "_i")
    base = rows.groupBy(*keys).agg(F.count("x").cast("double").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("v"))
    base = materialize(base, "moments")
    t = join_null_safe(ranked, broadcast_if_small(base.select(*keys, "n", "mean")), keys)
    m = coarse_quantile((F.col("_i") - 0.375) / (F.col("n") + 0.25))
    sums = t.withColumn("_m", m).groupBy(*keys).agg(
        F.struct(F.sum(F.col("_m") * (F.col("x") - F.col("mean"))).alias("mx"), F.sum(F.col("_m") * F.col("_m")).alias("mm")).alias("_s")
    )
    return _royston(join_null_safe(base, sums, keys), keys)


def _royston(t: DataFrame, keys: list[str]) -> DataFrame:
    """From n, v and the score sums _s to W' and its p-value."""
    n = F.col("n")
    # The scores sum to zero, so centring x leaves the product unchanged and is better behaved.
    w = F.least(F.lit(1.0), F.try_divide(F.col("_s.mx") * F.col("_s.mx") / F.col("_s.mm"), n * F.col("v")))
    w = F.when(F.col("v") > 0, w).otherwise(F.lit(1.0))
    # Royston's approximation (1993) for samples of 5 to 5000.
    log = F.ln(n)
    mu = -1.2725 + 1.0521 * (F.ln(log) - log)
    sigma = 1.0308 - 0.26758 * (F.ln(log) + 2 / log)
    t = t.where(n >= 3).select(*keys, "n", w.alias("w"), mu.alias("_m"), sigma.alias("_sd"))
    z = (F.ln(1 - F.col("w")) - F.col("_m")) / F.col("_sd")
    p = F.when(F.col("w") >= 1, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - coarse_cdf(z))))
    p = F.when(F.col("n").between(*SHAPIRO_ROWS), p)
    return t.select(*keys, F.col("n").cast("long").alias("n"), "w", p.alias("p"))


def ks_normal(df: DataFrame, column: str) -> DataFrame:
    """Largest gap between the empirical and the fitted normal distribution, asymptotic p."""
    x = number(df, column)
    fit = df.agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).select(F.struct("*"))
    t = cumulative_counts(df.select(x.alias("x")), "x", {"c": F.count(F.lit(1))}).withColumn("_f", fit.scalar())
    f = coarse_cdf((F.col("x") - F.col("_f.m")) / F.col("_f.s"))
    n = F.col("_f.n")
    low, high = F.col("c_before") / n, (F.col("c_before") + F.col("c")) / n
    s = t.agg(
        F.max(F.when(F.col("_f.s") > 0, F.greatest(F.abs(f - low), F.abs(f - high))).otherwise(0.0)).alias("d"),
        F.max(n).alias("n"),
    )
    root = F.sqrt(F.col("n").cast("double"))
    s = s.withColumn("_x", (root + 0.12 + 0.11 / root) * F.col("d"))
    return s.select("d", "n", kolmogorov_p_value("_x").alias("p"))


def qq_points(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """Sorted values against normal quantiles at evenly spaced exact ranks."""
    from tabsmith.operators.order_stats import quantile_table

    picks = {f"q{i}": ((i + 0.5) / points, "floor") for i in range(points)}
    q = quantile_table(df, [column], picks)
    at = F.array(*[F.col(f"q{i}") for i in range(points)])
    long = q.select(F.posexplode(at).alias("i", "value"))
    share = (F.col("i") + 0.5) / points
    return long.select(share.alias("share"), norm_quantile(share).alias("theoretical"), "value")


def tail_bands(df: DataFrame, column: str, cuts: tuple = (0.001, 0.01, 0.05, 0.25, 0.75, 0.95, 0.99, 0.999)):
    """Rows and share per band of normal tail probability under the fitted normal."""
    x = number(df, column)
    fit = df.agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"), F.count(x).alias("n")).select(F.struct("*"))
    t = df.select(x.alias("x")).where("x is not null").withColumn("_f", fit.scalar())
    p = coarse_cdf((F.col("x") - F.col("_f.m")) / F.col("_f.s"))
    band = F.lit(0)
    for c in cuts:
        band = band + (F.col("_p") >= c).cast("int")
    g = t.select(p.alias("_p"), F.col("_f.n").alias("_n")).groupBy(band.alias("band"), "_n").agg(F.count(F.lit(1)).alias("n"))
    return g.select("band", "n", (F.col("n") / F.col("_n")).alias("share"))


def _item_sums(df: DataFrame, items: list[str]) -> tuple[DataFrame, list[str]]:
    full = df.select(*[number(df, c).alias(c) for c in items]).dropna()
    return full, items


def cronbach_alpha(df: DataFrame, items: list[str]) -> DataFrame:
    """Alpha over rows complete in all items: one aggregate."""
    full, _ = _item_sums(df, items)
    total = sum((F.col(c) for c in items[1:]), F.col(items[0]))
    k = len(items)
    s = full.agg(
        F.count(F.lit(1)).alias("n"), F.var_samp(total).alias("_t"),
        sum((F.var_samp(c) for c in items[1:]), F.var_samp(items[0])).alias("_i"),
    )
    alpha = F.lit(k / (k - 1)) * (1 - F.try_divide(F.col("_i"), F.col("_t")))
    return s.select("n", F.lit(k).alias("items"), F.coalesce(alpha, F.lit(0.0)).alias("alpha"))


def alpha_if_deleted(df: DataFrame, items: list[str]) -> DataFrame:
    """Alpha without each item, all from one aggregate."""
    full, _ = _item_sums(df, items)
    k = len(items) - 1
    aggs = [F.var_samp(c).alias(f"_v{i}") for i, c in enumerate(items)]
    for i in range(len(items)):
        rest = [F.col(c) for j, c in enumerate(items) if j != i]
        aggs.append(F.var_samp(sum(rest[1:], rest[0])).alias(f"_t{i}"))
    s = full.agg(*aggs)
    rows = []
    for i, c in enumerate(items):
        own = [F.col(f"_v{j}") for j in range(len(items)) if j != i]
        alpha = F.lit(k / (k - 1)) * (1 - F.try_divide(sum(own[1:], own[0]), F.col(f"_t{i}")))
        rows.append(F.struct(F.lit(c).alias("item"), F.coalesce(alpha, F.lit(0.0)).alias("alpha")))
    return s.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def kmo(df: DataFrame, items: list[str]) -> DataFrame:
    """Sampling adequacy from correlations and true partial correlations."""
    r, n = correlation_matrix(df, items)
    p = partial_matrix(r)
    off = ~np.eye(len(items), dtype=bool)
    a, b = float((r[off] ** 2).sum()), float((p[off] ** 2).sum())
    value = a / (a + b) if a + b else 0.0
    return df.sparkSession.createDataFrame([(n, value)], "n long, kmo double")


def bartlett(df: DataFrame, items: list[str]) -> DataFrame:
    """Sphericity: chi2 from ln det R with k(k-1)/2 degrees of freedom."""
    r, n = correlation_matrix(df, items)
    k = len(items)
    det = float(np.linalg.det(r))
    chi2 = -(n - 1 - (2 * k + 5) / 6) * math.log(det if det > 0 else 1e-6)
    out = df.sparkSession.createDataFrame(
        [(n, chi2, k * (k - 1) / 2)], "n long, chi2 double, df double"
    )
    return out.withColumn("p", chi2_p_value("chi2", "df"))


def efa_loadings(df: DataFrame, items: list[str], components: int = 2) -> DataFrame:
    """Principal directions of the standardised items, one row per item.

    Signs are fixed so that the largest entry of a component is positive.
    """
    r, _ = correlation_matrix(df, items)
    values, vectors = np.linalg.eigh(r)
    at = np.argsort(-values)[:components]
    rows = []
    v = vectors[:, at]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), range(v.shape[1])])
    for i, c in enumerate(items):
        for k in range(v.shape[1]):
            rows.append((c, k + 1, float(v[i, k]), float(values[at[k]] / len(items))))
    return df.sparkSession.createDataFrame(
        rows, "item string, component int, loading double, explained double"
    )
