"""Process capability per characteristic, for any number of characteristics at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.normal import norm_pdf, norm_quantile, norm_sf_abs
from tabsmith.functions.scalars import number
from tabsmith.operators.charts import histogram
from tabsmith.operators.slices import join_null_safe, with_history, with_position

# d2 for two points and the customary long-term shift.
D2_PAIR = 1.128
SIGMA_SHIFT = 1.5


def moving_range(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Rows with the absolute step from the previous value of the same key (NULL at the first)."""
    src = df.select(*dict.fromkeys([*keys, *order]), number(df, value).alias("x")).where("x is not null")
    return with_history(
        src, keys, order, 1, lambda w: {"mr": F.abs(F.col("x") - F.lag("x", 1).over(w))}
    )


def sigma_within(
    df: DataFrame, keys: list[str], value: str, order: list[str], subgroup: int = 1
) -> DataFrame:
    """Short-term deviation per key.

    Single values use the mean moving range; larger subgroups the root mean subgroup variance,
    an incomplete last subgroup being dropped.
    """
    if subgroup <= 1:
        mr = moving_range(df, keys, value, order)
        return mr.groupBy(*keys).agg((F.avg("mr") / D2_PAIR).alias("sigma_within"))
    src = df.select(*dict.fromkeys([*keys, *order]), number(df, value).alias("x")).where("x is not null")
    placed = with_position(src, keys, order)
    sub = F.floor((F.col("rn") - 1) / subgroup).alias("_sub")
    g = placed.groupBy(*keys, sub).agg(F.count("x").alias("_n"), F.var_samp("x").alias("_v"))
    return (
        g.where(F.col("_n") == subgroup)
        .groupBy(*keys)
        .agg(F.sqrt(F.avg("_v")).alias("sigma_within"))
    )


def _indices(prefix: str, mean: Column, sigma: Column, lsl: Column, usl: Column) -> dict[str, Column]:
    up = F.try_divide(usl - mean, 3 * sigma)
    low = F.try_divide(mean - lsl, 3 * sigma)
    return {
        f"{prefix}": F.try_divide(usl - lsl, 6 * sigma),
        f"{prefix}u": up,
        f"{prefix}l": low,
        # least() skips NULL, so one limit alone gives the one-sided index.
        f"{prefix}k": F.least(up, low),
    }


def capability(
    df: DataFrame, keys: list[str], value: str, order: list[str],
    lsl: Column | float | None, usl: Column | float | None, subgroup: int = 1,
) -> DataFrame:
    """Cp, Cpk, Pp, Ppk, yield, ppm and sigma level per key.

    Limits are constants or columns of `df` that are constant per key.
    """
    lo = F.lit(lsl).cast("double") if not isinstance(lsl, Column) else lsl
    hi = F.lit(usl).cast("double") if not isinstance(usl, Column) else usl
    x = number(df, value)
    total = df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sigma_total"),
        F.max(lo).alias("lsl"), F.max(hi).alias("usl"),
    )
    within = sigma_within(df, keys, value, order, subgroup)
    both = join_null_safe(total, within, keys) if keys else total.withColumn("sigma_within", within.scalar())
    mean, low, up = F.col("mean"), F.col("lsl"), F.col("usl")
    out = both.where("n >= 2")
    out = out.withColumns(_indices("cp", mean, F.col("sigma_within"), low, up))
    out = out.withColumns(_indices("pp", mean, F.col("sigma_total"), low, up))
    zu, zl = (up - mean) / F.col("sigma_total"), (low - mean) / F.col("sigma_total")
    # Outside share from the two tails, so that small ppm keep their digits.
    above = F.when(zu > 0, norm_sf_abs(zu)).otherwise(1 - norm_sf_abs(zu))
    below = F.when(zl < 0, norm_sf_abs(zl)).otherwise(1 - norm_sf_abs(zl))
    ok = F.col("sigma_total") > 0
    outside = F.when(ok & low.isNotNull() & up.isNotNull(), above + below)
    out = out.withColumn("_out", outside).withColumns(
        {
            "yield": 1 - F.col("_out"),
            "ppm": F.col("_out") * 1e6,
            "sigma_level": -norm_quantile(F.col("_out")) + SIGMA_SHIFT,
        }
    )
    return out.drop("_out")


def insights(df: DataFrame) -> DataFrame:
    """Text classes from cp, cpk and (when present) the normality p-value."""
    cp, cpk = F.coalesce("cp", F.lit(0.0)), F.coalesce("cpk", F.lit(0.0))
    spread = F.when((cp > 1.33) & (cpk < 1.0), "capable but off centre").when(cp < 1.0, "spread too wide").otherwise("")
    level = F.when(cpk < 1.33, "insufficient or marginal").otherwise("excellent")
    out = df.withColumns({"spread_insight": spread, "level_insight": level})
    if "p" in df.columns:
        out = out.withColumn("shape_insight", F.when(F.col("p") > 0.05, "").when(F.col("p").isNull(), "not tested").otherwise("not normal"))
    return out


def curve(df: DataFrame, value: str, bins: int = 20, points: int = 81) -> tuple[DataFrame, DataFrame]:
    """Histogram and fitted normal density over mean +- 4 sigma."""
    h = histogram(df, value, bins)
    x = number(df, value)
    fit = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
    step = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    z = F.col("i") * (8.0 / (points - 1)) - 4.0
    density = fit.select("m", "s", step).select(
        "i", (F.col("m") + z * F.col("s")).alias("x"), F.try_divide(norm_pdf(z), F.col("s")).alias("density")
    )
    return h, density
