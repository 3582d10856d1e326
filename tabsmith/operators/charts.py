"""Descriptive statistics and the aggregates behind charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.scalars import number, present
from tabsmith.operators.order_stats import melt, quantile_table
from tabsmith.operators.profiling import missing_rate, per_column
from tabsmith.operators.slices import broadcast_if_small, join_null_safe
from tabsmith.session import materialize

FIVE = {
    "q1": (0.25, "floor"), "median": (0.5, "floor"), "q3": (0.75, "floor"),
}


def descriptive(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, population and sample deviation, quartiles, range and missing rate per column."""
    t = per_column(
        df,
        columns,
        {
            "mean": lambda x, p: F.avg(x),
            "sd": lambda x, p: F.stddev_pop(x),
            "sd_sample": lambda x, p: F.stddev_samp(x),
            "min": lambda x, p: F.min(x),
            "max": lambda x, p: F.max(x),
            "missing_rate": missing_rate,
        },
    )
    q = quantile_table(
        df, columns,
        {"q1": (0.25, "midpoint"), "median": (0.5, "linear"), "q3": (0.75, "midpoint")},
    )
    return t.join(F.broadcast(q.drop("n")), "column", "left")


def skew_kurt(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis per column."""
    t = per_column(
        df,
        columns,
        {
            "n": lambda x, p: F.count(x),
            "g1": lambda x, p: F.skewness(x),
            "g2": lambda x, p: F.kurtosis(x),
        },
    )
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1"))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return t.select("column", "n", skew.alias("skewness"), kurt.alias("kurtosis"))


def five_numbers(
    df: DataFrame, columns: list[str], group: list[str] = (), picks: dict | None = None
) -> DataFrame:
    """n, min, quartiles and max per (group, column)."""
    picks = {"min": (0.0, "floor"), **(picks or FIVE), "max": (1.0, "floor")}
    return quantile_table(df, columns, picks, group)


def boxplot(df: DataFrame, columns: list[str], k: float = 1.5) -> DataFrame:
    """Five numbers, the fences' violations counted per column."""
    picks = {"q1": (0.25, "midpoint"), "median": (0.5, "linear"), "q3": (0.75, "midpoint")}
    five = materialize(five_numbers(df, columns, picks=picks), "five")  # a row a column, for the result and the fences
    out = boxplot_outliers(df, columns, k, five).groupBy("column").agg(
        F.count(F.lit(1)).alias("outliers")
    )
    return five.join(F.broadcast(out), "column", "left").withColumn(
        "outliers", F.coalesce("outliers", F.lit(0))
    )


def boxplot_outliers(
    df: DataFrame, columns: list[str], k: float = 1.5, five: DataFrame | None = None
) -> DataFrame:
    """(column, value) of the points outside the fences."""
    if five is None:
        picks = {"q1": (0.25, "midpoint"), "median": (0.5, "linear"), "q3": (0.75, "midpoint")}
        five = five_numbers(df, columns, picks=picks)
    iqr = F.col("q3") - F.col("q1")
    fences = five.select(
        "column", (F.col("q1") - k * iqr).alias("_lo"), (F.col("q3") + k * iqr).alias("_hi")
    )
    return (
        melt(df, columns)
        .join(F.broadcast(fences), "column")
        .where((F.col("value") < F.col("_lo")) | (F.col("value") > F.col("_hi")))
        .select("column", "value")
    )


def frequency(df: DataFrame, column: str) -> DataFrame:
    level = F.coalesce(present(df, column).cast("string"), F.lit("missing"))
    return df.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, column: str, bins: int = 20, group: list[str] = ()) -> DataFrame:
    """Equal-width bins with mid-points and counts, empty bins included; the last bin is closed."""
    x = number(df, column)
    keys = list(group)
    src = df.select(*keys, x.alias("_x")).where(F.col("_x").isNotNull())
    if keys:
        lim = src.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        placed = join_null_safe(src, broadcast_if_small(lim), keys)
    else:
        lim = src.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        fit = lim.select(F.struct("*")).scalar()
        placed = src.withColumn("_f", fit).select("_x", "_f.*")
    width = (F.col("_hi") - F.col("_lo")) / bins
    raw = F.when(width > 0, F.floor((F.col("_x") - F.col("_lo")) / width)).otherwise(F.lit(0))
    b = F.greatest(F.lit(0), F.least(raw, F.lit(bins - 1))).cast("int")
    counts = placed.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = lim.select(
        *keys, "_lo", width.alias("_w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    return join_null_safe(frame, counts, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("_lo") + (F.col("bin") + 0.5) * F.col("_w")).alias("mid"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def group_mean_topn(df: DataFrame, category: str, value: str, n: int = 12) -> DataFrame:
    """Mean and count of the n most frequent categories; ties by category."""
    x = number(df, value)
    return (
        df.where(present(df, category).isNotNull() & x.isNotNull())
        .groupBy(F.col(category).alias("category"))
        .agg(F.avg(x).alias("mean"), F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "category")
        .limit(n)
    )


def crosstab_topn(df: DataFrame, row: str, column: str, rows: int = 8, columns: int = 6) -> DataFrame:
    """Counts over the most frequent row and column levels. One grouping of the detail."""
    both = present(df, row).isNotNull() & present(df, column).isNotNull()
    cells = (
        df.where(both)
        .groupBy(F.col(row).alias("row_level"), F.col(column).alias("column_level"))
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def top(level: str, k: int) -> DataFrame:
        return (
            cells.groupBy(level)
            .agg(F.sum("n").alias("_t"))
            .orderBy(F.desc("_t"), level)
            .limit(k)
            .select(level)
        )

    return cells.join(F.broadcast(top("row_level", rows)), "row_level").join(
        F.broadcast(top("column_level", columns)), "column_level"
    ).select("row_level", "column_level", "n")


def chart_agg(df: DataFrame, category: str, measures: list[str], agg: str = "count") -> DataFrame:
    """Per category: count of numeric cells per measure (or sum, avg), and the row count."""
    how = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[agg]
    level = F.coalesce(present(df, category).cast("string"), F.lit("(empty)"))
    return df.groupBy(level.alias(category)).agg(
        *[how(number(df, m)).alias(m) for m in measures], F.count(F.lit(1)).alias("row_count")
    )


def chart_sort(df: DataFrame, measure: str, ascending: bool, tie: list[str]) -> DataFrame:
    c = F.coalesce(F.col(measure), F.lit(0))
    return df.orderBy(c.asc() if ascending else c.desc(), *tie)


def radar_max(df: DataFrame, measures: list[str]) -> DataFrame:
    """Axis limits: 1.2 times the maximum, blanks counting as zero."""
    return per_column(
        df, measures, {"axis_max": lambda x, p: F.max(F.coalesce(x, F.lit(0.0))) * 1.2}
    )


def heatmap_range(df: DataFrame, measure: str) -> DataFrame:
    """Colour range: 0 to the maximum, 100 when that is 0."""
    m = F.max(F.coalesce(number(df, measure), F.lit(0.0)))
    return df.agg(F.lit(0.0).alias("low"), F.coalesce(F.when(m != 0, m), F.lit(100.0)).alias("high"))


def scatter_sample(df: DataFrame, key: list[str], columns: list[str], n: int = 500, seed: int = 42):
    """n pseudo-random rows, the same for any layout: a distributed top-k on a key hash."""
    h = F.md5(F.concat_ws("|", *[F.col(f"`{k}`").cast("string") for k in key], F.lit(str(seed))).cast("binary"))
    return df.select(*key, *columns).orderBy(h, *key).limit(n)


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line and the x range over complete pairs."""
    a, b = number(df, x), number(df, y)
    both = df.where(a.isNotNull() & b.isNotNull())
    flat = F.coalesce(F.var_pop(a), F.lit(0.0)) == 0
    slope = F.when(flat, 0.0).otherwise(F.regr_slope(b, a))
    return both.agg(
        slope.alias("slope"),
        F.when(flat, F.avg(b)).otherwise(F.regr_intercept(b, a)).alias("intercept"),
        F.min(a).alias("min_x"),
        F.max(a).alias("max_x"),
    )


def status_rollup(
    courses: DataFrame, runs: DataFrame, key: str, ts: str, tie: str, passed: str, final: str
) -> DataFrame:
    """Per course: passed, pending, partial or failed from its runs, and the latest run."""
    g = runs.groupBy(key).agg(
        F.count(F.lit(1)).alias("runs"),
        F.bool_or(F.col(final) & F.col(passed)).alias("_final"),
        F.bool_or(passed).alias("_any"),
        F.max_by(tie, F.struct(ts, tie)).alias("latest"),
    )
    status = (
        F.when(F.col("_final"), "passed")
        .when(F.col("runs").isNull(), "pending")
        .when(F.col("_any"), "partial")
        .otherwise("failed")
    )
    return courses.select(key).distinct().join(g, key, "left").select(
        key, status.alias("status"), F.coalesce("runs", F.lit(0)).alias("runs"), "latest"
    )


def leaderboard_topk(
    runs: DataFrame, dataset: str, score: str, run_id: str, k: int = 10
) -> DataFrame:
    """Best k runs per dataset.

    The rank filter lets Spark keep only k rows per dataset before the shuffle.
    """
    w = Window.partitionBy(dataset).orderBy(F.desc(score), run_id)
    return runs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def kpi_rates(attempts: DataFrame, user: str, item: str, ts: str, order: str, passed: str) -> DataFrame:
    """Completion, first-pass and retry success rates, and the longest run of active days per user."""
    per_item = attempts.groupBy(user, item).agg(
        F.bool_or(passed).alias("_done"),
        F.min_by(passed, F.struct(ts, order)).alias("_first"),
        F.count(F.lit(1)).alias("_n"),
        F.count_if(passed).alias("_ok"),
    )
    rates = per_item.groupBy(user).agg(
        F.avg(F.col("_done").cast("double")).alias("completion_rate"),
        F.avg(F.col("_first").cast("double")).alias("first_pass_rate"),
        F.try_divide(
            F.sum(F.col("_ok") - F.col("_first").cast("long")), F.sum(F.col("_n") - 1)
        ).alias("retry_rate"),
    )
    days = attempts.select(user, F.unix_date(F.to_date(ts)).alias("_d")).distinct()
    island = F.col("_d") - F.row_number().over(Window.partitionBy(user).orderBy("_d"))
    streak = (
        days.withColumn("_g", island)
        .groupBy(user, "_g")
        .agg(F.count(F.lit(1)).alias("_len"))
        .groupBy(user)
        .agg(F.max("_len").alias("streak_days"))
    )
    return rates.join(streak, user)


def recent_topn(
    runs: DataFrame, names: DataFrame, key: str, name_key: str, name: str, ts: str, tie: str, n: int
) -> DataFrame:
    """Newest n runs with their dataset's name; only n rows are joined."""
    top = runs.orderBy(F.desc(ts), tie).limit(n)
    right = names.select(F.col(name_key).alias("_k"), F.col(name))
    return top.join(right, F.col(key) == F.col("_k"), "left").drop("_k")
