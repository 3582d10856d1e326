"""Measures over grouped rows: shares, periods, ranks, lookups, OEE and Pareto.

Detail rows are always aggregated first; windows run on the grouped result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsmith.operators.order_stats import running_before
from tabsmith.operators.slices import fit_slicer, join_null_safe


def oee(
    df: DataFrame, keys: list[str], planned: Column, run: Column, actual: Column, good: Column,
    ideal_rate: float,
) -> DataFrame:
    """Availability, performance, quality and their product per key; empty divisors give NULL."""
    s = df.groupBy(*keys).agg(
        F.sum(planned).alias("_p"), F.sum(run).alias("_r"), F.sum(actual).alias("_a"), F.sum(good).alias("_g")
    )
    availability = F.try_divide(F.col("_r"), F.col("_p"))
    performance = F.try_divide(F.col("_a"), F.col("_r") * F.lit(ideal_rate))
    quality = F.try_divide(F.col("_g"), F.col("_a"))
    return s.select(
        *keys, availability.alias("availability"), performance.alias("performance"),
        quality.alias("quality"), (availability * performance * quality).alias("oee"),
    )


def pareto(df: DataFrame, category: str, measure: Column) -> DataFrame:
    """Totals per category and the share of all totals at least as large; ties share.

    Equal totals are counted once before the running sum, which runs in slices of the totals. A
    category without a total has no share.
    """
    totals = df.groupBy(category).agg(measure.alias("total"))
    levels = totals.where(F.col("total").isNotNull()).groupBy("total").agg(F.sum("total").alias("s"))
    down = levels.withColumn("_neg", -F.col("total"))
    slicer = fit_slicer(down, F.col("_neg").cast("double"))
    run = running_before(down, "_neg", ["s"], [], slicer)
    grand = levels.agg(F.sum("s"))
    share = run.select(
        F.col("total").alias("_t"),
        F.try_divide(F.col("s_before") + F.col("s"), grand.scalar()).alias("cumulative_share"),
    )
    return totals.join(share, F.col("total") == F.col("_t"), "left").select(category, "total", "cumulative_share")


def filtered_sums(df: DataFrame, keys: list[str], value: str, filters: dict[str, Column]) -> DataFrame:
    """One sum per named filter, all in one pass; no match gives 0."""
    aggs = [F.coalesce(F.sum(F.when(c, F.col(value))), F.lit(0.0)).alias(k) for k, c in filters.items()]
    return df.groupBy(*keys).agg(*aggs)


def share_of_total(
    df: DataFrame, keys: list[str], measure: Column, shares: dict[str, list[str]]
) -> DataFrame:
    """Measure per key and its share of the total within each list of kept keys."""
    grouped = df.groupBy(*keys).agg(measure.alias("value"))
    out = grouped
    for name, kept in shares.items():
        # Totals are small aggregates joined back; a window would gather a total's rows in one task.
        if kept:
            totals = grouped.groupBy(*kept).agg(F.sum("value").alias("_total"))
            placed = join_null_safe(out, totals, kept)
        else:
            placed = out.withColumn("_total", grouped.agg(F.sum("value")).scalar())
        out = placed.withColumn(name, F.try_divide(F.col("value"), F.col("_total"))).drop("_total")
    return out


def prior_periods(df: DataFrame, time: str, measure: Column, back: dict[str, int]) -> DataFrame:
    """Monthly measure joined to the same measure some months earlier."""
    monthly = df.groupBy(F.trunc(time, "month").alias("month")).agg(measure.alias("value"))
    out = monthly
    for name, months in back.items():
        prior = monthly.select(
            F.add_months("month", months).alias("_at"), F.col("value").alias(name)
        )
        out = out.join(prior, F.col("month") == F.col("_at"), "left").drop("_at")
    return out


def daily(df: DataFrame, time: str, measure: Column, keys: list[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.to_date(time).alias("day")).agg(measure.alias("value"))


def year_to_date(df: DataFrame, time: str, measure: Column, keys: list[str] = ()) -> DataFrame:
    w = Window.partitionBy(*keys, F.year("day")).orderBy("day")
    return daily(df, time, measure, keys).withColumn("ytd", F.sum("value").over(w))


def rolling_days(df: DataFrame, time: str, measure: Column, days: int, keys: list[str] = ()) -> DataFrame:
    """Sum over the last `days` calendar days; the window sees one row per key and day."""
    w = Window.partitionBy(*keys).orderBy(F.unix_date("day")).rangeBetween(1 - days, 0)
    return daily(df, time, measure, keys).withColumn("rolling", F.sum("value").over(w))


def lookup(df: DataFrame, table: DataFrame, key: str, table_key: str, columns: list[str]) -> DataFrame:
    right = table.select(F.col(table_key).alias("_k"), *columns)
    return df.join(right, F.col(key) == F.col("_k"), "left").drop("_k")


def related_totals(
    df: DataFrame, detail: DataFrame, key: str, detail_key: str, measures: dict[str, Column]
) -> DataFrame:
    """Aggregates of the related detail rows; none gives 0. Detail is grouped before the join."""
    g = detail.groupBy(F.col(detail_key).alias("_k")).agg(*[m.alias(n) for n, m in measures.items()])
    out = df.join(g, F.col(key) == F.col("_k"), "left").drop("_k")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in measures})


def top_n_with_ties(df: DataFrame, by: str, n: int) -> DataFrame:
    """Rows at or above the n-th largest value: a distributed top-k finds the bound."""
    bound = df.select(by).orderBy(F.desc(by)).limit(n).agg(F.min(by))
    return df.where(F.col(by) >= bound.scalar())


def rank_all(df: DataFrame, by: str) -> DataFrame:
    """rank, dense rank and running total in descending order, for any number of rows.

    Distinct values are counted first; ranks come from sliced running sums. Rows without a value
    rank last.
    """
    levels = df.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("c"), F.sum(by).alias("s"), F.lit(1).alias("d")
    )
    down = levels.withColumn("_neg", -F.col(by))
    slicer = fit_slicer(down, F.col("_neg").cast("double"))
    run = running_before(down, "_neg", ["c", "s", "d"], [], slicer)
    ranks = run.select(
        F.col(by).alias("_v"),
        (F.col("c_before") + 1).cast("long").alias("rnk"),
        (F.col("d_before") + 1).cast("long").alias("dense"),
        (F.col("s_before") + F.col("s")).alias("running"),
    )
    last = levels.agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("d"), F.sum("s").alias("s")).select(
        F.lit(None).cast(df.schema[by].dataType).alias("_v"),
        (F.coalesce("c", F.lit(0)) + 1).cast("long").alias("rnk"),
        (F.col("d") + 1).cast("long").alias("dense"),
        F.col("s").alias("running"),
    )
    return df.join(ranks.unionByName(last), F.col(by).eqNullSafe(F.col("_v"))).drop("_v")


def level_grid(a: DataFrame, a_column: str, b: DataFrame, b_column: str) -> DataFrame:
    """All combinations of the levels of two category columns."""
    return a.select(a_column).distinct().crossJoin(b.select(b_column).distinct())


def data_table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)
