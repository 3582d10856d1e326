"""Profiles as mergeable states: sketches kept for each part of a table, merged without reading it again.

A state row describes one column of one part: counts, range, mean and squared deviations, an HLL sketch
of the distinct values and a KLL sketch of the numbers. States of any parts merge to the state of their
union, so a new day's data costs one scan of that day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.functions.scalars import number, present

#: Size of a quantile sketch (rank error about 0.2 %) and log2 of the registers of a distinct sketch (about 1.6 %).
KLL_SIZE = 1600
HLL_LOG = 12
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def profile_state(df: DataFrame, columns: list[str] | None = None, part: Column | None = None) -> DataFrame:
    """One state row for each part and column, from one scan with partial aggregation.

    `part` names the part of a row (text; NULL is a part of its own); without it the table is one part,
    which has a state even if it holds no rows. Cells that are no numbers count as values, not in the numbers.
    """
    columns = columns or df.columns
    cells, aggs = [], []
    for i, c in enumerate(columns):
        cells += [number(df, c).cast("double").alias(f"x{i}"), present(df, c).cast("string").alias(f"p{i}")]
        x, p = F.col(f"x{i}"), F.col(f"p{i}")
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(F.lit(1)).alias("row_count"),
                F.count_if(p.isNull()).alias("null_count"),
                F.count(x).alias("n"),
                F.avg(x).alias("mean"),
                (F.var_pop(x) * F.count(x)).alias("squares"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
                F.hll_sketch_agg(p, HLL_LOG).alias("distinct"),
                F.kll_sketch_agg_double(x, KLL_SIZE).alias("quantiles"),
            ).alias(f"s{i}")
        )
    if part is None:
        wide = df.select(*cells).agg(*aggs).withColumn("part", F.lit(None).cast("string"))
    else:
        wide = df.select(part.cast("string").alias("part"), *cells).groupBy("part").agg(*aggs)
    states = F.explode(F.array(*[F.col(f"s{i}") for i in range(len(columns))])).alias("s")
    return wide.select("part", states).select("part", "s.*")


def merge_states(states: DataFrame, *keys: str) -> DataFrame:
    """States of the union of parts, one row a column (and key, if keys name further columns).

    Squared deviations are taken about the merged mean, so that parts far from zero lose no digits.
    """
    by = [*keys, "column"]
    means = states.groupBy(*by).agg(F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("_mean"))
    same = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in by]
    on = same[0]
    for x in same[1:]:
        on = on & x
    both = states.alias("a").join(means.alias("b"), on).select("a.*", "b._mean")
    off = F.col("mean") - F.col("_mean")
    return both.groupBy(*by).agg(
        F.sum("row_count").alias("row_count"),
        F.sum("null_count").alias("null_count"),
        F.sum("n").alias("n"),
        F.first("_mean").alias("mean"),
        F.sum(F.col("squares") + F.col("n") * off * off).alias("squares"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("quantiles", KLL_SIZE).alias("quantiles"),
    )


def read_states(states: DataFrame) -> DataFrame:
    """The figures of each state: columns of the approximate profile; no numbers give NULL figures."""
    some = F.col("n") > 0
    quartiles = {name: F.when(some, F.kll_sketch_get_quantile_double("quantiles", F.lit(rank))) for name, rank in QUARTILES.items()}
    return states.withColumns(
        {
            "unique_count": F.hll_sketch_estimate("distinct"),
            "std": F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1))),
            **quartiles,
        }
    ).drop("n", "squares", "distinct", "quantiles")


class ProfileStore:
    """States of a growing table in a folder: only parts that it does not know are scanned."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def states(self) -> DataFrame | None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return None
        return self.spark.read.parquet(self.path)

    def update(self, df: DataFrame, part: str, columns: list[str] | None = None) -> list[str | None]:
        """Profile the parts of `df` that are new, by its column `part`; returns their names.

        The names are few (days, files); as a filter on the column they reach the scan and prune it.
        A part counts as whole when first seen. One job writes all new states, so a failed one leaves none.
        """
        names = df.select(F.col(f"`{part}`").cast("string").alias("part")).distinct()
        known = self.states()
        if known is not None:
            old = known.select("part").distinct().alias("o")
            names = names.alias("n").join(old, F.col("n.part").eqNullSafe(F.col("o.part")), "left_anti")
        fresh = sorted((r[0] for r in names.collect()), key=lambda v: (v is not None, v))
        if fresh:
            cell = F.col(f"`{part}`")
            wanted = cell.cast("string").isin([v for v in fresh if v is not None])
            if None in fresh:
                wanted = wanted | cell.isNull()
            columns = columns or [c for c in df.columns if c != part]
            profile_state(df.where(wanted), columns, cell).write.mode("append").parquet(self.path)
        return fresh

    def profile(self) -> DataFrame:
        """The profile of everything seen so far, from the states alone."""
        states = self.states()
        if states is None:
            raise FileNotFoundError(self.path)
        return read_states(merge_states(states))
