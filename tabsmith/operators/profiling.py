"""Schema inference, column roles, profiles and data health. One scan per question."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.scalars import (
    any_of, is_numeric, is_temporal, is_text, number, numbers, present,
)
from tabsmith.operators.pairwise import pair_moments
from tabsmith.operators.order_stats import quantile_table

# Name keywords per role.
ROLE_KEYWORDS = {
    "time": ("time", "date", "ts", "timestamp"),
    "device": ("device", "machine", "equipment", "station"),
    "product": ("product", "part", "item", "sku"),
    "quantity": ("qty", "quantity", "count", "output", "amount"),
}


def per_column(df: DataFrame, columns: list[str], measures: dict[str, callable]) -> DataFrame:
    """One aggregate over all columns, turned to one row per column.

    Each measure maps (number, cell) of a column to an aggregate expression. The conversion runs
    once per row, before the aggregate.
    """
    cells = []
    for i, c in enumerate(columns):
        cells += [number(df, c).alias(f"x{i}"), present(df, c).alias(f"p{i}")]
    aggs = [
        fn(F.col(f"x{i}"), F.col(f"p{i}")).alias(f"_{i}_{m}")
        for i in range(len(columns))
        for m, fn in measures.items()
    ]
    wide = df.select(*cells).agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), *[F.col(f"_{i}_{m}").alias(m) for m in measures]
            )
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def missing_rate(x: Column, p: Column) -> Column:
    return F.coalesce(F.try_divide(F.count_if(p.isNull()), F.count(F.lit(1))), F.lit(0.0))


def numeric_share(x: Column, p: Column) -> Column:
    """Share of all cells that parse as a number."""
    return F.coalesce(F.try_divide(F.count(x), F.count(F.lit(1))), F.lit(0.0))


def infer_schema(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.7):
    """Per column: numeric when more than `threshold` of the cells parse, and the missing rate."""
    columns = columns or df.columns
    t = per_column(
        df, columns, {"share": numeric_share, "missing": missing_rate}
    )
    role = F.when(F.col("share") > threshold, "numeric").otherwise("categorical")
    return t.select("column", role.alias("type"), F.col("missing").alias("missing_rate"))


def _name_matches(keywords: tuple[str, ...]) -> Column:
    words = F.split(F.lower(F.col("column")), r"[^a-z0-9]+")
    return F.arrays_overlap(words, F.array(*[F.lit(k) for k in keywords])) | any_of(
        [F.lower(F.col("column")).contains(k) for k in keywords if len(k) > 3]
    )


def tag_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Role tags per column from its content (one scan per kind of storage type) and its name."""
    columns = columns or df.columns

    kinds = {"time": [], "text": [], "other": []}
    for c in columns:
        kinds["time" if is_temporal(df, c) else "text" if is_text(df, c) else "other"].append(c)
    in_time = {
        "time": lambda p: p.isNotNull(),
        "text": lambda p: F.try_to_timestamp(p).isNotNull(),
        "other": lambda p: F.lit(False),
    }
    t = None
    for kind, chosen in kinds.items():
        if not chosen:
            continue
        test = in_time[kind]
        part = per_column(
            df,
            chosen,
            {
                "numeric_share": numeric_share,
                "time_share": lambda x, p: F.coalesce(
                    F.try_divide(F.count_if(test(p)), F.count(p)), F.lit(0.0)
                ),
                "distinct_count": lambda x, p: F.approx_count_distinct(p, 0.02),
                "n": lambda x, p: F.count(p),
            },
        )
        t = part if t is None else t.unionByName(part)
    is_time = (F.col("time_share") > 0.7) | (_name_matches(ROLE_KEYWORDS["time"]) & (F.col("numeric_share") <= 0.7))
    value_type = (
        F.when(F.col("time_share") > 0.7, "datetime")
        .when(F.col("numeric_share") > 0.7, "numeric")
        .when(F.try_divide(F.col("distinct_count"), F.col("n")) > 0.5, "text")
        .otherwise("categorical")
    )
    return t.select(
        "column",
        value_type.alias("type"),
        is_time.alias("is_time"),
        _name_matches(ROLE_KEYWORDS["device"]).alias("is_device"),
        _name_matches(ROLE_KEYWORDS["product"]).alias("is_product"),
        (_name_matches(ROLE_KEYWORDS["quantity"]) & (F.col("numeric_share") > 0.7)).alias("is_quantity"),
    )


def normalize_frame(df: DataFrame, drop_duplicates: bool = True) -> DataFrame:
    """Clean names and text cells; "nan" and "None" become empty; exact duplicates go."""
    renamed = df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])

    def cell(c: str) -> Column:
        if not is_text(renamed, c):
            return F.col(f"`{c}`")
        bare = F.trim(F.regexp_replace(F.col(f"`{c}`"), "﻿", ""))
        return F.coalesce(F.when(~bare.isin("nan", "None"), bare), F.lit("")).alias(c)

    out = renamed.select(*[cell(c).alias(c) for c in renamed.columns])
    return out.dropDuplicates() if drop_duplicates else out


def _moments(df: DataFrame, columns: list[str]) -> DataFrame:
    return per_column(
        df,
        columns,
        {
            "row_count": lambda x, p: F.count(F.lit(1)),
            "null_count": lambda x, p: F.count_if(p.isNull()),
            "count": lambda x, p: F.count(x),
            "mean": lambda x, p: F.avg(x),
            "std": lambda x, p: F.stddev_samp(x),
            "min": lambda x, p: F.min(x),
            "max": lambda x, p: F.max(x),
        },
    )


def distinct_counts(df: DataFrame, columns: list[str], blanks: bool = True) -> DataFrame:
    """Exact distinct values per column; with `blanks` an empty cell counts as a value.

    Two steps of grouping: values are de-duplicated in the map tasks before they are shuffled.
    """
    names = [f"_d{i}" for i in range(len(columns))]
    wide = df.select(*[present(df, c).cast("string").alias(n) for c, n in zip(columns, names)])
    parts = ", ".join(f"'{c}', {n}" for c, n in zip(columns, names))
    long = wide.selectExpr(f"stack({len(columns)}, {parts}) as (column, v)")
    if not blanks:
        long = long.where(F.col("v").isNotNull())
    return long.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"))


def profile_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Counts, moments and linear quartiles per column, exact."""
    columns = columns or df.columns
    numeric = [c for c in columns if is_numeric(df, c) or is_text(df, c)]
    q = quantile_table(
        df, numeric, {"q1": (0.25, "linear"), "median": (0.5, "linear"), "q3": (0.75, "linear")}
    ).drop("n")
    return (
        _moments(df, columns)
        .join(F.broadcast(distinct_counts(df, columns)), "column", "left")
        .join(F.broadcast(q), "column", "left")
        .withColumnRenamed("distinct_count", "unique_count")
    )


def profile_approx(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The profile in a single scan with mergeable sketches for distinct counts and quartiles."""
    from tabsmith.operators.profile_state import profile_state, read_states

    names = ["column", "row_count", "null_count", "unique_count", "mean", "std", "min", "q1", "median", "q3", "max"]
    return read_states(profile_state(df, columns)).select(*names)


def quality_table(df: DataFrame, columns: list[str] | None = None, share: float = 0.7) -> DataFrame:
    """Type, missing share, distinct count, range and a warning per column."""
    columns = columns or df.columns
    t = per_column(
        df,
        columns,
        {
            "share": lambda x, p: F.try_divide(F.count(x), F.count(p)),
            "total": lambda x, p: F.count(F.lit(1)),
            "missing": lambda x, p: F.count_if(p.isNull()),
            "min": lambda x, p: F.min(x),
            "max": lambda x, p: F.max(x),
        },
    ).join(F.broadcast(distinct_counts(df, columns, blanks=False)), "column", "left")
    pct = F.coalesce(F.try_divide(F.col("missing") * 100.0, F.col("total")), F.lit(0.0))
    distinct = F.coalesce(F.col("distinct_count"), F.lit(0))
    return t.select(
        "column",
        F.when(F.col("share") > share, "numeric").otherwise("categorical").alias("type"),
        "total",
        "missing",
        F.round(pct, 2).alias("missing_pct"),
        distinct.alias("distinct_count"),
        F.when(F.col("share") > share, F.col("min")).alias("min"),
        F.when(F.col("share") > share, F.col("max")).alias("max"),
        F.when(pct > 30, "missing").when(distinct <= 1, "constant").otherwise("ok").alias("warning"),
    )


def outlier_count_3sigma(df: DataFrame, columns: list[str], k: float = 3.0) -> DataFrame:
    """Cells further than k sample standard deviations from the column mean."""
    typed = numbers(df, columns)
    fit = typed.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)],
    )
    scored = typed.withColumn("_fit", fit.select(F.struct("*")).scalar())
    far = [
        F.abs(F.col(c) - F.col(f"_fit.m{i}")) > F.lit(k) * F.col(f"_fit.s{i}")
        for i, c in enumerate(columns)
    ]
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"o{i}").alias("outliers")
        )
        for i, c in enumerate(columns)
    ]
    wide = scored.agg(
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.count_if(f).alias(f"o{i}") for i, f in enumerate(far)],
    )
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def health_score(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean missing rate, outlier rate and the 0..100 score."""
    miss = per_column(df, columns, {"missing": missing_rate}).agg(
        F.avg("missing").alias("avg_missing")
    )
    out = outlier_count_3sigma(df, columns).agg(
        F.coalesce(F.try_divide(F.sum("outliers"), F.sum("n")), F.lit(0.0)).alias("outlier_rate")
    )
    both = miss.withColumn("outlier_rate", out.scalar())
    raw = (1 - F.col("avg_missing")) * 40 + (1 - F.col("outlier_rate")) * 40 + 20
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(raw + 0.5)))
    return both.withColumn("score", score.cast("int"))


def pair_corr_matrix(df: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """Long symmetric matrix of pairwise-complete Pearson correlations; 0 without variance."""
    r = F.round(F.coalesce(F.when(~F.isnan("r"), F.col("r")), F.lit(0.0)), digits).alias("r")
    a, b = F.col("a"), F.col("b")
    both = F.array(F.struct(a.alias("a"), b.alias("b"), r), F.struct(b.alias("a"), a.alias("b"), r))
    pairs = pair_moments(numbers(df, columns), columns).select(F.explode(both).alias("c")).select("c.*")
    diagonal = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "a string, b string, r double")
    return diagonal.unionByName(pairs)


def fe_plan(
    df: DataFrame,
    numeric: list[str],
    categorical: list[str],
    threshold: float = 0.8,
    numeric_fill: str = "mean",
) -> DataFrame:
    """Feature plan: (item, name, detail) rows for fills, collinear pairs and dummy counts."""
    both = [*numeric, *categorical]
    fills = per_column(
        df, both, {"missing": lambda x, p: F.count_if(p.isNull())}
    ).select(
        F.lit("fill").alias("item"),
        F.col("column").alias("name"),
        F.when(F.col("missing") == 0, "none")
        .when(F.col("column").isin(numeric), numeric_fill)
        .otherwise("mode")
        .alias("strategy"),
        F.col("missing").cast("double").alias("value"),
    )
    pairs = (
        pair_corr_matrix(df, numeric)
        .where((F.col("a") < F.col("b")) & (F.abs("r") > threshold))
        .select(
            F.lit("collinear").alias("item"),
            F.concat_ws("|", "a", "b").alias("name"),
            F.lit("drop one").alias("strategy"),
            F.col("r").alias("value"),
        )
    )
    dummies = distinct_counts(df, categorical, blanks=False).select(
        F.lit("dummies").alias("item"),
        F.col("column").alias("name"),
        F.lit("one-hot").alias("strategy"),
        F.col("distinct_count").cast("double").alias("value"),
    )
    return fills.unionByName(pairs).unionByName(dummies)
