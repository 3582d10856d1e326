"""Single-step cleaning operations on chosen columns.

Statistics come from one small aggregate that Spark evaluates as a scalar subquery of the same
plan (order statistics are fitted first); applying them is a narrow projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.scalars import (
    all_of, any_of, is_numeric, is_text, number, present, round_half_up,
)
from tabsmith.operators.order_stats import quantile_values

STORED_DIGITS = 4
NUMERIC_GATE = 0.5


def numeric_columns(df: DataFrame, columns: list[str], gate: float = NUMERIC_GATE) -> list[str]:
    """The chosen columns whose share of numeric cells exceeds the gate.

    Typed numeric columns pass without a scan.
    """
    unsure = [c for c in columns if is_text(df, c)]
    share = {}
    if unsure:
        row = df.agg(
            *[F.try_divide(F.count(number(df, c)), F.count(F.lit(1))).alias(c) for c in unsure]
        ).first()
        share = row.asDict()
    return [c for c in columns if is_numeric(df, c) or (share.get(c) or 0.0) > gate]


def _with_fit(df: DataFrame, aggs: dict[str, Column]) -> DataFrame:
    """Attach one aggregated struct as a scalar subquery in column `_fit`."""
    fit = df.agg(*[a.alias(k) for k, a in aggs.items()])
    return df.withColumn("_fit", fit.select(F.struct("*")).scalar())


def _store(c: Column) -> Column:
    return F.round(c, STORED_DIGITS)


def _apply(df: DataFrame, new: dict[str, Column], keep: list[str]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in keep])


def fill_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    cols = numeric_columns(df, columns)
    if not cols:
        return df
    fit = _with_fit(df, {f"f{i}": F.avg(number(df, c)) for i, c in enumerate(cols)})
    new = {
        c: F.coalesce(number(df, c), _store(F.col(f"_fit.f{i}"))) for i, c in enumerate(cols)
    }
    return _apply(fit, new, df.columns)


def fill_median(df: DataFrame, columns: list[str], rule: tuple = (0.5, "linear")) -> DataFrame:
    cols = numeric_columns(df, columns)
    if not cols:
        return df
    med = quantile_values(df, cols, {"m": rule})
    new = {
        c: F.coalesce(number(df, c), _store(F.lit(med[c]["m"]))) for c in cols if c in med
    }
    return _apply(df, new, df.columns)


def fill_constant(df: DataFrame, columns: list[str], value) -> DataFrame:
    new = {}
    for c in columns:
        cell = number(df, c) if is_numeric(df, c) else present(df, c)
        new[c] = F.coalesce(cell, F.lit(value).cast(df.schema[c].dataType))
    return _apply(df, new, df.columns)


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent value per column as text; ties go to the smallest value."""
    names = [f"_v{i}" for i in range(len(columns))]
    wide = df.select(*[present(df, c).cast("string").alias(n) for c, n in zip(columns, names)])
    parts = ", ".join(f"'{c}', {n}" for c, n in zip(columns, names))
    counts = (
        wide.selectExpr(f"stack({len(columns)}, {parts}) as (column, v)")
        .where("v is not null")
        .groupBy("column", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.groupBy("column").agg(F.min_by("v", F.struct(-F.col("n"), "v")).alias("mode"))


def fill_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    found = {r["column"]: r["mode"] for r in modes(df, columns).collect()}
    new = {
        c: F.coalesce(present(df, c), F.lit(found[c]).cast(df.schema[c].dataType))
        for c in columns
        if c in found
    }
    return _apply(df, new, df.columns)


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(all_of([present(df, c).isNotNull() for c in columns]))


def iqr_clip(df: DataFrame, columns: list[str], k: float = 1.5) -> DataFrame:
    """Clamp to the Tukey fences with quartiles at element floor(n*p)."""
    cols = numeric_columns(df, columns)
    q = quantile_values(df, cols, {"q1": (0.25, "floor"), "q3": (0.75, "floor")})
    new = {}
    for c in cols:
        if c in q:
            iqr = q[c]["q3"] - q[c]["q1"]
            lo, hi = q[c]["q1"] - k * iqr, q[c]["q3"] + k * iqr
            x = number(df, c)
            new[c] = F.when(x < lo, _store(F.lit(lo))).when(x > hi, _store(F.lit(hi))).otherwise(x)
    return _apply(df, new, df.columns)


def _centre_and_spread(df: DataFrame, cols: list[str]) -> DataFrame:
    aggs = {f"m{i}": F.avg(number(df, c)) for i, c in enumerate(cols)}
    aggs |= {f"s{i}": F.stddev_samp(number(df, c)) for i, c in enumerate(cols)}
    return _with_fit(df, aggs)


def zscore_filter(df: DataFrame, columns: list[str], limit: float = 3.0) -> DataFrame:
    """Drop rows with any |z| above the limit; NULLs and constant columns pass."""
    cols = numeric_columns(df, columns)
    fit = _centre_and_spread(df, cols)
    far = [
        F.coalesce(
            F.abs(number(df, c) - F.col(f"_fit.m{i}")) > F.lit(limit) * F.col(f"_fit.s{i}"),
            F.lit(False),
        )
        & (F.col(f"_fit.s{i}") > 0)
        for i, c in enumerate(cols)
    ]
    return fit.where(~F.coalesce(any_of(far), F.lit(False))).drop("_fit")


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    cols = numeric_columns(df, columns)
    fit = _centre_and_spread(df, cols)
    new = {}
    for i, c in enumerate(cols):
        x, s = number(df, c), F.col(f"_fit.s{i}")
        new[c] = F.when(
            x.isNotNull(),
            F.when(s > 0, _store((x - F.col(f"_fit.m{i}")) / s)).otherwise(F.lit(0.0)),
        )
    return _apply(fit, new, df.columns)


def minmax(
    df: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0
) -> DataFrame:
    """Scale to [low, high]; a constant column becomes `low`."""
    cols = numeric_columns(df, columns)
    aggs = {f"a{i}": F.min(number(df, c)) for i, c in enumerate(cols)}
    aggs |= {f"z{i}": F.max(number(df, c)) for i, c in enumerate(cols)}
    fit = _with_fit(df, aggs)
    new = {}
    for i, c in enumerate(cols):
        x, a, z = number(df, c), F.col(f"_fit.a{i}"), F.col(f"_fit.z{i}")
        scaled = F.lit(low) + (x - a) / (z - a) * F.lit(high - low)
        new[c] = F.when(
            x.isNotNull(), F.when(z > a, _store(scaled)).otherwise(F.lit(float(low)))
        )
    return _apply(fit, new, df.columns)


def log1p(df: DataFrame, columns: list[str]) -> DataFrame:
    cols = numeric_columns(df, columns)
    new = {}
    for c in cols:
        x = number(df, c)
        new[c] = F.when(x >= 0, _store(F.log1p(x))).otherwise(x)
    return _apply(df, new, df.columns)


def absolute(df: DataFrame, columns: list[str]) -> DataFrame:
    cols = numeric_columns(df, columns)
    return _apply(df, {c: F.abs(number(df, c)) for c in cols}, df.columns)


def round_nearest(df: DataFrame, columns: list[str]) -> DataFrame:
    cols = numeric_columns(df, columns)
    return _apply(df, {c: round_half_up(number(df, c)) for c in cols}, df.columns)


def _text(df: DataFrame, columns: list[str], fn) -> DataFrame:
    return _apply(df, {c: fn(F.col(f"`{c}`")) for c in columns if is_text(df, c)}, df.columns)


def trim(df: DataFrame, columns: list[str]) -> DataFrame:
    return _text(df, columns, F.trim)


def lowercase(df: DataFrame, columns: list[str]) -> DataFrame:
    return _text(df, columns, F.lower)


def uppercase(df: DataFrame, columns: list[str]) -> DataFrame:
    return _text(df, columns, F.upper)


def to_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Typed double columns; cells that do not parse are NULL (see reject_counts)."""
    return _apply(df, {c: number(df, c) for c in columns}, df.columns)


def reject_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    from tabsmith.operators.profiling import per_column

    return per_column(
        df,
        columns,
        {
            "parsed": lambda x, p: F.count(x),
            "rejected": lambda x, p: F.count_if(p.isNotNull() & x.isNull()),
        },
    )


def drop_duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row per key in the given order; partial minima before the shuffle."""
    if not order:
        raise ValueError("drop_duplicates needs an explicit order")
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_row")).select("_row.*")


def change_counts(before: DataFrame, after: DataFrame, key: list[str], columns: list[str]):
    """Removed rows and modified cells between two versions that share a unique key."""
    a = before.select(*key, *[F.col(f"`{c}`").cast("string").alias(f"a_{c}") for c in columns])
    b = after.select(
        *key, F.lit(1).alias("_kept"), *[F.col(f"`{c}`").cast("string").alias(f"b_{c}") for c in columns]
    )
    diff = F.lit(0)
    for c in columns:
        diff = diff + (~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).cast("int")
    return a.join(b, key, "left").agg(
        F.count_if(F.col("_kept").isNull()).alias("removed"),
        F.sum(F.when(F.col("_kept").isNotNull(), diff).otherwise(0)).alias("modified"),
    )


OPERATIONS = {
    "fill_mean": fill_mean,
    "fill_median": fill_median,
    "fill_mode": fill_mode,
    "drop_missing": drop_missing,
    "iqr_clip": iqr_clip,
    "zscore_filter": zscore_filter,
    "standardize": standardize,
    "minmax": minmax,
    "log1p": log1p,
    "abs": absolute,
    "round": round_nearest,
    "trim": trim,
    "lowercase": lowercase,
    "uppercase": uppercase,
    "to_numeric": to_numeric,
}


def clean(df: DataFrame, operation: str, columns: list[str]) -> DataFrame:
    """Run one operation by name; an unknown name is an error."""
    if operation not in OPERATIONS:
        raise ValueError(f"unknown cleaning operation {operation!r}")
    return OPERATIONS[operation](df, columns)
