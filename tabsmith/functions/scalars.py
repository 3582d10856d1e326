"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.StringType, T.CharType, T.VarcharType))


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def is_temporal(df: DataFrame, name: str) -> bool:
    return isinstance(
        df.schema[name].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)
    )


def present(df: DataFrame, name: str) -> Column:
    """The cell, with blank text as NULL."""
    c = F.col(f"`{name}`")
    if is_text(df, name):
        return F.when(F.trim(c) != "", c)
    return c


def number(df: DataFrame, name: str) -> Column:
    """The cell as a finite double; anything else is NULL.

    Numeric columns are only widened, so filters on them still reach the scan.
    """
    c = F.col(f"`{name}`")
    if is_numeric(df, name):
        d = c.cast("double")
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)
        return d
    if is_text(df, name):
        # A failed parse is costly, so only cells that look like a number are cast.
        d = F.expr(f"try_cast(`{name}` as double)")
        parsed = F.when(c.rlike(NUMBER_PATTERN), d)
        return F.when(F.abs(parsed) != float("inf"), parsed)
    return F.lit(None).cast("double")


def numbers(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """Only the given columns, converted by `number` once per row, beside those to keep.

    Aggregates over the result refer to plain columns, which keeps generated code small.
    """
    return df.select(*keep, *[number(df, c).alias(c) for c in dict.fromkeys(columns)])


def round_half_up(c: Column) -> Column:
    """Nearest integer with halves going up, also below zero."""
    return F.floor(c + F.lit(0.5)).cast("double")


def safe_div(a: Column, b: Column, otherwise=None) -> Column:
    r = F.try_divide(a, b)
    return r if otherwise is None else F.coalesce(r, F.lit(otherwise))


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def order_axis(df: DataFrame, name: str) -> Column:
    """A double that never decreases when the column increases."""
    c = F.col(f"`{name}`")
    dt = df.schema[name].dataType
    if isinstance(dt, T.NumericType):
        return c.cast("double")
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(dt, T.TimestampType):
        # the instant, not the clock: the hour that a time zone repeats must not go back
        return F.unix_micros(c).cast("double") / 1e6
    if isinstance(dt, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)").cast("double") / 1e6
    raise TypeError(f"cannot slice on column {name} of type {dt.simpleString()}")


# Scalar functions in the vocabulary of spreadsheet-like measures.


def divide(a: Column, b: Column, alternate=None) -> Column:
    return safe_div(a, b, alternate)


def ceiling_to(x: Column, step) -> Column:
    return F.ceil(x / F.lit(float(step))) * F.lit(float(step))


def floor_mod(x: Column, n) -> Column:
    n = F.lit(n)
    return x - n * F.floor(x / n)


def switch(c: Column, cases: dict, otherwise=None) -> Column:
    out = None
    for k, v in cases.items():
        out = F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(otherwise))


def is_blank(c: Column) -> Column:
    return c.isNull()


def single_value(c: Column, alternate=None) -> Column:
    """Aggregate: the value when the group holds exactly one, else the alternate."""
    return F.when(
        (F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1))), F.max(c)
    ).otherwise(F.lit(alternate))


def has_one_value(c: Column) -> Column:
    """Aggregate: whether the group holds exactly one distinct value, blanks counting as one."""
    return ((F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1)))) | (F.count(c) == 0)
