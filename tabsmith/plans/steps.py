"""Multi-step preparation: a list of steps becomes one lazy plan per dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabsmith.functions.scalars import is_numeric
from tabsmith.operators import cleaning, encoding, relational

ALIASES = {
    "normalize": "minmax",
    "fill_missing": "fill",
    "encode": "label_encode",
    "filter": "filter_text",
    "sql_filter": "filter_text",
    "merge": "join",
}


def _columns(df: DataFrame, p: dict) -> list[str]:
    """The chosen columns; none chosen means every numeric column."""
    if p.get("columns"):
        return list(p["columns"])
    return [c for c in df.columns if is_numeric(df, c)]


def _fill(df: DataFrame, p: dict) -> DataFrame:
    method = p.get("method", "mean")
    if method == "mean":
        return cleaning.fill_mean(df, _columns(df, p))
    if method == "median":
        return cleaning.fill_median(df, _columns(df, p), (0.5, "floor"))
    if method == "mode":
        return cleaning.fill_mode(df, _columns(df, p))
    if method == "constant":
        return cleaning.fill_constant(df, _columns(df, p), p["value"])
    raise ValueError(f"unknown fill method {method!r}")


def _binning(df: DataFrame, p: dict) -> DataFrame:
    if p.get("method", "width") == "quantile":
        return encoding.quantile_bins(df, _columns(df, p), p.get("bins", 3))
    for c in _columns(df, p):
        df = encoding.equal_width_bins(df, c, p.get("bins", 5), f"{c}_bin")
    return df


STEPS = {
    "minmax": lambda df, p: cleaning.minmax(df, _columns(df, p), p.get("min", 0.0), p.get("max", 1.0)),
    "standardize": lambda df, p: cleaning.standardize(df, _columns(df, p)),
    "fill": _fill,
    "fill_mean": lambda df, p: _fill(df, {**p, "method": "mean"}),
    "label_encode": lambda df, p: encoding.label_encode(df, list(p["columns"]), p["order"]),
    "one_hot": lambda df, p: encoding.one_hot(df, list(p["columns"])),
    "binning": _binning,
    "add_column": lambda df, p: relational.add_column_expr(df, p["name"], p["formula"]),
    "filter_compare": lambda df, p: relational.filter_compare(df, p["column"], p["op"], p["value"]),
    "filter_text": lambda df, p: relational.filter_text(df, p["condition"]),
    "filter_range": lambda df, p: relational.filter_range(df, p["filters"]),
    "join": lambda df, p: relational.join(
        df, p["right"], p["left_key"], p["right_key"], p.get("how", "inner")
    ),
}


def run_steps(df: DataFrame, steps: list[dict]) -> DataFrame:
    """Apply `{"type": ..., **params}` steps in order. An unknown type is an error."""
    if not steps:
        raise ValueError("no steps given")
    for step in steps:
        kind = ALIASES.get(step.get("type"), step.get("type"))
        if kind in STEPS:
            df = STEPS[kind](df, step)
        elif kind in cleaning.OPERATIONS:
            df = cleaning.clean(df, kind, _columns(df, step))
        else:
            raise ValueError(f"unknown step {step.get('type')!r}")
    return df


def apply_to_many(frames: dict[str, DataFrame], steps: list[dict]) -> dict[str, DataFrame]:
    """The same steps on several datasets, one independent lazy plan each."""
    if not frames:
        raise ValueError("no datasets given")
    return {name: run_steps(df, steps) for name, df in frames.items()}
