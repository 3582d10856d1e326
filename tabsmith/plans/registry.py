"""Self-describing operators: named slots with accepted column types and arity."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tabsmith.functions.scalars import is_numeric, is_temporal
from tabsmith.operators import association, charts, concordance, hypothesis, profiling


@dataclass(frozen=True)
class Slot:
    name: str
    types: tuple[str, ...] = ("numeric",)
    least: int = 1
    most: int | None = 1


@dataclass(frozen=True)
class Operator:
    id: str
    category: str
    slots: tuple[Slot, ...]
    run: Callable[..., DataFrame]


ANY = ("numeric", "categorical", "datetime")
MANY = Slot("columns", ("numeric",), 1, None)
PAIR = (Slot("a"), Slot("b"))

REGISTRY: dict[str, Operator] = {
    o.id: o
    for o in (
        Operator("profile_columns", "profile", (Slot("columns", ANY, 1, None),), profiling.profile_columns),
        Operator("health_score", "profile", (MANY,), profiling.health_score),
        Operator("descriptive", "describe", (MANY,), charts.descriptive),
        Operator("frequency", "describe", (Slot("column", ANY),), charts.frequency),
        Operator("corr_pearson", "association", (Slot("columns", ("numeric",), 2, None),), association.corr_pearson),
        Operator("corr_spearman", "association", PAIR, association.corr_spearman),
        Operator("corr_kendall", "association", PAIR, concordance.corr_kendall),
        Operator("corr_distance", "association", PAIR, concordance.corr_distance),
        Operator("cramers_v", "association", (Slot("a", ANY), Slot("b", ANY)), association.cramers_v),
        Operator("ttest_one", "test", (Slot("column"),), hypothesis.ttest_one),
        Operator("ttest_two", "test", (Slot("group", ANY), Slot("column")), hypothesis.ttest_two),
        Operator("anova_oneway", "test", (Slot("factor", ANY), Slot("column")), hypothesis.anova_oneway),
        Operator("chi_square", "test", (Slot("a", ANY), Slot("b", ANY)), hypothesis.chi_square),
        Operator("shapiro_francia", "test", (Slot("column"),), hypothesis.shapiro_francia),
        Operator("cronbach_alpha", "reliability", (Slot("items", ("numeric",), 2, None),), hypothesis.cronbach_alpha),
    )
}


def column_type(df: DataFrame, name: str) -> str:
    if is_numeric(df, name):
        return "numeric"
    return "datetime" if is_temporal(df, name) else "categorical"


def register(operator: Operator) -> None:
    """Add an operator of one's own."""
    if operator.id in REGISTRY:
        raise ValueError(f"operator {operator.id} exists")
    REGISTRY[operator.id] = operator


def check_call(op: Operator, df: DataFrame, variables: dict[str, list[str]]) -> None:
    """Raise when a slot has too few or too many columns, or one of an unsuitable type."""
    for slot in op.slots:
        given = variables.get(slot.name, [])
        if len(given) < slot.least or (slot.most is not None and len(given) > slot.most):
            raise ValueError(f"{op.id}: slot {slot.name} takes {slot.least}..{slot.most or 'many'} columns")
        for c in given:
            if c not in df.columns:
                raise ValueError(f"{op.id}: no column {c}")
            if column_type(df, c) not in slot.types:
                raise ValueError(f"{op.id}: column {c} is {column_type(df, c)}, not {slot.types}")


def run(op_id: str, df: DataFrame, variables: dict[str, list[str]], **params) -> DataFrame:
    """Check and call an operator; single-column slots are passed as a name."""
    op = REGISTRY.get(op_id)
    if op is None:
        raise ValueError(f"unknown operator {op_id!r}")
    check_call(op, df, variables)
    args = {
        s.name: variables[s.name][0] if s.most == 1 else list(variables[s.name])
        for s in op.slots
        if s.name in variables
    }
    return op.run(df, **args, **params)
