"""Filters, formula columns, joins and set operations with spreadsheet-like rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.scalars import all_of, is_numeric, is_text, number

# Functions a formula may use.
FORMULA_FUNCTIONS = {
    "abs", "ceil", "coalesce", "cos", "exp", "floor", "greatest", "least", "ln", "log10",
    "pow", "round", "sign", "sin", "sqrt", "tan", "try_divide",
}
_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([A-Za-z_]\w*)|(`[^`]+`)|(\*\*|[-+*/%(),]))")


def formula_tokens(df: DataFrame, formula: str) -> list[str]:
    """Tokens of a formula: numbers, column names (quoted in the result), arithmetic and the listed functions.

    `**` is refused: the functions hold pow.
    """
    at, out = 0, []
    names = {c.lower() for c in df.columns}
    text = formula.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.group(4) == "**":
            raise ValueError(f"unexpected character in formula at {text[at:]!r}")
        num, word, quoted, sign = m.groups()
        if word is not None:
            if text[m.end():].lstrip()[:1] == "(":
                if word.lower() not in FORMULA_FUNCTIONS:
                    raise ValueError(f"unknown name in formula: {word}")
                out.append(word)
            elif word.lower() in names:
                out.append(f"`{word}`")
            else:
                raise ValueError(f"unknown name in formula: {word}")
        elif quoted is not None and quoted.strip("`").lower() not in names:
            raise ValueError(f"unknown column in formula: {quoted}")
        else:
            out.append(num or quoted or sign)
        at = m.end()
    return out


def check_formula(df: DataFrame, formula: str) -> str:
    """The formula as SQL text, or ValueError."""
    return " ".join(formula_tokens(df, formula))


def add_column_expr(df: DataFrame, name: str, formula: str, strict: bool = False) -> DataFrame:
    """Add a formula over column names, evaluated by Spark SQL.

    A division by zero is NULL; with `strict` it is an error.
    """
    tokens = formula_tokens(df, formula)
    if not strict:
        tokens = _guard_division(tokens)
    return df.withColumn(name, F.expr(" ".join(tokens)).cast("double"))


def _guard_division(tokens: list[str]) -> list[str]:
    """Make the right operand of / and % NULL when it is zero."""
    out, i = [], 0
    while i < len(tokens):
        out.append(tokens[i])
        i += 1
        if out[-1] in ("/", "%"):
            end = _operand_end(tokens, i)
            out += ["nullif(", *_guard_division(tokens[i:end]), ", 0)"]
            i = end
    return out


def _operand_end(tokens: list[str], i: int) -> int:
    """End of the factor that begins at token i: signs, then a name, number, call or bracket."""
    while i < len(tokens) and tokens[i] in ("-", "+"):
        i += 1
    if i + 1 < len(tokens) and tokens[i] != "(" and tokens[i + 1] == "(":
        i += 1
    if i < len(tokens) and tokens[i] == "(":
        depth = 0
        while i < len(tokens):
            depth += (tokens[i] == "(") - (tokens[i] == ")")
            i += 1
            if depth == 0:
                break
        return i
    return i + 1


def derive_expr(df: DataFrame, lines: str) -> tuple[DataFrame, list[str]]:
    """Apply `name = formula` lines in order; a bad line is reported and skipped."""
    problems = []
    for raw in (s.strip() for s in lines.split("\n")):
        if not raw:
            continue
        name, _, formula = raw.partition("=")
        if not formula:
            name, formula = raw.replace(" ", ""), raw
        try:
            df = add_column_expr(df, name.strip(), formula)
        except Exception as e:
            problems.append(f"{raw}: {str(e).splitlines()[0]}")
    return df, problems


def predicate(df: DataFrame, column: str, op: str, value) -> Column:
    """A typed comparison: numeric columns compare as numbers, text columns as text for
    equality and as numbers for order."""
    c = F.col(f"`{column}`")
    text = is_text(df, column)
    if op == "contains":
        return F.lower(c.cast("string")).contains(str(value).lower())
    if op in ("==", "="):
        return c == F.lit(str(value) if text else value)
    if op == "!=":
        return ~c.eqNullSafe(F.lit(str(value) if text else value))
    left = number(df, column) if text else c
    compare = {
        ">": left > F.lit(value),
        "<": left < F.lit(value),
        ">=": left >= F.lit(value),
        "<=": left <= F.lit(value),
    }
    if op not in compare:
        raise ValueError(f"unknown comparison {op!r}")
    return compare[op]


def filter_compare(df: DataFrame, column: str, op: str, value) -> DataFrame:
    return df.where(predicate(df, column, op, value))


_FREE = re.compile(r"^\s*(.+?)\s*([><=])\s*(-?[\d.]+)\s*$")


def filter_text(df: DataFrame, condition: str) -> DataFrame:
    """`column op number` with op > < =; rows whose cell is not a number are kept."""
    m = _FREE.match(condition)
    if not m or m.group(1) not in df.columns:
        raise ValueError(f"cannot read condition {condition!r}")
    name, op, raw = m.groups()
    x = number(df, name)
    v = F.lit(float(raw))
    hit = {">": x > v, "<": x < v, "=": x == v}[op]
    return df.where(x.isNull() | hit)


def filter_range(df: DataFrame, filters: dict[str, dict]) -> DataFrame:
    """ANDed filters per column: min, max, eq, contains (case-insensitive)."""
    conds = []
    for name, f in filters.items():
        for key, op in (("min", ">="), ("max", "<="), ("eq", "=="), ("contains", "contains")):
            if f.get(key) is not None:
                conds.append(predicate(df, name, op, f[key]))
    return df.where(all_of(conds)) if conds else df


JOIN_KINDS = {
    "inner": "inner", "left": "left_outer", "right": "right_outer", "outer": "full_outer",
    "full": "full_outer", "anti": "left_anti", "semi": "left_semi",
}


def join(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner"
) -> DataFrame:
    """Equi-join with 1:N expansion; on a name clash the left column wins.

    Numeric keys of any two types compare as numbers. Against a text key a number is written as text,
    whole ones without decimals; other unlike types compare as text. Spark chooses the join strategy
    at run time, including the splitting of skewed keys.
    """
    if how not in JOIN_KINDS:
        raise ValueError(f"unknown join kind {how!r}")
    kind = JOIN_KINDS[how]
    lk, rk = left[left_key], right[right_key]
    if left.schema[left_key].dataType != right.schema[right_key].dataType:
        if not (is_numeric(left, left_key) and is_numeric(right, right_key)):
            lk, rk = _key_text(left, left_key), _key_text(right, right_key)
    joined = left.join(right, lk == rk, kind)
    if kind in ("left_anti", "left_semi"):
        return joined
    keep = [right[c] for c in right.columns if c not in left.columns]
    if kind in ("full_outer", "right_outer"):
        clash = set(left.columns) & set(right.columns)
        mine = [
            F.coalesce(left[c], right[c]).alias(c) if c in clash else left[c] for c in left.columns
        ]
        return joined.select(*mine, *keep)
    return joined.select(*[left[c] for c in left.columns], *keep)


def _key_text(df: DataFrame, name: str) -> Column:
    """A key as text; whole numbers are written without decimals or exponent."""
    c = df[name]
    if not is_numeric(df, name):
        return c.cast("string")
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))


def append(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def unpivot(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    return df.unpivot(ids, columns, "attribute", "value")


def pivot(df: DataFrame, ids: list[str], column: str, value: str, levels: list) -> DataFrame:
    """Wide form with the levels given, so that no extra pass is needed to find them."""
    return df.groupBy(*ids).pivot(column, levels).agg(F.sum(value))


def intersect_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of `a` present in `b`, NULLs matching, duplicates kept."""
    cond = all_of([a[c].eqNullSafe(b[d]) for c, d in zip(a.columns, b.columns)])
    return a.join(b, cond, "left_semi")


def except_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of `a` absent from `b`, NULLs matching, duplicates kept."""
    cond = all_of([a[c].eqNullSafe(b[d]) for c, d in zip(a.columns, b.columns)])
    return a.join(b, cond, "left_anti")


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    common = [c for c in a.columns if c in b.columns]
    if not common:
        raise ValueError("a natural join needs a common column")
    return a.join(b, common, how)
