"""Association rules between process bins and a target bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.scalars import is_numeric, number, present
from tabsmith.operators.encoding import bin_labels, case_chain, quantile_cuts
from tabsmith.operators.fptree import frequent_itemsets
from tabsmith.session import materialize

JOINER = " & "
SEPARATOR = "\u0001"
FILLED = "_filled"


def binned_items(
    df: DataFrame, columns: list[str], bins: int = 3, impute: str | None = None
) -> tuple[DataFrame, dict[str, list[str]]]:
    """Replace the columns by item tokens `column:label`; missing cells are NULL.

    Returns the frame and the ordered labels of each numeric column.
    """
    from tabsmith.operators import cleaning

    numeric = [c for c in columns if is_numeric(df, c)]
    if impute == "mean":
        df = cleaning.fill_mean(df, numeric)
    elif impute == "median":
        df = cleaning.fill_median(df, numeric)
    cuts = quantile_cuts(df, numeric, bins) if numeric else {}
    df = df.withColumns({c: number(df, c) for c in numeric})
    new, labels = {}, {}
    for c in columns:
        if c in cuts:
            labels[c] = [f"{c}:{v}" for v in bin_labels(cuts[c])]
            new[c] = case_chain(F.col(f"`{c}`"), cuts[c], labels[c])
        else:
            cell = present(df, c).cast("string")
            new[c] = F.when(cell.isNotNull(), F.concat(F.lit(f"{c}:"), cell))
    # Counted on the cells, not on the tokens: a filter on tokens would be pushed below them and
    # evaluate every bin expression twice.
    filled = F.lit(0)
    for c in columns:
        filled = filled + (F.col(f"`{c}`") if c in cuts else present(df, c)).isNotNull().cast("int")
    return df.withColumn(FILLED, filled).withColumns(new), labels


def _item_list(columns: list[str]) -> Column:
    """Items of a row as an array; concat_ws leaves NULLs out and stays in generated code."""
    return F.split(F.concat_ws(SEPARATOR, *[F.col(f"`{c}`") for c in columns]), SEPARATOR)


def transactions(items: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """Item list per row; missing items dropped; at least two items."""
    return items.where(F.col(FILLED) >= 2).select(*keep, _item_list(columns).alias("items"))


def count_baskets(items: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct baskets (sorted arrays) with their row counts `c`.

    Binned rows repeat a lot, so rows are grouped on the plain token columns, partially in the map
    tasks, and arrays are built for the distinct combinations only.
    """
    g = items.where(F.col(FILLED) >= 2).groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias("_rows"))
    return materialize(g.select(F.array_sort(_item_list(columns)).alias("items"), F.col("_rows").alias("c")), "baskets")


def _key(items: Column) -> Column:
    return F.array_join(items, JOINER)


def target_rules(
    counted: DataFrame, target: str, min_support: float = 0.05, min_confidence: float = 0.5,
    itemsets: DataFrame | None = None,
) -> DataFrame:
    """Rules X -> one target item with confidence and lift, trivial lifts removed.

    Counts of the two sides are looked up in the itemset table, where every subset of a frequent
    set is present; the data is not read again.
    """
    sets = itemsets if itemsets is not None else frequent_itemsets(counted, min_support)
    total = counted.agg(F.sum("c"))
    prefix = f"{target}:"
    hit = F.filter("items", lambda i: i.startswith(F.lit(prefix)))
    pairs = sets.where((F.size("items") >= 2) & (F.size(hit) == 1)).select(
        F.filter("items", lambda i: ~i.startswith(F.lit(prefix))).alias("lhs"),
        F.get(hit, F.lit(0)).alias("rhs"),
        F.col("n").alias("count_xy"),
    )
    ones = sets.where(F.size("items") == 1).select(F.get("items", F.lit(0)).alias("rhs"), F.col("n").alias("count_y"))
    joined = (
        pairs.join(sets.select(F.col("items").alias("lhs"), F.col("n").alias("count_x")), "lhs")
        .join(ones, "rhs")
        .withColumn("_x", _key(F.col("lhs")))
        .withColumn("total", total.scalar())
    )
    confidence = F.col("count_xy") / F.col("count_x")
    lift = F.col("count_xy").cast("double") * F.col("total") / (F.col("count_x").cast("double") * F.col("count_y"))
    return (
        joined.select(
            F.col("_x").alias("lhs"), "rhs", "count_x", "count_xy", "count_y", "total",
            confidence.alias("confidence"), lift.alias("lift"),
        )
        .where((F.col("confidence") >= min_confidence) & (F.abs(F.col("lift") - 1) >= 0.05))
    )


def top_rules(rules: DataFrame, n: int | None = 30) -> DataFrame:
    """The strongest rules; None as `n` returns all."""
    ordered = rules.orderBy(F.desc("lift"), F.desc("confidence"), "lhs", "rhs")
    return ordered if n is None else ordered.limit(n)


def rule_sides(target_labels: list[str], higher_better: bool = True) -> tuple[str, str]:
    """(favourable, unfavourable) target items from the ordered labels."""
    low, high = target_labels[0], target_labels[-1]
    return (high, low) if higher_better else (low, high)


def best_worst_rule(rules: DataFrame, favourable: str, unfavourable: str) -> DataFrame:
    """The strongest rule towards each of the two target items."""
    side = F.when(F.col("rhs") == favourable, "best").when(F.col("rhs") == unfavourable, "worst")
    w = Window.partitionBy("side").orderBy(F.desc("lift"), F.desc("confidence"), "lhs")
    return (
        rules.withColumn("side", side)
        .where(F.col("side").isNotNull())
        .withColumn("_r", F.row_number().over(w))
        .where("_r = 1")
        .drop("_r")
    )


def rule_grade(rules: DataFrame, favourable: str, unfavourable: str) -> DataFrame:
    good, bad = F.col("rhs") == favourable, F.col("rhs") == unfavourable
    grade = (
        F.when((F.col("lift") > 1.5) & good, "strong favourable")
        .when((F.col("lift") > 1.5) & bad, "strong unfavourable")
        .when((F.col("lift") > 1.0) & good, "favourable")
        .when((F.col("lift") > 1.0) & bad, "unfavourable")
        .otherwise("neutral")
    )
    return rules.withColumn("grade", grade)
