"""The industrial-effect report: a composition of preparation, forest, rules and dependence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.scalars import number
from tabsmith.operators import features, models, trees as tree_tables
from tabsmith.operators.relational import derive_expr
from tabsmith.session import materialize


def industrial_effect(
    df: DataFrame, target: str, columns: list[str], key: list[str], expressions: str = "",
    focus: list[str] | None = None, test_size: float = 0.2, trees: int = 100, rule_depth: int = 3,
    higher_better: bool = True,
) -> dict[str, DataFrame]:
    """Partial dependence covers `focus`, or every input. Frames `metrics`, `importance`, `rules`, `pdp`, `warnings`, and all of them as `report`."""
    before = set(df.columns)
    df, problems = derive_expr(df, expressions)
    columns = [*columns, *[c for c in df.columns if c not in before]]
    numeric, categorical = features.split_roles(df, columns)
    data = df.withColumn("label", number(df, target)).where("label is not null")
    train, test = features.split_holdout(data, key, test_size)
    prep = features.fit_features(train, numeric, categorical, scale="standard")
    ready = features.apply_features(prep, train, numeric, categorical)
    names = features.feature_names(prep, train, numeric, categorical)
    train = materialize(ready.select("features", "label"), "train")
    test = materialize(
        features.apply_features(prep, test, numeric, categorical).select("features", "label"), "test"
    )
    model = models.rf_regression(trees).fit(train)
    metrics = models.evaluate_regression(model, train, test)
    found = metrics.collect()  # a row a part: the report need not score all rows again
    metrics = df.sparkSession.createDataFrame(found, metrics.schema)
    scores = {r["part"]: r["r2"] for r in found}
    importance = models.importance_table(model, names, train)
    rules = models.joint_rules(train.unionByName(test), names, rule_depth, higher_better)
    pdp = None
    forest = tree_tables.from_forest(df.sparkSession, model, len(names))
    for f in focus or names:
        slot = names.index(f)
        one = tree_tables.dependence_table(train, forest, slot, f, models.pdp_grid(train, slot))
        pdp = one if pdp is None else pdp.unionByName(one)
    notes = [("skipped formula", p) for p in problems]
    if scores["train"] - scores["test"] > 0.15:
        notes.append(("overfit", "train R2 exceeds test R2 by more than 0.15"))
    if scores["test"] < 0.3:
        notes.append(("weak", "R2 below 0.3: the inputs hardly explain the target"))
    elif scores["test"] < 0.5:
        notes.append(("moderate", "R2 below 0.5: add operating conditions or rows"))
    warnings = df.sparkSession.createDataFrame(notes, "code string, message string")

    def rows(section: str, frame: DataFrame, name, value) -> DataFrame:
        return frame.select(F.lit(section).alias("section"), name.cast("string").alias("name"), value.cast("double").alias("value"))

    report = (
        rows("r2", metrics, F.col("part"), F.col("r2"))
        .unionByName(rows("importance", importance, F.col("feature"), F.col("importance")))
        .unionByName(rows("rule", rules, F.col("rule"), F.col("effect")))
        .unionByName(rows("pdp", pdp, F.concat_ws("=", "feature", F.round("grid", 4)), F.col("response")))
        .unionByName(rows("warning", warnings, F.col("message"), F.lit(None)))
    )
    return {"metrics": metrics, "importance": importance, "rules": rules, "pdp": pdp, "warnings": warnings, "report": report}
