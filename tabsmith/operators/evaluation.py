"""Model evaluation as aggregates over scored frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.operators.order_stats import cumulative_counts


def error_slices(df: DataFrame, actual: str, predicted: str, segments: list[str]) -> DataFrame:
    """Count, mean absolute error and bias per segment."""
    err = F.col(predicted) - F.col(actual)
    return df.groupBy(*segments).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.avg(err).alias("bias")
    )


def metrics_regression(
    df: DataFrame, actual: str, predicted: str, keys: list[str] = ()
) -> DataFrame:
    """R2, RMSE and MAE; a constant target scores 1 when matched exactly, else 0."""
    y, p = F.col(actual), F.col(predicted)
    both = y.isNotNull() & p.isNotNull()
    g = df.where(both).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((y - p) * (y - p)).alias("_res"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("_tot"),
        F.avg(F.abs(y - p)).alias("mae"),
    )
    r2 = F.when(
        F.col("_tot") > 0, 1 - F.col("_res") / F.greatest(F.col("_tot"), F.lit(1e-10))
    ).otherwise(F.when(F.col("_res") < 1e-12, 1.0).otherwise(0.0))
    return g.select(*keys, "n", r2.alias("r2"), F.sqrt(F.col("_res") / F.col("n")).alias("rmse"), "mae")


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def metrics_classification(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, and the overall accuracy."""
    c = confusion(df, label, predicted)
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    by_label = c.groupBy(F.col("label").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(hit).alias("tp")
    )
    by_pred = c.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("chosen"))
    overall = c.agg(F.try_divide(F.sum(hit), F.sum("n")))
    zero = F.lit(0)
    t = by_label.join(by_pred, "class", "full_outer").select(
        "class",
        F.coalesce("support", zero).alias("support"),
        F.coalesce("tp", zero).alias("tp"),
        F.coalesce("chosen", zero).alias("chosen"),
    )
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("chosen")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return t.select(
        "class", "support", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
        overall.scalar().alias("accuracy"),
    )


def auc(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """Area under the ROC curve by rank sum with tied scores averaged."""
    t = cumulative_counts(
        df.withColumn("_pos", positive.cast("int")),
        score,
        {"n": F.count(F.lit(1)), "p": F.sum("_pos")},
    )
    rank = F.col("n_before") + (F.col("n") + 1) / 2.0
    s = t.agg(F.sum(F.col("p") * rank).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    neg = F.col("n") - F.col("p")
    u = F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0
    return s.select(
        F.try_divide(u, F.col("p").cast("double") * neg).alias("auc"),
        F.col("p").cast("long").alias("positives"),
        neg.cast("long").alias("negatives"),
    )


def auc_one_vs_rest(df: DataFrame, label: str, scores: dict) -> DataFrame:
    """Macro mean of the one-vs-rest areas; `scores` maps a class to its score column."""
    parts = None
    for cls, col in scores.items():
        one = auc(df, F.col(label) == F.lit(cls), col)
        parts = one if parts is None else parts.unionByName(one)
    return parts.agg(F.avg("auc").alias("auc"), F.count("auc").alias("classes"))


def model_verdict(df: DataFrame, test_r2: str = "test_r2", train_r2: str = "train_r2") -> DataFrame:
    """Fit class by R2, and over- or under-fit flags."""
    r, tr = F.col(test_r2), F.col(train_r2)
    grade = (
        F.when(r >= 0.8, "excellent").when(r >= 0.6, "good").when(r >= 0.4, "fair").otherwise("poor")
    )
    return df.withColumns({"grade": grade, "overfit": (tr - r) > 0.2, "weak": r < 0.5})


def residual_points(df: DataFrame, actual: str, predicted: str, keys: list[str]) -> DataFrame:
    return df.select(
        *keys,
        F.col(actual).alias("actual"),
        F.col(predicted).alias("predicted"),
        (F.col(actual) - F.col(predicted)).alias("residual"),
    )
