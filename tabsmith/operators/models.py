"""Regression, classification, clustering, tuning, importance and scoring."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.scalars import number
from tabsmith.functions.tails import t_two_sided
from tabsmith.operators import evaluation
from tabsmith.operators.features import FEATURES
from tabsmith.operators.forest import ForestRegressor

SEED = 42


def gram(df: DataFrame, xs: list[str], y: str, keys: list[str] = ()) -> DataFrame:
    """n, X'X (upper triangle, with intercept), X'y and y'y, in one aggregate."""
    cols = [F.lit(1.0), *[F.col(x) for x in xs]]
    k = len(cols)
    aggs = [F.count(F.lit(1)).cast("double").alias("n")]
    xx = [F.sum(cols[i] * cols[j]) for i in range(k) for j in range(i, k)]
    xy = [F.sum(c * F.col(y)) for c in cols]
    aggs += [F.array(*xx).alias("xx"), F.array(*xy).alias("xy"), F.sum(F.col(y) * F.col(y)).alias("yy")]
    return df.groupBy(*keys).agg(*aggs)


def unpack(xx: list[float], k: int) -> np.ndarray:
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = xx
    return m + np.triu(m, 1).T


def ols(df: DataFrame, target: str, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Coefficient table and fit summary from one aggregate over complete rows.

    Columns are centred on their means first, which keeps the normal equations well conditioned.
    """
    full = df.select(*[number(df, c).alias(c) for c in [*features, target]]).dropna()
    centre = full.agg(*[F.avg(c).alias(c) for c in [*features, target]]).first().asDict()
    moved = full.select(*[(F.col(c) - F.lit(centre[c])).alias(c) for c in [*features, target]])
    g = gram(moved, features, target).first()
    k = len(features) + 1
    xx, xy, n, yy = unpack(g["xx"], k), np.array(g["xy"]), g["n"], g["yy"]
    inv = np.linalg.pinv(xx)
    beta = inv @ xy
    rss = max(yy - float(beta @ xy), 0.0)
    tss = max(yy - xy[0] ** 2 / n, 1e-300)
    dof = n - k
    mse = rss / dof if dof > 0 else float("nan")
    # Move the intercept back to the original origin.
    shift = np.array([-centre[f] for f in features])
    beta0 = beta.copy()
    beta0[0] = beta[0] + centre[target] + float(shift @ beta[1:])
    jac = np.eye(k)
    jac[0, 1:] = shift
    se = np.sqrt(np.maximum(np.diag(jac @ inv @ jac.T) * mse, 0))
    rows = []
    for name, b, s in zip(["intercept", *features], beta0, se):
        t = float(b / s) if s > 0 else None
        p = float(t_two_sided(t, dof)) if t is not None else None
        rows.append((name, float(b), float(s), t, p))
    spark = df.sparkSession
    coef = spark.createDataFrame(rows, "term string, coefficient double, se double, t double, p double")
    r2 = 1 - rss / tss
    fit = spark.createDataFrame(
        [(int(n), float(r2), float(1 - (1 - r2) * (n - 1) / dof), float(mse))], "n long, r2 double, adjusted_r2 double, mse double"
    )
    return coef, fit


def linear_equation(coef: DataFrame, target: str) -> str:
    parts = [f"{r['coefficient']:+.4f}{'' if r['term'] == 'intercept' else '*' + r['term']}" for r in coef.collect()]
    return f"{target} = " + " ".join(parts)


def ridge(rows: int, alpha: float = 1.0) -> LinearRegression:
    """Ridge with the penalty alpha*|b|^2 on the summed loss: MLlib averages the loss over rows."""
    return LinearRegression(
        featuresCol=FEATURES, labelCol="label", elasticNetParam=0.0, regParam=alpha / max(rows, 1),
        standardization=False, solver="normal",
    )


def lasso(alpha: float = 1.0, max_iter: int = 200) -> LinearRegression:
    """Lasso on the mean squared loss halved, the usual alpha."""
    return LinearRegression(
        featuresCol=FEATURES, labelCol="label", elasticNetParam=1.0, regParam=alpha,
        standardization=False, maxIter=max_iter, tol=1e-8,
    )


def rf_regression(trees: int = 100, depth: int = 8) -> ForestRegressor:
    return ForestRegressor(featuresCol=FEATURES, labelCol="label", numTrees=trees, maxDepth=depth, seed=SEED)


def logistic(rows: int, c: float = 1.0, max_iter: int = 100) -> LogisticRegression:
    return LogisticRegression(
        featuresCol=FEATURES, labelCol="label", family="auto", regParam=1.0 / (c * max(rows, 1)),
        elasticNetParam=0.0, standardization=False, maxIter=max_iter,
    )


def decision_tree(depth: int = 5) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(featuresCol=FEATURES, labelCol="label", maxDepth=depth, seed=SEED, leafCol="leaf")


def rf_classification(trees: int = 100, depth: int = 8) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol=FEATURES, labelCol="label", numTrees=trees, maxDepth=depth, seed=SEED)


def class_coefficients(model, names: list[str], df: DataFrame) -> DataFrame:
    """(class, feature, coefficient, odds_ratio) of a logistic model, `(intercept)` among the features.

    With two classes there is one equation, that of class 1. With more there is one a class; their scores' softmax
    are the probabilities, so only differences between classes have a meaning.
    """
    matrix, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    classes = [1] if len(matrix) == 1 else range(len(matrix))
    rows = [
        (int(c), n, float(v))
        for c, row, first in zip(classes, matrix, intercepts)
        for n, v in [("(intercept)", first), *zip(names, row)]
    ]
    t = df.sparkSession.createDataFrame(rows, "class int, feature string, coefficient double")
    return t.withColumn("odds_ratio", F.exp("coefficient"))


def coefficient_table(model, names: list[str], df: DataFrame) -> DataFrame:
    """Coefficients of a model with one equation; `class_coefficients` gives those of several classes."""
    if hasattr(model, "coefficientMatrix") and model.coefficientMatrix.numRows > 1:
        raise ValueError("one equation a class: use class_coefficients")
    values = model.coefficients.toArray()
    rows = [(n, float(v)) for n, v in zip(names, values)]
    t = df.sparkSession.createDataFrame(rows, "feature string, coefficient double")
    return t.withColumn("selected", F.abs("coefficient") > 1e-8).orderBy(F.desc(F.abs("coefficient")))


def importance_table(model, names: list[str], df: DataFrame) -> DataFrame:
    values = model.featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"))


def evaluate_regression(model, train: DataFrame, test: DataFrame) -> DataFrame:
    """R2, RMSE and MAE on both parts, in one scored pass over their union."""
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return evaluation.metrics_regression(model.transform(both), "label", "prediction", ["part"])


def cross_validate(df: DataFrame, estimator, fold: str, k: int) -> DataFrame:
    """R2, RMSE and MAE per held-out fold; folds are a column, so nothing is shuffled for them."""
    parts = None
    for i in range(k):
        model = estimator.fit(df.where(F.col(fold) != i))
        m = evaluation.metrics_regression(model.transform(df.where(F.col(fold) == i)), "label", "prediction")
        m = m.withColumn("fold", F.lit(i))
        parts = m if parts is None else parts.unionByName(m)
    return parts


def cross_validate_classes(df: DataFrame, estimator, fold: str, k: int) -> DataFrame:
    """Precision, recall, F1 and support per class and the accuracy of each held-out fold."""
    parts = None
    for i in range(k):
        model = estimator.fit(df.where(F.col(fold) != i))
        m = evaluation.metrics_classification(model.transform(df.where(F.col(fold) == i)), "label", "prediction")
        m = m.withColumn("fold", F.lit(i))
        parts = m if parts is None else parts.unionByName(m)
    return parts


def auto_tune(df: DataFrame, estimator, grid: dict, folds: int = 3, parallelism: int = 4, fold: str = ""):
    """Grid search by cross-validated R2 over all rows; returns (best model, score table)."""
    builder = ParamGridBuilder()
    for param, values in grid.items():
        builder = builder.addGrid(getattr(estimator, param), values)
    maps = builder.build()
    cv = CrossValidator(
        estimator=estimator, estimatorParamMaps=maps,
        evaluator=RegressionEvaluator(labelCol="label", metricName="r2"),
        numFolds=folds, parallelism=parallelism, seed=SEED, foldCol=fold,
    ).fit(df)
    rows = [
        (", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda e: e[0].name)), float(s))
        for m, s in zip(maps, cv.avgMetrics)
    ]
    scores = df.sparkSession.createDataFrame(rows, "params string, r2 double")
    return cv.bestModel, scores


def with_slot(df: DataFrame, slot, value) -> DataFrame:
    """Replace one slot of the feature vector."""
    arr = vector_to_array(FEATURES)
    changed = F.transform(arr, lambda x, i: F.when(i == slot, value).otherwise(x))
    return df.withColumn(FEATURES, array_to_vector(changed))


def replace_importance(model: Transformer, df: DataFrame, names: list[str]) -> DataFrame:
    """Mean absolute change of the prediction when a feature is set to its mean.

    Each row is expanded once per feature and scored in a single pass.
    """
    arr = vector_to_array(FEATURES)
    k = len(names)
    means = df.select(arr.alias("a")).agg(*[F.avg(F.col("a")[i]).alias(f"m{i}") for i in range(k)])
    mean_row = means.select(F.array(*[F.col(f"m{i}") for i in range(k)])).scalar()
    base = model.transform(df).select(FEATURES, F.col("prediction").alias("_base")).withColumn("_mean", mean_row)
    wide = base.withColumn("slot", F.explode(F.array(*[F.lit(i) for i in range(k)])))
    changed = with_slot(wide, F.col("slot"), F.element_at("_mean", F.col("slot") + 1)).drop("_mean")
    scored = model.transform(changed)
    g = scored.groupBy("slot").agg(F.avg(F.abs(F.col("prediction") - F.col("_base"))).alias("importance"))
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("slot") + 1)
    return g.select(label.alias("feature"), "importance")


def pdp_grid(df: DataFrame, slot: int, points: int = 20) -> list[float]:
    """An even grid between a feature's 5th and 95th percentile."""
    x = vector_to_array(FEATURES)[slot]
    lo, hi = df.select(x.alias("x")).agg(F.percentile_approx("x", [0.05, 0.95], 10_000)).first()[0]
    return [lo + (hi - lo) * i / (points - 1) for i in range(points)]


def pdp(model: Transformer, df: DataFrame, slot: int, name: str, points: int = 20) -> DataFrame:
    """Partial dependence of any model on an even grid between the 5th and 95th percentile.

    For trees, `trees.dependence_table` needs no data. Prediction is averaged over all rows; the grid is a literal array, so rows expand in place.
    """
    grid = pdp_grid(df, slot, points)
    wide = df.select(FEATURES).withColumn("grid", F.explode(F.array(*[F.lit(float(v)) for v in grid])))
    scored = model.transform(with_slot(wide, F.lit(slot), F.col("grid")))
    return scored.groupBy("grid").agg(F.avg("prediction").alias("response")).withColumn("feature", F.lit(name))


def kmeans(df: DataFrame, k: int = 3) -> tuple:
    """Cluster standardised features; returns (model, assigned rows)."""
    model = KMeans(featuresCol=FEATURES, k=k, seed=SEED, predictionCol="cluster").fit(df)
    return model, model.transform(df)


def cluster_centres(assigned: DataFrame, columns: list[str]) -> DataFrame:
    """Cluster sizes and centres in the original scale."""
    return assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns]
    )


def pca_project(df: DataFrame, k: int = 2) -> DataFrame:
    model = PCA(k=k, inputCol=FEATURES, outputCol="_pc").fit(df)
    arr = vector_to_array("_pc")
    return model.transform(df).withColumns({f"pc{i + 1}": arr[i] for i in range(k)}).drop("_pc")


def tree_rules(model, names: list[str]) -> list[tuple[int, str]]:
    """(leaf id, condition) of a fitted tree in the numbering of its leaf column."""
    out, leaf = [], 0

    def walk(node, conds):
        nonlocal leaf
        if node.numDescendants() == 0:
            out.append((leaf, " AND ".join(conds) or "all"))
            leaf += 1
            return
        s = node.split()
        name = names[s.featureIndex()]
        if hasattr(s, "threshold") and "Continuous" in s.getClass().getSimpleName():
            left, right = f"{name} <= {s.threshold():.4f}", f"{name} > {s.threshold():.4f}"
        else:
            cats = ",".join(str(c) for c in s.leftCategories())
            left, right = f"{name} in ({cats})", f"{name} not in ({cats})"
        walk(node.leftChild(), [*conds, left])
        walk(node.rightChild(), [*conds, right])

    walk(model._java_obj.rootNode(), [])
    return out


def leaf_stats(scored: DataFrame, target: str = "label", leaf: str = "leaf") -> DataFrame:
    return scored.groupBy(F.col(leaf).cast("int").alias("leaf")).agg(
        F.count(F.lit(1)).alias("samples"), F.avg(target).alias("mean_value")
    )


def joint_rules(
    df: DataFrame, names: list[str], depth: int = 3, higher_better: bool = True, top: int | None = 15,
    min_support: int = 5,
) -> DataFrame:
    """Rules of a regression tree with support, mean and effect against the overall mean, over all rows.

    The strongest `top`; None returns all.
    """
    if not 2 <= depth <= 5:
        raise ValueError("the depth of joint rules is 2 to 5")
    tree = DecisionTreeRegressor(
        featuresCol=FEATURES, labelCol="label", maxDepth=depth, seed=SEED, leafCol="leaf"
    ).fit(df)
    rules = df.sparkSession.createDataFrame(tree_rules(tree, names), "leaf int, rule string")
    stats = leaf_stats(tree.transform(df))
    overall = df.agg(F.avg("label")).scalar()
    t = stats.join(F.broadcast(rules), "leaf").withColumn("_m", overall)
    effect = F.col("mean_value") - F.col("_m")
    good = (effect > 0) if higher_better else (effect < 0)
    out = (
        t.where((F.col("samples") >= min_support) & (F.abs(effect) >= 0.01 * F.abs(F.col("_m"))))
        .select("rule", "mean_value", "samples", effect.alias("effect"),
                F.when(good, "favourable").otherwise("unfavourable").alias("direction"))
        .orderBy(F.desc(F.abs("effect")), "rule")
    )
    return out if top is None else out.limit(top)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().save(path)


def batch_score(path: str, df: DataFrame) -> DataFrame:
    """Score rows with a stored pipeline; there is no row cap."""
    return PipelineModel.load(path).transform(df)
