"""Coefficients of logistic models by class."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler

from tabsmith.operators import models


def fitted(spark, classes):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 2))
    label = (x @ np.array([[2.0, -1.0, 0.0], [0.0, 1.0, -2.0]])[:, :classes] + rng.gumbel(size=(600, classes))).argmax(axis=1)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, label)], "a double, b double, label double")
    ready = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    return x, label, ready, LogisticRegression(maxIter=200, tol=1e-10).fit(ready)


@pytest.mark.parametrize("classes", [2, 3])
def test_class_coefficients_solve_the_likelihood_equations(spark, classes):
    x, label, ready, model = fitted(spark, classes)
    rows = models.class_coefficients(model, ["a", "b"], ready).collect()
    table = {(r["class"], r["feature"]): r["coefficient"] for r in rows}
    assert {c for c, _ in table} == ({1} if classes == 2 else {0, 1, 2}) and len(rows) == len(table)
    design = np.c_[np.ones(len(x)), x]
    scores = np.stack([design @ [table.get((c, f), 0.0) for f in ("(intercept)", "a", "b")] for c in range(classes)], axis=1)
    p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
    gradient = design.T @ (p - np.eye(classes)[label]) / len(x)
    assert np.abs(gradient).max() < 1e-4
    assert all(r["odds_ratio"] == pytest.approx(np.exp(r["coefficient"])) for r in rows)


def test_one_table_of_coefficients_needs_one_equation(spark):
    _, _, ready, two = fitted(spark, 2)
    got = {r["feature"]: r["coefficient"] for r in models.coefficient_table(two, ["a", "b"], ready).collect()}
    assert got == pytest.approx(dict(zip("ab", two.coefficients.toArray())))
    with pytest.raises(ValueError):
        models.coefficient_table(fitted(spark, 3)[3], ["a", "b"], ready)
