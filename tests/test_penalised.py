"""Penalised paths from cross-products against plain solutions on the rows."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from tabsmith.operators import penalised


def frame(spark, x, y, fold=None):
    cols = [f"x{i}" for i in range(x.shape[1])]
    rows = [(*map(float, a), None if b is None else float(b), int(f)) for a, b, f in zip(x, y, fold if fold is not None else np.zeros(len(x)))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols) + ", label double, fold int").repartition(5)
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(df)


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 6)) * [1, 10, 0.1, 1, 1, 0] + [0, 1000, 0, 0, 0, 5]
    x[:, 4] = x[:, 0] + 0.05 * r.normal(size=400)
    y = 3 * x[:, 0] + 0.2 * x[:, 1] - 8 * x[:, 2] + r.normal(size=400) + 50
    return x, y, r.integers(0, 4, size=400)


def plain_ridge(x, y, alpha):
    c, d = x - x.mean(0), y - y.mean()
    return np.linalg.lstsq(c.T @ c + alpha * np.eye(x.shape[1]), c.T @ d, rcond=None)[0]


def test_ridge_and_its_folds_equal_fits_on_the_rows(spark, data):
    x, y, fold = data
    folds = penalised.fold_moments(frame(spark, x, y, fold), "fold")
    assert {f: m.rows for f, m in folds.items()} == {f: int((fold == f).sum()) for f in range(4)}
    model = penalised.ridge(penalised.total(folds), 2.0)
    want = plain_ridge(x, y, 2.0)
    assert model.coefficients == pytest.approx(want, abs=1e-7)
    assert model.intercept == pytest.approx(y.mean() - x.mean(0) @ want, rel=1e-9)
    for s in penalised.cross_validate(folds, "ridge", [0.1, 50.0]):
        out = fold == s["fold"]
        b = plain_ridge(x[~out], y[~out], s["alpha"])
        e = y[out] - (y[~out].mean() - x[~out].mean(0) @ b) - x[out] @ b
        assert s["r2"] == pytest.approx(1 - (e**2).sum() / ((y[out] - y[out].mean()) ** 2).sum(), abs=1e-8)
        assert s["rmse"] == pytest.approx(np.sqrt((e**2).mean()), rel=1e-7)


def test_lasso_meets_its_optimality_conditions(spark, data):
    x, y, fold = data
    m = penalised.total(penalised.fold_moments(frame(spark, x, y, fold), "fold"))
    alphas = penalised.alpha_path(m, 20)
    models = penalised.lasso_path(m, alphas)
    assert not models[0].coefficients.any() or np.abs(models[0].coefficients).max() < 1e-12
    n, sizes = len(y), []
    for alpha, model in zip(alphas, models):
        b = model.coefficients
        slope = (x - x.mean(0)).T @ (y - model.intercept - x @ b) / n
        for g, v in zip(slope, b):
            assert abs(g) <= alpha * (1 + 1e-5) + 1e-7
            if v:
                assert g == pytest.approx(alpha * np.sign(v), rel=1e-4, abs=1e-6)
        sizes.append(int((b != 0).sum()))
        assert b[5] == 0  # a constant column
    assert sizes[0] == 0 and sizes[-1] >= 3


def test_tuning_takes_the_best_mean_score(spark, data):
    x, y, fold = data
    folds = penalised.fold_moments(frame(spark, x, y, fold), "fold")
    for kind, by in (("ridge", "r2"), ("lasso", "mse")):
        model, table = penalised.tune(folds, kind, by=by)
        scores = [t[by] for t in table]
        assert len(table) == 100 and model.alpha == table[int(np.argmax(scores) if by == "r2" else np.argmin(scores))]["alpha"]
    with pytest.raises(ValueError):
        penalised.tune(folds, "ridge", by="mae")


def test_gaps_and_edges(spark):
    x = np.array([[1.0, 2.0], [2.0, np.nan], [3.0, 1.0], [4.0, 5.0]])
    df = frame(spark, x, [1.0, 2.0, None, 4.0])
    m = penalised.fold_moments(df)
    assert m[0].rows == 2 and penalised.score(penalised.ridge(m[0], 1.0), m[0])["n"] == 2
    assert penalised.fold_moments(df.filter("x0 < 0")) == {}
    flat = penalised.fold_moments(frame(spark, x[[0, 0, 0]], [3.0, 3.0, 3.0]))[0]
    model = penalised.lasso(flat, 0.1)
    assert model.intercept == pytest.approx(3.0) and not model.coefficients.any()
    assert penalised.score(model, flat)["r2"] is None and penalised.score(model, flat)["rmse"] == pytest.approx(0.0, abs=1e-9)
