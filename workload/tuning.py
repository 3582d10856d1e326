"""Penalised regression and its tuning, beside closed forms in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.operators import features, penalised
from tabsmith.session import materialize
from workload.base import query
from workload.modelling import BUCKET, SPLIT_KEY
from workload.preparation import DERIVED, derived

XS = ["l_quantity", "l_discount"]

#: Standardised predictors a and b of the rows with a target; part and fold from the row's bucket.
SCALED = f"""r AS (SELECT l_quantity AS a, l_discount AS b, y, {BUCKET} % 10000 >= 2000 AS train, {BUCKET} % 5 AS fold FROM {DERIVED} WHERE y IS NOT NULL),
  f AS (SELECT avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb FROM r WHERE train),
  d AS (SELECT (a - ma) / sa AS a, (b - mb) / sb AS b, y, train, fold FROM r, f)"""

SUMS = """count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb, var_pop(y) * count(*) AS yy,
  covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS by_"""

#: Ridge of two predictors from their sums s and a penalty alpha.
RIDGE = """(ay * (bb + alpha) - by_ * ab) / ((aa + alpha) * (bb + alpha) - ab * ab) AS b1,
  (by_ * (aa + alpha) - ay * ab) / ((aa + alpha) * (bb + alpha) - ab * ab) AS b2"""

#: Lasso of two predictors: of the nine sign patterns, the consistent one with the least loss.
LASSO = """SELECT * EXCLUDE (loss, i, j), CASE WHEN i = 0 THEN 0 ELSE x1 END AS b1, CASE WHEN j = 0 THEN 0 ELSE x2 END AS b2 FROM (
  SELECT *, (aa * x1 * x1 + bb * x2 * x2 + 2 * ab * x1 * x2) / 2 / n - (ay * x1 + by_ * x2) / n + alpha * (abs(x1) + abs(x2)) AS loss FROM (
  SELECT *, CASE WHEN i = 0 THEN 0 WHEN j = 0 THEN (ay - alpha * n * i) / aa ELSE ((ay - alpha * n * i) * bb - (by_ - alpha * n * j) * ab) / (aa * bb - ab * ab) END AS x1,
    CASE WHEN j = 0 THEN 0 WHEN i = 0 THEN (by_ - alpha * n * j) / bb ELSE ((by_ - alpha * n * j) * aa - (ay - alpha * n * i) * ab) / (aa * bb - ab * ab) END AS x2
  FROM {source}, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j))
  WHERE x1 * i >= 0 AND x2 * j >= 0) QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY loss, abs(i) + abs(j)) = 1"""

FITTED = """c AS (SELECT *, my - b1 * ma - b2 * mb AS b0 FROM m),
  t AS (SELECT b0, b1, b2, 1 - sum(pow(y - b0 - b1 * a - b2 * b, 2)) FILTER (WHERE train) / (var_pop(y) FILTER (WHERE train) * count(*) FILTER (WHERE train)) AS r_train,
    1 - sum(pow(y - b0 - b1 * a - b2 * b, 2)) FILTER (WHERE NOT train) / (var_pop(y) FILTER (WHERE NOT train) * count(*) FILTER (WHERE NOT train)) AS r_test
    FROM d, (SELECT b0, b1, b2 FROM c) GROUP BY b0, b1, b2)
  SELECT 'intercept' AS name, round(b0, 5) AS value FROM t UNION ALL SELECT 'l_quantity', round(b1, 5) FROM t UNION ALL SELECT 'l_discount', round(b2, 5) FROM t
  UNION ALL SELECT 'r2_train', round(r_train, 6) FROM t UNION ALL SELECT 'r2_test', round(r_test, 6) FROM t"""


def two_features(t):
    """Stored (features, label, part, fold): both predictors scaled by the training rows."""
    d = derived(t).where("y is not null").select(*SPLIT_KEY, *XS, F.col("y").alias("label"))
    train, _ = features.split_holdout(d, SPLIT_KEY, 0.2)
    prep = features.fit_features(train, XS, [], scale="standard")
    part = (features.bucket(SPLIT_KEY, features.SPLIT_PARTS, 42) < 2000).cast("int").alias("part")
    fold = features.bucket(SPLIT_KEY, 5, 42).cast("int").alias("fold")
    return materialize(features.apply_features(prep, d, XS, []).select("features", "label", part, fold), "scaled")


def fitted(d, solve):
    parts = penalised.fold_moments(d, "part")
    model = solve(parts[0])
    coef = penalised.coefficient_rows(model, XS, d).select(F.col("term").alias("name"), F.round("coefficient", 5).alias("value"))
    scores = [(f"r2_{name}", round(penalised.score(model, parts[i])["r2"], 6)) for i, name in enumerate(("train", "test"))]
    return coef.unionByName(d.sparkSession.createDataFrame(scores, "name string, value double"))


@query("ridge", f"WITH {SCALED}, s AS (SELECT {SUMS}, 1.0::DOUBLE AS alpha FROM d WHERE train), m AS (SELECT *, {RIDGE} FROM s), {FITTED}")
def ridge(t):
    return fitted(two_features(t), lambda m: penalised.ridge(m, 1.0))


@query("lasso", f"WITH {SCALED}, s AS (SELECT {SUMS}, 0.5::DOUBLE AS alpha FROM d WHERE train), m AS ({LASSO.format(source='s', key='n')}), {FITTED}")
def lasso(t):
    return fitted(two_features(t), lambda m: penalised.lasso(m, 0.5))


#: Errors on each fold of the models m (out, place, alpha, b1, b2) that left it out, averaged over folds.
HELD_OUT = """c AS (SELECT out, place, alpha, b1, b2, my - b1 * ma - b2 * mb AS b0 FROM m),
  e AS (SELECT out, place, alpha, count(*) AS n, sum(pow(y - b0 - b1 * a - b2 * b, 2)) AS sse, var_pop(y) * count(*) AS sst FROM d JOIN c ON d.fold = c.out WHERE d.train GROUP BY ALL)"""
LEFT = f"SELECT o.out, {SUMS} FROM d JOIN (SELECT unnest(range(5)) AS out) o ON d.fold <> o.out WHERE d.train GROUP BY o.out"
ALPHAS = [0.01, 0.1, 1.0, 10.0, 100.0]


@query(
    "auto_tune",
    f"""WITH {SCALED}, l AS ({LEFT}), s AS (SELECT l.*, i AS place, {ALPHAS}[i + 1]::DOUBLE AS alpha FROM l, range(5) r(i)), m AS (SELECT *, {RIDGE} FROM s), {HELD_OUT}
      SELECT CAST(place AS INTEGER) AS place, alpha, round(avg(1 - sse / sst), 8) AS r2, round(avg(sse / n), 6) AS mse FROM e GROUP BY place, alpha""",
)
def auto_tune(t):
    """Ridge over five penalties and five folds of the training rows, all from one set of cross-products."""
    d = two_features(t).where("part = 0")
    _, table = penalised.tune(penalised.fold_moments(d, "fold"), "ridge", ALPHAS)
    return penalised.path_table(table, d).withColumns({"r2": F.round("r2", 8), "mse": F.round("mse", 6)})


@query(
    "lasso_path",
    f"""WITH {SCALED}, w AS (SELECT {SUMS} FROM d WHERE train), l AS ({LEFT}),
      s AS (SELECT l.*, i AS place, (SELECT greatest(abs(ay), abs(by_)) / n FROM w) * pow(0.001, i / 99.0) AS alpha FROM l, range(100) r(i)),
      m AS ({LASSO.format(source='s', key='out, place')}), {HELD_OUT}
      SELECT CAST(place AS INTEGER) AS place, round(alpha, 6) AS alpha, round(avg(1 - sse / sst), 6) AS r2, round(avg(sse / n), 5) AS mse FROM e GROUP BY place, alpha""",
)
def lasso_path(t):
    """The lasso over 100 penalties and five folds, chosen by the mean squared error."""
    d = two_features(t).where("part = 0")
    _, table = penalised.tune(penalised.fold_moments(d, "fold"), "lasso", by="mse")
    return penalised.path_table(table, d).withColumns({"alpha": F.round("alpha", 6), "r2": F.round("r2", 6), "mse": F.round("mse", 5)})


@query(
    "cross_validate",
    f"""WITH {SCALED}, l AS ({LEFT}), s AS (SELECT *, 0 AS place, 1.0::DOUBLE AS alpha FROM l), m AS (SELECT *, {RIDGE} FROM s), {HELD_OUT}
      SELECT CAST(out AS INTEGER) AS fold, n, round(1 - sse / sst, 8) AS r2, round(sqrt(sse / n), 6) AS rmse FROM e""",
)
def cross_validate(t):
    """R2 and RMSE of ridge on each of five held-out folds."""
    d = two_features(t).where("part = 0")
    rows = [(s["fold"], s["n"], s["r2"], s["rmse"]) for s in penalised.cross_validate(penalised.fold_moments(d, "fold"), "ridge", [1.0])]
    out = d.sparkSession.createDataFrame(rows, "fold int, n long, r2 double, rmse double")
    return out.withColumns({"r2": F.round("r2", 8), "rmse": F.round("rmse", 6)})
