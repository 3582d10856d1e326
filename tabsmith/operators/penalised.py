"""Ridge and lasso paths with cross-validation from one pass over the rows.

Tasks turn Arrow batches into sums and cross-products of (features, label), one set a fold; Spark adds
them up. A fold is left out by subtracting its sums from the total, and a model's error on a fold follows
from the fold's sums as well, so any number of penalties and folds costs no further pass: the driver works
on matrices as wide as the features, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.operators.features import FEATURES

#: Penalties of an automatic path and the smallest as a share of the largest.
PATH, SMALLEST = 100, 1e-3
SWEEPS, PRECISION = 10_000, 1e-12
#: Rows that fix the shift of the sums.
SHIFT_ROWS = 1000


@dataclass
class Moments:
    """Sums over rows of (1, x, y) products, with x and y moved by `shift` (x first, y last)."""

    sums: np.ndarray
    shift: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.sums + other.sums, self.shift)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.sums - other.sums, self.shift)

    @property
    def rows(self) -> int:
        return int(round(self.sums[0, 0]))

    def centred(self) -> tuple[np.ndarray, np.ndarray, float]:
        """X'X, X'y and y'y about their means."""
        first = self.sums[0, 1:]
        c = self.sums[1:, 1:] - np.outer(first, first) / max(self.rows, 1)
        return c[:-1, :-1], c[:-1, -1], float(max(c[-1, -1], 0.0))

    def means(self) -> np.ndarray:
        return self.sums[0, 1:] / max(self.rows, 1) + self.shift


@dataclass
class Linear:
    intercept: float
    coefficients: np.ndarray
    alpha: float


def fold_moments(df: DataFrame, fold: str | None = None, features: str = FEATURES, label: str = "label") -> dict[int, Moments]:
    """Moments of each fold (0 without a fold column) in one pass.

    Columns are moved by the medians of a few rows first, which only keeps the sums well conditioned. Rows with a missing label, feature or fold do not count; no rows give no folds.
    """
    rows = df.select(
        vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), (F.col(fold) if fold else F.lit(0)).cast("int").alias("fold")
    ).where("x is not null and y is not null and fold is not null")
    some = rows.limit(SHIFT_ROWS).collect()
    if not some:
        return {}
    z = np.array([[*r["x"], r["y"]] for r in some])
    shift = np.nan_to_num(np.median(np.where(np.isfinite(z), z, 0.0), axis=0))
    width = len(shift) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width - 2)
            z = np.column_stack([np.ones(batch.num_rows), np.column_stack([x, batch.column(1).to_numpy(zero_copy_only=False)]) - shift])
            folds = batch.column(2).to_numpy(zero_copy_only=False)
            whole = np.isfinite(z).all(axis=1)
            for f in np.unique(folds[whole]):
                part = z[whole & (folds == f)]
                found[int(f)] = found.get(int(f), 0) + part.T @ part
        for f, sums in found.items():
            yield pa.RecordBatch.from_pydict({"fold": pa.array([f] * width, pa.int32()), "i": pa.array(range(width), pa.int32()), "row": pa.array(sums.tolist(), pa.list_(pa.float64()))})

    parts = rows.mapInArrow(partial, "fold int, i int, row array<double>").select("fold", "i", F.posexplode("row").alias("j", "v"))
    out: dict[int, np.ndarray] = {}
    for r in parts.groupBy("fold", "i", "j").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r["fold"], np.zeros((width, width)))[r["i"], r["j"]] = r["v"]
    return {f: Moments(m, shift) for f, m in sorted(out.items())}


def total(folds: dict[int, Moments]) -> Moments:
    parts = list(folds.values())
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def _linear(m: Moments, beta: np.ndarray, alpha: float) -> Linear:
    means = m.means()
    return Linear(float(means[-1] - beta @ means[:-1]), beta, float(alpha))


def ridge(m: Moments, alpha: float = 1.0) -> Linear:
    """Least squares with alpha * |b|^2 on the summed loss; the intercept is free."""
    xx, xy, _ = m.centred()
    return _linear(m, np.linalg.lstsq(xx + alpha * np.eye(len(xx)), xy, rcond=None)[0], alpha)


def alpha_path(m: Moments, count: int = PATH, smallest: float = SMALLEST) -> list[float]:
    """Penalties in even steps of their logarithm, from the least one that makes all lasso coefficients zero."""
    _, xy, _ = m.centred()
    top = float(np.abs(xy).max(initial=0.0)) / max(m.rows, 1)
    return [top * smallest ** (i / (count - 1)) for i in range(count)] if count > 1 else [top]


def lasso_path(m: Moments, alphas: list[float]) -> list[Linear]:
    """Lasso on half the mean squared loss plus alpha * |b|, by coordinate descent; each penalty starts
    from the solution of the one before it."""
    xx, xy, yy = m.centred()
    n, k = max(m.rows, 1), len(xy)
    g, c, size = xx / n, xy / n, np.diag(xx) / n
    beta, out = np.zeros(k), []
    left = c.copy()  # the gradient: c - g @ beta
    for alpha in alphas:
        for _ in range(SWEEPS):
            widest = 0.0
            for j in range(k):
                if size[j] <= 1e-14 * max(yy / n, 1e-300):
                    continue
                pull = left[j] + size[j] * beta[j]
                new = np.sign(pull) * max(abs(pull) - alpha, 0.0) / size[j]
                if new != beta[j]:
                    left -= g[:, j] * (new - beta[j])
                    widest = max(widest, abs(new - beta[j]) * np.sqrt(size[j]))
                    beta[j] = new
            if widest <= PRECISION * np.sqrt(max(yy / n, 1e-300)):
                break
        out.append(_linear(m, beta.copy(), alpha))
    return out


def lasso(m: Moments, alpha: float = 1.0) -> Linear:
    return lasso_path(m, [alpha])[0]


def score(model: Linear, m: Moments) -> dict[str, float]:
    """R2, RMSE and mean squared error of a model on the rows behind `m`; R2 is NULL for a constant label."""
    b = model.coefficients
    xx, xy, yy = m.centred()
    means = m.means()
    gap = means[-1] - model.intercept - b @ means[:-1]
    sse = max(float(yy - 2 * b @ xy + b @ xx @ b), 0.0) + m.rows * float(gap) ** 2
    mse = sse / m.rows if m.rows else None
    return {"n": m.rows, "r2": 1 - sse / yy if yy > 0 else None, "rmse": None if mse is None else float(np.sqrt(mse)), "mse": mse}


#: Path solvers by name: from moments and penalties to models.
SOLVERS = {"ridge": lambda m, alphas: [ridge(m, a) for a in alphas], "lasso": lasso_path}


def cross_validate(folds: dict[int, Moments], kind: str, alphas: list[float]) -> list[dict]:
    """One record per fold and penalty: the scores on the fold of the model fitted on all others."""
    whole = total(folds)
    out = []
    for f, own in folds.items():
        for i, model in enumerate(SOLVERS[kind](whole - own, alphas)):
            out.append({"fold": f, "place": i, "alpha": alphas[i], **score(model, own)})
    return out


def tune(folds: dict[int, Moments], kind: str, alphas: list[float] | None = None, by: str = "r2") -> tuple[Linear, list[dict]]:
    """The penalty of best mean score over the folds (`r2`, or `mse` as usual for the lasso; ties: the first),
    the model with it over all rows, and the mean scores by penalty."""
    if by not in ("r2", "mse"):
        raise ValueError("choose by r2 or mse")
    whole = total(folds)
    alphas = alphas or alpha_path(whole)
    scores = cross_validate(folds, kind, alphas)
    table = []
    for i, a in enumerate(alphas):
        own = [s for s in scores if s["place"] == i]
        mean = {k: float(np.mean([s[k] for s in own if s[k] is not None])) for k in ("r2", "mse") if any(s[k] is not None for s in own)}
        table.append({"place": i, "alpha": a, "r2": mean.get("r2"), "mse": mean.get("mse")})
    usable = [t for t in table if t[by] is not None]
    if not usable:
        raise ValueError("no fold can be scored")
    best = min(usable, key=lambda t: (t["mse"] if by == "mse" else -t["r2"], t["place"]))
    return SOLVERS[kind](whole, alphas[: best["place"] + 1])[-1], table


def coefficient_rows(model: Linear, names: list[str], df: DataFrame) -> DataFrame:
    """term, coefficient and whether it is in the model, the intercept first."""
    rows = [("intercept", model.intercept, True), *[(n, float(b), bool(abs(b) > 1e-8)) for n, b in zip(names, model.coefficients)]]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, selected boolean")


def path_table(table: list[dict], df: DataFrame) -> DataFrame:
    rows = [(t["place"], t["alpha"], t["r2"], t["mse"]) for t in table]
    return df.sparkSession.createDataFrame(rows, "place int, alpha double, r2 double, mse double")
