"""Multivariate adaptive regression splines.

Each forward step reads the data once: tasks turn their rows into partial cross-products of all
candidate hinge pairs with the current basis, and Spark sums them. The driver only solves small
systems. Pruning needs no data at all, since every subset's fit follows from the final Gram matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.scalars import number
from tabsmith.operators.order_stats import quantile_values
from tabsmith.session import materialize

RIDGE = 1e-8
#: Shares of the target's variation: the least gain of a forward step, what counts as a better candidate,
#: and the residual below which a fit is exact (there, sums differ by rounding only).
MIN_GAIN = 1e-6
BETTER = 1e-9
EXACT = 1e-9
#: Share of its own variation that a basis column must add to those before it.
INDEPENDENT = 1e-10


@dataclass
class Hinge:
    feature: int
    knot: float
    sign: int


@dataclass
class Mars:
    features: list[str]
    terms: list[list[Hinge]] = field(default_factory=list)
    coefficients: list[float] = field(default_factory=list)
    intercept: float = 0.0
    gcv: float = float("nan")

    def column(self):
        """The prediction as a column expression: scoring stays in the JVM."""
        out = F.lit(self.intercept)
        for term, b in zip(self.terms, self.coefficients):
            part = F.lit(b)
            for h in term:
                x = F.col(self.features[h.feature]).cast("double")
                part = part * F.greatest(F.lit(0.0), (x - h.knot) * h.sign)
            out = out + part
        return out

    def describe(self) -> list[tuple[str, str, float]]:
        rows = []
        for term, b in zip(self.terms, self.coefficients):
            name = " * ".join(
                f"max(0, {self.features[h.feature]} - {h.knot:.3f})" if h.sign > 0
                else f"max(0, {h.knot:.3f} - {self.features[h.feature]})"
                for h in term
            )
            rule = " AND ".join(
                f"{self.features[h.feature]} {'>' if h.sign > 0 else '<'} {h.knot:.3f}" for h in term
            )
            rows.append((name, rule, b))
        return rows


def _hinge(x: np.ndarray, h: Hinge) -> np.ndarray:
    return np.maximum(0.0, (x[:, h.feature] - h.knot) * h.sign)


def _basis(x: np.ndarray, terms: list[list[Hinge]]) -> np.ndarray:
    out = np.ones((len(x), len(terms) + 1))
    for j, term in enumerate(terms):
        for h in term:
            out[:, j + 1] *= _hinge(x, h)
    return out


def _partial_sums(cols: list[str], y: str, terms, candidates):
    """Task function: one row per candidate with its sums against the basis, itself and y."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base_sum, sums = None, None
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype=float)
            t = pdf[y].to_numpy(dtype=float)
            b = np.column_stack([_basis(x, terms), t])
            g = b.T @ b
            base_sum = g if base_sum is None else base_sum + g
            part = np.empty((len(candidates), 2, b.shape[1] + 1))
            basis = b[:, :-1]
            for i, (parent, f, knot) in enumerate(candidates):
                d = x[:, f] - knot
                for s, side in enumerate((np.maximum(d, 0.0), np.maximum(-d, 0.0))):
                    h = side * basis[:, parent]
                    part[i, s, :-1] = h @ b
                    part[i, s, -1] = h @ h
            sums = part if sums is None else sums + part
        if base_sum is None:
            return
        rows = [(-1, base_sum.ravel().tolist())]
        if len(candidates):
            rows += [(i, sums[i].ravel().tolist()) for i in range(len(candidates))]
        yield pd.DataFrame(rows, columns=["candidate", "sums"])

    return run


def _collect_sums(df: DataFrame, cols: list[str], y: str, terms, candidates) -> dict[int, np.ndarray]:
    """Sum the tasks' arrays element-wise with one shuffle on (candidate, position)."""
    parts = df.select(*cols, y).mapInPandas(
        _partial_sums(cols, y, terms, candidates), "candidate int, sums array<double>"
    )
    long = parts.select("candidate", F.posexplode("sums").alias("i", "v"))
    rows = (
        long.groupBy("candidate", "i").agg(F.sum("v").alias("v"))
        .groupBy("candidate")
        .agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"))
        .collect()
    )
    return {r["candidate"]: np.array([e["v"] for e in r["s"]]) for r in rows}


def _solve(g: np.ndarray, r: np.ndarray) -> np.ndarray:
    scale = np.sqrt(np.maximum(np.diag(g), 1e-30))
    a = g / np.outer(scale, scale) + RIDGE * np.eye(len(g))
    return np.linalg.lstsq(a, r / scale, rcond=None)[0] / scale


def _rss(g: np.ndarray, r: np.ndarray, yy: float) -> float:
    beta = _solve(g, r)
    return max(float(yy - 2 * beta @ r + beta @ g @ beta), 0.0)


def gcv(rss: float, n: int, terms: int, penalty: float) -> float:
    """Generalised cross-validation; `terms` counts the intercept."""
    room = 1 - (terms + penalty * (terms - 1) / 2) / n
    return float("inf") if room <= 0 else rss / n / room**2


def knots(df: DataFrame, cols: list[str], per_feature: int = 20) -> list[list[float]]:
    """Evenly spaced interior order statistics of each column's distinct values."""
    picks = {f"k{i}": (i / (per_feature + 1), "floor") for i in range(1, per_feature + 1)}
    out = []
    for c in cols:
        distinct = df.select(c).distinct()
        found = quantile_values(distinct, [c], picks).get(c, {})
        out.append(sorted(set(found.values())))
    return out


def fit(
    df: DataFrame, target: str, features: list[str], max_terms: int = 11, interaction: int = 2,
    penalty: float = 3.0, knots_per_feature: int = 20,
) -> Mars:
    """Forward selection of hinge pairs, then backward pruning by GCV.

    The target is centred first and all thresholds are shares of its variation, so that terms do not
    depend on the order in which partial sums are added. A constant target gives no terms.
    """
    data = df.select(*[number(df, c).alias(c) for c in [*features, target]]).dropna()
    mean = data.agg(F.avg(target)).first()[0]
    if mean is None:
        raise ValueError("no complete rows to fit")
    data = materialize(data.withColumn(target, F.col(target) - F.lit(mean)), "mars")
    grid = knots(data, features, knots_per_feature)
    model = Mars(features)
    terms = model.terms
    best_rss = None
    while True:
        candidates = []
        if len(terms) + 2 <= max_terms - 1:
            for parent in range(len(terms) + 1):
                used = terms[parent - 1] if parent else []
                if len(used) >= interaction:
                    continue
                taken = {h.feature for h in used}
                candidates += [
                    (parent, f, k) for f in range(len(features)) if f not in taken for k in grid[f]
                ]
        sums = _collect_sums(data, features, target, terms, candidates)
        m = len(terms) + 1
        g = sums[-1].reshape(m + 1, m + 1)
        base, xy, yy, n = g[:m, :m], g[:m, m], g[m, m], int(round(g[0, 0]))
        if best_rss is None:
            best_rss = _rss(base, xy, yy)
        choice, found = None, best_rss
        for i, cand in enumerate(candidates):
            s = sums[i].reshape(2, m + 2)
            big = np.zeros((m + 2, m + 2))
            big[:m, :m] = base
            big[m:, :m] = s[:, :m]
            big[:m, m:] = s[:, :m].T
            big[m, m], big[m + 1, m + 1] = s[0, -1], s[1, -1]
            if s[0, -1] <= 0 and s[1, -1] <= 0:
                continue
            rss = max(_rss(big, np.concatenate([xy, s[:, m]]), yy), EXACT * yy)
            if rss < found - BETTER * yy:
                found, choice = rss, cand
        if choice is None or found > best_rss - MIN_GAIN * yy:
            break
        best_rss = found
        parent, f, k = choice
        stem = list(terms[parent - 1]) if parent else []
        terms.append([*stem, Hinge(f, k, 1)])
        terms.append([*stem, Hinge(f, k, -1)])
    model = _prune(model, base, xy, yy, n, penalty)
    model.intercept += mean
    return model


def _independent(g: np.ndarray) -> list[int]:
    """Columns of a centred Gram matrix that vary beyond what the kept ones before them explain."""
    keep: list[int] = []
    for j in range(len(g)):
        own = left = g[j, j]
        if keep and own > 0:
            part = np.linalg.lstsq(g[np.ix_(keep, keep)], g[keep, j], rcond=None)[0]
            left = own - part @ g[keep, j]
        if own > 0 and left > INDEPENDENT * own:
            keep.append(j)
    return keep


def _prune(model: Mars, g: np.ndarray, r: np.ndarray, yy: float, n: int, penalty: float) -> Mars:
    """Drop terms, the least useful first, while GCV does not rise; a residual below EXACT counts as EXACT,
    so that terms which add only rounding go."""
    mean = g[0, 1:] / n
    scale = np.sqrt(np.maximum(np.diag(g)[1:], 1e-300))
    centred = g[1:, 1:] - np.outer(mean, mean) * n
    flat = np.diag(centred) <= INDEPENDENT * scale**2
    c = centred / np.outer(scale, scale)
    c[flat, :] = c[:, flat] = 0.0
    y = (r[1:] - mean * r[0]) / scale
    all_ = max(yy - r[0] ** 2 / n, 0.0)

    def solve(idx: list[int]) -> np.ndarray:
        return np.linalg.lstsq(c[np.ix_(idx, idx)], y[idx], rcond=None)[0] if idx else np.zeros(0)

    def score(idx: list[int]) -> float:
        rss = max(all_ - float(solve(idx) @ y[idx]), EXACT * all_)
        return gcv(rss, n, len(idx) + 1, penalty)

    keep = _independent(c)
    best = score(keep)
    while keep:
        value, drop = min((score([k for k in keep if k != j]), j) for j in keep)
        if value > best:
            break
        best, keep = value, [k for k in keep if k != drop]
    beta = solve(keep) / scale[keep]
    model.terms = [model.terms[k] for k in keep]
    model.coefficients = [float(b) for b in beta]
    model.intercept = float(r[0] / n - beta @ mean[keep])
    model.gcv = best
    return model


def basis_table(model: Mars, df: DataFrame) -> DataFrame:
    rows = model.describe()
    t = df.sparkSession.createDataFrame(rows, "basis string, rule string, coefficient double")
    return t.orderBy(F.desc(F.abs("coefficient")))


def importance(model: Mars, df: DataFrame) -> DataFrame:
    """Sum of absolute coefficients of the terms in which a feature occurs."""
    total: dict[str, float] = {}
    for term, b in zip(model.terms, model.coefficients):
        for h in term:
            name = model.features[h.feature]
            total[name] = total.get(name, 0.0) + abs(b)
    return df.sparkSession.createDataFrame(
        list(total.items()), "feature string, importance double"
    ).orderBy(F.desc("importance"))
