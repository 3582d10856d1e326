"""Tree ensembles as leaf tables: prediction, exact Shapley values and partial dependence.

A leaf holds, for each feature on its path, the interval that leads to it, whether a missing value does,
and the share of training rows that the path's splits on this feature let through. Everything below
follows from these: a row's prediction is the sum of the leaves it meets, Shapley values come from
polynomials over a leaf's features, partial dependence from the shares alone. Rows are worked on in Arrow
batches, all of them, and no row depends on another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import factorial, inf

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.operators.features import FEATURES
from tabsmith.session import scratch_path

#: Rows that are worked on at a time, and cells of a batch of features from many rows.
ROWS, CHUNK_CELLS = 8192, 1_000_000
#: Numbers in the Shapley values of a tree's grid, and in all grids that a task keeps.
GRID, KEPT = 1 << 21, 1 << 23


@dataclass
class Tree:
    """Nodes by number, 0 the root. A row goes left if its value is at most `threshold`, or, if it is missing,
    where `missing_left` says. Leaves have left -1. `cover` counts training rows."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for cells, x in ((self.feature, -1), (self.threshold, 0.0), (self.missing_left, False), (self.left, -1), (self.right, -1)):
            cells.append(x)
        self.value.append(value)
        self.cover.append(cover)
        return len(self.value) - 1

    def split(self, node: int, feature: int, threshold: float, missing_left: bool, left: int, right: int) -> None:
        self.feature[node], self.threshold[node], self.missing_left[node] = feature, threshold, missing_left
        self.left[node], self.right[node] = left, right

    def leaves(self) -> list[int]:
        return [i for i, at in enumerate(self.left) if at < 0]

    def walk(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x."""
        feature, threshold, default = np.array(self.feature), np.array(self.threshold), np.array(self.missing_left)
        left, right = np.array(self.left), np.array(self.right)
        at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while True:
            inner = left[at] >= 0
            if not inner.any():
                return at
            v = x[rows, np.maximum(feature[at], 0)]
            goes = np.where(np.isnan(v), default[at], v <= threshold[at])
            at = np.where(inner, np.where(goes, left[at], right[at]), at)


@dataclass
class Leaf:
    """value, features on the path, and for each: low < x <= high, whether missing passes, share let through."""

    value: float
    features: list[int]
    low: list[float]
    high: list[float]
    missing: list[bool]
    share: list[float]

    def passes(self, x: np.ndarray) -> np.ndarray:
        """Rows x path features: whether a row's own value lets it through."""
        v = x[:, self.features]
        inside = (v > self.low) & (v <= self.high)
        return np.where(np.isnan(v), self.missing, inside)


def leaf_table(tree: Tree) -> list[Leaf]:
    out, stack = [], [(0, {})]
    while stack:
        node, path = stack.pop()
        if tree.left[node] < 0:
            rows = list(path.items())
            cells = [[p[i] for _, p in rows] for i in range(4)]
            out.append(Leaf(tree.value[node], [f for f, _ in rows], *cells))
            continue
        f, t, default = tree.feature[node], tree.threshold[node], tree.missing_left[node]
        low, high, missing, share = path.get(f, (-inf, inf, True, 1.0))
        for child, bounds in ((tree.left[node], (low, min(high, t), missing and default)), (tree.right[node], (max(low, t), high, missing and not default))):
            part = tree.cover[child] / tree.cover[node] if tree.cover[node] else 0.0
            stack.append((child, path | {f: (*bounds, share * part)}))
    return out


@dataclass
class Ensemble:
    """base + the sum over trees of weight * leaf value."""

    trees: list[Tree]
    weight: float
    base: float
    width: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += self.weight * np.array(t.value)[t.walk(x)]
        return out

    def cuts(self) -> dict[int, np.ndarray]:
        """The thresholds of all trees, ascending, of each feature that they split on."""
        found: dict[int, set] = {}
        for t in self.trees:
            for f, c, at in zip(t.feature, t.threshold, t.left):
                if at >= 0:
                    found.setdefault(f, set()).add(c)
        return {f: np.array(sorted(found[f])) for f in sorted(found)}

    def expected(self) -> float:
        """The mean prediction by the training counts in the nodes."""
        tables = (leaf for t in self.trees for leaf in leaf_table(t))
        return self.base + self.weight * sum(leaf.value * float(np.prod(leaf.share)) for leaf in tables)

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """Exact Shapley values, rows x features, of the game in which absent features follow the training
        counts at the splits. A row's values add up to its prediction minus `expected`."""
        return _Shapley(self).values(x)

    def dependence(self, feature: int, grid: list[float]) -> list[float]:
        """Mean prediction when a feature has each value of the grid, other splits weighted by training counts."""
        out = np.full(len(grid), self.base)
        at = np.asarray(grid, dtype=float)
        for t in self.trees:
            for leaf in leaf_table(t):
                rest = float(np.prod([s for f, s in zip(leaf.features, leaf.share) if f != feature]))
                meets = 1.0
                if feature in leaf.features:
                    i = leaf.features.index(feature)
                    meets = np.where(np.isnan(at), leaf.missing[i], (at > leaf.low[i]) & (at <= leaf.high[i]))
                out += self.weight * leaf.value * rest * meets
        return out.tolist()


def _place(cuts: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Between which thresholds each value lies, the missing last."""
    return np.where(np.isnan(x), len(cuts) + 1, np.searchsorted(cuts, x, side="left"))


class _Cells:
    """Predictions of rows. Trees see of a row only between which thresholds each feature lies, so rows that agree on
    this have one prediction: it is worked out once, and kept for later rows as far as there is room."""

    def __init__(self, ensemble: Ensemble):
        self.of, self.axes = ensemble, ensemble.cuts()
        self.codes, self.found = np.empty(0, np.int64), np.empty(0)
        self.fits = np.prod([len(c) + 2.0 for c in self.axes.values()]) < 2**62

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.fits:
            return self.of.predict(x)
        code = np.zeros(len(x), np.int64)
        for f, cuts in self.axes.items():
            code = code * (len(cuts) + 2) + _place(cuts, x[:, f])
        out = np.empty(len(x))
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        known = self.codes[at] == code if len(self.codes) else np.zeros(len(x), bool)
        out[known] = self.found[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            codes, first, back = np.unique(code[new], return_index=True, return_inverse=True)
            values = self.of.predict(x[new[first]])
            out[new] = values[back]
            if len(self.codes) + len(codes) <= KEPT // 8:
                both = np.concatenate([self.codes, codes])
                order = np.argsort(both, kind="stable")
                self.codes, self.found = both[order], np.concatenate([self.found, values])[order]
        return out


class _Shapley:
    """Shapley values of rows. A tree sees of a row only between which of its thresholds each feature lies; where
    the grid of these intervals is not much larger than the rows, its values are worked out once, leaf by leaf,
    and looked up. Grids are kept for later rows as far as there is room."""

    def __init__(self, ensemble: Ensemble):
        self.of, self.grids, self.room = ensemble, {}, KEPT

    def values(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.of.width))
        rows = range(0, len(x), ROWS)
        # each feature is placed once among the thresholds of all trees
        axes = {f: (cuts, _place(cuts, x[:, f])) for f, cuts in self.of.cuts().items()}
        for number, t in enumerate(self.of.trees):
            grid = self.grids.get(number) or self._grid(number, t, len(x))
            if grid is None:
                for leaf in leaf_table(t):
                    for i in rows if leaf.features else ():
                        _add_leaf(out[i : i + ROWS], x[i : i + ROWS], leaf, self.of.weight)
                continue
            used, cuts, table = grid
            if not used:
                continue
            cell = 0
            for f, own in zip(used, cuts):
                every, place = axes[f]
                # an interval among all thresholds lies in one of the tree's own
                to = np.append(np.searchsorted(own, every, side="left"), [len(own), len(own) + 1])
                cell = cell * (len(own) + 2) + to[place]
            found = table[cell]
            for k, f in enumerate(used):
                out[:, f] += found[:, k]
        return out

    def _grid(self, number: int, tree: Tree, rows: int):
        """Used features, their thresholds, and a row of values for each cell; None if that is too much."""
        used = sorted({f for f, at in zip(tree.feature, tree.left) if at >= 0})
        cuts = [np.unique([c for g, c, at in zip(tree.feature, tree.threshold, tree.left) if g == f and at >= 0]) for f in used]
        shape = [len(c) + 2 for c in cuts]
        cells = int(np.prod(shape, dtype=float)) if len(used) <= 12 else GRID
        if cells > 4 * rows or cells * len(used) > GRID:
            return None
        # a value of each interval: its upper end, beyond the last threshold infinity, and the missing
        ends = [np.concatenate([c, [inf, np.nan]]) for c in cuts]
        out = np.zeros((len(used), *shape))
        for leaf in leaf_table(tree):
            m, code = len(leaf.features), 0
            for j, f in enumerate(leaf.features):
                k = used.index(f)
                meets = np.where(np.isnan(ends[k]), leaf.missing[j], (ends[k] > leaf.low[j]) & (ends[k] <= leaf.high[j]))
                code = code + (meets.astype(np.int64) << j).reshape([-1 if i == k else 1 for i in range(len(used))])
            if m:
                patterns = (np.arange(2**m)[:, None] >> np.arange(m)) & 1
                values = _coefficients(patterns.astype(float), np.array(leaf.share)) * (self.of.weight * leaf.value)
                for j, f in enumerate(leaf.features):
                    out[used.index(f)] += values[code, j]
        grid = used, cuts, np.ascontiguousarray(out.reshape(len(used), -1).T)
        if out.size <= self.room:
            self.grids[number], self.room = grid, self.room - out.size
        return grid


def _coefficients(passes: np.ndarray, share: np.ndarray) -> np.ndarray:
    """For rows of 0/1 `passes`: the weight of each feature in the leaf's Shapley values.

    The product over the other features of (share + pass * t) has, at t^s, the sum over sets of s present
    features; each is weighted by s! (m - s - 1)! / m!.
    """
    n, m = passes.shape
    out = np.empty((n, m))
    weights = np.array([factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)])
    for i in range(m):
        poly = np.zeros((n, m))
        poly[:, 0] = 1.0
        size = 0
        for j in range(m):
            if j != i:
                size += 1
                poly[:, 1 : size + 1] = poly[:, 1 : size + 1] * share[j] + poly[:, :size] * passes[:, j : j + 1]
                poly[:, 0] *= share[j]
        out[:, i] = (poly @ weights) * (passes[:, i] - share[i])
    return out


def _add_leaf(out: np.ndarray, x: np.ndarray, leaf: Leaf, weight: float) -> None:
    passes, share, m = leaf.passes(x), np.array(leaf.share), len(leaf.features)
    if 2**m <= len(x):  # as many patterns at most: work them out once each
        code = passes @ (1 << np.arange(m))
        patterns = (np.arange(2**m)[:, None] >> np.arange(m)) & 1
        values = _coefficients(patterns.astype(float), share)[code]
    else:
        values = _coefficients(passes.astype(float), share)
    out[:, leaf.features] += weight * leaf.value * values


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _scored(ensemble: Ensemble, how, kind: str) -> Column:
    """A column function of the feature array; `how` turns a matrix into one result a row."""

    @F.arrow_udf(kind)
    def run(xs: pa.Array) -> pa.Array:
        parts = [how(_matrix(xs.slice(i, ROWS), ensemble.width)) for i in range(0, len(xs), ROWS)]
        if kind == "double":
            return pa.array(np.concatenate(parts) if parts else [], pa.float64())
        return pa.array([row for p in parts for row in p.tolist()], pa.list_(pa.float64()))

    return run


def with_prediction(df: DataFrame, ensemble: Ensemble, features: str = FEATURES, name: str = "prediction") -> DataFrame:
    return df.withColumn(name, _scored(ensemble, _Cells(ensemble).predict, "double")(vector_to_array(features)))


def with_shapley(df: DataFrame, ensemble: Ensemble, features: str = FEATURES, name: str = "shapley") -> DataFrame:
    """Add the array of Shapley values, one a feature."""
    return df.withColumn(name, _scored(ensemble, ensemble.shapley, "array<double>")(vector_to_array(features)))


def shapley_importance(df: DataFrame, ensemble: Ensemble, names: list[str], features: str = FEATURES) -> DataFrame:
    """feature, importance: the mean absolute Shapley value over all rows, from one sum a task and feature."""
    width = ensemble.width
    most = max(ROWS, CHUNK_CELLS // max(width, 1))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held, n = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                held.append(_matrix(batch.column(0).slice(i, ROWS), width))
                n += len(held[-1])
                if n >= most:
                    yield np.concatenate(held)
                    held, n = [], 0
        if held:
            yield np.concatenate(held)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, shapley = np.zeros(width), 0, _Shapley(ensemble)
        for x in chunks(batches):
            total, n = total + np.abs(shapley.values(x)).sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(range(width), pa.int32()), "s": pa.array(total), "n": pa.array([n] * width, pa.int64())})

    parts = df.select(vector_to_array(features).alias("x")).mapInArrow(sums, "slot int, s double, n long")
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("slot") + 1)
    return parts.groupBy("slot").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("importance")).select(label.alias("feature"), "importance")


def dependence_table(df: DataFrame, ensemble: Ensemble, feature: int, name: str, grid: list[float]) -> DataFrame:
    """grid, response, feature; reads no rows."""
    rows = [(float(v), float(r), name) for v, r in zip(grid, ensemble.dependence(feature, grid))]
    return df.sparkSession.createDataFrame(rows, "grid double, response double, feature string")


def from_forest(spark: SparkSession, model, width: int) -> Ensemble:
    """A fitted regression tree or forest; the splits of one of MLlib must be on numbers (or on two categories)."""
    if hasattr(model, "ensemble"):
        return model.ensemble
    path = scratch_path(spark, "forest")
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    cells = F.col("nodeData") if "nodeData" in data.columns else F.struct("*")
    number = F.col("treeID") if "treeID" in data.columns else F.lit(0)
    rows = data.select(number.alias("tree"), cells.alias("node")).select(
        "tree", "node.id", "node.prediction", "node.rawCount", "node.leftChild", "node.rightChild", "node.split.*"
    )
    # the model's structure: its size is bounded by trees and depth, not by rows
    nodes: dict[int, dict[int, tuple]] = {}
    for r in rows.collect():
        nodes.setdefault(r["tree"], {})[r["id"]] = r
    trees = []
    for _, found in sorted(nodes.items()):
        tree = Tree()
        for i in range(len(found)):
            tree.add(float(found[i]["prediction"]), float(found[i]["rawCount"]))
        for i, r in found.items():
            if r["leftChild"] < 0:
                continue
            values = list(r["leftCategoriesOrThreshold"])
            if r["numCategories"] == -1:
                tree.split(i, r["featureIndex"], float(values[0]), False, r["leftChild"], r["rightChild"])
            elif r["numCategories"] == 2 and values == [0.0]:
                tree.split(i, r["featureIndex"], 0.5, False, r["leftChild"], r["rightChild"])
            elif r["numCategories"] == 2 and values == [1.0]:
                tree.split(i, r["featureIndex"], 0.5, False, r["rightChild"], r["leftChild"])
            else:
                raise ValueError("splits on more than two categories have no intervals")
        trees.append(tree)
    return Ensemble(trees, 1.0 / max(len(trees), 1), 0.0, width)

