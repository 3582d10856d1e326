"""Random forests of regression trees, grown from sums by cell of the binned features.

Features are cut into at most 32 bins, so that rows of equal bins and equal label are one unit with a count, whatever
the number of rows. A bootstrap sample draws each row a Poisson(1) number of times, hence a unit of c rows a Poisson(c)
number: draws come from a hash of the unit, and do not depend on the layout. Units of equal bins lie side by side and
are summed once a tree. Each level is one pass for all trees: tasks add up the nodes' sums by (feature, bin), and the
best splits are found tree by tree. No pass visits a row for each tree.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache
from math import ceil, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.operators.boosting import ACCURACY, CUT_COLUMNS, TIE, mixed
from tabsmith.operators.trees import Ensemble, Tree, with_prediction
from tabsmith.session import materialize

#: Bins of a feature, and the finer quantiles among which its cuts are chosen.
BINS, FINE = 32, 1024
#: Units of a block, and bytes of the sums that a task holds in a pass.
BLOCK_UNITS, HELD = 200_000, 1 << 27
#: Gains below this share of the variance a row are rounding errors.
NOISE = 1e-12
#: What a pass finds for each open node.
FOUND = "tree int, place int, n double, g double, feature int, cut int, gain double, nl double, gl double"


def feature_cuts(df: DataFrame, features: str, label: str) -> tuple[list[list[float]], float | None, float]:
    """Cuts of each feature (half-way between values, all of them if these are few, else next to quantiles), and the
    label's mean and variance. Rows that no tree can take are an error, as in MLlib."""
    y = F.col(label).cast("double")
    x = df.select(vector_to_array(features).alias("x"), y.alias("y"))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    lost = bad(F.col("y")) | F.coalesce(F.exists("x", bad), F.lit(True))
    first = x.agg(F.max(F.size("x")), F.avg("y"), F.var_pop("y"), F.count_if(lost), F.count_distinct(F.size("x"))).first()
    if first[3] or first[4] > 1:
        raise ValueError("labels and features must be finite numbers, and vectors of one length")
    shares, out = ", ".join(str(i / FINE) for i in range(1, FINE)), []
    for start in range(0, first[0] or 0, CUT_COLUMNS):
        some = range(start, min(start + CUT_COLUMNS, first[0]))
        cells = x.select(*[F.col("x")[i].alias(f"c{i}") for i in some])
        found = cells.agg(*[F.expr(f"struct(percentile_approx(c{i}, array({shares}), {ACCURACY}), min(c{i}), max(c{i}))") for i in some]).first()
        for at, low, high in found:
            values = sorted({low, *at, high})
            chosen = range(len(values) - 1)
            if len(values) > BINS:
                place = {v: k for k, v in enumerate(values)}
                chosen = sorted({place[at[i * FINE // BINS - 1]] for i in range(1, BINS)} - {len(values) - 1})
            out.append([values[k] + (values[k + 1] - values[k]) / 2 for k in chosen])
    return out, first[1], first[2] or 0.0


def _units(df: DataFrame, cuts: list[list[float]], features: str, label: str, seed: int) -> DataFrame:
    """bins (one byte a feature), y, c (rows with both) and id (a hash)."""
    edges, width = [np.array(c) for c in cuts], len(cuts)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, width)
            bins = np.empty((n, width), np.uint8)
            for j, e in enumerate(edges):
                bins[:, j] = np.searchsorted(e, x[:, j], side="left")
            cells = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(bins)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([cells, batch.column(1)], ["bins", "y"])

    rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    units = rows.mapInArrow(binned, "bins binary, y double").groupBy("bins", "y").agg(F.count(F.lit(1)).alias("c"))
    return units.withColumn("id", F.xxhash64(F.lit(seed), "bins", "y"))


@cache
def _poisson(mean: int) -> tuple[int, np.ndarray]:
    """A number, and the shares of draws up to it, up to the next, and so on."""
    low = max(0, int(mean - 12 * sqrt(mean) - 20))
    ks = range(low, int(mean + 12 * sqrt(mean) + 40))
    upto = np.cumsum(np.exp([k * log(mean) - mean - lgamma(k + 1) for k in ks]))
    upto /= upto[-1]
    return low, upto[: int(np.searchsorted(upto, 1.0)) + 1]


def drawn_counts(ids: np.ndarray, counts: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a tree draws each unit: Poisson(count), the sum of draws for the count's powers of two."""
    out = np.zeros(len(ids), np.int64)
    for bit in range(int(counts.max(initial=0)).bit_length()):
        some = np.flatnonzero(counts >> bit & 1) if counts.max() > 1 else slice(None)
        low, upto = _poisson(1 << bit)
        u = (mixed(ids[some], (seed * 1_000_003 + tree) * 64 + bit) >> np.uint64(11)) * 2.0**-53
        out[some] += low + np.searchsorted(upto, u, side="right")
    return out


def _blocks(units: DataFrame, width: int, trees: int, seed: int, base: float) -> DataFrame:
    """Blocks of units: n cells (different bins), bins (feature by feature), starts (each cell's first unit), counts
    (tree by tree, `size` bytes each) and sums. Where cells hold many units, counts and sums (of labels, less `base`)
    are those of the cells, tree by tree, and there are no starts; elsewhere sums are the units' labels."""

    def block(parts: list) -> pa.RecordBatch:
        bins, y, c, ids = (np.concatenate(p) for p in zip(*parts))
        bins = bins.reshape(len(y), width)
        starts = np.concatenate([[0], np.flatnonzero((bins[1:] != bins[:-1]).any(axis=1)) + 1]).astype(np.int32)
        small = 16 * len(starts) <= len(y)
        counts, sums = np.empty((trees, len(starts) if small else len(y)), np.int64 if small else np.uint32), []
        for t in range(trees):
            w = drawn_counts(ids, c, seed, t)
            counts[t] = np.add.reduceat(w, starts) if small else w
            sums += [np.add.reduceat(w * y, starts)] if small else []
        kind = np.min_scalar_type(int(counts.max()))
        cells = [np.ascontiguousarray(bins[starts].T), np.empty(0, np.int32) if small else starts, counts.astype(kind), np.concatenate(sums) if small else y]
        bins, starts, counts, sums = (pa.array([a.tobytes()], pa.binary()) for a in cells)
        return pa.RecordBatch.from_arrays([pa.array([cells[0].shape[1]], pa.int32()), bins, starts, pa.array([kind.itemsize], pa.int32()), counts, sums], ["n", "bins", "starts", "size", "counts", "sums"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            y, c, ids = (col.to_numpy(zero_copy_only=False) for col in batch.columns[1:])
            parts.append((np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8), y - base, c, ids))
            held += len(y)
            if held >= BLOCK_UNITS:
                yield block(parts)
                parts, held = [], 0
        if held:
            yield block(parts)

    return units.mapInArrow(draw, "n int, bins binary, starts binary, size int, counts binary, sums binary")


def _sums_of(row: tuple, trees: int):
    """bins, and a function of the tree that gives the cells' counts and sums of labels."""
    n, bins, starts, size, counts, sums = row
    bins = np.frombuffer(bins, np.uint8)
    starts, counts, sums = np.frombuffer(starts, np.int32), np.frombuffer(counts, f"u{size}").reshape(trees, -1), np.frombuffer(sums)
    if not len(starts):
        return n, bins, lambda t: (counts[t].astype(float), sums.reshape(trees, n)[t])
    if len(starts) == len(sums):
        return n, bins, lambda t: (counts[t].astype(float), counts[t] * sums)
    return n, bins, lambda t: (np.add.reduceat(counts[t], starts, dtype=float), np.add.reduceat(counts[t] * sums, starts))


def _pass(blocks: DataFrame, trees: int, level: int, asked: list[int], feature: np.ndarray, cut: np.ndarray, slot: np.ndarray, chosen: list[np.ndarray], noise: float) -> list:
    """For the asked trees' open nodes of a level: tree, place among its open nodes, count, sum and, if there is a gain, the
    best split's feature, cut, gain and left count and sum. `chosen` holds the features that each open node may split on."""
    m = chosen[0].shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((2, nodes.size * BINS)) for nodes in chosen]
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                n, bins, of = _sums_of(row, trees)
                every = np.arange(n)
                for total, t, nodes in zip(totals, asked, chosen):
                    at = np.zeros(n, np.int64)
                    for _ in range(level):
                        at = 2 * at + 1 + (bins[feature[t][at] * n + every] > cut[t][at])
                    counts, sums = of(t)
                    place = slot[t][at]
                    some = np.flatnonzero((place >= 0) & (counts > 0))
                    place, counts, sums = place[some], counts[some], sums[some]
                    for j in range(m):
                        cell = (place * m + j) * BINS + bins[nodes[place, j] * n + some]
                        total[0] += np.bincount(cell, counts, total.shape[1])
                        total[1] += np.bincount(cell, sums, total.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int32()), pa.array([t.tobytes() for t in totals], pa.binary())], ["tree", "sums"])

    number = {t: k for k, t in enumerate(asked)}

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, parts in zip(*(c.to_pylist() for c in batch.columns)):
                nodes = chosen[number[t]]
                total = sum(np.frombuffer(p) for p in parts).reshape(2, len(nodes), m, BINS)
                nl, gl = np.cumsum(total, axis=3)
                n, g = nl[:, 0, -1], gl[:, 0, -1]
                nr, gr = n[:, None, None] - nl, g[:, None, None] - gl
                able = (nl > 0.5) & (nr > 0.5)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(able, gl**2 / nl + gr**2 / nr - (g * g / np.maximum(n, 1))[:, None, None], -np.inf).reshape(len(nodes), -1)
                top = gain.max(axis=1)
                first = np.argmax(gain >= (top - TIE * np.abs(top))[:, None], axis=1)
                for i, (k, worth) in enumerate(zip(first, top)):
                    j, c = divmod(int(k), BINS)
                    split = (int(nodes[i, j]), c, float(worth), float(nl[i, j, c]), float(gl[i, j, c])) if worth > noise * n[i] else (-1, 0, 0.0, 0.0, 0.0)
                    out.append((t, i, float(n[i]), float(g[i]), *split))
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], FOUND.replace(",", "").split()[::2])

    parts = blocks.mapInArrow(add, "tree int, sums binary").groupBy("tree").agg(F.collect_list("sums").alias("parts"))
    return parts.mapInArrow(best, FOUND).collect()


def fit(df: DataFrame, trees: int = 100, depth: int = 8, seed: int = 42, features: str = "features", label: str = "label") -> tuple[Ensemble, np.ndarray]:
    """The forest, and each feature's importance: its gains, as shares of a tree's, averaged over trees. A node may split
    on a third of the features, drawn anew for each node; a single tree's nodes on all."""
    cuts, base, variance = feature_cuts(df, features, label)
    if base is None:
        raise ValueError("there are no rows to learn from")
    width = len(cuts)
    units = materialize(_units(df, cuts, features, label, seed), "units")
    cores = df.sparkSession.sparkContext.defaultParallelism
    # units of a cell are neighbours, and a cell of many units is cut like any other
    dealt = units.repartitionByRange(max(1, min(4 * cores, units.count() // 5000)), "bins", "y").sortWithinPartitions("bins", "y")
    blocks = materialize(_blocks(dealt, width, trees, seed, base), "drawn").coalesce(cores).persist()

    size = 2 ** (depth + 1) - 1  # node i has the children 2i + 1 and 2i + 2
    feature, cut = np.zeros((trees, size), np.int64), np.full((trees, size), 255)
    split = np.zeros((trees, size), bool)
    sums, gains = np.zeros((trees, size, 2)), np.zeros((trees, width))
    m = max(1, ceil(width / 3)) if trees > 1 else max(1, width)
    open_ = {t: [0] for t in range(trees)} if width else {}
    for level in range(depth):
        most = max(map(len, open_.values()), default=0)
        if not most:
            break
        slot, chosen = np.full((trees, size), -1), {}
        for t, nodes in open_.items():
            slot[t, nodes] = range(len(nodes))
            order = np.random.default_rng([seed, t, level]).random((2**level, width)).argsort(axis=1)
            chosen[t] = order[np.array(nodes) - (2**level - 1), :m]
        asked, step, following = sorted(open_), max(1, HELD // (most * m * BINS * 16)), {}
        for some in (asked[i : i + step] for i in range(0, len(asked), step)):
            for r in _pass(blocks, trees, level, some, feature, cut, slot, [chosen[t] for t in some], NOISE * variance):
                t, node = r["tree"], open_[r["tree"]][r["place"]]
                sums[t, node] = r["n"], r["g"]
                if r["feature"] < 0:
                    continue
                feature[t, node], cut[t, node], split[t, node] = r["feature"], r["cut"], True
                gains[t, r["feature"]] += r["gain"]
                sums[t, 2 * node + 1] = r["nl"], r["gl"]
                sums[t, 2 * node + 2] = r["n"] - r["nl"], r["g"] - r["gl"]
                following.setdefault(t, []).extend(c for c in (2 * node + 1, 2 * node + 2) if sums[t, c, 0] > 1.5)
        open_ = {t: sorted(nodes) for t, nodes in following.items() if nodes}
    blocks.unpersist()

    out = []
    for t in range(trees):
        tree, at, nodes = Tree(), {}, [0]
        for i in nodes:  # grows as it goes
            n, g = sums[t, i]
            at[i] = tree.add(float(base + g / n) if n else float(base), float(n))
            nodes += [2 * i + 1, 2 * i + 2] if split[t, i] else []
        for i in nodes:
            if split[t, i]:
                tree.split(at[i], int(feature[t, i]), cuts[feature[t, i]][cut[t, i]], False, at[2 * i + 1], at[2 * i + 2])
        out.append(tree)
    whole = gains.sum(axis=1, keepdims=True)
    share = np.divide(gains, whole, out=np.zeros_like(gains), where=whole > 0).sum(axis=0)
    return Ensemble(out, 1.0 / trees, 0.0, width), share / (share.sum() or 1.0)


class ForestModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted forest; it is written and read like any stage."""

    forest = Param(Params._dummy(), "forest", "weight, base, width, importances and trees, as JSON", TypeConverters.toString)

    @property
    def ensemble(self) -> Ensemble:
        d = json.loads(self.getOrDefault(self.forest))
        return Ensemble([Tree(*t) for t in d["trees"]], d["weight"], d["base"], d["width"])

    @property
    def featureImportances(self) -> DenseVector:
        return Vectors.dense(json.loads(self.getOrDefault(self.forest))["importances"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return with_prediction(dataset, self.ensemble, self.getFeaturesCol(), self.getPredictionCol())


class ForestRegressor(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """`fit` as an MLlib estimator. Inputs whose metadata name more than two categories go to MLlib's forest, whose
    splits take sets of categories."""

    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "largest depth of a tree", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", numTrees=100, maxDepth=8, seed=42):
        super().__init__()
        self._setDefault(numTrees=100, maxDepth=8, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame):
        names = {p: self.getOrDefault(p) for p in ("featuresCol", "labelCol", "predictionCol", "numTrees", "maxDepth", "seed")}
        x = names["featuresCol"]
        kinds = dataset.schema[x].metadata.get("ml_attr", {}).get("attrs", {}).get("nominal", [])
        if any(len(a.get("vals", ())) > 2 or a.get("num_vals", 0) > 2 for a in kinds):
            return RandomForestRegressor(**names).fit(dataset)
        found, importances = fit(dataset, names["numTrees"], names["maxDepth"], names["seed"], x, names["labelCol"])
        trees = [[t.feature, t.threshold, t.missing_left, t.left, t.right, t.value, t.cover] for t in found.trees]
        text = json.dumps({"weight": found.weight, "base": found.base, "width": found.width, "importances": importances.tolist(), "trees": trees})
        model = ForestModel()
        return model._set(forest=text, featuresCol=x, predictionCol=names["predictionCol"])
