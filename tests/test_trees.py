"""Boosted trees against a plain version on the rows, Shapley values against all subsets."""

import heapq
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tabsmith.operators import boosting, forest, models, trees


def frame(spark, x, y, parts=4):
    cols = [f"x{i}" for i in range(x.shape[1])]
    rows = [(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols) + ", label double").repartition(parts)
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(df)


def plain_best(x, g, s):
    """The best split of rows by trying every value and both sides for the missing."""
    best, score = None, lambda v: v.sum() ** 2 / (len(v) + s.l2)
    for f in range(x.shape[1]):
        col = x[:, f]
        lost = np.isnan(col)
        for side in (True, False) if lost.any() else (False,):
            for cut in sorted(set(col[~lost])):
                left = (col <= cut) | (lost & side)
                if min(left.sum(), (~left).sum()) < max(1, s.least_rows):
                    continue
                gain = (score(g[left]) + score(g[~left]) - score(g)) / 2
                if gain > s.least_gain + 1e-12 and (best is None or gain > best[0] + 1e-9 * abs(best[0])):
                    best = (gain, f, cut, side, left)
    return best


def plain_tree(x, g, s):
    """Predictions of one tree, one split at a time: best leaf first, or every leaf up to the depth."""
    leaves, out, heap, tick = {0: (np.arange(len(x)), 0)}, np.zeros(len(x)), [], 0

    def offer(i):
        rows, depth = leaves[i]
        if s.depth is None or depth < s.depth:
            b = plain_best(x[rows], g[rows], s)
            if b:
                heapq.heappush(heap, (-b[0], i, b))

    offer(0)
    while heap and (s.leaves is None or len(leaves) < s.leaves):
        _, i, b = heapq.heappop(heap)
        rows, depth = leaves.pop(i)
        for part in (rows[b[4]], rows[~b[4]]):
            tick += 1
            leaves[tick] = (part, depth + 1)
            offer(tick)
    for rows, _ in leaves.values():
        out[rows] = -g[rows].sum() / (len(rows) + s.l2)
    return out, len(leaves)


@pytest.mark.parametrize(
    "settings",
    [
        boosting.Settings(rounds=3, rate=0.3, depth=3, l2=1.0),
        boosting.Settings(rounds=3, rate=0.5, depth=None, leaves=7, l2=0.0, least_rows=5),
        boosting.Settings(rounds=2, rate=1.0, depth=4, l2=2.0, least_gain=0.5),
    ],
)
def test_boosting_equals_the_plain_version(spark, settings):
    r = np.random.default_rng(1)
    x = np.round(r.normal(size=(240, 4)), 2)
    x[r.random(x.shape) < 0.15] = np.nan
    y = np.where(np.isnan(x[:, 0]), 2.0, x[:, 0] ** 2) + np.nan_to_num(x[:, 1]) + 0.1 * r.normal(size=240)
    df = frame(spark, x, y)
    model = boosting.fit(df, settings)
    pred, sizes = np.full(len(y), y.mean()), []
    for _ in range(settings.rounds):
        step, n = plain_tree(x, pred - y, settings)
        pred, sizes = pred + settings.rate * step, [*sizes, n]
    assert [len(t.leaves()) for t in model.trees] == sizes
    assert model.predict(x) == pytest.approx(pred, abs=1e-9)
    got = {q["id"]: q["prediction"] for q in trees.with_prediction(df, model).select("id", "prediction").collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(list(pred), abs=1e-9)


def test_leaf_wise_trees_are_not_bound_by_depth_and_draws_repeat(spark, monkeypatch):
    r = np.random.default_rng(2)
    x = r.random(size=(1500, 3))
    y = np.floor(x[:, 0] * 40) + x[:, 1]
    runs = []
    monkeypatch.setattr(boosting, "STORE_TREES", 2)
    for parts, few in ((1, 64), (6, 0)):  # sums by the driver, and by Spark
        monkeypatch.setattr(boosting, "FEW_PARTS", few)
        s = boosting.lgbm(rounds=4, rate=0.5, leaves=31, features=0.7, rows=0.8)
        runs.append(boosting.fit(frame(spark, x, y, parts), s, ["id"]))
    assert all(len(t.leaves()) == 31 for t in runs[0].trees)
    assert runs[0].predict(x) == pytest.approx(runs[1].predict(x), abs=1e-9)
    assert np.mean((runs[0].predict(x) - y) ** 2) < 0.15 * y.var()


def test_edges(spark):
    x = np.array([[1.0], [np.nan], [3.0]])
    flat = boosting.fit(frame(spark, x, [2.0, 2.0, 2.0]), boosting.xgb(rounds=3, rows=1.0))
    assert flat.predict(x) == pytest.approx([2.0] * 3)
    empty = frame(spark, x, [1.0, 2.0, 3.0]).where("id < 0")
    assert np.isnan(boosting.fit(empty, boosting.xgb(rounds=2)).base)
    none = frame(spark, np.full((4, 1), np.nan), [1.0, 2.0, 3.0, 4.0])
    assert boosting.fit(none, boosting.xgb(rounds=2, rows=1.0)).predict(np.array([[np.nan]])) == pytest.approx([2.5])
    # missing values alone can decide
    lost = np.array([[np.nan]] * 10 + [[0.0], [1.0]] * 5)
    model = boosting.fit(frame(spark, lost, [5.0] * 10 + [1.0] * 10), boosting.Settings(rounds=1, rate=1.0, depth=1, l2=0.0))
    assert model.predict(lost) == pytest.approx([5.0] * 10 + [1.0] * 10)


def subset_value(tree, x, present):
    def go(i):
        if tree.left[i] < 0:
            return tree.value[i]
        f = tree.feature[i]
        if f in present:
            left = tree.missing_left[i] if np.isnan(x[f]) else x[f] <= tree.threshold[i]
            return go(tree.left[i] if left else tree.right[i])
        return sum(tree.cover[c] / tree.cover[i] * go(c) for c in (tree.left[i], tree.right[i]))

    return go(0)


def plain_shapley(e, x):
    k, out = len(x), np.zeros(len(x))
    value = lambda s: e.base + e.weight * sum(subset_value(t, x, s) for t in e.trees)
    for i in range(k):
        rest = [j for j in range(k) if j != i]
        for size in range(k):
            for s in combinations(rest, size):
                out[i] += factorial(size) * factorial(k - size - 1) / factorial(k) * (value({*s, i}) - value(set(s)))
    return out


@pytest.fixture(scope="module")
def ensembles(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 4))
    x[:, 3] = r.integers(0, 2, size=400)
    y = x[:, 0] * x[:, 1] + 2 * x[:, 3] + r.normal(size=400) * 0.1
    df = frame(spark, x, y)
    forest = RandomForestRegressor(numTrees=5, maxDepth=4, seed=1).fit(df)
    gaps = x.copy()
    gaps[r.random(x.shape) < 0.2] = np.nan
    boosted = boosting.fit(frame(spark, gaps, y), boosting.lgbm(rounds=4, leaves=9, rate=0.5))
    return {"forest": (trees.from_forest(spark, forest, 4), x, df, forest), "boosted": (boosted, gaps, frame(spark, gaps, y), None)}


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_shapley_values_equal_the_sum_over_subsets(ensembles, kind):
    e, x, df, forest = ensembles[kind]
    if forest:
        want = {q["id"]: q["prediction"] for q in forest.transform(df).select("id", "prediction").collect()}
        assert e.predict(x) == pytest.approx([want[i] for i in range(len(x))], abs=1e-9)
    values = e.shapley(x)
    assert values.sum(axis=1) + e.expected() == pytest.approx(e.predict(x), abs=1e-9)
    for i in (0, 7, 19):
        assert values[i] == pytest.approx(plain_shapley(e, x[i]), abs=1e-9)
    few = e.shapley(x[:3])  # fewer rows than patterns: the other way
    assert few == pytest.approx(values[:3], abs=1e-9)
    assert e.shapley(x[:0]).shape == (0, 4)
    table = {q["feature"]: q["importance"] for q in trees.shapley_importance(df, e, list("abcd")).collect()}
    assert [table[n] for n in "abcd"] == pytest.approx(np.abs(values).mean(axis=0), abs=1e-9)
    rows = {q["id"]: q["shapley"] for q in trees.with_shapley(df, e).select("id", "shapley").collect()}
    assert rows[5] == pytest.approx(values[5], abs=1e-9)


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_dependence_is_the_weighted_traversal(ensembles, kind):
    e, *_ = ensembles[kind]
    for f in range(4):
        grid = [-2.0, -0.3, 0.0, 0.5, 1.0, 3.0, float("nan")]
        x = np.zeros((len(grid), 4))
        x[:, f] = grid
        want = [e.base + e.weight * sum(subset_value(t, row, {f}) for t in e.trees) for row in x]
        assert e.dependence(f, grid) == pytest.approx(want, abs=1e-9)


def test_blocks_hold_gradients_of_many_batches(spark):
    x = np.arange(60_000, dtype=float).reshape(-1, 2)
    df = frame(spark, x, np.ones(len(x)), 1)
    blocks = boosting._blocks(df, [[1.0, 70_000.0]] * 2, "features", "label", ["id"], 42, 3.0)
    assert blocks.columns == ["n", "bins", "g", "id"], "the trees so far are in the gradient, not walked in each pass"
    (only,) = blocks.collect()
    assert only["n"] == len(x) and set(np.frombuffer(only["g"])) == {2.0}


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_shapley_grids_spare_the_leaves_of_many_rows(ensembles, kind, monkeypatch):
    e, x, *_ = ensembles[kind]
    want = e.shapley(x[:40])
    monkeypatch.setattr(trees, "GRID", 0)
    assert e.shapley(x[:40]) == pytest.approx(want, abs=1e-9)
    monkeypatch.undo()
    monkeypatch.setattr(trees, "_add_leaf", None)
    many = np.tile(x, (30, 1))
    many[-1] = [np.inf, -1e300, np.nan, 0.0]
    got = e.shapley(many)
    assert got[:40] == pytest.approx(want, abs=1e-9)
    assert got.sum(axis=1) + e.expected() == pytest.approx(e.predict(many), abs=1e-9)


def plain_gains(x, y, w, node, features, cuts):
    """The best split's gain of the rows of one node by trying all cuts."""
    best = 0.0
    score = lambda rows: (w[rows] @ y[rows]) ** 2 / w[rows].sum()
    for f in features:
        for c in cuts[f]:
            left, right = node & (x[:, f] <= c), node & (x[:, f] > c)
            if w[left].sum() and w[right].sum():
                best = max(best, score(left) + score(right) - score(node))
    return best


@pytest.mark.parametrize("block", [7, 200_000])
def test_forest_trees_split_best_by_their_bootstrap_rows(spark, monkeypatch, block):
    r = np.random.default_rng(5)
    x = np.column_stack([r.integers(0, 6, 600), r.integers(0, 3, 600), r.normal(size=600)]).astype(float)
    y = np.round(x[:, 0] * 2 + (x[:, 1] == 1) * x[:, 2] + r.normal(size=600))
    monkeypatch.setattr(forest, "BLOCK_UNITS", block)
    df = frame(spark, x, y)
    for count in (1, 4):
        e, gains = forest.fit(df, count, 3, seed=9)
        cuts, base, variance = forest.feature_cuts(df, "features", "label")
        assert [len(c) for c in cuts] == [5, 2, forest.BINS - 1] and cuts[1] == [0.5, 1.5]
        assert (base, variance) == (pytest.approx(y.mean()), pytest.approx(y.var()))
        units = forest._units(df, cuts, "features", "label", 9).toPandas()
        assert units["c"].sum() == 600 and units["c"].max() > 1
        sums = np.zeros(3)
        for t, tree in enumerate(e.trees):
            w = forest.drawn_counts(units["id"].to_numpy(), units["c"].to_numpy(), 9, t).astype(float)
            b = np.array([list(v) for v in units["bins"]], float)
            edges = [np.arange(len(c)) for c in cuts]
            rows, own = {0: np.ones(len(w), bool)}, np.zeros(3)
            for i in range(len(tree.left)):
                n = w[rows[i]].sum()
                assert tree.cover[i] == n and tree.value[i] == pytest.approx(w[rows[i]] @ units["y"][rows[i]] / n)
                if tree.left[i] < 0:
                    continue
                f = tree.feature[i]
                c = cuts[f].index(tree.threshold[i])
                left, right = rows[i] & (b[:, f] <= c), rows[i] & (b[:, f] > c)
                rows[tree.left[i]], rows[tree.right[i]] = left, right
                yy = units["y"].to_numpy() - base
                got = (w[left] @ yy[left]) ** 2 / w[left].sum() + (w[right] @ yy[right]) ** 2 / w[right].sum() - (w[rows[i]] @ yy[rows[i]]) ** 2 / n
                asked = range(3) if count == 1 else [f]  # a third of three features is one
                assert got == pytest.approx(plain_gains(b, yy, w, rows[i], asked, edges), rel=1e-6)
                own[f] += got
            sums += own / own.sum()
        assert gains == pytest.approx(sums / sums.sum())


def test_forest_does_not_depend_on_the_layout_and_is_stored(spark, tmp_path):
    r = np.random.default_rng(6)
    x = np.round(r.normal(size=(900, 4)), 1)
    y = x[:, 0] * x[:, 1] + 3 * x[:, 2]
    one, many = (models.rf_regression(6, 5).fit(frame(spark, x, y, parts)) for parts in (1, 9))
    assert one.ensemble.predict(x) == pytest.approx(many.ensemble.predict(x), abs=1e-9)
    assert list(one.featureImportances) == pytest.approx(list(many.featureImportances), abs=1e-9)
    one.write().save(f"{tmp_path}/forest")
    again = forest.ForestModel.load(f"{tmp_path}/forest")
    got = {q["id"]: q["prediction"] for q in again.transform(frame(spark, x, y)).select("id", "prediction").collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(list(one.ensemble.predict(x)), abs=1e-9)
    theirs = RandomForestRegressor(numTrees=60, maxDepth=5, seed=1).fit(frame(spark, x, y))
    ours = models.rf_regression(60, 5).fit(frame(spark, x, y))
    assert list(ours.featureImportances) == pytest.approx(list(theirs.featureImportances), abs=0.06)
    assert trees.from_forest(spark, ours, 4).predict(x) == pytest.approx(trees.from_forest(spark, theirs, 4).predict(x), abs=1.5)


def test_forest_draws_equal_rows_as_one(spark):
    ids = np.arange(200_000)
    for c in (1, 5, 1000):
        w = forest.drawn_counts(ids, np.full(len(ids), c), 1, 0)
        assert (w.mean(), w.var()) == (pytest.approx(c, rel=0.01), pytest.approx(c, rel=0.03))
    ones = forest.drawn_counts(ids, np.ones(len(ids), int), 1, 0)
    assert np.bincount(ones)[:3] / len(ids) == pytest.approx([np.exp(-1), np.exp(-1), np.exp(-1) / 2], abs=0.005)
    x, y = np.tile([[0.0], [1.0]], (3000, 1)), np.tile([1.0, 2.0], 3000)
    df = frame(spark, x, y, 3)
    units = forest._units(df, [[0.5]], "features", "label", 1).collect()
    assert sorted((r["y"], r["c"]) for r in units) == [(1.0, 3000), (2.0, 3000)], "a pass visits two units, not 6000 rows"
    e, gains = forest.fit(df, 3, 4)
    assert e.predict(np.array([[0.0], [1.0]])) == pytest.approx([1.0, 2.0]) and list(gains) == [1.0]
    assert all(abs(t.cover[0] - 6000) < 500 for t in e.trees)
    for lost in (df.where("id < 0"), df.withColumn("label", F.when(F.col("id") != 3, F.col("label"))), frame(spark, np.array([[np.nan], [1.0]]), [1.0, 2.0])):
        with pytest.raises(ValueError):
            forest.fit(lost, 2, 2)


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_rows_of_one_cell_are_predicted_once(ensembles, kind, monkeypatch):
    e, x, *_ = ensembles[kind]
    want, cells = e.predict(x), trees._Cells(e)
    assert cells.predict(x[:150]) == pytest.approx(want[:150], abs=1e-12)
    assert cells.predict(x) == pytest.approx(want, abs=1e-12)
    monkeypatch.setattr(trees.Ensemble, "predict", None)
    assert cells.predict(np.tile(x, (9, 1))) == pytest.approx(np.tile(want, 9), abs=1e-12)


@pytest.mark.parametrize("share", [0.7, 1.0])
def test_boosting_from_cells_equals_boosting_from_rows(spark, monkeypatch, share):
    r = np.random.default_rng(8)
    x = np.column_stack([r.integers(0, 8, 4000), r.integers(0, 3, 4000)]).astype(float)
    x[r.random(x.shape) < 0.1] = np.nan
    y = np.nan_to_num(x[:, 0], nan=9.0) * 2 + np.nan_to_num(x[:, 1]) + r.normal(size=4000)
    df, s = frame(spark, x, y, 3), boosting.xgb(rounds=6, rows=share, depth=3)
    got = {}
    for kind, room, held in (("rows", 0, 1 << 27), ("cells", 1 << 21, 1 << 27), ("parts", 900, 0), ("joined", 900, 1 << 27)):
        monkeypatch.setattr(boosting, "GATHER_ROWS", room or 1 << 21)
        monkeypatch.setattr(boosting, "HELD", held)
        monkeypatch.setattr(boosting, "BLOCK_ROWS", 300)
        if not room:
            monkeypatch.setattr(boosting, "_collapsed", lambda blocks, *_: blocks.withColumn("drawn", F.lit(b"")))
        got[kind] = boosting.fit(df, s, ["id"])
        monkeypatch.undo()
    for e in got.values():
        assert [t.threshold for t in e.trees] == [t.threshold for t in got["rows"].trees]
        assert [t.cover for t in e.trees] == [t.cover for t in got["rows"].trees]
        assert e.predict(x) == pytest.approx(got["rows"].predict(x), abs=1e-9)
    cuts = boosting.feature_cuts(df)
    blocks = boosting._blocks(df, cuts, "features", "label", ["id"], 42, 0.0).coalesce(1)
    (cell,) = boosting._collapsed(blocks, [len(c) for c in cuts], s).collect()
    assert cell["n"] == 9 * 4, "passes visit 36 cells, not 4000 rows"
    wide = frame(spark, r.normal(size=(500, 2)), r.normal(size=500), 1)
    cuts = boosting.feature_cuts(wide)
    blocks = boosting._blocks(wide, cuts, "features", "label", ["id"], 42, 0.0)
    (only,) = boosting._collapsed(blocks, [len(c) for c in cuts], s).collect()
    assert (only["n"], len(only["drawn"]), len(only["id"])) == (500, 0, 4000), "rows that do not collapse stay"
