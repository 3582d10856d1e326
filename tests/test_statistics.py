"""Statistics, tail probabilities, rules, capability, models, forecasts and streams."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabsmith.functions import normal, tails
from tabsmith.operators import (
    arima, association, charts, concordance, evaluation, features, hypothesis, mars, mic, models,
    rules, slices, spc,
)
from tabsmith.streaming import quality


def test_tail_probabilities_match_published_tables():
    assert tails.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.t_two_sided(12.7062, 1) == pytest.approx(0.05, abs=1e-6)
    assert tails.f_upper(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_upper(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_upper(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.kolmogorov_upper(1.358099) == pytest.approx(0.05, abs=1e-5)


def test_normal_columns(spark):
    zs = [-9.0, -3.0, -1.96, 0.0, 0.5, 2.575829, 6.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for r in df.select("z", normal.norm_cdf(F.col("z")).alias("p"), normal.coarse_cdf(F.col("z")).alias("c")).collect():
        exact = 0.5 * math.erfc(-r["z"] / math.sqrt(2))
        assert r["p"] == pytest.approx(exact, rel=1e-9, abs=1e-16)
        assert r["c"] == pytest.approx(exact, abs=2e-5)
    p = spark.createDataFrame([(0.025,), (0.5,), (0.999,), (1.0,)], "p double")
    got = [r["q"] for r in p.select(normal.norm_quantile(F.col("p")).alias("q")).collect()]
    assert got[:3] == pytest.approx([-1.959964, 0.0, 3.090232], abs=1e-6) and got[3] is None


def test_known_small_table(spark):
    df = spark.createDataFrame([(1, 2, "A"), (2, 4, "A"), (3, 6, "B"), (4, 8, "B")], "x int, y int, g string")
    assert association.corr_pearson(df, ["x", "y"]).first()["r"] == pytest.approx(1.0)
    t = {r["method"]: r for r in hypothesis.ttest_two(df, "g", "x").collect()}
    assert t["pooled"]["t"] == pytest.approx(-2.828427, abs=1e-5) and t["pooled"]["df"] == 2
    k = concordance.corr_kendall(df, "x", "y").first()
    assert (k["gamma"], k["tau_b"], k["concordant"]) == (1.0, pytest.approx(1.0), 6)


def brute_pairs(rows):
    c = d = 0
    for i in range(len(rows)):
        for j in range(i):
            s = (rows[i][0] - rows[j][0]) * (rows[i][1] - rows[j][1])
            c, d = c + (s > 0), d + (s < 0)
    return c, d


def test_concordance_with_heavy_ties_and_layouts(layouts, monkeypatch):
    monkeypatch.setattr(slices, "ROWS_PER_SLICE", 20)
    r = random.Random(5)
    rows = [(1.0 if r.random() < 0.4 else round(r.gauss(0, 3), 1), float(r.randint(0, 6))) for _ in range(150)]
    c, d = brute_pairs(rows)
    a = np.abs(np.subtract.outer([x for x, _ in rows], [x for x, _ in rows]))
    b = np.abs(np.subtract.outer([y for _, y in rows], [y for _, y in rows]))
    a = a - a.mean(0) - a.mean(1)[:, None] + a.mean()
    b = b - b.mean(0) - b.mean(1)[:, None] + b.mean()
    want = math.sqrt((a * b).mean() / math.sqrt((a * a).mean() * (b * b).mean()))
    for df in layouts([*rows, (None, 1.0)], "x double, y double")[2:]:
        k = concordance.corr_kendall(df, "x", "y").first()
        assert (k["concordant"], k["discordant"], k["n"]) == (c, d, 150)
        assert concordance.corr_distance(df, "x", "y").first()["dcor"] == pytest.approx(want, abs=1e-9)


def test_parabola_is_found_by_mic_not_by_pearson(spark):
    df = spark.createDataFrame([(i, i - 50.0, (i - 50.0) ** 2) for i in range(101)], "id long, x double, y double")
    m = mic.mic_pairs(df, ["x", "y"], ["id"]).first()
    assert abs(m["pearson"]) < 1e-9 and m["mic"] > 0.8
    few = mic.mic_pairs(df.limit(4), ["x", "y"], ["id"]).first()
    assert few["mic"] == 0.0


def test_auc_of_permuted_and_perfect_scores(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(i % 2, r.random(), float(i % 2)) for i in range(2000)], "y int, s double, best double")
    assert evaluation.auc(df, F.col("y") == 1, "s").first()["auc"] == pytest.approx(0.5, abs=0.05)
    assert evaluation.auc(df, F.col("y") == 1, "best").first()["auc"] == 1.0


def test_exact_line_and_cross_check_with_mllib(spark):
    line = spark.createDataFrame([(float(x), 3.0 * x - 2) for x in range(20)], "x double, y double")
    coef, fit = models.ols(line, "y", ["x"])
    got = {r["term"]: r["coefficient"] for r in coef.collect()}
    assert got["x"] == pytest.approx(3.0) and got["intercept"] == pytest.approx(-2.0)
    assert fit.first()["r2"] == pytest.approx(1.0)
    r = random.Random(2)
    rows = [(r.gauss(100, 1), r.gauss(0, 2), r.gauss(0, 1)) for _ in range(300)]
    noisy = spark.createDataFrame([(a, b, a - 2 * b + e) for a, b, e in rows], "a double, b double, y double")
    coef = {r["term"]: r for r in models.ols(noisy, "y", ["a", "b"])[0].collect()}
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    vec = VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(noisy)
    m = LinearRegression(featuresCol="f", labelCol="y", solver="normal").fit(vec)
    assert coef["b"]["coefficient"] == pytest.approx(m.coefficients[1], rel=1e-6)
    assert coef["b"]["se"] == pytest.approx(m.summary.coefficientStandardErrors[1], rel=1e-6)


def test_split_is_independent_of_layout(layouts):
    rows = [(i,) for i in range(500)]
    parts = [features.split_holdout(df, ["id"], 0.3)[1].agg(F.sum("id"), F.count("id")).first() for df in layouts(rows, "id long")]
    assert parts[0] == parts[1] == parts[2] and 100 < parts[0][1] < 200


def test_unseen_labels_survive_a_stored_transform(spark):
    train = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (None, "a")], "x double, g string")
    new = spark.createDataFrame([(None, "zzz"), (5.0, None)], "x double, g string")
    model = features.fit_features(train, ["x"], ["g"], one_hot=False)
    out = features.apply_features(model, new, ["x"], ["g"]).select(vector_to_array("features")).collect()
    assert out[0][0] == [1.5, 2.0] and out[1][0] == [5.0, 2.0]


def test_planted_rule_is_found(spark):
    r = random.Random(4)
    rows = []
    for _ in range(400):
        a, b = r.choice(["hi", "lo"]), r.choice(["hi", "lo"])
        rows.append((a, b, "high" if a == "hi" and b == "lo" else r.choice(["high", "low", "low", "low"])))
    df = spark.createDataFrame(rows, "a string, b string, t string")
    items, _ = rules.binned_items(df, ["a", "b", "t"])
    counted = rules.count_baskets(items, ["a", "b", "t"])
    best = rules.top_rules(rules.target_rules(counted, "t", 0.05, 0.5)).first()
    assert best["lhs"] == "a:hi & b:lo" and best["rhs"] == "t:high" and best["lift"] > 1.5


def brute_itemsets(baskets, least):
    from collections import Counter
    from itertools import combinations

    n = Counter(c for b in baskets for k in range(1, len(b) + 1) for c in combinations(sorted(b), k))
    return {(k, v) for k, v in n.items() if v >= least}


def test_itemsets_of_nine_columns_and_clashing_names(spark):
    r = random.Random(5)
    names = ["c", "items", "n", "prefix", "rest", "f", "g", "h", "t"]
    rows = [tuple(r.choice(["a & b", "b", "c"]) if r.random() < 0.9 else None for _ in names) for _ in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"{x} string" for x in names))
    items, _ = rules.binned_items(df, names)
    counted = rules.count_baskets(items, names)
    got = {(tuple(x["items"]), x["n"]) for x in rules.frequent_itemsets(counted, 0.3).collect()}
    baskets = [[f"{k}:{v}" for k, v in zip(names, row) if v] for row in rows]
    baskets = [b for b in baskets if len(b) >= 2]
    assert got == brute_itemsets(baskets, 0.3 * len(baskets) - 1e-9)
    assert rules.target_rules(counted, "t", 0.1, 0.3).count() > 0


def test_capability_of_a_known_process(spark):
    r = random.Random(8)
    rows = [("m", i, r.gauss(10, 2)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, i long, v double")
    for size in (1, 5):
        c = spc.capability(df, ["k"], "v", ["i"], 4.0, 16.0, size).first()
        assert c["cp"] == pytest.approx(1.0, abs=0.05) and c["ppk"] == pytest.approx(1.0, abs=0.06)
        assert c["ppm"] == pytest.approx(2700, abs=900) and c["sigma_level"] == pytest.approx(4.28, abs=0.15)
    one = spc.capability(df, ["k"], "v", ["i"], None, 16.0).first()
    assert one["cp"] is None and one["cpk"] is not None and one["yield"] is None


def test_mars_finds_a_hinge(spark):
    df = spark.createDataFrame([(i / 10.0, max(0.0, i / 10.0 - 5)) for i in range(101)], "x double, y double")
    m = mars.fit(df, "y", ["x"], max_terms=5, interaction=1, knots_per_feature=19)
    scored = df.withColumn("p", m.column())
    assert evaluation.metrics_regression(scored, "y", "p").first()["r2"] > 0.999
    assert any(abs(h.knot - 5.0) < 0.3 for term in m.terms for h in term)


def test_arima_recovers_parameters_per_key(spark):
    r = np.random.default_rng(0)
    rows = []
    for key, phi, theta in (("ar", 0.7, 0.0), ("ma", 0.0, 0.5)):
        e = r.normal(size=4001)
        x = 0.0
        for i in range(1, 4001):
            x = phi * x + e[i] + theta * e[i - 1]
            rows.append((key, i, float(x)))
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(5)
    p, fitted = arima.fit(df, ["k"], "v", ["i"], 1, 0, 0)
    assert {x["k"]: x["ar"][0] for x in p.collect()}["ar"] == pytest.approx(0.7, abs=0.05)
    p, fitted = arima.fit(df, ["k"], "v", ["i"], 0, 0, 1)
    assert {x["k"]: x["ma"][0] for x in p.collect()}["ma"] == pytest.approx(0.5, abs=0.05)
    trend = spark.createDataFrame([("t", i, 2.0 * i) for i in range(60)], "k string, i long, v double")
    p, fitted = arima.fit(trend, ["k"], "v", ["i"], 0, 1, 0)
    steps = arima.forecast(p, fitted, ["k"], 0, 1, 0, 3).orderBy("step").collect()
    assert [s["forecast"] for s in steps] == pytest.approx([120.0, 122.0, 124.0])


def test_moving_range_stream_orders_late_rows_and_counts_drops(spark, tmp_path):
    base = 1_704_067_200

    def write(name, rows):
        df = spark.createDataFrame([("k", base + s, i, v) for s, i, v in rows], "k string, s long, id long, v double")
        df.select("k", F.timestamp_seconds("s").alias("ts"), "id", "v").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    schema = "k string, ts timestamp, id long, v double"
    write("a", [(0, 1, 1.0), (20, 3, 4.0), (10, 2, 2.0)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    write("b", [(500, 5, 9.0)])
    write("c", [(5, 4, 100.0), (900, 6, 1.0)])
    out = quality.run_to_end(quality.moving_range(stream, "k", "ts", "id", "v", "60 seconds"), "append")
    got = {r["id"]: r["mr"] for r in out.collect()}
    assert [got[1], got[2], got[3]] == [None, 1.0, 2.0] and 4 not in got and got[5] == 5.0


def test_rollups(spark):
    df = spark.createDataFrame([("a", 1.0), ("", 2.0), (None, 3.0), ("a", None)], "g string, x double")
    assert {r["level"]: r["n"] for r in charts.frequency(df, "g").collect()} == {"a": 2, "missing": 2}
    h = charts.histogram(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x", 4).orderBy("bin").collect()
    assert [r["n"] for r in h] == [2, 0, 0, 0]
    sampled = charts.scatter_sample(spark.range(1000).repartition(7), ["id"], [], 50)
    again = charts.scatter_sample(spark.range(1000).repartition(3), ["id"], [], 50)
    assert {r["id"] for r in sampled.collect()} == {r["id"] for r in again.collect()}
