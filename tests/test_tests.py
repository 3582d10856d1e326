"""Normality tests against their formulas, and splines on several layouts."""

from statistics import NormalDist

import numpy as np
import pytest

from tabsmith.operators import hypothesis, mars


def plain_shapiro_francia(x):
    n, nd = len(x), NormalDist()
    m = np.array([nd.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    x = np.sort(x)
    w = (m @ x) ** 2 / (m @ m) / ((x - x.mean()) ** 2).sum()
    u, v = np.log(np.log(n)) - np.log(n), np.log(np.log(n)) + 2 / np.log(n)
    return w, 1 - nd.cdf((np.log(1 - w) - (-1.2725 + 1.0521 * u)) / (1.0308 - 0.26758 * v))


def test_shapiro_francia_accepts_normal_and_rejects_skewed_samples(spark):
    r = np.random.default_rng(7)
    samples = {f"n{i}": r.normal(5, 3, size=int(n)) for i, n in enumerate(r.integers(20, 800, size=100))}
    samples |= {f"e{i}": r.exponential(size=200) for i in range(20)} | {"big": r.normal(size=5001), "four": r.normal(size=4)}
    rows = [(k, float(v)) for k, x in samples.items() for v in x] + [("n0", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(6)
    got = {x["k"]: x for x in hypothesis.shapiro_francia_by(df, ["k"], "x").collect()}
    for k, x in samples.items():
        w, p = plain_shapiro_francia(x)
        assert got[k]["n"] == len(x) and got[k]["w"] == pytest.approx(w, abs=1e-3)
        if k in ("big", "four"):
            assert got[k]["p"] is None
        else:
            assert got[k]["p"] == pytest.approx(p, abs=0.02)
    assert 89 <= sum(got[f"n{i}"]["p"] > 0.05 for i in range(100)) <= 99
    assert all(got[f"e{i}"]["p"] < 0.001 for i in range(20))
    one = hypothesis.shapiro_francia(df.filter("k = 'n3'"), "x").first()
    assert (one["n"], one["w"], one["p"]) == pytest.approx((got["n3"]["n"], got["n3"]["w"], got["n3"]["p"]), abs=1e-9)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_spline_terms_do_not_depend_on_the_layout(spark, parts):
    r = np.random.default_rng(1)
    x, z, u = r.integers(1, 51, size=4000), r.integers(0, 11, size=4000) / 100, r.normal(size=4000)
    rows = [(float(a), float(b), float(c), float(max(0, a - 20) * 2 + b * 50 + 1e4)) for a, b, c in zip(x, z, u)]
    df = spark.createDataFrame(rows, "x double, z double, u double, y double").repartition(parts)
    model = mars.fit(df, "y", ["x", "z", "u"])
    assert len(model.terms) == 2 and all(len(t) == 1 for t in model.terms)
    got = {model.features[t[0].feature]: (t[0].sign, c) for t, c in zip(model.terms, model.coefficients)}
    assert got["x"] == (1, pytest.approx(2.0, abs=1e-6)) and abs(got["z"][1]) == pytest.approx(50.0, abs=1e-4)
    worst = df.select(((model.column() - df["y"]) ** 2).alias("e")).agg({"e": "max"}).first()[0]
    assert worst < 1e-6


def test_spline_of_a_constant_and_of_nothing(spark):
    df = spark.createDataFrame([(float(i), 3.0) for i in range(50)], "x double, y double")
    model = mars.fit(df, "y", ["x"])
    assert model.terms == [] and model.intercept == pytest.approx(3.0)
    with pytest.raises(ValueError):
        mars.fit(df.filter("x < 0"), "y", ["x"])
