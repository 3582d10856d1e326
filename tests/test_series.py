"""ARIMA by exact maximum likelihood against a plain sequential filter."""

import numpy as np
import pytest

from tabsmith.operators import arima, kalman


def plain_loglik(z, ar, ma, mean):
    """Log likelihood by the textbook recursion, one row after the other, variance concentrated."""
    r = max(len(ar), len(ma) + 1)
    t = np.zeros((r, r))
    t[: len(ar), 0] = ar
    t[:-1, 1:] = np.eye(r - 1)
    shock = np.concatenate([[1.0], ma, np.zeros(r - 1 - len(ma))])
    cover = np.linalg.solve(np.eye(r * r) - np.kron(t, t), np.outer(shock, shock).ravel()).reshape(r, r)
    a, squares, logs, errors = np.zeros(r), 0.0, 0.0, []
    for x in np.asarray(z) - mean:
        f, v = cover[0, 0], x - a[0]
        squares, logs = squares + v * v / f, logs + np.log(f)
        gain = t @ cover[:, 0] / f
        a, cover = t @ a + gain * v, t @ cover @ t.T - np.outer(gain, gain) * f + np.outer(shock, shock)
        errors.append(v)
    s2 = squares / len(z)
    return -len(z) / 2 * (np.log(2 * np.pi * s2) + 1) - logs / 2, s2, np.array(errors)


def series(seed, n, ar, ma, mean=0.0):
    e = np.random.default_rng(seed).normal(size=n + 300)
    z = np.zeros(n + 300)
    for t in range(5, n + 300):
        z[t] = e[t] + sum(a * z[t - 1 - i] for i, a in enumerate(ar)) + sum(b * e[t - 1 - i] for i, b in enumerate(ma))
    return z[300:] + mean


@pytest.mark.parametrize("ar,ma", [([0.6], [0.4]), ([0.5, -0.3], []), ([], [0.9]), ([0.2], [-0.5, 0.3, 0.1]), ([], [])])
def test_elements_join_to_the_sequential_filter(ar, ma):
    z = series(1, 1500, ar, ma, 3.0)
    f = kalman.Filter(np.array(ar), np.array(ma))
    for cuts in ([0, 1500], [0, 1, 2, 300, 301, 1100, 1500]):
        whole = None
        for a, b in zip(cuts, cuts[1:]):
            e = kalman.Element.of(kalman.elements(z[a:b], a, [kalman.Filter(np.array(ar), np.array(ma))])[0].numbers(), f.size)
            whole = e if whole is None else whole.then(e)
        got = kalman.likelihood(whole, True)
        want, s2, _ = plain_loglik(z, np.array(ar), np.array(ma), got.mean)
        assert got.loglik == pytest.approx(want, abs=1e-6) and got.sigma2 == pytest.approx(s2, rel=1e-9)
        less = max(plain_loglik(z, np.array(ar), np.array(ma), got.mean + d)[0] for d in (-0.01, 0.01))
        assert less < want


def test_transform_goes_back_and_forth():
    r = np.random.default_rng(3)
    for p, q in ((1, 1), (3, 2), (0, 4)):
        free = r.normal(size=p + q)
        assert kalman.free_numbers(*kalman.coefficients(free, p, q), limit=0.9999999) == pytest.approx(free, abs=1e-5)


@pytest.mark.parametrize("slice_rows", [100_000, 400, 130])
def test_fit_is_the_maximum_at_any_slice_size(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(arima, "FAN", 3)  # several levels of joining
    data = {"a": series(5, 1300, [0.7], [0.4], 2.0), None: series(6, 900, [-0.4], [0.3]), "short": series(7, 60, [0.5], [0.0])}
    rows = [(k, i, float(v)) for k, z in data.items() for i, v in enumerate(z)]
    df = spark.createDataFrame(rows + [("gap", 1, None), ("one", 1, 5.0)], "k string, i long, v double").repartition(7)
    params, fitted = arima.fit(df, ["k"], "v", ["i"], 1, 0, 1, slice_rows=slice_rows)
    got = {r["k"]: r for r in params.collect()}
    assert set(got) == {*data, "one"} and got["one"]["n"] == 1
    errors = {}
    for r in fitted.collect():
        errors.setdefault(r["k"], []).append((r["i"], r["error"], r["fitted"], r["x"]))
    for k, z in data.items():
        r = got[k]
        ar, ma = np.array(r["ar"]), np.array(r["ma"])
        mean = r["const"] / (1 - ar.sum())
        want, s2, plain = plain_loglik(z, ar, ma, mean)
        assert r["n"] == len(z) and r["sigma2"] == pytest.approx(s2, rel=1e-6)
        assert r["aic"] == pytest.approx(-2 * want + 8, abs=1e-3) and r["bic"] == pytest.approx(-2 * want + 4 * np.log(len(z)), abs=1e-3)
        for da, dm in ((0.01, 0), (-0.01, 0), (0, 0.01), (0, -0.01), (0.005, -0.005)):
            assert plain_loglik(z, ar + da, ma + dm, mean)[0] < want + 1e-4
        mine = sorted(errors[k])
        assert [e[1] for e in mine] == pytest.approx(list(plain), abs=1e-6)
        assert all(e[2] + e[1] == pytest.approx(e[3]) for e in mine)


def test_slice_sizes_agree_and_constant_can_be_left_out(spark):
    z = np.cumsum(series(9, 800, [0.5], [], 0.0))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(z)], "i long, v double").repartition(3)
    runs = [arima.fit(df, [], "v", ["i"], 1, 1, 1, constant=False, slice_rows=s)[0].first() for s in (100_000, 100)]
    for name in ("const", "sigma2", "aic", "bic"):
        assert runs[0][name] == pytest.approx(runs[1][name], rel=1e-5, abs=1e-3)
    assert runs[0]["const"] == 0.0 and runs[0]["n"] == 799
    assert runs[0]["ar"] + runs[0]["ma"] == pytest.approx(runs[1]["ar"] + runs[1]["ma"], abs=1e-3)
    empty, rows = arima.fit(df.filter("i < 0"), [], "v", ["i"], 1, 1, 1)
    assert empty.count() == 0 and rows.count() == 0


def test_two_stages_are_near_the_maximum(spark):
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(series(11, 3000, [0.6], [0.3]))], "k string, i long, v double")
    a, b = (f(df, ["k"], "v", ["i"], 1, 0, 1)[0].first() for f in (arima.fit, arima.fit_two_stage))
    assert a["ar"][0] == pytest.approx(b["ar"][0], abs=0.05) and a["ma"][0] == pytest.approx(b["ma"][0], abs=0.05)


def test_a_task_works_out_the_gains_of_a_series_once(spark, monkeypatch):
    import pandas as pd

    made, plain = [], arima._filters
    monkeypatch.setattr(arima, "_filters", lambda points, p, q: made.append(len(points)) or plain(points, p, q))
    z = series(4, 600, [0.5], [0.3])
    numbers, starts, slices = pd.Series([7] * 6), pd.Series(range(0, 600, 100)), pd.Series([z[i : i + 100] for i in range(0, 600, 100)])
    found = arima._elements({7: [[0.2, 0.1], [0.4, 0.3]]}, 1, 1).func(numbers, starts, slices)
    assert made == [2], "not once a slice"
    want = kalman.elements(z, 0, plain([[0.4, 0.3]], 1, 1))[0]
    whole = None
    for row in found:
        e = kalman.Element.of(row[1], want.state.shape[0])
        whole = e if whole is None else whole.then(e)
    assert whole.squares == pytest.approx(want.squares, rel=1e-9) and whole.rows == 600
    made.clear()
    errors = arima._errors(1, 1).func(pd.Series([[0.4, 0.3, 0.0, 1.0, 0.0]] * 6), starts, pd.Series([None] * 6), slices)
    assert made == [1] and len(errors[0]) == 100
