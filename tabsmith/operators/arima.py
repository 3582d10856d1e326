"""ARIMA(p, d, q) for many series at once, by exact maximum likelihood or by two-stage least squares.

Maximum likelihood: each series is stored as slices of consecutive values. A series of one slice is
fitted whole by the task that holds it. Longer ones are fitted together: a search on the driver asks
for the likelihood at several points, and one pass over the slices answers for all series by the
associative filter scan of `kalman`; only a few numbers a series and point reach the driver.

Two stages (Hannan-Rissanen): a long autoregression estimates the innovations, then values are
regressed on their own lags and lagged innovations, from one set of cross-products a series.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.scalars import number
from tabsmith.operators import kalman
from tabsmith.operators.models import gram, unpack
from tabsmith.operators.slices import broadcast_if_small, join_null_safe, with_history
from tabsmith.session import materialize


def difference(df: DataFrame, keys: list[str], value: str, order: list[str], d: int) -> DataFrame:
    """Series with its d-th difference in column z; `rn` is the position in the series."""
    src = df.select(*dict.fromkeys([*keys, *order]), number(df, value).alias("x")).where("x is not null")

    def build(w) -> dict:
        terms = F.lit(0.0)
        for k in range(d + 1):
            sign = (-1) ** k * math.comb(d, k)
            terms = terms + F.lit(float(sign)) * F.lag("x", k).over(w)
        return {"z": terms}

    return with_history(src, keys, order, max(d, 1), build)


def _lags(df: DataFrame, keys: list[str], specs: dict[str, tuple[str, int]]) -> DataFrame:
    reach = max(k for _, k in specs.values())
    return with_history(
        df, keys, ["rn"], reach,
        lambda w: {name: F.lag(c, k).over(w) for name, (c, k) in specs.items()},
    )


def _solve_rows(g: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Coefficients and residual sum per series from its Gram row: one small row per key."""

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                xx, xy = unpack(list(row.xx), k), np.array(row.xy)
                beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
                out.append((beta.tolist(), max(float(row.yy - beta @ xy), 0.0)))
            yield pdf[[*keys, "n"]].assign(beta=[o[0] for o in out], rss=[o[1] for o in out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in g.schema if f.name in keys)
    schema = f"{fields + ', ' if fields else ''}n double, beta array<double>, rss double"
    return g.mapInPandas(run, schema)


def _apply(beta: str, xs: list[str]):
    out = F.col(beta)[0]
    for i, x in enumerate(xs):
        out = out + F.col(beta)[i + 1] * F.col(x)
    return out


#: Values of a series that one task holds, and slices whose elements it joins at a time.
SLICE_ROWS = 100_000
FAN = 1024
#: Gain in log likelihood below which a search ends.
GAIN = 1e-5


def _filters(points: list, p: int, q: int) -> list[kalman.Filter]:
    return [kalman.Filter(*kalman.coefficients(np.asarray(x, dtype=float), p, q)) for x in points]


def _likelihoods(z: np.ndarray, points: list, p: int, q: int, constant: bool) -> list[kalman.Likelihood]:
    return [kalman.likelihood(e, constant) for e in kalman.elements(z, 0, _filters(points, p, q))]


def _fit_whole(p: int, q: int, constant: bool):
    """Column function: the values of a whole series to its free numbers, mean, variance and log likelihood."""

    @F.pandas_udf("array<double>")
    def run(series: pd.Series) -> pd.Series:
        def one(z):
            z = np.asarray(z, dtype=float)
            cost = lambda points: [-x.loglik / len(z) for x in _likelihoods(z, points, p, q, constant)]
            free, _ = kalman.solve(kalman.search(np.zeros(p + q), GAIN / len(z)), cost)
            best = _likelihoods(z, [free], p, q, constant)[0]
            return [*free, best.mean, best.sigma2, best.loglik]

        return series.map(one)

    return run


def _elements(points: dict[int, list], p: int, q: int):
    """Column function: (series number, first position, values) to one element for each point of that series.

    Gains depend on the point and the position alone: a task works them out once for all its slices of a series."""
    filters: dict[int, list[kalman.Filter]] = {}

    @F.pandas_udf("array<array<double>>")
    def run(number: pd.Series, start: pd.Series, values: pd.Series) -> pd.Series:
        def one(i, t, z):
            z, i = np.asarray(z, dtype=float), int(i)
            if i not in filters:
                filters[i] = _filters(points.get(i, []), p, q)
            return [e.numbers() for e in kalman.elements(z, int(t), filters[i])]

        return pd.Series([one(*row) for row in zip(number, start, values)])

    return run


def _joined(parts: DataFrame, by: list[str], size: int, slices: int) -> DataFrame:
    """Elements of (by, slice, e) joined in order until one is left for each `by`."""
    fields = ", ".join(f"{c} int" for c in by)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slice")
        whole = None
        for e in pdf["e"]:
            e = kalman.Element.of(e, size)
            whole = e if whole is None else whole.then(e)
        head = {c: [pdf[c].iloc[0]] for c in [*by, "block"]}
        return pd.DataFrame(head | {"e": [whole.numbers()]}).rename(columns={"block": "slice"})

    while True:
        blocked = parts.withColumn("block", (F.col("slice") / FAN).cast("int"))
        parts = blocked.groupBy(*by, "block").applyInPandas(join, f"{fields}, slice int, e array<double>")
        slices = -(-slices // FAN)
        if slices <= 1:
            return parts


def _start_states(parts: DataFrame, size: int, slices: int) -> DataFrame:
    """For (number, slice, e): the filter's state before each slice, as a form of (series, ones), flattened."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slice")
        at = np.asarray(pdf["before"].iloc[0], dtype=float).reshape(size, 2)
        out = []
        for e in pdf["e"]:
            out.append(at.ravel().tolist())
            at = kalman.Element.of(e, size).state @ np.vstack([np.eye(2), at])
        return pd.DataFrame({"number": pdf["number"], "slice": pdf["slice"], "state": out})

    zero = F.array_repeat(F.lit(0.0), 2 * size)
    blocked = parts.withColumn("block", (F.col("slice") / FAN).cast("int"))
    if slices <= FAN:
        blocked = blocked.withColumn("before", zero)
    else:
        upper = _joined(parts, ["number"], size, FAN)  # one level: one element a block
        upper = _start_states(upper, size, -(-slices // FAN))
        blocked = blocked.join(upper.select("number", F.col("slice").alias("block"), F.col("state").alias("before")), ["number", "block"])
    return blocked.groupBy("number", "block").applyInPandas(scan, "number int, slice int, state array<double>")


def _fit_long(cells: DataFrame, p: int, q: int, constant: bool, slices: int, rows: dict[int, int]):
    """Fit the series of (number, slice, start, z) together: {number: estimates}, and (number, slice, state)."""
    size = max(p, q + 1)

    def answers(points: dict[int, list]) -> dict[tuple[int, int], kalman.Likelihood]:
        found = cells.withColumn("all", _elements(points, p, q)("number", "start", "z"))
        parts = found.select("number", "slice", F.posexplode("all").alias("point", "e"))
        whole = _joined(parts, ["number", "point"], size, slices).collect()
        return {(r["number"], r["point"]): kalman.likelihood(kalman.Element.of(r["e"], size), constant) for r in whole}

    searches = {i: kalman.search(np.zeros(p + q), GAIN / rows[i]) for i in rows}
    asked = {i: next(s) for i, s in searches.items()}
    final = {}
    while asked:
        got = answers({i: [x.tolist() for x in points] for i, points in asked.items()})
        for i in list(asked):
            try:
                asked[i] = searches[i].send([-got[i, k].loglik / rows[i] for k in range(len(asked[i]))])
            except StopIteration as done:
                final[i] = done.value[0]
                del asked[i]
    points = {i: [x.tolist()] for i, x in final.items()}
    best = answers(points)
    estimates = {i: [*final[i].tolist(), b.mean, b.sigma2, b.loglik] for (i, _), b in best.items()}
    parts = cells.select("number", "slice", _elements(points, p, q)("number", "start", "z")[0].alias("e"))
    return estimates, _start_states(parts, size, slices)


def _errors(p: int, q: int):
    """Column function: one-step prediction errors of a slice's values."""
    kept: dict[tuple, kalman.Filter] = {}

    @F.pandas_udf("array<double>")
    def run(estimates: pd.Series, start: pd.Series, state: pd.Series, values: pd.Series) -> pd.Series:
        def one(est, t, at, z):
            free, mean = tuple(est[: p + q]), est[p + q]
            if free not in kept:  # the gains of the last series only: its slices follow each other
                kept.clear()
                (kept[free],) = _filters([free], p, q)
            f = kept[free]
            forms = kalman.innovations(np.asarray(z, dtype=float), int(t), f)
            begin = np.asarray(at, dtype=float).reshape(f.size, 2) @ [1.0, -mean] if at is not None else np.zeros(f.size)
            return (forms[:, 0] - mean * forms[:, 1] + forms[:, 2:] @ begin).tolist()

        return pd.Series([one(*row) for row in zip(estimates, start, state, values)])

    return run


def _coefficients(p: int, q: int):
    """Column function: estimates to const, the AR and the MA coefficients."""

    @F.pandas_udf("array<double>")
    def run(estimates: pd.Series) -> pd.Series:
        def one(est):
            ar, ma = kalman.coefficients(np.asarray(est[: p + q]), p, q)
            return [float(est[p + q] * (1 - ar.sum())), *ar.tolist(), *ma.tolist()]

        return estimates.map(one)

    return run


def _table(n, beta, sigma2, loglik, keys: list[str], p: int, q: int, count: int) -> list:
    none = F.array().cast("array<double>")
    return [
        *keys, n.cast("long").alias("n"), beta[0].alias("const"),
        (F.slice(beta, 2, p) if p else none).alias("ar"), (F.slice(beta, 2 + p, q) if q else none).alias("ma"),
        sigma2.alias("sigma2"), (-2 * loglik + 2 * count).alias("aic"), (-2 * loglik + count * F.ln(n)).alias("bic"),
        beta.alias("beta"),
    ]


def fit(
    df: DataFrame, keys: list[str], value: str, order: list[str], p: int = 1, d: int = 1, q: int = 1,
    constant: bool = True, slice_rows: int = SLICE_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(parameters per series, rows with one-step fits) by exact maximum likelihood of the d-th difference.

    Parameters: const, ar, ma, sigma2, aic, bic and the number of fitted rows. `constant` fits the mean
    of the difference (a drift for d = 1), else it is zero. Rows without a value are left out; a series
    with at most d values has no row. Results do not depend on `slice_rows` beyond rounding.
    """
    ks = keys or ["_all"]
    src = df if keys else df.withColumn("_all", F.lit(0))
    z = difference(src, ks, value, order, d).where("z is not null")
    t = F.col("rn") - d - 1
    cell = F.struct("rn", *[c for c in order if c not in ks], "x", "z")
    sliced = z.withColumn("_slice", F.floor(t / slice_rows).cast("int"))
    cells = materialize(sliced.groupBy(*ks, "_slice").agg(F.array_sort(F.collect_list(cell)).alias("_rows")), "slices")
    series = materialize(cells.groupBy(*ks).agg(F.max("_slice").alias("_last"), F.sum(F.size("_rows")).alias("_n")), "series")
    cells = join_null_safe(cells, broadcast_if_small(series), ks)
    # fitting costs far more than the bytes of a series tell: spread them by number
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    short = cells.where("_last = 0").repartition(parts, *ks).withColumn("_est", _fit_whole(p, q, constant)(F.col("_rows.z")))
    fitted = materialize(short.withColumn("_state", F.lit(None).cast("array<double>")), "short")
    # a long series fills at least one slice, so their number is the rows' divided by slice_rows
    many = [(*[r[k] for k in ks], i, r["_n"], r["_last"]) for i, r in enumerate(series.where("_last > 0").collect())]
    if many:
        schema = T.StructType([*[series.schema[k] for k in ks], T.StructField("number", T.IntegerType())])
        names = df.sparkSession.createDataFrame([m[:-2] for m in many], schema)
        own = join_null_safe(cells.where("_last > 0"), broadcast_if_small(names), ks)
        start = F.col("_slice").cast("long") * slice_rows
        # slices of a series lie together, so that a task works out the gains of few series
        dealt = own.select("number", F.col("_slice").alias("slice"), start.alias("start"), F.col("_rows.z").alias("z"))
        stored = materialize(dealt.repartitionByRange(parts, "number", "slice"), "long")
        found, states = _fit_long(stored, p, q, constant, max(m[-1] for m in many) + 1, {m[-3]: m[-2] for m in many})
        table = df.sparkSession.createDataFrame(list(found.items()), "number int, _est array<double>")
        states = states.select("number", F.col("slice").alias("_slice"), F.col("state").alias("_state"))
        done = own.join(table, "number").join(states, ["number", "_slice"]).select(*fitted.columns)
        fitted = fitted.unionByName(materialize(done, "long_fits"))
    est = F.col("_est")
    first = fitted.where("_slice = 0").withColumn("_beta", _coefficients(p, q)("_est"))
    count = p + q + int(constant) + 1
    params = first.select(*_table(F.col("_n"), F.col("_beta"), est[p + q + 1], est[p + q + 2], ks, p, q, count))
    errors = _errors(p, q)("_est", F.col("_slice").cast("long") * slice_rows, "_state", F.col("_rows.z"))
    rows = fitted.select(*ks, F.explode(F.arrays_zip(F.col("_rows").alias("r"), errors.alias("e"))).alias("_c"))
    rows = rows.select(*ks, "_c.r.*", F.col("_c.e").alias("error")).withColumn("fitted", F.col("x") - F.col("error"))
    drop = [] if keys else ["_all"]
    return broadcast_if_small(params.drop(*drop)), rows.drop(*drop)


def fit_two_stage(
    df: DataFrame, keys: list[str], value: str, order: list[str], p: int = 1, d: int = 1, q: int = 1
) -> tuple[DataFrame, DataFrame]:
    """(parameters per series, rows with one-step fits) by two-stage least squares: passes over the rows
    do not depend on how hard the likelihood is to maximise.

    Parameters: const, ar, ma, sigma2, aic, bic and the number of fitted rows.
    """
    # numbered and differenced once, lagged once: everything later reads the stored rows
    z = materialize(difference(df, keys, value, order, d).where("z is not null"), "series")
    long_order = max(p, q) + 8 if q else 0
    if q:
        specs = {f"l{i}": ("z", i) for i in range(1, long_order + 1)}
        lagged = _lags(z, keys, specs)
        g = gram(lagged.dropna(subset=list(specs)), list(specs), "z", keys)
        first = broadcast_if_small(_solve_rows(g, keys, long_order + 1).select(*keys, F.col("beta").alias("_b")))
        lagged = join_null_safe(lagged, first, keys) if keys else lagged.withColumn("_b", first.select("_b").scalar())
        z = lagged.withColumn("e", F.col("z") - _apply("_b", list(specs))).drop("_b", *specs)
    specs = {f"z{i}": ("z", i) for i in range(1, p + 1)}
    specs |= {f"e{i}": ("e", i) for i in range(1, q + 1)}
    rows = materialize(_lags(z, keys, specs), "lags") if specs else z
    xs = list(specs)
    g = gram(rows.dropna(subset=["z", *xs]), xs, "z", keys)
    solved = _solve_rows(g, keys, p + q + 1)
    n, k = F.col("n"), p + q + 1
    sigma2 = F.greatest(F.col("rss") / n, F.lit(1e-300))
    loglik = -n / 2 * (F.ln(2 * math.pi * sigma2) + 1)
    params = solved.select(*_table(n, F.col("beta"), sigma2, loglik, keys, p, q, k + 1))
    params = broadcast_if_small(params)
    joined = join_null_safe(rows, params.select(*keys, "beta"), keys) if keys else rows.withColumn(
        "beta", params.select("beta").scalar()
    )
    # The d-th difference is predicted, so the level's error is the difference's error.
    fitted = joined.withColumn("error", F.col("z") - _apply("beta", xs)).withColumn(
        "fitted", F.col("x") - F.col("error")
    )
    return params, fitted.drop("beta")


def metrics(fitted: DataFrame, keys: list[str]) -> DataFrame:
    e = F.col("error")
    return fitted.where("error is not null").groupBy(*keys).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae")
    )


def forecast(
    params: DataFrame, fitted: DataFrame, keys: list[str], p: int, d: int, q: int, steps: int = 10
) -> DataFrame:
    """Point forecasts per series. Only the last few rows of each series are needed."""
    tail = max(p, q, d, 1)
    last = fitted.groupBy(*keys).agg(F.max("rn").alias("_end"))
    near = join_null_safe(fitted, broadcast_if_small(last), keys) if keys else fitted.withColumn("_end", last.scalar())
    near = near.where(F.col("rn") > F.col("_end") - tail)
    e = F.col("error") if q else F.lit(0.0)
    state = near.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rn", "x", "z", F.coalesce(e, F.lit(0.0)).alias("e")))).alias("s")
    )
    both = join_null_safe(params, state, keys) if keys else params.withColumn("s", state.select("s").scalar())

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                hist = row["s"]
                z = [h["z"] for h in hist][::-1]
                err = [h["e"] for h in hist][::-1]
                x = [h["x"] for h in hist][::-1]
                # levels[k] is the latest k-th difference, for undoing the differencing.
                levels = [
                    sum((-1) ** j * math.comb(k, j) * x[j] for j in range(k + 1)) for k in range(d)
                ]
                for step in range(1, steps + 1):
                    nxt = row["const"]
                    nxt += sum(a * v for a, v in zip(row["ar"], z))
                    nxt += sum(b * v for b, v in zip(row["ma"], err))
                    z.insert(0, nxt)
                    err.insert(0, 0.0)
                    up = nxt
                    for k in reversed(range(d)):
                        levels[k] += up
                        up = levels[k]
                    out.append([*[row[k] for k in keys], step, float(up)])
            yield pd.DataFrame(out, columns=[*keys, "step", "forecast"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in params.schema if f.name in keys)
    schema = f"{fields + ', ' if fields else ''}step int, forecast double"
    return both.select(*keys, "const", "ar", "ma", "s").mapInPandas(run, schema)
