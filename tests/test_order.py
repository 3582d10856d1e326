"""Slices, positions, history windows and order statistics against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.operators import order_stats, slices
from tabsmith.operators.cleaning import drop_duplicates


def hot_rows(n=3000, seed=3):
    """One key with most of the rows and one order value shared by a third of them."""
    r = random.Random(seed)
    return [
        ("hot" if r.random() < 0.7 else f"k{r.randint(1, 5)}", 7 if r.random() < 0.34 else r.randint(0, 900), i, r.gauss(0, 1))
        for i in range(n)
    ]


SCHEMA = "k string, t long, id long, v double"


def expected_positions(rows):
    out = {}
    for key in {r[0] for r in rows}:
        for i, row in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))):
            out[row[2]] = i + 1
    return out


@pytest.fixture()
def many_slices(monkeypatch):
    monkeypatch.setattr(slices, "ROWS_PER_SLICE", 50)
    monkeypatch.setattr(slices, "SKETCH_SHARE", 1.1)


def test_position_is_exact_for_any_layout(layouts, many_slices):
    rows = hot_rows()
    want = expected_positions(rows)
    for df in layouts(rows, SCHEMA):
        got = slices.with_position(df, ["k"], ["t", "id"]).select("id", "rn").collect()
        assert {r["id"]: r["rn"] for r in got} == want


def test_a_heavy_order_value_is_split_by_the_tie_break(spark, many_slices):
    df = spark.createDataFrame(hot_rows(), SCHEMA)
    s = slices.fit_slicer(df, F.col("t").cast("double"), F.col("id").cast("double"))
    assert 7.0 in s.heavy
    sizes = s.add(df, F.col("t").cast("double"), F.col("id").cast("double")).groupBy(slices.SLICE).count()
    assert sizes.agg(F.max("count")).first()[0] < 300


def test_position_without_keys_and_on_an_empty_frame(spark):
    df = spark.createDataFrame(hot_rows(200), SCHEMA)
    got = slices.with_position(df, [], ["t", "id"]).orderBy("rn").select("rn").collect()
    assert [r["rn"] for r in got] == list(range(1, 201))
    assert slices.with_position(df.where("false"), ["k"], ["t", "id"]).count() == 0


def test_null_keys_are_kept(spark):
    df = spark.createDataFrame([(None, 1, 1, 0.0), (None, 2, 2, 0.0), ("a", 1, 3, 0.0)], SCHEMA)
    got = {r["id"]: r["rn"] for r in slices.with_position(df, ["k"], ["t", "id"]).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_order_is_mandatory(spark):
    df = spark.createDataFrame([("a", 1, 1, 0.0)], SCHEMA)
    with pytest.raises(ValueError):
        slices.with_position(df, ["k"], [])
    with pytest.raises(ValueError):
        drop_duplicates(df, ["k"], [])


@pytest.mark.parametrize("chunk", [4, 7, 1000])
def test_history_windows_cross_chunks(spark, many_slices, chunk):
    rows = hot_rows(600)
    df = spark.createDataFrame(rows, SCHEMA)
    out = slices.with_history(
        df, ["k"], ["t", "id"], 3, lambda w: {"m": F.sum("v").over(w.rowsBetween(-3, -1))}, chunk
    ).collect()
    assert len(out) == len(rows)
    for key in {r[0] for r in rows}:
        seq = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        want = {r[2]: sum(x[3] for x in seq[max(0, i - 3):i]) if i else None for i, r in enumerate(seq)}
        for r in out:
            if r["k"] == key:
                assert r["m"] == pytest.approx(want[r["id"]]) if want[r["id"]] is not None else r["m"] is None


def reference_quantile(xs, p, rule):
    n = len(xs)
    if rule == "linear":
        return float(np.quantile(xs, p))
    if rule == "floor":
        return xs[min(int(n * p + 1e-9), n - 1)]
    if rule == "low":
        return xs[int(np.floor(p * (n - 1) + 1e-9))]
    if rule == "high":
        return xs[int(np.ceil(p * (n - 1) - 1e-9))]
    k = n * p
    if abs(k - round(k)) > 1e-9:
        return xs[int(np.ceil(k)) - 1]
    k = int(round(k))
    return (xs[k - 1] + xs[k]) / 2 if n % 2 == 0 else xs[k]


@pytest.mark.parametrize("rule", order_stats.RULES)
def test_quantile_rules_match_plain_python(layouts, many_slices, rule):
    r = random.Random(11)
    for n in (1, 2, 7, 40, 101):
        xs = [float(r.choice([1, 1, 1, 5, 9]) + r.randint(0, 3)) for _ in range(n)]
        want = [reference_quantile(sorted(xs), p, rule) for p in (0.25, 0.5, 0.75)]
        rows = [("g", x) for x in xs] + [("g", None)]
        for df in layouts(rows, "g string, x double"):
            got = order_stats.quantile_table(
                df, ["x"], {f"q{i}": (p, rule) for i, p in enumerate((0.25, 0.5, 0.75))}, ["g"]
            ).first()
            assert got["n"] == n
            assert [got["q0"], got["q1"], got["q2"]] == pytest.approx(want)


def test_quantiles_of_an_all_null_column_are_absent(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert order_stats.quantile_table(df, ["x"], {"m": (0.5, "linear")}).count() == 0


def test_average_ranks(layouts, many_slices):
    xs = [3.0, 1.0, 3.0, 2.0, 3.0, 1.0]
    for df in layouts([(x,) for x in xs], "x double"):
        got = {r["x"]: r["avg_rank"] for r in order_stats.rank_table(df, "x").collect()}
        assert got == {1.0: 1.5, 2.0: 3.0, 3.0: 5.0}


def test_large_tables_get_finer_cuts(spark, monkeypatch):
    monkeypatch.setattr(slices, "FIRST_SLICES", 8)
    monkeypatch.setattr(slices, "ROWS_PER_SLICE", 20)
    monkeypatch.setattr(slices, "SKETCH_SHARE", 1.1)
    df = spark.range(3000).withColumn("x", F.rand(1))
    s = slices.fit_slicer(df, F.col("x"))
    assert len(s.cuts) > 100
    placed = slices.with_position(df, [], ["x"])
    assert placed.orderBy("x").select("rn").limit(2000).agg(F.max("rn"), F.count_distinct("rn")).first()[:] == (2000, 2000)
