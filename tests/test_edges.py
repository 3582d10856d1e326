"""Rows, keys and names at the edges: NULL order values, zoned clocks, unlike keys, formulas."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabsmith.operators import charts, encoding, measures, relational
from tabsmith.operators.slices import with_position
from tabsmith.sources import jdbc


def test_positions_keep_rows_without_order(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", 3, 3), ("b", None, 4)], "k string, o int, id int")
    got = {r["id"]: r["rn"] for r in with_position(df, ["k"], ["o", "id"]).collect()}
    assert got == {1: 1, 3: 2, 2: 3, 4: 1}


def test_positions_through_the_end_of_summer_time(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        start = int(dt.datetime(2024, 11, 3, 4, 0, tzinfo=dt.timezone.utc).timestamp())
        df = spark.range(240).select("id", F.timestamp_seconds(F.lit(start) + F.col("id") * 60).alias("ts"))
        rows = with_position(df, [], ["ts", "id"]).collect()
        assert all(r["rn"] == r["id"] + 1 for r in rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_unlike_keys_meet(spark):
    left = spark.createDataFrame([(1,), (2,)], "a int")
    for kind in ("double", "long", "decimal(12,3)", "float"):
        right = left.select(F.col("a").cast(kind).alias("b"))
        assert relational.join(left, right, "a", "b").count() == 2, kind
    text = spark.createDataFrame([("1",), ("2",), ("x",)], "b string")
    assert relational.join(left.select(F.col("a").cast("double").alias("a")), text, "a", "b").count() == 2
    assert relational.join(left, text, "a", "b", "outer").count() == 3


def test_formulas_by_token(spark):
    df = spark.createDataFrame([(6.0, 2.0, 0.0)], "a double, `my col` double, `x/y` double")
    value = lambda f: relational.add_column_expr(df, "v", f).first()["v"]
    assert value("a / `my col`") == 3.0
    assert value("`x/y` + 1") == 1.0
    assert value("a/1e-5") == pytest.approx(6e5)
    assert value("a / `x/y`") is None
    assert value("a / -(2 + 1)") == -2.0
    assert value("a / abs(2) * 3") == 9.0
    assert value("8 / 2 / `my col`") == 2.0
    with pytest.raises(ValueError):
        value("a ** 2")


def test_ranks_and_shares_keep_rows_without_measure(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 3.0), (3, None), (4, 5.0)], "id int, v double")
    got = {r["id"]: (r["rnk"], r["dense"], r["running"]) for r in measures.rank_all(df, "v").collect()}
    assert got == {1: (1, 1, 10.0), 4: (1, 1, 10.0), 2: (3, 2, 13.0), 3: (4, 3, 13.0)}
    shares = {r["id"]: r["cumulative_share"] for r in measures.pareto(df, "id", F.sum("v")).collect()}
    assert shares[3] is None and len(shares) == 4


def test_histogram_keeps_the_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 1.0)], "g string, v double")
    rows = charts.histogram(df, "v", 2, ["g"]).collect()
    assert sum(r["n"] for r in rows if r["g"] is None) == 2 and len(rows) == 4


def test_too_many_levels_are_an_error(spark):
    df = spark.range(101).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        encoding.one_hot(df, ["c"])
    assert len(encoding.one_hot(df, ["c"], 101).columns) == 101


def test_extract_is_whole_unless_a_sample_is_named(spark):
    day = dt.datetime(2024, 1, 1)
    df = spark.range(150_000).select("id", F.lit(day).alias("ts"))
    assert jdbc.range_preset(df, "ts", day, "1d").count() == 150_000
    assert jdbc.range_preset(df, "ts", day, "1d", sampling="1k", tie=["id"]).count() == 1000


def test_five_hundred_columns_in_one_scan(spark):
    import numpy as np

    from tabsmith.operators import association
    from tabsmith.operators.pairwise import pair_moments

    names = [f"v{i}" for i in range(500)]
    wide = spark.range(300).select(*[
        F.when(F.xxhash64("id", F.lit(i)) % 7 != 0, F.xxhash64("id", F.lit(i % 50)) % 1000 + i * 1e4).cast("double").alias(n)
        for i, n in enumerate(names)
    ])
    x = np.array(wide.toPandas(), dtype=float)
    got = {(r["a"], r["b"]): r for r in pair_moments(wide, names).collect()}
    assert len(got) == 500 * 499 // 2
    for i, j in ((0, 1), (3, 53), (10, 499), (250, 300)):
        ok = np.isfinite(x[:, i]) & np.isfinite(x[:, j])
        row = got[names[i], names[j]]
        assert row["n"] == ok.sum()
        assert row["r"] == pytest.approx(np.corrcoef(x[ok, i], x[ok, j])[0, 1], abs=1e-9)
        assert row["cov"] == pytest.approx(np.cov(x[ok, i], x[ok, j])[0, 1], rel=1e-7, abs=1e-5)
    few = association.corr_pearson(wide, names[:4], p_values=False).collect()
    assert all(abs(r["r"] - got[r["a"], r["b"]]["r"]) < 1e-9 and r["n"] == got[r["a"], r["b"]]["n"] for r in few)


def test_tails_at_very_many_degrees_of_freedom():
    from tabsmith.functions import tails

    assert tails.t_two_sided(1.7, 1e11) == pytest.approx(0.0891309, abs=1e-7)
    for low, high in ((tails.t_two_sided(1.7, 9.9e6), tails.t_two_sided(1.7, 1.1e7)), (tails.f_upper(2.0, 3, 9.9e6), tails.f_upper(2.0, 3, 1.1e7)), (tails.chi2_upper(9.9e6 + 5000, 9.9e6), tails.chi2_upper(9.9e6 + 5000, 9.9e6 + 1))):
        assert low == pytest.approx(high, rel=2e-3)
