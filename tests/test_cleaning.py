"""Cleaning, profiles, encodings, formulas and step lists on small fixtures."""

import pytest
from pyspark.sql import functions as F

from tabsmith.operators import cleaning, encoding, profiling, relational
from tabsmith.plans import steps
from tabsmith.plans.registry import REGISTRY, check_call

DIRTY = [(1, " Foo "), (2, "﻿bar"), (3, ""), (4, "nan"), (5, "1e3"), (6, "12,5"), (7, "abc"), (8, None)]


def test_dirty_text_is_parsed_or_null(spark):
    df = spark.createDataFrame(DIRTY, "id int, t string")
    got = {r["id"]: r["t"] for r in cleaning.to_numeric(df, ["t"]).collect()}
    assert got[5] == 1000.0 and all(got[i] is None for i in (1, 2, 3, 4, 6, 7, 8))
    rej = cleaning.reject_counts(df, ["t"]).first()
    assert (rej["parsed"], rej["rejected"]) == (1, 5)


def test_normalize_frame(spark):
    df = spark.createDataFrame([("﻿ a ", 1), ("a", 1), ("None", 2)], "`﻿x ` string, y int")
    out = profiling.normalize_frame(df)
    assert out.columns == ["x", "y"]
    assert sorted((r["x"], r["y"]) for r in out.collect()) == [("", 2), ("a", 1)]


def test_constant_single_row_and_empty_frames(spark):
    const = spark.createDataFrame([(5.0,)] * 3, "x double")
    assert [r["x"] for r in cleaning.standardize(const, ["x"]).collect()] == [0.0] * 3
    assert [r["x"] for r in cleaning.minmax(const, ["x"], 2.0, 3.0).collect()] == [2.0] * 3
    assert cleaning.zscore_filter(const, ["x"]).count() == 3
    one = spark.createDataFrame([(5.0,)], "x double")
    assert cleaning.zscore_filter(one, ["x"]).count() == 1
    assert [r["x"] for r in cleaning.iqr_clip(one, ["x"]).collect()] == [5.0]
    empty = const.where("false")
    for op in ("fill_mean", "fill_median", "iqr_clip", "standardize", "minmax", "fill_mode", "zscore_filter"):
        assert cleaning.clean(empty, op, ["x"]).count() == 0
    nulls = spark.createDataFrame([(None,), (None,)], "x double")
    assert [r["x"] for r in cleaning.fill_mean(nulls, ["x"]).collect()] == [None, None]
    assert [r["x"] for r in cleaning.fill_median(nulls, ["x"]).collect()] == [None, None]


def test_fill_mode_breaks_ties_by_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("",), (None,)], "x string")
    assert [r["x"] for r in cleaning.fill_mode(df, ["x"]).collect()] == ["b", "a", "b", "a", "a", "a"]


def test_round_halves_go_up_and_log_keeps_negatives(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,), (-0.4,)], "x double")
    assert [r["x"] for r in cleaning.round_nearest(df, ["x"]).collect()] == [-2.0, 3.0, 0.0]
    assert [r["x"] for r in cleaning.log1p(df, ["x"]).collect()] == [-2.5, 1.2528, -0.4]


def test_unknown_operations_are_errors(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    with pytest.raises(ValueError):
        cleaning.clean(df, "copy", ["x"])
    with pytest.raises(ValueError):
        steps.run_steps(df, [{"type": "copy"}])
    with pytest.raises(ValueError):
        steps.run_steps(df, [])
    with pytest.raises(ValueError):
        steps.apply_to_many({}, [{"type": "minmax"}])


def test_label_codes_follow_first_appearance(layouts):
    rows = [(i, v) for i, v in enumerate(["z", "a", "z", "", "m", "a", None])]
    for df in layouts(rows, "id long, v string"):
        got = {r["id"]: r["v"] for r in encoding.label_encode(df, ["v"], "id").collect()}
        assert got == {0: 0, 1: 1, 2: 0, 3: None, 4: 2, 5: 1, 6: None}


def test_quantile_bins_are_left_closed_and_constant_gives_one_bin(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(9)] + [(None, 1.0)], "x double, c double")
    got = encoding.quantile_bins(df, ["x", "c"], 3).collect()
    by = {r["x"]: r["x_bin"] for r in got}
    assert by[2.0].startswith("low") and by[3.0].startswith("mid") and by[6.0].startswith("high")
    assert by[None] is None
    assert len({r["c_bin"] for r in got}) == 1


def test_one_hot_skips_wide_columns(spark):
    df = spark.createDataFrame([(f"v{i}",) for i in range(5)], "x string")
    assert encoding.one_hot(df, ["x"], max_levels=4).columns == ["x"]
    assert len(encoding.one_hot(df, ["x"]).columns) == 5


def test_formulas_allow_only_arithmetic(spark):
    df = spark.createDataFrame([(6.0, 0.0)], "a double, b double")
    assert relational.add_column_expr(df, "c", "(a + 2) * 3 / b").first()["c"] is None
    assert relational.add_column_expr(df, "c", "a / (a - 4) + abs(-a)").first()["c"] == 9.0
    for bad in ("drop(a)", "a; b", "nowhere + 1", "java_method('x')"):
        with pytest.raises(ValueError):
            relational.add_column_expr(df, "c", bad)
    out, problems = relational.derive_expr(df, "c = a * 2\n\nd = zzz + 1\ne = c + 1")
    assert out.columns == ["a", "b", "c", "e"] and len(problems) == 1


def test_text_filter_keeps_non_numeric_rows(spark):
    df = spark.createDataFrame([("5",), ("12",), ("x",), (None,)], "v string")
    assert sorted(str(r["v"]) for r in relational.filter_text(df, "v > 9").collect()) == ["12", "None", "x"]


def test_join_keeps_left_columns_on_clash(spark):
    a = spark.createDataFrame([(1, "l"), (2, "l")], "k int, v string")
    b = spark.createDataFrame([("1", "r", 9), ("1", "r", 8), ("3", "r", 7)], "k string, v string, w int")
    inner = relational.join(a, b, "k", "k", "inner")
    assert inner.columns == ["k", "v", "w"]
    assert sorted(r["w"] for r in inner.collect()) == [8, 9] and {r["v"] for r in inner.collect()} == {"l"}
    assert relational.join(a, b, "k", "k", "left").count() == 3
    assert relational.join(a, b, "k", "k", "anti").count() == 1


def test_profile_of_gappy_columns(layouts):
    rows = [(1.0, "a"), (2.0, ""), (None, None), (4.0, "a")]
    for df in layouts(rows, "x double, s string"):
        p = {r["column"]: r for r in profiling.profile_columns(df).collect()}
        assert (p["x"]["null_count"], p["x"]["unique_count"], p["x"]["median"]) == (1, 4, 2.0)
        assert (p["s"]["null_count"], p["s"]["unique_count"]) == (2, 2)
    h = profiling.health_score(layouts([(1.0,), (1.0,)], "x double")[0], ["x"]).first()
    assert (h["avg_missing"], h["outlier_rate"], h["score"]) == (0.0, 0.0, 100)


def test_scan_filters_and_columns_reach_parquet(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2.0D as x", "cast(id as string) as s").write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    out = relational.filter_range(df, {"x": {"min": 10, "max": 20}}).select("x")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x,10.0)" in plan and "ReadSchema: struct<x:double>" in plan


def test_registry_checks_arity_and_types(spark):
    df = spark.createDataFrame([(1.0, "a")], "x double, g string")
    spec = REGISTRY["anova_oneway"]
    check_call(spec, df, {"factor": ["g"], "column": ["x"]})
    with pytest.raises(ValueError):
        check_call(spec, df, {"factor": ["g"]})
    with pytest.raises(ValueError):
        check_call(spec, df, {"factor": ["g"], "column": ["g"]})
    assert F is not None
