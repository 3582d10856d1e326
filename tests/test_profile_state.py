import math
import random

import pytest
from pyspark.sql import functions as F

from tabsmith.operators.profile_state import ProfileStore, merge_states, profile_state, read_states
from tabsmith.operators.profiling import profile_approx


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(4)
    rows = [(str(i % 5) if i % 50 else None, r.gauss(1e6, 1), None if i % 7 == 0 else float(i % 900), r.choice("abc"), None) for i in range(20000)]
    return spark.createDataFrame(rows, "part string, x double, n double, column string, gone double").repartition(6)


def by_column(df):
    return {r["column"]: r.asDict() for r in df.collect()}


def test_merged_parts_equal_the_whole(table):
    columns = ["x", "n", "column", "gone"]
    whole = by_column(profile_approx(table, columns))
    parts = by_column(read_states(merge_states(profile_state(table, columns, F.col("part")))))
    for c in columns:
        for f in ("row_count", "null_count", "min", "max"):
            assert parts[c][f] == whole[c][f], (c, f)
        for f in ("mean", "std"):
            a, b = parts[c][f], whole[c][f]
            assert a == b or math.isclose(a, b, rel_tol=1e-9), (c, f)
    assert whole["gone"]["null_count"] == 20000 and whole["gone"]["median"] is None and whole["gone"]["unique_count"] == 0
    assert whole["column"]["mean"] is None and whole["column"]["unique_count"] == 3


def test_errors_stay_in_bounds(table):
    """Rank of each quartile within 1 % and distinct counts within 5 %, merged or not."""
    for prof in (profile_approx(table, ["x", "n"]), read_states(merge_states(profile_state(table, ["x", "n"], F.col("part"))))):
        got = by_column(prof)
        for c in ("x", "n"):
            values = sorted(r[0] for r in table.select(c).dropna().collect())
            for name, rank in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
                q = got[c][name]
                low, high = sum(v < q for v in values) / len(values), sum(v <= q for v in values) / len(values)
                assert low - 0.01 <= rank <= high + 0.01, (c, name)
            assert abs(got[c]["unique_count"] / len(set(values)) - 1) < 0.05


def test_store_reads_only_new_parts(spark, table, tmp_path):
    store = ProfileStore(spark, str(tmp_path / "states"))
    with pytest.raises(FileNotFoundError):
        store.profile()
    assert store.update(table.where("part < '3'"), "part") == ["0", "1", "2"]
    # What is known is not read again: cells of known parts raise when they are evaluated.
    trap = F.when(F.col("part") < "3", F.raise_error(F.lit("read again")).cast("double")).otherwise(F.col("x"))
    assert store.update(table.withColumn("x", trap), "part") == [None, "3", "4"]
    assert store.update(table, "part") == []
    got, whole = by_column(store.profile()), by_column(profile_approx(table, ["x"]))
    assert got["x"]["row_count"] == 20000 and got["x"]["min"] == whole["x"]["min"]
    assert math.isclose(got["x"]["std"], whole["x"]["std"], rel_tol=1e-9)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "a double, b string")
    got = by_column(profile_approx(empty))
    assert got["a"]["row_count"] == 0 and got["a"]["median"] is None and got["b"]["unique_count"] == 0
    assert profile_state(empty, ["a"], F.col("b")).count() == 0
