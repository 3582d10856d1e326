"""Upserts by key: rows equal the full union, and files without a changed key keep their names."""

import pytest
from pyspark.sql import functions as F

from tabsmith.sources import keyed


def names(store, version=None):
    return {r["file"] for r in store.files(version).select("file").collect()}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("kind", ["long", "string", "timestamp"])
def test_only_files_with_a_changed_key_are_rewritten(spark, tmp_path, kind):
    def frame(ids, value):
        key = {
            "long": F.col("id"), "string": F.format_string("k%06d", "id"), "timestamp": F.timestamp_seconds("id")
        }[kind]
        return spark.createDataFrame([(i,) for i in ids], "id long").select(key.alias("a key"), F.lit(value).alias("v"))

    store = keyed.KeyedStore(spark, str(tmp_path / "s"), "a key", rows_per_file=100)
    store.create(frame(range(0, 4000, 2), "old"))
    before = names(store)
    assert len(before) >= 20
    # two keys that exist, lying in one or two files, and absent odd ones in ranges of many files
    assert store.upsert(frame([1000, 1002, *range(1, 4000, 398)], "new")) == 2
    assert len(before - names(store)) in (1, 2)
    want = {i: "old" for i in range(0, 4000, 2)} | {i: "new" for i in [1000, 1002, *range(1, 4000, 398)]}
    assert rows(store.read()) == rows(frame(list(i for i, v in want.items() if v == "old"), "old").unionByName(frame([i for i, v in want.items() if v == "new"], "new")))
    # a second generation lies across the first: its keys are found there too
    assert store.upsert(frame([1, 1000], "newer")) == 3
    got = dict(rows(store.read()))
    assert len(got) == len(want) and sum(v == "newer" for v in got.values()) == 2
    assert store.read(1).count() == 2000, "old versions stay readable"


def test_null_keys_repeated_keys_and_empty_tables(spark, tmp_path):
    schema = "id long, v string"
    store = keyed.KeyedStore(spark, str(tmp_path / "s"), "id", rows_per_file=2)
    store.create(spark.createDataFrame([], schema))
    assert store.read().count() == 0
    store.upsert(spark.createDataFrame([(None, "a"), (1, "a"), (1, "b"), (2, None)], schema))
    assert rows(store.read()) == rows(spark.createDataFrame([(None, "a"), (1, "b"), (2, None)], schema))
    store.upsert(spark.createDataFrame([(None, "z"), (3, "c")], schema))
    assert rows(store.read()) == rows(spark.createDataFrame([(None, "z"), (1, "b"), (2, None), (3, "c")], schema))
    held = names(store)
    store.upsert(spark.createDataFrame([], schema))
    assert held <= names(store) and store.read().count() == 4
    with pytest.raises(ValueError):
        store.upsert(spark.createDataFrame([(1,)], "id long"))


def test_a_version_is_written_once_and_a_failed_write_frees_it(spark, tmp_path):
    store = keyed.KeyedStore(spark, str(tmp_path / "s"), "id")
    df = spark.range(10)
    store.create(df)
    with pytest.raises(RuntimeError):
        store.create(df)
    with pytest.raises(Exception):
        store.upsert(df.select(F.raise_error(F.lit("no")).cast("long").alias("id")))
    assert store.upsert(spark.range(5, 15)) == 2 and store.read().count() == 15
