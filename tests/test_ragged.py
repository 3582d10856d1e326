"""Ragged files by ranges of bytes, and splits of a database scan."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tabsmith.sources import jdbc, ragged


def text_of(rows):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows(rows)
    return out.getvalue()


def make(seed, n):
    rng = random.Random(seed)
    words = ["plain", 'say "hi"', "two\nlines", "a,b", "größe", "温度", "tab\tin", "\n\n", "x" * 300]
    return [[str(i), *(rng.choice(words) for _ in range(rng.randrange(1, 4)))] for i in range(n)]


@pytest.mark.parametrize("width", [7, 64, 1000, 1 << 20])
def test_every_range_width_gives_the_same_records(tmp_path, width):
    rows = make(1, 120)
    raw = text_of(rows).encode()
    path = tmp_path / "a.txt"
    path.write_bytes(raw[:-1])  # the last record has no line break
    got = []
    for start in range(0, len(raw) - 1, width):
        inside = raw[:start].count(b'"') % 2 == 1
        got += ragged.records(f"file://{path}", start, min(start + width, len(raw) - 1), inside, True)
    assert [ragged.cells_of(r.decode(), True) for _, r in got] == rows
    assert all(raw[at:].startswith(r) for at, r in got)


def test_scan_of_quoted_files_with_filters(spark, tmp_path):
    want = {}
    for name, seed in (("a.txt", 2), ("b.txt", 3)):
        rows = make(seed, 150)
        (tmp_path / name).write_text("id,first\n" + text_of(rows), encoding="utf-8")
        want[name] = [tuple((r + [""] * 4)[:4]) for r in rows]
    df = ragged.scan_ragged_files(spark, str(tmp_path), quoted=True, width=500)
    assert df.columns == ["_path", "_at", "id", "first", "col_3", "col_4"]
    assert df.rdd.getNumPartitions() > 20
    plain = sorted(want["a.txt"] + want["b.txt"])
    assert sorted(tuple(r)[2:] for r in df.collect()) == plain
    some = df.where((F.col("first") == "a,b") & F.col("id").isin("3", "5", "40", "77", "78") & (F.length("id") == 2))
    assert sorted(tuple(r)[2:] for r in some.collect()) == [r for r in plain if r[1] == "a,b" and r[0] in ("40", "77", "78")]
    one = df.where(F.col("_path").endswith("a.txt")).count()
    assert one == 150
    path = df.select("_path").distinct().orderBy("_path").first()[0]
    early = df.where((F.col("_path") == path) & (F.col("_at") < 500))
    assert early.rdd.getNumPartitions() == 1
    assert early.count() == sum(1 for r in df.collect() if r["_path"] == path and r["_at"] < 500)


def test_unquoted_tabs_encodings_blank_lines_and_odd_headers(spark, tmp_path):
    (tmp_path / "g.txt").write_bytes("名称\t\t值,值\n温度\t\t1\t2\t9  \r\n\n   \n压力,2\n".encode("gbk"))
    df = ragged.scan_ragged_files(spark, str(tmp_path / "g.txt"), encoding="GBK", width=5)
    assert df.columns[2:] == ["名称", "值", "值_2", "col_4"]
    assert [tuple(r)[2:] for r in df.orderBy("_at").collect()] == [("温度", "1", "2", "9"), ("压力", "2", "", "")]
    (tmp_path / "empty.txt").write_text("")
    with pytest.raises(ValueError):
        ragged.scan_ragged_files(spark, str(tmp_path / "empty.txt"))


def test_splits_follow_skewed_keys_and_hold_every_row_once(spark):
    df = spark.range(20_000).select(F.when(F.col("id") < 18_000, F.col("id")).otherwise(F.col("id") * 100_000).alias("k"))
    df = df.unionByName(spark.createDataFrame([(None,)] * 7, "k long"))
    splits = jdbc.split_predicates("k", jdbc.key_cuts(df, "k", 8))
    sizes = [df.where(p).count() for p in splits]
    assert len(sizes) == 8 and sum(sizes) == 20_007 and max(sizes) < 1.2 * 20_007 / 8
    assert jdbc.split_predicates("k", jdbc.key_cuts(df.where("k < 0"), "k", 4)) == ["1 = 1"]
    for bad in ("k; drop", ""):
        with pytest.raises(ValueError):
            jdbc.split_predicates(bad, [1])
    with pytest.raises(ValueError):
        jdbc.split_predicates("k", ["x'"])
