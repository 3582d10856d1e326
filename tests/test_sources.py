"""Files, ranges and versions."""

import datetime as dt

import pytest

from tabsmith.sources import files, jdbc, versions


def test_gbk_files_are_recognised(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes("名称,值\n温度,1\n\n压力,2\n".encode("gbk"))
    (tmp_path / "u.csv").write_text("名称,值\n温度,1\n", encoding="utf-8")
    assert len(files.invalid_utf8_files(spark, str(tmp_path))) == 1
    g = files.scan_csv(spark, str(tmp_path / "g.csv"))
    assert g.columns == ["名称", "值"] and [r["名称"] for r in g.collect()] == ["温度", "压力"]
    assert files.scan_csv(spark, str(tmp_path / "u.csv")).first()["名称"] == "温度"


def test_csv_round_trip_with_quotes(spark, tmp_path):
    df = spark.createDataFrame([('a "b", c', "1"), ("x", "2")], "t string, n string")
    files.sink_csv(df, str(tmp_path / "out"))
    assert sorted(files.scan_csv(spark, str(tmp_path / "out")).collect()) == sorted(df.collect())


def test_ragged_text(spark):
    lines = [(0, "a,b"), (1, "1\t\t2\t3  "), (2, "   "), (3, "4"), (4, "5,6,7")]
    out = files.scan_ragged_text(spark.createDataFrame(lines, "i long, t string"), "i", "t")
    assert out.columns == ["i", "a", "b", "col_3"]
    assert [tuple(r) for r in out.orderBy("i").collect()] == [(1, "1", "2", "3"), (3, "4", "", ""), (4, "5", "6", "7")]


def test_ranges_are_mandatory_and_identifiers_checked(spark):
    df = spark.sql("select timestamp_ntz'2024-01-02' as ts, 1 as v")
    end = dt.datetime(2024, 1, 3)
    assert jdbc.range_preset(df, "ts", end, preset="1d").count() == 1
    assert jdbc.range_preset(df, "ts", end, preset="1h").count() == 0
    with pytest.raises(ValueError):
        jdbc.range_preset(df, "ts", end)
    with pytest.raises(ValueError):
        jdbc.range_extract(df, "ts; drop", 0, 1)
    o = jdbc.jdbc_options("postgres", host="h", database="d", table="s.t", partition_column="id", lower=0, upper=9, partitions=3)
    assert o["url"] == "jdbc:postgresql://h:5432/d" and o["numPartitions"] == "3"


def test_versions_count_up_and_latest_wins(spark, tmp_path):
    store = versions.VersionStore(spark, str(tmp_path / "s"))
    df = spark.range(5)
    assert [store.save(df, "a"), store.save(df.where("id > 2"), "a"), store.save(df, "b")] == [1, 2, 1]
    assert store.latest("a").count() == 2 and store.catalog().count() == 3
    with pytest.raises(KeyError):
        store.latest("zzz")


def test_a_folder_of_two_encodings_and_quoted_line_breaks(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.csv").write_bytes("id,name\n1,größe\n".encode())
    (folder / "b.csv").write_bytes("id,name\n2,温度\n".encode("gbk"))
    got = {r["id"]: r["name"] for r in files.scan_csv(spark, str(folder)).collect()}
    assert got == {"1": "größe", "2": "温度"}
    df = spark.createDataFrame([("1", 'two\nlines "quoted"'), ("2", "plain")], "id string, name string")
    files.sink_csv(df, str(tmp_path / "out"))
    back = files.scan_csv(spark, str(tmp_path / "out"), quoted_newlines=True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_two_writers_get_their_own_versions(spark, tmp_path):
    a, b = (versions.VersionStore(spark, str(tmp_path)) for _ in range(2))
    assert a._claim("x", 1) == 1 and b._claim("x", 1) == 2
