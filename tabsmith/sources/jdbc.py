"""Database tables and mandatory time ranges.

The range planner works on any frame: over JDBC, Catalyst pushes its projection, filter and
limit into the database; over Parquet into the scan.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Identifier pattern, presets and sample sizes.
IDENTIFIER = re.compile(r"^[A-Za-z0-9_.$]+$")
PRESETS = {
    "1h": dt.timedelta(hours=1),
    "1d": dt.timedelta(days=1),
    "7d": dt.timedelta(days=7),
    "30d": dt.timedelta(days=30),
}
SAMPLE_ROWS = {"1k": 1_000, "10k": 10_000}
DRIVERS = {
    "mssql": ("jdbc:sqlserver://{host}:{port};databaseName={database}", 1433),
    "postgres": ("jdbc:postgresql://{host}:{port}/{database}", 5432),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", 3306),
}


def check_identifier(name: str) -> str:
    if not IDENTIFIER.match(name or ""):
        raise ValueError(f"not a plain identifier: {name!r}")
    return name


def jdbc_options(kind: str, host: str, database: str, table: str, port: int | None = None, **kw):
    """Reader options; `partition_column`, `lower`, `upper`, `partitions` split the scan."""
    if kind not in DRIVERS:
        raise ValueError(f"unknown database kind {kind!r}")
    pattern, default_port = DRIVERS[kind]
    options = {
        "url": pattern.format(host=host, port=port or default_port, database=database),
        "dbtable": check_identifier(table),
        "fetchsize": "10000",
        "pushDownLimit": "true",
    }
    if kw.get("partition_column"):
        options |= {
            "partitionColumn": check_identifier(kw["partition_column"]),
            "lowerBound": str(kw["lower"]),
            "upperBound": str(kw["upper"]),
            "numPartitions": str(kw["partitions"]),
        }
    for k in ("user", "password"):
        if k in kw:
            options[k] = kw[k]
    return options


def scan_jdbc(spark: SparkSession, kind: str, **kw) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(kind, **kw)).load()


def key_cuts(sample: DataFrame, key: str, parts: int) -> list:
    """At most parts - 1 different cut points of a key at equal shares of the rows, by approximate quantiles.

    Equal-width bounds give one split most rows where keys are dense in places; these follow the rows.
    """
    check_identifier(key)
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = sample.agg(F.percentile_approx(key, shares, 10_000).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


def split_predicates(key: str, cuts: list) -> list[str]:
    """One condition a split, for `spark.read.jdbc(predicates=...)`; each row meets exactly one, NULL keys the first."""
    check_identifier(key)
    if not cuts:
        return ["1 = 1"]
    marks = [_literal(c) for c in cuts]
    between = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(marks, marks[1:])]
    return [f"{key} < {marks[0]} OR {key} IS NULL", *between, f"{key} >= {marks[-1]}"]


def _literal(x) -> str:
    if isinstance(x, (dt.datetime, dt.date)):
        return f"{'TIMESTAMP' if isinstance(x, dt.datetime) else 'DATE'} '{x}'"
    if isinstance(x, (int, float)):
        return repr(x)
    raise ValueError("splits are on numbers, dates and times")


def scan_jdbc_splits(spark: SparkSession, kind: str, key: str, cuts: list, **kw) -> DataFrame:
    """A database table read by one task a split."""
    options = jdbc_options(kind, **kw)
    table, url = options.pop("dbtable"), options.pop("url")
    return spark.read.jdbc(url, table, predicates=split_predicates(key, cuts), properties=options)


def range_extract(
    df: DataFrame,
    time_column: str,
    start,
    end,
    columns: list[str] | None = None,
    limit: int | None = None,
    tie: list[str] = (),
) -> DataFrame:
    """All rows of a closed time range, or its newest `limit`; chosen columns only."""
    check_identifier(time_column)
    kept = df.where(F.col(time_column).between(F.lit(start), F.lit(end)))
    if limit is not None:
        kept = kept.orderBy(F.col(time_column).desc(), *tie).limit(limit)
    return kept.select(*[check_identifier(c) for c in columns]) if columns else kept


def range_preset(
    df: DataFrame,
    time_column: str,
    anchor: dt.datetime,
    preset: str | None = None,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    sampling: str | None = None,
    columns: list[str] | None = None,
    tie: list[str] = (),
) -> DataFrame:
    """Range by preset back from `anchor`; an explicit start or end wins; one is mandatory.

    Only a named sample cuts the rows.
    """
    if start is None:
        if preset not in PRESETS:
            raise ValueError("a time range is mandatory: give a preset or a start")
        start = anchor - PRESETS[preset]
    end = end or anchor
    if sampling and sampling not in SAMPLE_ROWS:
        raise ValueError(f"unknown sample {sampling!r}")
    rows = SAMPLE_ROWS[sampling] if sampling else None
    return range_extract(df, time_column, start, end, columns, rows, tie)
