"""Registration of queries and access to the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the Parquet tables of one folder: `t.lineitem`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def gappy_lineitem(self) -> DataFrame:
        """lineitem with NULLs: quantity on every 7th order, discount on every 11th."""
        return self.lineitem.withColumns(
            {
                "l_quantity": F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")),
                "l_discount": F.when(F.col("l_orderkey") % 11 != 0, F.col("l_discount")),
            }
        )

    @property
    def text_lineitem(self) -> DataFrame:
        """lineitem with text numbers: blanks, junk and padded cells mixed in."""
        k = F.col("l_orderkey")
        return self.lineitem.withColumns(
            {
                "q_text": F.when(k % 7 == 0, "")
                .when(k % 13 == 0, "n/a")
                .otherwise(F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"))),
                "f_text": F.when(k % 5 == 0, " ").otherwise(F.col("l_returnflag")),
            }
        )


GAPPY = """(SELECT * REPLACE (CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS l_quantity,
  CASE WHEN l_orderkey % 11 <> 0 THEN l_discount END AS l_discount) FROM lineitem)"""

TEXTY = """(SELECT *, CASE WHEN l_orderkey % 7 = 0 THEN '' WHEN l_orderkey % 13 = 0 THEN 'n/a'
  ELSE ' ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS q_text,
  CASE WHEN l_orderkey % 5 = 0 THEN ' ' ELSE l_returnflag END AS f_text FROM lineitem)"""

ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
KEY_SQL = ", ".join(ROW_KEY)


def query(name: str, sql: str | None = None):
    """Register a query; `sql` is the statement DuckDB must agree with."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def t_two_sided_sql(t: str, df: str) -> str:
    """Two-sided t p-value by Simpson's rule over the density, as correlated SQL."""
    df = f"CAST({df} AS DOUBLE)"
    dens = (
        f"exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(({df}) * pi())"
        f" * pow(1 + pow(abs({t}) * s.i / 4000.0, 2) / ({df}), -(({df}) + 1) / 2.0)"
    )
    weight = "CASE WHEN s.i IN (0, 4000) THEN 1 WHEN s.i % 2 = 1 THEN 4 ELSE 2 END"
    return (
        f"greatest(0, 1 - 2 * (SELECT sum({weight} * {dens}) * abs({t}) / 12000.0"
        f" FROM range(0, 4001) s(i)))"
    )


def f_upper_sql(f: str, d1: str, d2: str) -> str:
    """Upper F probability by Simpson's rule over the beta density (d1 >= 2)."""
    x = f"(({d1}) * ({f}) / (({d1}) * ({f}) + ({d2})))"
    dens = (
        f"exp(lgamma((({d1}) + ({d2})) / 2.0) - lgamma(({d1}) / 2.0) - lgamma(({d2}) / 2.0))"
        f" * pow({x} * s.i / 4000.0, ({d1}) / 2.0 - 1)"
        f" * pow(1 - {x} * s.i / 4000.0, ({d2}) / 2.0 - 1)"
    )
    weight = "CASE WHEN s.i IN (0, 4000) THEN 1 WHEN s.i % 2 = 1 THEN 4 ELSE 2 END"
    return (
        f"greatest(0, 1 - (SELECT sum({weight} * {dens}) * {x} / 12000.0"
        f" FROM range(0, 4001) s(i)))"
    )


def chi2_upper_sql(x: str, df: str) -> str:
    """Upper chi-square probability by Simpson's rule over the density (df >= 2)."""
    dens = (
        f"exp((({df}) / 2.0 - 1) * ln(greatest(({x}) * s.i / 4000.0, 1e-300))"
        f" - ({x}) * s.i / 8000.0 - ({df}) / 2.0 * ln(2) - lgamma(({df}) / 2.0))"
    )
    weight = "CASE WHEN s.i IN (0, 4000) THEN 1 WHEN s.i % 2 = 1 THEN 4 ELSE 2 END"
    return (
        f"greatest(0, 1 - (SELECT sum({weight} * {dens}) * ({x}) / 12000.0"
        f" FROM range(0, 4001) s(i)))"
    )


def quantile_sql(column: str, p: float, rule: str) -> str:
    """Order statistic from a list aggregate, by the same rules as order_stats.RULES."""
    xs = f"list_sort(list({column}) FILTER (WHERE {column} IS NOT NULL))"
    n = f"len({xs})"
    if rule == "linear":
        return f"quantile_cont({column}, {p})"
    if rule == "floor":
        return f"{xs}[CAST(least(floor({n} * {p} + 1e-9), {n} - 1) AS BIGINT) + 1]"
    if rule == "low":
        return f"{xs}[CAST(floor({p} * ({n} - 1) + 1e-9) AS BIGINT) + 1]"
    if rule == "high":
        return f"{xs}[CAST(ceil({p} * ({n} - 1) - 1e-9) AS BIGINT) + 1]"
    if rule == "midpoint":
        k = f"({n} * {p})"
        return (
            f"CASE WHEN {k} <> floor({k}) THEN {xs}[CAST(ceil({k}) AS BIGINT)]"
            f" WHEN {n} % 2 = 0 THEN ({xs}[CAST({k} AS BIGINT)] + {xs}[CAST({k} AS BIGINT) + 1]) / 2"
            f" ELSE {xs}[CAST({k} AS BIGINT) + 1] END"
        )
    raise ValueError(rule)
