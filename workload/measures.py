"""Measure operators in the vocabulary of DAX, with the filter context as explicit arguments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.functions import scalars
from tabsmith.operators import measures, relational
from workload.base import GAPPY, query

ORDERS_Y = "(SELECT *, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders)"


def orders_y(t):
    return t.orders.withColumn("y", F.year("o_orderdate"))


@query(
    "oee",
    """SELECT l_returnflag, round(run / nullif(planned, 0), 6) AS availability, round(actual / nullif(run * 0.5, 0), 6) AS performance,
      round(good / nullif(actual, 0), 6) AS quality, round(run / nullif(planned, 0) * (actual / nullif(run * 0.5, 0)) * (good / nullif(actual, 0)), 6) AS oee
      FROM (SELECT l_returnflag, sum(l_quantity) AS planned, sum(l_quantity * (1 - l_tax)) AS run, sum(l_quantity * 0.45) AS actual,
      sum(l_quantity * 0.45 * (1 - l_discount)) AS good FROM lineitem GROUP BY l_returnflag)""",
)
def oee(t):
    q = F.col("l_quantity")
    out = measures.oee(
        t.lineitem, ["l_returnflag"], planned=q, run=q * (1 - F.col("l_tax")), actual=q * 0.45,
        good=q * 0.45 * (1 - F.col("l_discount")), ideal_rate=0.5,
    )
    return out.withColumns({c: F.round(c, 6) for c in ("availability", "performance", "quality", "oee")})


@query(
    "pareto",
    """SELECT user_id, total, round(sum(total) OVER (ORDER BY total DESC RANGE UNBOUNDED PRECEDING) / sum(total) OVER (), 6) AS cumulative_share
      FROM (SELECT user_id, count(*)::DOUBLE AS total FROM events WHERE event_type = 'error' GROUP BY user_id)""",
)
def pareto(t):
    errors = t.events.where("event_type = 'error'")
    out = measures.pareto(errors, "user_id", F.count(F.lit(1)).cast("double"))
    return out.withColumn("cumulative_share", F.round("cumulative_share", 6))


@query(
    "dax_aggs",
    """SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS customers, count(*) AS rows,
      min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY o_orderstatus""",
)
def dax_aggs(t):
    return t.orders.groupBy("o_orderstatus").agg(
        F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_distinct("o_custkey").alias("customers"),
        F.count(F.lit(1)).alias("rows"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"),
    )


@query(
    "dax_iterators",
    "SELECT l_linestatus, round(sum(l_quantity * l_tax), 4) AS sumx, round(avg(l_extendedprice / l_quantity), 4) AS averagex FROM lineitem GROUP BY l_linestatus",
)
def dax_iterators(t):
    return t.lineitem.groupBy("l_linestatus").agg(
        F.round(F.sum(F.col("l_quantity") * F.col("l_tax")), 4).alias("sumx"),
        F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 4).alias("averagex"),
    )


@query(
    "dax_divide_math",
    """SELECT c_custkey, coalesce(c_acctbal / nullif(c_nationkey, 0), -1) AS ratio, round(c_acctbal, 1) AS rounded,
      abs(c_acctbal) AS absolute, ceil(c_acctbal / 250.0) * 250.0 AS up_to, c_nationkey - 12 - 5 * floor((c_nationkey - 12) / 5.0) AS modulo FROM customer""",
)
def dax_divide_math(t):
    n = F.col("c_nationkey")
    return t.customer.select(
        "c_custkey",
        scalars.divide(F.col("c_acctbal"), n, -1.0).alias("ratio"),
        F.round("c_acctbal", 1).alias("rounded"),
        F.abs("c_acctbal").alias("absolute"),
        scalars.ceiling_to(F.col("c_acctbal"), 250).alias("up_to"),
        scalars.floor_mod((n - 12).cast("double"), 5).cast("double").alias("modulo"),
    )


@query(
    "dax_filtered_measure",
    """SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total, round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0), 2) AS finished,
      round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 200000), 0), 2) AS large_finished FROM orders GROUP BY o_orderpriority""",
)
def dax_filtered_measure(t):
    done = F.col("o_orderstatus") == "F"
    large = F.col("o_totalprice") > 200000
    out = measures.filtered_sums(
        t.orders, ["o_orderpriority"], "o_totalprice",
        {"total": F.lit(True), "finished": done, "large_finished": done & large},
    )
    return out.withColumns({c: F.round(c, 2) for c in ("total", "finished", "large_finished")})


@query(
    "dax_share_of_total",
    """SELECT o_orderstatus, o_orderpriority, round(v / sum(v) OVER (), 6) AS share_all,
      round(v / sum(v) OVER (PARTITION BY o_orderstatus), 6) AS share_status FROM
      (SELECT o_orderstatus, o_orderpriority, sum(o_totalprice) AS v FROM orders GROUP BY ALL)""",
)
def dax_share_of_total(t):
    out = measures.share_of_total(
        t.orders, ["o_orderstatus", "o_orderpriority"], F.sum("o_totalprice"),
        {"share_all": [], "share_status": ["o_orderstatus"]},
    )
    return out.select(
        "o_orderstatus", "o_orderpriority", F.round("share_all", 6).alias("share_all"),
        F.round("share_status", 6).alias("share_status"),
    )


@query("dax_values_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def dax_values_distinct(t):
    return t.part.select("p_brand", "p_type").distinct()


@query(
    "dax_prior_period",
    """WITH m AS (SELECT date_trunc('month', o_orderdate) AS mon, sum(o_totalprice) AS v FROM orders GROUP BY 1)
      SELECT strftime(a.mon, '%Y-%m') AS month, round(a.v, 2) AS v, round(b.v, 2) AS last_month, round(c.v, 2) AS last_year,
      round((a.v - b.v) / nullif(b.v, 0), 6) AS mom FROM m a LEFT JOIN m b ON b.mon = a.mon - INTERVAL 1 MONTH LEFT JOIN m c ON c.mon = a.mon - INTERVAL 12 MONTH""",
)
def dax_prior_period(t):
    out = measures.prior_periods(
        t.orders, "o_orderdate", F.sum("o_totalprice"), {"last_month": 1, "last_year": 12}
    )
    mom = F.round(F.try_divide(F.col("value") - F.col("last_month"), F.col("last_month")), 6)
    return out.select(
        F.date_format("month", "yyyy-MM").alias("month"), F.round("value", 2).alias("v"),
        F.round("last_month", 2).alias("last_month"), F.round("last_year", 2).alias("last_year"), mom.alias("mom"),
    )


@query(
    "dax_to_date",
    """SELECT strftime(d, '%Y-%m-%d') AS day, strftime(date_trunc('month', d), '%Y-%m-%d') AS month_start, strftime(last_day(d), '%Y-%m-%d') AS month_end,
      round(sum(v) OVER (PARTITION BY year(d) ORDER BY d), 2) AS ytd FROM
      (SELECT CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1)""",
)
def dax_to_date(t):
    out = measures.year_to_date(t.orders, "o_orderdate", F.sum("o_totalprice"))
    return out.select(
        F.col("day").cast("string").alias("day"), F.trunc("day", "month").cast("string").alias("month_start"),
        F.last_day("day").cast("string").alias("month_end"), F.round("ytd", 2).alias("ytd"),
    )


@query(
    "dax_rolling_period",
    """SELECT strftime(d, '%Y-%m-%d') AS day, round(sum(v) OVER (ORDER BY d RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW), 2) AS rolling
      FROM (SELECT CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1)""",
)
def dax_rolling_period(t):
    out = measures.rolling_days(t.orders, "o_orderdate", F.sum("o_totalprice"), 30)
    return out.select(F.col("day").cast("string").alias("day"), F.round("rolling", 2).alias("rolling"))


@query(
    "dax_logic",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size,
      CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE 'none' END AS flag, l_discount IS NULL AS blank FROM {GAPPY}""",
)
def dax_logic(t):
    return t.gappy_lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.when(F.col("l_quantity") > 25, "big").otherwise("small").alias("size"),
        scalars.switch(F.col("l_returnflag"), {"A": "accepted", "R": "returned"}, "none").alias("flag"),
        scalars.is_blank(F.col("l_discount")).alias("blank"),
    )


@query(
    "dax_single_value",
    """SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN max(o_orderstatus) ELSE 'many' END AS selected,
      count(DISTINCT o_orderstatus) = 1 AS has_one FROM orders GROUP BY o_custkey""",
)
def dax_single_value(t):
    s = F.col("o_orderstatus")
    return t.orders.groupBy("o_custkey").agg(
        scalars.single_value(s, "many").alias("selected"), scalars.has_one_value(s).alias("has_one")
    )


@query(
    "dax_text",
    """SELECT o_orderkey, o_orderstatus || '-' || o_orderpriority AS joined, strftime(o_orderdate, '%Y-%m') AS month,
      format('{:,.2f}', o_totalprice) AS price FROM orders""",
)
def dax_text(t):
    return t.orders.select(
        "o_orderkey", F.concat("o_orderstatus", F.lit("-"), "o_orderpriority").alias("joined"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.format_number("o_totalprice", 2).alias("price"),
    )


@query(
    "dax_summarize",
    """SELECT c_mktsegment, n, total, round(total / n, 2) AS mean FROM (SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total
      FROM customer GROUP BY c_mktsegment)""",
)
def dax_summarize(t):
    s = t.customer.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total")
    )
    return s.withColumns({"mean": F.round(F.col("total") / F.col("n"), 2)}).select("c_mktsegment", "n", "total", "mean")


@query(
    "dax_lookup",
    """SELECT c_custkey, n_name, r_name, coalesce(k, 0) AS orders, round(coalesce(v, 0), 2) AS total FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
      LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT o_custkey, count(*) AS k, sum(o_totalprice) AS v FROM orders
      WHERE o_orderstatus = 'P' GROUP BY o_custkey) ON o_custkey = c_custkey""",
)
def dax_lookup(t):
    names = measures.lookup(t.customer, t.nation, "c_nationkey", "n_nationkey", ["n_name", "n_regionkey"])
    names = measures.lookup(names, t.region, "n_regionkey", "r_regionkey", ["r_name"])
    out = measures.related_totals(
        names, t.orders.where("o_orderstatus = 'P'"), "c_custkey", "o_custkey",
        {"orders": F.count(F.lit(1)), "total": F.sum("o_totalprice")},
    )
    return out.select("c_custkey", "n_name", "r_name", "orders", F.round("total", 2).alias("total"))


@query(
    "dax_topn_rank",
    """SELECT o_custkey, total, rnk, dense, round(running, 2) AS running FROM (SELECT o_custkey, total, rank() OVER (ORDER BY total DESC) AS rnk,
      dense_rank() OVER (ORDER BY total DESC) AS dense, sum(total) OVER (ORDER BY total DESC RANGE UNBOUNDED PRECEDING) AS running FROM
      (SELECT o_custkey, count(*) AS total FROM orders GROUP BY o_custkey)) WHERE rnk <= 40""",
)
def dax_topn_rank(t):
    totals = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total"))
    top = measures.top_n_with_ties(totals, "total", 40)
    return measures.rank_all(top, "total").select(
        "o_custkey", "total", "rnk", "dense", F.round(F.col("running").cast("double"), 2).alias("running")
    )


@query(
    "dax_rank_all",
    """SELECT o_custkey, total, rank() OVER (ORDER BY total DESC) AS rnk, dense_rank() OVER (ORDER BY total DESC) AS dense,
      sum(total) OVER (ORDER BY total DESC RANGE UNBOUNDED PRECEDING)::DOUBLE AS running FROM
      (SELECT o_custkey, count(*) AS total FROM orders GROUP BY o_custkey)""",
)
def dax_rank_all(t):
    totals = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total"))
    return measures.rank_all(totals, "total").withColumn("running", F.col("running").cast("double"))


C96 = "(SELECT o_custkey AS c, CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE o_orderstatus END AS s FROM orders WHERE year(o_orderdate) = 1996)"
C97 = C96.replace("1996", "1997")


def cust_in(t, year):
    return orders_y(t).where(F.col("y") == year).select(
        F.col("o_custkey").alias("c"),
        F.when(~F.col("o_orderpriority").like("5%"), F.col("o_orderstatus")).alias("s"),
    )


@query(
    "dax_setops",
    f"""SELECT 'union' AS op, c, s, count(*) AS n FROM (SELECT * FROM {C96} UNION ALL SELECT * FROM {C97}) GROUP BY c, s
      UNION ALL SELECT 'intersect', c, s, count(*) FROM {C96} a WHERE EXISTS (SELECT 1 FROM {C97} b WHERE a.c IS NOT DISTINCT FROM b.c AND a.s IS NOT DISTINCT FROM b.s) GROUP BY c, s
      UNION ALL SELECT 'except', c, s, count(*) FROM {C96} a WHERE NOT EXISTS (SELECT 1 FROM {C97} b WHERE a.c IS NOT DISTINCT FROM b.c AND a.s IS NOT DISTINCT FROM b.s) GROUP BY c, s""",
)
def dax_setops(t):
    a, b = cust_in(t, 1996), cust_in(t, 1997)
    parts = {
        "union": a.unionAll(b),
        "intersect": relational.intersect_rows(a, b.distinct()),
        "except": relational.except_rows(a, b.distinct()),
    }
    return relational.append(
        *[
            d.groupBy("c", "s").agg(F.count(F.lit(1)).alias("n")).withColumn("op", F.lit(k))
            for k, d in parts.items()
        ]
    )


@query(
    "dax_joins",
    """SELECT 'natural_inner' AS kind, count(*) AS n FROM orders NATURAL JOIN (SELECT c_custkey AS o_custkey FROM customer WHERE c_acctbal > 0)
      UNION ALL SELECT 'natural_left', count(*) FROM orders NATURAL LEFT JOIN (SELECT c_custkey AS o_custkey FROM customer WHERE c_acctbal > 0)
      UNION ALL SELECT 'cross', count(*) FROM (SELECT DISTINCT o_orderstatus FROM orders), (SELECT DISTINCT c_mktsegment FROM customer)""",
)
def dax_joins(t):
    rich = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    grid = measures.level_grid(t.orders, "o_orderstatus", t.customer, "c_mktsegment")
    parts = {
        "natural_inner": relational.natural_join(t.orders, rich),
        "natural_left": relational.natural_join(t.orders, rich, "left"),
        "cross": grid,
    }
    return relational.append(
        *[d.agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(k)) for k, d in parts.items()]
    )


@query(
    "dax_datatable",
    """SELECT o_orderpriority, weight, count(*) AS n FROM orders JOIN (VALUES ('1-URGENT', 5), ('2-HIGH', 3)) AS w(p, weight) ON o_orderpriority = p
      GROUP BY o_orderpriority, weight""",
)
def dax_datatable(t):
    weights = measures.data_table(t.spark, "p string, weight int", [("1-URGENT", 5), ("2-HIGH", 3)])
    return (
        t.orders.join(F.broadcast(weights), F.col("o_orderpriority") == F.col("p"))
        .groupBy("o_orderpriority", "weight")
        .agg(F.count(F.lit(1)).alias("n"))
    )
