"""Sources and sinks, step lists, joins and the SQL-course operators."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import functions as F

from tabsmith.operators import cleaning, encoding, profiling, relational
from tabsmith.operators.slices import with_history
from tabsmith.plans import steps
from tabsmith.session import scratch_path
from tabsmith.sources import files, jdbc, keyed, ragged, versions
from workload.base import GAPPY, KEY_SQL, ROW_KEY, query, quantile_sql
from workload.preparation import (
    CLEAN_COLS, LABEL_SQL, MODE, STANDARD_SQL, base, keyed_sql, minmax_sql, rounded,
)

# --- sources and sinks ----------------------------------------------------------------------

CUSTOMER_TEXT = """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR)
  AS c_nationkey, c_mktsegment || ', "' || c_name || '"' AS note FROM customer"""


def customer_csv(t) -> str:
    path = scratch_path(t.spark, "csv")
    c = t.customer.select(
        "c_custkey", "c_name", "c_nationkey",
        F.concat("c_mktsegment", F.lit(', "'), "c_name", F.lit('"')).alias("note"),
    )
    files.sink_csv(c, path)
    return path


@query("scan_csv", CUSTOMER_TEXT)
def scan_csv(t):
    return files.scan_csv(t.spark, customer_csv(t))


@query("sink_csv", f"SELECT count(*) AS n, count(DISTINCT note) AS notes FROM ({CUSTOMER_TEXT})")
def sink_csv(t):
    back = files.scan_csv(t.spark, customer_csv(t))
    return back.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("note").alias("notes"))


@query(
    "scan_ragged_text",
    """SELECT CAST(o_orderkey AS BIGINT) + 1 AS line, CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status,
      CASE WHEN o_custkey % 3 <> 0 THEN o_orderpriority ELSE '' END AS col_3 FROM orders""",
)
def scan_ragged_text(t):
    header = t.region.where("r_regionkey = 0").select(F.lit(0).cast("long").alias("line"), F.lit("id,status").alias("text"))
    body = t.orders.select(
        (F.col("o_orderkey") + 1).alias("line"),
        F.when(
            F.col("o_custkey") % 3 == 0,
            F.concat("o_orderkey", F.lit("\t\t"), "o_orderstatus", F.lit("  ")),
        )
        .when(F.col("o_custkey") % 3 == 1, F.concat_ws("\t", "o_orderkey", "o_orderstatus", "o_orderpriority"))
        .otherwise(F.concat_ws(",", "o_orderkey", "o_orderstatus", "o_orderpriority"))
        .alias("text"),
    )
    return files.scan_ragged_text(header.unionByName(body), "line", "text")


@query("scan_parquet", "SELECT s_suppkey, s_acctbal FROM supplier")
def scan_parquet(t):
    return files.scan_parquet(t.spark, f"{t.folder}/supplier.parquet", ["s_suppkey", "s_acctbal"])


@query(
    "scan_jdbc",
    """SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate BETWEEN
      TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'""",
)
def scan_jdbc(t):
    """The range planner of the database reader; no database is at hand, so it reads Parquet."""
    return jdbc.range_extract(
        t.orders, "o_orderdate", dt.datetime(1996, 1, 1), dt.datetime(1996, 12, 31),
        ["o_orderkey", "o_orderdate", "o_totalprice"], tie=["o_orderkey"],
    )


@query(
    "range_extract",
    """SELECT event_id, ts, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND
      TIMESTAMP '2024-01-12 12:00:00' ORDER BY ts DESC, event_id LIMIT 1000""",
)
def range_extract(t):
    return jdbc.range_extract(
        t.events, "ts", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 12, 12),
        ["event_id", "ts", "value"], 1000, ["event_id"],
    )


@query(
    "range_preset",
    """SELECT event_id, ts, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-13' AND
      TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id LIMIT 10000""",
)
def range_preset(t):
    return jdbc.range_preset(
        t.events, "ts", dt.datetime(2024, 1, 20), preset="7d", sampling="10k",
        columns=["event_id", "ts", "value"], tie=["event_id"],
    )


@query("preview", "SELECT count(*) AS row_count, 5::INTEGER AS column_count, least(count(*), 100) AS shown FROM customer")
def preview(t):
    shown = files.preview(t.customer, 100).agg(F.count(F.lit(1)))
    return files.shape(t.customer).withColumn("shown", shown.scalar())


@query("sort_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def sort_page(t):
    return files.sort_page(
        t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], 3, 20, False
    )


@query(
    "save_version",
    """SELECT unnest(['orders_clean', 'orders_clean', 'orders_late']) AS name, unnest([1, 2, 1]::INTEGER[]) AS version,
      unnest([(SELECT count(*) FROM orders), (SELECT count(*) FROM orders WHERE o_orderstatus = 'F'),
      (SELECT count(*) FROM orders WHERE o_orderstatus = 'O')]) AS row_count""",
)
def save_version(t):
    store = versions.VersionStore(t.spark, scratch_path(t.spark, "store"))
    store.save(t.orders, "orders_clean")
    store.save(t.orders.where("o_orderstatus = 'F'"), "orders_clean")
    store.save(t.orders.where("o_orderstatus = 'O'"), "orders_late")
    return store.catalog().select("name", "version", "row_count")


@query(
    "latest_version",
    """SELECT o_custkey, max(o_orderkey) AS version, max_by(o_orderstatus || '/' || o_orderkey, o_orderkey) AS path
      FROM orders GROUP BY o_custkey""",
)
def latest_version(t):
    catalog = t.orders.select(
        "o_custkey", F.col("o_orderkey").alias("version"),
        F.concat_ws("/", "o_orderstatus", "o_orderkey").alias("path"),
    )
    return versions.latest_version(catalog, "o_custkey", "version", "path")


@query(
    "upsert_by_id",
    """SELECT event_id, ts, value FROM events WHERE event_type <> 'click' UNION ALL
      SELECT event_id, ts, value + 1000 FROM events WHERE event_type = 'click'""",
)
def upsert_by_id(t):
    e = t.events.select("event_id", "ts", "value", "event_type")
    local = e.where("event_type = 'click'").withColumn("value", F.col("value") + 1000)
    return (
        versions.upsert_by_id(e.drop("event_type"), local.drop("event_type"), "event_id")
        .orderBy(F.desc("ts"), "event_id")
    )


@query(
    "upsert_indexed",
    """SELECT event_id, ts, value FROM events WHERE ts < (SELECT max(ts) - INTERVAL 3 DAY FROM events)
      UNION ALL SELECT event_id, ts, value + 1000 FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 3 DAY FROM events)
      UNION ALL SELECT -1 - event_id, ts, value FROM events WHERE event_type = 'click'""",
)
def upsert_indexed(t):
    """All events, of which those of the last three days change and the clicks come again under new ids."""
    e = t.events.select("event_id", "ts", "value", "event_type")
    store = keyed.KeyedStore(t.spark, scratch_path(t.spark, "keyed"), "event_id")
    store.create(e.drop("event_type"))
    since = e.agg(F.max("ts") - F.expr("INTERVAL 3 DAYS")).scalar()
    changed = e.where(F.col("ts") >= since).withColumn("value", F.col("value") + 1000)
    again = e.where("event_type = 'click'").withColumn("event_id", -1 - F.col("event_id"))
    store.upsert(changed.unionByName(again).drop("event_type"))
    return store.read()


@query(
    "scan_ragged_files",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, o_orderpriority || chr(10) || 'no "' || o_custkey || '", checked' AS note
      FROM orders WHERE o_orderstatus <> 'O' AND o_orderstatus >= 'A'""",
)
def scan_ragged_files(t):
    """Orders as text files with quoted line breaks, read by ranges of 64 KB; the filter is pushed to the tasks."""
    path = scratch_path(t.spark, "ragged")
    note = F.concat(F.lit('"'), "o_orderpriority", F.lit('\nno ""'), "o_custkey", F.lit('"", checked"'))
    lines = t.orders.select(F.concat(F.col("o_orderkey").cast("string"), F.lit("\t\t"), "o_orderstatus", F.lit("\t"), note))
    lines.write.option("lineSep", "\n").text(path)
    rows = ragged.scan_ragged_files(t.spark, path, quoted=True, width=1 << 16, names=["id", "status", "note"], header=False)
    return rows.where("status <> 'O' AND status >= 'A'").drop("_path", "_at")


@query("jdbc_splits", "SELECT l_returnflag, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity FROM lineitem GROUP BY 1")
def jdbc_splits(t):
    """The splits of a database scan on the rows' own quantiles; no database is at hand, so they read Parquet."""
    splits = jdbc.split_predicates("l_orderkey", jdbc.key_cuts(t.lineitem, "l_orderkey", 6))
    parts = [t.lineitem.where(p).select("l_returnflag", "l_quantity") for p in splits]
    whole = reduce(lambda a, b: a.unionByName(b), parts)
    return whole.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("double").alias("quantity"))


# --- step lists -----------------------------------------------------------------------------


@query("step_minmax_range", minmax_sql(-1.0, 3.0))
def step_minmax_range(t):
    return steps.run_steps(base(t), [{"type": "normalize", "columns": CLEAN_COLS, "min": -1.0, "max": 3.0}])


@query("step_standardize", STANDARD_SQL)
def step_standardize(t):
    return steps.run_steps(base(t), [{"type": "standardize", "columns": CLEAN_COLS}])


def upper_median(c: str) -> str:
    return f"(SELECT {quantile_sql(c, 0.5, 'floor')} FROM {GAPPY})"


@query(
    "step_fill",
    keyed_sql(f"coalesce(l_quantity, {upper_median('l_quantity')})", f"coalesce(l_discount, {MODE.format(c='l_discount')})"),
)
def step_fill(t):
    return steps.run_steps(
        base(t),
        [
            {"type": "fill_missing", "columns": ["l_quantity"], "method": "median"},
            {"type": "fill_missing", "columns": ["l_discount"], "method": "mode"},
        ],
    )


@query("step_fill_constant", keyed_sql("coalesce(l_quantity, 7)", "coalesce(l_discount, 7)"))
def step_fill_constant(t):
    return steps.run_steps(base(t), [{"type": "fill", "columns": CLEAN_COLS, "method": "constant", "value": 7}])


@query("step_label_encode", LABEL_SQL)
def step_label_encode(t):
    return steps.run_steps(
        t.orders.select("o_orderkey", "o_orderpriority"),
        [{"type": "encode", "columns": ["o_orderpriority"], "order": "o_orderkey"}],
    )


ONE_HOT = ", ".join(
    f"CAST(o_orderstatus = '{s}' AS INTEGER) AS \"o_orderstatus_{s}\"" for s in "FOP"
)


@query("one_hot", f"SELECT o_orderkey, {ONE_HOT} FROM orders")
def one_hot(t):
    return encoding.one_hot(t.orders.select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])


@query(
    "step_binning",
    f"""SELECT {KEY_SQL}, CAST(CASE WHEN l_quantity IS NOT NULL THEN least(floor((l_quantity - lo) / (hi - lo) * 5) + 1, 5)
      END AS DOUBLE) AS l_quantity_bin FROM {GAPPY}, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM {GAPPY})""",
)
def step_binning(t):
    out = steps.run_steps(t.gappy_lineitem, [{"type": "binning", "columns": ["l_quantity"], "bins": 5}])
    return out.select(*ROW_KEY, F.col("l_quantity_bin").cast("double").alias("l_quantity_bin"))


@query(
    "add_column_expr",
    f"SELECT {KEY_SQL}, l_extendedprice * (1 - l_discount) / nullif(l_quantity - 10, 0) AS unit FROM {GAPPY}",
)
def add_column_expr(t):
    out = relational.add_column_expr(
        t.gappy_lineitem, "unit", "l_extendedprice * (1 - l_discount) / (l_quantity - 10)"
    )
    return out.select(*ROW_KEY, "unit")


@query(
    "derive_expr",
    f"SELECT {KEY_SQL}, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM {GAPPY}",
)
def derive_expr(t):
    out, _ = relational.derive_expr(
        t.gappy_lineitem,
        "net = l_extendedprice * (1 - l_discount)\nbroken = nowhere + 1\ngross = net * (1 + l_tax)",
    )
    return out.select(*ROW_KEY, "net", "gross")


@query(
    "filter_compare",
    """SELECT o_orderkey FROM orders WHERE o_totalprice >= 250000 AND o_orderstatus <> 'P'
      AND lower(o_orderpriority) LIKE '%urgent%'""",
)
def filter_compare(t):
    o = relational.filter_compare(t.orders, "o_totalprice", ">=", 250000)
    o = relational.filter_compare(o, "o_orderstatus", "!=", "P")
    return relational.filter_compare(o, "o_orderpriority", "contains", "URGENT").select("o_orderkey")


@query("filter_text", f"SELECT {KEY_SQL}, l_quantity FROM {GAPPY} WHERE l_quantity IS NULL OR l_quantity > 45")
def filter_text(t):
    return relational.filter_text(t.gappy_lineitem.select(*ROW_KEY, "l_quantity"), "l_quantity > 45")


@query(
    "filter_range",
    f"SELECT {KEY_SQL} FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 20 AND l_returnflag = 'R' AND lower(l_linestatus) LIKE '%o%'",
)
def filter_range(t):
    return relational.filter_range(
        t.lineitem,
        {"l_quantity": {"min": 10, "max": 20}, "l_returnflag": {"eq": "R"}, "l_linestatus": {"contains": "O"}},
    ).select(*ROW_KEY)


def text_customers(t):
    """All customers with text keys; every third key is moved out of range, so that it matches no order."""
    key = F.col("c_custkey") + F.when(F.col("c_custkey") % 3 == 0, 10_000_000).otherwise(0)
    return t.customer.select(key.cast("string").alias("ck"), "c_name", F.lit("x").alias("o_orderstatus"))


CUSTOMERS = "(SELECT CAST(c_custkey + CASE WHEN c_custkey % 3 = 0 THEN 10000000 ELSE 0 END AS VARCHAR) AS ck, c_name FROM customer)"


def order_keys(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")


@query("join_inner", f"SELECT o_orderkey, o_custkey, o_orderstatus, ck, c_name FROM orders JOIN {CUSTOMERS} ON CAST(o_custkey AS VARCHAR) = ck")
def join_inner(t):
    return relational.join(order_keys(t), text_customers(t), "o_custkey", "ck", "inner")


@query("join_left", f"SELECT o_orderkey, o_custkey, o_orderstatus, ck, c_name FROM orders LEFT JOIN {CUSTOMERS} ON CAST(o_custkey AS VARCHAR) = ck")
def join_left(t):
    return relational.join(order_keys(t), text_customers(t), "o_custkey", "ck", "left")


@query("join_outer", f"SELECT o_orderkey::DOUBLE AS o_orderkey, o_custkey::DOUBLE AS o_custkey, coalesce(o_orderstatus, CASE WHEN ck IS NOT NULL THEN 'x' END) AS o_orderstatus, ck, c_name FROM orders FULL JOIN {CUSTOMERS} ON CAST(o_custkey AS VARCHAR) = ck")
def join_outer(t):
    out = relational.join(order_keys(t), text_customers(t), "o_custkey", "ck", "outer")
    return out.withColumns({c: F.col(c).cast("double") for c in ("o_orderkey", "o_custkey")})


@query("join_unlike_numbers", "SELECT o_orderkey, c_custkey::DOUBLE AS ck, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_unlike_numbers(t):
    """A whole-number key against the same key as a double."""
    right = t.customer.select(F.col("c_custkey").cast("double").alias("ck"), "c_name")
    return relational.join(t.orders.select("o_orderkey", "o_custkey"), right, "o_custkey", "ck").drop("o_custkey")


@query("join_text_to_double", f"SELECT o_orderkey, ck, c_name FROM orders JOIN {CUSTOMERS} ON CAST(o_custkey AS VARCHAR) = ck")
def join_text_to_double(t):
    """A double key against text: whole doubles read as whole numbers."""
    left = t.orders.select("o_orderkey", F.col("o_custkey").cast("double").alias("k"))
    return relational.join(left, text_customers(t).drop("o_orderstatus"), "k", "ck").drop("k")


@query("merge", f"SELECT o_orderkey, o_custkey, o_orderstatus, ck, c_name FROM orders JOIN {CUSTOMERS} ON CAST(o_custkey AS VARCHAR) = ck")
def merge(t):
    return steps.run_steps(
        order_keys(t),
        [{"type": "merge", "right": text_customers(t), "left_key": "o_custkey", "right_key": "ck"}],
    )


@query(
    "apply_to_many",
    """SELECT 'customer' AS source, c_custkey AS id, round((c_acctbal - a) / (z - a), 4) AS balance FROM customer,
      (SELECT min(c_acctbal) AS a, max(c_acctbal) AS z FROM customer WHERE c_acctbal > 100) WHERE c_acctbal > 100
      UNION ALL SELECT 'supplier', s_suppkey, round((s_acctbal - a) / (z - a), 4) FROM supplier,
      (SELECT min(s_acctbal) AS a, max(s_acctbal) AS z FROM supplier WHERE s_acctbal > 100) WHERE s_acctbal > 100""",
)
def apply_to_many(t):
    frames = {
        "customer": t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")),
        "supplier": t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")),
    }
    done = steps.apply_to_many(
        frames,
        [{"type": "filter", "condition": "balance > 100"}, {"type": "normalize", "columns": ["balance"]}],
    )
    return relational.append(*[d.withColumn("source", F.lit(n)) for n, d in done.items()])


# --- SQL course -----------------------------------------------------------------------------


@query("sql_select", "SELECT * FROM part")
def sql_select(t):
    return t.part.select("*")


@query(
    "sql_where",
    """SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 5 AND 20 AND p_name LIKE 'red%'
      AND p_brand IN ('Brand#1', 'Brand#7', 'Brand#17') OR p_retailprice < 905 AND p_type <> 'ECONOMY'""",
)
def sql_where(t):
    p = t.part
    return p.where(
        (
            p.p_size.between(5, 20)
            & p.p_name.like("red%")
            & p.p_brand.isin("Brand#1", "Brand#7", "Brand#17")
        )
        | ((p.p_retailprice < 905) & (p.p_type != "ECONOMY"))
    ).select("p_partkey", "p_name")


@query("sql_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sql_order_limit(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query(
    "sql_aggregates",
    "SELECT count(*) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_extendedprice), 4) AS mean, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem",
)
def sql_aggregates(t):
    return t.lineitem.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"),
        F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.min("l_tax").alias("lo"), F.max("l_tax").alias("hi"),
    )


@query(
    "sql_group_having",
    "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12",
)
def sql_group_having(t):
    return (
        t.orders.groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
        .where("n > 12")
    )


@query(
    "sql_inner_join",
    """SELECT n_name, r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name""",
)
def sql_inner_join(t):
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("n_name", "r_name")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    )


@query(
    "unpivot",
    f"SELECT {KEY_SQL}, attribute, value FROM (SELECT {KEY_SQL}, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR attribute IN (l_quantity, l_discount, l_tax))",
)
def unpivot(t):
    return relational.unpivot(t.lineitem, ROW_KEY, ["l_quantity", "l_discount", "l_tax"])


@query(
    "pivot",
    """SELECT l_returnflag, sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS "F",
      sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS "O" FROM lineitem GROUP BY l_returnflag""",
)
def pivot(t):
    return relational.pivot(t.lineitem, ["l_returnflag"], "l_linestatus", "l_quantity", ["F", "O"])


@query(
    "merge_kinds",
    "SELECT kind, count(*) AS n, count(o_orderkey) AS orders, count(ck) AS customers FROM ("
    + " UNION ALL ".join(
        f"SELECT '{k}' AS kind, o_orderkey, ck FROM orders {j} JOIN {CUSTOMERS} ON CAST(o_custkey AS VARCHAR) = ck"
        for k, j in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL"))
    )
    + f" UNION ALL SELECT 'anti', o_orderkey, NULL FROM orders WHERE CAST(o_custkey AS VARCHAR) NOT IN (SELECT ck FROM {CUSTOMERS})) GROUP BY kind",
)
def merge_kinds(t):
    parts = []
    for kind in ("inner", "left", "right", "full", "anti"):
        j = relational.join(order_keys(t), text_customers(t), "o_custkey", "ck", kind)
        ck = F.col("ck") if "ck" in j.columns else F.lit(None).cast("string")
        parts.append(
            j.withColumn("ck", ck).agg(
                F.count(F.lit(1)).alias("n"), F.count("o_orderkey").alias("orders"), F.count("ck").alias("customers")
            ).withColumn("kind", F.lit(kind))
        )
    return relational.append(*parts)


@query(
    "append",
    "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier",
)
def append(t):
    return relational.append(
        t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
        t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
    )


@query(
    "text_proper",
    """SELECT p_partkey, list_aggregate(list_transform(string_split(p_name, ' '),
      lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS proper FROM part""",
)
def text_proper(t):
    return t.part.select("p_partkey", F.initcap("p_name").alias("proper"))


@query("end_of_month", "SELECT o_orderkey, CAST(last_day(o_orderdate) AS VARCHAR) AS month_end FROM orders")
def end_of_month(t):
    return t.orders.select("o_orderkey", F.last_day("o_orderdate").cast("string").alias("month_end"))


@query("select_rows", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01' AND o_totalprice > 100000")
def select_rows(t):
    return t.orders.where("o_orderdate >= timestamp_ntz'1999-01-01' and o_totalprice > 100000").select("o_orderkey")


@query(
    "describe",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,"
        f" min({c}) AS min, round(quantile_cont({c}, 0.25), 4) AS q1, round(median({c}), 4) AS median,"
        f" round(quantile_cont({c}, 0.75), 4) AS q3, max({c}) AS max FROM {GAPPY}"
        for c in ("l_quantity", "l_tax")
    ),
)
def describe(t):
    p = profiling.profile_columns(t.gappy_lineitem, ["l_quantity", "l_tax"])
    return rounded(
        p.select("column", "count", "mean", "std", "min", "q1", "median", "q3", "max"),
        4, "mean", "std", "q1", "median", "q3",
    )


@query("group_count", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def group_count(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "threshold_clean",
    f"""SELECT 'l_quantity' AS "column", count(*) AS count, round(avg(q), 4) AS mean, round(stddev_samp(q), 4) AS std, min(q) AS min, max(q) AS max
      FROM (SELECT coalesce(l_quantity, round((SELECT avg(l_quantity) FROM {GAPPY}), 4)) AS q FROM {GAPPY}) WHERE q <= 40""",
)
def threshold_clean(t):
    filled = cleaning.fill_mean(t.gappy_lineitem, ["l_quantity"]).where("l_quantity <= 40")
    p = profiling.profile_columns(filled, ["l_quantity"])
    return rounded(p.select("column", "count", "mean", "std", "min", "max"), 4, "mean", "std")


@query(
    "convert_rename",
    """SELECT event_id AS id, CAST(ts AS DATE)::VARCHAR AS day, CAST(value AS DOUBLE) AS reading,
      TRY_CAST(CASE WHEN user_id % 4 = 0 THEN 'x' ELSE CAST(user_id AS VARCHAR) END AS DOUBLE) AS "user" FROM events""",
)
def convert_rename(t):
    raw = t.events.select(
        F.col("event_id"), F.col("ts").cast("string").alias("ts"), F.col("value").cast("string").alias("value"),
        F.when(F.col("user_id") % 4 == 0, "x").otherwise(F.col("user_id").cast("string")).alias("user_id"),
    )
    typed = raw.withColumns(
        {
            "ts": F.to_date(F.try_to_timestamp("ts")).cast("string"),
            "value": F.expr("try_cast(value as double)"),
            "user_id": F.expr("try_cast(user_id as double)"),
        }
    )
    return typed.withColumnsRenamed({"event_id": "id", "ts": "day", "value": "reading", "user_id": "user"})


@query(
    "time_features",
    """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(dayofweek(ts) + 1 AS INTEGER) AS weekday, CAST(month(ts) AS INTEGER) AS month,
      round(avg(value) OVER w, 4) AS roll_mean, round(stddev_samp(value) OVER w, 4) AS roll_std FROM events
      WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""",
)
def time_features(t):
    rolled = with_history(
        t.events, ["event_type"], ["ts", "event_id"], 5,
        lambda w: {
            "roll_mean": F.round(F.avg("value").over(w.rowsBetween(-5, 0)), 4),
            "roll_std": F.round(F.stddev_samp("value").over(w.rowsBetween(-5, 0)), 4),
        },
    )
    return rolled.select(
        "event_id", F.hour("ts").alias("hour"), F.dayofweek("ts").alias("weekday"), F.month("ts").alias("month"),
        "roll_mean", "roll_std",
    )


@query(
    "threshold_anomaly",
    """SELECT event_id, value, coalesce(abs(value - m) > 2.5 * s, false) AS anomaly FROM (SELECT event_id, value,
      avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM events
      WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))""",
)
def threshold_anomaly(t):
    band = with_history(
        t.events, ["event_type"], ["ts", "event_id"], 20,
        lambda w: {
            "m": F.avg("value").over(w.rowsBetween(-20, -1)),
            "s": F.stddev_samp("value").over(w.rowsBetween(-20, -1)),
        },
    )
    out = F.coalesce(F.abs(F.col("value") - F.col("m")) > 2.5 * F.col("s"), F.lit(False))
    return band.select("event_id", "value", out.alias("anomaly"))


SCORED = "(SELECT *, l_quantity * 1500 AS predicted FROM lineitem)"


@query(
    "error_slices",
    f"""SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(abs(l_extendedprice - predicted)), 3) AS mae,
      round(avg(predicted - l_extendedprice), 3) AS bias FROM {SCORED} GROUP BY l_returnflag, l_linestatus""",
)
def error_slices(t):
    from tabsmith.operators.evaluation import error_slices as slices_of

    scored = t.lineitem.withColumn("predicted", F.col("l_quantity") * 1500)
    return rounded(slices_of(scored, "l_extendedprice", "predicted", ["l_returnflag", "l_linestatus"]), 3, "mae", "bias")
