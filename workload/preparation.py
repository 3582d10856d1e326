"""Sources, schema, profiles and single-step cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.operators import cleaning, encoding, profile_state, profiling
from workload.base import GAPPY, KEY_SQL, ROW_KEY, TEXTY, query, quantile_sql

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def union_columns(template: str, columns: list[str]) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


# --- schema ---------------------------------------------------------------------------------

SCHEMA_COLS = ["q_text", "f_text", "l_tax", "l_linestatus"]


@query(
    "infer_schema",
    union_columns(
        "SELECT '{c}' AS \"column\", CASE WHEN count(TRY_CAST({c} AS DOUBLE)) / count(*)::DOUBLE > 0.7"
        " THEN 'numeric' ELSE 'categorical' END AS type,"
        " count(*) FILTER (WHERE {c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '') / count(*)::DOUBLE"
        " AS missing_rate FROM " + TEXTY,
        SCHEMA_COLS,
    ),
)
def infer_schema(t):
    return profiling.infer_schema(t.text_lineitem, SCHEMA_COLS)


@query(
    "tag_columns",
    """SELECT * FROM (VALUES
      ('event_id', 'numeric', false, false, false, false),
      ('ts', 'datetime', true, false, false, false),
      ('user_id', 'numeric', false, false, false, false),
      ('event_type', 'categorical', false, false, false, false),
      ('value', 'numeric', false, false, false, false),
      ('ts_text', 'datetime', true, false, false, false),
      ('machine_code', 'categorical', false, true, false, false),
      ('output_qty', 'numeric', false, false, false, true))
      AS v("column", type, is_time, is_device, is_product, is_quantity)
      WHERE (SELECT count(*) FROM events WHERE value IS NOT NULL) > 0""",
)
def tag_columns(t):
    e = t.events.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.col("ts").cast("string").alias("ts_text"),
        F.concat(F.lit("M"), F.col("user_id") % 5).alias("machine_code"),
        F.col("value").cast("int").cast("string").alias("output_qty"),
    )
    return profiling.tag_columns(e)


@query(
    "normalize_frame",
    """SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN '' ELSE event_type END AS event_type,
      user_id FROM events""",
)
def normalize_frame(t):
    e = t.events.select(
        F.when(F.col("user_id") % 3 == 0, F.lit(" nan "))
        .otherwise(F.concat(F.lit("﻿ "), F.col("event_type"), F.lit("  ")))
        .alias("﻿event_type "),
        F.col("user_id").alias(" user_id"),
    )
    return profiling.normalize_frame(e)


# --- profiles -------------------------------------------------------------------------------

PROFILE_TEMPLATE = (
    "SELECT '{c}' AS \"column\", count(*) AS row_count, count(*) - count({c}) AS null_count,"
    " count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS unique_count,"
    " count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,"
    " min({c}) AS min, max({c}) AS max, round(quantile_cont({c}, 0.25), 4) AS q1,"
    " round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3 FROM "
    + GAPPY
)


def rounded(df, digits: int, *cols: str):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("profile_columns", union_columns(PROFILE_TEMPLATE, NUM))
def profile_columns(t):
    return rounded(
        profiling.profile_columns(t.gappy_lineitem, NUM), 4, "mean", "std", "q1", "median", "q3"
    )


@query("profile_approx")
def profile_approx(t):
    return profiling.profile_approx(t.gappy_lineitem, [*NUM, "l_returnflag"])


@query(
    "profile_merged",
    union_columns(
        "SELECT '{c}' AS \"column\", count(*) AS row_count, count(*) - count({c}) AS null_count,"
        " round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min, max({c}) AS max FROM " + GAPPY,
        NUM,
    ),
)
def profile_merged(t):
    """States of each month merged; the sketched figures, which SQL cannot repeat, are left to the tests."""
    states = profile_state.profile_state(t.gappy_lineitem, NUM, F.date_format("l_shipdate", "yyyy-MM"))
    whole = profile_state.read_states(profile_state.merge_states(states))
    return rounded(whole.select("column", "row_count", "null_count", "mean", "std", "min", "max"), 4, "mean", "std")


QUALITY_COLS = ["q_text", "f_text", "l_tax", "l_linestatus"]


@query(
    "quality_table",
    union_columns(
        "SELECT '{c}' AS \"column\", CASE WHEN num THEN 'numeric' ELSE 'categorical' END AS type,"
        " total, missing, round(missing * 100.0 / total, 2) AS missing_pct, distinct_count,"
        " CASE WHEN num THEN lo END AS min, CASE WHEN num THEN hi END AS max,"
        " CASE WHEN missing * 100.0 / total > 30 THEN 'missing' WHEN distinct_count <= 1 THEN 'constant'"
        " ELSE 'ok' END AS warning FROM (SELECT count(*) AS total, count(*) - count(v) AS missing,"
        " count(DISTINCT v) AS distinct_count, count(d) / count(v)::DOUBLE > 0.7 AS num,"
        " min(d) AS lo, max(d) AS hi FROM (SELECT v, TRY_CAST(v AS DOUBLE) AS d FROM"
        " (SELECT nullif(trim(CAST({c} AS VARCHAR)), '') AS v FROM " + TEXTY + ")))",
        QUALITY_COLS,
    ),
)
def quality_table(t):
    return profiling.quality_table(t.text_lineitem, QUALITY_COLS)


SKEWED = """(SELECT *, CASE WHEN l_partkey % 97 = 0 THEN l_extendedprice * 20
  ELSE l_extendedprice END AS spiky FROM """ + GAPPY + ")"


def spiky(t):
    return t.gappy_lineitem.withColumn(
        "spiky",
        F.when(F.col("l_partkey") % 97 == 0, F.col("l_extendedprice") * 20).otherwise(
            F.col("l_extendedprice")
        ),
    )


OUTLIER_TEMPLATE = (
    "SELECT '{c}' AS \"column\", count({c}) AS n, count(*) FILTER (WHERE abs({c} - m) > 3 * s)"
    " AS outliers FROM " + SKEWED + ", (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM " + SKEWED + ")"
)


@query("outlier_count_3sigma", union_columns(OUTLIER_TEMPLATE, ["l_quantity", "spiky", "l_tax"]))
def outlier_count_3sigma(t):
    return profiling.outlier_count_3sigma(spiky(t), ["l_quantity", "spiky", "l_tax"])


@query(
    "health_score",
    "SELECT round(avg_missing, 6) AS avg_missing, round(outlier_rate, 6) AS outlier_rate,"
    " CAST(greatest(0, least(100, floor((1 - avg_missing) * 40 + (1 - outlier_rate) * 40 + 20 + 0.5)))"
    " AS INTEGER) AS score FROM (SELECT avg(mr) AS avg_missing FROM ("
    + union_columns(
        "SELECT (count(*) - count({c})) / count(*)::DOUBLE AS mr FROM " + SKEWED,
        ["l_quantity", "spiky", "l_tax"],
    )
    + ")), (SELECT sum(outliers) / sum(n)::DOUBLE AS outlier_rate FROM ("
    + union_columns(OUTLIER_TEMPLATE, ["l_quantity", "spiky", "l_tax"])
    + "))",
)
def health_score(t):
    return rounded(
        profiling.health_score(spiky(t), ["l_quantity", "spiky", "l_tax"]),
        6, "avg_missing", "outlier_rate",
    )


def derived(t):
    """A frame with real dependence between columns, and gaps."""
    return t.gappy_lineitem.withColumns(
        {
            "y": 3 * F.col("l_quantity") - 40 * F.col("l_discount") + F.col("l_partkey") % 17,
            "z": F.col("l_quantity") + F.col("l_suppkey") % 5,
        }
    )


DERIVED = "(SELECT *, 3 * l_quantity - 40 * l_discount + l_partkey % 17 AS y, l_quantity + l_suppkey % 5 AS z FROM " + GAPPY + ")"
CORR_COLS = ["l_quantity", "l_discount", "y", "z"]


def corr_pairs_sql(expr: str, columns: list[str]) -> str:
    parts = []
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            parts.append(expr.format(a=a, b=b))
    return " UNION ALL ".join(parts)


@query(
    "pair_corr_matrix",
    "SELECT * FROM ("
    + union_columns("SELECT '{c}' AS a, '{c}' AS b, 1.0::DOUBLE AS r", CORR_COLS)
    + " UNION ALL "
    + corr_pairs_sql(
        "SELECT unnest(['{a}', '{b}']) AS a, unnest(['{b}', '{a}']) AS b, r FROM"
        " (SELECT round(corr({a}, {b}), 3) AS r FROM " + DERIVED + ")",
        CORR_COLS,
    )
    + ")",
)
def pair_corr_matrix(t):
    return profiling.pair_corr_matrix(derived(t), CORR_COLS)


FE_CAT = ["l_returnflag", "l_linestatus"]


@query(
    "fe_plan",
    union_columns(
        "SELECT 'fill' AS item, '{c}' AS name, CASE WHEN count({c}) = count(*) THEN 'none' ELSE"
        " 'mean' END AS strategy, (count(*) - count({c}))::DOUBLE AS value FROM " + DERIVED,
        [*CORR_COLS, *FE_CAT],
    )
    + " UNION ALL SELECT 'collinear', a || '|' || b, 'drop one', r FROM ("
    + corr_pairs_sql(
        "SELECT least('{a}', '{b}') AS a, greatest('{a}', '{b}') AS b, round(corr({a}, {b}), 3) AS r FROM "
        + DERIVED,
        CORR_COLS,
    )
    + ") WHERE abs(r) > 0.8 UNION ALL "
    + union_columns(
        "SELECT 'dummies', '{c}', 'one-hot', count(DISTINCT {c})::DOUBLE FROM " + DERIVED, FE_CAT
    ),
)
def fe_plan(t):
    return profiling.fe_plan(derived(t), CORR_COLS, FE_CAT)


# --- cleaning -------------------------------------------------------------------------------

CLEAN_COLS = ["l_quantity", "l_discount"]
KEYED = [*ROW_KEY, *CLEAN_COLS]


def base(t):
    return t.gappy_lineitem.select(*KEYED)


def keyed_sql(q: str, d: str, extra: str = "") -> str:
    return f"SELECT {KEY_SQL}, {q} AS l_quantity, {d} AS l_discount FROM {GAPPY} g{extra}"


def stats_sql(expr: str) -> str:
    """Attach per-column statistics named <stat>_q and <stat>_d."""
    return ", (SELECT " + ", ".join(
        f"{expr.format(c=c)} AS s_{s}" for c, s in (("l_quantity", "q"), ("l_discount", "d"))
    ) + f" FROM {GAPPY}) st"


@query(
    "fill_mean",
    keyed_sql("coalesce(l_quantity, round(s_q, 4))", "coalesce(l_discount, round(s_d, 4))", stats_sql("avg({c})")),
)
def fill_mean(t):
    return cleaning.fill_mean(base(t), CLEAN_COLS)


@query(
    "fill_median",
    keyed_sql("coalesce(l_quantity, round(s_q, 4))", "coalesce(l_discount, round(s_d, 4))", stats_sql("median({c})")),
)
def fill_median(t):
    return cleaning.fill_median(base(t), CLEAN_COLS)


MODE = "(SELECT {c} FROM " + GAPPY + " WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 1)"


@query(
    "fill_mode",
    keyed_sql(
        "coalesce(l_quantity, " + MODE.format(c="l_quantity") + ")",
        "coalesce(l_discount, " + MODE.format(c="l_discount") + ")",
    ),
)
def fill_mode(t):
    return cleaning.fill_mode(base(t), CLEAN_COLS)


@query(
    "drop_missing",
    keyed_sql("l_quantity", "l_discount", " WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL"),
)
def drop_missing(t):
    return cleaning.drop_missing(base(t), CLEAN_COLS)


SPIKY_CLIP = (
    f"SELECT {KEY_SQL}, CASE WHEN spiky < q1 - 1.5 * (q3 - q1) THEN round(q1 - 1.5 * (q3 - q1), 4)"
    f" WHEN spiky > q3 + 1.5 * (q3 - q1) THEN round(q3 + 1.5 * (q3 - q1), 4) ELSE spiky END AS spiky"
    f" FROM {SKEWED}, (SELECT {quantile_sql('spiky', 0.25, 'floor')} AS q1,"
    f" {quantile_sql('spiky', 0.75, 'floor')} AS q3 FROM {SKEWED})"
)


@query("iqr_clip", SPIKY_CLIP)
def iqr_clip(t):
    return cleaning.iqr_clip(spiky(t).select(*ROW_KEY, "spiky"), ["spiky"])


@query(
    "zscore_filter",
    f"SELECT {KEY_SQL}, l_quantity, spiky FROM {SKEWED}, (SELECT avg(spiky) AS ms, stddev_samp(spiky)"
    f" AS ss, avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq FROM {SKEWED})"
    " WHERE coalesce(abs(spiky - ms) <= 3 * ss, true) AND coalesce(abs(l_quantity - mq) <= 3 * sq, true)",
)
def zscore_filter(t):
    return cleaning.zscore_filter(
        spiky(t).select(*ROW_KEY, "l_quantity", "spiky"), ["l_quantity", "spiky"]
    )


STANDARD_SQL = keyed_sql(
    "round((l_quantity - m_q) / d_q, 4)",
    "round((l_discount - m_d) / d_d, 4)",
    f", (SELECT avg(l_quantity) AS m_q, stddev_samp(l_quantity) AS d_q, avg(l_discount) AS m_d,"
    f" stddev_samp(l_discount) AS d_d FROM {GAPPY}) st",
)


@query("standardize", STANDARD_SQL)
def standardize(t):
    return cleaning.standardize(base(t), CLEAN_COLS)


def minmax_sql(lo: float, hi: float) -> str:
    f = "round({lo} + ({c} - a_{s}) / (z_{s} - a_{s}) * ({hi} - {lo}), 4)"
    return keyed_sql(
        f.format(c="l_quantity", s="q", lo=lo, hi=hi),
        f.format(c="l_discount", s="d", lo=lo, hi=hi),
        f", (SELECT min(l_quantity) AS a_q, max(l_quantity) AS z_q, min(l_discount) AS a_d,"
        f" max(l_discount) AS z_d FROM {GAPPY}) st",
    )


@query("minmax", minmax_sql(0.0, 1.0))
def minmax(t):
    return cleaning.minmax(base(t), CLEAN_COLS)


SIGNED = f"(SELECT {KEY_SQL}, l_quantity - 25.5 AS v FROM {GAPPY})"


def signed(t):
    return t.gappy_lineitem.select(*ROW_KEY, (F.col("l_quantity") - 25.5).alias("v"))


@query(
    "log1p",
    f"SELECT {KEY_SQL}, CASE WHEN v >= 0 THEN round(ln(1 + v), 4) ELSE v END AS v FROM {SIGNED}",
)
def log1p(t):
    return cleaning.log1p(signed(t), ["v"])


@query("abs", f"SELECT {KEY_SQL}, abs(v) AS v FROM {SIGNED}")
def absolute(t):
    return cleaning.absolute(signed(t), ["v"])


@query("round", f"SELECT {KEY_SQL}, floor(v + 0.5) AS v FROM {SIGNED}")
def round_nearest(t):
    return cleaning.round_nearest(signed(t), ["v"])


def padded_part(t):
    return t.part.select("p_partkey", F.concat(F.lit("  "), F.initcap("p_name"), F.lit(" ")).alias("p_name"))


PADDED = """(SELECT p_partkey, '  ' || list_aggregate(list_transform(string_split(p_name, ' '),
  lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') || ' ' AS p_name FROM part)"""


@query("trim", f"SELECT p_partkey, trim(p_name) AS p_name FROM {PADDED}")
def trim(t):
    return cleaning.trim(padded_part(t), ["p_name"])


@query("lowercase", f"SELECT p_partkey, lower(p_name) AS p_name FROM {PADDED}")
def lowercase(t):
    return cleaning.lowercase(padded_part(t), ["p_name"])


@query("uppercase", f"SELECT p_partkey, upper(p_name) AS p_name FROM {PADDED}")
def uppercase(t):
    return cleaning.uppercase(padded_part(t), ["p_name"])


LABEL_SQL = """SELECT o_orderkey, code AS o_orderpriority FROM orders JOIN
  (SELECT o_orderpriority, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM orders
   GROUP BY o_orderpriority) USING (o_orderpriority)"""


@query("label_encode", LABEL_SQL)
def label_encode(t):
    return encoding.label_encode(
        t.orders.select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], "o_orderkey"
    )


@query("to_numeric", f"SELECT {KEY_SQL}, TRY_CAST(q_text AS DOUBLE) AS q_text FROM {TEXTY}")
def to_numeric(t):
    return cleaning.to_numeric(t.text_lineitem.select(*ROW_KEY, "q_text"), ["q_text"])


@query(
    "to_numeric_rejects",
    f"SELECT 'q_text' AS \"column\", count(TRY_CAST(q_text AS DOUBLE)) AS parsed, count(*) FILTER"
    f" (WHERE trim(q_text) <> '' AND TRY_CAST(q_text AS DOUBLE) IS NULL) AS rejected FROM {TEXTY}",
)
def to_numeric_rejects(t):
    return cleaning.reject_counts(t.text_lineitem, ["q_text"])


@query(
    "drop_duplicates",
    """SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER
      (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""",
)
def drop_duplicates(t):
    return cleaning.drop_duplicates(
        t.events.select("event_id", "ts", "user_id", "event_type", "value"),
        ["user_id", "event_type"], ["ts", "event_id"],
    ).drop("ts")


@query(
    "clean_change_counts",
    f"""SELECT 0::BIGINT AS removed, count(*) FILTER (WHERE v IS NOT NULL AND
      floor(v + 0.5) <> v) AS modified FROM {SIGNED}""",
)
def clean_change_counts(t):
    before = signed(t).withColumn("v", F.col("v"))
    after = cleaning.round_nearest(before, ["v"])
    return cleaning.change_counts(before, after, ROW_KEY, ["v"])
