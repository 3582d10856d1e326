"""Descriptive statistics, chart aggregates, associations and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.operators import association, charts, concordance, hypothesis, mic, relational
from workload.base import (
    GAPPY, KEY_SQL, ROW_KEY, TEXTY, chi2_upper_sql, f_upper_sql, quantile_sql, query, t_two_sided_sql,
)
from workload.preparation import (
    CORR_COLS, DERIVED, SKEWED, corr_pairs_sql, derived, rounded, spiky, union_columns,
)

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def q(c: str, p: float, rule: str) -> str:
    return quantile_sql(c, p, rule)


SAMPLE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query(
    "descriptive",
    union_columns(
        "SELECT '{c}' AS \"column\", round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS sd, round(stddev_samp({c}), 4) AS sd_sample,"
        " min({c}) AS min, max({c}) AS max, round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS missing_rate,"
        " round(" + q("{c}", 0.25, "midpoint") + ", 4) AS q1, round(median({c}), 4) AS median, round("
        + q("{c}", 0.75, "midpoint") + ", 4) AS q3 FROM " + GAPPY,
        NUM,
    ),
)
def descriptive(t):
    return rounded(charts.descriptive(t.gappy_lineitem, NUM), 4, "mean", "sd", "sd_sample", "q1", "median", "q3").withColumn(
        "missing_rate", F.round("missing_rate", 6)
    )


@query(
    "skew_kurt",
    union_columns(
        "SELECT '{c}' AS \"column\", count({c}) AS n, round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis FROM " + SKEWED,
        ["l_quantity", "spiky"],
    ),
)
def skew_kurt(t):
    return rounded(charts.skew_kurt(spiky(t), ["l_quantity", "spiky"]), 4, "skewness", "kurtosis")


BOX = (
    "SELECT *, (SELECT count(*) FROM " + SKEWED + " WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers FROM "
    "(SELECT '{c}' AS \"column\", count({c}) AS n, min({c}) AS min, " + q("{c}", 0.25, "midpoint") + " AS q1, median({c}) AS median, "
    + q("{c}", 0.75, "midpoint") + " AS q3, max({c}) AS max FROM " + SKEWED + ")"
)


@query("boxplot", union_columns(BOX, ["l_quantity", "spiky"]))
def boxplot(t):
    return charts.boxplot(spiky(t), ["l_quantity", "spiky"])


@query(
    "frequency",
    f"SELECT coalesce(nullif(trim(f_text), ''), 'missing') AS level, count(*) AS n FROM {TEXTY} GROUP BY 1",
)
def frequency(t):
    return charts.frequency(t.text_lineitem, "f_text")


@query(
    "histogram",
    f"""WITH lim AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 20 AS w FROM lineitem)
      SELECT CAST(i AS INTEGER) AS bin, round(lo + (i + 0.5) * w, 4) AS mid, count(l_extendedprice) AS n FROM lim, range(0, 20) r(i)
      LEFT JOIN lineitem ON greatest(0, least(floor((l_extendedprice - (SELECT lo FROM lim)) / (SELECT w FROM lim)), 19)) = i GROUP BY i, lo, w""",
)
def histogram(t):
    return rounded(charts.histogram(t.lineitem, "l_extendedprice", 20), 4, "mid")


@query(
    "group_mean_topn",
    "SELECT p_brand AS category, round(avg(p_retailprice), 4) AS mean, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 12",
)
def group_mean_topn(t):
    return rounded(charts.group_mean_topn(t.part, "p_brand", "p_retailprice"), 4, "mean")


@query(
    "crosstab_topn",
    """SELECT p_brand AS row_level, p_name AS column_level, count(*) AS n FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand
      ORDER BY count(*) DESC, p_brand LIMIT 8) AND p_name IN (SELECT p_name FROM part GROUP BY p_name ORDER BY count(*) DESC, p_name LIMIT 6) GROUP BY ALL""",
)
def crosstab_topn(t):
    return charts.crosstab_topn(t.part, "p_brand", "p_name")


@query(
    "chart_agg",
    f"""SELECT coalesce(nullif(trim(f_text), ''), '(empty)') AS f_text, count(TRY_CAST(q_text AS DOUBLE)) AS q_text, count(l_tax) AS l_tax,
      count(*) AS row_count FROM {TEXTY} GROUP BY 1""",
)
def chart_agg(t):
    return charts.chart_agg(t.text_lineitem, "f_text", ["q_text", "l_tax"])


@query(
    "chart_agg_sum",
    f"""SELECT coalesce(nullif(trim(f_text), ''), '(empty)') AS f_text, sum(TRY_CAST(q_text AS DOUBLE)) AS q_text, count(*) AS row_count FROM {TEXTY} GROUP BY 1""",
)
def chart_agg_sum(t):
    return charts.chart_agg(t.text_lineitem, "f_text", ["q_text"], "sum")


@query("chart_sort", "SELECT o_orderpriority, count(o_totalprice) AS o_totalprice, count(*) AS row_count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1")
def chart_sort(t):
    c = charts.chart_agg(t.orders, "o_orderpriority", ["o_totalprice"])
    return charts.chart_sort(c, "o_totalprice", False, ["o_orderpriority"])


CHART_BOX = (
    "SELECT '{c}' AS \"column\", l_returnflag, count({c}) AS n, min({c}) AS min, " + q("{c}", 0.25, "floor") + " AS q1, "
    + q("{c}", 0.5, "floor") + " AS median, " + q("{c}", 0.75, "floor") + " AS q3, max({c}) AS max FROM " + GAPPY + " GROUP BY l_returnflag"
)


@query("chart_boxplot", union_columns(CHART_BOX, ["l_quantity", "l_extendedprice"]))
def chart_boxplot(t):
    return charts.five_numbers(t.gappy_lineitem, ["l_quantity", "l_extendedprice"], ["l_returnflag"])


@query(
    "chart_radar_max",
    union_columns("SELECT '{c}' AS \"column\", max(coalesce({c}, 0)) * 1.2 AS axis_max FROM " + GAPPY, NUM),
)
def chart_radar_max(t):
    return charts.radar_max(t.gappy_lineitem, NUM)


@query("chart_heatmap_range", "SELECT 0.0::DOUBLE AS low, coalesce(nullif(max(coalesce(value, 0)), 0), 100) AS high FROM events")
def chart_heatmap_range(t):
    return charts.heatmap_range(t.events, "value")


@query("scatter_sample", f"""SELECT {', '.join(SAMPLE_KEY)}, l_quantity FROM lineitem
  ORDER BY md5(concat_ws('|', {', '.join(SAMPLE_KEY)}, 42)), {', '.join(SAMPLE_KEY)} LIMIT 500""")
def scatter_sample(t):
    return charts.scatter_sample(t.lineitem, SAMPLE_KEY, ["l_quantity"], 500)


@query(
    "trend_line",
    f"""SELECT round(regr_slope(y, l_quantity), 6) AS slope, round(regr_intercept(y, l_quantity), 6) AS intercept, min(l_quantity) AS min_x, max(l_quantity) AS max_x
      FROM {DERIVED} WHERE y IS NOT NULL AND l_quantity IS NOT NULL""",
)
def trend_line(t):
    return rounded(charts.trend_line(derived(t), "l_quantity", "y"), 6, "slope", "intercept")


def runs(t):
    """Learning runs derived from events: the course is the user, the outcome depends on the row."""
    e = t.events
    return e.select(
        F.col("user_id").alias("course"), "ts", "event_id", F.col("event_type").alias("step"),
        ((F.col("event_type") == "purchase") | ((F.col("user_id") % 3 == 0) & (F.col("value") > 20))).alias("passed"),
        (F.col("event_id") % 5 == 0).alias("final"),
    ).where(F.col("course") % 7 != 0)


RUNS = """(SELECT user_id AS course, ts, event_id, event_type AS step, (event_type = 'purchase' OR (user_id % 3 = 0 AND value > 20)) AS passed,
  event_id % 5 = 0 AS final FROM events WHERE user_id % 7 <> 0)"""


@query(
    "status_rollup",
    f"""SELECT c.course, CASE WHEN g.f THEN 'passed' WHEN g.runs IS NULL THEN 'pending' WHEN g.a THEN 'partial' ELSE 'failed' END AS status,
      coalesce(g.runs, 0) AS runs, g.latest::DOUBLE AS latest FROM (SELECT DISTINCT user_id AS course FROM events) c LEFT JOIN (SELECT course, count(*) AS runs,
      bool_or(final AND passed) AS f, bool_or(passed) AS a, max_by(event_id, ts) AS latest FROM {RUNS} GROUP BY course) g ON c.course = g.course""",
)
def status_rollup(t):
    courses = t.events.select(F.col("user_id").alias("course"))
    out = charts.status_rollup(courses, runs(t), "course", "ts", "event_id", "passed", "final")
    return out.withColumn("latest", F.col("latest").cast("double"))


@query(
    "leaderboard_topk",
    """SELECT event_type, event_id, value, place FROM (SELECT event_type, event_id, value, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INTEGER) AS place
      FROM events) WHERE place <= 10""",
)
def leaderboard_topk(t):
    return charts.leaderboard_topk(t.events.select("event_type", "event_id", "value"), "event_type", "value", "event_id")


@query(
    "kpi_rates",
    f"""WITH item AS (SELECT course, step, bool_or(passed) AS done, min_by(passed, ts) AS first, count(*) AS n, count(*) FILTER (WHERE passed) AS ok FROM {RUNS} GROUP BY course, step),
      d AS (SELECT DISTINCT course, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS d FROM {RUNS}),
      s AS (SELECT course, max(len) AS streak_days FROM (SELECT course, g, count(*) AS len FROM (SELECT course, d - row_number() OVER (PARTITION BY course ORDER BY d) AS g FROM d) GROUP BY course, g) GROUP BY course)
      SELECT course, round(avg(done::INT), 6) AS completion_rate, round(avg(first::INT), 6) AS first_pass_rate,
      round(sum(ok - first::INT)::DOUBLE / nullif(sum(n - 1), 0), 6) AS retry_rate, any_value(streak_days) AS streak_days FROM item JOIN s USING (course) GROUP BY course""",
)
def kpi_rates(t):
    k = charts.kpi_rates(runs(t), "course", "step", "ts", "event_id", "passed")
    return rounded(k, 6, "completion_rate", "first_pass_rate", "retry_rate")


@query(
    "recent_topn",
    "SELECT o_orderkey, o_custkey, o_orderdate, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 50",
)
def recent_topn(t):
    return charts.recent_topn(
        t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), t.customer, "o_custkey", "c_custkey", "c_name",
        "o_orderdate", "o_orderkey", 50,
    )


# --- associations ---------------------------------------------------------------------------


def pearson_sql(source: str, pairs: list[tuple[str, str]], digits: int = 6) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, r, n, r * sqrt((n - 2) / greatest(1e-12, 1 - r * r)) AS t FROM"
        f" (SELECT corr({a}, {b}) AS r, CAST(regr_count({b}, {a}) AS BIGINT) AS n FROM {source})"
        for a, b in pairs
    )


RANGED = "(SELECT *, l_extendedprice + 900 * l_quantity AS spend FROM lineitem WHERE l_quantity >= 5 AND l_quantity <= 45 AND l_returnflag IN ('A', 'R'))"
FOCUS = [("l_extendedprice", c) for c in ("l_quantity", "l_discount", "spend")]


@query(
    "corr_pearson",
    f"SELECT a, b, round(r, 6) AS r, n, round(t, 4) AS t, round({t_two_sided_sql('t', 'n - 2')}, 6) AS p FROM ({pearson_sql(RANGED, FOCUS)})",
)
def corr_pearson(t):
    kept = relational.filter_range(t.lineitem, {"l_quantity": {"min": 5, "max": 45}}).where(F.col("l_returnflag").isin("A", "R"))
    kept = kept.withColumn("spend", F.col("l_extendedprice") + 900 * F.col("l_quantity"))
    out = association.corr_pearson(kept, ["l_extendedprice", "l_quantity", "l_discount", "spend"], "l_extendedprice")
    return out.withColumns({"r": F.round("r", 6), "t": F.round("t", 4), "p": F.round("p", 6)})


SPEARMAN_PAIR = "(SELECT l_quantity AS x, y FROM " + DERIVED + " WHERE l_quantity IS NOT NULL AND y IS NOT NULL)"


def avg_rank_sql(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


@query(
    "corr_spearman",
    f"SELECT 'l_quantity' AS a, 'y' AS b, round(corr(rx, ry), 6) AS r, count(*) AS n FROM (SELECT {avg_rank_sql('x')} AS rx, {avg_rank_sql('y')} AS ry FROM {SPEARMAN_PAIR})",
)
def corr_spearman(t):
    return rounded(association.corr_spearman(derived(t), "l_quantity", "y"), 6, "r")


TIED = "(SELECT l_quantity AS x, l_quantity * 2 + 3 * l_linenumber AS y FROM " + GAPPY + " WHERE l_quantity IS NOT NULL)"


def tied(t):
    return t.gappy_lineitem.select("l_quantity", (F.col("l_quantity") * 2 + 3 * F.col("l_linenumber")).alias("y"))


def kendall_sql(points: str, a: str, b: str) -> str:
    return f"""WITH p AS (SELECT x, y, count(*)::DOUBLE AS w FROM {points} GROUP BY x, y),
      s AS (SELECT sum(CASE WHEN (i.x - j.x) * (i.y - j.y) > 0 THEN i.w * j.w ELSE 0 END) / 2 AS c,
        sum(CASE WHEN (i.x - j.x) * (i.y - j.y) < 0 THEN i.w * j.w ELSE 0 END) / 2 AS d FROM p i, p j),
      n AS (SELECT sum(w) AS n FROM p), tx AS (SELECT sum(k * (k - 1) / 2) AS tx FROM (SELECT sum(w) AS k FROM p GROUP BY x)),
      ty AS (SELECT sum(k * (k - 1) / 2) AS ty FROM (SELECT sum(w) AS k FROM p GROUP BY y))
      SELECT '{a}' AS a, '{b}' AS b, CAST(n AS BIGINT) AS n, c AS concordant, d AS discordant,
      round((c - d) / (sqrt(n * (n - 1) / 2 - tx) * sqrt(n * (n - 1) / 2 - ty)), 6) AS tau_b, round((c - d) / (c + d), 6) AS gamma FROM s, n, tx, ty"""


@query("corr_kendall", kendall_sql(TIED, "l_quantity", "y"))
def corr_kendall(t):
    return rounded(concordance.corr_kendall(tied(t), "l_quantity", "y"), 6, "tau_b", "gamma")


BALANCE = "(SELECT c_acctbal AS x, c_acctbal * (1 + c_nationkey % 3) + c_custkey AS y FROM customer)"


def balance(t):
    return t.customer.select(
        "c_acctbal", (F.col("c_acctbal") * (1 + F.col("c_nationkey") % 3) + F.col("c_custkey")).alias("y")
    )


@query("corr_kendall_continuous", kendall_sql(BALANCE, "c_acctbal", "y"))
def corr_kendall_continuous(t):
    return rounded(concordance.corr_kendall(balance(t), "c_acctbal", "y"), 6, "tau_b", "gamma")


BICOR = ["l_quantity", "spiky", "l_extendedprice"]


def bicor_sql() -> str:
    full = f"(SELECT {', '.join(BICOR)} FROM {SKEWED} WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in BICOR) + ")"
    med = ", ".join(f"median({c}) AS m{i}" for i, c in enumerate(BICOR))
    mad = ", ".join(f"median(abs({c} - m{i})) AS d{i}" for i, c in enumerate(BICOR))
    w = ", ".join(
        f"CASE WHEN abs(({c} - m{i}) / (9 * d{i})) < 1 THEN ({c} - m{i}) * pow(1 - pow(({c} - m{i}) / (9 * d{i}), 2), 2) ELSE 0 END AS w{i}"
        for i, c in enumerate(BICOR)
    )
    pairs = " UNION ALL ".join(
        f"SELECT '{BICOR[i]}' AS a, '{BICOR[j]}' AS b, round(corr(w{i}, w{j}), 6) AS r, count(*) AS n FROM w"
        for i in range(3) for j in range(i + 1, 3)
    )
    return f"""WITH f AS {full}, m AS (SELECT {med} FROM f), d AS (SELECT {mad} FROM f, m), w AS (SELECT {w} FROM f, m, d) {pairs}"""


@query("corr_bicor", bicor_sql())
def corr_bicor(t):
    return rounded(association.corr_bicor(spiky(t), BICOR), 6, "r")


def winsor_sql() -> str:
    full = f"(SELECT {', '.join(BICOR)} FROM {SKEWED} WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in BICOR) + ")"
    lim = ", ".join(f"{q(c, 0.05, 'low')} AS l{i}, {q(c, 0.95, 'high')} AS h{i}" for i, c in enumerate(BICOR))
    w = ", ".join(f"greatest(l{i}, least(h{i}, {c})) AS w{i}" for i, c in enumerate(BICOR))
    pairs = " UNION ALL ".join(
        f"SELECT '{BICOR[i]}' AS a, '{BICOR[j]}' AS b, round(corr(w{i}, w{j}), 6) AS r, count(*) AS n FROM w"
        for i in range(3) for j in range(i + 1, 3)
    )
    return f"WITH f AS {full}, l AS (SELECT {lim} FROM f), w AS (SELECT {w} FROM f, l) {pairs}"


@query("corr_winsor", winsor_sql())
def corr_winsor(t):
    return rounded(association.corr_winsor(spiky(t), BICOR), 6, "r")


def distance_sql(points: str, a: str, b: str) -> str:
    return f"""WITH p AS (SELECT x, y, count(*)::DOUBLE AS w FROM {points} GROUP BY x, y),
      r AS (SELECT i.x, i.y, any_value(i.w) AS w, sum(j.w * abs(i.x - j.x)) AS ax, sum(j.w * abs(i.y - j.y)) AS ay,
        sum(j.w * abs(i.x - j.x) * abs(i.y - j.y)) AS xy, sum(j.w * abs(i.x - j.x) * abs(i.x - j.x)) AS xx,
        sum(j.w * abs(i.y - j.y) * abs(i.y - j.y)) AS yy FROM p i, p j GROUP BY i.x, i.y),
      s AS (SELECT sum(w) AS n, sum(w * xy) AS xy, sum(w * xx) AS xx, sum(w * yy) AS yy, sum(w * ax) AS tx, sum(w * ay) AS ty,
        sum(w * ax * ay) AS qxy, sum(w * ax * ax) AS qx, sum(w * ay * ay) AS qy FROM r),
      v AS (SELECT n, xy / (n * n) - 2 * qxy / pow(n, 3) + tx * ty / pow(n, 4) AS c, xx / (n * n) - 2 * qx / pow(n, 3) + tx * tx / pow(n, 4) AS vx,
        yy / (n * n) - 2 * qy / pow(n, 3) + ty * ty / pow(n, 4) AS vy FROM s)
      SELECT '{a}' AS a, '{b}' AS b, CAST(n AS BIGINT) AS n, round(sqrt(greatest(c / sqrt(vx * vy), 0)), 6) AS dcor, round(greatest(c / sqrt(vx * vy), 0), 6) AS dcor_squared FROM v"""


@query("corr_distance", distance_sql(TIED, "l_quantity", "y"))
def corr_distance(t):
    return rounded(concordance.corr_distance(tied(t), "l_quantity", "y"), 6, "dcor", "dcor_squared")


@query("corr_distance_continuous", distance_sql(BALANCE, "c_acctbal", "y"))
def corr_distance_continuous(t):
    return rounded(concordance.corr_distance(balance(t), "c_acctbal", "y"), 6, "dcor", "dcor_squared")


LINKED = """(SELECT *, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderpriority END AS cls,
  CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE o_orderstatus END AS st FROM orders)"""


def linked(t):
    return t.orders.withColumns(
        {
            "cls": F.when(F.col("o_totalprice") > 300000, "big").when(F.col("o_orderstatus") == "F", "done").otherwise(F.col("o_orderpriority")),
            "st": F.when(F.col("o_custkey") % 9 != 0, F.col("o_orderstatus")),
        }
    )


CHI = f"""(SELECT greatest(tot * (sum(n * n / (rn * cn)) - 1), 0) AS chi2, (count(DISTINCT cls) - 1) * (count(DISTINCT st) - 1) AS df, tot AS n,
  least(count(DISTINCT cls), count(DISTINCT st)) AS k FROM (SELECT cls, st, n::DOUBLE AS n, sum(n) OVER (PARTITION BY cls)::DOUBLE AS rn, sum(n) OVER (PARTITION BY st)::DOUBLE AS cn,
  CAST(sum(n) OVER () AS BIGINT) AS tot FROM (SELECT cls, st, count(*) AS n FROM {LINKED} WHERE st IS NOT NULL GROUP BY cls, st)) GROUP BY tot)"""


@query("cramers_v", f"SELECT 'cls' AS a, 'st' AS b, round(sqrt(chi2 / (n * (k - 1))), 6) AS v, n FROM {CHI}")
def cramers_v(t):
    return rounded(association.cramers_v(linked(t), "cls", "st"), 6, "v")


ETA = f"""(SELECT sqrt(sum(c * (m - g) * (m - g)) / (sum(c * (m - g) * (m - g)) + sum(c * v))) AS eta, CAST(sum(c) AS BIGINT) AS n FROM
  (SELECT *, sum(c * m) OVER () / sum(c) OVER () AS g FROM (SELECT cls, count(*) AS c, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM {LINKED} GROUP BY cls)))"""


@query("corr_ratio", f"SELECT 'cls' AS a, 'o_totalprice' AS b, round(eta, 6) AS eta, n FROM {ETA}")
def corr_ratio(t):
    return rounded(association.corr_ratio(linked(t), "cls", "o_totalprice"), 6, "eta")


STRENGTH = "CASE WHEN abs(value) < 0.1 THEN 'very weak' WHEN abs(value) < 0.3 THEN 'weak' WHEN abs(value) < 0.5 THEN 'moderate' WHEN abs(value) < 0.7 THEN 'strong' ELSE 'very strong' END"


@query(
    "mixed_assoc",
    f"""SELECT a, b, measure, round(value, 6) AS value, n, {STRENGTH} AS strength, CASE WHEN measure <> 'pearson' THEN 'none' WHEN value > 0 THEN 'positive'
      WHEN value < 0 THEN 'negative' ELSE 'none' END AS direction FROM (SELECT 'o_totalprice' AS a, 'o_custkey' AS b, 'pearson' AS measure, corr(o_totalprice, o_custkey) AS value, count(*) AS n FROM orders
      UNION ALL SELECT 'o_totalprice', 'cls', 'eta', eta, n FROM {ETA}
      UNION ALL SELECT 'o_totalprice', 'st', 'eta', eta, n FROM {ETA.replace('GROUP BY cls', 'WHERE st IS NOT NULL GROUP BY st').replace('SELECT cls,', 'SELECT st,')}
      UNION ALL SELECT 'o_custkey', 'cls', 'eta', eta, n FROM {ETA.replace('o_totalprice) AS m', 'o_custkey) AS m').replace('var_pop(o_totalprice)', 'var_pop(o_custkey)')}
      UNION ALL SELECT 'o_custkey', 'st', 'eta', eta, n FROM {ETA.replace('GROUP BY cls', 'WHERE st IS NOT NULL GROUP BY st').replace('SELECT cls,', 'SELECT st,').replace('o_totalprice) AS m', 'o_custkey) AS m').replace('var_pop(o_totalprice)', 'var_pop(o_custkey)')}
      UNION ALL SELECT 'cls', 'st', 'cramers_v', sqrt(chi2 / (n * (k - 1))), n FROM {CHI})""",
)
def mixed_assoc(t):
    return rounded(association.mixed_assoc(linked(t), ["o_totalprice", "o_custkey", "cls", "st"]), 6, "value")


SYM = corr_pairs_sql("SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, CAST(regr_count({b}, {a}) AS BIGINT) AS n FROM " + DERIVED, CORR_COLS)
CELL = (
    "printf('%.3f', r) || CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END"
)


@query(
    "corr_sym_table",
    f"""WITH c AS (SELECT a, b, {CELL} AS cell FROM (SELECT a, b, r, {t_two_sided_sql('t', 'n - 2')} AS p FROM
      (SELECT *, r * sqrt((n - 2) / greatest(1e-12, 1 - r * r)) AS t FROM ({SYM})))), l AS (SELECT a, b, cell FROM c UNION ALL SELECT b, a, cell FROM c
      UNION ALL SELECT v, v, '1.000' FROM (SELECT unnest({CORR_COLS}) AS v))
      SELECT a AS variable, {', '.join(f"max(cell) FILTER (WHERE b = '{c}') AS {c}" for c in CORR_COLS)} FROM l GROUP BY a""",
)
def corr_sym_table(t):
    return association.corr_sym_table(derived(t), CORR_COLS)


@query("corr_threshold", f"SELECT a, b, round(r, 6) AS r FROM ({SYM}) WHERE abs(r) > 0.8")
def corr_threshold(t):
    return rounded(association.corr_threshold(derived(t), CORR_COLS, 0.8), 6, "r")


P3 = ["l_quantity", "y", "z"]


@query(
    "partial_corr",
    f"""WITH r AS (SELECT corr(l_quantity, y) AS xy, corr(l_quantity, z) AS xz, corr(y, z) AS yz FROM {DERIVED} WHERE l_quantity IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL),
      e AS (SELECT 'l_quantity' AS a, 'y' AS b, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS rho FROM r
      UNION ALL SELECT 'l_quantity', 'z', (xz - xy * yz) / sqrt((1 - xy * xy) * (1 - yz * yz)) FROM r
      UNION ALL SELECT 'y', 'z', (yz - xy * xz) / sqrt((1 - xy * xy) * (1 - xz * xz)) FROM r)
      SELECT a, b, round(rho, 5) AS rho, CASE WHEN rho >= 0 THEN '+' ELSE '-' END AS sign, 2::INTEGER AS degree_a, 2::INTEGER AS degree_b FROM e""",
)
def partial_corr(t):
    return rounded(association.partial_corr(derived(t), P3), 5, "rho")


MIC_COLS = ["l_quantity", "l_extendedprice", "bend", "z"]
MIC_ROWS = f"(SELECT {KEY_SQL}, l_quantity, l_extendedprice, (l_quantity - 25) * (l_quantity - 25) + l_partkey % 40 AS bend, l_quantity + l_suppkey % 5 AS z FROM {GAPPY} WHERE l_quantity IS NOT NULL)"


def mic_rows(t):
    g = t.gappy_lineitem
    d = F.col("l_quantity") - 25
    return g.select(
        *ROW_KEY, "l_quantity", (d * d + F.col("l_partkey") % 40).alias("bend"), (F.col("l_quantity") + F.col("l_suppkey") % 5).alias("z")
    )


def mic_sql() -> str:
    pos = ", ".join(
        f"row_number() OVER (ORDER BY {c}, {KEY_SQL}) - 1 AS i{k}" for k, c in enumerate(MIC_COLS)
    )
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    parts = " UNION ALL ".join(
        f"SELECT '{MIC_COLS[i]}' AS a, '{MIC_COLS[j]}' AS b, ga, gb, (i{i} * ga) // n AS ba, (i{j} * gb) // n AS bb, any_value(n) AS n, count(*) AS c FROM pos, tot, shape GROUP BY ga, gb, 5, 6"
        for i, j in pairs
    )
    rs = " UNION ALL ".join(
        f"SELECT '{MIC_COLS[i]}' AS a, '{MIC_COLS[j]}' AS b, corr({MIC_COLS[i]}, {MIC_COLS[j]}) AS pearson FROM {MIC_ROWS}"
        for i, j in pairs
    )
    return f"""WITH pos AS (SELECT {pos} FROM {MIC_ROWS}), tot AS (SELECT count(*) AS n FROM pos),
      shape AS (SELECT x.g AS ga, y.g AS gb FROM range(2, 16) x(g), range(2, 16) y(g), tot WHERE x.g * y.g <= least(pow(n, 0.6), 225)),
      j AS ({parts}), m AS (SELECT *, sum(c) OVER (PARTITION BY a, b, ga, gb, ba) AS ra, sum(c) OVER (PARTITION BY a, b, ga, gb, bb) AS rb FROM j),
      g AS (SELECT a, b, ga, gb, sum(c / n::DOUBLE * ln(c * n::DOUBLE / (ra * rb))) / ln(least(ga, gb)) AS v FROM m GROUP BY a, b, ga, gb),
      r AS ({rs})
      SELECT a, b, least(1, max(v)) AS mic, any_value(pearson) AS pearson, greatest(0, least(1, max(v)) - any_value(pearson) * any_value(pearson)) AS nonlinearity
      FROM g JOIN r USING (a, b) GROUP BY a, b"""


def mic_result(t):
    return mic.mic_pairs(mic_rows(t), MIC_COLS, ROW_KEY)


@query("mic", f"SELECT a, b, round(mic, 5) AS mic, round(pearson, 5) AS pearson, round(nonlinearity, 5) AS nonlinearity FROM ({mic_sql()})")
def mic_all(t):
    return rounded(mic_result(t), 5, "mic", "pearson", "nonlinearity")


@query(
    "mic_relation_type",
    f"""SELECT a, b, round(mic, 5) AS mic, round(pearson, 5) AS pearson, round(nonlinearity, 5) AS nonlinearity, CASE WHEN mic < 0.1 THEN 'none' WHEN nonlinearity > 0.15 THEN 'nonlinear'
      WHEN nonlinearity > 0.05 THEN 'mixed' WHEN mic > 0.3 THEN 'linear' ELSE 'weak' END AS relation FROM ({mic_sql()}) WHERE nonlinearity > 0.05 ORDER BY nonlinearity DESC LIMIT 15""",
)
def mic_relation_type(t):
    return rounded(mic.mic_relation_type(mic_result(t)), 5, "mic", "pearson", "nonlinearity")


@query("covariance", corr_pairs_sql("SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 4) AS cov FROM " + DERIVED, CORR_COLS))
def covariance(t):
    return rounded(association.covariance(derived(t), CORR_COLS), 4, "cov")


# --- tests ----------------------------------------------------------------------------------


def one_sample_sql(values: str, mu: float) -> str:
    return f"""SELECT n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(t, 4) AS t, n - 1 AS df, round({t_two_sided_sql('t', 'n - 1')}, 6) AS p
      FROM (SELECT *, (mean - {mu}) / (sd / sqrt(n)) AS t FROM (SELECT count(v)::DOUBLE AS n, avg(v) AS mean, stddev_samp(v) AS sd FROM {values}))"""


def test_rounded(df):
    digits = {"mean": 6, "sd": 6, "mean_difference": 6, "t": 4, "p": 6, "ss": 3, "ms": 4, "f": 5, "chi2": 5}
    df = df.withColumns({c: F.round(c, d) for c, d in digits.items() if c in df.columns})
    return df.withColumn("df", F.round(F.col("df").cast("double"), 4)) if "df" in df.columns else df


@query("ttest_one", one_sample_sql(f"(SELECT l_quantity AS v FROM {GAPPY})", 25.4))
def ttest_one(t):
    return test_rounded(hypothesis.ttest_one(t.gappy_lineitem, "l_quantity", 25.4))


@query("ttest_paired", one_sample_sql(f"(SELECT l_discount * 0.8 - l_tax AS v FROM {GAPPY})", 0.0))
def ttest_paired(t):
    g = t.gappy_lineitem.withColumn("d", F.col("l_discount") * 0.8)
    return test_rounded(hypothesis.ttest_paired(g, "d", "l_tax"))


@query(
    "ttest_two",
    f"""WITH g AS (SELECT c_mktsegment IN ('BUILDING', 'MACHINERY') AS k, count(c_acctbal)::DOUBLE AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1),
      w AS (SELECT max(m) FILTER (NOT k) AS m1, max(m) FILTER (k) AS m2, max(n) FILTER (NOT k) AS n1, max(n) FILTER (k) AS n2, max(v) FILTER (NOT k) AS v1, max(v) FILTER (k) AS v2 FROM g),
      r AS (SELECT 'pooled' AS method, m1 - m2 AS d, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) AS t, n1 + n2 - 2 AS df FROM w
      UNION ALL SELECT 'welch', m1 - m2, (m1 - m2) / sqrt(v1 / n1 + v2 / n2), pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) FROM w)
      SELECT method, round(d, 6) AS mean_difference, round(t, 4) AS t, round(df, 4) AS df, round({t_two_sided_sql('t', 'df')}, 6) AS p FROM r""",
)
def ttest_two(t):
    c = t.customer.withColumn("k", F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "b").otherwise("a"))
    return test_rounded(hypothesis.ttest_two(c, "k", "c_acctbal", ("a", "b")))


GROUPS = """(SELECT *, sum(n * m) OVER () / sum(n) OVER () AS g FROM (SELECT c_mktsegment AS l, count(*)::DOUBLE AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) AS v FROM customer GROUP BY 1))"""


@query(
    "anova_oneway",
    f"""WITH s AS (SELECT sum(n * (m - g) * (m - g)) AS b, sum(n * v) AS w, count(*)::DOUBLE - 1 AS db, sum(n) - count(*) AS dw FROM {GROUPS}),
      f AS (SELECT *, (b / db) / (w / dw) AS f FROM s)
      SELECT 'between' AS source, round(b, 3) AS ss, db AS df, round(b / db, 4) AS ms, round(f, 5) AS f, round({f_upper_sql('f', 'db', 'dw')}, 6) AS p FROM f
      UNION ALL SELECT 'within', round(w, 3), dw, round(w / dw, 4), NULL, NULL FROM f UNION ALL SELECT 'total', round(b + w, 3), db + dw, NULL, NULL, NULL FROM f""",
)
def anova_oneway(t):
    return test_rounded(hypothesis.anova_oneway(t.customer, "c_mktsegment", "c_acctbal"))


@query(
    "anova_posthoc",
    f"""WITH g AS {GROUPS}, w AS (SELECT sum(n * v) / (sum(n) - count(*)) AS ms FROM g)
      SELECT x.l AS a, y.l AS b, round(x.m - y.m, 6) AS mean_difference, round((x.m - y.m) / sqrt(ms / x.n + ms / y.n), 4) AS t FROM g x, g y, w WHERE x.l < y.l""",
)
def anova_posthoc(t):
    return test_rounded(hypothesis.anova_posthoc(t.customer, "c_mktsegment", "c_acctbal"))


WEAK = CHI.replace("cls", "o_orderpriority")


@query("chi_square", f"SELECT round(chi2, 5) AS chi2, df::DOUBLE AS df, n, round({chi2_upper_sql('chi2', 'df')}, 6) AS p FROM {WEAK}")
def chi_square(t):
    return test_rounded(hypothesis.chi_square(linked(t), "o_orderpriority", "st"))


def coarse_cdf_sql(z: str) -> str:
    tt = f"(1 / (1 + 0.2316419 * abs({z})))"
    tail = (
        f"(0.3989423 * exp(-({z}) * ({z}) / 2) * {tt} * (0.3193815 + {tt} * (-0.3565638 + {tt} * (1.781478 + {tt} * (-1.821256 + {tt} * 1.330274)))))"
    )
    return f"CASE WHEN ({z}) > 0 THEN 1 - {tail} ELSE {tail} END"


def coarse_quantile_sql(p: str) -> str:
    tt = f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    z = f"({tt} - (2.515517 + {tt} * (0.802853 + {tt} * 0.010328)) / (1 + {tt} * (1.432788 + {tt} * (0.189269 + {tt} * 0.001308))))"
    return f"CASE WHEN {p} < 0.5 THEN -{z} ELSE {z} END"


def shapiro_sql(key: str = "") -> str:
    """W' and p over all events, or for each value of `key`."""
    by, of, lead = (f"PARTITION BY {key} ", f" GROUP BY {key}", f"{key}, ") if key else ("", "", "")
    return f"""WITH r AS (SELECT {lead}value AS v, row_number() OVER ({by}ORDER BY value) AS i, count(*) OVER ({by.strip()}) AS n FROM events),
      m AS (SELECT {lead}v, n, {coarse_quantile_sql('((i - 0.375) / (n + 0.25))')} AS m FROM r),
      s AS (SELECT {lead}any_value(n) AS n, least(1, pow(sum(m * v), 2) / sum(m * m) / (var_pop(v) * count(*))) AS w FROM m{of}),
      z AS (SELECT *, (ln(1 - w) - (-1.2725 + 1.0521 * (ln(ln(n)) - ln(n)))) / (1.0308 - 0.26758 * (ln(ln(n)) + 2 / ln(n))) AS z FROM s)
      SELECT {lead}n, round(w, 5) AS w, CASE WHEN n BETWEEN 5 AND 5000 THEN round({coarse_cdf_sql('-z')}, 5) END AS p FROM z"""


SHAPIRO_SQL = shapiro_sql()


@query("shapiro_francia", SHAPIRO_SQL)
def shapiro_francia(t):
    return rounded(hypothesis.shapiro_francia(t.events, "value"), 5, "w", "p")


@query(
    "ks_normal",
    f"""WITH f AS (SELECT avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM events),
      r AS (SELECT (v - m) / s AS z, (sum(c) OVER (ORDER BY v) - c) / n AS lo, sum(c) OVER (ORDER BY v) / n AS hi, n FROM (SELECT value AS v, count(*) AS c FROM events GROUP BY 1), f),
      d AS (SELECT max(greatest(abs({coarse_cdf_sql('z')} - lo), abs({coarse_cdf_sql('z')} - hi))) AS d, any_value(n) AS n FROM r)
      SELECT round(d, 6) AS d, n, round(greatest(0, least(1, (SELECT 2 * sum(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * k * k * pow((sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d, 2))) FROM range(1, 101) t(k)))), 6) AS p FROM d""",
)
def ks_normal(t):
    return rounded(hypothesis.ks_normal(t.events, "value"), 6, "d", "p")


@query("qq_points")
def qq_points(t):
    return hypothesis.qq_points(t.lineitem, "l_extendedprice", 100)


@query(
    "tail_bands",
    f"""SELECT CAST(band AS INTEGER) AS band, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM
      (SELECT len(list_filter([0.001, 0.01, 0.05, 0.25, 0.75, 0.95, 0.99, 0.999], lambda c: p >= c)) AS band FROM
      (SELECT {coarse_cdf_sql('((value - m) / s)')} AS p FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events))) GROUP BY band""",
)
def tail_bands(t):
    return rounded(hypothesis.tail_bands(t.events, "value"), 6, "share")


ITEMS = ["i1", "i2", "i3", "i4"]
ITEM_ROWS = f"(SELECT l_quantity AS i1, l_quantity + l_partkey % 19 AS i2, l_quantity * 0.5 + l_suppkey % 13 AS i3, l_discount * 300 + l_linenumber AS i4 FROM {GAPPY} WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL)"


def items(t):
    qy = F.col("l_quantity")
    return t.gappy_lineitem.select(
        qy.alias("i1"), (qy + F.col("l_partkey") % 19).alias("i2"), (qy * 0.5 + F.col("l_suppkey") % 13).alias("i3"),
        (F.col("l_discount") * 300 + F.col("l_linenumber")).alias("i4"),
    )


@query("cronbach_alpha", f"SELECT count(*) AS n, 4::INTEGER AS items, round(4 / 3.0 * (1 - (var_samp(i1) + var_samp(i2) + var_samp(i3) + var_samp(i4)) / var_samp(i1 + i2 + i3 + i4)), 6) AS alpha FROM {ITEM_ROWS}")
def cronbach_alpha(t):
    return rounded(hypothesis.cronbach_alpha(items(t), ITEMS), 6, "alpha")


@query(
    "alpha_if_deleted",
    " UNION ALL ".join(
        f"SELECT '{c}' AS item, round(3 / 2.0 * (1 - ({' + '.join(f'var_samp({o})' for o in ITEMS if o != c)}) / var_samp({' + '.join(o for o in ITEMS if o != c)})), 6) AS alpha FROM {ITEM_ROWS}"
        for c in ITEMS
    ),
)
def alpha_if_deleted(t):
    return rounded(hypothesis.alpha_if_deleted(items(t), ITEMS), 6, "alpha")


R3 = f"(SELECT corr(i1, i2) AS a, corr(i1, i3) AS b, corr(i2, i3) AS c, count(*) AS n FROM {ITEM_ROWS})"


@query(
    "kmo",
    f"""SELECT n, round(r / (r + pa + pb + pc), 5) AS kmo FROM (SELECT n, a * a + b * b + c * c AS r, pow(a - b * c, 2) / ((1 - b * b) * (1 - c * c)) AS pa,
      pow(b - a * c, 2) / ((1 - a * a) * (1 - c * c)) AS pb, pow(c - a * b, 2) / ((1 - a * a) * (1 - b * b)) AS pc FROM {R3})""",
)
def kmo(t):
    full = items(t).where("i4 is not null")
    return rounded(hypothesis.kmo(full, ITEMS[:3]), 5, "kmo")


@query(
    "bartlett",
    f"""SELECT n, round(chi2, 3) AS chi2, 3.0::DOUBLE AS df, round({chi2_upper_sql("chi2", "3")}, 4) AS p FROM
      (SELECT n, -(n - 1 - 11 / 6.0) * ln(1 + 2 * a * b * c - a * a - b * b - c * c) AS chi2 FROM
      (SELECT count(*) AS n, corr(l_quantity, l_discount) AS a, corr(l_quantity, l_tax) AS b, corr(l_discount, l_tax) AS c FROM {GAPPY}
      WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL))""",
)
def bartlett(t):
    out = hypothesis.bartlett(t.gappy_lineitem, ["l_quantity", "l_discount", "l_tax"])
    return rounded(out, 4, "p").withColumn("chi2", F.round("chi2", 3))


@query("efa_loadings")
def efa_loadings(t):
    return hypothesis.efa_loadings(items(t), ITEMS, 2)
