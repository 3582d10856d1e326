"""Capability, rules, features, models and forecasts."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabsmith.operators import (
    arima, boosting, encoding, evaluation, features, hypothesis, mars, models, rules, spc, trees,
)
from tabsmith.session import materialize, scratch_path
from workload.base import GAPPY, KEY_SQL, ROW_KEY, query, quantile_sql, t_two_sided_sql
from workload.preparation import DERIVED, derived, rounded
from workload.statistics import shapiro_sql

# --- capability -----------------------------------------------------------------------------

ORDER = ["ts", "event_id"]
LSL, USL = -40.0, 160.0
MR_SQL = """(SELECT event_type, avg(abs(value - prev)) / 1.128 AS sigma_within FROM (SELECT event_type, value,
  lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS prev FROM events) GROUP BY event_type)"""
SUB_SQL = """(SELECT event_type, sqrt(avg(v)) AS sigma_within FROM (SELECT event_type, s, count(*) AS n, var_samp(value) AS v FROM (SELECT event_type, value,
  (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 5 AS s FROM events) GROUP BY event_type, s) WHERE n = 5 GROUP BY event_type)"""
TOTAL_SQL = "(SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sigma_total FROM events GROUP BY event_type)"


@query("spc_sigma_within", f"SELECT event_type, round(sigma_within, 6) AS sigma_within FROM {MR_SQL}")
def spc_sigma_within(t):
    return rounded(spc.sigma_within(t.events, ["event_type"], "value", ORDER), 6, "sigma_within")


@query("spc_sigma_subgroup", f"SELECT event_type, round(sigma_within, 6) AS sigma_within FROM {SUB_SQL}")
def spc_sigma_subgroup(t):
    return rounded(spc.sigma_within(t.events, ["event_type"], "value", ORDER, 5), 6, "sigma_within")


def index_sql(p: str, sigma: str) -> str:
    return (
        f"round(({USL} - {LSL}) / (6 * {sigma}), 6) AS {p}, round(({USL} - mean) / (3 * {sigma}), 6) AS {p}u,"
        f" round((mean - {LSL}) / (3 * {sigma}), 6) AS {p}l, round(least(({USL} - mean), (mean - {LSL})) / (3 * {sigma}), 6) AS {p}k"
    )


def capability(t, subgroup=1):
    return spc.capability(t.events, ["event_type"], "value", ORDER, LSL, USL, subgroup)


@query("spc_cp_cpk", f"SELECT event_type, {index_sql('cp', 'sigma_within')} FROM {TOTAL_SQL} JOIN {MR_SQL} USING (event_type)")
def spc_cp_cpk(t):
    return rounded(capability(t).select("event_type", "cp", "cpu", "cpl", "cpk"), 6, "cp", "cpu", "cpl", "cpk")


@query("spc_pp_ppk", f"SELECT event_type, {index_sql('pp', 'sigma_total')} FROM {TOTAL_SQL}")
def spc_pp_ppk(t):
    return rounded(capability(t).select("event_type", "pp", "ppu", "ppl", "ppk"), 6, "pp", "ppu", "ppl", "ppk")


def exact_cdf_sql(z: str) -> str:
    """Normal CDF by Simpson's rule from 0."""
    w = "CASE WHEN s.i IN (0, 2000) THEN 1 WHEN s.i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(0.5 + (SELECT sum({w} * exp(-pow({z} * s.i / 2000.0, 2) / 2)) * {z} / 6000.0 / sqrt(2 * pi()) FROM range(0, 2001) s(i)))"


@query(
    "spc_yield_ppm",
    f"""SELECT event_type, round(y, 7) AS yield, round((1 - y) * 1e6, 2) AS ppm FROM (SELECT event_type,
      {exact_cdf_sql(f'(({USL} - mean) / sigma_total)')} - {exact_cdf_sql(f'(({LSL} - mean) / sigma_total)')} AS y FROM {TOTAL_SQL})""",
)
def spc_yield_ppm(t):
    c = capability(t)
    return c.select("event_type", F.round("yield", 7).alias("yield"), F.round("ppm", 2).alias("ppm"))


@query("spc_sigma_level")
def spc_sigma_level(t):
    return capability(t).select("event_type", "yield", "sigma_level")


@query("spc_normality", f"SELECT *, p > 0.05 AS is_normal FROM ({shapiro_sql('event_type')})")
def spc_normality(t):
    """Shapiro-Francia for each type of event; `is_normal` at p > 0.05, NULL beyond 5000 rows."""
    w = rounded(hypothesis.shapiro_francia_by(t.events, ["event_type"], "value"), 5, "w", "p")
    return w.withColumn("is_normal", F.col("p") > 0.05)


@query(
    "spc_insights",
    f"""SELECT event_type, CASE WHEN cp > 1.33 AND cpk < 1 THEN 'capable but off centre' WHEN cp < 1 THEN 'spread too wide' ELSE '' END AS spread_insight,
      CASE WHEN cpk < 1.33 THEN 'insufficient or marginal' ELSE 'excellent' END AS level_insight FROM
      (SELECT event_type, {index_sql('cp', 'sigma_within')} FROM {TOTAL_SQL} JOIN {MR_SQL} USING (event_type))""",
)
def spc_insights(t):
    return spc.insights(capability(t)).select("event_type", "spread_insight", "level_insight")


@query(
    "spc_curve",
    """WITH f AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) SELECT CAST(i AS INTEGER) AS i, round(m + (i * 0.1 - 4) * s, 5) AS x,
      round(exp(-pow(i * 0.1 - 4, 2) / 2) / sqrt(2 * pi()) / s, 8) AS density FROM f, range(0, 81) r(i)""",
)
def spc_curve(t):
    _, density = spc.curve(t.events, "value", 20, 81)
    return density.select("i", F.round("x", 5).alias("x"), F.round("density", 8).alias("density"))


@query(
    "spc_histogram",
    """WITH lim AS (SELECT min(value) AS lo, (max(value) - min(value)) / 20 AS w FROM events) SELECT CAST(i AS INTEGER) AS bin, round(lo + (i + 0.5) * w, 7) AS mid, count(value) AS n
      FROM lim, range(0, 20) r(i) LEFT JOIN events ON greatest(0, least(floor((value - (SELECT lo FROM lim)) / (SELECT w FROM lim)), 19)) = i GROUP BY i, lo, w""",
)
def spc_histogram(t):
    h, _ = spc.curve(t.events, "value", 20)
    return rounded(h, 7, "mid")


@query(
    "spc_by_group",
    f"""SELECT event_type, n, round(mean, 6) AS mean, round(sigma_total, 6) AS sigma_total, round(sigma_within, 6) AS sigma_within, {index_sql('cp', 'sigma_within')},
      {index_sql('pp', 'sigma_total')} FROM {TOTAL_SQL} JOIN {SUB_SQL} USING (event_type)""",
)
def spc_by_group(t):
    cols = ["mean", "sigma_total", "sigma_within", "cp", "cpu", "cpl", "cpk", "pp", "ppu", "ppl", "ppk"]
    return rounded(capability(t, 5).select("event_type", "n", *cols), 6, *cols)


# --- bins and rules -------------------------------------------------------------------------

RULE_COLS = ["l_quantity", "l_discount", "l_returnflag"]


def planted(t):
    """Target depends on quantity and flag, so that rules exist; NULLs stay NULL."""
    return t.gappy_lineitem.withColumn(
        "yield_",
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity") * 2).otherwise(F.col("l_quantity"))
        + (F.col("l_partkey") % 11),
    )


PLANTED = f"(SELECT *, CASE WHEN l_returnflag = 'R' THEN l_quantity * 2 ELSE l_quantity END + l_partkey % 11 AS yield_ FROM {GAPPY})"


def bin_sql(c: str, source: str) -> str:
    """Item token of a column with three quantile bins (two distinct cuts assumed)."""
    cuts = f"(SELECT {quantile_sql(c, 1 / 3, 'floor')} AS a, {quantile_sql(c, 2 / 3, 'floor')} AS b FROM {source})"
    return f"""(SELECT CASE WHEN x.{c} IS NULL THEN NULL WHEN x.{c} < q.a THEN '{c}:low(<' || printf('%.2f', q.a) || ')'
      WHEN x.{c} < q.b THEN '{c}:mid(' || printf('%.2f', q.a) || '~' || printf('%.2f', q.b) || ')' ELSE '{c}:high(>=' || printf('%.2f', q.b) || ')' END FROM {cuts} q)"""


@query(
    "quantile_bins",
    f"""SELECT {KEY_SQL}, split_part({bin_sql('l_quantity', GAPPY)}, ':', 2) AS l_quantity_bin, split_part({bin_sql('l_extendedprice', GAPPY)}, ':', 2) AS l_extendedprice_bin FROM {GAPPY} x""",
)
def quantile_bins(t):
    out = encoding.quantile_bins(t.gappy_lineitem, ["l_quantity", "l_extendedprice"], 3)
    return out.select(*ROW_KEY, "l_quantity_bin", "l_extendedprice_bin")


ITEMS_SQL = f"""(SELECT {KEY_SQL}, {bin_sql('l_quantity', PLANTED)} AS a, {bin_sql('l_discount', PLANTED)} AS b, 'l_returnflag:' || l_returnflag AS c, {bin_sql('yield_', PLANTED)} AS d FROM {PLANTED} x)"""


def baskets(t, keep=()):
    items, labels = rules.binned_items(planted(t), [*RULE_COLS, "yield_"])
    return rules.transactions(items, [*RULE_COLS, "yield_"], keep), labels


def counted_baskets(t):
    items, labels = rules.binned_items(planted(t), [*RULE_COLS, "yield_"])
    return rules.count_baskets(items, [*RULE_COLS, "yield_"]), labels


@query(
    "transactions",
    f"SELECT {KEY_SQL}, concat_ws(' & ', a, b, c, d) AS items FROM {ITEMS_SQL} WHERE (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + 1 + (d IS NOT NULL)::INT >= 2",
)
def transactions(t):
    b, _ = baskets(t, ROW_KEY)
    return b.select(*ROW_KEY, F.array_join("items", " & ").alias("items"))


MIN_SUPPORT = 0.03
SETS_SQL = f"""(SELECT list_sort(list_filter([a, b, c, d], lambda x: x IS NOT NULL)) AS items, count(*) AS n FROM
  (SELECT CASE WHEN m & 1 > 0 THEN a END AS a, CASE WHEN m & 2 > 0 THEN b END AS b, CASE WHEN m & 4 > 0 THEN c END AS c, CASE WHEN m & 8 > 0 THEN d END AS d
   FROM {ITEMS_SQL}, range(1, 16) r(m) WHERE (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + 1 + (d IS NOT NULL)::INT >= 2
   AND (m & 1 = 0 OR a IS NOT NULL) AND (m & 2 = 0 OR b IS NOT NULL) AND (m & 8 = 0 OR d IS NOT NULL))
  GROUP BY a, b, c, d)"""
TOTAL_BASKETS = f"(SELECT count(*) AS total FROM {ITEMS_SQL} WHERE (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + 1 + (d IS NOT NULL)::INT >= 2)"
FREQ_SQL = f"(SELECT items, n FROM {SETS_SQL}, {TOTAL_BASKETS} WHERE n >= ceil({MIN_SUPPORT} * total))"


@query("frequent_itemsets", f"SELECT array_to_string(items, ' & ') AS itemset, n FROM {FREQ_SQL}")
def frequent_itemsets(t):
    b, _ = counted_baskets(t)
    f = rules.frequent_itemsets(b, MIN_SUPPORT)
    return f.select(F.array_join("items", " & ").alias("itemset"), "n")


RULES_SQL = f"""(WITH f AS {FREQ_SQL}, t AS {TOTAL_BASKETS}, p AS (SELECT list_filter(items, lambda x: NOT starts_with(x, 'yield_:')) AS l, list_filter(items, lambda x: starts_with(x, 'yield_:')) AS h, n FROM f WHERE len(items) >= 2)
  SELECT array_to_string(l, ' & ') AS lhs, h[1] AS rhs, x.n AS count_x, p.n AS count_xy, y.n AS count_y, total, p.n / x.n::DOUBLE AS confidence,
  p.n::DOUBLE * total / (x.n::DOUBLE * y.n) AS lift FROM p JOIN f x ON x.items = p.l JOIN f y ON y.items = p.h, t WHERE len(h) = 1
  AND p.n / x.n::DOUBLE >= 0.4 AND abs(p.n::DOUBLE * total / (x.n::DOUBLE * y.n) - 1) >= 0.05)"""


def all_rules(t):
    b, labels = counted_baskets(t)
    return rules.target_rules(b, "yield_", MIN_SUPPORT, 0.4), labels["yield_"]


@query("target_rules", f"SELECT lhs, rhs, count_x, count_xy, count_y, total, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM {RULES_SQL} ORDER BY lift DESC, confidence DESC, lhs, rhs LIMIT 30")
def target_rules(t):
    return rounded(rules.top_rules(all_rules(t)[0], 30), 6, "confidence", "lift")


@query(
    "best_worst_rule",
    f"""SELECT lhs, rhs, round(lift, 6) AS lift, side FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY lift DESC, confidence DESC, lhs) AS r FROM
      (SELECT *, CASE WHEN starts_with(rhs, 'yield_:high') THEN 'best' WHEN starts_with(rhs, 'yield_:low') THEN 'worst' END AS side FROM {RULES_SQL}) WHERE side IS NOT NULL) WHERE r = 1""",
)
def best_worst_rule(t):
    r, labels = all_rules(t)
    out = rules.best_worst_rule(r, *rules.rule_sides(labels))
    return rounded(out.select("lhs", "rhs", "lift", "side"), 6, "lift")


@query(
    "rule_grade",
    f"""SELECT lhs, rhs, CASE WHEN lift > 1.5 AND starts_with(rhs, 'yield_:high') THEN 'strong favourable' WHEN lift > 1.5 AND starts_with(rhs, 'yield_:low') THEN 'strong unfavourable'
      WHEN lift > 1 AND starts_with(rhs, 'yield_:high') THEN 'favourable' WHEN lift > 1 AND starts_with(rhs, 'yield_:low') THEN 'unfavourable' ELSE 'neutral' END AS grade FROM {RULES_SQL}""",
)
def rule_grade(t):
    r, labels = all_rules(t)
    return rules.rule_grade(r, *rules.rule_sides(labels)).select("lhs", "rhs", "grade")


# --- evaluation -----------------------------------------------------------------------------

SCORED = "(SELECT *, 2 * l_quantity + 10 AS actual, 2 * l_quantity + 10 + (l_partkey % 13 - 6) AS predicted FROM lineitem)"


def scored(t):
    a = 2 * F.col("l_quantity") + 10
    return t.lineitem.withColumns({"actual": a, "predicted": a + (F.col("l_partkey") % 13 - 6)})


@query(
    "metrics_regression",
    f"""SELECT count(*) AS n, round(1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)), 6) AS r2,
      round(sqrt(avg((actual - predicted) * (actual - predicted))), 6) AS rmse, round(avg(abs(actual - predicted)), 6) AS mae FROM {SCORED}""",
)
def metrics_regression(t):
    return rounded(evaluation.metrics_regression(scored(t), "actual", "predicted"), 6, "r2", "rmse", "mae")


CLASSED = "(SELECT label, CASE WHEN vec_id % 4 = 0 THEN (label + 1) % 10 WHEN vec_id % 9 = 0 THEN 3 ELSE label END AS guess, vec_id FROM embeddings)"


def classed(t):
    v, l = F.col("vec_id"), F.col("label")
    return t.embeddings.select(
        "vec_id", "label", F.when(v % 4 == 0, (l + 1) % 10).when(v % 9 == 0, 3).otherwise(l).alias("guess")
    )


@query(
    "metrics_classification",
    f"""WITH c AS (SELECT label AS class, count(*) AS support, count(*) FILTER (WHERE label = guess) AS tp FROM {CLASSED} GROUP BY label), g AS (SELECT guess AS class, count(*) AS chosen FROM {CLASSED} GROUP BY guess)
      SELECT class, support, round(tp / chosen, 6) AS precision, round(tp / support, 6) AS recall, round(2 * (tp / chosen) * (tp / support) / (tp / chosen + tp / support), 6) AS f1,
      round((SELECT avg((label = guess)::INT) FROM {CLASSED}), 6) AS accuracy FROM c JOIN g USING (class)""",
)
def metrics_classification(t):
    m = evaluation.metrics_classification(classed(t), "label", "guess")
    return rounded(m, 6, "precision", "recall", "f1", "accuracy")


@query("confusion_matrix", f"SELECT label, guess AS predicted, count(*) AS n FROM {CLASSED} GROUP BY 1, 2")
def confusion_matrix(t):
    return evaluation.confusion(classed(t), "label", "guess")


LABELLED = "(SELECT quality, toxic, n_chars // 50 AS s, lang, doc_id FROM labels JOIN documents USING (doc_id))"


def labelled(t):
    return t.labels.join(t.documents.drop("text"), "doc_id")


def auc_sql(pos: str) -> str:
    return f"""SELECT (sum(CASE WHEN p THEN rk ELSE 0 END) - count(*) FILTER (WHERE p) * (count(*) FILTER (WHERE p) + 1) / 2.0) / (count(*) FILTER (WHERE p) * count(*) FILTER (WHERE NOT p)) AS auc,
      count(*) FILTER (WHERE p) AS positives, count(*) FILTER (WHERE NOT p) AS negatives FROM (SELECT {pos} AS p, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM {LABELLED})"""


@query("auc", f"SELECT round(auc, 6) AS auc, positives, negatives FROM ({auc_sql('quality = 1')})")
def auc(t):
    d = labelled(t).withColumn("s", F.floor(F.col("n_chars") / 50))
    return rounded(evaluation.auc(d, F.col("quality") == 1, "s"), 6, "auc")


@query(
    "auc_one_vs_rest",
    f"""SELECT round(avg(auc), 6) AS auc, count(*) AS classes FROM ({' UNION ALL '.join('SELECT * FROM (' + auc_sql(f"quality + toxic = {i}") + ')' for i in range(3))})""",
)
def auc_one_vs_rest(t):
    d = labelled(t).withColumns({"s": F.floor(F.col("n_chars") / 50), "cls": F.col("quality") + F.col("toxic")})
    return rounded(evaluation.auc_one_vs_rest(d, "cls", {0: "s", 1: "s", 2: "s"}), 6, "auc")


@query(
    "model_verdict",
    """SELECT c_custkey, CASE WHEN r >= 0.8 THEN 'excellent' WHEN r >= 0.6 THEN 'good' WHEN r >= 0.4 THEN 'fair' ELSE 'poor' END AS grade, q - r > 0.2 AS overfit, r < 0.5 AS weak
      FROM (SELECT c_custkey, c_acctbal / 10000 AS r, c_nationkey / 25.0::DOUBLE AS q FROM customer)""",
)
def model_verdict(t):
    c = t.customer.select("c_custkey", (F.col("c_acctbal") / 10000).alias("test_r2"), (F.col("c_nationkey") / F.lit(25.0)).alias("train_r2"))
    return evaluation.model_verdict(c).select("c_custkey", "grade", "overfit", "weak")


@query("residual_points", f"SELECT {KEY_SQL}, actual, predicted::DOUBLE AS predicted, actual - predicted AS residual FROM {SCORED}")
def residual_points(t):
    return evaluation.residual_points(scored(t), "actual", "predicted", ROW_KEY)


@query("pred_vs_actual", f"SELECT actual, predicted, count(*) AS n FROM {SCORED} GROUP BY 1, 2")
def pred_vs_actual(t):
    return scored(t).groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query(
    "scale_fit",
    f"""SELECT {KEY_SQL}, round((l_quantity - m) / s, 4) AS l_quantity FROM {GAPPY}, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM {GAPPY} WHERE l_orderkey % 5 <> 0)""",
)
def scale_fit(t):
    out = features.scale_fit(t.gappy_lineitem, F.col("l_orderkey") % 5 != 0, ["l_quantity"])
    return rounded(out.select(*ROW_KEY, "l_quantity"), 4, "l_quantity")


@query(
    "scale_fit_minmax",
    f"""SELECT {KEY_SQL}, round((l_quantity - m) / s, 4) AS l_quantity FROM {GAPPY}, (SELECT min(l_quantity) AS m, max(l_quantity) - min(l_quantity) AS s FROM {GAPPY} WHERE l_orderkey % 5 <> 0)""",
)
def scale_fit_minmax(t):
    out = features.scale_fit(t.gappy_lineitem, F.col("l_orderkey") % 5 != 0, ["l_quantity"], "minmax")
    return rounded(out.select(*ROW_KEY, "l_quantity"), 4, "l_quantity")


@query("dedupe_before_fit", f"SELECT DISTINCT l_quantity, l_discount, l_returnflag FROM {GAPPY}")
def dedupe_before_fit(t):
    return features.dedupe_before_fit(t.gappy_lineitem, ["l_quantity", "l_discount", "l_returnflag"])


SPLIT_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
BUCKET = f"('0x' || substr(md5(concat_ws('|', {', '.join(SPLIT_KEY)}, 42)), 1, 8))::BIGINT"


@query("split_holdout", f"SELECT {KEY_SQL}, CASE WHEN {BUCKET} % 10000 >= 2000 THEN 'train' ELSE 'test' END AS part FROM lineitem")
def split_holdout(t):
    train, test = features.split_holdout(t.lineitem.select(*ROW_KEY), SPLIT_KEY, 0.2)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("split_kfold", f"SELECT {KEY_SQL}, CAST({BUCKET} % 5 AS INTEGER) AS fold FROM lineitem")
def split_kfold(t):
    return features.split_kfold(t.lineitem.select(*ROW_KEY), SPLIT_KEY, 5)


NUMS, CATS = ["l_quantity", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus"]


def codes_sql(column: str, source: str) -> str:
    """Codes 0, 1, ... of the levels, the most frequent first, ties in order."""
    return f"(SELECT {column} AS v, row_number() OVER (ORDER BY count(*) DESC, {column}) - 1 AS k FROM {source} GROUP BY {column})"


def slots(df, n: int):
    """The vector as n rounded columns f0, f1, ..."""
    xs = vector_to_array("features")
    return df.select(*ROW_KEY, *[(F.round(xs[i], 6) + 0.0).alias(f"f{i}") for i in range(n)])


RAW_FEATURES = f"""(SELECT {KEY_SQL}, coalesce(l_quantity, (SELECT avg(l_quantity) FROM {GAPPY})) AS x0, coalesce(l_discount, (SELECT avg(l_discount) FROM {GAPPY})) AS x1,
  coalesce(l_tax, (SELECT avg(l_tax) FROM {GAPPY})) AS x2, CAST(r.k = 0 AS DOUBLE) AS x3, CAST(r.k = 1 AS DOUBLE) AS x4, CAST(r.k = 2 AS DOUBLE) AS x5, CAST(s.k = 0 AS DOUBLE) AS x7, CAST(s.k = 1 AS DOUBLE) AS x8
  FROM {GAPPY} g JOIN {codes_sql('l_returnflag', GAPPY)} r ON g.l_returnflag = r.v JOIN {codes_sql('l_linestatus', GAPPY)} s ON g.l_linestatus = s.v)"""
SCALED = ", ".join("0.0 AS f%d" % i if i in (6, 9) else f"round((x{i} - avg(x{i}) OVER ()) / stddev_samp(x{i}) OVER (), 6) + 0.0 AS f{i}" for i in range(10))


@query("feature_pipeline", f"SELECT {KEY_SQL}, {SCALED} FROM {RAW_FEATURES}")
def feature_pipeline(t):
    """Slots 6 and 9 stand for labels not seen in training."""
    model = features.fit_features(t.gappy_lineitem, NUMS, CATS, scale="standard")
    out = features.apply_features(model, t.gappy_lineitem, NUMS, CATS)
    return slots(out, 10)


SEEN = f"(SELECT * FROM {GAPPY} WHERE l_returnflag <> 'R')"


@query(
    "transform_stored",
    f"""SELECT {KEY_SQL}, round(coalesce(l_quantity, (SELECT avg(l_quantity) FROM {SEEN})), 6) AS f0, round(coalesce(l_discount, (SELECT avg(l_discount) FROM {SEEN})), 6) AS f1,
      round(coalesce(l_tax, (SELECT avg(l_tax) FROM {SEEN})), 6) AS f2, CAST(coalesce(r.k, (SELECT count(DISTINCT l_returnflag) FROM {SEEN})) AS DOUBLE) AS f3, CAST(s.k AS DOUBLE) AS f4
      FROM {GAPPY} g LEFT JOIN {codes_sql('l_returnflag', SEEN)} r ON g.l_returnflag = r.v JOIN {codes_sql('l_linestatus', SEEN)} s ON g.l_linestatus = s.v""",
)
def transform_stored(t):
    """A stored pipeline applied to rows with labels it has never seen."""
    from pyspark.ml import PipelineModel

    seen = t.gappy_lineitem.where("l_returnflag <> 'R'")
    path = scratch_path(t.spark, "pipeline")
    features.fit_features(seen, NUMS, CATS, one_hot=False).write().save(path)
    out = features.apply_features(PipelineModel.load(path), t.gappy_lineitem, NUMS, CATS)
    return slots(out, 5)


# --- models ---------------------------------------------------------------------------------


def ols_sql(select: str) -> str:
    """Two-predictor least squares in closed form from centred sums."""
    return f"""WITH d AS (SELECT l_quantity AS a, l_discount AS b, y FROM {DERIVED} WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND y IS NOT NULL),
      s AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb, var_pop(y) * count(*) AS yy,
        covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS by_ FROM d),
      c AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS b1, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS b2 FROM s),
      e AS (SELECT *, my - b1 * ma - b2 * mb AS b0, (yy - b1 * ay - b2 * by_) AS rss, (yy - b1 * ay - b2 * by_) / (n - 3) AS mse FROM c),
      r AS (SELECT 'intercept' AS term, b0 AS b, sqrt(mse * (1.0 / n + (ma * ma * bb - 2 * ma * mb * ab + mb * mb * aa) / (aa * bb - ab * ab))) AS se, n FROM e
        UNION ALL SELECT 'l_quantity', b1, sqrt(mse * bb / (aa * bb - ab * ab)), n FROM e UNION ALL SELECT 'l_discount', b2, sqrt(mse * aa / (aa * bb - ab * ab)), n FROM e)
      {select}"""


@query("ols", ols_sql(f"SELECT term, round(b, 5) AS coefficient, round(se, 6) AS se, round(b / se, 3) AS t, round({t_two_sided_sql('b / se', 'n - 3')}, 5) AS p FROM r"))
def ols(t):
    coef, _ = models.ols(derived(t), "y", ["l_quantity", "l_discount"])
    return coef.select(
        "term", F.round("coefficient", 5).alias("coefficient"), F.round("se", 6).alias("se"), F.round("t", 3).alias("t"), F.round("p", 5).alias("p")
    )


@query("ols_fit", ols_sql("SELECT n, round(1 - rss / yy, 6) AS r2, round(1 - rss / yy * (n - 1) / (n - 3), 6) AS adjusted_r2, round(mse, 5) AS mse FROM e"))
def ols_fit(t):
    _, fit = models.ols(derived(t), "y", ["l_quantity", "l_discount"])
    return fit.select("n", F.round("r2", 6).alias("r2"), F.round("adjusted_r2", 6).alias("adjusted_r2"), F.round("mse", 5).alias("mse"))


def regression_data(t, scale="standard"):
    """Prepared train and test frames for the derived target."""
    d = derived(t).where("y is not null").select(*ROW_KEY, "l_quantity", "l_discount", "l_tax", "l_returnflag", F.col("y").alias("label"))
    train, _ = features.split_holdout(d, SPLIT_KEY, 0.2)
    prep = features.fit_features(train, NUMS, ["l_returnflag"], scale=scale)
    names = features.feature_names(prep, train, NUMS, ["l_returnflag"])
    ready = materialize(features.apply_features(prep, d, NUMS, ["l_returnflag"]).select(*ROW_KEY, "features", "label"), "model")
    return *features.split_holdout(ready, SPLIT_KEY, 0.2), names


def fit_and_evaluate(t, build):
    train, test, names = regression_data(t)
    est = build(train)
    model = est.fit(train)
    return model, models.evaluate_regression(model, train, test), names, train, test


def coefs_and_metrics(t, build):
    model, m, names, train, _ = fit_and_evaluate(t, build)
    coef = models.coefficient_table(model, names, train).select(F.col("feature").alias("name"), F.col("coefficient").alias("value"))
    return coef.unionByName(m.select(F.concat_ws("_", F.lit("r2"), "part").alias("name"), F.col("r2").alias("value")))


FACTS = f"""SELECT CASE WHEN {BUCKET} % 10000 >= 2000 THEN 'train' ELSE 'test' END AS part, count(*) AS n, true AS good, 'l_quantity' AS strongest
  FROM {DERIVED} WHERE y IS NOT NULL GROUP BY 1"""


def model_facts(t, build, least: float = 0.95):
    """Rows scored in each part, whether R2 is above `least` there (the planted line explains about 98 %),
    and the strongest input by the model's own account."""
    model, m, names, train, _ = fit_and_evaluate(t, build)
    table = models.importance_table if hasattr(model, "featureImportances") else models.coefficient_table
    weight = "importance" if table is models.importance_table else "coefficient"
    strongest = table(model, names, train).where(F.col("feature") != "intercept").orderBy(F.desc(F.abs(weight))).first()["feature"]
    return m.select("part", "n", (F.col("r2") > least).alias("good"), F.lit(strongest).alias("strongest"))


@query("ridge_coefficients")
def ridge_coefficients(t):
    return coefs_and_metrics(t, lambda train: models.ridge(train.count(), 1.0))


@query("rf_regression", FACTS)
def rf_regression(t):
    return model_facts(t, lambda _: models.rf_regression(), 0.9)


def boosted_facts(t, settings):
    """`model_facts` of a boosted ensemble: scores by its own trees, strongest input by exact Shapley values."""
    train, test, names = regression_data(t)
    model = boosting.fit(train, settings, ROW_KEY)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    m = evaluation.metrics_regression(trees.with_prediction(both, model), "label", "prediction", ["part"])
    strongest = trees.shapley_importance(test, model, names).orderBy(F.desc("importance")).first()["feature"]
    return m.select("part", "n", (F.col("r2") > 0.9).alias("good"), F.lit(strongest).alias("strongest"))


@query("gbt_regression_xgb", FACTS)
def gbt_regression_xgb(t):
    return boosted_facts(t, boosting.xgb())


@query("gbt_regression_lgbm", FACTS)
def gbt_regression_lgbm(t):
    return boosted_facts(t, boosting.lgbm())


@query("replace_importance")
def replace_importance(t):
    train, test, names = regression_data(t)
    return models.replace_importance(models.ridge(train.count(), 1.0).fit(train), test, names)


@query("shap_importance")
def shap_importance(t):
    """Mean absolute exact Shapley values of a boosted ensemble over all test rows."""
    train, test, names = regression_data(t)
    model = boosting.fit(train, boosting.xgb(rounds=30), ROW_KEY)
    return trees.shapley_importance(test, model, names)


@query("pdp")
def pdp(t):
    """Partial dependence of a forest from its trees alone; only the grid's ends read rows."""
    train, test, names = regression_data(t)
    slot = names.index("l_quantity")
    forest = trees.from_forest(t.spark, models.rf_regression(30).fit(train), len(names))
    return trees.dependence_table(test, forest, slot, "l_quantity", models.pdp_grid(test, slot, 20))


@query("batch_score")
def batch_score(t):
    d = derived(t).where("y is not null").withColumn("label", F.col("y"))
    src = features.prepare(d, NUMS, ["l_returnflag"])
    stages = [*features.feature_stages(NUMS, ["l_returnflag"], scale="standard"), models.ridge(src.count(), 1.0)]
    path = scratch_path(t.spark, "model")
    models.save_model(Pipeline(stages=stages).fit(src), path)
    return models.batch_score(path, src).select(*ROW_KEY, "prediction")


def classification_data(t):
    """Wide part of the order table: a class that depends on price and date, with text features."""
    o = t.orders.withColumns(
        {
            "label": ((F.col("o_totalprice") > 250000) & (F.col("o_orderstatus") != "P")).cast("double"),
            "price": F.when(F.col("o_custkey") % 9 != 0, F.col("o_totalprice")),
        }
    )
    train, test = features.split_holdout(o, ["o_orderkey"], 0.2)
    nums, cats = ["price"], ["o_orderstatus", "o_orderpriority"]
    prep = features.fit_features(train, nums, cats, scale="standard")
    done = [
        materialize(features.apply_features(prep, p, nums, cats).select("o_orderkey", "features", "label"), "class")
        for p in (train, test)
    ]
    return done[0], done[1], features.feature_names(prep, train, nums, cats)


def class_metrics(model, test):
    m = evaluation.metrics_classification(model.transform(test), "label", "prediction")
    return m.select(F.col("class").cast("string").alias("name"), F.col("f1").alias("value")).unionByName(
        m.select(F.lit("accuracy").alias("name"), F.col("accuracy").alias("value")).distinct()
    )


@query("logistic")
def logistic(t):
    train, test, names = classification_data(t)
    model = models.logistic(train.count()).fit(train)
    s = model.transform(test).withColumn("score", vector_to_array("probability")[1])
    area = evaluation.auc(s, F.col("label") == 1, "score").select(F.lit("auc").alias("name"), F.col("auc").alias("value"))
    coef = models.coefficient_table(model, names, train).select(F.col("feature").alias("name"), F.col("coefficient").alias("value"))
    return class_metrics(model, test).unionByName(area).unionByName(coef)


@query("logistic_classes")
def logistic_classes(t):
    """Coefficients of each order status (F, O, P) on price and year."""
    o = t.orders.withColumn("label", F.when(F.col("o_orderstatus") == "F", 0.0).when(F.col("o_orderstatus") == "O", 1.0).otherwise(2.0))
    o = o.withColumn("year", F.year("o_orderdate").cast("double"))
    prep = features.fit_features(o, ["o_totalprice", "year"], [], scale="standard")
    ready = materialize(features.apply_features(prep, o, ["o_totalprice", "year"], []).select("features", "label"), "statuses")
    model = models.logistic(ready.count()).fit(ready)
    return models.class_coefficients(model, ["o_totalprice", "year"], ready)


@query(
    "cross_validate_classes",
    """SELECT CAST(('0x' || substr(md5(concat_ws('|', o_orderkey, 42)), 1, 8))::BIGINT % 3 AS INTEGER) AS fold,
      CAST(o_totalprice > 250000 AS DOUBLE) AS class, count(*) AS support, true AS good FROM orders GROUP BY ALL""",
)
def cross_validate_classes(t):
    """Folds and supports exactly; a class that one cut on the price decides must be found nearly always."""
    o = t.orders.withColumn("label", (F.col("o_totalprice") > 250000).cast("double"))
    prep = features.fit_features(o, ["o_totalprice"], [], scale="standard")
    ready = features.apply_features(prep, o, ["o_totalprice"], []).select("o_orderkey", "features", "label")
    folded = materialize(features.split_kfold(ready, ["o_orderkey"], 3), "folds")
    m = models.cross_validate_classes(folded, models.decision_tree(4), "fold", 3)
    return m.select("fold", "class", "support", (F.col("f1") > 0.95).alias("good"))


@query("decision_tree")
def decision_tree(t):
    train, test, names = classification_data(t)
    model = models.decision_tree(4).fit(train)
    rule = t.spark.createDataFrame(models.tree_rules(model, names), "leaf int, rule string")
    return models.leaf_stats(model.transform(train)).join(rule, "leaf")


@query("rf_classification")
def rf_classification(t):
    train, test, names = classification_data(t)
    model = models.rf_classification().fit(train)
    imp = models.importance_table(model, names, train).select(F.col("feature").alias("name"), F.col("importance").alias("value"))
    return class_metrics(model, test).unionByName(imp)


def cluster_data(t):
    v = t.embeddings.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    cols = [f"e{i}" for i in range(64)]
    prep = features.fit_features(v, cols, [], scale="standard")
    return features.apply_features(prep, v, cols, []), cols


@query("kmeans", "SELECT count(*) AS n, 3::BIGINT AS clusters, true AS nearest FROM embeddings")
def kmeans(t):
    """Rows over all clusters, their number, and whether every row is in the cluster of its nearest centre."""
    d, _ = cluster_data(t)
    model, assigned = models.kmeans(d, 3)
    x, centres = vector_to_array("features"), [c.tolist() for c in model.clusterCenters()]
    gaps = [F.aggregate(F.zip_with(x, F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for c in centres]
    own = F.get(F.array(*gaps), F.col("cluster"))
    return assigned.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("cluster").alias("clusters"), F.bool_and(own <= F.array_min(F.array(*gaps)) + 1e-9).alias("nearest")
    )


@query("cluster_centres")
def cluster_centres(t):
    d, cols = cluster_data(t)
    _, assigned = models.kmeans(d, 3)
    return models.cluster_centres(assigned, cols)


@query("pca_project")
def pca_project(t):
    d, _ = cluster_data(t)
    return models.pca_project(d, 2).select("vec_id", "pc1", "pc2")


@query("joint_rules")
def joint_rules(t):
    train, _, names = regression_data(t, scale="none")
    return models.joint_rules(train, names, 3)


@query("leaf_stats", f"SELECT count(*) AS samples, round(avg(y), 4) AS mean_value FROM {DERIVED} WHERE y IS NOT NULL AND {BUCKET} % 10000 >= 2000")
def leaf_stats(t):
    """Over all leaves: their samples, and the mean that their means add up to, are those of the training rows."""
    from pyspark.ml.regression import DecisionTreeRegressor

    train, _, _ = regression_data(t)
    tree = DecisionTreeRegressor(featuresCol="features", labelCol="label", maxDepth=3, leafCol="leaf", seed=models.SEED)
    leaves = models.leaf_stats(tree.fit(train).transform(train))
    return leaves.agg(
        F.sum("samples").alias("samples"), F.round(F.sum(F.col("samples") * F.col("mean_value")) / F.sum("samples"), 4).alias("mean_value")
    )


@query("industrial_effect")
def industrial_effect(t):
    """Derived columns, forest, importances, joint rules and partial dependence in one report."""
    from tabsmith.plans.effect import industrial_effect as report

    d = derived(t).where("y is not null")
    parts = report(
        d, "y", ["l_quantity", "l_discount", "l_tax"], ROW_KEY,
        expressions="net = l_extendedprice * (1 - l_discount)", rule_depth=3,
    )
    return parts["report"]


@query(
    "mars",
    """SELECT 'max(0, l_quantity - 20.000)' AS basis, 'l_quantity > 20.000' AS rule, 2.0::DOUBLE AS coefficient
      UNION ALL SELECT 'max(0, l_discount - 0.000)', 'l_discount > 0.000', 50.0::DOUBLE""",
)
def mars_(t):
    """The fit must find the planted hinges and slopes, and nothing else."""
    d = derived(t).withColumn("bent", F.greatest(F.lit(0.0), F.col("l_quantity") - 20) * 2 + F.col("l_discount") * 50)
    model = mars.fit(d, "bent", ["l_quantity", "l_discount", "l_tax"])
    return mars.basis_table(model, d).withColumn("coefficient", F.round("coefficient", 3))


@query("arima")
def arima_(t):
    params, fitted = arima.fit(t.events, ["event_type"], "value", ORDER, 1, 1, 1, constant=False)
    f = arima.forecast(params, fitted, ["event_type"], 1, 1, 1, 10)
    return f.groupBy("event_type").agg(
        F.array_sort(F.collect_list(F.struct("step", "forecast"))).alias("forecast")
    ).join(params.select("event_type", "aic", "bic"), "event_type").join(arima.metrics(fitted, ["event_type"]), "event_type")
