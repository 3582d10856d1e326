"""Kendall's tau and distance correlation in O(n log n) work, without pairs of rows.

Points are counted per distinct (x, y). Each x gets a dense rank, read as digits in base RADIX.
Two points with different x differ first at one digit, so every pair is met at exactly one level:
there, within one prefix, running sums over y tell what lies below with a smaller digit. The
running sums go through y slices, so no prefix is ever one task, not even the first, which holds
all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.scalars import number
from tabsmith.operators.order_stats import running_before
from tabsmith.operators.slices import SLICE, fit_slicer, join_null_safe
from tabsmith.session import materialize

RADIX = 4


def _points(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.select(number(df, a).alias("x"), number(df, b).alias("y")).where(
        "x is not null and y is not null"
    )
    return both.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("w"))


def _with_dense_x(points: DataFrame) -> tuple[DataFrame, int]:
    """Attach the dense rank of x (from 0); also the number of digits needed."""
    levels = points.select("x").distinct().withColumn("d", F.lit(1))
    slicer = fit_slicer(points, F.col("x"))
    run = running_before(levels, "x", ["d"], [], slicer).select(
        F.col("x").alias("_x"), F.col("d_before").cast("long").alias("rx")
    )
    count = levels.count()
    digits = max(1, math.ceil(math.log(max(count, 2)) / math.log(RADIX) - 1e-12))
    while RADIX**digits < count:
        digits += 1
    return points.join(run, F.col("x") == F.col("_x")).drop("_x"), digits


def below_sums(points: DataFrame, measures: dict[str, Column], combine: dict[str, Column]):
    """Aggregates over all pairs in which x and y are both strictly larger on one side.

    `measures` are summed over the points below (columns `<m>_below`), `combine` aggregates them
    with the upper side's own sums `<m>`.
    """
    ranked, digits = _with_dense_x(points)
    level = F.explode(F.array(*[F.lit(i) for i in range(digits)]))
    # At level i the prefix drops the last i + 1 digits and the digit in question is the i-th.
    spread = ranked.withColumn("_level", level).withColumn("_unit", F.pow(F.lit(RADIX), "_level").cast("long"))
    coded = spread.withColumns(
        {
            "_prefix": F.floor(F.col("rx") / (F.col("_unit") * RADIX)).cast("long"),
            "_digit": (F.floor(F.col("rx") / F.col("_unit")) % RADIX).cast("int"),
        }
    )
    names = list(measures)
    sums = [
        F.sum(F.when(F.col("_digit") == d, m)).alias(f"_{k}_{d}")
        for k, m in measures.items()
        for d in range(RADIX)
    ]
    slicer = fit_slicer(points, F.col("y"))
    cells = slicer.add(coded.groupBy("_level", "_prefix", "y").agg(*sums), F.col("y"))
    cols = [f"_{k}_{d}" for k in names for d in range(RADIX)]
    cells = cells.na.fill(0.0, cols)
    by = ["_level", "_prefix", SLICE]
    w = Window.partitionBy(*by).orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    local = cells.withColumns({f"r{c}": F.coalesce(F.sum(c).over(w), F.lit(0.0)) for c in cols})
    per = cells.groupBy(*by).agg(*[F.sum(c).alias(c) for c in cols])
    wo = Window.partitionBy("_level", "_prefix").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offs = per.select(*by, *[F.coalesce(F.sum(c).over(wo), F.lit(0.0)).alias(f"o{c}") for c in cols])
    joined = join_null_safe(local, offs, by)
    digit_rows = []
    for d in range(1, RADIX):
        fields = [F.col(f"_{k}_{d}").alias(k) for k in names]
        for k in names:
            below = F.lit(0.0)
            for s in range(d):
                below = below + F.col(f"r_{k}_{s}") + F.col(f"o_{k}_{s}")
            fields.append(below.alias(f"{k}_below"))
        digit_rows.append(F.struct(*fields))
    flat = joined.select(F.explode(F.array(*digit_rows)).alias("p")).select("p.*")
    return flat.agg(*[c.alias(k) for k, c in combine.items()])


def corr_kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """Concordant and discordant pairs, tau-b and gamma over complete rows."""
    points = materialize(_points(df, a, b), "points")
    conc = below_sums(points, {"w": F.col("w")}, {"c": F.sum(F.col("w") * F.col("w_below"))})

    def tied(keys: list[str]) -> DataFrame:
        g = points.groupBy(*keys).agg(F.sum("w").alias("k"))
        return g.agg(F.coalesce(F.sum(F.col("k") * (F.col("k") - 1) / 2), F.lit(0.0)))

    t = points.agg(F.sum("w").alias("n")).withColumns(
        {
            "c": F.coalesce(conc.scalar(), F.lit(0.0)),
            "tx": tied(["x"]).scalar(), "ty": tied(["y"]).scalar(), "txy": tied(["x", "y"]).scalar(),
        }
    )
    pairs = F.col("n") * (F.col("n") - 1) / 2
    d = pairs - F.col("tx") - F.col("ty") + F.col("txy") - F.col("c")
    out = t.withColumns({"pairs": pairs, "d": d})
    diff = F.col("c") - F.col("d")
    tau = F.try_divide(diff, F.sqrt(F.col("pairs") - F.col("tx")) * F.sqrt(F.col("pairs") - F.col("ty")))
    gamma = F.try_divide(diff, F.col("c") + F.col("d"))
    return out.select(
        F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("n").cast("long").alias("n"),
        F.col("c").alias("concordant"), F.col("d").alias("discordant"),
        F.coalesce(tau, F.lit(0.0)).alias("tau_b"), F.coalesce(gamma, F.lit(0.0)).alias("gamma"),
    )


def _distance_row_sums(points: DataFrame, v: str, name: str) -> DataFrame:
    """Sum over all points of |v_i - v_j|, joined to each point."""
    levels = points.groupBy(v).agg(F.sum("w").alias("k"), F.sum(F.col("w") * F.col(v)).alias("s"))
    slicer = fit_slicer(points, F.col(v))
    run = running_before(levels, v, ["k", "s"], [], slicer)
    tot = points.agg(F.sum("w").alias("k"), F.sum(F.col("w") * F.col(v)).alias("s"))
    run = run.withColumn("_t", tot.select(F.struct("*")).scalar())
    below = F.col(v) * F.col("k_before") - F.col("s_before")
    above = (F.col("_t.s") - F.col("s_before") - F.col("s")) - F.col(v) * (
        F.col("_t.k") - F.col("k_before") - F.col("k")
    )
    return points.join(
        run.select(F.col(v).alias("_v"), (below + above).alias(name)), F.col(v) == F.col("_v")
    ).drop("_v")


def corr_distance(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distance correlation (and its square) over complete rows.

    Sum |dx||dy| is twice the concordant part of sum dx*dy minus the whole; the concordant part
    comes from the same radix sums. Values are centred first to keep the sums small.
    """
    raw = df.select(number(df, a).alias("x"), number(df, b).alias("y")).where(
        "x is not null and y is not null"
    )
    centre = raw.agg(F.avg("x").alias("x"), F.avg("y").alias("y")).first()
    points = materialize(
        raw.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("w"))
        .select((F.col("x") - F.lit(centre["x"])).alias("x"), (F.col("y") - F.lit(centre["y"])).alias("y"), "w"),
        "points",
    )
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    # (xj - xi)(yj - yi) summed over weighted pairs, from sums of 1, x, y and xy on both sides.
    product = (
        F.col("p") * F.col("w_below") - F.col("u") * F.col("v_below")
        - F.col("v") * F.col("u_below") + F.col("w") * F.col("p_below")
    )
    conc = below_sums(points, {"w": w, "u": w * x, "v": w * y, "p": w * x * y}, {"c": F.sum(product)})
    sums = _distance_row_sums(_distance_row_sums(points, "x", "ax"), "y", "ay")
    s = sums.agg(
        F.sum("w").alias("n"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"),
        F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"), F.sum(w * x * y).alias("sxy"),
        F.sum(w * F.col("ax")).alias("tx"), F.sum(w * F.col("ay")).alias("ty"),
        F.sum(w * F.col("ax") * F.col("ax")).alias("qx"), F.sum(w * F.col("ay") * F.col("ay")).alias("qy"),
        F.sum(w * F.col("ax") * F.col("ay")).alias("qxy"),
    ).withColumn("c", conc.scalar())
    n = F.col("n")
    all_pairs = n * F.col("sxy") - F.col("sx") * F.col("sy")
    sum_xy = 2 * (2 * F.col("c") - all_pairs)
    sum_xx = 2 * (n * F.col("sxx") - F.col("sx") * F.col("sx"))
    sum_yy = 2 * (n * F.col("syy") - F.col("sy") * F.col("sy"))

    def centred(total: Column, q: Column, t1: Column, t2: Column) -> Column:
        return total / (n * n) - 2 * q / (n * n * n) + t1 * t2 / (n * n * n * n)

    cov = centred(sum_xy, F.col("qxy"), F.col("tx"), F.col("ty"))
    vx = centred(sum_xx, F.col("qx"), F.col("tx"), F.col("tx"))
    vy = centred(sum_yy, F.col("qy"), F.col("ty"), F.col("ty"))
    squared = F.when((vx > 0) & (vy > 0), F.greatest(cov / (F.sqrt(vx) * F.sqrt(vy)), F.lit(0.0))).otherwise(0.0)
    return s.select(
        F.lit(a).alias("a"), F.lit(b).alias("b"), n.cast("long").alias("n"),
        F.sqrt(squared).alias("dcor"), squared.alias("dcor_squared"),
    )
