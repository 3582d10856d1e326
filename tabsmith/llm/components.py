"""Connected components of a link table, by alternating large and small stars.

Every step is a grouped minimum (map-side partial sums) and a join; no node's neighbours are ever
gathered in one place, so a node that a third of all links touch is no special case. Each step is
written to the shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.session import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Tie neighbours to the least node of the neighbourhood: the larger ones, or the smaller and the node itself."""
    if large:
        around = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    met = around.join(least, "a")
    if large:
        moved = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.filter("a <> m").select("a", F.col("m").alias("b"))
        )
    return moved.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) to (node, root): the least node of each component; roots are listed too.

    Links with a NULL end and self-links are ignored; no links give an empty result. Repeated links
    and either direction are allowed.
    """
    now = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        now = materialize(_star(_star(now, True), False), "stars")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
