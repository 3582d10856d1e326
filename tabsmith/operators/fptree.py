"""Frequent itemsets by FP-trees over conditional projections.

Items are ranked by frequency and dealt to groups. Each basket sends a group the part of itself up to
the group's last item, equal parts are summed, and a task builds one prefix tree of them and mines the
group's items. A group with more cells than a task should hold is projected further by Spark: first on
its single items, then on pairs and so on, each time without the items that are no longer frequent
there, until every piece fits. Results do not depend on the groups or on that bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.session import materialize

#: Cells (items of distinct paths) that one task mines in memory.
CELLS = 2_000_000
#: What mining returns.
FOUND = "items array<string>, n long"


def mine(paths: list[tuple[list[int], int]], least: int, owned=None) -> Iterator[tuple[tuple[int, ...], int]]:
    """Frequent itemsets of weighted paths (ranks, ascending), those whose highest rank `owned` accepts.

    One prefix tree at a time: the nodes of an item give its count, their ways to the root give the
    paths of the next, smaller tree, without the items that are too rare beside it.
    """
    todo = [((), paths)]
    while todo:
        suffix, rows = todo.pop()
        item, parent, weight = [-1], [-1], [0]
        child: dict[tuple[int, int], int] = {}
        nodes: dict[int, list[int]] = {}
        for path, n in rows:
            at = 0
            for x in path:
                to = child.get((at, x))
                if to is None:
                    to = child[at, x] = len(item)
                    item.append(x)
                    parent.append(at)
                    weight.append(0)
                    nodes.setdefault(x, []).append(to)
                weight[to] += n
                at = to
        for x, places in nodes.items():
            if not suffix and owned is not None and not owned(x):
                continue
            n = sum(weight[p] for p in places)
            if n < least:
                continue
            yield (*suffix, x), n
            beside: dict[int, int] = {}
            ways = []
            for p in places:
                way, up = [], parent[p]
                while up:
                    way.append(item[up])
                    beside[item[up]] = beside.get(item[up], 0) + weight[p]
                    up = parent[up]
                ways.append((way, weight[p]))
            kept = {y for y, m in beside.items() if m >= least}
            if kept:
                todo.append(((*suffix, x), [([y for y in reversed(way) if y in kept], m) for way, m in ways]))


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "path").agg(F.sum("c").alias("c"))


def _sized(rows: DataFrame, cells: int, *keys: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the keys that fit a task, and of those that do not."""
    large = rows.groupBy(*keys).agg(F.sum(F.size("path") + 1).alias("_cells")).where(F.col("_cells") > cells).drop("_cells")
    large = materialize(large, "large")
    if large.isEmpty():
        return rows, None
    return rows.join(large, list(keys), "left_anti"), rows.join(large, list(keys), "left_semi")


def _before(path: Column, at: Column) -> Column:
    """The items of a path before a position counted from 0."""
    return F.slice(path, F.lit(1), at)


def frequent_itemsets(counted: DataFrame, min_support: float = 0.05, groups: int | None = None, cells: int = CELLS) -> DataFrame:
    """Itemsets in at least `min_support` of the rows, as sorted arrays with their row counts.

    `counted` has arrays `items` with row counts `c`; NULL items and repeats within a basket do not
    count, an empty table gives no sets. Only the names of frequent items reach the driver: at most
    the mean basket length divided by the support.
    """
    total = counted.agg(F.sum("c")).first()[0]
    least = max(1, math.ceil(min_support * (total or 0) - 1e-9))
    bare = counted.select(F.array_distinct("items").alias("items"), "c")
    single = bare.select(F.explode("items").alias("item"), "c").dropna().groupBy("item").agg(F.sum("c").alias("n"))
    names = [r[0] for r in single.where(F.col("n") >= least).orderBy(F.desc("n"), "item").collect()]
    if not names:
        return counted.limit(0).select(F.col("items").cast("array<string>").alias("items"), F.col("c").cast("long").alias("n"))
    groups = max(1, min(len(names), groups or int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ranks = F.transform("items", lambda i: F.array_position(F.lit(names), i).cast("int") - 1)
    ranked = _summed(bare.select(F.array_sort(F.filter(ranks, lambda r: r >= 0)).alias("path"), "c"))

    # A basket goes to each group once, up to the last of the group's items in it.
    dealt = F.transform("path", lambda r: r % groups)
    spots = ranked.select("path", "c", dealt.alias("_dealt"), F.posexplode(dealt).alias("_at", "grp"))
    last = F.array_position(F.reverse("_dealt"), F.col("grp")) == F.size("path") - F.col("_at")
    parts = spots.where(last).select("grp", _before(F.col("path"), F.col("_at") + 1).alias("path"), "c")
    parts = materialize(_summed(parts, "grp"), "projections")
    small, large = _sized(parts, cells, "grp")

    def named(found) -> pd.DataFrame:
        rows = [(sorted(names[x] for x in ranks), n) for ranks, n in found]
        return pd.DataFrame({"items": [r[0] for r in rows], "n": pd.Series([r[1] for r in rows], dtype="int64")})

    def of_group(part: pd.DataFrame) -> pd.DataFrame:
        grp = int(part["grp"].iloc[0])
        paths = [(list(p), int(c)) for p, c in zip(part["path"], part["c"])]
        return named(mine(paths, least, lambda x: x % groups == grp))

    def of_suffix(part: pd.DataFrame) -> pd.DataFrame:
        suffix = tuple(part["suffix"].iloc[0])
        paths = [(list(p), int(c)) for p, c in zip(part["path"], part["c"])]
        return named(((*suffix, *ranks), n) for ranks, n in mine(paths, least))

    out = small.groupBy("grp").applyInPandas(of_group, FOUND)
    if large is not None:
        own = large.select("grp", "path", "c", F.posexplode("path").alias("_at", "_item")).where(F.col("_item") % groups == F.col("grp"))
        pieces = own.select(F.array("_item").alias("suffix"), _before(F.col("path"), F.col("_at")).alias("path"), "c")
        while True:
            pieces = materialize(_summed(pieces, "suffix"), "projections")
            sets = pieces.groupBy("suffix").agg(F.sum("c").alias("n")).where(F.col("n") >= least)
            label = F.array_sort(F.transform("suffix", lambda x: F.get(F.lit(names), x)))
            out = out.unionByName(sets.select(label.alias("items"), "n"))
            beside = pieces.select("suffix", F.explode("path").alias("_item"), "c").groupBy("suffix", "_item").agg(F.sum("c").alias("n"))
            kept = beside.where(F.col("n") >= least).groupBy("suffix").agg(F.collect_set("_item").alias("_kept"))  # at most one entry a frequent item
            rest = pieces.join(kept, "suffix").select("suffix", F.array_intersect("path", "_kept").alias("path"), "c")
            rest = materialize(_summed(rest.where(F.size("path") > 0), "suffix"), "projections")
            small, large = _sized(rest, cells, "suffix")
            out = out.unionByName(small.groupBy("suffix").applyInPandas(of_suffix, FOUND))
            if large is None:
                break
            spread = large.select("suffix", "path", "c", F.posexplode("path").alias("_at", "_item"))
            longer = F.concat("suffix", F.array("_item"))
            pieces = spread.select(longer.alias("suffix"), _before(F.col("path"), F.col("_at")).alias("path"), "c")
    return materialize(out, "itemsets")
