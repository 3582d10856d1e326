"""Exact top-k inner products by a dual-tree search over cover trees.

Queries and data share one index. A cover tree over a bounded sample gives the groups; every row joins
the group of its nearest centre, and each group's covering radius is measured over all its rows. A
group is cut into blocks of bounded size, so a group of copies never meets in one task. Each query first
searches one block of its own group, which gives its group a worst k-th score. Pairs of groups whose
bound (centres' product plus what the radii can add) lies below that score are pruned; what survives is
searched block by block, with cover trees over both sides and the same bound on pairs of nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabsmith.llm.common import column
from tabsmith.session import materialize

#: Rows the groups are fitted on, rows of a group before it is cut, children of a node.
SAMPLE = 4096
GROUP = 512
CHILDREN = 12
#: Rows of a data block, and queries that search one together.
BLOCK = 4096
QUERIES = 4096
LEAF = 512
QUERY_LEAF = 64


@dataclass
class Node:
    """A centre, the covering radius of all rows below it, and either children or rows."""

    center: np.ndarray
    radius: float
    rows: np.ndarray
    children: list[Node]


def build(points: np.ndarray, leaf: int = LEAF, rows: np.ndarray | None = None) -> Node:
    """Cover tree: centres are points, each child's centre is farther from its siblings than any
    point of theirs is from its own, and radii are those of the points really below.

    Children come by farthest-first choice, the parent's centre first, until the radius has halved or
    there are enough of them. Equal points end in one leaf of any size with radius 0.
    """
    rows = np.arange(len(points)) if rows is None else rows
    center = points[rows[0]] if len(rows) else np.zeros(points.shape[1])
    near = _far(points[rows], center)
    node = Node(center, float(near.max(initial=0.0)), rows, [])
    if len(rows) <= leaf or node.radius == 0:
        return node
    owner = np.zeros(len(rows), np.int64)
    for k in range(1, CHILDREN):
        at = int(near.argmax())
        if near[at] <= node.radius / 2 and k > 1 or near[at] == 0:
            break
        new = _far(points[rows], points[rows[at]])
        owner = np.where(new < near, k, owner)
        near = np.minimum(near, new)
        owner[at] = k
    for k in range(int(owner.max()) + 1):
        own = rows[owner == k]
        if len(own):
            first = near[owner == k].argmin()
            own[[0, first]] = own[[first, 0]]
            node.children.append(build(points, leaf, own))
    return node


def _far(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, ((points - center) ** 2).sum(axis=1)))


def leaves(node: Node) -> list[Node]:
    return [x for c in node.children for x in leaves(c)] if node.children else [node]


def bound(a: np.ndarray, ra, b: np.ndarray, rb) -> np.ndarray:
    """No product of a row within ra of a and one within rb of b is above this (with slack for rounding)."""
    na, nb = np.sqrt((a * a).sum(-1)), np.sqrt((b * b).sum(-1))
    top = (a * b).sum(-1) + ra * nb + rb * na + ra * rb
    return top + 1e-9 * (na + ra) * (nb + rb) + 1e-6


class Best:
    """The k highest (score, least id) of each query, and the worst of them."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self.score = np.full((len(query_ids), k), -np.inf)
        self.ids = np.full((len(query_ids), k), np.iinfo(np.int64).max)

    def worst(self, rows: np.ndarray) -> float:
        return float(self.score[rows, -1].min())

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, floor: np.ndarray) -> None:
        """Take in the scores of these query rows; below `floor` none is looked at."""
        least = np.maximum(np.maximum(self.score[rows, -1], floor), np.finfo(float).min)
        good = (scores >= least[:, None]) & (self.query_ids[rows][:, None] != ids[None, :])
        for i in np.flatnonzero(good.any(axis=1)):
            row, at = rows[i], np.flatnonzero(good[i])
            s, d = np.concatenate([self.score[row], scores[i, at]]), np.concatenate([self.ids[row], ids[at]])
            top = np.lexsort((d, -s))[: self.k]
            self.score[row], self.ids[row] = s[top], d[top]


def search(queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int) -> Best:
    """Top k of each query among the data (its own id aside); only scores of at least `floor` are sure to be found."""
    best = Best(query_ids, k)
    if not len(queries) or not len(data):
        return best
    worst = lambda rows: max(best.worst(rows), float(floor[rows].min()))
    stack = [(build(queries, QUERY_LEAF), build(data))]
    while stack:
        q, d = stack.pop()
        if float(bound(q.center, q.radius, d.center, d.radius)) < worst(q.rows):
            continue
        if not q.children and not d.children:
            best.offer(q.rows, _products(queries[q.rows], data[d.rows]), data_ids[d.rows], floor[q.rows])
            continue
        split = bool(q.children) and (not d.children or q.radius > d.radius)
        pairs = [(c, d) for c in q.children] if split else [(q, c) for c in d.children]
        tops = [float(bound(a.center, a.radius, b.center, b.radius)) for a, b in pairs]
        stack.extend(pairs[i] for i in np.argsort(tops, kind="stable"))  # the most promising is taken first
    return best


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of whole numbers; beyond what doubles hold exactly, by Python's whole numbers, held within a long."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return a @ b.T
    exact = a.astype(np.int64).astype(object) @ b.astype(np.int64).astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(float)


def quantised(vector: Column) -> Column:
    """floor(256 x) of every component as double; NULL for a vector that is NULL or holds NULL, NaN or infinity."""
    bad = F.exists(vector, lambda x: F.coalesce(F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")), F.lit(True)))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("double"))
    return F.when(~bad, whole)


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled with zeros to the width."""
    out = np.zeros((len(col), width))
    flat = col.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(col.offsets.to_numpy())
    row = np.repeat(np.arange(len(col)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = flat
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each query (rows where `is_query`, given over vec_id, holds): its k highest integer inner products.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id; a query's own id is
    no candidate; fewer candidates give fewer rows. Rows without an id, and vectors that are NULL or
    hold NULL or non-finite components, take no part. Of rows that share an id, the least vector stands
    for all; shorter vectors count as filled with zeros. No query or no data give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(column(vectors, vec_id).cast("long").alias("vec_id"), quantised(column(vectors, vector)).alias("v")).dropna()
    rows = materialize(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    width = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()  # at most SAMPLE rows
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    points = _matrix(sample.column(0).combine_chunks(), width)
    centers = np.array([x.center for x in leaves(build(points, GROUP))])  # at most as many as the sample has rows

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = (centers * centers).sum(axis=1)
        for b in batches:
            x = _matrix(b.column(1), width)
            group = (square - 2 * x @ centers.T).argmin(axis=1)
            far = np.sqrt(((x - centers[group]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(group), pa.array(far)], names=["vec_id", "v", "grp", "far"])

    placed = rows.mapInArrow(assign, "vec_id long, v binary, grp long, far double").withColumn("is_query", is_query)
    placed = materialize(placed, "placed")
    facts = placed.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"), F.max(F.when(F.col("is_query"), F.col("far"))).alias("reach"), F.count_if("is_query").alias("queries")
    )
    facts = {r["grp"]: r for r in facts.collect()}  # one row a group
    blocks = {g: -(-r["n"] // BLOCK) for g, r in facts.items()}
    parts = max(1, -(-sum(r["queries"] for r in facts.values()) // QUERIES))
    sizes = spark.createDataFrame([(int(g), int(n)) for g, n in blocks.items()], "grp long, blocks long")
    mixed = F.xxhash64("vec_id")
    data = placed.join(F.broadcast(sizes), "grp").withColumn("block", F.pmod(mixed, "blocks"))
    asks = data.filter("is_query").withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "vec_id"), F.lit(parts)))
    data = data.select("grp", "block", "vec_id", "v")

    def dual(key, left: pa.Table, right: pa.Table) -> pa.Table:
        load = lambda col: np.frombuffer(b"".join(col.to_pylist()), float).reshape(len(col), width)
        ids = left.column("q_vec_id").to_numpy()
        data_ids = right.column("vec_id").to_numpy()
        best = search(load(left.column("q_v")), ids, left.column("q_floor").to_numpy(), load(right.column("v")), data_ids, k)
        at = np.isfinite(best.score)
        return pa.table({"query_id": np.repeat(ids, at.sum(axis=1)), "vec_id": best.ids[at], "score": best.score[at].astype(np.int64)})

    out = "query_id long, vec_id long, score long"
    keys = ["grp", "block", "part"]
    spread = data.withColumn("part", F.explode(F.array(*[F.lit(i).cast("long") for i in range(parts)]))) if parts < 64 else data.withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    )
    asked = lambda df: df.select(*[F.col(c).alias(f"q_{c}") for c in (*keys, "vec_id", "v", "floor")]).groupBy(*[f"q_{c}" for c in keys])
    home = asks.withColumn("floor", F.lit(float("-inf")))
    needed = spread.join(home.select(*keys).distinct(), keys, "left_semi")
    first = asked(home).cogroup(needed.groupBy(*keys)).applyInArrow(dual, out)
    first = materialize(first, "first")
    kth = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    floor = F.when(F.col("n") >= k, F.col("least").cast("double")).otherwise(float("-inf"))
    asks = asks.join(kth.select(F.col("query_id").alias("vec_id"), floor.alias("floor")), "vec_id", "left").fillna(float("-inf"), ["floor"])
    asks = materialize(asks.select("grp", F.col("block").alias("own_block"), "part", "vec_id", "v", "floor"), "asks")
    worst = {r[0]: r[1] for r in asks.groupBy("grp").agg(F.min("floor")).collect()}  # one row a group

    pairs = []
    groups = sorted(facts)
    for g in sorted(worst):
        others = centers[groups]
        tops = bound(centers[g][None, :], facts[g]["reach"] or 0.0, others, np.array([facts[h]["radius"] for h in groups]))
        pairs += [(g, h, blocks[h]) for h, top in zip(groups, tops) if top >= worst[g]]
    pairs = spark.createDataFrame([(int(a), int(b), int(n)) for a, b, n in pairs], "own long, grp long, blocks long")
    sent = (
        asks.withColumnRenamed("grp", "own")
        .join(F.broadcast(pairs), "own")
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .filter((F.col("own") != F.col("grp")) | (F.col("block") != F.col("own_block")))
    )
    second = asked(sent).cogroup(spread.groupBy(*keys)).applyInArrow(dual, out)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        first.unionByName(second)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
