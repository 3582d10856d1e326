"""Gradient boosting of regression trees on binned features, depth-wise or leaf-wise.

Features are cut once at quantiles and stored as one byte a cell, in blocks of rows with the gradient so
far; each finished tree moves the gradients once, into cached blocks that the next tree reads. Rows of equal bins
that are many become one cell, with the sums of the rows that each tree draws. A pass adds
up, for the nodes it is asked for, gradients and counts by (feature, bin): tasks return fixed-size
histograms and Spark sums them. Of two children only the smaller is read, the other is its parent minus the
sibling. Missing values have a bin of their own, and each split learns to which side they go.

Leaf-wise growth takes the leaf of largest gain first. That order is replayed on the driver over the nodes
known so far; leaves it needs whose children are unknown are all read in the next pass. The tree is that
of one split at a time, with about as many passes as the tree is deep.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.operators.features import FEATURES
from tabsmith.operators.trees import Ensemble, Tree
from tabsmith.session import materialize

MISSING, BINS = 255, 254
#: Trees after which gradients are stored anew, rows of a block, and parts whose histograms the driver adds itself.
STORE_TREES, BLOCK_ROWS, FEW_PARTS = 20, 50_000, 64
#: Rows that a task holds to see whether they collapse to cells, and bytes of the sums by cell that it keeps.
GATHER_ROWS, HELD = 1 << 21, 1 << 27
#: Columns whose quantiles one aggregate finds, and their precision.
CUT_COLUMNS, ACCURACY = 100, 20_000
#: Gains closer than this share count as equal: the first candidate wins, whatever the order of sums.
TIE = 1e-9


@dataclass
class Settings:
    """`leaves` or `depth` bounds a tree (None: no bound). `l2` is added to the hessian, `least_gain` is what a split
    must gain, `least_rows` what a child must hold. Shares of rows and features are drawn for each tree."""

    rounds: int = 100
    rate: float = 0.1
    depth: int | None = 6
    leaves: int | None = None
    l2: float = 1.0
    least_gain: float = 0.0
    least_rows: int = 1
    rows: float = 1.0
    features: float = 1.0
    bins: int = BINS
    seed: int = 42


def xgb(rounds: int = 100, rate: float = 0.1, depth: int = 6, rows: float = 0.8, **more) -> Settings:
    """Second-order gains with a penalty on leaf weights, grown level by level."""
    return Settings(rounds, rate, depth, None, rows=rows, **more)


def lgbm(rounds: int = 120, rate: float = 0.05, leaves: int = 31, features: float = 0.8, least_rows: int = 20, **more) -> Settings:
    """Best leaf first, without a penalty."""
    return Settings(rounds, rate, None, leaves, **({"l2": 0.0} | more), features=features, least_rows=least_rows)


@dataclass
class Split:
    gain: float
    feature: int
    cut: int
    missing_left: bool
    left: tuple[float, float]
    right: tuple[float, float]


@dataclass
class Node:
    """sums: gradient and count; histogram: features x 256 x 2, if it is known."""

    sums: tuple[float, float]
    depth: int
    histogram: np.ndarray | None = None
    best: Split | None = None
    children: tuple[int, int] | None = None


def feature_cuts(df: DataFrame, features: str = FEATURES, bins: int = BINS) -> list[list[float]]:
    """Ascending cut points of each feature: its quantiles and its largest value, which parts the present
    from the missing. With fewer than `bins` different values, each common one is a cut."""
    x = df.select(vector_to_array(features).alias("x"))
    width = x.agg(F.max(F.size("x"))).first()[0] or 0
    # one text for the shares: a long list of literals is slow to build; the largest value makes the last cut
    shares, out = ", ".join(str(i / bins) for i in range(1, bins)), []
    for start in range(0, width, CUT_COLUMNS):
        some = range(start, min(start + CUT_COLUMNS, width))
        cells = x.select(*[F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]).alias(f"c{i}") for i in some])
        found = cells.agg(*[F.expr(f"struct(percentile_approx(c{i}, array({shares}), {ACCURACY}), max(c{i}))") for i in some]).first()
        out += [sorted({*(at or []), top} - {None}) for at, top in found]
    return out


def _blocks(df: DataFrame, cuts: list[list[float]], features: str, label: str, key: list[str], seed: int, base: float) -> DataFrame:
    """Blocks of rows as bytes: n, bins (one a cell, feature by feature), g (the gradient) and id (eight a row)."""
    edges, width = [np.array(c) for c in cuts], len(cuts)
    of = [F.col(k) for k in key] if key else [vector_to_array(features), F.col(label)]
    rows = df.where(F.col(label).isNotNull()).select(
        vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), F.xxhash64(F.lit(seed), *of).alias("id")
    )

    def block(parts: list) -> pa.RecordBatch:
        bins, g, ids = (np.concatenate(c, axis=-1) for c in zip(*parts))
        cells = [np.ascontiguousarray(bins), g, ids]
        return pa.RecordBatch.from_arrays([pa.array([len(g)], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in cells]], ["n", "bins", "g", "id"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(i, BLOCK_ROWS)
                n = part.num_rows
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, width)
                bins = np.empty((width, n), np.uint8)
                for j, e in enumerate(edges):
                    bins[j] = np.where(np.isnan(x[:, j]), MISSING, np.searchsorted(e, x[:, j], side="left"))
                parts.append((bins, base - part.column(1).to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False)))
                held += n
                if held >= BLOCK_ROWS:
                    yield block(parts)
                    parts, held = [], 0
        if held:
            yield block(parts)

    return rows.mapInArrow(pack, "n int, bins binary, g binary, id binary")


def _unpack(batch: pa.RecordBatch, width: int):
    """bins, g, id and drawn of each block; cells have no id, rows nothing drawn (see `_collapsed`)."""
    for n, bins, g, ids, sums in zip(*batch.columns):
        bins = np.frombuffer(bins.as_buffer(), np.uint8).reshape(width, n.as_py())
        yield bins, np.frombuffer(g.as_buffer()), np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(sums.as_buffer()).reshape(2, -1, n.as_py())


def _collapsed(blocks: DataFrame, sizes: list[int], s: Settings) -> DataFrame:
    """Blocks with a column `drawn`: where many rows of a task have equal bins, they are replaced by cells. A cell's g is
    what the trees have moved its rows by; for each tree to come, `drawn` has the number of its rows that the tree
    reads, and the sum of their first gradients. Where this would take more room than the rows, they stay."""
    width = len(sizes)
    fits = np.prod([k + 2.0 for k in sizes]) < 2**62

    def record(n: int, bins: bytes, g: bytes, ids: bytes, sums: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *[pa.array([c], pa.binary()) for c in (bins, g, ids, sums)]], ["n", "bins", "g", "id", "drawn"])

    def cells(bins: np.ndarray, g: np.ndarray, ids: np.ndarray):
        """Codes, bins and sums (2 x trees x cells) of the cells of rows; None if there are too many."""
        code = np.zeros(len(g), np.int64)
        for k, b in zip(sizes, bins):
            code = code * (k + 2) + np.where(b == MISSING, k + 1, b)
        codes, first, of = np.unique(code, return_index=True, return_inverse=True)
        if len(codes) * s.rounds > len(g):
            return None
        sums = np.empty((2, s.rounds, len(codes)))
        for tree in range(s.rounds):
            drew = drawn(ids, s.seed, tree, s.rows)
            sums[0, tree] = np.bincount(of[drew], minlength=len(codes))
            sums[1, tree] = np.bincount(of[drew], g[drew], len(codes))
        return codes, bins[:, first], sums

    def joined(one, two):
        codes, first, of = np.unique(np.concatenate([one[0], two[0]]), return_index=True, return_inverse=True)
        sums = np.zeros((2, s.rounds, len(codes)))
        sums[:, :, of[: len(one[0])]] += one[2]
        sums[:, :, of[len(one[0]) :]] += two[2]
        return codes, np.concatenate([one[1], two[1]], axis=1)[:, first], sums

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held, n = None, [], 0

        def settle():
            nonlocal kept, held, n
            parts = [(np.frombuffer(b, np.uint8).reshape(width, k), np.frombuffer(g), np.frombuffer(i, np.int64)) for k, b, g, i in held]
            found = cells(*(np.concatenate(c, axis=-1) for c in zip(*parts))) if fits and s.rounds and width else None
            if found is None:
                yield from (record(*h, b"") for h in held)
            else:
                kept = found if kept is None else joined(kept, found)
                if kept[2].nbytes > HELD:
                    yield stored()
            held, n = [], 0

        def stored() -> pa.RecordBatch:
            nonlocal kept
            codes, bins, sums = kept
            kept = None
            return record(len(codes), np.ascontiguousarray(bins).tobytes(), np.zeros(len(codes)).tobytes(), b"", sums.tobytes())

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                n += row[0]
                if n >= GATHER_ROWS:
                    yield from settle()
        if held:
            yield from settle()
        if kept is not None:
            yield stored()

    return blocks.mapInArrow(collapse, "n int, bins binary, g binary, id binary, drawn binary")


def _rows_of(tree: Tree, cut: list[int], bins: np.ndarray, wanted: list[int], rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(node, its rows) for the wanted nodes; only their branches are followed."""
    asked, needed = set(wanted), set(wanted)
    for i in reversed(range(len(tree.left))):  # children come after their parent
        if tree.left[i] >= 0 and (tree.left[i] in needed or tree.right[i] in needed):
            needed.add(i)
    stack = [(0, rows)] if 0 in needed else []
    while stack:
        i, rows = stack.pop()
        if i in asked:
            yield i, rows
        if tree.left[i] < 0:
            continue
        left, right = tree.left[i] in needed, tree.right[i] in needed
        if left or right:
            b = bins[tree.feature[i]][rows]
            goes = (b <= cut[i]) | (b == MISSING) if tree.missing_left[i] else b <= cut[i]
            if left:
                stack.append((tree.left[i], rows[goes]))
            if right:
                stack.append((tree.right[i], rows[~goes]))


def mixed(ids: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each id and the salt (splitmix64)."""
    z = ids.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def drawn(ids: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """Rows that a tree reads: a share of all, by a hash of the row and the tree."""
    return mixed(ids, seed * 1_000_003 + tree) >= np.uint64(int((1 - share) * 2**64)) if share < 1 else np.ones(len(ids), bool)


def best_split(histogram: np.ndarray, sums: tuple[float, float], cuts: list[int], chosen: list[int], s: Settings) -> Split | None:
    """The split of largest gain over the chosen features, all cuts and both sides for the missing."""
    g, n = sums
    best = None
    for f in chosen:
        k = cuts[f]
        if not k:
            continue
        running = np.cumsum(histogram[f, :k], axis=0)
        lost = histogram[f, MISSING]
        for missing_left in (True, False) if lost[1] else (False,):
            left = running + lost if missing_left else running
            gl, nl = left[:, 0], left[:, 1]
            gr, nr = g - gl, n - nl
            able = (nl >= s.least_rows) & (nr >= s.least_rows) & (nl > 0.5) & (nr > 0.5)
            if not able.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = gl**2 / (nl + s.l2) + gr**2 / (nr + s.l2) - g * g / (n + s.l2)
            gain = np.where(able, gain / 2, -np.inf)
            top = gain.max()
            i = int(np.argmax(gain >= top - TIE * abs(top)))
            if gain[i] > s.least_gain + 1e-12 and (best is None or gain[i] > best.gain + TIE * abs(best.gain)):
                best = Split(float(gain[i]), f, i, missing_left, (float(gl[i]), float(nl[i])), (float(gr[i]), float(nr[i])))
    return best


class _Grower:
    """One tree: nodes known so far, and what to read next. The rows are behind `read`, which sums histograms
    of nodes of a partial tree."""

    def __init__(self, read, cuts: list[list[float]], chosen: list[int], settings: Settings):
        self.read, self.cuts, self.chosen, self.s = read, [len(c) for c in cuts], chosen, settings
        self.tree, self.cut_of, self.nodes = Tree(), [], {}
        self._new((0.0, 0.0), 0)
        self._learn([0])
        h = self.nodes[0].histogram
        self.nodes[0].sums = tuple(h[chosen[0]].sum(axis=0).tolist()) if chosen else (0.0, 0.0)
        self._judge(0)

    def _new(self, sums, depth: int) -> int:
        self.cut_of.append(0)
        i = self.tree.add(0.0, sums[1])
        self.nodes[i] = Node(sums, depth)
        return i

    def _learn(self, wanted: list[int]) -> None:
        for i, h in zip(wanted, self.read(self.tree, self.cut_of, wanted)):
            self.nodes[i].histogram = h

    def _judge(self, i: int) -> None:
        node = self.nodes[i]
        if self.s.depth is None or node.depth < self.s.depth:
            node.best = best_split(node.histogram, node.sums, self.cuts, self.chosen, self.s)

    def _expand(self, open_: list[int]) -> None:
        """Split the nodes and learn what their children hold: one pass for all."""
        wanted = []
        for i in open_:
            node, b = self.nodes[i], self.nodes[i].best
            node.children = tuple(self._new(sums, node.depth + 1) for sums in (b.left, b.right))
            self.tree.split(i, b.feature, 0.0, b.missing_left, *node.children)
            self.cut_of[i] = b.cut
            if self.s.depth is None or node.depth + 1 < self.s.depth:
                left, right = (self.nodes[c] for c in node.children)
                wanted.append((i, node.children[0] if left.sums[1] <= right.sums[1] else node.children[1]))
        if not wanted:
            return
        self._learn([small for _, small in wanted])
        for i, small in wanted:
            node = self.nodes[i]
            other = sum(node.children) - small
            self.nodes[other].histogram = node.histogram - self.nodes[small].histogram
            for c in node.children:
                self._judge(c)
            node.histogram = None

    def _replay(self) -> tuple[list[int], list[int]]:
        """Best leaf first over the known nodes: the nodes split, and those whose children must be known to go on."""
        split, unknown = [], []
        heap = [(-self.nodes[0].best.gain, 0)] if self.nodes[0].best else []
        while heap and (self.s.leaves is None or len(split) + 1 < self.s.leaves):
            _, i = heapq.heappop(heap)
            split.append(i)
            if self.nodes[i].children is None:
                unknown.append(i)
                continue
            for c in self.nodes[i].children:
                if self.nodes[c].best:
                    heapq.heappush(heap, (-self.nodes[c].best.gain, c))
        return split, unknown

    def grow(self, cuts: list[list[float]]) -> tuple[Tree, list[int]]:
        while True:
            split, unknown = self._replay()
            if not unknown:
                break
            self._expand(unknown)
        out, out_cuts, at = Tree(), [], {}
        stack, keep = [0], set(split)
        for i in stack:  # grows as it goes
            node = self.nodes[i]
            g, n = node.sums
            at[i] = out.add(-g / (n + self.s.l2) if n else 0.0, n)
            out_cuts.append(0)
            if i in keep:
                stack += node.children
        for i in keep:
            b, (left, right) = self.nodes[i].best, self.nodes[i].children
            out.split(at[i], b.feature, cuts[b.feature][b.cut], b.missing_left, at[left], at[right])
            out_cuts[at[i]] = b.cut
        return out, out_cuts


def fit(df: DataFrame, settings: Settings, key: list[str] = (), features: str = FEATURES, label: str = "label") -> Ensemble:
    """Boost squared error from the mean label. `key` names the columns that identify a row (all by default):
    with them, drawing rows does not depend on the layout. Rows without a label are left out; a table
    without rows gives the constant NULL (not a number)."""
    s = settings
    cuts = feature_cuts(df, features, min(s.bins, BINS))
    width, base = len(cuts), df.agg(F.avg(F.col(label).cast("double"))).first()[0]
    if base is None:
        return Ensemble([], s.rate, float("nan"), width)
    # the passes are many and the same: an equal share of the blocks for each core
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows = _blocks(df, cuts, features, label, list(key), s.seed, base).repartition(cores)
    blocks = materialize(_collapsed(rows, [len(c) for c in cuts], s), "binned").coalesce(cores).persist()
    few = blocks.rdd.getNumPartitions() <= FEW_PARTS
    random = np.random.default_rng(s.seed)
    trees: list[Tree] = []
    stale: list[DataFrame] = []
    sizes = [len(c) for c in cuts]

    for number in range(s.rounds):
        chosen = sorted(random.permutation(width)[: max(1, round(s.features * width))].tolist()) if width else []
        # the bins of the chosen features one after the other, each with its missing last
        starts = np.cumsum([0, *[sizes[f] + 1 for f in chosen]]).tolist()

        def read(tree: Tree, cut: list[int], wanted: list[int], number=number, blocks=blocks, chosen=chosen, starts=starts):
            place = {i: k for k, i in enumerate(wanted)}

            def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros((len(wanted), starts[-1], 2))
                for batch in batches:
                    for bins, g, ids, cells in _unpack(batch, width):
                        if cells.size:
                            count, g = cells[0, number], cells[1, number] + cells[0, number] * g
                            drew = np.flatnonzero(count).astype(np.int32)
                        else:
                            count = None
                            drew = np.flatnonzero(drawn(ids, s.seed, number, s.rows)).astype(np.int32)
                        for i, rows in _rows_of(tree, cut, bins, wanted, drew):
                            own, times = g[rows], None if count is None else count[rows]
                            for f, at in zip(chosen, starts):
                                b, k = bins[f][rows], sizes[f]
                                for side, found in ((0, np.bincount(b, own, 256)), (1, np.bincount(b, times, 256))):
                                    total[place[i], at : at + k, side] += found[:k]
                                    total[place[i], at + k, side] += found[MISSING]
                chunks = total.reshape(len(wanted), -1)
                cells = pa.array([c.tobytes() for c in chunks], pa.binary()) if few else pa.array(chunks.tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(range(len(wanted)), pa.int32()), cells], ["node", "sums"])

            parts = blocks.mapInArrow(sums, f"node int, sums {'binary' if few else 'array<double>'}")
            if not few:  # one row a node and position: summed before they reach the driver
                cells = parts.select("node", F.posexplode("sums").alias("i", "v")).groupBy("node", "i").agg(F.sum("v").alias("v"))
                parts = cells.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("sums"))
            found = np.zeros((len(wanted), starts[-1], 2))
            for r in parts.collect():
                found[r["node"]] += (np.frombuffer(r["sums"]) if few else np.array(r["sums"])).reshape(starts[-1], 2)
            out = np.zeros((len(wanted), width, 256, 2))
            for f, at in zip(chosen, starts):
                out[:, f, : sizes[f]], out[:, f, MISSING] = found[:, at : at + sizes[f]], found[:, at + sizes[f]]
            return out

        tree, cut = _Grower(read, cuts, chosen, s).grow(cuts)
        while stale:  # the root's pass has filled the cache of the present blocks
            stale.pop().unpersist()
        trees.append(tree)
        if len(tree.value) == 1 and s.rows >= 1 and s.features >= 1:
            break  # nothing is left to gain, and the next round would see the same
        if number + 1 == s.rounds:
            break

        def move(batches: Iterator[pa.RecordBatch], tree=tree, cut=cut) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                moved = []
                for bins, g, _, _ in _unpack(batch, width):
                    g = g.copy()
                    for i, rows in _rows_of(tree, cut, bins, tree.leaves(), np.arange(len(g), dtype=np.int32)):
                        g[rows] += s.rate * tree.value[i]
                    moved.append(g.tobytes())
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(moved, pa.binary()), *batch.columns[3:]], batch.schema.names)

        stale.append(blocks)
        blocks = blocks.mapInArrow(move, blocks.schema)
        if (number + 1) % STORE_TREES == 0:
            blocks = materialize(blocks, "boosted").coalesce(cores)
        blocks = blocks.persist()
    for b in (*stale, blocks):
        b.unpersist()
    return Ensemble(trees, s.rate, float(base), width)


def importance(ensemble: Ensemble, names: list[str], df: DataFrame) -> DataFrame:
    """feature, importance: the share of all splits' training rows that split on the feature."""
    total = np.zeros(len(names))
    for t in ensemble.trees:
        for i, f in enumerate(t.feature):
            if t.left[i] >= 0:
                total[f] += t.cover[i]
    whole = total.sum() or 1.0
    return df.sparkSession.createDataFrame([(n, float(v / whole)) for n, v in zip(names, total)], "feature string, importance double")
