"""SimHash near-duplicates by pivot distance tables.

Each text gets a 64-bit fingerprint. For every distinct fingerprint the Hamming distances to many
reference fingerprints (pivots) count: the zero fingerprint, the 64 with a single bit set, and a set of
pseudorandom ones, whose distances are tabulated. Two fingerprints' distances to a pivot differ by at most
their own distance, so a pair whose rows differ by more than the radius in any coordinate is discarded
before its distance is computed.

The pairs to look at come from the same table. Differences of the coordinates to the first 65 pivots
are the bits themselves; cut into six groups of coordinates, two fingerprints within three bits agree
in at least three whole groups. Twenty keys, one per choice of three groups, therefore bring every
linked pair together. Keys that many different fingerprints share are cut again, by the same rule,
over the coordinates the key leaves free; then at most 2^18 different fingerprints can share one,
whatever the data, and those that over BLOCK share are taken by pairs of blocks. Within a key, a breadth-first search emits a spanning forest of the
links, never all pairs. Equal fingerprints are one node throughout.

Three bits of 64 mean texts that are all but equal. For near copies in the sense of a Jaccard similarity
of 0.8 over five-word shingles there are wide fingerprints of 256 bits: an angle that 0.8 stands for
turns about 39 of them. No group of bits is sure to agree then, so keys sample bits, in as many tables
as let nineteen of twenty pairs of similarity 0.8 meet, whatever the number of texts; keys that more than ROOMY share
tie what is near to one representative each, and what is not near it meets all members by pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import column, map_batches, packed, unpacked
from tabsmith.llm.components import components
from tabsmith.session import materialize

RADIUS = 3
SHINGLE = 3
#: Different fingerprints that may share a key before it is cut again.
ROOMY = 2048
SEED = 42
#: Wide fingerprints: words of 64 bits, words of a shingle, bits that two near copies may differ in.
LANES = 4
WIDE_SHINGLE = 5
WIDE_RADIUS = 42
#: Chance that two texts of similarity 0.8 agree in a bit, and expected tables in which such a pair meets.
AGREE = 0.8485
MEETINGS = 3.0
#: Fingerprints of a block: a key that more share is taken by pairs of blocks.
BLOCK = 4096
#: Rows of a table of keys that may be broadcast.
SMALL = 100_000


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of a UTF-8 text, repeats included.

    A-Z are lower-cased; words are runs without ASCII white space. Fewer words than a shingle give
    one shingle of them all; no word (or NULL) gives none.
    """
    from xxhash import xxh64_intdigest as digest

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])
    n = len(words) - shingle + 1
    cuts = zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())
    return np.fromiter((digest(line[s:e], SEED) for s, e in cuts), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half the hashes; zero without hashes."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 128 * 128  # sums of up to 128 fit in a byte
        ones += bits[:whole].reshape(-1, 128, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text by majority over all its shingles' hashes."""
    return majority(shingle_hashes(text, shingle))


def wide_fingerprint(text: bytes | None, shingle: int = WIDE_SHINGLE) -> list[int]:
    """LANES words by majority over the different shingles, each word from hashes mixed anew."""
    hashes = np.unique(shingle_hashes(text, shingle))
    out = []
    for lane in range(LANES):
        h = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 % (1 << 64))
        if lane:
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
        out.append(majority(h))
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: doc_id and its fingerprint fp as a signed long."""

    def make():
        def run(cols):
            prints = np.array([fingerprint(t, shingle) for t in cols["text"]], np.uint64)
            return {"doc_id": cols["doc_id"], "fp": prints.view(np.int64)}

        return run

    narrow = docs.select(column(docs, doc_id).cast("long").alias("doc_id"), column(docs, text).cast("binary").alias("text"))
    return map_batches(narrow, "doc_id long, fp long", make)


def pivots(lanes: int = 1, random: int = 16) -> np.ndarray:
    """Reference fingerprints: zero, those with a single bit set, and pseudorandom ones."""
    bits = 64 * lanes
    out = np.zeros((1 + bits + random, lanes), np.uint64)
    for i in range(bits):
        out[1 + i, i // 64] = np.uint64(1) << np.uint64(i % 64)
    out[1 + bits :] = np.random.default_rng(SEED).integers(0, 2**64, (random, lanes), dtype=np.uint64)
    return out


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of fingerprints, the last axis being their words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def distances(prints: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Table of Hamming distances, one row per fingerprint and one column per pivot."""
    out = np.empty((len(prints), len(refs)), np.int16)
    for i, ref in enumerate(refs):
        out[:, i] = hamming(prints, ref)
    return out


def _groups(free: list[int], parts: int = 6) -> list[list[int]]:
    return [x.tolist() for x in np.array_split(np.array(free), parts)]


def _masks() -> list[tuple[int, list[int]]]:
    """For each choice of three of six coordinate groups: the mask it fixes and, within the rest, the masks of the second cut."""
    out = []
    for chosen in combinations(_groups(list(range(64))), 3):
        bits = [b for g in chosen for b in g]
        free = [b for b in range(64) if b not in bits]
        again = [sum(1 << b for g in c for b in g) for c in combinations(_groups(free), 3)]
        out.append((sum(1 << b for b in bits), again))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(nodes: DataFrame, masks: list[int], own: str = "at") -> DataFrame:
    """A row for each fingerprint and mask: the mask's number and the coordinates it fixes."""
    cells = [F.struct(F.lit(i).alias(own), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)]
    return nodes.select("fp", F.explode(F.array(*cells)).alias("cell")).select("fp", "cell.*")


def close(table: np.ndarray, x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Whether rows x and y of a pivot table differ by at most `radius` in every coordinate; the first few
    coordinates settle most pairs."""
    ok = np.flatnonzero((np.abs(table[x, :4] - table[y, :4]) <= radius).all(axis=-1))
    ok = ok[(np.abs(table[x[ok], 4:] - table[y[ok], 4:]) <= radius).all(axis=-1)]
    out = np.zeros(len(x), bool)
    out[ok] = True
    return out


def forest(prints: np.ndarray, radius: int = RADIUS, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among different fingerprints (places of both ends), breadth first.

    Each step takes one fingerprint against those not reached yet: first the pseudorandom pivots'
    coordinates, then the true distance of the survivors.
    """
    if table is None:
        table = distances(prints, pivots(prints.shape[1])[-16:])
    left = np.arange(len(prints))
    a, b = [], []
    queue: list[int] = []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        here = queue.pop()
        maybe = left
        for k in range(4):
            maybe = maybe[np.abs(table[maybe, k] - table[here, k]) <= radius]
        if len(maybe):
            maybe = maybe[(np.abs(table[maybe] - table[here]) <= radius).all(axis=1)]
        near = maybe[hamming(prints[maybe], prints[here]) <= radius]
        if len(near):
            a.append(np.full(len(near), here))
            b.append(near)
            queue.extend(near.tolist())
            left = np.setdiff1d(left, near, assume_unique=True)
    none = np.zeros(0, np.int64)
    return (np.concatenate(a) if a else none), (np.concatenate(b) if b else none)


def _link_runs(keys: np.ndarray, prints: np.ndarray, radius: int, few: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys; rows come sorted by key. Long runs give spanning forests.

    The rows' distances to the pseudorandom pivots are tabulated once. A pair whose rows differ by more than
    the radius anywhere is discarded; only the survivors' own distance is ever computed.
    """
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(keys)])
    table = distances(prints, pivots(prints.shape[1])[-16:])
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, few):
        chosen = (sizes > step) & (sizes <= few)
        of, n = starts[chosen], sizes[chosen] - step
        if not len(of):
            break
        x = np.repeat(of, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        x = x[close(table, x, x + step, radius)]
        x = x[hamming(prints[x], prints[x + step]) <= radius]
        a.append(x)
        b.append(x + step)
    for s, n in zip(starts[sizes > few], sizes[sizes > few]):
        x, y = forest(prints[s : s + n], radius, table[s : s + n])
        a.append(x + s)
        b.append(y + s)
    return prints[np.concatenate(a)], prints[np.concatenate(b)]


def _links(cells: DataFrame, by: list[str], prints: list[str], radius: int) -> DataFrame:
    """Links (a, b) within equal `by`: structs of the print's words.

    A task reads its rows sorted and keeps one run at a time; callers see to it that runs are short.
    """
    n, m = len(by), len(prints)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = np.zeros((0, n), np.int64), np.zeros((0, m), np.uint64)

        def flush(k, p):
            ends = [pa.StructArray.from_arrays([pa.array(x[:, i].view(np.int64)) for i in range(m)], names=prints) for x in map(np.ascontiguousarray, _link_runs(k, p, radius))]
            return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

        def columns(batch, at):
            return np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in at], axis=1)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([keys, columns(batch, range(n))])
            rows = np.concatenate([rows, columns(batch, range(n, n + m)).view(np.uint64)])
            done = np.flatnonzero((keys != keys[-1]).any(axis=1))
            cut = done[-1] + 1 if len(done) else 0
            if cut:
                yield flush(keys[:cut], rows[:cut])
                keys, rows = keys[cut:], rows[cut:]
        yield flush(keys, rows)

    words = ", ".join(f"{p}: long" for p in prints)
    return cells.select(*by, *prints).repartition(*by).sortWithinPartitions(*by).mapInArrow(run, f"a struct<{words}>, b struct<{words}>")


def _met(rows: DataFrame, keys: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join with a stored table of keys, broadcast if it is small."""
    return rows.join(F.broadcast(keys) if keys.count() <= SMALL else keys, by, how)


def _block_links(rows: DataFrame, by: list[str], prints: list[str], radius: int) -> DataFrame:
    """Links within keys of any size, as `_links`; rows that are `settled` are joined already and need no links among themselves.

    A key's open and settled rows are dealt to blocks by hash. Each pair of blocks, one of them open at least,
    is searched as a run of its own, so that every pair of rows meets unless both are settled.
    """
    settled = F.col("settled")
    sizes = rows.groupBy(*by).agg(F.count_if(~settled).alias("open"), F.count_if(settled).alias("done")).filter("open > 0")
    sizes = sizes.select(*by, F.ceil(F.col("open") / BLOCK).alias("open"), F.ceil(F.col("done") / BLOCK).alias("done"))
    rows = _met(rows, materialize(sizes, "blocks"), by)
    first, blocks = F.when(settled, F.col("open")).otherwise(0), F.when(settled, F.col("done")).otherwise(F.col("open"))
    own, other = F.col("own"), F.col("other")
    rows = rows.withColumn("own", first + F.pmod(F.xxhash64(*prints), blocks))
    last = F.when(settled, F.col("open") - 1).otherwise(F.col("open") + F.col("done") - 1)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = rows.filter((own != other) | (F.col("open") + F.col("done") == 1))
    return _links(rows.select(*by, F.least(own, other).alias("lo"), F.greatest(own, other).alias("hi"), *prints), [*by, "lo", "hi"], prints, radius)


def link_fingerprints(nodes: DataFrame, radius: int = RADIUS, roomy: int = ROOMY) -> DataFrame:
    """Links (a, b) that join the same components as all pairs of different `fp` within `radius` bits (3 at most)."""
    if not 0 <= radius <= 3:
        raise ValueError("the six coordinate groups find pairs within three bits")
    spark, masks = nodes.sparkSession, _masks()
    cells = _keyed(nodes, [m for m, _ in masks])
    sizes = cells.groupBy("at", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    sizes = materialize(sizes, "keys")
    full = sizes.filter(F.col("size") > roomy)
    plain = lambda links: links.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    links = plain(_links(cells.join(sizes.filter(F.col("size") <= roomy), ["at", "key"]), ["at", "key"], ["fp"], radius))
    if full.isEmpty():
        return links
    again = spark.createDataFrame(
        [(i, j, _signed(m | x)) for i, (m, more) in enumerate(masks) for j, x in enumerate(more)], "at int, cut int, mask long"
    )  # 400 fixed rows
    inner = (
        cells.join(full.select("at", "key"), ["at", "key"], "left_semi")
        .join(F.broadcast(again), "at")
        .select("at", "cut", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", F.lit(False).alias("settled"))
    )
    return links.unionByName(plain(_block_links(inner, ["at", "cut", "key"], ["fp"], radius)))


def tables_for(n: int) -> tuple[int, int]:
    """Bits of a key and number of tables for n wide fingerprints."""
    bits = max(12, n.bit_length())
    return bits, -int(-MEETINGS // AGREE**bits)


def wide_links(nodes: DataFrame, radius: int = WIDE_RADIUS) -> DataFrame:
    """Links (a, b) among different wide fingerprints (columns l0, l1, ...) of at most `radius` differing bits."""
    lanes = [f"l{i}" for i in range(LANES)]
    bits, tables = tables_for(nodes.count())
    rng, keys = np.random.default_rng(SEED), []
    for t in range(tables):
        masks = [0] * LANES
        for bit in rng.choice(64 * LANES, bits, replace=False).tolist():
            masks[bit // 64] |= 1 << (bit % 64)
        keys.append(F.xxhash64(F.lit(t), *[F.col(c).bitwiseAND(F.lit(_signed(m))) for c, m in zip(lanes, masks)]))
    cells = nodes.select(*lanes, F.explode(F.array(*keys)).alias("key"))
    print_ = F.struct(*lanes)
    full = materialize(cells.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > ROOMY).select("key"), "full")
    if full.isEmpty():
        return _links(cells, ["key"], lanes, radius)
    heavy = materialize(_met(cells, full, ["key"]).groupBy("key").agg(F.min(print_).alias("rep")), "heavy")
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col("rep").getField(c))) for c in lanes), F.lit(0))
    marked = _met(cells, heavy, ["key"]).select("key", *lanes, "rep", apart.alias("apart"))
    star = marked.filter((F.col("apart") <= radius) & (F.col("apart") > 0)).select(print_.alias("a"), F.col("rep").alias("b")).distinct()
    members = marked.select("key", *lanes, (F.col("apart") <= radius).alias("settled"))
    rest = _met(cells, full, ["key"], "left_anti")
    return _links(rest, ["key"], lanes, radius).unionByName(star).unionByName(_block_links(members, ["key"], lanes, radius))


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """From (doc_id, fp) to (fp, root, component_id): the component's least fingerprint and least doc_id."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(link_fingerprints(nodes.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    tied = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    tied = materialize(tied, "roots")
    least = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    return tied.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the least doc_id reachable over links, the row's own included; NULL ids do not
    count, and a component of NULL ids only has NULL. Empty and NULL texts share fingerprint zero
    and link like any other. Repeated rows are kept. An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    return prints.join(classes(prints, radius), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def wide_classes(prints: DataFrame, radius: int = WIDE_RADIUS) -> DataFrame:
    """From (doc_id, l0, ...) to (l0, ..., root, component_id), as `classes` does."""
    lanes = [f"l{i}" for i in range(LANES)]
    nodes = materialize(prints.groupBy(*lanes).agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(wide_links(nodes.select(*lanes), radius)).select("node.*", "root")
    tied = nodes.join(roots, lanes, "left").withColumn("root", F.coalesce("root", F.struct(*lanes)))
    tied = materialize(tied, "roots")
    least = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    return tied.join(least, "root").select(*lanes, "root", "component_id")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay: of each group of near copies the row with the least doc_id, unchanged.

    Near copies are texts of about 0.8 Jaccard similarity or more over five-word shingles, by their wide
    fingerprints; groups are what links join. Rows without an id give way to rows with one; where an id
    occurs more than once in a group, one of its rows stays. Texts without words are one group. The rows
    are stored once with their fingerprints, as both joins need them; all but the least of a group are
    dropped before the few that share an id are reduced to one.
    """
    lanes = [f"l{i}" for i in range(LANES)]

    @F.pandas_udf(", ".join(f"{c} long" for c in lanes))
    def print_of(texts: pd.Series) -> pd.DataFrame:
        words = np.array([wide_fingerprint(t) for t in texts], np.uint64).reshape(-1, LANES)
        return pd.DataFrame(np.ascontiguousarray(words).view(np.int64), columns=lanes)

    rows = packed(docs, doc_id=column(docs, doc_id).cast("long"), print=print_of(column(docs, text).cast("binary")))
    rows = materialize(rows.select("row", "doc_id", "print.*"), "printed")
    found = rows.join(wide_classes(rows.select("doc_id", *lanes)), lanes)
    found = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return unpacked(found.groupBy("root").agg(F.first("row").alias("row")), docs)
