"""SimHash, components and exact top-k against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.llm import components, covertree, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_print(text, n=3):
    import xxhash

    words = WORD.findall((text or "").translate(LOW))
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprints_and_components(frames, odd_rows):
    rows = odd_rows + [(300 + i, " ".join(["same"] * 400 + ["Tail"] * (i % 3)), "en", "s") for i in range(9)]
    got = simhash.near_duplicates(frames(rows)).collect()
    prints = [plain_print(r[1]) for r in rows]
    of = groups(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    least = {}
    for g, r in zip(of, rows):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = [(r[0], f"{p:016x}", least.get(g)) for r, p, g in zip(rows, prints, of)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert simhash.near_duplicates(frames([])).count() == simhash.dedup(frames([])).count() == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("roomy", [2, 16, 100_000])
def test_no_link_is_lost_in_crowded_keys(spark, roomy):
    r = random.Random(6)
    centre, prints = r.getrandbits(64), set()
    while len(prints) < 160:
        x = r.choice([centre, r.getrandbits(64), *list(prints)[-3:]])
        for b in r.sample(range(64), r.randint(0, 4)):
            x ^= 1 << b
        prints.add(x)
    prints = sorted(prints)
    nodes = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    links = simhash.link_fingerprints(nodes, roomy=roomy)
    edges = {(x["a"] % 2**64, x["b"] % 2**64) for x in links.collect()}
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    at = {x: i for i, x in enumerate(prints)}
    pairs = {frozenset((at[a], at[b])) for a, b in edges}
    assert groups(len(prints), lambda i, j: frozenset((i, j)) in pairs) == groups(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)


def test_pivots_never_discard_a_link():
    r = np.random.default_rng(1)
    prints = r.integers(0, 2**64, (50, 4), dtype=np.uint64)
    refs = simhash.pivots(4)
    table = simhash.distances(prints, refs)
    for i in range(50):
        for j in range(i):
            assert np.abs(table[i] - table[j]).max() <= simhash.hamming(prints[i], prints[j])


def jaccard(a, b):
    cut = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    return len(cut(a) & cut(b)) / len(cut(a) | cut(b))


def test_near_copies_go_and_others_stay(frames):
    r = random.Random(7)
    words = [f"w{i}" for i in range(4000)]
    rows, copies = [], []
    for i in range(60):
        text = [r.choice(words) for _ in range(200)]
        rows.append((i, " ".join(text), "en", "s"))
        if i % 2:
            text[r.randrange(200)] = "edit"
            copies.append((1000 + i, " ".join(text), "en", "s"))
    assert all(jaccard(rows[c[0] - 1000][1], c[1]) > 0.9 for c in copies)
    df = frames(rows + copies + [copies[0], (None, "alone", None, None), (None, None, None, None), (2000, "", "en", "s")])
    out = simhash.dedup(df)
    assert out.columns == df.columns
    kept = [x["doc_id"] for x in out.select("doc_id").collect()]
    assert sorted(k for k in kept if k is not None) == [*range(60), 2000] and kept.count(None) == 1


@pytest.mark.parametrize("n", [100, 10_000, 30_000_000])
def test_pairs_at_the_bound_meet_at_any_size(n):
    bits, tables = simhash.tables_for(n)
    # sets of Jaccard similarity 0.8 have a cosine of 2 * 0.8 / 1.8
    agree = 1 - np.arccos(1.6 / 1.8) / np.pi
    assert tables * agree**bits >= 0.999 * simhash.MEETINGS


def test_hot_near_copies_by_representative(spark, monkeypatch):
    monkeypatch.setattr(simhash, "ROOMY", 5)
    base = np.random.default_rng(2).integers(0, 2**64, 4, dtype=np.uint64)
    rows = []
    for i in range(60):
        x = base.copy()
        x[i % 4] ^= np.uint64(1) << np.uint64(i)
        rows.append(tuple(x.view(np.int64).tolist()))
    far = np.random.default_rng(3).integers(0, 2**64, (40, 4), dtype=np.uint64).view(np.int64)
    nodes = spark.createDataFrame([*rows, *map(tuple, far.tolist())], "l0 long, l1 long, l2 long, l3 long")
    found = components.components(simhash.wide_links(nodes)).collect()
    assert len(found) == 60 and len({tuple(x["root"]) for x in found}) == 1


@pytest.mark.parametrize("block", [4096, 16])
def test_wide_spread_of_a_hot_key_loses_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "ROOMY", 5)
    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    monkeypatch.setattr(simhash, "MEETINGS", 1e-9)  # one table, whose bits all share
    same = set(np.random.default_rng(simhash.SEED).choice(256, 12, replace=False).tolist())
    r, free = random.Random(9), [b for b in range(256) if b not in same]
    flip = lambda x, n: x ^ sum(1 << b for b in r.sample(free, n))
    base = r.getrandbits(256) | 1 << 255  # not the least: it need not represent the key
    prints = [flip(base, r.randint(15, 30)) for _ in range(50)]
    prints += [flip(x, r.randint(30, 42)) for x in prints] + [flip(base, 120) for _ in range(30)]
    prints += [flip(x, 40) for x in prints[-10:]]
    lanes = [tuple(signed(x >> 64 * i & (2**64 - 1)) for i in range(4)) for x in prints]
    nodes = spark.createDataFrame(lanes, "l0 long, l1 long, l2 long, l3 long")
    roots = {tuple(x["node"]): tuple(x["root"]) for x in components.components(simhash.wide_links(nodes)).collect()}
    got = [roots.get(x, x) for x in lanes]
    want = groups(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 42)
    assert len(set(want)) > 20
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(prints)) for j in range(i))


@pytest.mark.parametrize("block", [3, 20])
def test_no_link_is_lost_between_blocks_of_a_key(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(10)
    prints = sorted({sum(1 << b for b in r.sample(range(0, 64, 4), r.randint(0, 8))) for _ in range(90)})
    rows = [(7, 1, signed(x), False) for x in prints]
    links = simhash._block_links(spark.createDataFrame(rows, "at int, key long, fp long, settled boolean"), ["at", "key"], ["fp"], 3).collect()
    roots = {x["node"]: x["root"] for x in components.components(spark.createDataFrame([(x["a"]["fp"], x["b"]["fp"]) for x in links], "a long, b long")).collect()}
    got = [roots.get(signed(x), signed(x)) for x in prints]
    want = groups(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(prints)) for j in range(i))


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (3, 2), (None, 5), (200, 201), (201, 200)]
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    want = {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}, 200: 200, 201: 200}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_top(rows, k, pick):
    seen = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [float(np.floor(256 * float(x))) for x in v]
        seen[i] = min(seen.get(i, q), q)
    out = []
    for q in filter(pick, seen):
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(seen[q], seen[d])), d) for d in seen if d != q)
        out += [(q, n + 1, d, -s) for n, (s, d) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 7])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(covertree, "BLOCK", block)
    monkeypatch.setattr(covertree, "QUERIES", 5)
    monkeypatch.setattr(covertree, "GROUP", 8)
    monkeypatch.setattr(covertree, "LEAF", 4)
    monkeypatch.setattr(covertree, "QUERY_LEAF", 2)
    r = random.Random(8)
    spot = [[r.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [x + r.gauss(0, 0.1) for x in r.choice(spot)]) for i in range(90)]
    rows += [(100 + i, [0.5] * 6) for i in range(30)] + [(200, [0.0] * 6), (200, [0.1] * 6), (201, [1.0, 2.0]), (202, [])]
    rows += [(210, None), (None, [1.0] * 6), (212, [None] + [9.0] * 5), (213, [float("nan")] * 6), (214, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("grp", F.lit(2))
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = covertree.top_k(df, F.col("vec_id") % 5 == 0, 4).collect()
    assert sorted(map(tuple, got)) == brute_top(as_float, 4, lambda i: i % 5 == 0)


def test_top_k_of_little(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert covertree.top_k(empty, F.col("vec_id") % 5 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (3, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in covertree.top_k(two, F.col("vec_id") % 5 == 0).collect()] == [(0, 1, 3, 256 * 512)]
    big = spark.createDataFrame([(0, [1e9]), (1, [1e9]), (2, [-1e9])], "vec_id long, embedding array<double>")
    rows = covertree.top_k(big, F.col("vec_id") == 0).collect()
    assert [x["vec_id"] for x in rows] == [1, 2]
