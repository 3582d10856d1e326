"""Exact dedup, mixing and licence scans against plain versions."""

import re
from collections import Counter, defaultdict
from hashlib import sha256

import pytest

from tabsmith.llm import exact_dedup, licenses, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_dedup(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1] or ""].append(row)
    return groups


@pytest.mark.parametrize("support", [1e-3, 0.05, 0.5])
def test_annotations(frames, odd_rows, support):
    rows = odd_rows + [(100 + i, "hot text", "en", "s1") for i in range(50)] + [(149, "hot text", "en", "s1")] * 5
    got = exact_dedup.annotate(frames(rows), support=support).collect()
    groups = plain_dedup(rows)
    assert len(got) == len(rows)
    by_digest = {sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    for digest, group in by_digest.items():
        own = [r for r in got if r["text_sha256"] == digest]
        ids = [x[0] for x in group if x[0] is not None]
        keep = max(ids) if ids else None
        assert Counter(r["doc_id"] for r in own) == Counter(x[0] for x in group)
        assert all(r["keep_id"] == keep and r["group_size"] == len(group) for r in own)
        kept = [r for r in own if r["kept"]]
        assert len(kept) == 1 and kept[0]["doc_id"] == keep


@pytest.mark.parametrize("support", [1e-3, 0.05])
def test_kept_rows(frames, odd_rows, support):
    rows = odd_rows + [(200, "hot text", "en", "s1")] * 30
    df = frames(rows)
    out = exact_dedup.dedup(df, support=support)
    assert out.columns == df.columns
    kept = out.selectExpr("doc_id", "text").collect()
    groups = plain_dedup(rows)
    assert len(kept) == len(groups)
    for r in kept:
        ids = [x[0] for x in groups[r["text"] or ""] if x[0] is not None]
        assert r["doc_id"] == (max(ids) if ids else None)


def test_empty_tables(frames):
    empty = frames([])
    assert exact_dedup.annotate(empty).count() == exact_dedup.dedup(empty).count() == 0
    assert licenses.scan(empty).count() == 0
    assert mixing.mix_sizes(empty).taken().count() == 0
    assert mixing.mix_texts(empty).count() == 0


def water(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by resharing the excess until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        rate = left / sum(w[s] for s in open_)
        full = {s for s in open_ if rate * w[s] >= most * sizes[s]}
        if not full:
            target |= {s: rate * w[s] for s in open_}
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("block", [1, 7, 256])
def test_mix_meets_its_targets(frames, odd_rows, block):
    got = mixing.mix_sizes(frames(), block=block).taken().collect()
    assert len(got) == len(odd_rows)
    sizes = defaultdict(int)
    for _, text, _, source in odd_rows:
        sizes[source] += len(WORD.findall(text or ""))
    target, taken = water(sizes), defaultdict(int)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((x[0], len(WORD.findall(x[1] or ""))) for x in odd_rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5001 for s in sizes)


def test_mix_agrees_in_any_layout(spark, odd_rows):
    rows = odd_rows + [(300 + i, f"some words of row {i} " * (1 + i % 7), "en", f"s{i % 4}") for i in range(400)]
    runs, texts = [], []
    for parts in (1, 3, 11):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(parts)
        runs.append(sorted(map(str, mixing.mix_sizes(df, block=16).taken().collect())))
        texts.append(sorted(map(str, mixing.mix_texts(df, block=16).collect())))
    assert runs[0] == runs[1] == runs[2] and texts[0] == texts[1] == texts[2]


def test_mix_reruns_agree_and_shards_are_mixed(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "concat('s', id % 4) AS source", "repeat('w ', cast(20 + id % 90 AS int)) AS text")
    a, b = (mixing.mix_sizes(df, block=8).taken() for _ in range(2))
    assert sorted(a.collect()) == sorted(b.collect())
    draws = mixing.mix_sizes(df, block=8).draws().collect()
    per = defaultdict(dict)
    for r in draws:
        per[r["shard"]][r["number"]] = r["slots"]
    full = [x for x in per.values() if sum(x.values()) == mixing.SHARD_SLOTS]
    assert len(full) >= 20 and all(len(x) == 4 for x in full) and len({tuple(sorted(x.items())) for x in full}) > 5


def test_permutation_is_one_to_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 10, 257):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(5)).alias("p"), "id")
        rows = df.collect()
        assert sorted(r["p"] for r in rows) == list(range(n))
    assert sum(r["p"] == r["id"] for r in rows) < 20


def test_mixed_texts_hold_the_words_taken(frames, odd_rows):
    df = frames()
    out = mixing.mix_texts(df, block=16)
    assert out.columns == df.columns
    got = Counter()
    for r in out.select("source", "text").collect():
        got[r["source"]] += len(WORD.findall(r["text"]))
    sizes = defaultdict(int)
    for _, text, _, source in odd_rows:
        sizes[source] += len(WORD.findall(text or ""))
    assert all(abs(got[s] - t) <= 0.5001 for s, t in water(sizes).items())


def test_licences(frames):
    texts = [t for _, t in licenses.KNOWN]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    rows += [
        (900, "Copyright (c) 2024 A. Body\n\n  released UNDER the M.I.T. -- Licence!!", "en", "s"),
        (901, "Some prose.\r\nReleased under the MIT License.\nMore.\nLicensed under CC BY-NC 4.0.", "en", "s"),
        (902, "I released it under the MIT License yesterday.", "en", "s"), (903, None, None, None), (904, "", "en", "s"), (905, "a\n" * 50_000, "en", "s"),
        (901, "Some prose.\r\nReleased under the MIT License.\nMore.\nLicensed under CC BY-NC 4.0.", "en", "s"),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(frames(rows)).collect()}
    assert licenses.scan(frames(rows)).count() == len(rows)
    for i, (name, _) in enumerate(licenses.KNOWN):
        assert got[i]["license"] == name
    assert got[900]["license"] is None or got[900]["license"] == "MIT"
    assert got[901]["license"] is None and got[901]["n_lines"] == 2 and got[901]["licenses"] == "CC-BY-NC-4.0,MIT"
    assert all(got[i]["license"] is None and got[i]["n_lines"] == 0 and got[i]["licenses"] == "" for i in (902, 903, 904, 905))
