"""Spelling variants, importance resampling and sharding against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from tabsmith.llm import resampling, sharding, spelling

RUN = re.compile("[a-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(rows, thin, length, least):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in RUN.findall((text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if thin and h % thin == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= length and k >= least}


def plain_variants(n, ratio):
    out = {}
    for w in n:
        near = [v for v in n if one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = (form, len(near))
    rows = set()
    for w, (form, many) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, n[w], many, n[form] if form else None))
    return rows


def test_bitsets_find_all_words_one_edit_away():
    r = random.Random(2)
    words = list({"".join(r.choice("abé") for _ in range(r.randint(1, 7))) for _ in range(400)}) + ["x" * 3000, "x" * 3001]
    index = spelling.BitSliced(words)
    for q in [*words, "zzz", "a", "", "ab" * 40, "x" * 2999]:
        assert sorted(index.words[i] for i in index.near(q)) == sorted(w for w in words if one_edit(q, w)), q[:20]


@pytest.mark.parametrize("block", [8192, 3])
def test_variants_equal_the_definition(spark, block):
    r = random.Random(3)
    stems = ["".join(r.choice("aeinst") for _ in range(r.randint(7, 9))) for _ in range(30)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa"]
    n = {}
    for s in stems:
        n[s] = r.choice([2, 25, 300, 4000])
        for _ in range(6):
            i, c = r.randrange(len(s)), r.choice("aeinsté")
            w = r.choice([s[:i] + s[i + 1 :], s[:i] + c + s[i:], s[:i] + c + s[i + 1 :]])
            if len(w) >= 7:
                n.setdefault(w, r.choice([2, 3, 25, 300]))
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(5)
    got = spelling.variants(df, 10, block).collect()
    assert len(got) == len(n) and {tuple(x) for x in got} == plain_variants(n, 10)
    assert any(x["form"] and x["root"] != x["form"] for x in got)  # chains of forms


def test_word_counts_and_edges(frames, odd_rows):
    rows = odd_rows + [(i, "Considerable CONSIDERABLE considerably Établirétablir x" * 2, None, None) for i in range(60, 160)]
    for thin in (31, 3, 0):
        got = {x["word"]: x["n"] for x in spelling.word_counts(frames(rows), thin=thin).collect()}
        assert got == plain_counts(rows, thin, 7, 2)
    full = {tuple(x) for x in spelling.variants(spelling.word_counts(frames(rows), thin=3)).collect()}
    assert full == plain_variants(plain_counts(rows, 3, 7, 2), 10)
    empty = spelling.variants(spelling.word_counts(frames([])))
    assert empty.count() == 0 and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]


WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text, longest):
    w = WORDS.findall((text or "").translate(LOWER))
    return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain_resample(rows, target, longest, buckets, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    docs = [plain_features(t, longest) for _, t, *_ in rows]
    s = Counter(bucket(f) for _, fs in docs for f in fs)
    t = Counter(bucket(f) for x in target for f in plain_features(x, longest)[1])
    gain = lambda b: math.floor(
        1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))
    )
    out = []
    for (doc_id, *_), (words, fs) in zip(rows, docs):
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0], x[1], x[2]))
    for i, x in enumerate(able[: len(able) * percent // 100]):
        x[4] = i + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


@pytest.mark.parametrize("longest,percent", [(1, 10), (2, 50), (3, 100)])
def test_resampling_equals_the_definition(spark, frames, odd_rows, longest, percent):
    rows = odd_rows + [(45, odd_rows[3][1], "de", "s2")] * 5
    target = [odd_rows[5][1], None, "", odd_rows[6][1] + " The BROWN stone"]
    wanted = spark.createDataFrame([(x,) for x in target], "body string")
    got = resampling.resample(frames(rows), wanted, target_text="body", longest=longest, buckets=97, percent=percent, least_words=5)
    assert sorted((tuple(x) for x in got.collect()), key=str) == plain_resample(rows, target, longest, 97, percent, 5)


def test_resampling_of_equal_rows_and_of_none(spark, frames):
    rows = [(1, "a b c", None, None)] * 9000 + [(2, "a b c d", None, None)] * 10
    empty = spark.createDataFrame([], "text string")
    got = resampling.resample(frames(rows), empty, percent=50, least_words=3).collect()
    assert len(got) == 9010 and sorted(x["rank"] for x in got if x["rank"]) == list(range(1, 4506))
    assert resampling.resample(frames([]), empty).count() == 0
    assert resampling.resample(frames([(None, None, None, None)]), empty).collect()[0][1:] == (0, 0, resampling.resample(frames([(None, "", None, None)]), empty).collect()[0]["score"], None)


def test_slabs_do_not_change_features(monkeypatch, spark, frames, odd_rows):
    whole = resampling.bucket_counts(frames(), longest=2)
    monkeypatch.setattr(resampling, "SLAB", 1000)
    assert np.array_equal(resampling.bucket_counts(frames(), longest=2), whole)


def check_shards(got, rows, shards):
    assert Counter((x["doc_id"], x["size"], x["text_crc32"]) for x in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    slots = defaultdict(list)
    for x in got:
        slots[x["shard"]].append(x["slot"])
    assert set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("shards", [1, 3, 8, 100])
def test_shards_of_odd_rows(frames, odd_rows, shards):
    check_shards(sharding.assign(frames(), shards=shards).collect(), odd_rows, shards)


def test_shards_hold_the_mixture_in_any_layout(spark, frames):
    r = random.Random(5)
    rows = [(i, f"text {r.random()}", None, "hot" if i % 3 == 0 else f"s{r.randrange(30)}") for i in range(3000)]
    rows += [(7, "a copy", None, "hot")] * 1500
    source = {(i, t): s for i, t, _, s in rows}
    runs = []
    for parts in (1, 5):
        got = sharding.assign(frames(rows, parts), shards=8).collect()
        check_shards(got, rows, 8)
        runs.append(sorted(map(tuple, got)))
    assert runs[0] == runs[1]
    crc = {zlib.crc32(t.encode()): s for (_, t), s in source.items()}
    share = Counter((x["shard"], crc[x["text_crc32"]]) for x in got)
    total = Counter(s for *_, s in rows)
    for s, n in total.items():
        for k in range(8):
            assert abs(share[k, s] - n / 8) <= 2 + n * 31 / len(rows)


def test_shards_as_files_and_of_none(spark, frames, odd_rows, tmp_path):
    df = frames()
    sharding.write(df, f"{tmp_path}/out", shards=4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert set(back.columns) == {*df.columns, "shard"} and back.count() == len(odd_rows)
    want = Counter((x["shard"], x["doc_id"], x["size"]) for x in sharding.assign(df, shards=4).collect())
    assert Counter((x["shard"], x["doc_id"], len((x["text"] or "").encode()) + 1) for x in back.collect()) == want
    assert sharding.assign(frames([])).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(df, shards=0)
