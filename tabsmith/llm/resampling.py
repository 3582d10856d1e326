"""Importance resampling towards a target distribution over hashed n-grams.

Words and n-grams come from Arrow kernels: `ascii_lower`, `split_pattern_regex`, `list_flatten` and
`dictionary_encode`. Runs of n words are formed from shifted dictionary indices; the distinct ones, a
small part of all, are spelled out once for their crc32 bucket, and `take` spreads buckets, or the
buckets' gains, back over all places, where a sum by segment gives one number a document.

Two passes read the texts: one counts buckets over all of them (a fixed number of counters a task),
the other sums gains. The draw ranks documents over slices of the score, cut at the counts of scores
themselves, so no task ever orders all rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import column
from tabsmith.llm.running import each_copy, first_places
from tabsmith.session import materialize

BUCKETS = 10_000
#: What lies between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that go through the kernels at once (a single text may hold more).
SLAB = 4 << 20


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to `longest` words of each text, their rows, and the texts' word counts.

    NULL texts have no words. Rows come in order within a run length, not over all of them.
    """
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), BETWEEN)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    words = pc.list_flatten(lists)
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    filled = pc.greater(pc.binary_length(words), 0)
    rows = rows[filled.to_numpy(zero_copy_only=False)]
    coded = pc.dictionary_encode(words.filter(filled))
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = coded.dictionary.to_pylist()
    sizes = np.bincount(rows, minlength=len(texts))
    all_buckets, all_rows = [], []
    codes, spelled, starts = index, [w.encode() for w in names], rows
    for n in range(1, longest + 1):
        if n > 1:
            # a run is the run before it and the word n - 1 places on, if both lie in one text
            inside = np.flatnonzero(rows[n - 1 :] == starts[: max(0, len(rows) - n + 1)])
            pairs = codes[inside] * len(names) + index[inside + n - 1]
            distinct, codes_inside = np.unique(pairs, return_inverse=True)
            spelled = [spelled[p // len(names)] + b" " + names[p % len(names)].encode() for p in distinct.tolist()]
            codes = np.full(len(rows), -1, np.int64)
            codes[inside] = codes_inside
            at, of = codes_inside, rows[inside]
        else:
            at, of = index, rows
        digests = pa.array([zlib.crc32(s) % buckets for s in spelled], pa.int64())
        all_buckets.append(pc.take(digests, pa.array(at, pa.int64())).to_numpy(zero_copy_only=False))
        all_rows.append(of)
    return np.concatenate(all_buckets), np.concatenate(all_rows), sizes


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = max(1, min(batch.num_rows, -(-batch.nbytes // SLAB)))
        step = max(1, -(-batch.num_rows // parts))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket. A task sends one row a bucket, the driver gets `buckets` sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for slab in _slabs(batches):
            found, _, _ = features(slab.column(0), longest, buckets)
            sums += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some], pa.int64())], ["bucket", "n"])

    parts = texts.select(column(texts, text).alias("text")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the source."""
    size, all_, wanted = len(source), int(source.sum()), int(target.sum())
    ratio = lambda s, t: float(t + 1) * float(all_ + size) / (float(s + 1) * float(wanted + size))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", longest: int = 1) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight (the sum of its features' gains)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(shared.value, pa.int64())
        for slab in _slabs(batches):
            buckets, rows, sizes = features(slab.column("text"), longest, len(table))
            worth = pc.take(table, pa.array(buckets, pa.int64())).to_numpy(zero_copy_only=False)
            order = np.argsort(rows, kind="stable")
            present, first = np.unique(rows[order], return_index=True)
            weight, many = np.zeros(slab.num_rows, np.int64), np.bincount(rows, minlength=slab.num_rows)
            if len(first):
                weight[present] = np.add.reduceat(worth[order], first)
            cols = [slab.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(many, pa.int64()), pa.array(weight, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_features", "weight"])

    narrow = docs.select(column(docs, doc_id).cast("long").alias("doc_id"), column(docs, text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    longest: int = 1, buckets: int = BUCKETS, seed: int = 2024, percent: int = 10, least_words: int = 20,
) -> DataFrame:
    """Draw documents like the target: one row per document: doc_id, n_features, weight, score, rank.

    A bucket's gain is floor(1000 ln) of its smoothed share in the target over its share in `docs`;
    weight sums them over a document's features. score adds Gumbel noise drawn from `<seed>:<doc_id>`, so
    the floor(percent * N / 100) highest of the N documents with `least_words` words are a draw
    without replacement in proportion to exp(weight / 1000). Drawn rows have rank 1, 2, ... by score
    (ties: smaller doc_id, NULL last, then fewer features and weight); others NULL. A NULL text has no
    words, a NULL doc_id counts as empty in the noise; repeated rows are drawn each; an empty table
    gives no rows. `longest` is the longest run of words that is a feature.
    """
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    seeded = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(seeded, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = weigh(docs, gain, doc_id, text, longest).withColumn("score", F.col("weight") + noise)
    cells = ["doc_id", "n_features", "weight", "score"]
    able = (F.col("n_words") >= least_words).alias("able")
    scored = materialize(scored.select(*cells, able).groupBy(*cells, "able").agg(F.count(F.lit(1)).alias("copies")), "scores")
    drawn = scored.filter("able").agg(F.floor(F.sum("copies") * percent / 100)).scalar()
    last_id = F.coalesce("doc_id", F.lit(2**63 - 1))
    order = [F.col("score").desc(), last_id, F.col("doc_id").asc_nulls_last(), "n_features", "weight"]
    placed = each_copy(first_places(scored.filter("able"), -F.col("score").cast("double"), last_id.cast("double"), order))
    place = F.col("first") + F.col("copy")
    rank = F.when(place <= drawn, place).cast("long")
    rest = each_copy(scored.filter("NOT able"))
    return placed.select(*cells, rank.alias("rank")).unionByName(rest.select(*cells, F.lit(None).cast("long").alias("rank")))
