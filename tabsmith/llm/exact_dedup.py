"""Exact duplicates with a split for heavy hitters.

Texts are equal when they are identical; NULL counts as the empty text. Misra-Gries counters (one
pass, at most 1/support of them) name every digest that can hold more than a share `support` of
the rows. Their true counts and their winners are then computed with map-side partial sums, and the
verified ones, at most 1/support, are broadcast: rows that lose against a heavy winner are settled
where they are read. Only the remaining rows, whose groups each hold a small share, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabsmith.llm.common import column, packed, unpacked
from tabsmith.session import materialize

#: Digests above this share of the rows are heavy; its inverse bounds what is broadcast.
SUPPORT = 1e-3


def text_digest(df: DataFrame, text: str):
    return F.sha2(F.coalesce(column(df, text), F.lit("")), 256)


def heavy_winners(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Verified heavy digests of (digest, rank): digest, win, size; at most 1/support rows.

    `rank` orders the rows of a digest; its largest value wins.
    """
    found = rows.stat.freqItems(["digest"], support).select(F.explode(F.col("digest_freqItems")).alias("digest"))
    counted = (
        rows.join(F.broadcast(found.distinct()), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max("rank").alias("win"), F.count(F.lit(1)).alias("size"))
    )
    least = rows.agg((F.count(F.lit(1)) * support).alias("least"))
    return counted.filter(F.col("size") >= least.scalar()).select("digest", "win", "size")


def annotate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays (NULL ids come last); where that id occurs
    more than once in the group, exactly one of its rows stays. An empty table gives no rows. Extra
    columns of any name are ignored.
    """
    narrow = docs.select(
        column(docs, doc_id).alias("doc_id"),
        text_digest(docs, text).alias("digest"),
        F.monotonically_increasing_id().alias("row_no"),
    )
    narrow = materialize(narrow, "digests")  # the one pass over the texts; row numbers are fixed here
    rows = narrow.withColumn("rank", F.struct("doc_id", "row_no"))
    marked = rows.join(F.broadcast(heavy_winners(rows, support)), "digest", "left")
    heavy = F.col("size").isNotNull()
    out = ["doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")]
    settled = marked.filter(heavy).select(
        "doc_id", F.col("win.doc_id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("row_no") == F.col("win.row_no")).alias("kept"), "digest",
    )
    group = Window.partitionBy("digest")
    rest = marked.filter(~heavy).select(
        "doc_id", F.max("rank").over(group).alias("best"), F.count(F.lit(1)).over(group).alias("group_size"), "row_no", "digest"
    )
    rest = rest.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row_no") == F.col("best.row_no")).alias("kept"), "digest",
    )
    return settled.select(*out).unionByName(rest.select(*out))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of `docs` that stay, all columns as they were.

    Rules as in `annotate`. Rows that lose against a heavy winner are dropped where they are read;
    the few that equal the winner's id are first reduced map-side, so that a hot group never meets
    in one task. The other rows are shuffled once by digest.
    """
    rows = packed(docs, id=column(docs, doc_id), digest=text_digest(docs, text))
    narrow = materialize(rows.select("digest", F.struct("id").alias("rank")), "digests")
    wins = F.broadcast(heavy_winners(narrow, support).select("digest", F.col("win.id").alias("win_id"), F.lit(True).alias("heavy")))
    marked = rows.join(wins, "digest", "left")
    winners = (
        marked.filter(F.col("heavy") & F.col("id").eqNullSafe(F.col("win_id")))
        .groupBy("digest")
        .agg(F.first("row").alias("row"))
        .select("row")
    )
    order = Window.partitionBy("digest").orderBy(F.col("id").desc_nulls_last())
    light = marked.filter(F.col("heavy").isNull()).withColumn("place", F.row_number().over(order)).filter("place = 1").select("row")
    return unpacked(winners.unionByName(light), docs)
