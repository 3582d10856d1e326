"""Shards that each hold the mixture of sources: proportional stratified interleaving.

Rows are put into a seeded pseudorandom order within their source. The r-th of a source's n rows gets
the fractional rank (r + u) / n, where u in [0, 1) belongs to the source, so that small sources do not
all meet at one place. Sorted by fractional rank, any stretch of the order holds each source in its
proportion, to within two rows; the order is cut into shards of equal row counts.

The order depends on the rows themselves (id, source, text) and never on how they are stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import column, packed
from tabsmith.operators.slices import with_position
from tabsmith.session import materialize

SHARDS = 8
SEED = 7
#: Source tables of up to this many rows are broadcast.
FEW_SOURCES = 10_000


def _leading(hexadecimal: Column, digits: int) -> Column:
    return F.conv(F.substring(hexadecimal, 1, digits), 16, 10).cast("long")


def _narrow(docs: DataFrame, doc_id: str, source: str, text: str, seed: int) -> dict[str, Column]:
    body = F.coalesce(column(docs, text), F.lit(""))
    name = column(docs, source).cast("string")
    key = F.coalesce(F.concat(F.lit("="), name), F.lit(""))
    of = F.coalesce(column(docs, doc_id).cast("string"), F.lit(""))
    return {
        "doc_id": column(docs, doc_id).cast("long"),
        "key": key,
        "size": (F.octet_length(body) + 1).cast("long"),
        "text_crc32": F.crc32(F.encode(body, "UTF-8")).cast("long"),
        "digest": F.substring(F.sha2(F.concat_ws("\n", F.lit(str(seed)), of, key, body), 256), 1, 32),
        "row_no": F.monotonically_increasing_id(),
    }


def _copies(rows: DataFrame) -> DataFrame:
    """Add `copy`: the number, from 0, of a row among the rows of equal id, source and text.

    Only rows that have equals are numbered, over slices of one order of them all.
    """
    repeated = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("same")).filter("same > 1").select("digest")
    equals = materialize(rows.join(repeated, "digest", "left_semi").select("digest", "row_no", _leading(F.col("digest"), 15).alias("axis")), "equals")
    at = materialize(with_position(equals, [], ["axis", "row_no"], "at").select("digest", "row_no", "at"), "places")
    first = at.groupBy("digest").agg(F.min("at").alias("first"))
    numbered = at.join(first, "digest").select("row_no", (F.col("at") - F.col("first")).alias("copy"))
    return rows.join(numbered, "row_no", "left").withColumn("copy", F.coalesce("copy", F.lit(0).cast("long")))


def interleave(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Add shard (0 to shards - 1) and slot (gapless from 0 in its shard) to stored rows of (row_no, key, digest)."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    rows = _copies(rows)
    again = F.sha2(F.concat_ws("\n", "digest", F.col("copy").cast("string")), 256)
    axis = _leading(F.when(F.col("copy") == 0, F.col("digest")).otherwise(again), 15)
    rows = materialize(rows.withColumn("axis", axis), "shuffled")
    ranked = with_position(rows, ["key"], ["axis", "digest", "copy"], "rank")
    sizes = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("of")), "sources")
    sizes = sizes.withColumn("shift", _leading(F.sha2(F.concat_ws("\n", F.lit(str(seed)), "key"), 256), 8) / 4294967296)
    few = sizes.count() <= FEW_SOURCES
    ranked = ranked.join(F.broadcast(sizes) if few else sizes, "key")
    ranked = materialize(ranked.withColumn("fraction", (F.col("rank") - 1 + F.col("shift")) / F.col("of")), "ranked")
    total = ranked.agg(F.count(F.lit(1))).scalar()
    placed = with_position(ranked, [], ["fraction", "rank", "key"], "place").withColumn("total", total)
    return (
        placed.withColumn("shard", F.expr(f"((place * {shards} + total - 1) DIV total) - 1").cast("int"))
        .withColumn("slot", F.expr(f"place - 1 - ((shard * total) DIV {shards})").cast("long"))
        .drop("axis", "rank", "of", "shift", "fraction", "total", "place", "copy")
    )


def assign(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes plus 1. Row counts of the shards are at most one apart, and each
    shard holds each source in its share of all rows. NULL texts count as empty, NULL and empty sources
    are sources of their own, a NULL id counts as empty. Rows of equal id, source and text are dealt
    each; which of them goes where makes no difference. Reruns agree in any layout; an empty table
    gives no rows.
    """
    parts = _narrow(docs, doc_id, source, text, seed)
    rows = materialize(docs.select(*[c.alias(n) for n, c in parts.items()]), "rows")
    return interleave(rows, shards, seed).select("doc_id", "size", "text_crc32", "shard", "slot")


def write(docs: DataFrame, path: str, doc_id: str = "doc_id", source: str = "source", text: str = "text", shards: int = SHARDS, seed: int = SEED) -> None:
    """Write the documents, all columns, as Parquet folders shard=0, 1, ..., rows in order of their slots.

    Rules as in `assign`. Texts are stored once with their row numbers and shuffled once into the shards;
    a shard is written in as many files as its size asks for.
    """
    parts = _narrow(docs, doc_id, source, text, seed)
    wide = materialize(packed(docs, **parts), "wide")
    at = interleave(wide.select("row_no", "key", "digest"), shards, seed).select("row_no", F.col("shard").alias("to_shard"), "slot")
    dealt = wide.join(at, "row_no").repartitionByRange("to_shard", "slot").sortWithinPartitions("to_shard", "slot")
    out = [F.col("row").getField(c).alias(c) for c in docs.columns if c != "shard"]
    dealt.select(F.col("to_shard").alias("shard"), *out).write.partitionBy("shard").parquet(path)
