"""Mix sources to target weights.

Each source's documents, in pseudorandom order, form one stream of words, packed into blocks of fixed
length. A target says how many words the mix takes of a source; it is cut into slots of one block.
All slots are dealt over output shards by a pseudorandom permutation, so the counts of sources in a
shard are a multinomial draw, conditioned on the totals that the targets fix. A slot finds its block
through a pseudorandom permutation of the source's block indices, one for each pass over the source,
and slots and blocks are joined by index. Everything is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabsmith.llm.common import WORD, column, packed
from tabsmith.session import materialize

#: Words of a block, slots of an output shard, rows whose offsets are summed in one window.
BLOCK = 256
SHARD_SLOTS = 1024
WINDOW_ROWS = 5000
#: Slots that one row expands to at a time.
CHUNK = 4096
ROUNDS = 24
#: Source tables of up to this many rows are broadcast.
FEW_SOURCES = 10_000


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """Pseudorandom permutation of 0..n-1 at x, one for each key, by swap-or-not rounds.

    Every round pairs x with (k - x) mod n and a hash of the larger of the two decides for both
    whether they change places, so each round, and the whole, is one to one for any n.
    """
    n = F.greatest(n.cast("long"), F.lit(1).cast("long"))

    def round_(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit("pair"), *key, r), n) - at, n)
        swap = F.xxhash64(F.lit("swap"), *key, r, F.greatest(at, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), round_)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """From (source, source_size, rows) to the targets: number, source, source_size, target (double), rows.

    Sources in code-point order, NULL last, weigh as listed, repeating. Together they get `share`
    times all sizes; no target is above `most` times its source, and the excess goes to the others
    by weight. Sorted by cap over weight, the sources at their caps come first: a source is among
    them if its cap is at most what its weight would give it after all before it took theirs.
    """
    every = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    numbered = (
        sizes.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    )
    tight = Window.orderBy(F.col("cap") / F.col("weight"), "number")
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    after = tight.rowsBetween(0, Window.unboundedFollowing)
    rate = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    capped = numbered.withColumn("full", F.col("cap") <= rate * F.col("weight"))
    spent = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    left = F.coalesce((F.col("budget") - spent) / open_weight, F.lit(0.0))
    return capped.select(
        "number", "source", "source_size", "rows",
        F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), left * F.col("weight"))).alias("target"),
    )


@dataclass
class Mix:
    """rows: row_no, doc_id, source, size, number, source_size, target. pieces: shard, seat, number,
    pass, row_no, start, words (words start..start+words of the row go to that seat of the shard)."""

    rows: DataFrame
    pieces: DataFrame

    def taken(self) -> DataFrame:
        """One row per document: doc_id, size, source_size, target, taken, source."""
        took = self.pieces.groupBy("row_no").agg(F.sum("words").alias("taken"))
        return self.rows.join(took, "row_no", "left").select(
            "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "source"
        )

    def draws(self) -> DataFrame:
        """Slots drawn of each source for each shard: shard, number, slots."""
        return self.pieces.select("shard", "seat", "number").distinct().groupBy("shard", "number").agg(F.count(F.lit(1)).alias("slots"))


def mix(rows: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: int = 42) -> Mix:
    """Deal the words of rows (row_no, doc_id, digest, source, size) to shards.

    A source's words taken equal its rounded target; a pass takes no word twice, so no document
    gives more than ceil(`most`) times its size. Rows without words give nothing. NULL and empty
    sources are sources of their own. The order of a source's rows follows from doc_id and `digest` (of
    the text); row_no only parts rows that are equal in both, so reruns agree however the rows are
    stored. An empty table gives empty results. `rows` must be a stored table, as it is read more than once.
    """
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), weights, share, most)
    targets = materialize(targets, "targets")
    few = targets.count() <= FEW_SOURCES
    by_source = F.broadcast(targets) if few else targets
    rows = rows.join(by_source, rows["source"].eqNullSafe(by_source["source"]), "left").drop(by_source["source"])

    # a source is cut into as many slices as its rows need, so that no window holds a hot source
    slices = F.ceil(F.col("rows") / WINDOW_ROWS)
    placed = rows.filter("size > 0").select(
        "number", "row_no", "doc_id", "digest", "size", F.xxhash64(F.lit(seed), "doc_id", "digest").alias("order"), slices.alias("slices")
    ).withColumn("slice", F.pmod("order", "slices"))
    slice_sizes = placed.groupBy("number", "slice").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("number").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slice_sizes.select("number", "slice", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("number", "slice").orderBy("order", "doc_id", "digest", "size", "row_no")
    placed = (
        placed.withColumn("upto", F.sum("size").over(inside))
        .join(starts, ["number", "slice"])
        .select("number", "row_no", "size", (F.col("base") + F.col("upto") - F.col("size")).alias("offset"))
    )
    first = F.floor(F.col("offset") / block)
    last = F.floor((F.col("offset") + F.col("size") - 1) / block)
    packed_rows = placed.select("*", F.explode(F.sequence(first, last)).alias("block")).select(
        "number", "block", "row_no",
        F.greatest(F.col("offset"), F.col("block") * block).alias("lo"),
        F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block).alias("hi"),
        "offset",
    )

    passes = max(1, int(-(-most // 1)))
    want = F.round("target").cast("long")
    part = F.greatest(F.lit(0).cast("long"), F.least(want - F.col("pass") * F.col("source_size"), F.col("source_size")))
    runs = (
        targets.withColumn("pass", F.explode(F.array(*[F.lit(p) for p in range(passes)])))
        .select("number", "pass", F.ceil(F.col("source_size") / block).alias("blocks"), part.alias("words"))
        .filter("words > 0")
        .withColumn("slots", F.ceil(F.col("words") / block))
    )
    so_far = Window.orderBy("number", "pass").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("base", F.coalesce(F.sum("slots").over(so_far), F.lit(0))).withColumn("all", F.sum("slots").over(Window.partitionBy()))
    chunks = runs.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / CHUNK))))
    low = F.col("chunk") * CHUNK
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = (
        chunks.repartition(parts, "number", "pass", "chunk")
        .withColumn("k", F.explode(F.sequence(low, F.least(low + CHUNK, F.col("slots")) - 1)))
        .withColumn("seat", permuted(F.col("base") + F.col("k"), F.col("all"), F.lit(seed)))
        .select(
            "number", "pass", "seat", F.floor(F.col("seat") / SHARD_SLOTS).alias("shard"),
            # the last, shorter block of a source ends its pass
            F.when(F.col("k") == F.col("blocks") - 1, F.col("k"))
            .otherwise(permuted(F.col("k"), F.col("blocks") - 1, F.lit(seed), F.col("number"), F.col("pass"))).alias("block"),
            F.least(F.lit(block).cast("long"), F.col("words") - F.col("k") * block).alias("room"),
        )
    )
    end = F.least(F.col("hi"), F.col("block") * block + F.col("room"))
    pieces = slots.hint("merge").join(packed_rows, ["number", "block"]).filter(end > F.col("lo")).select(
        "shard", "seat", "number", "pass", "row_no", (F.col("lo") - F.col("offset")).alias("start"), (end - F.col("lo")).alias("words")
    )
    return Mix(rows, pieces)


def mix_sizes(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> Mix:
    """`mix` over the words of `text` (NULL: none), from one pass over the texts."""
    rows = docs.select(
        column(docs, doc_id).alias("doc_id"),
        column(docs, source).alias("source"),
        word_count(column(docs, text)).alias("size"),
        F.xxhash64(column(docs, text)).alias("digest"),
        F.monotonically_increasing_id().alias("row_no"),
    )
    return mix(materialize(rows, "sizes"), **options)


def mix_texts(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mix as documents: a row for each document and pass with the words taken of it.

    Columns as in `docs`; a text taken whole is unchanged, of others the taken words come in order,
    joined by spaces. Documents without words give no row. The rows are stored once with their
    numbers, so that both reads agree whatever happens to executors.
    """
    rows = packed(docs, row_no=F.monotonically_increasing_id(), size=word_count(column(docs, text)), digest=F.xxhash64(column(docs, text)))
    rows = materialize(rows, "rows")
    cells = F.col("row")
    narrow = rows.select(
        cells.getField(doc_id).alias("doc_id"), cells.getField(source).alias("source"), "size", "digest", "row_no"
    )
    cut = (
        mix(narrow, **options)
        .pieces.groupBy("row_no", "pass")
        .agg(F.sum("words").alias("took"), F.sort_array(F.collect_list(F.struct("start", "words"))).alias("cuts"))
    )
    words = F.regexp_extract_all(cells.getField(text), F.lit(WORD), F.lit(0))
    pieces = F.flatten(F.transform("cuts", lambda c: F.slice(F.col("all_words"), (c["start"] + 1).cast("int"), c["words"].cast("int"))))
    whole = rows.join(cut, "row_no")
    whole = whole.withColumn("all_words", F.when(F.col("took") < F.col("size"), words))
    new = F.when(F.col("took") == F.col("size"), cells.getField(text)).otherwise(F.array_join(pieces, " "))
    return whole.select(*[(new if c == text else cells.getField(c)).alias(c) for c in docs.columns])
