"""Spelling variants: words one edit apart, found by a bit-sliced position index.

A block of the vocabulary is held as bitsets, one for each (position, letter): bit i is set if word i
has that letter there. A query word is read once, letter by letter. A set of the words that agree so
far and three sets of the words with one error so far (a letter replaced; one more in the vocabulary
word, positions then shifted by +1; one less, shifted by -1) are carried along together, each by a few
word-parallel operations, so all words of the block are compared at once.

Blocks are formed so that no pair within one edit is missed: for a pair whose shorter word has l
letters, the edit lies either behind the first l // 2 letters or before the last l - l // 2, so the two
words share one of these parts. A word belongs to the groups of both parts for l = its length and for
l = its length - 1. A group larger than a block is cut into blocks by a hash, and its words are sent as
queries to every block: nothing is dropped, and no task holds more than a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import column
from tabsmith.session import materialize

#: Words of one block of the index, and rows of groups that one task searches.
BLOCK = 8192
TASK_ROWS = 50_000
#: Letters of a word, after A-Z are lower-cased.
LETTERS = r"a-zÀ-ÿ"


class BitSliced:
    """Bitsets over `words` by (position, letter), and by length."""

    def __init__(self, words: list[str]):
        self.words = words
        self.at: list[dict[str, int]] = []
        self.length: dict[int, int] = {}
        for i, word in enumerate(words):
            bit = 1 << i
            while len(self.at) < len(word) + 2:
                self.at.append({})
            for place, letter in zip(self.at, word):
                place[letter] = place.get(letter, 0) | bit
            self.length[len(word)] = self.length.get(len(word), 0) | bit
        self.all = (1 << len(words)) - 1

    def near(self, word: str, lengths: tuple[int, ...] | None = None) -> list[int]:
        """Indices of the words exactly one inserted, deleted or replaced code point from `word`."""
        at, size = self.at, len(word)
        same, replaced, longer, shorter = self.all, 0, 0, 0
        before: dict[str, int] = {}
        for p, letter in enumerate(word):
            here = at[p] if p < len(at) else {}
            ahead = at[p + 1] if p + 1 < len(at) else {}
            agree = same & here.get(letter, 0)
            replaced = (replaced & here.get(letter, 0)) | (same ^ agree)
            longer = (longer | same) & ahead.get(letter, 0)
            shorter = (shorter & before.get(letter, 0)) | same
            same, before = agree, here
            if not (same or replaced or longer or shorter):
                return []
        found = 0
        for n, errors in ((size, replaced), (size + 1, longer | same), (size - 1, shorter)):
            if lengths is None or n in lengths:
                found |= errors & self.length.get(n, 0)
        out = []
        while found:
            low = found & -found
            out.append(low.bit_length() - 1)
            found ^= low
        return out


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", thin: int = 31, length: int = 7, least: int = 2) -> DataFrame:
    """Words of at least `length` code points with at least `least` occurrences: word, n.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased. Where `thin` divides
    the crc32 h of `<doc_id>:<run>`, the code point h % length of the run is left out (thin = 0: never).
    A NULL text has no words, a NULL doc_id counts as empty in h; repeated rows count each. Partial
    counts are summed where the texts are read, so a very common word is no special case.
    """
    lowered = F.translate(column(docs, text), ascii_uppercase, ascii_lowercase)
    runs = F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(column(docs, doc_id).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    word = F.col("run")
    if thin:
        h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
        spot = F.pmod(h, F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), spot), F.substring("run", spot + 2, F.length("run")))
        word = F.when(h % thin == 0, cut).otherwise(word)
    return (
        rows.select(word.alias("word"))
        .filter(F.length("word") >= length)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= least)
    )


def _part(side: int, short: Column) -> Column:
    """The part of `word` that a pair with a shorter word of `short` code points shares: 0 first, 1 last."""
    half = F.floor(short / 2).cast("int")
    if side == 0:
        return F.substring("word", F.lit(1), half)
    return F.substring("word", F.length("word") - (short - half) + 1, short - half)


def _groups(vocabulary: DataFrame, block: int) -> DataFrame:
    """side, short, part (a digest), block, role, word, n: role 0 fills the index, 1 asks, 2 does both."""
    sides = []
    for side in (0, 1):
        for less in (0, 1):
            short = (F.length("word") - less).cast("int")
            sides.append(F.struct(F.lit(side).alias("side"), short.alias("short"), F.xxhash64(_part(side, short)).alias("part")))
    rows = vocabulary.select("word", "n", F.explode(F.array(*sides)).alias("group")).select("group.*", "word", "n")
    key = ["side", "short", "part"]
    large = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > block)
    cut = rows.join(large.withColumn("blocks", F.ceil(F.col("members") / block).cast("int")).drop("members"), key, "left")
    home = F.pmod(F.xxhash64("word"), "blocks").cast("int")
    entry = F.struct(home.alias("block"), F.lit(0).alias("role"))
    asks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.lit(1).alias("role")))
    alone = F.array(F.struct(F.lit(0).alias("block"), F.lit(2).alias("role")))
    places = F.when(F.col("blocks").isNull(), alone).otherwise(F.concat(F.array(entry), asks))
    return cut.select(*key, "word", "n", F.explode(places).alias("place")).select(*key, "place.*", "word", "n")


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, block and role to (word, n_near, near_n, near): the best and the number of
    near words that this block adds for each asking word."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])

    def answers(index, sizes, side, short, word):
        half, out = short // 2, []
        wanted = (short, short + 1) if len(word) == short else (short,)
        for i in index.near(word, wanted):
            other = index.words[i]
            # a pair that shares both parts belongs to the first side; other parts met by an equal digest
            if (word[:half] == other[:half]) == (side == 0):
                out.append((-sizes[i], other))
        return out

    def run() -> Iterator[tuple]:
        at, members, index, asking = None, [], None, []

        def close():
            found = BitSliced([w for w, _ in members])
            return found, [n for _, n in members]

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for side, short, part, block, role, word, n in zip(*cols):
                key = (side, short, part, block)
                if key != at:
                    if at is not None and asking and len(members) > 1:
                        index = close()
                        for w in asking:
                            yield w, answers(*index, at[0], at[1], w)
                    at, members, index, asking = key, [], None, []
                if role != 1:
                    members.append((word, n))
                if role == 2:
                    asking.append(word)
                elif role == 1:
                    index = index or close()
                    yield word, answers(*index, side, short, word)
        if at is not None and asking and len(members) > 1:
            index = close()
            for w in asking:
                yield w, answers(*index, at[0], at[1], w)

    rows: list[list] = [[], [], [], []]
    for word, found in run():
        if found:
            size, best = min(found)
            for cells, value in zip(rows, (word, len(found), -size, best)):
                cells.append(value)
        if len(rows[0]) >= 10_000:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)
            rows = [[], [], [], []]
    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)


def near_words(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each word of (word, n) with near words: word, n_near, and of these the one of largest n (ties: least
    in code-point order) as near, with near_n."""
    order = ["side", "short", "part", "block", "role"]
    rows = _groups(vocabulary, block).select(*order, "word", "n")
    # the search costs far more than the bytes of its rows tell: tasks are sized by rows
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-4 * vocabulary.count() // TASK_ROWS))
    dealt = rows.repartition(parts, "side", "short", "part", "block").sortWithinPartitions(*order)
    found = dealt.mapInArrow(_search, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("size"), "near")).alias("best")
    return (
        found.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), best)
        .select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.size")).alias("near_n"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """From (word, form), form never NULL and never in a cycle, to (word, root): the end of the chain of forms.

    Each step doubles the links followed; as a form is at least `ratio` times as frequent as its word,
    chains are short. Every step is written to the shared folder.
    """
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        moved = step.filter("next IS NOT NULL").limit(1).count()
        now = step.drop("next")
        if not moved:
            return now


def variants(vocabulary: DataFrame, ratio: int = 10, block: int = BLOCK) -> DataFrame:
    """Group the distinct words of (word, n) with their spelling variants.

    One row per word: word, form (its near word of largest n, ties to the least in code-point order, if
    that n is at least `ratio` times the word's, else NULL), root (the end of the chain of forms, the word
    itself if it has none), n, n_near (near words, 0 if none), form_n (the form's n or NULL). Words of
    under two code points have no near words of their own here; an empty vocabulary gives no rows.
    """
    vocabulary = materialize(vocabulary.select("word", "n"), "words")
    near = materialize(vocabulary.join(near_words(vocabulary.filter(F.length("word") > 1), block), "word", "left"), "near")
    formed = F.col("near_n") >= ratio * F.col("n")
    ends = roots(near.filter(formed).select("word", F.col("near").alias("form")))
    return near.join(ends, "word", "left").select(
        "word", F.when(formed, F.col("near")).alias("form"), F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("near_n")).alias("form_n"),
    )
