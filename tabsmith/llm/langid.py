"""Language identification: words first, then ever shorter character n-grams.

Learning counts, over all labelled rows, the words of each language, and from those counts the
character n-grams. A known word scores its log frequency in each language; an unseen one is covered
by the longest known n-grams, cut from the left and backing off to shorter ones, at a fixed price
for each step. The models kept are the most frequent words and n-grams, two documented bounds on
what is broadcast; the counts themselves cover everything.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabsmith.llm.common import column, map_batches
from tabsmith.session import materialize

#: Known words and n-grams kept for each language; longest n-gram.
WORDS = 20_000
GRAMS = 20_000
LONGEST = 4
#: Longer words are read as consecutive pieces of so many characters, and words a task counts before it passes counts on.
WORD_CHARS = 24
PENDING = 200_000
#: Log price of each step to a shorter n-gram, and of a character never seen.
STEP = -1.0
UNSEEN = -12.0
#: Words that a Python worker remembers.
KEEP = 300_000
#: Words after which more of the same evidence no longer sharpens the score.
ENOUGH = 8


def words_of(text: str) -> list[str]:
    """Lower-case words, without the punctuation and digits at their ends; long ones in pieces of WORD_CHARS."""
    words = [w for w in (x.strip(_ENDS) for x in text.lower().split()) if w]
    if max(map(len, words), default=0) <= WORD_CHARS:
        return words
    return [w[i : i + WORD_CHARS] for w in words for i in range(0, len(w), WORD_CHARS)]


_ENDS = "0123456789.,;:!?\"'()[]{}<>|*#$%&@^~`+=/\\_-–—…«»“”„‘’¿¡"


def word_counts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """lang, word, n over all rows with a language. Tasks pass their counts on when they hold many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(counts):
            keys = list(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())],
                names=["lang", "word", "n"],
            )

        counts: dict[tuple[str, str], int] = {}
        for batch in batches:
            by_lang: dict[str, Counter] = {}
            for i in range(batch.num_rows):
                by_lang.setdefault(batch.column(0)[i].as_py(), Counter()).update(words_of(batch.column(1)[i].as_py()))
            for lang, own in by_lang.items():
                for word, n in own.items():
                    key = (lang, word)
                    counts[key] = counts.get(key, 0) + n
            if len(counts) > PENDING:
                yield rows(counts)
                counts = {}
        yield rows(counts)

    narrow = docs.select(column(docs, lang).alias("lang"), column(docs, text).alias("text")).dropna()
    return narrow.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _top(counts: DataFrame, key: str, most: int, salts: int = 64) -> list[tuple[str, str, int]]:
    """Full counts, in every language, of the keys among the most frequent of one; ties by key: picked within salted parts, then among those."""
    order = [F.col("n").desc(), F.col(key)]
    parts = Window.partitionBy("lang", "part").orderBy(*order)
    whole = Window.partitionBy("lang").orderBy(*order)
    best = counts.withColumn("part", F.pmod(F.xxhash64(key), F.lit(salts))).withColumn("place", F.row_number().over(parts))
    best = best.filter(F.col("place") <= most).withColumn("place", F.row_number().over(whole)).filter(F.col("place") <= most)
    return [tuple(r) for r in counts.join(best.select(key).distinct(), key).select("lang", key, "n").collect()]  # at most `most` keys a language, in each


@dataclass
class Model:
    """Languages in order, and for each known word or n-gram its row of log frequencies."""

    langs: list[str] = field(default_factory=list)
    words: dict[str, np.ndarray] = field(default_factory=dict)
    grams: dict[str, np.ndarray] = field(default_factory=dict)

    def unseen_word(self, word: str) -> np.ndarray:
        """Cover a word by the longest known n-grams from the left; each backoff costs a step."""
        text, at = f" {word} ", 0
        total, parts = np.zeros(len(self.langs)), 0
        while at < len(text):
            for size in range(min(LONGEST, len(text) - at), 0, -1):
                known = self.grams.get(text[at : at + size])
                if known is not None:
                    total = total + known + STEP * (LONGEST - size)
                    at += size
                    break
            else:
                total = total + UNSEEN
                at += 1
            parts += 1
        return total / max(1, parts)


def _table(rows: list[tuple[str, str, int]], totals: dict[str, int], langs: list[str]) -> dict[str, np.ndarray]:
    """Log relative frequency by language; what a language lacks counts as half an occurrence."""
    out: dict[str, np.ndarray] = {}
    floor = np.array([np.log(0.5 / max(1, totals.get(g, 0))) for g in langs])
    for lang, key, n in rows:
        row = out.get(key)
        if row is None:
            row = out[key] = floor.copy()
        row[langs.index(lang)] = np.log(n / totals[lang])
    return out


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", words: int = WORDS, grams: int = GRAMS) -> Model:
    """Learn from every row with a language and a text. No such row gives a model without languages."""
    counts = materialize(word_counts(docs, lang, text), "words")
    totals = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}  # one row a language
    langs = sorted(totals)
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    sizes = F.sequence(F.lit(1), F.lit(LONGEST))
    cut = F.flatten(
        F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - k + 1)), lambda i: F.substring(padded, i, k)))
    )
    cells = counts.select("lang", "n", F.explode(cut).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    cells = materialize(cells, "grams")
    gram_totals = {r[0]: r[1] for r in cells.groupBy("lang").agg(F.sum("n")).collect()}
    return Model(langs, _table(_top(counts, "word", words), totals, langs), _table(_top(cells, "gram", grams), gram_totals, langs))


class Scores(dict):
    """Word to the number of its row in a growing table of log frequencies."""

    def __init__(self, model: Model, keep: int = KEEP):
        super().__init__()
        self.model, self.keep = model, keep
        self.rows = np.zeros((1024, max(1, len(model.langs))))

    def __missing__(self, word: str) -> int:
        row = self.model.words.get(word)
        if row is None:
            row = self.model.unseen_word(word)
        at = self[word] = len(self)
        if at >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at] = row
        return at

    def of(self, words: list[str]) -> np.ndarray:
        """Mean log frequency of the words in each language."""
        total = np.zeros(self.rows.shape[1])
        for i in range(0, len(words), 1 << 16):
            part = words[i : i + (1 << 16)]
            if len(self) > self.keep:
                self.clear()
            ids = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            total += self.rows[ids].sum(axis=0)
        return total / max(1, len(words))


def predict_one(scores: Scores, text: str | None) -> tuple[str, float]:
    """Language and score of one text: `und` and 0 without a letter or a model."""
    langs = scores.model.langs
    if not text or not langs or not any(map(str.isalpha, text)):
        return "und", 0.0
    words = words_of(text)
    mean = scores.of(words) * min(len(words), ENOUGH)
    best = int(mean.argmax())
    return langs[best], float(1 / np.exp(mean - mean[best]).sum())


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (0 to 1), from the text alone.

    NULL, empty and letterless texts are `und` with score 0. Ties go to the first language in order.
    Repeated rows are kept, an empty table gives no rows. The model, of bounded size, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scores = _worker(shared)

        def run(cols):
            found = [predict_one(scores, t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}

        return run

    narrow = docs.select(column(docs, doc_id).cast("long").alias("doc_id"), column(docs, text).alias("text"))
    return map_batches(narrow, "doc_id long, lang_pred string, score double", make)


_BUILT: list = []


def _worker(shared) -> Scores:
    if not _BUILT or _BUILT[0] is not shared.value:
        _BUILT[:] = [shared.value, Scores(shared.value)]
    return _BUILT[1]
