"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary's trie gets, for every node, a failure link and the number of tokens popped on the
way: if the next character has no edge, the node's string is replaced by what remains of it after
taking its longest-match pieces. Each character is read once and moves the automaton forward or
along links already paid for, so a word takes linear time and no piece is ever built.

Pieces follow the mark convention of the vocabulary: a word is preceded by the mark U+2581. A
character outside the vocabulary counts as its UTF-8 bytes, as with byte fallback.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import column, map_batches

MARK = "▁"
#: Words whose counts a Python worker keeps, and their longest length.
WORDS = 500_000
KEEP_CHARS = 32


def read_pieces(path: str) -> list[str]:
    """Text pieces of a sentencepiece model: no control, unknown or byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(f(i) for f in skip)]


class Automaton:
    """Trie with failure links and popped-token counts."""

    def __init__(self, pieces: list[str]):
        self.child: list[dict[str, int]] = [{}]
        whole = [False]
        for piece in pieces:
            at = 0
            for c in piece:
                nxt = self.child[at].get(c)
                if nxt is None:
                    nxt = self.child[at][c] = len(self.child)
                    self.child.append({})
                    whole.append(False)
                at = nxt
            whole[at] = True
        self.fail, self.popped = [0] * len(self.child), [0] * len(self.child)
        level = [(0, c, v) for c, v in self.child[0].items()]
        while level:
            for parent, c, v in level:
                if whole[v]:
                    self.popped[v] = 1
                else:
                    self.fail[v], self.popped[v] = self._pop(self.fail[parent], self.popped[parent], c, parent == 0)
            level = [(v, c, w) for _, _, v in level for c, w in self.child[v].items()]

    def _pop(self, at: int, count: int, c: str, alone: bool) -> tuple[int, int]:
        """Read c in state `at`, with `count` tokens popped so far."""
        while not alone:
            nxt = self.child[at].get(c)
            if nxt is not None:
                return nxt, count
            if at == 0:
                break
            count += self.popped[at]
            at = self.fail[at]
        return 0, count + len(c.encode("utf-8", "surrogatepass"))

    def count(self, word: str) -> int:
        child, fail, popped = self.child, self.fail, self.popped
        at = n = 0
        for c in word:
            nxt = child[at].get(c)
            while nxt is None and at:
                n += popped[at]
                at = fail[at]
                nxt = child[at].get(c)
            if nxt is None:
                n += len(c.encode("utf-8", "surrogatepass"))
            else:
                at = nxt
        while at:
            n += popped[at]
            at = fail[at]
        return n


def greedy(word: str, pieces: set[str]) -> int:
    """The definition: take the longest piece from the left, or one character as its bytes."""
    n, i, most = 0, 0, max(map(len, pieces), default=0)
    while i < len(word):
        size = next((k for k in range(min(most, len(word) - i), 0, -1) if word[i : i + k] in pieces), 0)
        n += 1 if size else len(word[i].encode("utf-8", "surrogatepass"))
        i += size or 1
    return n


class Counts(dict):
    """Word to its token count, kept up to a bound."""

    def __init__(self, pieces: list[str], words: int = WORDS):
        super().__init__()
        self.automaton, self.most = Automaton(pieces), words

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(MARK + word)
        if len(word) <= KEEP_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[word] = n
        return n


def token_counts(docs: DataFrame, pieces: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_tokens over the whole text.

    Words are runs without white space (as str.split cuts them); a NULL or empty text has none.
    Repeated rows are counted each, an empty table gives no rows. The vocabulary, of fixed size, is
    broadcast; the automaton is made once a Python worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def make():
        counts = _worker(shared)

        def run(cols):
            words = [t.split() for t in cols["text"]]
            return {
                "doc_id": cols["doc_id"],
                "n_words": list(map(len, words)),
                "n_tokens": [sum(map(counts.__getitem__, w)) for w in words],
            }

        return run

    narrow = docs.select(column(docs, doc_id).cast("long").alias("doc_id"), F.coalesce(column(docs, text), F.lit("")).alias("text"))
    return map_batches(narrow, "doc_id long, n_words long, n_tokens long", make)


_BUILT: list = []


def _worker(shared) -> Counts:
    if not _BUILT or _BUILT[0] is not shared.value:
        _BUILT[:] = [shared.value, Counts(shared.value)]
    return _BUILT[1]
