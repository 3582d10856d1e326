"""Byte-level BPE by a transducer that is determinised as it is needed.

The encoding of a text's prefix ends in one token whose removal leaves the encoding of the shorter
prefix, and a row of tokens is the encoding exactly if each two neighbours are the encoding of their
own bytes. So a nondeterministic transducer needs only the last complete token and the bytes read
since, a node of the vocabulary's trie. Its determinised states are the sets of such readings still
alive. A move names, for each reading of the next state, the one it came from, and the token that the
newest one completes; the tokens themselves belong to the path, not to the state, so that equal futures
share one state. They are emitted by following these links back as soon as one reading is left, after at
most the longest token's bytes, or at the end. States and moves are made when a text first needs them, up
to a bound; moves beyond it follow the same readings without storing them.
"""

from __future__ import annotations

import base64
from hashlib import sha256
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm.common import column, map_batches

#: States of the transducer, judged pairs and encoded pieces that a Python worker keeps.
STATES = 300_000
PAIRS = 1_000_000
PIECES = 500_000
#: Longer pieces are encoded without being kept.
KEEP_BYTES = 48
#: A rank above all.
NEVER = 1 << 62


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The rank file, one base64 token and its rank a line (a vocabulary, so of bounded size).

    A local file if the driver has it, else any path that Spark reads.
    """
    try:
        with open(path) as f:
            lines = f.read().split("\n")
    except OSError:
        lines = [r[0] for r in spark.read.text(path).collect()]
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merge(text: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: join the neighbours of lowest rank, leftmost first, until none has a rank."""
    parts = [text[i : i + 1] for i in range(len(text))]
    while len(parts) > 1:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Encode pieces of bytes; equal to `merge` on each."""

    def __init__(self, ranks: dict[bytes, int], states: int = STATES, pairs: int = PAIRS):
        self.ranks, self.most, self.most_pairs = ranks, states, pairs
        self.bytes = {i: b for b, i in ranks.items()}
        self.span = max(self.bytes, default=0) + 1
        self.child: list[dict[int, int] | None] = [{}]
        self.token: list[int] = [-1]
        for word, rank in ranks.items():
            at = 0
            for byte in word:
                if self.child[at] is None:
                    self.child[at] = {}
                nxt = self.child[at].get(byte)
                if nxt is None:
                    nxt = self.child[at][byte] = len(self.child)
                    self.child.append(None)
                    self.token.append(-1)
                at = nxt
            self.token[at] = rank
        self.fits: dict[int, bool] = {}
        self.spines: dict[int, tuple | None] = {}
        self.state: dict[tuple, int] = {}
        self.reading: list[tuple] = []
        self.move: list[dict[int, tuple[int, tuple[int, ...], int, int]]] = []
        self.links: dict[tuple, tuple] = {}
        self._state(((-1, 0),))

    def _state(self, readings: tuple) -> int:
        """readings: (last complete token, trie node of the bytes after it); the last has the root."""
        at = self.state.get(readings)
        if at is None:
            at = self.state[readings] = len(self.reading)
            self.reading.append(readings)
            self.move.append({})
        return at

    def _spine(self, token: int) -> tuple | None:
        """How the token grows from its first and from its last byte: two lists of (part, rank at which
        the part is merged on; the token itself never). None if the merges do not make the token."""
        if token in self.spines:
            return self.spines[token]
        text = self.bytes[token]
        out = None
        if len(text) == 1:
            out = ([(text, NEVER)], [(text, NEVER)])
        else:
            parts = merge(text, {b: r for b, r in self._below(text).items() if b != text})
            if len(parts) == 2:
                (left, _), (_, right) = self._spine(parts[0]), self._spine(parts[1])
                out = tuple([*[(p, min(r, token)) for p, r in side], (text, NEVER)] for side in (left, right))
        self.spines[token] = out
        return out

    def _below(self, text: bytes) -> dict[bytes, int]:
        cuts = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
        return {c: self.ranks[c] for c in cuts if c in self.ranks}

    def _fit(self, left: int, right: int) -> bool:
        """Whether the bytes of both encode to just these two: no merge ever crosses the seam.

        The parts beside the seam grow in order of rank; a crossing pair comes first if its rank is below
        the next merge on the left (which is further left, so wins ties) and at most that on the right.
        """
        a, b = self._spine(left) if left >= 0 else ([], []), self._spine(right)
        if a is None or b is None:
            return False
        if left < 0:
            return True
        x, y, i, j = a[1], b[0], 0, 0
        while True:
            (p, up), (q, on) = x[i], y[j]
            across = self.ranks.get(p + q, NEVER)
            if across < up and across <= on:
                return False
            if up == on == NEVER:
                return True
            if up <= on:
                i += 1
            else:
                j += 1

    def _fits(self, left: int, right: int) -> bool:
        pair = left * self.span + right
        ok = self.fits.get(pair)
        if ok is None:
            if len(self.fits) >= self.most_pairs:
                self.fits.clear()
            ok = self.fits[pair] = self._fit(left, right)
        return ok

    def _step(self, at: int, byte: int) -> tuple[int, tuple[int, ...], int, int]:
        """Next state, where its readings but the newest came from, where the newest did, and its token."""
        alive, came, source, done = [], [], -1, -1
        for k, (last, node) in enumerate(self.reading[at]):
            node = self.child[node].get(byte)
            if node is None:
                continue
            if self.child[node]:
                alive.append((last, node))
                came.append(k)
            token = self.token[node]
            if source < 0 and token >= 0 and self._fits(last, token):
                source, done = k, token
        alive.append((done, 0))
        links = self.links.setdefault(tuple(came), tuple(came))
        out = self.move[at][byte] = (self._state(tuple(alive)), links, source, done)
        return out

    def _simulate(self, readings: tuple, rest: bytes) -> tuple[int, list[int]]:
        """The readings followed without making states, for moves beyond the table's bound: the reading the
        path came from, and its tokens."""
        child, token, fits, span = self.child, self.token, self.fits, self.span
        last = [t for t, _ in readings]
        first = len(last)
        back = [-1] * first
        alive = [(k, node) for k, (_, node) in enumerate(readings)]
        for byte in rest:
            going, whole = [], False
            for k, node in alive:
                node = child[node].get(byte)
                if node is None:
                    continue
                if child[node]:
                    going.append((k, node))
                if not whole and token[node] >= 0:
                    ok = fits.get(last[k] * span + token[node])
                    if ok or ok is None and self._fits(last[k], token[node]):
                        whole = True
                        back.append(k)
                        last.append(token[node])
            going.append((len(last) - 1, 0))
            alive = going
        out, k = [], alive[-1][0]
        while k >= first:
            out.append(last[k])
            k = back[k]
        out.reverse()
        return k, out

    def encode(self, piece: bytes) -> list[int]:
        out: list[int] = []
        path: list[tuple] = []
        end: list[int] = []
        at, k, move = 0, -1, self.move
        for i, byte in enumerate(piece):
            step = move[at].get(byte)
            if step is None:
                if len(self.reading) >= self.most:
                    k, end = self._simulate(self.reading[at], piece[i:])
                    break
                step = self._step(at, byte)
            at = step[0]
            path.append(step)
            if not step[1]:  # one reading is left: all before it is settled
                out += self._tokens(path, -1)
                path.clear()
        out += self._tokens(path, k)
        out += end
        return out

    @staticmethod
    def _tokens(path: list[tuple], k: int) -> list[int]:
        """Follow the links back from reading k (-1: the newest) of the state that the path leads to."""
        out = []
        for _, came, source, token in reversed(path):
            if k < 0 or k == len(came):
                out.append(token)
                k = source
            else:
                k = came[k]
        out.reverse()
        return out


class Encoder(dict):
    """Piece of text to its ids, kept up to a bound. The split pattern comes first, as for the merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pieces: int = PIECES):
        import regex

        super().__init__()
        self.split = regex.compile(pattern).findall
        self.transducer, self.most = Transducer(ranks), pieces

    def __missing__(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        ids = self.transducer.encode(raw)
        if len(raw) <= KEEP_BYTES:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.split(text))))


#: UTF-8 as a state machine over classes of bytes. Fixed by the encoding: (first byte, last byte, class).
BYTE_CLASSES = [
    (0x00, 0x7F, 0), (0x80, 0x8F, 1), (0x90, 0x9F, 2), (0xA0, 0xBF, 3), (0xC2, 0xDF, 4), (0xE0, 0xE0, 5), (0xE1, 0xEC, 6),
    (0xED, 0xED, 7), (0xEE, 0xEF, 6), (0xF0, 0xF0, 8), (0xF1, 0xF3, 9), (0xF4, 0xF4, 10),
]
#: State to {class: next state}; 0 is between characters, anything absent is an error.
UTF8_MOVES = {
    0: {0: 0, 4: 1, 5: 4, 6: 2, 7: 5, 8: 6, 9: 3, 10: 7},
    1: {1: 0, 2: 0, 3: 0},
    2: {1: 1, 2: 1, 3: 1},
    3: {1: 2, 2: 2, 3: 2},
    4: {3: 1},
    5: {1: 1, 2: 1},
    6: {2: 2, 3: 2},
    7: {1: 2},
}


class StreamDecoder:
    """Ids to text in a stream: whole characters come out, the bytes of an unfinished one wait."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens, self.waiting, self.state = tokens, b"", 0
        self.classes = [next((c for a, b, c in BYTE_CLASSES if a <= i <= b), -1) for i in range(256)]

    def feed(self, ids: list[int]) -> str:
        """Text of the characters that these ids complete; ValueError on bytes that are no UTF-8."""
        return self.feed_bytes(b"".join(map(self.tokens.__getitem__, ids)))

    def feed_bytes(self, new: bytes) -> str:
        data = self.waiting + new
        # only the last three bytes can belong to an unfinished character
        cut = len(data)
        while cut > max(0, len(data) - 4) and data[cut - 1] & 0xC0 == 0x80:
            cut -= 1
        cut = max(0, cut - 1)
        state, whole = 0, cut
        for i in range(cut, len(data)):
            state = UTF8_MOVES[state].get(self.classes[data[i]], -1)
            if state < 0:
                raise ValueError("ids do not decode to UTF-8")
            if state == 0:
                whole = i + 1
        self.waiting, self.state = data[whole:], state
        return data[:whole].decode("utf-8")

    def close(self) -> None:
        if self.state:
            raise ValueError("the last character is unfinished")


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id and ids (array of int). NULL is the empty text, which has no ids.

    The vocabulary is broadcast (a rank file, of fixed size); the transducer is made once a Python worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def make():
        encoder = _worker(shared)[0]
        return lambda cols: {"doc_id": cols["doc_id"], "ids": [encoder.encode(t) for t in cols["text"]]}

    return map_batches(_narrow(docs, doc_id, text), "doc_id long, ids array<int>", make)


def decode(encoded: DataFrame, ranks: dict[bytes, int], doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """From ids back to text: doc_id, text. NULL ids give the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast({i: b for b, i in ranks.items()})

    def make():
        def one(row):
            machine = StreamDecoder(shared.value)
            parts = [machine.feed(row[i : i + 4096]) for i in range(0, len(row or ()), 4096)]
            machine.close()
            return "".join(parts)

        return lambda cols: {"doc_id": cols["doc_id"], "text": [one(x) for x in cols["ids"]]}

    narrow = encoded.select(column(encoded, doc_id).cast("long").alias("doc_id"), column(encoded, ids).alias("ids"))
    return map_batches(narrow, "doc_id long, text string", make)


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode, decode and digest in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256, and on demand the ids.

    Digests are lowercase hex: of the decimal ids joined by commas, and of the bytes the ids decode to.
    Repeated rows give repeated results, an empty table none.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def make():
        encoder, names, machine = _worker(shared)

        def run(cols):
            n, coded, back, kept = [], [], [], []
            for text in cols["text"]:
                ids = encoder.encode(text)
                n.append(len(ids))
                if with_ids:
                    kept.append(ids)
                coded.append(sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                digest = sha256()
                for i in range(0, len(ids), 65_536):
                    digest.update(machine.feed(ids[i : i + 65_536]).encode())
                machine.close()
                back.append(digest.hexdigest())
            return {"doc_id": cols["doc_id"], "n_tokens": n, "ids_sha256": coded, "decoded_sha256": back, "ids": kept}

        return run

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_batches(_narrow(docs, doc_id, text), schema, make)


def _narrow(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(column(docs, doc_id).cast("long").alias("doc_id"), F.coalesce(column(docs, text), F.lit("")).alias("text"))


#: What a Python worker has built, by broadcast: tasks that share a worker share it.
_BUILT: dict = {}


def _worker(shared) -> tuple[Encoder, dict[int, str], StreamDecoder]:
    value = shared.value
    built = _BUILT.get(id(value))
    if built is None or built[0] is not value:
        ranks, pattern = value
        encoder = Encoder(ranks, pattern)
        built = (value, encoder, {i: str(i) for i in ranks.values()}, StreamDecoder(encoder.transducer.bytes))
        _BUILT.clear()
        _BUILT[id(value)] = built
    return built[1:]
