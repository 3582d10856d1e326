"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text is cut into all overlapping windows of words (every half window begins one, and the last ends
with the text). A word's input is a learned word vector beside the mean of learned vectors of its
character trigrams, so unknown spellings still say something. Two gated recurrent passes read a
window from either side, attention pools their states, and the highest window gives the text's
score, put on a probability scale by a logistic fit on rows not used for training.

Training takes a bounded sample of labelled rows (SAMPLE). Labels belong to whole texts, so each
round first finds every text's highest window under the present weights and then fits those.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import column, map_batches, packed, unpacked

#: Labelled rows used for training at most.
SAMPLE = 5000
#: Words of a window and between the beginnings of two.
WINDOW = 32
STRIDE = 16
#: Hidden units of a direction, word and character dimensions, character buckets, kept words.
HIDDEN = 8
WORD_DIM = 8
CHAR_DIM = 8
BUCKETS = 4096
WORDS = 20_000
#: Texts of the sample that must hold a word for a lean, and for a vector of its own.
LEAN_TEXTS = 2
LEAST_TEXTS = 20
#: Texts by which a word's lean is drawn towards none.
DOUBT = 4.0
ROUNDS = 4
EPOCHS = 3
BATCH = 128
#: Steps of training at least, so that a small sample is gone through more often.
STEPS = 400
RATE = 0.01
DECAY = 0.02
#: Tokens a Python worker remembers; windows that go through the network together.
KEEP = 200_000
#: Bytes of a token; longer ones are read in parts.
TOKEN_BYTES = 64
TOGETHER = 2048
THRESHOLD = 0.7

_ENDS = "0123456789.,;:!?\"'()[]{}<>|*#$%&@^~`+=/\\_-–—…«»“”„‘’¿¡"


_JOINTS = re.compile(r"[.,;:!?|/\\_+=&~*-]+")


def tokens(text: str) -> list[str]:
    """Lower-case words between white space. Those over TOKEN_BYTES are taken apart at punctuation, and what is
    still longer by length, each piece beginning with the last two characters of the one before, so that every
    trigram is in one."""
    words = text.lower().split()
    if max(map(len, words), default=0) * 4 <= TOKEN_BYTES:
        return words
    out = []
    for word in words:
        if _bytes(word) <= TOKEN_BYTES:
            out.append(word)
            continue
        for part in filter(None, _JOINTS.split(word)):
            step = TOKEN_BYTES if part.isascii() else TOKEN_BYTES // 4
            out += [part[i : i + step] for i in range(0, max(1, len(part) - 2), step - 2)]
    return out


def _bytes(word: str) -> int:
    return len(word) if word.isascii() else len(word.encode("utf-8", "surrogatepass"))


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' byte trigrams (ends marked), and how many each word has."""
    raw = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in words]
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    code = (flat[:-2] * np.uint32(65_599) + flat[1:-1]) * np.uint32(65_599) + flat[2:]
    code = (code ^ (code >> np.uint32(15))) * np.uint32(2_246_822_519)
    keep = np.ones(len(flat), bool)
    ends = np.cumsum(sizes)
    keep[ends - 1] = False
    keep[ends - 2] = False
    return ((code >> np.uint32(13)) % np.uint32(BUCKETS)).astype(np.int64)[keep[: len(code)]], np.maximum(sizes - 2, 0)


@dataclass
class Network:
    """Weights. Gate columns: update, reset, candidate; index 0 of a direction reads forwards.

    A word's input: its lean (log odds of the label among the sample's texts that hold it, a fixed
    number), its learned vector (one for all rarer words) and its trigrams' mean vector.
    """

    vocabulary: dict[str, int]
    lean: dict[str, float]
    p: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0

    @staticmethod
    def fresh(words: list[str], lean: dict[str, float]) -> Network:
        """Small random weights for the words that get a vector."""
        rng, d, h = np.random.default_rng(7), 1 + WORD_DIM + CHAR_DIM, HIDDEN
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2] if len(s) > 1 else s[0])).astype(np.float32)
        p = {
            "word": (0.1 * rng.standard_normal((len(words) + 1, WORD_DIM))).astype(np.float32),
            "char": (0.1 * rng.standard_normal((BUCKETS, CHAR_DIM))).astype(np.float32),
            "x0": draw(d, 3 * h), "x1": draw(d, 3 * h), "b0": np.zeros(3 * h, np.float32), "b1": np.zeros(3 * h, np.float32),
            "u0": draw(h, 3 * h), "u1": draw(h, 3 * h), "att": draw(2 * h), "out": draw(2 * h), "bias": np.array([-2.0], np.float32),
        }
        return Network({w: i + 1 for i, w in enumerate(words)}, lean, p)

    def inputs(self, words: list[str], lean: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input rows of words, and what they came from: word rows, trigram buckets, trigram counts."""
        rows = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        if lean is None:
            lean = np.fromiter((self.lean.get(w, 0.0) for w in words), np.float32, len(words))
        grams, n = trigrams(words)
        sums = np.zeros((len(words), CHAR_DIM), np.float32)
        has = np.flatnonzero(n)
        if len(has):
            sums[has] = np.add.reduceat(self.p["char"][grams], (np.cumsum(n) - n)[has], axis=0) / n[has, None]
        return np.concatenate([lean[:, None], self.p["word"][rows], sums], axis=1), rows, grams, n

    def project(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs of both directions."""
        return np.concatenate([x @ self.p["x0"] + self.p["b0"], x @ self.p["x1"] + self.p["b1"]], axis=1)

    def forward(self, table: np.ndarray, ids: np.ndarray, real: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """Logits of windows of rows of `table`. real: which steps hold a word (None: all)."""
        n, steps, h = ids.shape[0], ids.shape[1], HIDDEN
        states = np.empty((steps, n, 2 * h), np.float32)
        for side in (0, 1):
            u, part = self.p[f"u{side}"], table[:, side * 3 * h : (side + 1) * 3 * h]
            now = np.zeros((n, h), np.float32)
            for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
                gx, gh = part[ids[:, t]], now @ u
                gates = 0.5 + 0.5 * np.tanh(0.5 * (gx[:, : 2 * h] + gh[:, : 2 * h]))
                z, r = gates[:, :h], gates[:, h:]
                new = np.tanh(gx[:, 2 * h :] + r * gh[:, 2 * h :])
                nxt = new + z * (now - new)
                if real is not None:
                    nxt *= real[:, t : t + 1]
                if keep is not None:
                    keep.append((side, t, now, z, r, new, gh[:, 2 * h :]))
                now = nxt
                states[t, :, side * h : (side + 1) * h] = nxt
        focus = states @ self.p["att"]
        if real is not None:
            focus = np.where(real.T > 0, focus, np.float32(-30))
        weight = np.exp(focus - focus.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if keep is not None:
            keep.append((states, weight, pooled))
        return pooled @ self.p["out"] + self.p["bias"][0]

    def backward(self, table: np.ndarray, ids: np.ndarray, real: np.ndarray, keep: list, slope: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients for the logits' slopes; `table` (gate inputs of the batch's words) gets one too."""
        h, (states, weight, pooled) = HIDDEN, keep[-1]
        g = {"out": pooled.T @ slope, "bias": np.array([slope.sum()], np.float32), "table": np.zeros_like(table)}
        d_pooled = slope[:, None] * self.p["out"]
        d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
        d_focus = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["att"] = np.einsum("tn,tnh->h", d_focus, states)
        d_states = weight[:, :, None] * d_pooled + d_focus[:, :, None] * self.p["att"]
        for side in (0, 1):
            u = self.p[f"u{side}"]
            d_u, later = np.zeros_like(u), np.zeros((len(ids), h), np.float32)
            for s, t, before, z, r, new, gh in reversed([k for k in keep[:-1] if k[0] == side]):
                d = (d_states[t, :, side * h : (side + 1) * h] + later) * real[:, t : t + 1]
                d_new = d * (1 - z) * (1 - new * new)
                d_z = d * (before - new) * z * (1 - z)
                d_r = d_new * gh * r * (1 - r)
                d_gx = np.concatenate([d_z, d_r, d_new], axis=1)
                d_gh = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_u += before.T @ d_gh
                later = d * z + d_gh @ u.T
                np.add.at(g["table"][:, side * 3 * h : (side + 1) * 3 * h], ids[:, t], d_gx)
            g[f"u{side}"] = d_u
        return g


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings of all windows in the run of all texts' words, and how many windows each text has."""
    n = np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1)
    of = np.repeat(np.arange(len(sizes)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.minimum(place * STRIDE, np.maximum(0, sizes[of] - WINDOW))
    return begin + (np.cumsum(sizes) - sizes)[of], n


class Windows:
    """All windows over a run of texts' word ids, handed out by number so that few are held at a time."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat = np.concatenate([flat, np.zeros(1, flat.dtype)])
        self.begins, self.n = windows(sizes)
        self.ends = np.repeat(np.cumsum(sizes), self.n)

    def __len__(self) -> int:
        return len(self.begins)

    def at(self, which: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of these windows, and which places hold a word."""
        place = self.begins[which][:, None] + np.arange(WINDOW)
        real = place < self.ends[which][:, None]
        return self.flat[np.where(real, place, len(self.flat) - 1)], real


class Scorer:
    """Scores of texts; remembers the gate inputs of tokens up to a bound."""

    def __init__(self, net: Network, keep: int = KEEP):
        self.net, self.keep = net, keep
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.table = np.zeros((0, 6 * HIDDEN), np.float32)
        self._learn([""])

    def _learn(self, tokens: list[str]) -> None:
        rows = self.net.project(self.net.inputs([t.strip(_ENDS) for t in tokens])[0])
        used = len(self.ids)
        if used + len(tokens) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(used, len(tokens), 1024), 6 * HIDDEN), np.float32)])
        self.table[used : used + len(tokens)] = rows
        self.ids.update(zip(tokens, range(used, used + len(tokens))))

    def ids_of(self, tokens: list[str]) -> np.ndarray:
        if len(self.ids) > self.keep:
            self.forget()
        if new := set(tokens).difference(self.ids):
            self._learn(sorted(new))
        return np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens))

    def logits(self, texts: list[list[str]]) -> np.ndarray:
        """Highest window logit of each text."""
        flat = [t for words in texts for t in words]
        every = Windows(self.ids_of(flat), np.array([len(t) for t in texts], np.int64))
        out = np.empty(len(every), np.float32)
        full = every.begins + WINDOW <= every.ends
        for which, masked in ((np.flatnonzero(full), False), (np.flatnonzero(~full), True)):
            for i in range(0, len(which), TOGETHER):
                ids, real = every.at(which[i : i + TOGETHER])
                out[which[i : i + TOGETHER]] = self.net.forward(self.table, ids, real.astype(np.float32) if masked else None)
        return np.maximum.reduceat(out, np.cumsum(every.n) - every.n) if len(out) else out

    def score(self, texts: list[str]) -> np.ndarray:
        """Probabilities, some texts at a time; very long texts go in parts that overlap by a window."""
        out, group, held = [], [], 0
        parts: list[int] = []

        def flush():
            nonlocal group, held
            if group:
                out.append(self.logits(group))
            group, held = [], 0

        most = 1 << 17
        for text in texts:
            words = tokens(text)
            cuts = [words] if len(words) <= most else [words[i : i + most + WINDOW] for i in range(0, len(words) - WINDOW, most)]
            parts.append(len(cuts))
            for cut in cuts:
                group.append(cut)
                held += len(cut)
                if held > most:
                    flush()
        flush()
        if not parts:
            return np.zeros(0)
        starts = np.cumsum(parts) - parts
        best = np.clip(np.maximum.reduceat(np.concatenate(out), starts).astype(np.float64), -12, 12)
        return 1 / (1 + np.exp(-np.clip(self.net.scale * best + self.net.shift, -30, 30)))


def leans(seen: np.ndarray, bad: np.ndarray, rate: float) -> np.ndarray:
    """Log odds of the label among `seen` texts that hold a word (`bad` of them toxic), less those of all
    texts (`rate`), drawn towards 0."""
    rate = min(max(rate, 0.001), 0.999)
    odds = np.log((bad + DOUBT * rate) / (seen - bad + DOUBT * (1 - rate))) - np.log(rate / (1 - rate))
    return np.where(seen >= LEAN_TEXTS, np.clip(odds / 2, -2, 4), 0).astype(np.float32)


def train(texts: list[str], toxic: list[int], sample: int = SAMPLE) -> Network:
    """Fit the network on texts with labels 0 or 1.

    Equal texts count once. Every fifth text is kept back: it picks the best round and sets the
    probability scale. While training, a text's leans come from the other half of the texts, so that
    its own label never speaks for it; afterwards they come from all.
    """
    once = dict(zip(texts[:sample], toxic[:sample]))
    y = np.array(list(once.values()), np.float32)
    number: dict[str, int] = {"": 0}
    ids, held = [], []
    for text in once:
        own = np.fromiter((number.setdefault(w.strip(_ENDS), len(number)) for w in tokens(text)), np.int32)
        ids.append(own)
        held.append(np.unique(own[own > 0]))
    names, v = list(number), len(number)
    rest = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    half = np.where(rest, 2, np.arange(len(y)) % 2)

    def counts(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        every = [np.zeros(0, np.int32), *[held[i] for i in np.flatnonzero(of)]]
        bad = [np.zeros(0, np.int32), *[held[i] for i in np.flatnonzero(of & (y > 0))]]
        return tuple(np.bincount(np.concatenate(x), minlength=v).astype(np.float32) for x in (every, bad)) + (float(y[of].mean()) if of.any() else 0.5,)

    by_half = np.stack([leans(*counts(half == 1)), leans(*counts(half == 0)), leans(*counts(half != 2))])
    seen, all_leans = counts(half != 2)[0], leans(*counts(half >= 0))
    common = np.flatnonzero(seen >= LEAST_TEXTS)
    common = common[np.lexsort((common, -seen[common]))][:WORDS]
    net = Network.fresh([names[i] for i in common], {names[i]: float(all_leans[i]) for i in np.flatnonzero(all_leans)})
    if not len(y) or y.min() == y.max():
        return net
    # a text's words are numbered apart by the half it is in, whose leans they take
    flat = np.concatenate([own + v * k for own, k in zip(ids, half.astype(np.int32))])
    every = Windows(flat, np.array([len(x) for x in ids], np.int64))
    lean, of = by_half.ravel(), np.repeat(np.arange(len(y)), every.n)
    first = np.cumsum(every.n) - every.n
    moment = {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in net.p.items()}
    rng, step = np.random.default_rng(11), 0
    fit = np.flatnonzero(~rest)
    judge = np.flatnonzero(rest) if rest.any() else fit
    best = (np.inf, net.p, None)

    def given(which) -> tuple:
        words, real = every.at(which)
        used, local = np.unique(words, return_inverse=True)
        made = net.inputs([names[i % v] for i in used.tolist()], lean[used])
        return made, net.project(made[0]), local.reshape(words.shape), real.astype(np.float32)

    def highest() -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for i in range(0, len(every), TOGETHER):
            _, table, local, real = given(slice(i, i + TOGETHER))
            parts.append(net.forward(table, local, real))
        logits = np.concatenate(parts)
        top = np.maximum.reduceat(logits, first)
        hit = np.flatnonzero(logits == top[of])
        return hit[np.unique(of[hit], return_index=True)[1]], top

    # at first a text's window is the one with the strongest lean
    strong = np.concatenate([np.where(r, lean[w], -9).max(axis=1) for w, r in (every.at(slice(i, i + TOGETHER)) for i in range(0, len(every), TOGETHER))])
    pick = np.lexsort((strong, of))[np.cumsum(every.n) - 1]
    batches = max(1, len(fit) // BATCH)
    for _ in range(ROUNDS):
        for _ in range(max(EPOCHS, -(-STEPS // (ROUNDS * batches)))):
            for part in np.array_split(rng.permutation(fit), batches):
                step += 1
                made, table, local, mask = given(pick[part])
                keep: list = []
                logits = net.forward(table, local, mask, keep)
                slope = (1 / (1 + np.exp(-logits)) - y[part]) / len(part)
                _update(net, net.backward(table, local, mask, keep, slope.astype(np.float32)), made, moment, step)
        pick, top = highest()
        loss = np.logaddexp(0, np.where(y[judge] > 0, -top[judge], top[judge])).mean()
        if loss < best[0]:
            best = (loss, {k: w.copy() for k, w in net.p.items()}, top)
    _, net.p, top = best
    if rest.any() and top is not None:
        net.scale, net.shift = _logistic(top[rest].astype(np.float64), y[rest])
    return net


def _update(net: Network, g: dict, made: tuple, moment: dict, step: int) -> None:
    """One Adam step with decay of the word and character vectors."""
    x, rows, grams, count = made
    d_x = 0
    for side in (0, 1):
        d = g["table"][:, side * 3 * HIDDEN : (side + 1) * 3 * HIDDEN]
        g[f"x{side}"], g[f"b{side}"] = x.T @ d, d.sum(axis=0)
        d_x = d_x + d @ net.p[f"x{side}"].T
    g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
    np.add.at(g["word"], rows, d_x[:, 1 : 1 + WORD_DIM])
    np.add.at(g["char"], grams, np.repeat(d_x[:, 1 + WORD_DIM :] / np.maximum(count, 1)[:, None], count, axis=0))
    for k, v in net.p.items():
        a, b = moment[k]
        a += 0.1 * (g[k] - a)
        b += 0.001 * (g[k] * g[k] - b)
        v -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-6)
        if k in ("word", "char"):
            v *= 1 - DECAY


def _logistic(x: np.ndarray, y: np.ndarray, trust: float = 4.0) -> tuple[float, float]:
    """Slope (0.2 to 3) and shift of a logistic fit, drawn towards (1, 0) as if by a few rows."""
    w = np.array([1.0, 0.0])
    a = np.stack([np.clip(x, -12, 12), np.ones_like(x)])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(w @ a, -30, 30)))
        grad = a @ (q - y) + trust * (w - [1, 0])
        move = np.linalg.solve((a * (q * (1 - q))) @ a.T + trust * np.eye(2), grad)
        w = w - np.clip(move, -0.5, 0.5)
        if np.abs(move).max() < 1e-8:
            break
    return float(np.clip(w[0], 0.2, 3)), float(w[1])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE) -> Network:
    """Train on at most `sample` labelled rows, picked by a hash of their ids; held-out ids take no part.

    Rows without id, label or text are passed over. Without both labels the network stays as begun.
    """
    known = labels.select(column(labels, doc_id).cast("long").alias("id"), (column(labels, toxic) > 0).cast("int").alias("toxic"))
    known = known.filter(F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(column(docs, doc_id).cast("long").alias("id"), column(docs, text).alias("text")).filter(F.col("text").isNotNull())
    rows = rows.join(F.broadcast(known), "id").orderBy(F.xxhash64("id"), "id").limit(sample).collect()  # at most `sample` rows
    return train([r["text"] for r in rows], [r["toxic"] for r in rows], sample)


def score(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, score. NULL is scored as the empty text, which has one empty window.

    Repeated rows are kept, an empty table gives no rows. The weights, of bounded size, are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        scorer = _worker(shared)
        return lambda cols: {"doc_id": cols["doc_id"], "score": scorer.score(cols["text"]).tolist()}

    narrow = docs.select(column(docs, doc_id).cast("long").alias("doc_id"), F.coalesce(column(docs, text), F.lit("")).alias("text"))
    return map_batches(narrow, "doc_id long, score double", make)


def below(docs: DataFrame, net: Network, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose text scores below the threshold, unchanged, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score_of(texts: pd.Series) -> pd.Series:
        return pd.Series(_worker(shared).score(["" if t is None else t for t in texts]), dtype="float64")

    rows = packed(docs, score=score_of(column(docs, text)))
    return unpacked(rows.filter(F.col("score") < threshold), docs)


_BUILT: list = []


def _worker(shared) -> Scorer:
    if not _BUILT or _BUILT[0] is not shared.value:
        _BUILT[:] = [shared.value, Scorer(shared.value)]
    return _BUILT[1]
