"""Secret scans: exact patterns, and a character convolutional network over every candidate.

Candidates are all runs of secret-like characters of some length. For each, the network sees the run
(a long one in overlapping windows, of which the likeliest counts) and the characters around it: embedded characters, one convolution, maximum and mean over places, a
hidden layer. It is trained on labelled findings from all texts: windows that a pattern finds are positive,
others negative, a bounded sample of each kind. One part of it sets the probability scale (a logistic
fit); all labelled windows that training did not take set the threshold, which never costs more recall
than wanted. Candidates above it that no pattern covers are added; what the patterns find always stays.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import column, map_batches
from tabsmith.session import materialize

#: Fixed patterns: kind, pattern, and the least length of the group that counts. In order of listing.
PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
]
KINDS = {k: i for i, k in enumerate([*(p[0] for p in PATTERNS), "learned"])}
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Characters seen: of the run itself, and before and after it. Longer runs are seen in windows, each so far from the last at most.
RUN = 40
STRIDE = 20
BEFORE = 24
AFTER = 8
WIDTH = RUN + BEFORE + AFTER
EMBED = 8
KERNEL = 5
#: Where a convolution's places begin and end: in the run, before it, and those that reach the last characters after it.
PLACES = ((BEFORE, BEFORE + RUN), (0, BEFORE), (BEFORE + RUN, WIDTH - KERNEL + 1))
FILTERS = 16
HIDDEN = 16
#: Characters of a finding that a window of a long run must hold to be one, or the whole finding.
HELD = 16
#: Windows of each kind of finding, and of none, that training takes at most.
SAMPLE = 3000
#: Windows whose hash leaves so much modulo 10, or more, are kept from training.
JUDGED = 8
#: Parts of a unit of log odds in which windows are counted for the threshold.
BINS = 1000
EPOCHS = 6
#: Steps of training at least, so that a small sample is gone through more often.
STEPS = 400
RECALL = 0.99
#: Probability that a threshold has at least, unless the recall needs a lower one.
FLOOR = 0.5


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind as listed; leftmost, non-overlapping for each kind."""
    found = [
        (m.start(), m.end(), kind)
        for kind, pattern, group, least in PATTERNS
        for m in pattern.finditer(text)
        if m.end(group) - m.start(group) >= least
    ]
    return sorted(found, key=lambda x: (x[0], KINDS[x[2]]))


def codes(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Character codes (0 to 127) around each span: BEFORE, the first RUN of it, AFTER its end. 0 is nothing, 127 not ASCII."""
    out = np.zeros((len(spans), WIDTH), np.uint8)
    for row, (s, e) in zip(out, spans):
        before, run, after = text[max(0, s - BEFORE) : s], text[s : min(e, s + RUN)], text[e : e + AFTER]
        for at, part in ((BEFORE - len(before), before), (BEFORE, run), (BEFORE + RUN, after)):
            raw = part.encode("ascii", "replace") if part.isascii() else bytes(ord(c) if c.isascii() else 127 for c in part)
            row[at : at + len(raw)] = np.frombuffer(raw, np.uint8)
    return out


@dataclass
class Network:
    p: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 1.1

    @staticmethod
    def fresh() -> Network:
        rng = np.random.default_rng(5)
        draw = lambda *s: (rng.standard_normal(s) * np.sqrt(2 / s[0])).astype(np.float32)
        return Network({
            "char": (0.3 * rng.standard_normal((128, EMBED))).astype(np.float32), "conv": draw(KERNEL * EMBED, FILTERS),
            "b1": np.zeros(FILTERS, np.float32), "hid": draw(6 * FILTERS, HIDDEN), "b2": np.zeros(HIDDEN, np.float32),
            "out": draw(HIDDEN), "b3": np.zeros(1, np.float32),
        })

    def forward(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits. Maximum and mean are taken over the run, what is before and what is after it apart."""
        p, n, steps = self.p, len(x), WIDTH - KERNEL + 1
        seen = np.lib.stride_tricks.sliding_window_view(p["char"][x], KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(n * steps, -1)
        map_ = np.maximum(seen @ p["conv"] + p["b1"], 0).reshape(n, steps, FILTERS)
        pooled = np.concatenate([f(map_[:, a:b], axis=1) for a, b in PLACES for f in (np.max, np.mean)], axis=1)
        hid = np.maximum(pooled @ p["hid"] + p["b2"], 0)
        if keep is not None:
            keep += [seen, map_, pooled, hid]
        return hid @ p["out"] + p["b3"][0]

    def backward(self, x: np.ndarray, keep: list, slope: np.ndarray) -> dict[str, np.ndarray]:
        p, (seen, map_, pooled, hid) = self.p, keep
        g = {"out": hid.T @ slope, "b3": np.array([slope.sum()], np.float32)}
        d_hid = slope[:, None] * p["out"] * (hid > 0)
        g["hid"], g["b2"] = pooled.T @ d_hid, d_hid.sum(axis=0)
        d_pool = d_hid @ p["hid"].T
        d_map = np.zeros_like(map_)
        for i, (a, b) in enumerate(PLACES):
            part, d_max = map_[:, a:b], d_pool[:, 2 * i * FILTERS : (2 * i + 1) * FILTERS]
            top = part.argmax(axis=1)
            np.put_along_axis(d_map[:, a:b], top[:, None], np.take_along_axis(d_map[:, a:b], top[:, None], 1) + d_max[:, None], 1)
            d_map[:, a:b] += d_pool[:, None, (2 * i + 1) * FILTERS : (2 * i + 2) * FILTERS] / (b - a)
        d_map = (d_map * (map_ > 0)).reshape(len(seen), FILTERS)
        g["conv"], g["b1"] = seen.T @ d_map, d_map.sum(axis=0)
        d_seen = (d_map @ p["conv"].T).reshape(len(x), -1, KERNEL, EMBED)
        g["char"] = np.zeros_like(p["char"])
        for k in range(KERNEL):
            np.add.at(g["char"], x[:, k : k + d_seen.shape[1]], d_seen[:, :, k])
        return g

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds on the probability scale."""
        logits = [self.forward(x[i : i + 256]) for i in range(0, len(x), 256)]
        z = np.concatenate(logits).astype(np.float64) if logits else np.zeros(0)
        return np.clip(self.scale * z + self.shift, -30, 30)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.odds(x)))

    def admit(self, most: float, others: float) -> None:
        """Set the threshold from the probability that keeps the recall and that of the bulk of the others.

        At most the first; halfway (in log odds) down to the second leaves room for new contexts.
        """
        odds = [np.log(q / (1 - q)) for q in np.clip([most, others], 1e-9, 1 - 1e-9)]
        self.threshold = min(most, max(FLOOR, float(1 / (1 + np.exp(-np.mean(odds))))))


def train(x: np.ndarray, y: np.ndarray, recall: float = RECALL) -> Network:
    """Fit on candidates with labels; without both labels the threshold admits nothing.

    Of ten, seven train, one sets the scale and two the threshold: FLOOR or more, halfway between the
    positives and the bulk of the negatives, but never so high that `recall` of the positives is not kept.
    """
    order = np.random.default_rng(3).permutation(len(y))
    learned, scale, judge = np.split(order, [int(0.7 * len(y)), int(0.8 * len(y))])
    net = learn(x, y, learned, scale)
    if net is None:
        return Network.fresh()
    p, bad = net.probability(x[judge]), y[judge] == 0
    if not bad.all():
        net.admit(float(np.quantile(p[~bad], 1 - recall, method="lower")), float(np.quantile(p[bad], 0.99)) if bad.any() else 0.0)
    return net


def learn(x: np.ndarray, y: np.ndarray, fit: np.ndarray, scale: np.ndarray) -> Network | None:
    """Weights from the rows `fit`, the probability scale from the rows `scale`; None for few rows or one label."""
    if len(y) < 20 or y.min() == y.max():
        return None
    net, rng = Network.fresh(), np.random.default_rng(3)
    moment, step = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}, 0
    batches = max(1, len(fit) // 64)
    for _ in range(max(EPOCHS, -(-STEPS // batches))):
        for part in np.array_split(rng.permutation(fit), batches):
            step += 1
            keep: list = []
            slope = ((1 / (1 + np.exp(-net.forward(x[part], keep))) - y[part]) / len(part)).astype(np.float32)
            g = net.backward(x[part], keep, slope)
            for k, v in net.p.items():
                a, b = moment[k]
                a += 0.1 * (g[k] - a)
                b += 0.001 * (g[k] * g[k] - b)
                v -= 0.004 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-6)
    z = np.clip(np.concatenate([net.forward(x[scale]), np.zeros(0, np.float32)]).astype(np.float64), -12, 12)
    w, a = np.array([1.0, 0.0]), np.stack([z, np.ones_like(z)])
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(w @ a, -30, 30)))
        move = np.linalg.solve((a * (q * (1 - q))) @ a.T + 2 * np.eye(2), a @ (q - y[scale]) + 2 * (w - [1, 0]))
        w = w - np.clip(move, -0.5, 0.5)
    net.scale, net.shift = float(max(w[0], 0.1)), float(w[1])
    return net


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """Overlapping windows of RUN characters over a run, the last up to its end; a short run is one."""
    if end - start <= RUN:
        return [(start, end)]
    return [(s, s + RUN) for s in [*range(start, end - RUN, STRIDE), end - RUN]]


def candidates(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[int]]:
    """Candidates of a text, all their windows, and how many windows each has."""
    spans = [m.span() for m in CANDIDATE.finditer(text)]
    every = [windows(*span) for span in spans]
    return spans, [w for ws in every for w in ws], [len(ws) for ws in every]


def labelled(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """Windows of the candidates of a text, and whether they hold a pattern's finding."""
    every, kinds = with_kinds(text)
    return every, [int(k > 0) for k in kinds]


def with_kinds(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """Windows of the candidates of a text, and the pattern (from 1) whose finding they hold, or enough of; 0 for none.

    Where a candidate is one window, any touch counts.
    """
    base = base_spans(text)
    begins, reach = [b[0] for b in base], np.maximum.accumulate([b[1] for b in base]).tolist() if base else []
    _, every, counts = candidates(text)
    kinds = []
    for (s, e), n in zip(every, [n for n in counts for _ in range(n)]):
        k, yes = bisect_right(begins, e - 1), 0
        while k and reach[k - 1] > s and not yes:
            k -= 1
            s2, e2, kind = base[k]
            if min(e, e2) - max(s, s2) >= (min(HELD, e2 - s2) if n > 1 else 1):
                yes = 1 + KINDS[kind]
        kinds.append(yes)
    return every, kinds


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, recall: float = RECALL) -> Network:
    """Train on windows of all texts' candidates, at most `sample` of each kind of finding and of none, picked by a hash.

    Equal windows in equal surroundings count once. All windows not trained on set the threshold; where none of them
    is positive, all labelled ones do. An empty table gives a network that adds nothing.
    """

    def make():
        def run(cols):
            rows = {"seen": [], "kind": [], "order": []}
            for t in cols["text"]:
                spans, kinds = with_kinds(t)
                for code, kind in zip(codes(t, spans), kinds):
                    raw = code.tobytes()
                    rows["seen"].append(raw)
                    rows["kind"].append(kind)
                    rows["order"].append(int.from_bytes(sha256(raw).digest()[:7], "big"))
            return rows

        return run

    narrow = docs.select(column(docs, text).alias("text")).filter(F.col("text").isNotNull())
    found = map_batches(narrow, "seen binary, kind int, order long", make)
    found = found.groupBy("seen", "order", (F.col("kind") > 0).alias("label")).agg(F.min("kind").alias("kind"))
    found = materialize(found, "windows")
    kinds = range(1 + len(PATTERNS))
    for judged in (F.col("order") % 10 >= JUDGED, F.lit(False)):  # all train where that leaves one label only
        picked = [found.filter((F.col("kind") == k) & ~judged).orderBy("order", "seen").limit(sample) for k in kinds]
        rows = sorted((r["order"], r["kind"], bytes(r["seen"])) for r in reduce(DataFrame.unionByName, picked).collect())  # a sample of each kind
        y = np.array([r[1] > 0 for r in rows], np.float32)
        if len(y) and y.min() < y.max():
            break
    x = np.array([np.frombuffer(r[2], np.uint8) for r in rows], np.uint8).reshape(len(rows), WIDTH)
    net = learn(x, y, *np.split(np.random.default_rng(3).permutation(len(y)), [int(0.875 * len(y))]))
    if net is None:
        return Network.fresh()
    last = [max(own) if len(own := [r[0] for r in rows if r[1] == k]) >= sample else None for k in kinds]
    beyond = [(F.col("kind") == k) & (F.col("order") > at) for k, at in enumerate(last) if at is not None]
    counts = _odds_counts(found.filter(reduce(Column.__or__, beyond, judged)), net)
    if not any(yes for yes, _, _ in counts):
        counts = _odds_counts(found, net)
    most = _place(sorted((b, n) for yes, b, n in counts if yes), 1 - recall, np.floor)
    others = _place(sorted((b + 1, n) for yes, b, n in counts if not yes), 0.99, np.ceil)
    net.admit(*(1 / (1 + np.exp(-b / BINS)) for b in (most, others)))
    return net


def _odds_counts(found: DataFrame, net: Network) -> list[tuple[bool, int, int]]:
    """How many windows of either label have their log odds in each bin: at most two times 60 BINS rows."""
    shared = found.sparkSession.sparkContext.broadcast(net)

    def make():
        def run(cols):
            x = np.frombuffer(b"".join(cols["seen"]), np.uint8).reshape(-1, WIDTH)
            return {"label": cols["label"], "bin": np.floor(shared.value.odds(x) * BINS).astype(np.int64)}

        return run

    bins = map_batches(found.select("seen", "label"), "label boolean, bin long", make)
    return [tuple(r) for r in bins.groupBy("label", "bin").count().collect()]


def _place(counts: list[tuple[int, int]], share: float, whole) -> float:
    """The bin in which a quantile lies, its place rounded by `whole`; the least log odds without any."""
    if not counts:
        return -30.0 * BINS
    sums = np.cumsum([n for _, n in counts])
    return float(counts[int(np.searchsorted(sums, whole((sums[-1] - 1) * share), side="right"))][0])


def added_spans(text: str, base: list[tuple[int, int, str]], spans: list[tuple[int, int]], likely: np.ndarray) -> list[tuple[int, int, str]]:
    """Candidates judged secret that no base span touches."""
    begins = [b[0] for b in base]
    reach = np.maximum.accumulate([b[1] for b in base]).tolist() if base else []
    out = []
    for (s, e), yes in zip(spans, likely):
        k = bisect_right(begins, e - 1)
        if yes and not (k and reach[k - 1] > s):
            out.append((s, e, "learned"))
    return out


def scan(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_learned.

    spans is kind:start:end by start, then kind, joined by commas; base_sha256 digests those of the
    patterns alone. NULL and empty texts have none. Repeated rows are kept; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        def run(cols):
            net = shared.value
            texts = cols["text"]
            base = [base_spans(t) for t in texts]
            found = [candidates(t) for t in texts]
            likely = []
            for i in range(0, len(texts), 512):
                part = found[i : i + 512]
                p = net.probability(np.concatenate([codes(t, w) for t, (_, w, _) in zip(texts[i : i + 512], part)]))
                n = np.array([n for _, _, counts in part for n in counts], np.int64)
                likely.append((np.maximum.reduceat(p, np.cumsum(n) - n) if len(n) else p) >= net.threshold)
            yes, at = np.concatenate(likely), 0
            out: dict = {"doc_id": cols["doc_id"], "n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": [], "n_learned": []}
            for t, b, (c, _, _) in zip(texts, base, found):
                more = added_spans(t, b, c, yes[at : at + len(c)])
                at += len(c)
                for kind in ("assign", "access", "hex"):
                    out[f"n_{kind}"].append(sum(x[2] == kind for x in b))
                out["base_sha256"].append(sha256(_joined(b).encode()).hexdigest())
                out["spans"].append(_joined(sorted(b + more, key=lambda x: (x[0], KINDS[x[2]]))))
                out["n_learned"].append(len(more))
            return out

        return run

    narrow = docs.select(column(docs, doc_id).cast("long").alias("doc_id"), F.coalesce(column(docs, text), F.lit("")).alias("text"))
    return map_batches(
        narrow, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_learned long", make
    )


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
