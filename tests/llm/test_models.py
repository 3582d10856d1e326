"""Language identification, secrets and toxicity: rules exactly, models on held-out rows."""

import random
import re
from hashlib import sha256

import numpy as np
import pytest

from tabsmith.llm import langid, secret_scan, toxicity

SOUNDS = {"aa": "ka lo mi nu", "bb": "che rru ña tio", "cc": "sch ung ei ßt"}


def prose(r, lang, n=40):
    return " ".join("".join(r.choice(SOUNDS[lang].split()) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_languages(frames, odd_rows):
    r = random.Random(1)
    rows = [(i, prose(r, lang, r.randint(1, 60)), lang, "s") for i, lang in enumerate(list(SOUNDS) * 60)]
    train, test = rows[:120], rows[120:]
    model = langid.fit(frames(train + [(500, None, "aa", "s"), (501, "no label", None, "s")]))
    assert model.langs == ["aa", "bb", "cc"]
    got = {x["doc_id"]: x for x in langid.predict(frames(test), model).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang, _ in test) >= 0.95 * len(test)
    odd = langid.predict(frames(), model).collect()
    assert len(odd) == len(odd_rows)
    for x in odd:
        assert 0 <= x["score"] <= 1
    texts = [(1, None), (2, ""), (3, "12 $ -- 5"), (4, "²³"), (5, "x" * 30_000), (6, "日本")]
    ends = {x["doc_id"]: x for x in langid.predict(frames([(i, t, None, None) for i, t in texts]), model).collect()}
    assert all(ends[i]["lang_pred"] == "und" and ends[i]["score"] == 0 for i in (1, 2, 3, 4))
    assert all(ends[i]["lang_pred"] in model.langs for i in (5, 6))
    nothing = langid.fit(frames([]))
    assert {x["lang_pred"] for x in langid.predict(frames(), nothing).collect()} == {"und"}
    assert langid.predict(frames([]), model).count() == 0


def test_kept_keys_have_their_counts_in_every_language(frames):
    rows = [(1, "ka " * 9 + "lo " * 5, "aa", "s"), (2, "che " * 9 + "ka " * 8, "bb", "s")]
    model = langid.fit(frames(rows), words=1, grams=1)
    assert sorted(model.words) == ["che", "ka"]
    assert np.allclose(model.words["ka"], np.log([9 / 14, 8 / 17]))
    assert np.allclose(model.words["che"], np.log([0.5 / 14, 9 / 17]))


def test_texts_without_spaces_are_read_to_their_end(frames):
    start, one, two = "xyz" * 8, "kalomi" * 20, "cheunr" * 20
    model = langid.fit(frames([(1, start + one, "aa", "s"), (2, start + two, "bb", "s")]))
    assert all(w in model.words for w in langid.words_of(one))
    texts = [(1, start + one, None, None), (2, start + two, None, None)]
    got = {x["doc_id"]: x["lang_pred"] for x in langid.predict(frames(texts), model).collect()}
    assert got == {1: "aa", 2: "bb"}
    assert "".join(langid.words_of(start + one)) == start + one


def test_backoff_covers_unseen_words():
    log = lambda *p: np.log(np.array(p))
    model = langid.Model(["x", "y"], {"known": log(0.9, 0.1)}, {" ab": log(0.8, 0.2), "c": log(0.1, 0.9), " ": log(0.5, 0.5)})
    want = (log(0.8, 0.2) + langid.STEP + log(0.1, 0.9) + 3 * langid.STEP + log(0.5, 0.5) + 3 * langid.STEP) / 3
    assert np.allclose(model.unseen_word("abc"), want)
    scores = langid.Scores(model)
    assert np.allclose(scores.of(["known", "known"]), log(0.9, 0.1))
    assert np.allclose(scores.of(["z" * 90] * 3), scores.of(["z" * 90]))


ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_spans(text):
    found = [("assign", m) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [("access", m) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ["assign", "access", "hex"]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in sorted(found, key=lambda x: (x[1].start(), order.index(x[0])))]


def test_base_spans_are_exact(frames, odd_rows):
    r = random.Random(2)
    parts = ["password", "PassWd", "api_key", "APIKEY", "token", "ſecret", "=", ":", " ", '"', "'", "abc123", "AKIA", "AKIAAKIA", "ABCDEFGHIJ123456", "é", "a" * 11, "0f" * 14, "G", "."]
    rows = odd_rows + [(600 + i, "".join(r.choice(parts) for _ in range(r.randint(1, 25))), "en", "s") for i in range(300)]
    df = frames(rows)
    got = secret_scan.scan(df, secret_scan.fit(df)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), sha256(",".join(plain_spans(t or "")).encode()).hexdigest()) for i, t, _, _ in rows)
    assert sorted((str(x["doc_id"]), x["base_sha256"]) for x in got) == want
    by_id = {i: plain_spans(t or "") for i, t, _, _ in rows if i and i >= 600}
    for x in got:
        if x["doc_id"] in by_id:
            base = by_id[x["doc_id"]]
            spans = x["spans"].split(",") if x["spans"] else []
            assert [s for s in spans if not s.startswith("learned")] == base
            assert [sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")] == [x["n_assign"], x["n_access"], x["n_hex"]]
    assert secret_scan.scan(frames([]), secret_scan.Network.fresh()).count() == 0


def test_network_finds_what_patterns_miss():
    r = random.Random(3)
    hexes = lambda n, s="0123456789abcdef": "".join(r.choice(s) for _ in range(n))
    texts = [f"words before token = {hexes(40)} and after" for _ in range(300)]
    texts += ["prose " + "".join(r.choice(["tion", "ing", "her", "and"]) for _ in range(8)) + " goes on" for _ in range(600)]
    x, y = [], []
    for t in texts:
        spans, labels = secret_scan.labelled(t)
        x.append(secret_scan.codes(t, spans))
        y += labels
    net = secret_scan.train(np.concatenate(x), np.array(y, np.float32))
    fresh = [f"see token is {hexes(40, '0123456789ABCDEF')} here" for _ in range(40)]
    plain = ["other " + "".join(r.choice(["tion", "ing", "her", "and"]) for _ in range(7)) + " text" for _ in range(40)]
    hit = lambda ts: np.mean([net.probability(secret_scan.codes(t, secret_scan.labelled(t)[0])).max(initial=0) >= net.threshold for t in ts])
    assert hit(plain) == 0 and hit([f"again token = {hexes(40)}" for _ in range(40)]) >= 0.95
    assert hit(fresh) >= 0.5


def test_long_runs_are_seen_to_their_end(frames):
    filler = "/".join(["tion", "ing", "her", "and"] * 8)
    text = f"see {filler}/token=0123456789abcdef0123 here"
    every, labels = secret_scan.labelled(text)
    seen = {i for s, e in every for i in range(s, e)}
    run = secret_scan.CANDIDATE.search(text)
    assert seen == set(range(*run.span())) and all(e - s <= secret_scan.RUN for s, e in every)
    assert labels[0] == 0 and labels[-1] == 1

    r = random.Random(5)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    plain = lambda n: "/".join(r.choice(["tion", "ing", "her", "and"]) for _ in range(n))
    texts = [f"see {plain(14)}/token={hexes(30)} here" for _ in range(200)] + [f"other {plain(24)} text" for _ in range(200)]
    made = [(secret_scan.codes(t, secret_scan.labelled(t)[0]), secret_scan.labelled(t)[1]) for t in texts]
    net = secret_scan.train(np.concatenate([x for x, _ in made]), np.array([k for _, y in made for k in y], np.float32))
    new = [(i, f"see {plain(14)}/{hexes(23)}Z here" if i < 20 else f"other {plain(24)} text", "en", "s") for i in range(40)]
    got = {x["doc_id"]: x["n_learned"] for x in secret_scan.scan(frames(new), net).collect()}
    assert sum(got[i] for i in range(20)) >= 15 and sum(got[i] for i in range(20, 40)) == 0


def test_threshold_counts_every_finding_not_trained_on(frames, monkeypatch):
    r = random.Random(6)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    texts = [f"token = {hexes(36)} and so on" for _ in range(300)] + [f"words {'ting/' * r.randint(4, 7)}{i} on" for i in range(300)]
    df = frames([(i, t, "en", "s") for i, t in enumerate(texts)])
    judged, learned = [], []
    counts, learn = secret_scan._odds_counts, secret_scan.learn
    monkeypatch.setattr(secret_scan, "_odds_counts", lambda f, net: judged.append(f.count()) or counts(f, net))
    monkeypatch.setattr(secret_scan, "learn", lambda x, y, *of: learned.append(len(y)) or learn(x, y, *of))
    net = secret_scan.fit(df, sample=40)
    assert learned[0] >= 80 and judged[0] + learned[0] == len({secret_scan.codes(t, [s]).tobytes() for t in texts for s in secret_scan.labelled(t)[0]})
    assert secret_scan.FLOOR <= net.threshold < 1
    x = np.concatenate([secret_scan.codes(t, secret_scan.labelled(t)[0]) for t in texts[:300]])
    assert np.mean(net.probability(x) >= net.threshold) >= 0.99
    # two findings in many texts are enough to be looked for
    few = secret_scan.fit(frames([(i, t, "en", "s") for i, t in enumerate(texts[298:])]))
    assert few.threshold <= 1


def test_all_of_the_surroundings_count():
    net = secret_scan.Network.fresh()
    x = np.full((2, secret_scan.WIDTH), ord("a"), np.uint8)
    x[1, -1] = ord("}")
    assert abs(float(np.subtract(*net.forward(x)))) > 0


def test_secret_gradients():
    net = secret_scan.Network.fresh()
    for k in net.p:
        net.p[k] = net.p[k].astype(float)
    r = np.random.default_rng(1)
    x, slope, keep = r.integers(0, 128, (5, secret_scan.WIDTH)).astype(np.uint8), r.standard_normal(5), []
    net.forward(x, keep)
    g = net.backward(x, keep, slope)
    for k, v in net.p.items():
        at = tuple(int(r.integers(0, n)) for n in v.shape) if k != "char" else (int(x[0, 30]), 2)
        old, eps = v[at], 1e-6
        v[at] = old + eps
        up = float(net.forward(x) @ slope)
        v[at] = old - eps
        down = float(net.forward(x) @ slope)
        v[at] = old
        assert (up - down) / (2 * eps) == pytest.approx(g[k][at], abs=1e-5), k


def toxic_rows(n=700):
    r = random.Random(4)
    words = [f"{a}{b}" for a in "ba ke li mo nu".split() for b in "ra se ti vo zu".split()]
    rows, labels = [], []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(5, 150))]
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            text.insert(r.randrange(len(text)), r.choice(["grumph", "Blarg!", "snork"]))
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark, frames, odd_rows):
    rows, labels = toxic_rows()
    table = spark.createDataFrame([*labels, (None, 1), (5000, None), (6000, 1), (3, 0)], "doc_id long, toxic int")
    df = frames(rows)
    net = toxicity.fit(df, table)
    got = {x["doc_id"]: x["score"] for x in toxicity.score(df, net).collect()}
    import zlib

    out = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    truth = dict(labels)
    caught = [got[i] >= toxicity.THRESHOLD for i in out if truth[i]]
    false = [got[i] >= toxicity.THRESHOLD for i in out if not truth[i]]
    assert np.mean(caught) >= 0.9 and np.mean(false) <= 0.02
    odd = toxicity.score(frames(), net).collect()
    assert len(odd) == len(odd_rows) and all(0 <= x["score"] <= 1 for x in odd)
    kept = toxicity.below(df, net)
    assert kept.columns == df.columns and {x["doc_id"] for x in kept.select("doc_id").collect()} == {i for i, s in got.items() if s < toxicity.THRESHOLD}
    assert toxicity.score(frames([]), net).count() == toxicity.below(frames([]), net).count() == 0
    for none in (toxicity.fit(frames([]), table), toxicity.fit(df, table.limit(0))):
        assert all(0 <= x["score"] <= 1 for x in toxicity.score(frames(rows[:5]), none).collect())


def test_one_bad_word_anywhere_in_a_long_text_is_seen():
    rows, labels = toxic_rows()
    net = toxicity.train([r[1] for r in rows], [y for _, y in labels])
    clean = " ".join(r[1] for r in rows if r[0] % 4)[:200_000].split()
    scorer = toxicity.Scorer(net)
    base = scorer.score([" ".join(clean)])[0]
    for at in (0, 7, len(clean) // 2, len(clean)):
        text = " ".join([*clean[:at], "grumph", "snork", "blarg", *clean[at:]])
        assert scorer.score([text])[0] > max(0.7, base)


def test_tokens_cover_long_words():
    assert toxicity.tokens("A b-c " + "d" * 64) == ["a", "b-c", "d" * 64]
    for word in ("abcdefghij" * 50, "日本語の文章で" * 40, "é" * 33):
        pieces = toxicity.tokens(word)
        assert all(len(p.encode()) <= toxicity.TOKEN_BYTES for p in pieces)
        assert pieces[0] + "".join(p[2:] for p in pieces[1:]) == word
    assert toxicity.tokens("x" * 60 + ".grumph-snork") == ["x" * 60, "grumph", "snork"]


def test_bad_words_behind_the_start_of_a_long_token_are_seen():
    rows, labels = toxic_rows()
    net = toxicity.train([r[1] for r in rows], [y for _, y in labels])
    scorer = toxicity.Scorer(net)
    clean = "-".join(next(r[1] for r in rows if r[0] % 4 and len(r[1]) > 300).split()[:20])
    bad = clean + ".grumph.snork.blarg"
    assert scorer.score([bad])[0] > max(0.7, scorer.score([clean])[0])


def test_windows_cover_and_overlap():
    sizes = np.array([0, 1, 31, 32, 33, 48, 49, 100])
    begins, n = toxicity.windows(sizes)
    at = np.cumsum(sizes) - sizes
    for i, size in enumerate(sizes):
        own = begins[np.cumsum(n)[i] - n[i] : np.cumsum(n)[i]] - at[i]
        seen = {w for b in own for w in range(b, min(b + toxicity.WINDOW, size))}
        assert seen == set(range(size)) and all(b - a <= toxicity.STRIDE for a, b in zip(own, own[1:]))


def test_toxicity_gradients():
    net = toxicity.Network.fresh(["a"], {})
    for k in net.p:
        net.p[k] = net.p[k].astype(float)
    r = np.random.default_rng(1)
    table, ids, slope = r.standard_normal((6, 6 * toxicity.HIDDEN)), r.integers(0, 6, (4, toxicity.WINDOW)), r.standard_normal(4)
    real = np.ones(ids.shape)
    real[2, 20:] = 0
    keep = []
    net.forward(table, ids, real, keep)
    g = net.backward(table, ids, real, keep, slope)
    for name, v in {"table": table, "u0": net.p["u0"], "u1": net.p["u1"], "att": net.p["att"], "out": net.p["out"]}.items():
        at = (1,) * v.ndim
        old, eps = v[at], 1e-2
        v[at] = old + eps
        up = float(net.forward(table, ids, real) @ slope)
        v[at] = old - eps
        down = float(net.forward(table, ids, real) @ slope)
        v[at] = old
        assert (up - down) / (2 * eps) == pytest.approx(float(g[name][at]), abs=2e-3), name
