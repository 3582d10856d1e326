"""Byte-level BPE and word-piece counts against their definitions."""

import random
from hashlib import sha256

import pytest

from tabsmith.llm import bpe, wordpiece

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = bpe.read_ranks(None, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
TEXTS = ["", " ", "\n\n  x", "it's the river's", "über Straße señor être", "日本語のテキスト", "😀😃 é", "a" * 3000, "-" * 700, "ab" * 900, "0123456789" * 9]


def encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.mark.parametrize("states", [1, 50, 100_000])
def test_pieces_encode_as_merged(states):
    r, transducer = random.Random(2), bpe.Transducer(RANKS, states=states, pairs=1000)
    alphabet = [b"a", b"e", b"th", b"ing", b" ", b"-", "é".encode(), "日".encode(), b"\xff", b"\x80", b"1"]
    for _ in range(1500):
        piece = b"".join(r.choice(alphabet) for _ in range(r.randint(1, 25)))
        assert transducer.encode(piece) == bpe.merge(piece, RANKS), piece


def test_small_vocabularies_where_merges_compete():
    r = random.Random(3)
    for _ in range(60):
        ranks = {bytes([c]): i for i, c in enumerate(b"abc")}
        while len(ranks) < 14:
            a, b = r.choice(list(ranks)), r.choice(list(ranks))
            if len(a + b) < 7:
                ranks.setdefault(a + b, len(ranks))
        transducer = bpe.Transducer(ranks, states=r.choice([2, 1000]))
        for _ in range(80):
            piece = bytes(r.choice(b"abc") for _ in range(r.randint(1, 18)))
            assert transducer.encode(piece) == bpe.merge(piece, ranks), (ranks, piece)


def test_whole_texts_as_tiktoken(frames, odd_rows):
    rows = odd_rows + [(500 + i, t, "en", "s") for i, t in enumerate(TEXTS)]
    got = bpe.round_trip(frames(rows), RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    own, want = encoding(), []
    for i, text, _, _ in rows:
        ids = own.encode_ordinary(text or "")
        joined = ",".join(map(str, ids))
        want.append((i, len(ids), sha256(joined.encode()).hexdigest(), sha256((text or "").encode()).hexdigest(), ids))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_encode_then_decode(frames, odd_rows):
    df = frames()
    back = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS)
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(str((i, t or "")) for i, t, _, _ in odd_rows)
    assert bpe.round_trip(frames([]), RANKS, public_tokenizers.PATTERN).count() == 0


def test_streaming_decoder():
    machine = bpe.StreamDecoder({i: bytes([i]) for i in range(256)})
    text = "aé日😀z" * 3
    assert "".join(machine.feed([b]) for b in text.encode()) == text
    machine.close()
    for bad in (b"\xff", b"\xc3a", b"\xe0\x80\x80", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\x80"):
        with pytest.raises(ValueError):
            machine = bpe.StreamDecoder({})
            machine.feed_bytes(bad)
    machine = bpe.StreamDecoder({})
    machine.feed_bytes("日".encode()[:2])
    with pytest.raises(ValueError):
        machine.close()


def test_greedy_counts_by_automaton():
    r = random.Random(4)
    for _ in range(80):
        pieces = {"".join(r.choice("abc▁") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 12))}
        automaton = wordpiece.Automaton(sorted(pieces))
        for _ in range(60):
            word = "".join(r.choice("abcdé▁") for _ in range(r.randint(0, 14)))
            assert automaton.count(word) == wordpiece.greedy(word, pieces), (pieces, word)


def test_token_counts(frames, odd_rows):
    pieces = wordpiece.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    known = set(pieces)
    got = wordpiece.token_counts(frames(), pieces).collect()
    want = []
    for i, text, _, _ in odd_rows:
        words = (text or "").split()
        want.append((i, len(words), sum(wordpiece.greedy(wordpiece.MARK + w, known) for w in words)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert wordpiece.token_counts(frames([]), pieces).count() == 0
