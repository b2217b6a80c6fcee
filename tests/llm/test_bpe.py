import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from veloframe.llm import bpe

pytestmark = pytest.mark.skipif(not Path(bpe.VOCABULARY).exists(), reason="no vocabulary file")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(Path(bpe.VOCABULARY).read_bytes())


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    return t


def lists(encoder, texts):
    ids, n = encoder.column(pa.array(texts))
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def same(encoder, public, texts):
    assert lists(encoder, texts) == [e.ids for e in public.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_plain_and_odd_texts(encoder, public):
    same(encoder, public, ["Hello, world", "", None, " ", "\n\n\t x", "don't we'll 'sup 's 'llama ''re I'M", "<|endoftext|> and <|startoftext|>", "a\r\n\r\n  b  \n", "ünïcödé 漢字 १२३ ½  　 x", "\x00\x01� \U0001f600", "'", " '", "\n's", "x's", "1's 2'd"])


def test_random_texts(encoder, public):
    rng = random.Random(1)
    alphabet = list("abst're'vll'md  \n\t\r12.,()é你ß́  '_ABtheing")
    same(encoder, public, ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(3000)])


def test_long_texts_are_whole(encoder, public, monkeypatch):
    texts = ["word and 'nother " * 900, "a" * 9000, " " * 3000 + "x" + "\n" * 5000, "é" * 5000, "x'" * 900, "tail"]
    want = [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]
    for size in (64, 1000, 1 << 20):
        monkeypatch.setattr(bpe, "CHUNK", size)
        assert lists(encoder, texts) == want


def test_speculation_agrees_with_exact_merging(encoder):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeinorstuz_-") for _ in range(rng.randrange(1, 14))).encode() for _ in range(2000)]
    encoder.known.clear()
    encoder.learn(words)
    assert all(list(encoder.known[w]) == encoder.exact(w) for w in words)
    assert any(encoder.propose(w) != encoder.exact(w) for w in words)  # some words do fail the check


def test_words_whose_hashes_collide(encoder, public, monkeypatch):
    """Thue-Morse words and their complements have one hash modulo 2^64 from 512 letters on."""
    a, b = "a", "b"
    texts = []
    while len(a) < 4096:
        a, b = a + b, b + a
        if len(a) >= 128:
            texts += [a, b, f"{a} {b} x {a}"]
    same(encoder, public, texts)
    same(encoder, public, [" ".join(texts)])
    monkeypatch.setattr(bpe.Encoder, "_hashes", lambda self, buf, start, end: np.zeros(len(start), np.uint64))  # all collide
    same(encoder, public, ["one two one three", "two é one", "x" * 70])


def test_forgetting_changes_nothing(encoder, public, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    same(encoder, public, ["one two three four five six seven", "eight nine ten one two"])


def test_dataframes(spark):
    rows = [(1, "a b", "z"), (2, "", "z"), (3, None, "z"), (None, "a b", "z"), (1, "a b", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode(df, "doc_id")
    assert got.columns == ["doc_id", "ids"]
    assert sorted(((r.doc_id or 0), r.ids) for r in got.collect()) == [(0, [64, 275]), (1, [64, 275]), (1, [64, 275]), (2, []), (3, [])]
    assert sorted(r.n_tokens for r in bpe.token_counts(df, ["doc_id"]).collect()) == [0, 0, 2, 2, 2]
    assert sorted(bytes(r.bytes) for r in bpe.decode(got, "doc_id").collect()) == [b"", b"", b"a b", b"a b", b"a b"]
    assert bpe.encode(df.filter("false"), "doc_id").count() == 0
