import hashlib
import random
import threading
import time

import pytest
from tokenizers import Tokenizer

from folioforge.llm.bpe import BpeCodec, default_vocabulary, encode_decode

WORDS = ["the", "Über", "naïve", "日本語", "don't", "we'll", "x=1;", "<|endoftext|>", "🙂👍🏽", "12345", " ", " ", " a", "é"]
GAPS = [" ", "  ", "\n", "\n\n ", "\t", " \n", ""]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_vocabulary())


def texts():
    r = random.Random(5)
    out = ["", " ", "a", "'ll", "a 'll b", "<|endoftext|>"]
    for n in (3, 20, 200):
        out += ["".join(r.choice(WORDS) + r.choice(GAPS) for _ in range(n)) for _ in range(30)]
    letters = "abcdefghijklmnopqrstuvwxyzßéü"
    out += ["".join(r.choices(letters, k=k)) for k in (60, 300, 1000)]
    out += ["ab " + "".join(r.choices("日本語漢字🙂", k=400)) + "<|endoftext|>" + "!" * 333 + "'s" + " " * 300 + "x", "a" * 777, "=-" * 400, "'s" * 300, "\n" * 500]
    return out


@pytest.mark.parametrize("leaf", [16, 64, 2048])
def test_equals_the_library(library, leaf):
    bpe = BpeCodec(default_vocabulary(), leaf, window=2)
    all_texts = texts()
    for text, ids in zip(all_texts, bpe.encode_batch(all_texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == want, text[:80]
        assert bpe.encode(text) == want
        assert bpe.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_leaves_are_encoded_in_parallel(library, monkeypatch):
    """Two leaves are inside the library at the same time, at every level of a join."""
    bpe = BpeCodec(default_vocabulary(), 64)
    text = "".join(random.Random(7).choices("abcdefgh\u00fc", k=64 * 50))
    together = threading.Barrier(2, timeout=20)
    leaf = bpe._leaf

    def waiting(x):
        together.wait()
        return leaf(x)

    monkeypatch.setattr(bpe, "_leaf", waiting)
    assert bpe.encode_unsplit(text) == library.encode(text, add_special_tokens=False).ids


def test_decoding_broken_sequences(library):
    bpe = BpeCodec(default_vocabulary())
    r = random.Random(1)
    for _ in range(200):
        ids = [r.randrange(50257) for _ in range(6)]
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_frame(spark, library):
    rows = [(1, "one two", "x"), (1, "one two", "x"), (None, "", "y"), (3, None, "z"), (4, "a" * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(encode_decode(df, digests=True).collect(), key=repr)
    assert len(got) == 5
    for r in got:
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
        assert r.ids == library.encode(r.decoded, add_special_tokens=False).ids and r.n_tokens == len(r.ids)
    assert encode_decode(df.limit(0)).count() == 0


def test_search_for_long_runs_is_linear():
    bpe = BpeCodec(default_vocabulary())
    for unit in ("x" * 2040 + " ", " " * 2040 + "x", "x", " ", "ab "):
        took = []
        for n in (1_000_000, 4_000_000):
            text = unit * (n // len(unit))
            began = time.time()
            found = sum(m.end() - m.start() for m in bpe.unsplit.finditer(text))
            took.append(time.time() - began)
            assert found == (len(text) if len(unit) == 1 else 0)
        assert took[1] < 2, unit[:5]
