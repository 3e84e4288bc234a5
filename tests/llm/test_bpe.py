import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellsight.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_equals_library(library, texts):
    tok = bpe.encoder(PATH)
    got = tok.encode_packed(texts)
    assert [ids(x) for x in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [tok.decode(np.frombuffer(x, "<u4")) for x in got] == texts


def test_odd_texts(library):
    rng = random.Random(1)
    parts = [" ", "a", "the", "\n", "\t", "é", "<|endoftext|>", "日", "՘", "1", "!!", "aaaa", "'s", "'ll", "\x1c", "　", "😀", "  ", "\xa0", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(500)] + ["a" * 5000, "ab" * 3000, " " * 2000, "x" * 65 + " " + "x" * 66, ""]
    tok = bpe.encoder(PATH)
    assert [ids(x) for x in tok.encode_packed(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_small_caches_give_the_same(library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_WORDS", 3)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 2)
    tok = bpe.TrieEncoder(PATH)
    for text in ["one two three four", "two three five one", "one one six"] * 3:
        assert ids(tok.encode_packed([text])[0]) == library.encode(text, add_special_tokens=False).ids


def test_table(spark, library):
    rows = [(1, "Hello there", "x"), (2, None, "y"), (None, "", "z"), (1, "Hello there", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, bpe.round_trip(df).collect()), key=str)
    empty = hashlib.sha256(b"").hexdigest()
    n = len(library.encode("Hello there").ids)
    assert [(r[0], r[1]) for r in got] == [(1, n), (1, n), (2, 0), (None, 0)]
    assert got[2][2:] == (empty, empty) and got[0][3] == hashlib.sha256(b"Hello there").hexdigest()
    assert bpe.round_trip(df.limit(0)).count() == 0
    back = bpe.decode(bpe.encode(df)).collect()
    assert sorted(r["text"] for r in back) == ["", "", "Hello there", "Hello there"]
