import random

import pytest

from quantmill.llm import token_count as t

from .helpers import EDGE_TEXTS

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counter():
    spec = t.read_vocabulary(PATH)
    return t.Counter(spec, t.proven_whole(spec))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_equals_the_library(counter, library, monkeypatch):
    monkeypatch.setattr(t, "REMEMBERED", 50)
    rng = random.Random(3)
    parts = ["  ", " ", "\n", "\t", "a", "B", "　", "\xa0", "\x85", "\u200b", "'s", ".", "1", "½", "é", " the", "<|endoftext|>", "!!", "中文", "\U0001f600", "hello,"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_rows(spark, library):
    docs = [(i, x) for i, x in enumerate(EDGE_TEXTS)] + [(0, "again")]
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in t.count_tokens(spark.createDataFrame(docs, "doc_id long, text string"), PATH).collect())
    n = [(i, len((x or "").encode()), len(library.encode(x or "", add_special_tokens=False).ids)) for i, x in docs]
    assert got == sorted((i, b, k, k > 512) for i, b, k in n)


def test_whole_tokens_encode_alone(library):
    whole = t.proven_whole(t.read_vocabulary(PATH))
    assert len(whole) > 40_000
    for x in random.Random(1).sample(whole, 300):
        assert len(library.encode(x, add_special_tokens=False).ids) == 1
