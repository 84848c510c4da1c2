import random

import numpy as np
import pyarrow as pa
import pytest

from quantmill.llm import textkit

from .helpers import words as plain


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_words_are_those_of_the_pattern(block, monkeypatch):
    monkeypatch.setattr(textkit, "BLOCK", block)
    monkeypatch.setattr(textkit, "_powers", {})
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB9 .éZz\x7f\n") for _ in range(rng.choice([0, 1, 5, 70, 300]))) for _ in range(200)] + ["a" * 500, "", "  "]
    data, offsets = textkit.buffers(pa.array([t.encode() for t in texts], pa.binary()))
    h, first = textkit.words(data, offsets)
    seen = {}
    for i, t in enumerate(texts):
        assert first[i + 1] - first[i] == len(plain(t))
        for w, x in zip(plain(t), h[first[i] : first[i + 1]], strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_shingles_follow_order_and_number():
    data, offsets = textkit.buffers(pa.array([b"a b c d e f", b"b a c d e", b"a b", b"", b"a b c d e"], pa.binary()))
    s, begin = textkit.shingles(*textkit.words(data, offsets))
    assert np.diff(begin).tolist() == [2, 1, 1, 0, 1]
    assert s[0] == s[-1] and len(set(s.tolist())) == 4
