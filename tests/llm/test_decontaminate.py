import hashlib

import numpy as np
import pytest

from quantmill.llm import decontaminate as d

from .helpers import EDGE_TEXTS, words


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = words(t)
        k = min(window, len(w))
        for p in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[p : p + k]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in wins}:
            for p in range(len(w) - size + 1):
                if (of := wins.get(tuple(w[p : p + size]))) is not None:
                    hit.update(range(p, p + size))
                    found |= of
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1 << 24, 300, 40])
def test_equals_brute_force(spark, data_dir, monkeypatch, block):
    monkeypatch.setattr(d, "BENCHMARK_BLOCK_BYTES", block)
    docs = [tuple(r) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").limit(150).collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").select("item_id", "text").limit(8).collect()]
    planted = words(items[0][1])
    docs += [(-1 - i, t) for i, t in enumerate(EDGE_TEXTS)] + [(-50, "lead " + " ".join(planted) + " tail"), (-51, " ".join(planted[:10]).upper()), (-52, " ".join(planted[:9])), (-53, "of the"), (-53, "of the"), (None, " ".join(planted))]
    items += [(900, "of the"), (901, None), (902, "zz"), (903, "*"), (900, "of the"), (None, "a b")]
    got = d.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_clean_keeps_columns_and_matches_are_the_longest(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, f"before {passage} after", "x"), (2, "nothing here", "y"), (3, None, None)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    kept = d.clean(docs, bench)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert [tuple(r) for r in d.matches(docs, bench).collect()] == [(1, "7", 1, 0, 12)]
    assert d.clean(docs.limit(0), bench).count() == 0 and d.clean(docs, bench.limit(0)).count() == 3


def test_suffix_array():
    x = np.random.default_rng(0).integers(0, 3, 200)
    assert d.suffix_array(x).tolist() == sorted(range(200), key=lambda i: x[i:].tolist())


def test_longest_matches_equal_brute_force_in_any_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    text = lambda n: " ".join(rng.choice(list("abc"), n))
    docs, items = [(i, text(60)) for i in range(12)] + [(99, "a " * 400)], [(i, text(30)) for i in range(6)] + [(7, "a " * 60), (8, "b c")]

    def brute_matches(window):
        out = []
        for d, t in docs:
            w = words(t)
            for i, x in items:
                v = words(x)
                k = min(window, len(v))
                for p in range(len(w)):
                    for q in range(len(v) - k + 1):
                        if w[p : p + k] == v[q : q + k] and not (p and q and w[p - 1] == v[q - 1]):
                            n = 0
                            while p + n < len(w) and q + n < len(v) and w[p + n] == v[q + n]:
                                n += 1
                            out.append((d, str(i), p, q, n))
        return sorted(out)

    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 130):
        monkeypatch.setattr(d, "BENCHMARK_BLOCK_BYTES", block)
        assert sorted(tuple(r) for r in d.matches(*frames, window=6).collect()) == brute_matches(6)
        assert {r.doc_id for r in d.clean(*frames, window=6).collect()} == {i for i, _ in docs} - {m[0] for m in brute_matches(6)}


def test_pieces_of_a_long_item_hold_every_window(monkeypatch):
    monkeypatch.setattr(d, "BENCHMARK_BLOCK_BYTES", 100)
    text = b" ".join(b"w%d" % i for i in range(300))
    seen = set()
    for piece, place in d._pieces(text, 10):
        w = piece.split()
        assert len(w) >= 10 and w[0] == b"w%d" % place
        seen |= {place + i for i in range(len(w) - 9)}
    assert seen == set(range(291))
