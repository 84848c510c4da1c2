import random

import numpy as np

from quantmill.llm import bagminhash as b

from .helpers import EDGE_TEXTS, groups


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    docs, n = {}, 0
    for _ in range(25):
        base = [word() for _ in range(rng.choice([6, 40, 200]))]
        for _ in range(rng.choice([1, 1, 3, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = word()
            docs[n] = " ".join(copy)
            n += 1
    docs |= {1000 + i: t for i, t in enumerate(EDGE_TEXTS)}
    docs |= {2000 + i: "boiler plate " * 50 + " ".join(word() for _ in range(30)) for i in range(10)}
    return docs


def test_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(b, "BLOCK", 4)
    monkeypatch.setattr(b, "COLUMNS", 64)
    docs = corpus()
    got = b.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    assert {r.doc_id: r.group_id for r in got.collect()} == groups(docs)


def test_keep_one_with_nulls_repeats_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, 1, "k"), (3, text + " more", 2, "k"), (None, text, 3, None), (9, "other words", 4, "k"), (9, "other words", 4, "k"), (7, None, 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, group_id long, bands string")
    kept = b.keep_one(docs)
    assert kept.schema == docs.schema
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["3", "7", "9", "None"]
    assert b.keep_one(docs.limit(0)).count() == 0


def test_register_agreement_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    shingle = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    c1, c2 = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    row = np.repeat([0, 1], 300)
    t = b.signatures(2, row, np.tile(shingle, 2), np.concatenate([c1, c2]), 4096)
    true = np.minimum(c1, c2).sum() / np.maximum(c1, c2).sum()
    assert abs((t[0] == t[1]).mean() - true) < 4 * (true * (1 - true) / 4096) ** 0.5


def test_text_ids_and_hot_leaders(spark, monkeypatch):
    monkeypatch.setattr(b, "LED", 4)
    monkeypatch.setattr(b, "BLOCK", 8)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    docs = {}
    for i in range(60):
        w = list(base)
        for at in rng.choice(120, 1 + i % 4, replace=False):
            w[at] = f"x{i}"
        docs[f"d{i:03}"] = " ".join(w)
    docs |= {"e1": None, "e2": "", "f1": "short text", "f2": "Short text"}
    got = {r.doc_id: r.group_id for r in b.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id string, text string")).collect()}
    assert got == groups(docs)
