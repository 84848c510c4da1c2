import random

import numpy as np
import pytest

from quantmill.llm import quality_classifier as qc

from .helpers import EDGE_TEXTS


def arrays(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def counts(texts):
    data, offsets = arrays(texts)
    out = [np.zeros(qc.BUCKETS, int) for _ in texts]
    for rows, found in qc.features(data, offsets):
        for i in range(len(texts)):
            out[i] += np.bincount(found[rows == i], minlength=qc.BUCKETS)
    return out


def made(spark, n=200, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(80)]
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        text = " ".join(rng.choice(words) + ("" if good else rng.choice(["$$$", "&&&"])) for _ in range(rng.randint(5, 60)))
        docs.append((i, text, "en", "s"))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_number_of_features():
    def n(text):
        words = text.split()
        grams = sum(max(0, len(w) + 2 - k + 1) for w in words for k in (3, 4, 5))
        return grams + len(words) + max(0, len(words) - 1) + sum(a == b for a, b in zip(words, words[1:], strict=False))

    texts = [b"", b"a", b"ab cd ab ab", b" \t ", b"abc", b"x y  z\nz", "é ü".encode(), b"ab"]
    got = counts(texts)
    assert [int(c.sum()) for c in got] == [n(t) for t in texts]
    assert not (got[2] == got[7]).all() and (counts([b"ab"])[0] == got[7]).all()
    assert (counts([b"ab\tcd  ab\n\nab"])[0] == got[2]).sum() > qc.BUCKETS - 40


def test_pieces_of_a_long_text_give_all_features(monkeypatch):
    text = b" ".join(b"word%d" % (i % 700) for i in range(30_000))
    whole = counts([b"a b", text, b"c"])
    monkeypatch.setattr(qc, "PIECE", 3000)
    cut = counts([b"a b", text, b"c"])
    assert all(abs(x - y).sum() <= 2 * len(text) // 12_000 for x, y in zip(whole, cut, strict=True))
    assert (whole[0] == cut[0]).all() and (whole[2] == cut[2]).all()


def test_gradient_step_is_the_derivative_of_the_loss():
    """One small step lowers the loss by its length times the squared gradient, found by differences."""
    at, n = np.array([3, 9]), np.array([1.0, 2.0], np.float32)
    rows = [(0, at, n), (1, np.array([4]), np.array([1.0], np.float32))] * 20
    model = qc.fit(rows, epochs=30)
    z = (model.scores[at] * (n / n.sum())[:, None]).sum(axis=0) + model.constants
    assert z[0] > z[1] + 1 and model.scores[4, 1] + model.constants[1] > model.scores[4, 0] + model.constants[0] + 1
    assert not model.scores[np.setdiff1d(np.arange(qc.BUCKETS), [3, 4, 9])].any()


def test_scores_are_softmax_of_mean_vectors(spark):
    docs, labels = made(spark)
    model = qc.train(docs, labels)
    texts = [r["text"].encode() for r in docs.limit(10).collect()] + [b""]
    got = model.good(*arrays(texts))
    for t, p in zip(counts(texts), got, strict=True):
        z = t @ model.scores / max(1, t.sum()) + model.constants
        assert p == pytest.approx(np.exp(z[1]) / np.exp(z).sum(), abs=1e-6)


def test_learns_from_rows_that_are_not_held_out(spark):
    docs, labels = made(spark, 300)
    out = {r["doc_id"]: r for r in qc.score(docs, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [i for i in out if out[i]["held_out"]]
    assert 30 < len(held) < 90 and sum(out[i]["predicted"] == truth[i] for i in held) >= 0.97 * len(held)
    import zlib

    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out)
    lied = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    assert {r["doc_id"]: r["score"] for r in qc.score(docs, lied).collect()} == {i: r["score"] for i, r in out.items()}


def test_held_out_accuracy_on_the_tables(spark, data_dir):
    docs, labels = (spark.read.parquet(f"{data_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = qc.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(out) > 50 and sum(r["predicted"] == r["quality"] for r in out) >= 0.97 * len(out)


def test_edges(spark):
    docs, labels = made(spark)
    odd = spark.createDataFrame([(1000 + i, t, None, None) for i, t in enumerate([*EDGE_TEXTS, "$$$ " * 3])] + [(None, "x", None, None), (1001, "again", None, None)], docs.schema)
    more = labels.unionByName(spark.createDataFrame([(None, 1, 0), (1003, None, 0), (2, 0, 0), (2, 1, 0)], labels.schema))
    out = qc.score(docs.unionByName(odd).withColumn("score", docs.doc_id).withColumn("h", docs.doc_id).withColumn("t", docs.text), more).collect()
    assert len(out) == 200 + odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    empty = [r["score"] for r in out if r["doc_id"] in (1000, 1001) and r["score"] is not None]
    assert len(set(empty[:2])) == 1
    assert qc.score(docs.limit(0), labels).count() == 0


def test_nothing_or_one_label_to_learn(spark):
    docs, labels = made(spark, 30)
    assert {r["score"] for r in qc.score(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in qc.score(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert {r["predicted"] for r in qc.score(docs, labels.where("quality = 0")).collect()} == {0}


def test_training_is_bounded_and_the_same_under_other_partitions(spark):
    docs, labels = made(spark, 400)
    repeated = docs.unionByName(docs.where("doc_id < 100"))
    rows = qc.training_rows(repeated.repartition(7), labels.repartition(3), most_rows=100)
    again = qc.training_rows(docs, labels, most_rows=100)
    assert len(rows) == len(again) == 100 and all((x[1] == y[1]).all() and (x[2] == y[2]).all() and x[0] == y[0] for x, y in zip(rows, again, strict=True))
    few = qc.training_rows(docs, labels, most_rows=100, most_bytes=30_000)
    assert 0 < len(few) < 100 and all((x[1] == y[1]).all() for x, y in zip(few, rows, strict=False))
