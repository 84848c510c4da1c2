import numpy as np
import pytest
from pyspark.sql import functions as F

from quantmill.llm import ann_tree as a


def exact(ids, v, q, k):
    s = v @ v[ids == q][0]
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
    return [int(ids[i]) for i in order]


def test_recall_scores_and_order(spark, monkeypatch):
    monkeypatch.setattr(a, "LEAF_ROWS", 32)
    monkeypatch.setattr(a, "BLOCK_VECTORS", 40)
    monkeypatch.setattr(a, "BLOCK_QUERIES", 8)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    v[700:1000] = v[700] * 4 / np.linalg.norm(v[700]) * 4  # a large group of equal vectors
    ids = np.arange(1500)
    df = spark.createDataFrame([(int(i), x.tolist(), 1) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>, score int")
    found = {}
    for r in a.search(df).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    recall = []
    for q in ids[ids % 20 == 0]:
        mine = found[int(q)]
        assert [r for r, *_ in mine] == list(range(1, 21)) and mine == sorted(mine, key=lambda x: (-x[2], x[1]))
        assert all(abs(s - v[q] @ v[i]) < 1e-9 and i != q for _, i, s in mine)
        s = v @ v[q]
        bar = np.sort(np.delete(s, q))[-20]
        recall.append(np.mean([x >= bar - 1e-9 for *_, x in mine]))
    assert np.mean(recall) >= 0.9
    equal = [i for _, i, s in found[700] if abs(s - v[700] @ v[700]) < 1e-12]
    assert equal == sorted(equal) and equal[0] == 701


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, []), (6, [1.0, None]), (7, [1.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (20, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [tuple(r) for r in a.search(df).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 1, 0.5)]
    assert a.search(df.limit(0)).count() == 0
    assert a.search(df.where(F.col("vec_id") == 0)).count() == 0


@pytest.mark.parametrize("size", ["sf0.01"])
def test_recall_on_the_table(spark, data_dir, size):
    df = spark.read.parquet(f"{data_dir}/embeddings.parquet")
    rows = df.collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = {}
    for r in a.search(df).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(set(exact(ids, v, q, 20)) & found[int(q)]) / 20 for q in ids[ids % 20 == 0]]) >= 0.9


def test_leaves_are_split_again(spark, monkeypatch):
    monkeypatch.setattr(a, "SAMPLE", 200)
    monkeypatch.setattr(a, "LEAF_ROWS", 16)
    monkeypatch.setattr(a, "LEAF_MOST", 40)
    monkeypatch.setattr(a, "LEAF_SAMPLE", 64)
    seen, split = [], a._split
    monkeypatch.setattr(a, "_split", lambda *x: seen.append(x[1]) or split(*x))
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=(2000, 8)), np.repeat(rng.normal(size=(1, 8)), 60, axis=0)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id int, embedding array<double>")
    found = {}
    for r in a.search(df, F.col("vec_id").isin(*range(0, 2000, 50))).collect():
        found.setdefault(int(r.query_id), set()).add(int(r.vec_id))
    assert len(seen) >= 1 and max(seen[0].values()) > 40
    assert np.mean([len(set(exact(np.arange(len(v)), v, q, 20)) & found[q]) / 20 for q in range(0, 2000, 50)]) >= 0.9


def test_repeated_queries_and_ids(spark):
    """A query row given twice is answered twice, in whole; of equal vectors an id with many rows hides no other id."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [rows[20], rows[40], (40, [3.0, 0.0, 0.0, 0.0])]
    equal = [5.0, 5.0, 5.0, 5.0]
    rows += [(100, equal)] * 30 + [(i, equal) for i in range(101, 130)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out = a.search(df).collect()
    x = np.array([r[1] for r in rows])
    ids = np.array([r[0] for r in rows])
    answers = {}
    for r in out:
        answers.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert len(answers[20]) == 40 and len(answers[0]) == 20 and len(answers[40]) == 60 and len(answers[100]) == 600
    assert sorted(answers[20]) == sorted(2 * sorted(answers[20])[::2])
    assert {v for _, v, _ in answers[100]} == set(range(101, 121))
    for q in (0, 20, 60, 120):
        if q not in answers:
            continue
        y = x[ids == q][0]
        s = x @ y
        want = [int(ids[i]) for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        got = [v for r, v, _ in sorted(set(answers[q]))]
        assert len(set(want) & set(got)) >= 0.9 * len(set(want))
    assert [v for _, v, _ in sorted(answers[120])] == [100] * 20


def test_large_leaves_share_what_room_there_is(monkeypatch):
    monkeypatch.setattr(a, "MOST_LEAVES", 40)
    monkeypatch.setattr(a, "LEAF_ROWS", 10)
    monkeypatch.setattr(a, "LEAF_MOST", 20)
    assert a._leaf_sizes(100) == (10, 20) and a._leaf_sizes(4000) == (200, 400)
    sizes = np.array([5, 300, 21, 100, 20, 150])
    assert a._to_split(sizes, 10, 20) == {1: 300}  # 30 of 34 leaves; the next would take 15
    assert a._to_split(sizes, 100, 20) == {1: 300, 5: 150, 3: 100, 2: 21}


def test_recall_where_leaves_are_few(spark, monkeypatch):
    for name, value in (("SAMPLE", 200), ("LEAF_ROWS", 16), ("LEAF_MOST", 40), ("LEAF_SAMPLE", 64), ("MOST_LEAVES", 48)):
        monkeypatch.setattr(a, name, value)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(1500, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id int, embedding array<double>")
    found = {}
    for r in a.search(df, F.col("vec_id") % 50 == 0).collect():
        found.setdefault(int(r.query_id), set()).add(int(r.vec_id))
    assert np.mean([len(set(exact(np.arange(len(v)), v, q, 20)) & found[q]) / 20 for q in range(0, 1500, 50)]) >= 0.9
