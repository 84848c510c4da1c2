import numpy as np
from pyspark.sql import functions as F

from quantmill.llm import mixing as m


def test_targets_are_met_by_nonnegative_rates(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    out = m.mix(docs, spark.read.parquet(f"{data_dir}/labels.parquet"))
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == docs.count()
    row = out.agg(F.min("rate").alias("least"), *(F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")).alias(d) for d in m.DOMAINS), F.sum("n_tokens").alias("all")).first()
    assert row["least"] >= 0
    for d, share in m.TARGETS.items():
        assert abs(row[d] / row["all"] - share) < 2e-3


def test_rates_equal_a_direct_iteration():
    rng = np.random.default_rng(0)
    n, p = rng.integers(0, 50, 200).astype(float), rng.dirichlet([1, 1, 1], 200)
    steps = [rng.normal(size=3) * 0.01 for _ in range(4)]
    r = np.ones(200)
    for g in steps:
        r = np.maximum(0, r - (n[:, None] * p) @ g)
    assert np.allclose(m.rates(n, p, steps), r)


def test_classifier_on_held_out_labels(spark, data_dir):
    docs, labels = spark.read.parquet(f"{data_dir}/documents.parquet"), spark.read.parquet(f"{data_dir}/labels.parquet")
    model = m.train(docs, labels.where("doc_id % 3 != 0"))
    held = m.posteriors(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    right = [max(m.DOMAINS, key=lambda d, r=r: r[f"p_{d}"]) == ("toxic" if r.toxic else "high" if r.quality else "low") for r in held]
    assert np.mean(right) > 0.85
    assert all(abs(sum(r[f"p_{d}"] for d in m.DOMAINS) - 1) < 1e-9 for r in held)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "a b", 1.0), (2, "***", 2.0), (2, "***", 2.0), (3, "x " * 5000, None)], "doc_id long, text string, rate double")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = m.mix(docs, labels)
    assert sorted(out.columns) == sorted({*docs.columns, "n_tokens", "p_high", "p_low", "p_toxic", "rate", "copies"})
    assert sorted(r.n_tokens for r in out.collect()) == [0, 0, 0, 2, 5000]
    assert m.mix(docs.limit(0), labels.limit(0)).count() == 0


def test_targets_out_of_reach_are_told(spark):
    judged = spark.createDataFrame([(i, 10 + i % 7, 0.9 - 0.001 * i, 0.1 + 0.001 * i, 0.0) for i in range(50)], "doc_id long, n_tokens long, p_high double, p_low double, p_toxic double")
    n, p = np.array([10 + i % 7 for i in range(50)], float), np.array([[0.9 - 0.001 * i, 0.1 + 0.001 * i, 0] for i in range(50)])
    for target in ({"high": 0.2, "low": 0.2, "toxic": 0.6}, {"high": 0.87, "low": 0.13, "toxic": 0.0}):
        steps, left = m.fit_rates(judged, target)
        r = m.rates(n, p, steps)
        total, goal = r @ (n[:, None] * p), np.array([target[d] for d in m.DOMAINS]) * n.sum()
        assert (r >= 0).all() and abs(left - np.abs(total - goal).max() / n.sum()) < 1e-9
        start = np.abs((n[:, None] * p).sum(axis=0) - goal).max() / n.sum()
        assert left < start and (left > m.CLOSE) == (target["toxic"] > 0)


def test_several_labels_ties_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(m.textkit, "BLOCK", 4096)
    docs = spark.createDataFrame([(1, "bad words here"), (2, "good text"), (3, "word " * 5000), (3, "word " * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, None), (2, None, 0)], "doc_id long, quality int, toxic int")
    out = m.mix(docs, labels).collect()
    assert sorted(r.n_tokens for r in out) == [2, 3, 5000, 5000]
    by = {r.doc_id: r for r in out}
    assert by[1].p_toxic > by[2].p_toxic and len({(r.p_high, r.rate) for r in out if r.doc_id == 3}) == 1
