"""Models: cross-validation, importance, bagging; and streams."""

import math

import pytest
from pyspark.sql import functions as F

from quantmill.operators import bars, crossval, filters, importance
from quantmill.operators.ensemble import SequentialBagging
from quantmill.sources.generators import classification_set
from quantmill.sources.tables import events_series
from quantmill.streaming.cusum import stream_bars, stream_cusum, stream_ewm

NAMES = ["I_0", "I_1", "N_0"]


@pytest.fixture(scope="module")
def data(spark):
    return classification_set(spark, 3, 2, 0, 240).withColumn("label", F.col("bin").cast("double")).repartition(2).cache()


@pytest.fixture(scope="module")
def folds(data):
    return crossval.purged_folds(data.withColumn("series_id", F.lit(1)), 2).cache()


def tree():
    from pyspark.ml.classification import DecisionTreeClassifier

    return DecisionTreeClassifier(labelCol="label", featuresCol="features", maxDepth=3)


def test_scores_and_importance(data, folds):
    scores = crossval.cv_score(tree(), importance.assemble(data, NAMES), folds, scoring="accuracy")
    assert len(scores) == 2 and sum(scores) / 2 > 0.6
    lost, base = importance.mda(tree(), data, NAMES, folds, scoring="accuracy")
    lost = {r.feature: r.mean for r in lost.collect()}
    assert max(lost, key=lost.get) != "N_0" and base == pytest.approx(sum(scores) / 2)
    with pytest.raises(ValueError):
        crossval.cv_score(tree(), data, folds, scoring="r2")


def test_mdi_sums_to_one(spark, data):
    from pyspark.ml.classification import RandomForestClassifier

    model = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=5, seed=1).fit(importance.assemble(data, NAMES))
    trees = importance.tree_importances(spark, model, NAMES)
    assert importance.mdi(trees).agg(F.sum("mean")).first()[0] == pytest.approx(1)
    grouped = importance.mdi(trees, {"signal": ["I_0", "I_1"], "noise": ["N_0"]})
    assert {r.feature for r in grouped.where("mean > 0.5").collect()} == {"signal"}


def test_permutation_keeps_values(data):
    p = importance.permuted(data, "I_0", 3)
    assert p.count() == data.count()
    assert p.agg(F.sum("I_0")).first()[0] == pytest.approx(data.agg(F.sum("I_0")).first()[0])
    assert p.join(data.select("id", F.col("I_0").alias("was")), "id").where("I_0 != was").count() > 100


def test_bagging(data):
    bars_ = data.select(F.col("t0").alias("ts"))
    model = SequentialBagging(NAMES, n_estimators=2, seed=1).fit(data, bars_)
    assert model.oob_score(data) > 0.55
    assert model.decision_function(data).where("(decision > 0) != (proba > 0.5)").count() == 0
    model.n_estimators = 3
    assert len(model.fit(data, bars_, warm_start=True).models) == 3


def test_streams_equal_batches(spark, small_dir, tmp_path):
    source = events_series(spark, small_dir).cache()
    cut = source.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0]
    for k, part in enumerate((source.where(F.col("seq") <= cut), source.where(F.col("seq") > cut))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    del k
    for name, make in (
        ("cusum", lambda s: stream_cusum(s, 50.0)), ("bars", lambda s: stream_bars(s, 500.0, "close")), ("ewm", lambda s: stream_ewm(s, "close", 10)),
    ):
        stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    keys = lambda df: sorted((r.series_id, r.seq) for r in df.collect())
    assert keys(spark.sql("select * from cusum")) == keys(filters.cusum_events(source, 50.0))
    assert keys(spark.sql("select * from bars")) == keys(bars.price_bars(source, 500.0))
    from quantmill.operators.volatility import ewm

    batch = {(r.series_id, r.seq): r.m for r in ewm(source, "close", 10, mean="m").collect()}
    for r in spark.sql("select * from ewm").collect():
        assert r.ewm_mean == pytest.approx(batch[r.series_id, r.seq])


def test_draws_equal_a_plain_loop():
    import numpy as np

    from quantmill.operators.bootstrap import sequential_draws, uniqueness

    for seed in range(6):
        rng = np.random.default_rng(seed)
        n, bars_ = 700, 500
        first = rng.integers(0, bars_, n)
        past = np.minimum(first + rng.integers(-1, (4, 300)[seed % 2], n), bars_)
        alive, expected, rng = np.zeros(bars_), [], np.random.default_rng(seed)
        for _ in range(n):
            p = uniqueness(first, past, alive)
            expected.append(rng.choice(n, p=p / p.sum()))
            alive[first[expected[-1]] : past[expected[-1]]] += 1
        assert sequential_draws(first, past, bars_, n, np.random.default_rng(seed)).tolist() == expected


@pytest.mark.parametrize("name", ["bagged_oob", "bagged_regression"])
def test_bagging_queries_cover_all_rows(spark, small_dir, name):
    from quantmill import plans

    ids = {r.vec_id for r in spark.read.parquet(f"{small_dir}/embeddings.parquet").select("vec_id").collect()}
    got = [r.id for r in plans.collected()[0][name](spark, small_dir).select("id").collect()]
    assert len(ids) > 300 and len(got) == len(ids) and set(got) == ids


def test_correlations_equal_those_of_spark(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(5, 2, (90, 4)) @ rng.normal(size=(4, 4))
    rows = [[None if rng.random() < 0.2 else float(v) for v in r] + [7.1] for r in x]
    names = list("abcde")
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(3)
    stats, corr = importance._standard(df, names)
    pairs = [(i, j) for i in range(4) for j in range(4)]
    expected = df.agg(*(F.corr(names[i], names[j]) for i, j in pairs)).first()
    assert [corr[i, j] for i, j in pairs] == pytest.approx(list(expected))
    assert corr[4].tolist() == [0, 0, 0, 0, 1] and stats["e"][1] == 0


def test_single_features_score_as_alone(data, folds):
    got = {r.feature: (r.mean, r.std) for r in importance.sfi(tree(), data, NAMES, folds).collect()}
    for n in NAMES:
        a, b = crossval.cv_score(tree(), importance.assemble(data, [n]), folds)
        assert got[n] == pytest.approx(((a + b) / 2, abs(a - b) / 2 / 2**0.5))
    assert data.is_cached and data.storageLevel.useMemory


@pytest.mark.parametrize("name", ["mda", "sfi", "mdi", "sorted_importances", "importance_analysis"])
def test_importance_queries_cover_all_features(spark, small_dir, name):
    from quantmill import plans

    width = len(spark.read.parquet(f"{small_dir}/embeddings.parquet").first().embedding)
    got = plans.collected()[0][name](spark, small_dir).collect()
    methods = {r.method for r in got} if name == "importance_analysis" else {None}
    assert width == 64 and len(got) == width * len(methods)
    assert {r.feature for r in got} == {f"f{i}" for i in range(width)}
    if name in ("sfi", "importance_analysis"):  # the score of some fold is never 0 (which a missing one would be)
        assert all(r.mean != 0 for r in got if name == "sfi" or r.method == "sfi")


def test_samples_hold_all_components(spark, small_dir):
    from quantmill.plans import models

    data, names = models.samples(spark, small_dir)
    rows = spark.read.parquet(f"{small_dir}/embeddings.parquet").collect()
    assert {r.id: [r[n] for n in names] for r in data.collect()} == {r.vec_id: list(r.embedding) for r in rows}


def test_streams_keep_rows_of_one_time(spark, tmp_path):
    import datetime

    at = [datetime.datetime(2024, 1, 1, 0, 0, k) for k in (0, 0, 1, 1, 1, 2)]
    rows = [("a", t, k, v) for k, (t, v) in enumerate(zip(at, (1.0, 9.0, 2.0, 12.0, 1.0, 20.0), strict=True))]
    source = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, seq long, close double")
    for part in (source.where("seq < 4"), source.where("seq >= 4"), source.where("seq = 1")):  # the last row is a repeat
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_cusum(stream, 5.0).writeStream.format("memory").queryName("ties").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    got = sorted(r.seq for r in spark.sql("select * from ties").collect())
    assert got == sorted(r.seq for r in filters.cusum_events(source, 5.0).collect()) and len(got) > 2


def test_bagging_of_three_classes_by_series(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    base = classification_set(spark, 3, 2, 0, 300).select("id", "t0", "t1", (F.col("id") % 2).alias("series"), (F.col("id") % 3).cast("double").alias("label"))
    noise = spark.createDataFrame([(i, float(i % 3 + rng.normal(0, 0.2)), float(rng.normal())) for i in range(300)], "id long, x double, y double")
    data = base.join(noise, "id").cache()
    bars_ = data.select(F.col("t0").alias("ts"), "series")
    model = SequentialBagging(["x", "y"], n_estimators=3, seed=1, key="series").fit(data, bars_)
    assert model.drawn.groupBy("m").agg(F.sum("n").alias("n")).where("n != 300").count() == 0
    out = model.predict(data).collect()
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 and len(r.probabilities) == 3 for r in out)
    assert np.mean([r.prediction == r.label for r in out]) > 0.9 and model.oob_score(data) > 0.85
    again = SequentialBagging(["x", "y"], n_estimators=3, seed=1, key="series").fit(data.repartition(5), bars_)
    rows = lambda m: sorted(map(tuple, m.drawn.collect()))
    assert rows(again) == rows(model)


def test_pipelines_take_weights_and_bags_are_averaged(spark, data, folds):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.tuning import ParamGridBuilder

    rows = importance.assemble(data, NAMES).withColumn("wt", F.when(F.col("label") == 1, 1000.0).otherwise(0.001))
    model = LogisticRegression(featuresCol="scaled", labelCol="label")
    steps = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled"), model])
    assert crossval.weighted(steps, "wt").getStages()[-1].getWeightCol() == "wt" and steps.getStages()[-1] is model
    out = crossval.weighted(steps, "wt").fit(rows).transform(rows)
    assert out.where("prediction = 0").count() < 0.2 * steps.fit(rows).transform(rows).where("prediction = 0").count()
    assert crossval.cv_score(steps, rows, folds, shuffle=3, scoring="accuracy") == pytest.approx(crossval.cv_score(steps, rows, folds, scoring="accuracy"), abs=0.05)
    with pytest.raises(ValueError):
        crossval.weighted(StandardScaler(), "wt")
    grid = ParamGridBuilder().addGrid(model.regParam, [0.0, 0.1]).build()
    bag, scores = crossval.hyper_fit(steps, grid, rows, folds, bagging=(2, 0.8))
    made = bag.transform(rows)
    assert len(bag.models) == 2 and len(scores) == 2 and made.where("abs(aggregate(probability, 0D, (a, x) -> a + x) - 1) > 1e-9").count() == 0
    assert made.where("prediction = label").count() > 0.7 * rows.count()


def test_kernel_machine_tells_a_ring_from_its_inside(spark):
    import numpy as np

    from quantmill.operators import kernel

    rng = np.random.default_rng(1)
    angle, label = rng.uniform(0, 6.28, 400), np.arange(400) % 2
    radius = np.where(label == 1, 2.0, 0.5) + rng.normal(0, 0.1, 400)
    rows = spark.createDataFrame([(i, float(r * np.cos(a)), float(r * np.sin(a)), float(k)) for i, (r, a, k) in enumerate(zip(radius, angle, label, strict=True))], "id long, x double, y double, label double").coalesce(1)
    report = kernel.svm_report(rows, ["x", "y"], costs=(10.0,), gammas=(None, 0.5), n=64, max_iter=12).collect()
    best = {r.gamma: r.accuracy for r in report}
    assert best[0.5] > 0.95 > best[None] and all(0 <= r.weighted_f1 <= 1 for r in report)
    x = np.random.default_rng(2).normal(size=(2, 2))
    made = kernel.fourier(spark.createDataFrame([(0, *map(float, x[0])), (1, *map(float, x[1]))], "id long, x double, y double"), ["x", "y"], 0.3, 3000).orderBy("id").collect()
    assert made[0].features.dot(made[1].features) == pytest.approx(np.exp(-0.3 * ((x[0] - x[1]) ** 2).sum()), abs=0.06)


def test_importances_of_shuffled_columns_equal_numpy_permutations(spark, data):
    """mda against permutations of the same ranks made in NumPy, fold by fold."""
    import numpy as np

    rows = data.select("id", "t0", "t1", "label", *NAMES).withColumn("series_id", F.lit(1))
    folds = crossval.purged_folds(rows, 3).persist()
    got = {r.feature: (r.mean, r.std) for r in importance.mda(tree(), rows, NAMES, folds, scoring="accuracy", seed=4)[0].collect()}
    lost = {n: [] for n in NAMES}
    for k in range(3):
        part = lambda role, k=k: rows.join(folds.where((F.col("fold") == k) & (F.col("role") == role)).select("id"), "id")
        model = tree().fit(importance.assemble(part("train"), NAMES))
        test = part("test").select("id", "label", *NAMES).orderBy("id").toPandas()
        right = lambda frame, model=model: float((model.transform(importance.assemble(spark.createDataFrame(frame), NAMES)).toPandas().sort_values("id").prediction.to_numpy() == frame.label.to_numpy()).mean())
        base = right(test)
        for j, n in enumerate(NAMES):
            hashes = [r[0] for r in spark.createDataFrame(test[["id"]]).orderBy("id").select(F.xxhash64(F.lit(4 + 2 * j), "id")).collect()]
            mixed = test.copy()
            mixed[n] = test[n].to_numpy()[np.argsort(hashes)]
            score = right(mixed)
            lost[n].append((base - score) / (1 - score) if score < 1 else math.nan)
    for n in NAMES:
        v = np.nan_to_num(np.array(lost[n]), neginf=0.0)
        assert got[n][0] == pytest.approx(v.mean()) and got[n][1] == pytest.approx(v.std(ddof=1) / math.sqrt(3))
    folds.unpersist()
