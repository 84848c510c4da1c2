"""Bagging on sequential bootstrap samples with pyspark.ml trees.

Every member is a tree fitted with the number of draws of a row as its weight; draws come
from the sequential bootstrap of the events' intervals, features are drawn at random.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bootstrap import OPEN, lazy_draws, micros, spans


def _size(asked: int | float, n: int) -> int:
    k = int(asked * n) if isinstance(asked, float) else asked
    if not 0 < k <= n:
        raise ValueError("sizes must be within the data")
    return k


@dataclass
class SequentialBagging:
    """Options of an ensemble; fit gives the fitted one.

    data of fit: id, t0, t1, label, features by name, weight if named; a key, if named, says
    which rows are of one series. Draws depend on one another inside a series only: the cluster
    draws each member and series as a task of its own, which holds three numbers of each event
    (without a key, of all events). max_samples counts rows of a series, or is a share of them.
    """

    features: Sequence[str]
    label: str = "label"
    weight: str | None = None
    n_estimators: int = 10
    max_samples: int | float = 1.0
    max_features: int | float = 1.0
    regression: bool = False
    estimator: object = None
    seed: int = 0
    key: str | None = None
    models: list = field(default_factory=list)
    chosen: list = field(default_factory=list)
    #: Rows (m, id, n): how often member m drew a row.
    drawn: DataFrame | None = None

    def _tree(self):
        from pyspark.ml.classification import DecisionTreeClassifier
        from pyspark.ml.regression import DecisionTreeRegressor

        tree = self.estimator or (DecisionTreeRegressor(seed=self.seed) if self.regression else DecisionTreeClassifier(seed=self.seed))
        return tree.copy({tree.featuresCol: "_features", tree.labelCol: self.label, tree.weightCol: "_weight"})

    def _draws(self, data: DataFrame, bars: DataFrame, members: range, ts: str) -> DataFrame:
        seed, asked = self.seed, self.max_samples
        series = F.col(self.key) if self.key else F.lit(0)
        every = F.explode(F.array(*(F.lit(m) for m in members)))
        events = data.select("id", micros(F.col("t0"), OPEN).alias("t0"), micros(F.col("t1"), OPEN).alias("t1"), series.alias("s")).withColumn("m", every)
        at = bars.select(micros(F.col(ts), OPEN).alias("ts"), series.alias("s")).distinct().withColumn("m", every)

        def draw(_key, e: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if e.empty:
                return pd.DataFrame({"m": [], "id": [], "n": []})
            e, times = e.sort_values(["t0", "id"]), np.sort(b["ts"].to_numpy())
            first, past = spans(times, e["t0"].to_numpy(), e["t1"].to_numpy())
            m = int(e["m"].iloc[0])
            rng = np.random.default_rng([seed, m, int(e["h"].iloc[0])])
            places, n = np.unique(lazy_draws(first, past, len(times), _size(asked, len(e)), rng), return_counts=True)
            return pd.DataFrame({"m": m, "id": e["id"].to_numpy()[places], "n": n})

        schema = T.StructType([T.StructField("m", T.IntegerType()), data.schema["id"], T.StructField("n", T.LongType())])
        events = events.withColumn("h", F.pmod(F.xxhash64("s"), F.lit(1 << 31)))
        return events.groupBy("m", "s").cogroup(at.groupBy("m", "s")).applyInPandas(draw, schema)

    def fit(self, data: DataFrame, bars: DataFrame, *, warm_start: bool = False, ts: str = "ts") -> SequentialBagging:
        from .importance import assemble

        if not warm_start:
            self.models, self.drawn, self.chosen = [], None, []
        members = range(len(self.models), self.n_estimators)
        if not members:
            return self
        new = self._draws(data, bars, members, ts).persist(StorageLevel.DISK_ONLY)
        for m in members:
            rng = np.random.default_rng([self.seed, m])
            places = sorted(rng.choice(len(self.features), _size(self.max_features, len(self.features)), replace=False).tolist())
            names = [self.features[i] for i in places]
            weight = F.col("_n") * (F.col(self.weight) if self.weight else F.lit(1.0))
            rows = data.join(new.where(F.col("m") == m).select("id", F.col("n").alias("_n")), "id").withColumn("_weight", weight.cast("double"))
            self.models.append(self._tree().fit(assemble(rows, names, "_features")))
            self.chosen.append(names)
        self.drawn = new if self.drawn is None else self.drawn.unionAll(new)
        return self

    def _members(self, data: DataFrame) -> DataFrame:
        """Adds one column for each member: the probabilities of the classes in order, or an array of the value."""
        from pyspark.ml.functions import vector_to_array

        from .importance import assemble

        out = data
        for m, (model, names) in enumerate(zip(self.models, self.chosen, strict=True)):
            scored = model.transform(assemble(out, names, "_features"))
            if self.regression:
                value = F.array("prediction")
            elif "probability" in scored.columns:
                value = vector_to_array("probability")
            else:  # a vote
                value = F.transform(F.sequence(F.lit(0), F.lit(model.numClasses - 1)), lambda k: (k == F.col("prediction")).cast("double"))
            out = scored.withColumn(f"_m{m}", value).drop("_features", "prediction", "probability", "rawPrediction")
        return out

    def _mean(self, used) -> Column:
        """Mean over the members of which used(m) holds, by class; a class that a member never drew has 0 there. Null if none is used."""
        each = [F.when(used(m), F.col(f"_m{m}")).otherwise(F.array().cast("array<double>")) for m in range(len(self.models))]
        width = F.greatest(F.lit(0), *(F.size(e) for e in each))
        count = sum((used(m).cast("int") for m in range(len(self.models))), F.lit(0))
        share = lambda k: sum((F.coalesce(F.get(e, k), F.lit(0.0)) for e in each), F.lit(0.0)) / count
        return F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), share))

    def predict_proba(self, data: DataFrame) -> DataFrame:
        """Adds probabilities (by class) and proba (of class 1); for a regression proba is the value."""
        names = [f"_m{m}" for m in range(len(self.models))]
        out = self._members(data).withColumn("probabilities", self._mean(lambda m: F.lit(True)))
        out = out.withColumn("proba", F.col("probabilities")[0] if self.regression else F.coalesce(F.get("probabilities", F.lit(1)), F.lit(0.0)))
        return out.drop(*names, *(["probabilities"] if self.regression else []))

    def predict_log_proba(self, data: DataFrame) -> DataFrame:
        return self.predict_proba(data).withColumn("log_proba", F.when(F.col("proba") > 0, F.log("proba")).otherwise(float("-inf")))

    def decision_function(self, data: DataFrame) -> DataFrame:
        """Log odds of the mean probability of class 1, kept finite."""
        p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("proba")))
        return self.predict_proba(data).withColumn("decision", F.log(p / (1 - p)))

    def predict(self, data: DataFrame) -> DataFrame:
        """Adds prediction: the value, or the first of the likeliest classes."""
        if self.regression:
            return self.predict_proba(data).withColumnRenamed("proba", "prediction")
        return self.predict_proba(data).withColumn("prediction", _likeliest(F.col("probabilities")))

    def out_of_bag(self, data: DataFrame) -> DataFrame:
        """id, label and the members that did not draw the row: oob (mean value, or probability of class 1; null if all drew it) and oob_class."""
        drawn = self.drawn.groupBy("id").agg(F.collect_set("m").alias("_in"))
        out = self._members(data).join(drawn, "id", "left")
        free = lambda m: ~F.coalesce(F.array_contains("_in", m), F.lit(False))
        out = out.select("id", F.col(self.label).alias("label"), self._mean(free).alias("_p"))
        if self.regression:
            return out.select("id", "label", F.col("_p")[0].alias("oob"))
        return out.select("id", "label", F.when(F.col("_p").isNotNull(), F.coalesce(F.get("_p", F.lit(1)), F.lit(0.0))).alias("oob"), _likeliest(F.col("_p")).alias("oob_class"))

    def oob_score(self, data: DataFrame) -> float:
        """Accuracy, or R squared, over rows that some member did not draw."""
        rows = self.out_of_bag(data).where("oob is not null")
        if not self.regression:
            return rows.agg(F.avg((F.col("oob_class") == F.col("label")).cast("double"))).first()[0]
        sse, sst = F.sum(F.pow(F.col("label") - F.col("oob"), F.lit(2.0))), F.var_pop("label") * F.count("*")
        return rows.agg(1 - sse / sst).first()[0]


def _likeliest(probabilities: Column) -> Column:
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("double")
