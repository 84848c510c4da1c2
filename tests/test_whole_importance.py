"""The importance query fits all trees on all folds."""

import inspect

from quantmill.operators import crossval, importance
from quantmill.plans import models


def test_importance_analysis_keeps_the_folds_and_trees_of_its_operator(spark, small_dir, monkeypatch):
    got = {}
    signature = inspect.signature(importance.importance_analysis)
    monkeypatch.setattr(importance, "importance_analysis", lambda *a, **k: got.update(signature.bind(*a, **k).arguments))
    models.importance_analysis(spark, small_dir)
    assert crossval.fold_numbers(got["folds"]) == list(range(10))
    assert got.get("trees", signature.parameters["trees"].default) == 1000 and "methods" not in got
    assert got["data"].count() == spark.read.parquet(f"{small_dir}/embeddings.parquet").count() and len(got["names"]) == 64
