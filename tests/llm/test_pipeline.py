import __spark_entry__ as entry
import corpus_pipeline as pipeline

from .helpers import groups, words


def test_stages(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "mixture"]
    stages = dict(pipeline.STAGES)
    first = stages["language"](spark, docs, small_dir)
    assert first.schema == docs.schema and first.count() == docs.count()
    second = stages["near_duplicates"](spark, first, small_dir)
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in second.collect()}
    assert kept == {i for i, g in groups(texts).items() if i == g}
    third = stages["decontamination"](spark, second, small_dir)
    wins = {tuple(w[p : p + 10]) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect() for w in [words(r.text)] for p in range(max(1, len(w) - 9))}
    hit = {i for i in kept for w in [words(texts[i])] if any(tuple(w[p : p + 10]) in wins for p in range(len(w)))}
    assert {r.doc_id for r in third.collect()} == kept - hit
    fourth = stages["personal_data"](spark, third, small_dir)
    assert fourth.columns == docs.columns and {r.doc_id for r in fourth.collect()} == kept - hit
    fifth = stages["mixture"](spark, fourth, small_dir)
    assert fifth.columns[: len(docs.columns)] == docs.columns and all(r.rate > 0 for r in fifth.collect())


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
