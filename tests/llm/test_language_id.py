import zlib

from quantmill.llm import language_id as lang


def test_held_out_accuracy_and_split(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = lang.identify(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_families_come_first(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").limit(400)
    model = lang.train(docs)
    assert model.family.classes == ["germanic", "romance"]
    assert [d.classes for d in model.languages] == [["de", "en"], ["es", "fr"]]


def test_edges(spark):
    rows = [(1, None, "en", 0.5), (None, "the and of", "en", 0.1), (3, "123 !!", "en", 0.2), (4, "", None, None), (5, "中文", None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    assert {(r.lang_pred, r.score) for r in lang.identify(docs).collect()} == {("und", 0.0)}
    assert lang.identify(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(i, "the and of " * 3, "en", 0.0) for i in range(9)] + [(9, "中文", None, 0.0), (9, "--", None, 0.0)], docs.schema)
    got = lang.identify(one).collect()
    assert sorted({(r.lang_pred, r.score) for r in got}) == [("en", 1.0), ("und", 0.0)]
    kept = lang.keep_identified(one)
    assert kept.schema == one.schema and kept.count() == 10

STRANGE = [
    "zxqj vkkq xxzz qqpw", "asdf jkl qwer uiop zxcv", "Съешь же ещё этих мягких французских булок", "我能吞下玻璃而不伤身体", "aaaaaaaaaaaaaaaaaa", "x", "qz " * 200,
    "Kto rano wstaje temu Pan Bóg daje, a kto późno chodzi, sam sobie szkodzi", "これは日本語の文章です", "dGhpcyBpcyBiYXNlNjQgZGF0YQ== QWxhZGRpbjpvcGVuIHNlc2FtZQ==", "Minä olen suomalainen ja asun Helsingissä", "0x3f a9 ff de ad be ef",
]


def test_junk_and_languages_never_learned_are_rejected(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text", "lang")
    strange = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(STRANGE)], docs.schema)
    kept = {r.doc_id for r in lang.keep_identified(docs.unionAll(strange)).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}


def test_one_decision_needs_the_root(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text", "lang").where("lang in ('en', 'de')")
    strange = spark.createDataFrame([(-1, STRANGE[2], None), (-2, STRANGE[3], None)], docs.schema)
    kept = [r.doc_id for r in lang.keep_identified(docs.unionAll(strange)).select("doc_id").collect()]
    assert min(kept) >= 0 and len(kept) > 0.99 * docs.count()
