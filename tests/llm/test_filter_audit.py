import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from quantmill.llm import filter_audit as fa

from .helpers import EDGE_TEXTS


def brute(docs, labels):
    """All rows by going through every document in every order: docs of (doc_id, text, source)."""
    fails, parts = [], {}
    for doc_id, text, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails.append([
            len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)),
            doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in docs),
        ])
    for k, (_, _, source) in enumerate(docs):
        parts.setdefault(source or "", []).append(k)
    good = [any(i is not None and i == d[0] and q == 1 for i, q, _ in labels) for d in docs]
    toxic = [any(i is not None and i == d[0] and t == 1 for i, _, t in labels) for d in docs]
    out = []
    for part, of in parts.items():
        shapley, rows = [0] * 5, []
        for order in itertools.permutations(range(5)):
            left = set(of)
            for step, f in enumerate(order, 1):
                gone = {k for k in left if fails[k][f]}
                redundant = sum(fails[k][f] for k in of if k not in left)
                left -= gone
                shapley[f] += len(gone)
                rows.append((f, ("".join("ABCDE"[x] for x in order), step, len(left), len(gone), redundant, sum(sum(fails[k]) == 1 and fails[k][f] for k in of), sum(good[k] for k in gone), sum(toxic[k] for k in gone))))
        out += [(part, *row, shapley[f]) for f, row in rows]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def labels(spark):
    rows = [(i, i % 2, i % 3 == 0) for i in range(0, 40, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None)]
    rows = [(i, q, None if t is None else int(t)) for i, q, t in rows]
    return rows, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_against_brute_force(spark, labels):
    rng = random.Random(3)
    texts = [*EDGE_TEXTS, "A B C", "one two " * 40, " ".join(map(str, range(60))), "x# y", "é" * 30 + "A", "a\x0bb\x0cc\x85d\x1ce", "tab\tX\nY\rZ"]
    docs = [(rng.choice([*range(40), None]), rng.choice(texts), rng.choice(["a", "b", "", None])) for _ in range(160)]
    docs += [(5, "the same row", "a")] * 3 + [(7, "the same row", "a")] * 3 + [(None, "the same row", "b")]
    frame = table(spark, docs).repartition(5).withColumn("part", F.lit("clash")).withColumn("mask", F.lit(1))
    assert found(fa.audit(frame, labels[1])) == brute(docs, labels[0])


def test_chains_given_out_early_and_texts_cut_word_by_word(spark, labels, monkeypatch):
    docs = [(i % 30, f"text {i % 4} " * (i % 4), "a") for i in range(120)]
    monkeypatch.setattr(fa, "HELD_BYTES", 300)
    monkeypatch.setattr(fa, "LISTED", 4)
    assert fa._word_counts(b" a\tb a\x0b ") == (3, 2)
    rows = list(fa._chains_of_task([(i, p, t.encode()) for i, t, p in docs]))
    got = sorted(fa._chains_of_fingerprint(sorted(rows, key=lambda r: r[0])))
    least = {}
    for i, t, _ in docs:
        least[t] = min(least.get(t, i), i)
    total = {}
    for i, _, mask, n in got:
        total[i, mask & fa.E > 0] = total.get((i, mask & fa.E > 0), 0) + n
    want = {}
    for i, t, _ in docs:
        want[i, i > least[t]] = want.get((i, i > least[t]), 0) + 1
    assert total == want


def test_texts_of_one_fingerprint_stay_apart(monkeypatch):
    import xxhash

    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda x: 1)
    rows = [(2, "", b"x"), (1, "", b"y"), (3, "", b"x"), (1, "", b"x"), (4, "", b"y")]
    got = {(i, m & fa.E > 0) for i, _, m, _ in fa._chains_of_fingerprint(sorted(fa._chains_of_task(rows), key=lambda r: r[0]))}
    assert got == {(1, False), (2, True), (3, True), (4, True)}


def test_repeated_ids(spark):
    docs = table(spark, [(3, "a", None), (1, "a", None), (1, "a", None), (2, "b", None), (5, None, None), (6, "", None), (6, "", None), (None, "a", None)])
    assert sorted(r[0] for r in fa.repeated_ids(docs).collect()) == [3, 6, 6]


def test_a_hot_text_leaves_the_map_tasks_once(spark):
    rows = list(fa._chains_of_task([(i, "p", b"the same") for i in range(5000)]))
    assert len([r for _, r in rows if r[0] == 0]) == 1 and len({fp % 7 for fp, _ in rows}) == 7


def test_empty_table(spark, labels):
    assert fa.audit(table(spark, []), labels[1]).count() == 0


def test_long_text(spark, labels):
    docs = [(1, "word " * 400_000 + "END", "a"), (2, "word " * 400_000 + "END", "b")]
    assert found(fa.audit(table(spark, docs), labels[1])) == brute(docs, labels[0])
