import collections
import hashlib
import itertools

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quantmill.llm import token_alignment as ta

from .helpers import EDGE_TEXTS

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    "a ▁ b", "two▁joined words", "  lead", "trail  ", "tab\tand\n\nlines \n x", " ", "   ", "<|endoftext|> and <s> </s> <0x41>", "don't we'll", "é café 中文 \U0001f600\U0001f600", "x　y   z",
    "the the the", "the cat the", "a\x00b c", "\x1f \x85 q", "1,234.5 -- 77 %%", "ﬁ ｆｕ   w", "the ▁ cat", "word ." * 50,
]


def brute(rows):
    """Whole texts, token by token: (doc_id, text) -> sorted rows of COLUMNS after doc_id."""
    from tokenizers import Tokenizer

    both = ta.Tokenizers(ta.read_vocabulary(A), open(B, "rb").read())
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    decode = {c: b for b, c in ta.byte_letters().items()}

    def ends(sizes):
        return list(itertools.accumulate(sizes))

    docs, pairs = [], collections.Counter()
    for doc_id, text in rows:
        text = text or ""
        tokens = a.encode(" " + text, add_special_tokens=False)
        x, xb = tokens.ids, [bytes(decode[c] for c in t) for t in tokens.tokens]
        y = both.b.encode(text)
        yb = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") and both.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, both.b.id_to_piece(i)) for i in y)]
        if not text or not b"".join(xb) == b"".join(yb) == b" " + text.encode():
            docs.append((doc_id, None))
            continue
        xe, ye = ends(map(len, xb)), ends(map(len, yb))
        links = [(x[i], y[j]) for i, e in enumerate(xe) for j in [ye.index(e) if e in set(ye) else -1] if j >= 0] if len(text) < 3000 else [(x[i], y[j]) for e in sorted(set(xe) & set(ye)) for i, j in [(xe.index(e), ye.index(e))]]
        cuts = sorted(set(xe) & set(ye))
        groups, i, j = [], 0, 0
        for c in cuts:
            k, m = i, j
            while k < len(xe) and xe[k] <= c:
                k += 1
            while m < len(ye) and ye[m] <= c:
                m += 1
            groups.append(",".join(map(str, x[i:k])) + "|" + ",".join(map(str, y[j:m])))
            i, j = k, m
        pairs.update(links)
        docs.append((doc_id, (len(x), len(y), links, ";".join(groups), len(groups))))
    most = collections.Counter()
    for (_, b), n in pairs.items():
        most[b] = max(most[b], n)
    out = []
    for doc_id, d in docs:
        if d is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            na, nb, links, groups, ng = d
            out.append((doc_id, na, nb, ng, len(links), sum(pairs[k] == most[k[1]] for k in links), sum(pairs[k] for k in links), hashlib.sha256(groups.encode()).hexdigest()))
    return sorted(out, key=str)


def found(docs):
    return sorted((tuple(r) for r in ta.digest(docs, A, B).select("doc_id", *COLUMNS).collect()), key=str)


def test_against_whole_texts(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    assert found(docs) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_odd_texts_repeats_nulls_and_other_columns(spark):
    rows = list(enumerate([*EDGE_TEXTS, *ODD, *ODD[:6], "the cat", "the cat"]))
    rows += [(3, "the same id"), (3, "the same id"), (None, "no id"), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, block string, n long, piece string").repartition(3)
    assert found(docs) == brute(rows)


def test_pairs_count_links_of_whole_texts_only(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, "the ▁ cat"), (3, "the dog")], "doc_id long, text string")
    pairs = {(r["a"], r["b"]): (r["n"], r["best"]) for r in ta.align(docs, A, B).pairs.where("n > 0").collect()}
    assert sorted(n for n, _ in pairs.values()) == [1, 1, 2] and all(best for _, best in pairs.values())


def test_groups_can_be_read_back(spark):
    groups = ta.align(spark.createDataFrame([(1, "tokenization aligned")], "doc_id long, text string"), A, B).documents.first()["groups"]
    both = ta.Tokenizers(ta.read_vocabulary(A), open(B, "rb").read())
    sides = [g.split("|") for g in groups.split(";")]
    for k, entries in ((0, both.a_bytes), (1, both.b_bytes)):
        assert b"".join(entries[int(i)] for s in sides for i in s[k].split(",")) == b" tokenization aligned"


def test_pairs_beyond_the_broadcast(spark, small_dir, monkeypatch):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").limit(20)
    want = found(docs)
    monkeypatch.setattr(ta, "MOST_BROADCAST", 0)
    assert found(docs) == want


def test_uncut_texts_give_the_same(spark, small_dir, monkeypatch):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").where(F.length("text") < 2000)
    want = found(docs)
    monkeypatch.setattr(ta.Tokenizers, "separable", lambda self: False)
    assert found(docs) == want


def test_empty_table_and_settings(spark):
    before = {k: spark.conf.get(k, None) for k in ta.PLANNING | ta.TOGETHER}
    out = ta.digest(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert out.count() == 0 and out.columns == ["doc_id", *COLUMNS[:-1], "groups_sha256"]
    assert {k: spark.conf.get(k, None) for k in before} == before


@pytest.mark.parametrize("text", ["a b", "x. Y", "é 9"])
def test_cut(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(F.size(F.split("t", ta.SAFE_CUT, -1))).first()[0] == 2
