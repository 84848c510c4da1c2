"""Alignment of two tokenizers' tokens by the bytes at which both end, in joins and windows.

Tokenizer A (byte-level BPE) encodes a space and the text, tokenizer B (sentencepiece BPE) the
text, to which it adds that space. Where an A and a B token end at one byte offset there is a
cut; cuts divide the tokens into groups, and the two tokens that end there are linked.

Both tokenizers start anew at a single space between two characters that are no white space
(checked on the files: A's pre-tokenizer cuts there, no piece of B goes on past a space). Such
a space is therefore always a cut, and the tokens of a *piece* of text between two of them are
the same wherever it stands. So the relational work is done once for each different piece:

1. Rows are dealt into blocks by a hash; each block gives its different pieces and their
   counts, and the piece takes a list of its blocks (as many as there are blocks at most).
2. Each piece is tokenized; ``posexplode`` gives a row for each token, a window the cumulative
   lengths, a join of A and B tokens on piece and end the cuts, running counts of cuts the
   group ids, and grouping the groups and links of a piece.
3. Links are counted corpus-wide by id pair, weighted by the piece's count; the highest count
   of each B id is marked, and the pairs are joined back to the links of each piece (broadcast up
   to ``MOST_BROADCAST`` pairs, else by a shuffle).
4. The pieces go to their blocks and meet the exploded texts there. Both sides are dealt out by
   block, so that texts are shuffled but no tokens; one aggregation in reading order gives a row
   for each document.

A common piece is one row for each block, so no key is hot. Null and empty texts, and texts
whose joined A or B bytes differ from the space and the text, have no tokens: zeros and an empty
digest; their pieces are not counted. Repeated rows count each and stay rows of their own; an
empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import contextlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import in_arrow, removed, written
from .token_count import _require, byte_letters, read_vocabulary

#: The space that both tokenizers start at: between two visible ASCII characters, letters or digits.
SAFE_CUT = r" (?<=[\x21-\x7E\p{L}\p{N}] )(?=[\x21-\x7E\p{L}\p{N}])"
#: Text of one block, as large on the average: a task holds its pieces and what becomes of them.
BLOCK_BYTES = 20 << 20
#: Id pairs up to this number are broadcast (some 40 bytes each).
MOST_BROADCAST = 500_000

#: Aggregations in the order of the rows; joins on (block, piece) of sides dealt out by block; shuffles that go with their query.
PLANNING = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.execution.useObjectHashAggregateExec": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Texts are put together in a hash table, whose size the text of a block bounds, and in the order in which they are read.
TOGETHER = {"spark.sql.execution.useObjectHashAggregateExec": "true", "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": str(1 << 30)}

_TOKENS = T.StructType([T.StructField("valid", T.BooleanType()), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("a_ids", "a_sizes", "b_ids", "b_sizes"))])


@contextlib.contextmanager
def _planning(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The settings hold for what is written inside, and go back to what they were."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Tokenizers:
    """Both tokenizers and the bytes of their entries, from the content of their files."""

    def __init__(self, spec: str, model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        config = json.loads(spec)
        _require(config)
        self.a = Tokenizer.from_str(spec)
        self.a.encode_special_tokens = True
        back = {c: b for b, c in byte_letters().items()}
        written_as = {i: w for w, i in config["model"]["vocab"].items()} | {t["id"]: t["content"] for t in config["added_tokens"]}
        self.a_bytes = [bytes(back[c] for c in w) if set(w) <= set(back) else w.encode() for w in (written_as.get(i, " ") for i in range(max(written_as) + 1))]
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.b_bytes = [self._b_piece(i) for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in y], np.int32) for y in (self.a_bytes, self.b_bytes))

    def _b_piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def separable(self) -> bool:
        """Whether no piece of B goes on past a space, so that texts may be cut at SAFE_CUT."""
        return not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))

    def encode(self, texts: list[bytes]) -> tuple[list[bool], list[list[int]], list[list[int]]]:
        """Whether the tokens of both give back a space and the text, and their ids."""
        plain = [t.decode("utf-8", "replace") for t in texts]
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in plain], add_special_tokens=False)]
        b = self.b.encode(plain, num_threads=1)
        valid = [bool(x) and b"".join(map(self.a_bytes.__getitem__, x)) == b" " + t == b"".join(map(self.b_bytes.__getitem__, y)) for t, x, y in zip(texts, a, b, strict=True)]
        return valid, a, b


def _lists(ids: list[list[int]], sizes: np.ndarray) -> tuple[pa.Array, pa.Array]:
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32())
    flat = np.fromiter((i for x in ids for i in x), np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.ListArray.from_arrays(offsets, pa.array(sizes[flat]))


def tokenized(pieces: DataFrame, spec: str, model: bytes) -> DataFrame:
    """The pieces with valid, a_ids, a_sizes, b_ids, b_sizes; lists are empty where not valid."""
    shared = pieces.sparkSession.sparkContext.broadcast((spec, model))

    def run(batches):
        both = Tokenizers(*shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                valid, a, b = both.encode(part.column("piece").cast(pa.binary()).to_pylist())
                a, b = ([x if ok else [] for x, ok in zip(y, valid, strict=True)] for y in (a, b))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(valid, pa.bool_()), *_lists(a, both.a_sizes), *_lists(b, both.b_sizes)], [*part.schema.names, *_TOKENS.names])

    return in_arrow(pieces, run, T.StructType([*pieces.schema.fields, *_TOKENS.fields]))


def _marks(spark: SparkSession, n: int) -> list[int]:
    """n numbers that Spark's hash partitioning deals to n partitions one by one."""
    found = spark.range(32 * n + 1000).selectExpr("id", f"pmod(hash(id), {n}) AS p").groupBy("p").agg(F.min("id").alias("id")).collect()
    of = {r["p"]: r["id"] for r in found}
    return [of.get(p, p) for p in range(n)]


def aligned_pieces(tokens: DataFrame, n: int) -> DataFrame:
    """pid -> n_a, n_b, groups (text) and links (a, b), from ids and sizes of tokens.

    A group is written as its A ids and its B ids (``a1,a2|b1``), groups are joined by ``;``.
    """

    def ends(side: str) -> DataFrame:
        dealt = tokens.select("pid", f"{side}_ids", f"{side}_sizes").repartition(n, "pid")
        rows = dealt.select("pid", F.posexplode(F.arrays_zip(f"{side}_ids", f"{side}_sizes")).alias("pos", "t"))
        end = F.sum(F.col(f"t.{side}_sizes")).over(W.partitionBy("pid").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
        return rows.select("pid", end.alias("end"), F.col(f"t.{side}_ids").alias(side))

    met = ends("a").join(ends("b"), ["pid", "end"], "full_outer")
    cut = (F.col("a").isNotNull() & F.col("b").isNotNull()).cast("int")
    before = F.sum(cut).over(W.partitionBy("pid").orderBy("end").rowsBetween(W.unboundedPreceding, 0)) - cut
    rows = met.withColumn("link", F.when(cut == 1, F.struct("a", "b"))).withColumn("group", before).sortWithinPartitions("pid", "group", "end")
    ids = [F.concat_ws(",", F.collect_list(F.col(c).cast("string"))) for c in ("a", "b")]
    groups = rows.groupBy("pid", "group").agg(F.concat_ws("|", *ids).alias("ids"), F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.max("link").alias("link"))
    return groups.groupBy("pid").agg(
        F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.concat_ws(";", F.collect_list("ids")).alias("groups"), F.collect_list("link").alias("links")
    )


@dataclass
class Alignment:
    """documents: a row each with the counts and groups; pairs: a, b, n, best (links of each id pair)."""

    documents: DataFrame
    pairs: DataFrame


def align(documents: DataFrame, path_a: str, path_b: str, groups_as: Callable[[Column], Column] = lambda groups: groups) -> Alignment:
    """Per document doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and its groups (as `groups_as` gives them).

    The result is written to the shared folder, since its plan needs settings of its own.
    """
    spark = documents.sparkSession
    spec = read_vocabulary(path_a)
    with open(path_b, "rb") as f:
        model = f.read()
    both = Tokenizers(spec, model)
    if min(both.a_sizes.min(), both.b_sizes.min()) < 1:
        raise ValueError("tokens without bytes are not supported")
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(texts.rdd.getNumPartitions(), -(-size // BLOCK_BYTES), 1)
    block = F.element_at(F.array(*map(F.lit, _marks(spark, n))).cast("array<long>"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int") + 1)
    dealt = texts.withColumn("block", block).repartition(n, "block").withColumn("row", F.monotonically_increasing_id())
    cut = F.split("text", SAFE_CUT, -1) if both.separable() else F.array("text")
    words = dealt.select("block", "row", "doc_id", F.posexplode(cut).alias("pos", "piece"))

    with _planning(spark, PLANNING):
        # a block has a piece once: dealt out before the second grouping, which has nothing to put together before
        counted = words.groupBy("block", "piece").agg(F.count("*").alias("n")).repartition(n, "piece").groupBy("piece").agg(F.sum("n").alias("n"), F.collect_list("block").alias("blocks"))
        pieces = written(tokenized(counted, spec, model).withColumn("pid", F.monotonically_increasing_id()), "alignment_pieces")
        counts = pieces.select("pid", "piece", "n", "blocks", "valid")
        wrong = counts.where("NOT valid AND piece <> ''")
        if wrong.limit(1).count():
            counts = _without_wrong(counts, wrong, words, n)
        aligned = written(counts.join(aligned_pieces(pieces, n), "pid", "left"), "alignment_groups")
        removed(pieces)

        links = aligned.select("pid", "n", F.explode("links").alias("link")).select("pid", "n", "link.a", "link.b")
        summed = links.groupBy("a", "b").agg(F.sum("n").alias("n"))
        most = F.max("n").over(W.partitionBy("b"))
        pairs = written(summed.withColumn("best", F.col("n") == most), "alignment_pairs")
        known = pairs.select("a", "b", F.col("n").alias("count"), F.col("best").cast("long").alias("best"))
        known = F.broadcast(known) if pairs.count() <= MOST_BROADCAST else known
        weights = links.join(known, ["a", "b"]).groupBy("pid").agg(F.count("*").alias("n_links"), F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
        numbers = ["n_a", "n_b", "n_links", "n_best", "count_sum"]
        weighed = written(aligned.select("pid", "piece", "blocks", "valid", "groups", "n_a", "n_b").join(weights, "pid", "left").drop("pid"), "alignment_weights")
        removed(aligned)

        table = weighed.select(F.explode("blocks").alias("block"), "piece", "valid", "groups", *numbers).repartition(n, "block")
        # the hash join keeps the reading order of this side, and so does the aggregation: nothing is sorted
        joined = words.join(table.hint("shuffle_hash"), ["block", "piece"])
        valid = F.bool_and("valid")
        sums = [F.when(valid, F.sum(c)).otherwise(0).cast("long").alias(c) for c in numbers]
        shown = F.when(valid, groups_as(F.concat_ws(";", F.collect_list("groups")))).otherwise("")
        found = joined.groupBy("block", "row").agg(F.first("doc_id").alias("doc_id"), *sums, shown.alias("groups"))
        # tokens have bytes, so that at a cut one token of each side ends: a group has one link
        result = found.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups")
        with _planning(spark, TOGETHER):
            done = written(result, "alignment")
        removed(weighed)
    return Alignment(done, pairs)


def _without_wrong(counts: DataFrame, wrong: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """The counts less the pieces of texts that hold a piece whose tokens do not give it back."""
    spots = wrong.select(F.explode("blocks").alias("block"), "piece", F.lit(True).alias("wrong")).repartition(n, "block")
    held = words.join(spots.hint("shuffle_hash"), ["block", "piece"], "left")
    rows = held.groupBy("block", "row").agg(F.bool_or(F.coalesce("wrong", F.lit(False))).alias("wrong"), F.collect_list("piece").alias("pieces")).where("wrong")
    less = rows.select(F.explode("pieces").alias("piece")).groupBy("piece").agg(F.count("*").alias("less"))
    return counts.join(less, "piece", "left").withColumn("n", F.col("n") - F.coalesce("less", F.lit(0))).drop("less")


def digest(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document the counts and groups_sha256, the hex digest of its groups ('' without tokens)."""
    done = align(documents, path_a, path_b, lambda groups: F.sha2(groups, 256)).documents
    return done.withColumnRenamed("groups", "groups_sha256")
