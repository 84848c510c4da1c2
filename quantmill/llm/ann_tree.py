"""Approximate nearest neighbours by inner product with a hierarchical k-means tree.

A tree of k-means splits is fitted on a bounded sample; every vector is then sent down to
its leaf. A leaf that holds more than ``LEAF_MOST`` vectors is split again on a sample of its
own, in the cluster, and so on level by level, so that leaves keep their size as the table
grows; ``MOST_LEAVES`` bounds the tree that is broadcast, and on tables too large for it all
leaves are aimed at evenly larger sizes. A search walks the tree best bin first: a priority queue holds the branches seen
so far, the one whose centre is nearest is opened next, and leaves come out in that order.
How many leaves a query opens is calibrated: for a few queries the exact neighbours are
found by one pass over all vectors, and the visits are widened until their mean recall
reaches the target.

Largest inner product becomes least distance by one more component per vector,
sqrt(M^2 - |x|^2) with M the largest norm; queries get 0 there. Scores are inner products
of the original vectors in double precision.

Equal vectors are the same candidate: of each, only the k+1 least ids go on, which is all
that any answer can use (equal scores go to the smaller id). Vectors are dealt out in blocks
of bounded size (several neighbouring leaves, or a part of a large one), and so are the
queries that open a block; a task compares one block of vectors with one block of queries by
one matrix product. The leaves that a query opens first give it a bar, and from the others
only candidates that reach the bar are sent on.

Vectors that are null, empty, zero or hold null or non-finite components take no part,
nor does a null vec_id; among vectors of several lengths only those of the commonest length
do (then the longest). vec_id is a whole number of any size (else an error). Repeated vec_ids are candidates of their own; a query never finds
its own id. A query row that is repeated is searched once and answered as often as it is there; rows of one
vec_id with different vectors are queries of their own. Fewer than k candidates give all of them. Empty tables give an empty result.
Other columns are not read.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import in_arrow, removed, written

K = 20
QUERY_EVERY = 20
#: Vectors of the sample that the tree is fitted on.
SAMPLE = 16_384
BRANCHES = 8
#: Vectors aimed at in a leaf, as far as the sample allows (at least LEAST_IN_LEAF of it).
LEAF_ROWS, LEAST_IN_LEAF = 256, 8
#: Vectors above which a leaf is split again, on so many of its own; leaves of a tree (a centre is some hundred bytes).
LEAF_MOST, LEAF_SAMPLE, MOST_LEAVES = 1024, 2048, 1 << 17
#: Queries whose exact neighbours calibrate the search, and the recall to reach.
CALIBRATION, RECALL = 64, 0.97
#: Leaves that a query opens before it holds other candidates against what it has.
FIRST_LEAVES = 4
#: Rows of one block of vectors and of one block of queries.
BLOCK_VECTORS, BLOCK_QUERIES = 2048, 1024


@dataclass
class Node:
    centres: np.ndarray  # of its branches
    branches: list  # of Node, or int for a leaf


class Tree:
    """Hierarchical k-means; leaves are numbered."""

    def __init__(self, sample: np.ndarray, total: int, leaf_rows: int, seed: int = 11):
        rng, self.leaves = np.random.default_rng(seed), 0
        most = max(LEAST_IN_LEAF, leaf_rows * len(sample) / max(total, 1))
        self.root = self._grow(sample, most, rng)

    def _grow(self, x: np.ndarray, most: float, rng: np.random.Generator):
        if len(x) <= most or len(x) <= BRANCHES:
            self.leaves += 1
            return self.leaves - 1
        centres = x[rng.choice(len(x), BRANCHES, replace=False)]
        for _ in range(12):
            near = nearest(x, centres)
            centres = np.array([x[near == k].mean(axis=0) if (near == k).any() else centres[k] for k in range(len(centres))])
        near = nearest(x, centres)
        used = [k for k in range(len(centres)) if (near == k).any()]
        if len(used) < 2:
            self.leaves += 1
            return self.leaves - 1
        return Node(centres[used], [self._grow(x[near == k], most, rng) for k in used])

    def graft(self, subtrees: dict[int, Tree]) -> None:
        """Put subtrees in the place of leaves; leaves are numbered anew, in order."""
        self.leaves = 0

        def copied(node, of):
            if isinstance(node, int):
                if of is not None and node in of:
                    return copied(of[node].root, None)
                self.leaves += 1
                return self.leaves - 1
            return Node(node.centres, [copied(b, of) for b in node.branches])

        self.root = copied(self.root, subtrees)

    def assign(self, x: np.ndarray) -> np.ndarray:
        leaf = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                leaf[rows] = node
                continue
            near = nearest(x[rows], node.centres)
            todo += [(b, rows[near == k]) for k, b in enumerate(node.branches) if (near == k).any()]
        return leaf

    def walk(self, q: np.ndarray):
        """The leaves, best bin first."""
        queue, n = [(0.0, 0, self.root)], 1
        while queue:
            _, _, node = heapq.heappop(queue)
            if isinstance(node, int):
                yield node
                continue
            far = ((node.centres - q) ** 2).sum(axis=1)
            for d, b in zip(far.tolist(), node.branches, strict=True):
                heapq.heappush(queue, (d, n, b))
                n += 1

    def visits(self, q: np.ndarray, sizes: np.ndarray, leaves: int, rows: int) -> list[int]:
        """The first leaves: so many, and more until they hold `rows` vectors."""
        out, held = [], 0
        for leaf in self.walk(q):
            if len(out) >= leaves and held >= rows:
                break
            out.append(leaf)
            held += int(sizes[leaf])
        return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * (x @ centres.T), axis=1)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0.0))
    return np.hstack([x, rest[:, None]])


def best(ids: np.ndarray, scores: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id, without the query's own id."""
    ok = np.flatnonzero(ids != own)
    if len(ok) > 4 * k:
        bar = np.partition(scores[ok], len(ok) - k)[len(ok) - k]
        ok = ok[scores[ok] >= bar - 1e-9 * max(1.0, abs(bar))]
    return ok[np.lexsort((ids[ok], -scores[ok]))[:k]]


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed the same way wherever a vector stands."""
    return np.einsum("ij,j->i", x, q, optimize=False)


def _top(vectors: DataFrame, queries: np.ndarray, numbers: list[int], ids: np.ndarray, width: int, k: int) -> DataFrame:
    """Exact neighbours of few queries, given with their numbers and ids: each task keeps k for each query."""

    def run(batches):
        for batch in batches:
            x, v = matrix(batch.column("v"), width), batch.column("vec_id").to_numpy()
            out = []
            for q, number, own in zip(queries, numbers, ids, strict=True):
                s = exact_scores(x, q)
                at = best(v, s, own, k)
                out += [(number, int(v[i]), float(s[i])) for i in at]
            if out:
                a, b, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["query", "vec_id", "score"])

    return in_arrow(vectors.select("vec_id", "v"), run, "query bigint, vec_id bigint, score double")


def _leaf_sizes(total: int) -> tuple[int, int]:
    """Vectors aimed at in a leaf, and above which one is split: evenly more where the leaves allowed would not do."""
    rows = max(LEAF_ROWS, -(-2 * total // MOST_LEAVES))
    return rows, max(LEAF_MOST, LEAF_MOST * rows // LEAF_ROWS)


def _to_split(sizes: np.ndarray, rows: int, most: int) -> dict[int, int]:
    """The large leaves and their sizes, largest first, as far as there is room for the leaves that come of them."""
    room, out = MOST_LEAVES - len(sizes), {}
    for leaf in np.argsort(-sizes, kind="stable"):
        size = int(sizes[leaf])
        if size <= most or size // rows > room:
            break
        out[int(leaf)] = size
        room -= size // rows
    return out


def _split(placed: DataFrame, large: dict[int, int], width: int, norm: float, leaf_rows: int) -> dict[int, Tree]:
    """A tree for each large leaf, fitted in the cluster on LEAF_SAMPLE of its vectors (a hash of vec_id chooses them)."""
    spark = placed.sparkSession
    shares = F.broadcast(spark.createDataFrame(list(large.items()), "leaf bigint, size bigint"))
    place = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    chosen = placed.join(shares, "leaf").where(place < F.lit(float(LEAF_SAMPLE)) / F.col("size")).select("leaf", "size", "v")

    def grow(key, rows):
        x = lifted(matrix(rows.column("v").combine_chunks(), width), norm)
        tree = Tree(x, rows.column("size")[0].as_py(), leaf_rows)
        return pa.table({"leaf": [key[0].as_py()], "tree": pa.array([pickle.dumps((tree.leaves, tree.root))], pa.binary())})

    out = {}
    for r in chosen.groupBy("leaf").applyInArrow(grow, "leaf bigint, tree binary").collect():  # bounded by MOST_LEAVES centres
        grown = Tree.__new__(Tree)
        grown.leaves, grown.root = pickle.loads(bytes(r["tree"]))
        if grown.leaves > 1:
            out[r["leaf"]] = grown
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(embeddings: DataFrame, is_query: Column | None = None, k: int = K, recall: float = RECALL) -> DataFrame:
    """The k nearest of each query: query_id, rank, vec_id, score."""
    from pyspark.sql import Window

    spark = embeddings.sparkSession
    is_query = is_query if is_query is not None else F.col("vec_id") % QUERY_EVERY == 0
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    usable = F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    if not isinstance(embeddings.schema["vec_id"].dataType, T.IntegralType):
        raise TypeError("vec_id must be a whole number")
    good = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where(usable).withColumn("norm", norm)
    shape = good.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n"), F.max("norm").alias("norm")).orderBy(F.desc("n"), F.desc("w")).first()
    if shape is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    width, top_norm = shape["w"], shape["norm"]
    good = good.where(F.size("v") == width)
    asked_rows = good.where(is_query).groupBy("vec_id", "v").agg(F.count("*").alias("times"))
    queries = written(asked_rows.withColumn("query", F.monotonically_increasing_id()), "queries")

    # of equal vectors the k+1 least ids are all that can appear in an answer, and k+1 rows of each id
    same, twins = Window.partitionBy("v").orderBy("vec_id"), Window.partitionBy("v", "vec_id").orderBy("vec_id")
    few_ids = good.select("vec_id", "v").withColumn("r", F.dense_rank().over(same)).where(F.col("r") <= k + 1)
    rows = written(few_ids.withColumn("r", F.row_number().over(twins)).where(F.col("r") <= k + 1).select("vec_id", "v"), "vectors")
    total = rows.count()
    place = F.xxhash64("vec_id", F.lit(1))
    part = F.pmod(place, F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(total, 1)) * (1 << 30))
    sample = np.array([r["v"] for r in rows.where(part | (F.lit(total) <= SAMPLE)).select("v").limit(SAMPLE + SAMPLE // 4).collect()]).reshape(-1, width)
    leaf_rows, leaf_most = _leaf_sizes(total)
    tree = Tree(lifted(sample, top_norm), total, leaf_rows)

    def place_all() -> tuple[DataFrame, Broadcast, np.ndarray]:
        shared = spark.sparkContext.broadcast(tree)

        def to_leaf(batches):
            for batch in batches:
                leaf = shared.value.assign(lifted(matrix(batch.column("v"), width), top_norm))
                yield batch.append_column("leaf", pa.array(leaf))

        placed = written(in_arrow(rows, to_leaf, T.StructType([*rows.schema.fields, T.StructField("leaf", T.LongType())])), "placed")
        sizes = np.zeros(tree.leaves, np.int64)
        for r in placed.groupBy("leaf").count().collect():  # one row for each leaf of the bounded tree
            sizes[r["leaf"]] = r["count"]
        return placed, shared, sizes

    placed, shared, sizes = place_all()
    while True:
        large = _to_split(sizes, leaf_rows, leaf_most)
        if not large:
            break
        subtrees = _split(placed, large, width, top_norm, leaf_rows)
        if not subtrees:
            break  # what is left cannot be told apart
        tree.graft(subtrees)
        removed(placed)
        placed, shared, sizes = place_all()

    # calibration: exact neighbours of a few queries, and when the walk reaches their leaves
    few = queries.orderBy(F.xxhash64("vec_id", F.lit(2)), "vec_id", F.xxhash64("v")).limit(CALIBRATION).collect()
    ids, points = np.array([r["vec_id"] for r in few], np.int64), np.array([r["v"] for r in few]).reshape(-1, width)
    visits = 1
    if len(few):
        found = _ranked(_top(placed, points, [r["query"] for r in few], ids, width, k), k).join(placed.select("vec_id", "leaf").distinct(), "vec_id")
        wanted = found.groupBy("query").agg(F.collect_list("leaf").alias("leaves"))

        def walks(batches):
            for batch in batches:
                out = []
                for q, leaves in zip(matrix(batch.column("v"), width), batch.column("leaves").to_pylist(), strict=True):
                    left, at = set(leaves), {}
                    for n, leaf in enumerate(shared.value.walk(np.append(q, 0.0)), 1):
                        if leaf in left:
                            at[leaf] = n
                            left.remove(leaf)
                            if not left:
                                break
                    out += [at[leaf] for leaf in leaves]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["n"])

        dealt = queries.select("query", "v").join(wanted, "query").repartition(CALIBRATION, "query").select("v", "leaves")
        reached = np.sort([r["n"] for r in in_arrow(dealt, walks, "n bigint").collect()])  # k numbers for each of few queries
        if len(reached):
            visits = int(reached[min(len(reached) - 1, int(np.ceil(recall * len(reached))) - 1)])

    # neighbouring small leaves share a block, a large leaf is dealt out over several
    block_of, parts, held = np.zeros(tree.leaves, np.int64), [], BLOCK_VECTORS
    for leaf, size in enumerate(sizes.tolist()):
        if held + size > BLOCK_VECTORS:
            parts.append(max(1, -(-size // BLOCK_VECTORS)))
            held = 0
        held += size
        block_of[leaf] = len(parts) - 1
    blocks = spark.sparkContext.broadcast(block_of)

    def to_visits(batches):
        t, of = shared.value, blocks.value
        for batch in batches:
            x = matrix(batch.column("v"), width)
            for lo in range(0, len(x), 256):
                opened = []
                for i, p in enumerate(x[lo : lo + 256], lo):
                    seen: dict[int, int] = {}
                    for n, leaf in enumerate(t.visits(np.append(p, 0.0), sizes, visits, 2 * (k + 1))):
                        seen.setdefault(int(of[leaf]), n)
                    opened += [(i, b, n) for b, n in seen.items()]
                row, block, n = (np.array(c, np.int64) for c in zip(*opened, strict=True))
                of_row = [batch.column(c).take(pa.array(row)) for c in ("query", "vec_id", "v")]
                yield pa.RecordBatch.from_arrays([*of_row, pa.array(block), pa.array(n)], ["query", "own", "q", "block", "n"])

    walked = written(in_arrow(queries.select("query", "vec_id", "v"), to_visits, "query bigint, own bigint, q array<double>, block bigint, n bigint"), "walks")
    asked = np.zeros(len(parts), np.int64)
    for r in walked.groupBy("block").count().collect():  # one row for each block
        asked[r["block"]] = r["count"]
    deal = F.broadcast(spark.createDataFrame([(b, nv, max(1, -(-int(asked[b]) // BLOCK_QUERIES))) for b, nv in enumerate(parts)], "block bigint, nv int, nq int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    leaf_block = F.broadcast(spark.createDataFrame([(k, int(b)) for k, b in enumerate(block_of)], "leaf bigint, block bigint"))
    left = placed.join(leaf_block, "leaf").join(deal, "block").withColumn("bv", F.pmod(F.xxhash64("vec_id"), F.col("nv")).cast("int")).withColumn("bq", every("nq")).select("block", "bv", "bq", "vec_id", "v")
    right = walked.join(deal, "block").withColumn("bq", F.pmod(F.xxhash64("query"), F.col("nq")).cast("int")).withColumn("bv", every("nv"))

    def compare(_key, a: pa.Table, b: pa.Table) -> pa.Table:
        """The k best of each query in the block that reach its bar."""
        q, v, s = [], [], []
        if len(a) and len(b):
            x, ids = matrix(a.column("v").combine_chunks(), width), a.column("vec_id").to_numpy()
            y, own, number = matrix(b.column("q").combine_chunks(), width), b.column("own").to_numpy(), b.column("query").to_numpy()
            bar = b.column("bar").to_numpy(zero_copy_only=False)
            near = y @ x.T
            near[own[:, None] == ids[None, :]] = -np.inf
            if near.shape[1] > k:
                kth = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
                bar = np.maximum(bar, kth)
            # products of matrices may differ in the last digits, so a little more is scored exactly
            row, at = np.nonzero(near >= (bar - 1e-9 * np.maximum(1.0, np.abs(bar)))[:, None])
            ok = ids[at] != own[row]
            row, at = row[ok], at[ok]
            q, v, s = number[row], ids[at], np.einsum("ij,ij->i", x[at], y[row], optimize=False)
        return pa.table({"query": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    def compared(rows: DataFrame) -> DataFrame:
        return left.groupBy("block", "bv", "bq").cogroup(rows.select("block", "bv", "bq", "query", "own", "q", "bar").groupBy("block", "bv", "bq")).applyInArrow(compare, "query bigint, vec_id bigint, score double")

    # the first leaves give each query a bar, which all but few of the other candidates miss
    first = written(_ranked(compared(right.where(F.col("n") < FIRST_LEAVES).withColumn("bar", F.lit(float("-inf")))), k), "first")
    bars = first.where(F.col("rank") == k).select("query", F.col("score").alias("bar"))
    later = right.where(F.col("n") >= FIRST_LEAVES).join(bars, "query", "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf"))))
    found = first.select("query", "vec_id", "score").unionAll(compared(later))
    names = queries.select("query", F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time"))
    return _ranked(found, k).join(names, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
