"""Mixing sources to target weights by soft membership.

A classifier trained on the labelled table gives every document a posterior over domains:
toxic, else high or low quality. Expected domain tokens of the corpus are then
sum(rate * tokens * posterior); rates of documents, nonnegative, are fitted by projected
gradient descent on the least squares distance to the targets, starting at rate 1.

Each step is one pass: a task replays the steps so far on its own rows (they depend on the
row and on a few numbers per step) and returns its share of the domain totals, so nothing
but those numbers is kept between steps. The distance is weighted by the inverse Gram matrix
of the expected tokens of the rows whose rate is above zero, which has the same least
(zero) wherever targets can be met and makes the steps long.

The classifier is a softmax over hashed words that tell the classes apart, on at most
``TRAINING_ROWS`` labelled documents (a hash of doc_id chooses them).

The metric makes a step a projected Newton step. Steps end when the targets are met within
``CLOSE`` of all tokens, when no step length helps, or after ``STEPS`` passes; ``mix`` warns
with what is left where the targets are not met.

Null or wordless texts have no tokens, prior posteriors and rate 1 (no gradient).
Null labels are no labels; several labels of a document count as the worst. Without labels
every document is of the first domain. A null doc_id is never trained on. Repeated rows are
weighted one by one. Empty tables give empty results. ``mix`` keeps all columns; an own
column named as one of its results is replaced.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit
from .shared import in_arrow, text_bytes, written

DOMAINS = ("high", "low", "toxic")
#: Shares of tokens aimed at.
TARGETS = {"high": 0.85, "low": 0.13, "toxic": 0.02}
TRAINING_ROWS = 6000
BUCKETS, CHOSEN = 1 << 18, 2000
STEPS, CLOSE = 30, 1e-4

#: Punctuation classes whose rates are features besides the words.
_MARKS = [np.isin(textkit._codes, list(c)).astype(np.int64) for c in (b".", b",", b"\n", b"*#$%&|!<>{}[]=", b"0123456789")] + [textkit.UPPER.astype(np.int64)]


def word_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of the distinct words, words of each row, and dense features."""
    h, first = textkit.words(data, offsets)
    n, n_words = len(offsets) - 1, np.diff(first)
    row = np.repeat(np.arange(n, dtype=np.int64), n_words)
    key = np.unique(row * BUCKETS + (h >> np.uint64(46)).astype(np.int64))
    row, bucket = key // BUCKETS, key % BUCKETS
    size = np.maximum(np.diff(offsets), 1)
    dense = np.zeros((n, len(_MARKS) + 3))
    base = int(offsets[0])
    for i, table in enumerate(_MARKS):
        at = np.flatnonzero(table[data[base : int(offsets[-1])]]) + base
        dense[:, i] = np.sqrt(np.diff(np.searchsorted(at, offsets)) / size)
    dense[:, -3] = np.bincount(row, minlength=n) / np.maximum(n_words, 1)
    dense[:, -2] = np.log1p(n_words) / 10
    dense[:, -1] = np.minimum(size / np.maximum(n_words, 1), 20) / 10
    return row, bucket, n_words, dense


@dataclass
class Classifier:
    column: np.ndarray  # of each bucket; -1: not chosen
    weights: np.ndarray  # words, dense features, bias; by domain

    def posteriors(self, n: int, row: np.ndarray, bucket: np.ndarray, dense: np.ndarray) -> np.ndarray:
        words = len(self.weights) - dense.shape[1] - 1
        z = dense @ self.weights[words:-1] + self.weights[-1]
        c = self.column[bucket]
        at = c >= 0
        for d in range(z.shape[1]):
            z[:, d] += np.bincount(row[at], self.weights[c[at], d], minlength=n)
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)


def fit(rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, epochs: int = 300) -> Classifier:
    """Softmax regression on the CHOSEN buckets that tell the classes apart best."""
    k, n = len(DOMAINS), len(rows)
    column = np.full(BUCKETS, -1, np.int64)
    width = dense.shape[1] if n else len(_MARKS) + 3
    if not n:
        weights = np.zeros((width + 1, k))
        weights[-1, 0] = 50.0
        return Classifier(column, weights)
    row, bucket = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows]), np.concatenate(rows)
    share = np.bincount(y, minlength=k) / n
    seen = np.array([np.bincount(bucket[y[row] == d], minlength=BUCKETS) for d in range(k)])
    total = seen.sum(axis=0)
    expected = total * share[:, None]
    chi = ((seen - expected) ** 2 / np.maximum(expected, 1e-9)).sum(axis=0) * (total >= 3)
    chosen = np.argsort(-chi, kind="stable")[:CHOSEN]
    chosen = chosen[chi[chosen] > 6.0]
    column[chosen] = np.arange(len(chosen))
    x = np.zeros((n, len(chosen) + width + 1), np.float32)
    at = column[bucket] >= 0
    x[row[at], column[bucket[at]]] = 1
    x[:, len(chosen) : -1], x[:, -1] = dense, 1
    truth = np.eye(k, dtype=np.float32)[y]
    weights, velocity = np.zeros((x.shape[1], k), np.float32), np.zeros((x.shape[1], k), np.float32)
    rate = np.float32(4.0 / max(1.0, float(np.einsum("ij,ij->", x, x)) / n))
    decay, momentum = np.float32(2e-3), np.float32(0.9)
    for _ in range(epochs):
        ahead = weights + momentum * velocity
        z = x @ ahead
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        slope = x.T @ (p - truth) / np.float32(n) + decay * ahead
        velocity = momentum * velocity - rate * slope
        weights = weights + velocity
    return Classifier(column, weights.astype(np.float64))


def train(documents: DataFrame, labels: DataFrame, most_rows: int = TRAINING_ROWS) -> Classifier:
    toxic, quality = F.max("toxic"), F.min("quality")
    domain = F.when(toxic == 1, 2).when(quality == 0, 1).when(quality.isNotNull() | toxic.isNotNull(), 0)
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(domain.alias("y")).where("y is not null")
    share = most_rows / max(1, known.count())
    place = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(place < share).limit(most_rows + most_rows // 4)  # bounded: fits a broadcast
    rows = documents.select("doc_id", text_bytes().alias("t")).join(F.broadcast(chosen), "doc_id").limit(most_rows + most_rows // 2)

    def gather(batches):
        for batch in batches:
            data, offsets = textkit.buffers(batch.column("t"))
            for lo, hi in textkit.ranges(offsets):
                row, bucket, _, dense = word_sets(data, offsets[lo : hi + 1])
                edge = np.searchsorted(row, np.arange(hi - lo + 1))
                bucket = bucket.astype(np.int32)
                lists = pa.array([bucket[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("y").slice(lo, hi - lo), lists, pa.array([d.tobytes() for d in dense], pa.binary())], ["doc_id", "y", "b", "d"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    got = sorted(in_arrow(rows, gather, f"doc_id {kind}, y int, b binary, d binary").collect(), key=lambda r: (r["doc_id"], bytes(r["d"])))
    return fit([np.frombuffer(bytes(r["b"]), np.int32) for r in got], np.array([np.frombuffer(bytes(r["d"])) for r in got]).reshape(len(got), len(_MARKS) + 3), np.array([r["y"] for r in got], np.int64))


_JUDGED = [T.StructField("n_tokens", T.LongType()), *(T.StructField(f"p_{d}", T.DoubleType()) for d in DOMAINS)]


def posteriors(documents: DataFrame, classifier: Classifier) -> DataFrame:
    """All columns of documents, n_tokens (words) and a posterior for each domain."""
    shared = documents.sparkSession.sparkContext.broadcast(classifier)
    new = [f.name for f in _JUDGED]
    names = [c for c in documents.columns if c not in (*new, "rate", "copies")]
    rows = documents.select(names)

    def run(batches):
        for batch in batches:
            data, offsets = textkit.buffers(batch.column("text"))
            for lo, hi in textkit.ranges(offsets):
                row, bucket, n_words, dense = word_sets(data, offsets[lo : hi + 1])
                p = shared.value.posteriors(hi - lo, row, bucket, dense)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(n_words), *(pa.array(p[:, d]) for d in range(len(DOMAINS)))], [*names, *new])

    return in_arrow(rows, run, T.StructType([*(rows.schema[c] for c in names), *_JUDGED]))


def rates(tokens: np.ndarray, p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """The rates after the steps so far, each a vector over domains."""
    a, r = tokens[:, None] * p, np.ones(len(tokens))
    for g in steps:
        r = np.maximum(0.0, r - a @ g)
    return r


def _pass(judged: DataFrame, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Domain totals at the rates so far, and the Gram matrix of the rows that can still move."""
    k = len(DOMAINS)

    def run(batches):
        total, gram = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            n = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            p = np.stack([batch.column(1 + d).to_numpy(zero_copy_only=False) for d in range(k)], axis=1)
            a, r = n[:, None] * p, rates(n, p, steps)
            total += r @ a
            gram += a[r > 0].T @ a[r > 0]
        yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in (*total, *gram.reshape(-1))], [f"t{i}" for i in range(k + k * k)])

    width = k + k * k
    parts = judged.select(*(f.name for f in _JUDGED)).mapInArrow(run, ", ".join(f"t{i} double" for i in range(width)))
    sums = np.array([x or 0.0 for x in parts.agg(*(F.sum(f"t{i}") for i in range(width))).first()])
    return sums[:k], sums[k:].reshape(k, k)


def fit_rates(judged: DataFrame, targets: dict[str, float], steps: int = STEPS) -> tuple[list[np.ndarray], float]:
    """The steps of projected gradient descent and what is left of the distance, as a share of all tokens.

    judged holds n_tokens and posteriors. A step that does not bring the totals nearer is
    halved and tried again; when no length helps, the least distance is reached.
    """
    share = np.array([targets[d] for d in DOMAINS], float)
    taken: list[np.ndarray] = []
    total, gram = _pass(judged, taken)
    goal = share / share.sum() * total.sum()
    far = lambda t: float(np.abs(t - goal).max() / max(goal.sum(), 1.0))
    tried, length = 0, 1.0
    while gram.any() and tried < steps and far(total) > CLOSE and length > 1e-3:
        # domains that no row belongs to cannot be moved
        inverse = np.linalg.pinv(gram, rcond=1e-9, hermitian=True)
        metric = lambda t, m=inverse: float((t - goal) @ m @ (t - goal))
        step = length * (inverse @ (total - goal))
        after, moved = _pass(judged, [*taken, step])
        tried += 1
        if metric(after) < metric(total) * (1 - 1e-6):
            taken.append(step)
            total, gram, length = after, moved, 1.0
        else:
            length /= 2
    return taken, far(total)


def mix(documents: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """All columns, n_tokens, a posterior for each domain, rate (expected uses) and copies.

    copies is rate rounded up or down by a hash of doc_id, so that its mean is rate.
    """
    judged = written(posteriors(documents, train(documents, labels)), "judged")
    steps, left = fit_rates(judged, targets or TARGETS)
    if left > CLOSE:
        warnings.warn(f"the targets are missed by {left:.2%} of the tokens", stacklevel=2)
    rate = F.lit(1.0)
    a = [F.col("n_tokens") * F.col(f"p_{d}") for d in DOMAINS]
    for g in steps:
        move = sum((x * float(w) for x, w in zip(a, g, strict=True)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate - move)
    place = F.pmod(F.coalesce(F.xxhash64("doc_id", F.lit(5)), F.lit(0)), F.lit(1 << 30)) / float(1 << 30)
    out = judged.withColumn("rate", rate)
    return out.withColumn("copies", (F.floor("rate") + F.when(place < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("bigint"))
