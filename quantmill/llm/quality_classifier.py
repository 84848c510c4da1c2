"""Quality scores from supervised subword embeddings.

A text is cut at space and \\x09-\\x0D. Its features are its words, its pairs of neighbouring
words, and the runs of 3 to 5 bytes inside a word with a mark at either end; a word that repeats
the one before it is one feature more, whatever the word. Each feature is hashed to one of
``BUCKETS`` vectors of ``DIMENSIONS`` numbers. The mean of the vectors of a text goes through a
softmax layer. Vectors and layer are trained together by stochastic gradient descent in NumPy.

Training takes at most ``TRAINING_ROWS`` labelled documents that are not held out (the least
hashes of doc_id and text), and of these, in the order of the hash, as many as have
``TRAINING_BYTES`` of features together; only labels, doc_id (for the choice and the held-out
rows) and texts are read. Of several labels of a document the largest holds; null labels and
null ids are not learned from. Nothing but the text is the input of a score. Scoring reads whole
texts: the layer is applied to the vectors once, so that a text's score is a mean over its
features of one number a class.

Null and empty texts have no features and get what the layer's constant says. With no labelled
row all texts score 0.5, with a single label all score 1 or 0. Repeated rows are judged one by
one (and learned from once), an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit
from .shared import in_arrow, removed, text_bytes, written

BUCKETS, DIMENSIONS, EPOCHS, RATE = 1 << 16, 16, 12, 1.0
TRAINING_ROWS, TRAINING_BYTES = 6000, 96 << 20
#: Scores from here on are predicted as label 1.
GOOD_FROM = 0.3
#: Bytes that are hashed at once; a longer text goes on in pieces that end between words where they can.
PIECE = 1 << 19

_SPACE = (textkit._codes == 32) | ((textkit._codes >= 9) & (textkit._codes <= 13))
_FOLD = np.where(_SPACE, 32, textkit._codes).astype(np.uint8)
_SHIFT = np.uint64(64 - 16)
_REPEAT = np.uint64(0x51ED270B35F1A2C3)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * textkit.BASE) >> _SHIFT).astype(np.int32)


def _piece_features(b: np.ndarray, row: np.ndarray, before: tuple[np.uint64, int] | None):
    """Rows and buckets of folded bytes where every row ends with a space; and the last word's hash and row."""
    space = b == 32
    rows, found = [], []
    wide = b.astype(np.uint64)
    gram = wide[:-2] | (wide[1:-1] << np.uint64(8)) | (wide[2:] << np.uint64(16))
    inner = ~space[1:-1]
    for size in (3, 4, 5):
        if size > 3:
            gram = gram[:-1] | (wide[size - 1 :] << np.uint64(8 * (size - 1)))
            inner = inner[:-1] & ~space[size - 2 : -1]
        at = np.flatnonzero(inner)
        found.append(_bucket(gram[at] + np.uint64(size)))
        rows.append(row[at + 1])
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    last = np.flatnonzero(~space & np.concatenate([space[1:], [True]]))
    if len(first):
        sums = np.cumsum((wide + np.uint64(1)) * textkit._power(len(b), textkit.BASE)[: len(b)], dtype=np.uint64)
        h = (sums[last] - np.where(first > 0, sums[first - 1], np.uint64(0))) * textkit._power(len(b), textkit.BASE_INVERSE)[first]
        h = textkit.mix(h + (last - first + 1).astype(np.uint64) * textkit.MIX_2)
        of = row[first]
        found.append(_bucket(h))
        rows.append(of)
        prior, prior_of = np.concatenate([[before[0] if before else np.uint64(0)], h[:-1]]), np.concatenate([[before[1] if before else -1], of[:-1]])
        pair = prior_of == of
        found.append(_bucket(textkit.mix(prior[pair] * textkit.MIX_1 + h[pair])))
        rows.append(of[pair])
        again = pair & (prior == h)
        found.append(np.full(int(again.sum()), int(_bucket(np.array([_REPEAT]))[0]), np.int32))
        rows.append(of[again])
        before = (h[-1], int(of[-1]))
    return np.concatenate(rows), np.concatenate(found), before


def features(data: np.ndarray, offsets: np.ndarray):
    """(rows, buckets) of all features of the texts, in pieces of bounded size."""
    lo, n, before = 0, len(offsets) - 1, None
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, side="right")) - 1)
        at, end = int(offsets[lo]), int(offsets[hi])
        while at < end:
            stop = min(end, at + 4 * PIECE)
            if stop < end:
                gaps = np.flatnonzero(_SPACE[data[at:stop]])
                stop = at + int(gaps[-1]) + 1 if len(gaps) else stop
            ends = np.clip(offsets[lo + 1 : hi + 1], at, stop) - at
            sizes = np.diff(np.concatenate([[0], ends]))
            b = np.concatenate([[np.uint8(32)], np.insert(_FOLD[data[at:stop]], ends, np.uint8(32))])
            row = np.repeat(np.arange(lo, hi), sizes + 1)
            rows, found, before = _piece_features(b, np.concatenate([row[:1], row]), before)
            yield rows, found
            at = stop
        lo = hi


@dataclass
class Model:
    """One number for each class and bucket (the layer applied to its vector), and the layer's constants."""

    classes: list[int]
    scores: np.ndarray  # (BUCKETS, classes)
    constants: np.ndarray

    def good(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each text."""
        n, k = len(offsets) - 1, len(self.classes)
        if k < 2 or 1 not in self.classes:
            return np.full(n, 0.5 if k == 0 else float(self.classes == [1]))
        sums, count = np.zeros((n, k)), np.zeros(n)
        for rows, found in features(data, offsets):
            lo, hi = int(rows.min(initial=n)), int(rows.max(initial=-1)) + 1
            count[lo:hi] += np.bincount(rows - lo, minlength=hi - lo)
            for c in range(k):
                sums[lo:hi, c] += np.bincount(rows - lo, self.scores[found, c], minlength=hi - lo)
        z = sums / np.maximum(count, 1)[:, None] + self.constants
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e[:, self.classes.index(1)] / e.sum(axis=1)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> Model:
    """Train on (label, buckets, counts) of each text; buckets are distinct."""
    classes = sorted({label for label, _, _ in rows})
    if len(classes) < 2:
        return Model(classes, np.zeros((BUCKETS, len(classes)), np.float32), np.zeros(len(classes)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer, constants = np.zeros((len(classes), DIMENSIONS), np.float32), np.zeros(len(classes), np.float32)
    seen = np.zeros(BUCKETS, bool)
    place = {c: i for i, c in enumerate(classes)}
    # each feature's step is its share of the text times the root of their number, so that long texts move their vectors too
    examples = [(place[label], at, (n / max(1, n.sum())).astype(np.float32)) for label, at, n in rows]
    for _, at, _ in examples:
        seen[at] = True
    steps, done = epochs * len(examples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            y, at, share = examples[i]
            step = np.float32(rate * (1 - done / steps))
            done += 1
            mine = vectors[at]
            mean = share @ mine
            z = layer @ mean + constants
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ layer
            layer -= step * np.outer(p, mean)
            constants -= np.float32(0.1) * step * p
            vectors[at] = mine - np.outer((step * share) * np.float32(len(at)) ** np.float32(0.5), back)
    vectors[~seen] = 0
    return Model(classes, (vectors @ layer.T).astype(np.float32), constants.astype(np.float64))


def training_rows(documents: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = TRAINING_ROWS, most_bytes: int = TRAINING_BYTES) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, buckets, counts) of a bounded sample of the labelled rows that are not held out."""
    spark = documents.sparkSession
    said = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("long").alias("label"))
    least = said.select("doc_id", "label", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(most_rows).select("doc_id", "label").collect()
    if not least:
        return []
    chosen = spark.createDataFrame(least, said.schema)  # at most most_rows pairs of numbers
    texts = documents.select("doc_id", text_bytes().alias("t")).join(F.broadcast(chosen), "doc_id").withColumn("h", F.xxhash64("doc_id", "t"))
    keys = [r["h"] for r in texts.groupBy("h").count().orderBy("h").limit(most_rows).collect()]
    picked = spark.createDataFrame([(k,) for k in keys], "h long")

    def counted(batches):
        for batch in batches:
            data, offsets = textkit.buffers(batch.column("t"))
            for i in range(batch.num_rows):
                total = np.zeros(BUCKETS, np.int64)
                for _, found in features(data, offsets[i : i + 2]):
                    total += np.bincount(found, minlength=BUCKETS)
                at = np.flatnonzero(total)
                one = batch.slice(i, 1)
                x = np.concatenate([at.astype(np.int32), total[at].astype(np.float32).view(np.int32)]).tobytes()
                yield pa.RecordBatch.from_arrays([one.column("h"), one.column("label"), pa.array([len(x)], pa.int64()), pa.array([x], pa.binary())], ["h", "label", "size", "x"])

    table = written(in_arrow(texts.join(F.broadcast(picked), "h").select("h", "label", "t"), counted, "h long, label long, size long, x binary").dropDuplicates(["h", "label"]), "quality_training")
    sizes = table.select("h", "size").orderBy("h").collect()
    upto = np.searchsorted(np.cumsum([r["size"] for r in sizes]), most_bytes, side="right")
    got = table.where(F.col("h") <= sizes[min(int(upto), len(sizes) - 1)]["h"]).select("h", "label", "x").collect() if sizes else []
    removed(table)
    out = []
    for r in sorted(got, key=lambda r: (r["h"], r["label"])):
        x = np.frombuffer(bytes(r["x"]), np.int32)
        out.append((r["label"], x[: len(x) // 2], x[len(x) // 2 :].view(np.float32)))
    return out


def train(documents: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    return fit(training_rows(documents, labels, label))


def score(documents: DataFrame, labels: DataFrame | None = None, model: Model | None = None, good_from: float = GOOD_FROM) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 from good_from on)."""
    shared = documents.sparkSession.sparkContext.broadcast(model or train(documents, labels))
    rows = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text_bytes().alias("t"))

    def run(batches):
        for batch in batches:
            data, offsets = textkit.buffers(batch.column("t"))
            for lo, hi in textkit.ranges(offsets):
                p = shared.value.good(data, offsets[lo : hi + 1])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= good_from).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return in_arrow(rows, run, T.StructType([rows.schema["doc_id"], rows.schema["held_out"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
