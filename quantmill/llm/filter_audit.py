"""What five quality filters remove, in every order of them.

Filters (words are maximal runs of other characters than space and \\x09-\\x0D, as they are
written; null text is empty):

* A: under 50 words
* B: 100 * distinct words < 65 * words
* C: 100 * characters A-Z > 5 * code points
* D: holds one of ``#$%&*|``
* E: identical to the text of a smaller doc_id anywhere in the table

Every document becomes the set of filters that it fails (a mask of five bits). Whether it
fails E is found by an RDD routed by the fingerprint of the text (xxhash, 64 bits): the
partition of a fingerprint holds a chain of the different texts that share it, each in full
(compressed) with its least doc_id, and gives out the ids that are not the least. Each map
task keeps such chains itself first, so that a text goes out once for each ``HELD_BYTES`` of
distinct text, however many rows hold it; ids that are beaten there go on without their text,
spread by their own hash. A partition reads its records sorted by fingerprint (Spark's
external sort), so that it holds one chain at a time.

Masks are counted by part of the corpus in vectors that ``combineByKey`` adds up, in the map
tasks first. The counts of all 120 orders follow from these 32 numbers for each part.

Rows with a null doc_id never fail E and make no other row fail it. Rows of one doc_id do not
make each other fail E; each row counts. A document with several labels is good or toxic if one
of them says so. Null sources count as the empty string. An empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
A, B, C, D, E = (1 << i for i in range(5))
#: Bytes of distinct text, and rows without a text, that a map task holds before it gives them out.
HELD_BYTES, HELD_ROWS = 32 << 20, 200_000
#: A text up to this length is cut into a list of words, a longer one word by word.
LISTED = 1 << 20

_CAPITALS, _MARKS, _CONTINUED = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))
_LEAST, _BEATEN = 0, 1


def _word_counts(text: bytes) -> tuple[int, int]:
    if len(text) <= LISTED:
        words = text.split()  # of bytes: cuts at space and \x09-\x0D, and nowhere else
        return len(words), len(set(words))
    import re

    n, distinct = 0, set()
    for found in re.finditer(rb"[^\x20\x09-\x0D]+", text):
        n += 1
        distinct.add(found[0])
    return n, len(distinct)


def own_failures(text: bytes) -> int:
    """The filters A to D that a text (UTF-8) fails."""
    n, distinct = _word_counts(text)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _CONTINUED))
    marked = len(text) != len(text.translate(None, _MARKS))
    return A * (n < 50) | B * (100 * distinct < 65 * n) | C * (100 * capitals > 5 * points) | D * marked


def _chains_of_task(rows):
    """(route, record) of one map task: each distinct text with its least id, and the beaten rows."""
    import xxhash
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    chains: dict[int, list[list]] = {}
    beaten: Counter = Counter()
    held = 0

    def given():
        for fp, chain in chains.items():
            for text, mask, least, parts in chain:
                yield fp, (_LEAST, least, mask, dict(parts), pack(text))
        for (doc_id, part, mask), n in beaten.items():
            yield xxhash.xxh64_intdigest(repr((doc_id, part))), (_BEATEN, doc_id, mask, part, n)
        chains.clear()
        beaten.clear()

    for doc_id, part, text in rows:
        text = bytes(text)
        if doc_id is None:
            beaten[None, part, own_failures(text)] += 1
        else:
            chain = chains.setdefault(xxhash.xxh64_intdigest(text), [])
            link = next((x for x in chain if x[0] == text), None)
            if link is None:
                chain.append([text, own_failures(text), doc_id, Counter([part])])
                held += len(text) + 200
            elif doc_id == link[2]:
                link[3][part] += 1
            elif doc_id > link[2]:
                beaten[doc_id, part, link[1] | E] += 1
            else:
                for other, n in link[3].items():
                    beaten[link[2], other, link[1] | E] += n
                link[2:] = doc_id, Counter([part])
        if held > HELD_BYTES or len(beaten) > HELD_ROWS:
            yield from given()
            held = 0
    yield from given()


def _chains_of_fingerprint(records):
    """(doc_id, part, mask, rows) from sorted records: in each chain all but the least id of a text fail E."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress

    def same(x: bytes, y: bytes) -> bool:
        return x == y or unpack(x) == unpack(y)

    for _, group in itertools.groupby(records, key=lambda r: r[0]):
        chain: list[list] = []
        for _, (kind, doc_id, mask, parts, rest) in group:
            if kind == _BEATEN:
                yield doc_id, parts, mask, rest
                continue
            link = next((x for x in chain if same(x[0], rest)), None)
            if link is None:
                chain.append([rest, mask, doc_id, Counter(parts)])
                continue
            if doc_id == link[2]:
                link[3].update(parts)
                continue
            lost, of = (doc_id, parts) if doc_id > link[2] else (link[2], link[3])
            for part, n in of.items():
                yield lost, part, mask | E, n
            if doc_id < link[2]:
                link[2:] = doc_id, Counter(parts)
        for _, mask, least, parts in chain:
            for part, n in parts.items():
                yield least, part, mask, n


def failures(documents: DataFrame, part: str = "source", name: str = "documents") -> DataFrame:
    """doc_id, part, mask (bits A=1 to E=16), n_rows: the filters that each document fails.

    `name` is what the RDD of the documents is called in the UI and the event log, where an RDD has no plan. Rows that agree in all three may come as one row or as several; n_rows adds up to the table's rows.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    source: RDD[Row] = rows.rdd.setName(name)
    n = max(source.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    routed = source.mapPartitions(_chains_of_task).repartitionAndSortWithinPartitions(n, lambda fp: fp % n)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("n_rows", T.LongType())])
    return spark.createDataFrame(routed.mapPartitions(_chains_of_fingerprint), schema, verifySchema=False)


def repeated_ids(documents: DataFrame) -> DataFrame:
    """doc_id of every row whose text a smaller doc_id has too (once for each row)."""
    empty = documents.select("doc_id", "text").withColumn("source", F.lit(""))
    found = failures(empty).where(F.col("mask").bitwiseAND(E) != 0)
    return found.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n_rows")))).select("doc_id")


def _steps() -> tuple[list[tuple[str, int]], np.ndarray]:
    """(order, step) and, by [which, row, mask], whether a mask is kept, removed, redundant or fails this filter only; last the share of Shapley."""
    keys, which = [], np.zeros((5, len(ORDERS) * 5, 32), np.int64)
    masks = np.arange(32)
    size = np.array([bin(m).count("1") for m in masks])
    for order in ORDERS:
        before = 0
        for step, name in enumerate(order, 1):
            bit, row = 1 << FILTERS.index(name), len(keys)
            fails, earlier = masks & bit > 0, masks & before > 0
            which[0, row], which[1, row], which[2, row], which[3, row] = masks & (before | bit) == 0, fails & ~earlier, fails & earlier, masks == bit
            which[4, row] = np.where(fails, len(ORDERS) // np.maximum(size, 1), 0)  # of all orders, those in which it comes first of the failing
            keys.append((order, step))
            before |= bit
    return keys, which


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(documents: DataFrame, labels: DataFrame, part: str = "source", name: str = "documents") -> DataFrame:
    """Per part, order of the filters and step: the counts named in ``RESULT``."""
    spark = documents.sparkSession
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c) for c in ("quality", "toxic")))
    masks = failures(documents, part, name).join(said, "doc_id", "left")
    rows = masks.select("part", "mask", "n_rows", F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0))).rdd

    def begun(x):
        return added(np.zeros((32, 3), np.int64), x)

    def added(counts, x):
        mask, n, good, toxic = x
        counts[mask] += (n, n * good, n * toxic)
        return counts

    counted = rows.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(begun, added, lambda x, y: x + y)

    def orders(vectors):
        keys, which = _steps()
        for name, counts in vectors:
            kept, removed, redundant, unique, shapley = which @ counts[:, 0]
            good, toxic = which[1] @ counts[:, 1], which[1] @ counts[:, 2]
            for i, (order, step) in enumerate(keys):
                yield (name, order, step, *(int(x[i]) for x in (kept, removed, redundant, unique, good, toxic, shapley)))

    return spark.createDataFrame(counted.mapPartitions(orders), RESULT, verifySchema=False)


SQL = r"""
WITH said AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), failed AS (
  SELECT part, doc_id,
    [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f
  FROM texts
), counted AS (
  SELECT part, f, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM failed LEFT JOIN said USING (doc_id) GROUP BY part, f
), names AS (SELECT unnest(range(1, 6)) AS i), orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM names a, names b, names c, names d, names e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (
  SELECT o, array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') AS filter_order, unnest(range(1, 6)) AS step FROM orders
), judged AS (
  SELECT part, filter_order, step, o[step] AS which, n, good, toxic, f[o[step]] AS fails,
    len(list_filter(o[1:step - 1], lambda x: f[x])) > 0 AS earlier, len(list_filter(f, lambda x: x)) AS n_fails
  FROM counted, steps
), done AS (
  SELECT part, filter_order, step, which,
    sum(CASE WHEN NOT fails AND NOT earlier THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT earlier THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails AND earlier THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails AND NOT earlier THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, which
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, which) AS BIGINT) AS shapley
FROM done
"""
