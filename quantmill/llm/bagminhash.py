"""Near-duplicate groups by BagMinHash signatures, banding and exact verification.

A document is the multiset of its shingles (five consecutive words; a document of fewer
words, but not none, is one shingle). Signatures follow weighted minwise hashing with
hierarchical Poisson processes: the weight axis of every shingle is cut into dyadic
stretches [0,1), [1,2), [2,4), ..., each with a Poisson process of its own whose points
carry a time, a register and a weight; points above the shingle's count are thinned out,
and a register keeps its earliest time. Two documents agree in a register with a
probability that is exactly their weighted Jaccard similarity. A process stops at the
first time later than all registers of its document, so most shingles draw one number.

Documents with equal multisets form a class first, and one representative of each goes
on. Banding proposes buckets; within a bucket pairs are never emitted. First all members are
compared with one leader (linear in the bucket), the multiset overlap verified exactly, and
components joined. What can still be missing are links between different components of a
bucket: the members outside its largest component are compared with all members, in blocks
of bounded size whose overlaps are one matrix product, and each block returns no more links
than it joins components. So every pair that shares a band is either verified or already in
one group; work beyond the linear part grows with the members that stay apart.

Documents without words (null, empty, punctuation only) are alone in their group. A null
doc_id has a null group and is kept. Rows sharing a doc_id are one document: their groups
are joined, and the stage keeps one row. Empty tables give empty results. Only doc_id and
text are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import textkit
from .shared import in_arrow, removed, written

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 26, 5  # a pair at 0.8 shares a band with probability 0.99997
#: Rows of ids up to which a side is broadcast (16 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Members on each side of a block that is compared at once, and elements of one product.
BLOCK, COLUMNS = 256, 4096
#: Members that one copy of a leader's elements is compared with.
LED = 256

_STEP = 0x9E3779B97F4A7C15


def bags(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle and count of the multisets, sorted by row and shingle."""
    h, first = textkit.words(data, offsets)
    s, begin = textkit.shingles(h, first, k)
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((s, row))
    row, s = row[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (row[1:] != row[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    return row[at], s[at], np.diff(np.append(at, len(s)))


def signatures(n_rows: int, row: np.ndarray, shingle: np.ndarray, count: np.ndarray, registers: int) -> np.ndarray:
    """Register times of each row; infinite where a row has no shingle."""
    times = np.full(n_rows * registers, np.inf)
    if not len(row):
        return times.reshape(n_rows, registers)
    # dyadic stretches of the weight axis below each count
    stretches = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 1)
    which = np.repeat(np.arange(len(row)), stretches)
    level = np.arange(len(which)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    size = np.where(level > 1, 2.0 ** (level - 1), 1.0)
    seed = textkit.mix(shingle[which] + (level.astype(np.uint64) + np.uint64(1)) * textkit.MIX_2)
    row, most = row[which], count[which].astype(np.float64)
    t = np.zeros(len(row))
    i = 0
    while len(row):
        i += 1
        u = textkit.mix(seed + np.uint64(i * _STEP & (1 << 64) - 1))
        v = textkit.mix(u + textkit.MIX_1)
        t = t - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / size
        register = (((v >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)).astype(np.int64)
        weight = low + size * ((v & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32)
        ok = weight < most
        np.minimum.at(times, (row * registers + register)[ok], t[ok])
        alive, place = np.unique(row, return_inverse=True)
        latest = times.reshape(n_rows, registers)[alive].max(axis=1)
        go = t < latest[place]
        row, seed, low, size, most, t = row[go], seed[go], low[go], size[go], most[go], t[go]
    return times.reshape(n_rows, registers)


def band_keys(times: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each row and band."""
    bits = np.ascontiguousarray(times).view(np.uint64).reshape(len(times), bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * textkit.MIX_1 + np.zeros((len(times), 1), np.uint64)
    for i in range(rows):
        key = textkit.mix(key * textkit.BASE + bits[:, :, i])
    return key.view(np.int64)


def _signed(batches):
    for batch in batches:
        data, offsets = textkit.buffers(batch.column("text"))
        for lo, hi in textkit.ranges(offsets):
            n = hi - lo
            row, s, c = bags(data, offsets[lo : hi + 1])
            total = np.bincount(row, c, minlength=n).astype(np.int64)
            sums = []
            for salt in (textkit.MIX_1, textkit.MIX_2):
                running = np.concatenate([[np.uint64(0)], np.cumsum(textkit.mix(textkit.mix(s + salt) + c.astype(np.uint64)), dtype=np.uint64)])
                edge = np.searchsorted(row, np.arange(n + 1))
                sums.append((running[edge[1:]] - running[edge[:-1]]).view(np.int64))
            keys = band_keys(signatures(n, row, s, c, BANDS * ROWS))
            size = np.where(total > 0, BANDS, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(keys[total > 0].reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), pa.array(total), pa.array(sums[0]), pa.array(sums[1]), lists], ["doc_id", "n", "b1", "b2", "bands"])


def _elements(batches):
    """Multisets as sets: the j-th copy of a shingle is an element of its own."""
    for batch in batches:
        data, offsets = textkit.buffers(batch.column("text"))
        for lo, hi in textkit.ranges(offsets):
            row, s, c = bags(data, offsets[lo : hi + 1])
            copy = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            element = textkit.mix(np.repeat(s, c) + copy.astype(np.uint64) * textkit.MIX_2).view(np.int64)
            edge = np.concatenate([[0], np.cumsum(np.bincount(row, c, minlength=hi - lo))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(edge), pa.array(element))], ["doc_id", "e"])


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast an id table whose counted rows stay within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for the ends a, b of the edges; comp is the least id of the component.

    Least labels flow over the edges and labels jump to their own label, until nothing
    changes; each step is a written table.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "id", "left").select("id", F.least("comp", "near").alias("now"), F.col("comp").alias("was"))
        jump = labels.select(F.col("id").alias("now"), F.col("comp").alias("far"))
        step = step.join(jump, "now", "left").select("id", F.least("now", "far").alias("comp"), "was")
        step = written(step, "labels")
        removed(labels)
        labels = step.select("id", "comp")
        if step.where("comp != was").limit(1).count() == 0:
            return labels


def _verified(pairs: DataFrame, elements: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough.

    A leader b of many pairs has its elements copied once for every ``LED`` of them, so that
    its pairs are dealt out.
    """
    led = pairs.groupBy("b").agg(F.ceil(F.count("*") / LED).cast("int").alias("parts"))
    copies = elements.select(F.col("doc_id").alias("b"), F.col("e").alias("eb")).join(led, "b").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = pairs.join(led, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    left = elements.select(F.col("doc_id").alias("a"), F.col("e").alias("ea")).join(dealt, "a")
    both = left.join(copies, ["b", "part"])
    # a pair of very different sizes cannot be similar
    both = both.where(F.least(F.size("ea"), F.size("eb")) >= similarity * F.greatest(F.size("ea"), F.size("eb")) - 1e-9)
    shared = F.size(F.array_intersect("ea", "eb"))
    return both.select("a", "b", shared.alias("s"), (F.size("ea") + F.size("eb")).alias("n")).where(F.col("s") >= similarity * (F.col("n") - F.col("s")) - 1e-9).select("a", "b")


def _apart(members: DataFrame, comp: DataFrame, elements: DataFrame, similarity: float) -> DataFrame:
    """Links between different components of a bucket; members holds key and id."""
    placed = members.join(comp, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum(F.xxhash64("id").bitwiseAND((1 << 40) - 1)).alias("h"))
    sizes = sizes.groupBy("key").agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("h").alias("h"), F.count("*").alias("k")).where("k > 1")
    # buckets with the same members need one comparison
    sizes = sizes.groupBy("n", "most", "main", "h", "k").agg(F.min("key").alias("key"))
    parts = lambda c: F.ceil(c / F.lit(BLOCK)).cast("int")
    sizes = sizes.select("key", "main", parts(F.col("n") - F.col("most")).alias("na"), parts(F.col("n")).alias("nb"))
    rows = written(placed.join(sizes, "key").join(elements.withColumnRenamed("doc_id", "id"), "id"), "apart")
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("comp != main").withColumn("ta", at("na")).withColumn("tb", every("nb")).select("key", "ta", "tb", "id", "comp", "e")
    right = rows.withColumn("tb", at("nb")).withColumn("ta", every("na")).select("key", "ta", "tb", "id", "comp", "e")

    ids = placed.schema["id"].dataType
    kind = to_arrow_type(ids)

    def compare(_key, a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"a": pa.array([], kind), "b": pa.array([], kind)})
        codes = pa.concat_arrays([x.column("comp").combine_chunks() for x in (a, b)]).dictionary_encode().indices.to_numpy()
        lists = [x.column("e").combine_chunks() for x in (a, b)]
        sizes = [np.diff(np.asarray(x.offsets)) for x in lists]
        known, place = np.unique(np.concatenate([np.asarray(x.flatten()) for x in lists]), return_inverse=True)
        row = np.repeat(np.arange(len(a) + len(b)), np.concatenate(sizes))
        overlap = np.zeros((len(a), len(b)))
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        for lo in range(0, len(known), COLUMNS):
            cut = slice(*np.searchsorted(place, [lo, lo + COLUMNS]))
            x = np.zeros((len(a) + len(b), min(COLUMNS, len(known) - lo)), np.float32)
            x[row[cut], place[cut] - lo] = 1
            overlap += x[: len(a)] @ x[len(a) :].T
        total = sizes[0][:, None] + sizes[1][None, :]
        near = (overlap >= similarity * (total - overlap) - 1e-9) & (codes[: len(a), None] != codes[None, len(a) :])
        parent = np.arange(codes.max() + 1)

        def find(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        found: list[tuple] = []
        for i, j in zip(*np.nonzero(near), strict=True):
            x, y = find(codes[i]), find(codes[len(a) + j])
            if x != y:
                parent[max(x, y)] = min(x, y)
                found.append((i, j))
        at = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": a.column("id").combine_chunks().take(pa.array(at[:, 0])), "b": b.column("id").combine_chunks().take(pa.array(at[:, 1]))})

    return left.groupBy("key", "ta", "tb").cogroup(right.groupBy("key", "ta", "tb")).applyInArrow(compare, T.StructType([T.StructField("a", ids), T.StructField("b", ids)]))


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per document: doc_id, group_id (least doc_id of its group), is_kept (it is that one)."""
    rows = documents.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    signed = written(in_arrow(rows, _signed, f"doc_id {kind}, n bigint, b1 bigint, b2 bigint, bands array<bigint>"), "signed")
    named = signed.where("doc_id is not null and n > 0")
    classes = named.groupBy("b1", "b2").agg(F.min("doc_id").alias("rep"))
    classes = written(classes, "classes")
    first = named.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "b1", "b2"])
    banded = first.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key")).distinct()
    shared_keys = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lead")).where("n > 1")
    members = written(banded.join(shared_keys, "key").select("key", "id", "lead"), "members")

    # an id that stands in several classes (rows sharing a doc_id) joins them
    links = named.select(F.col("doc_id").alias("a"), "b1", "b2").distinct().join(classes, ["b1", "b2"]).select("a", F.col("rep").alias("b")).where("a != b")
    links = links.join(named.select(F.col("doc_id").alias("a"), "b1", "b2").distinct().groupBy("a").count().where("count > 1"), "a", "left_semi").select("a", "b")
    links = written(links, "links")

    comp = None
    if members.limit(1).count():
        ids = written(members.select(F.col("id").alias("doc_id")).distinct(), "candidates")
        chosen = rows.join(small(ids, ids.count()), "doc_id", "left_semi")
        elements = written(in_arrow(chosen, _elements, f"doc_id {kind}, e array<bigint>"), "elements")
        pairs = members.where("id != lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()
        links = written(links.unionAll(_verified(pairs, elements, similarity)), "links")
        rest = _apart(members.where("id != lead").select("key", "id"), components(links), elements, similarity)
        links = written(links.unionAll(rest), "links")
        comp = components(links)
        removed(ids, elements, members)
    elif links.limit(1).count():
        comp = components(links)

    out = signed.select("doc_id", "b1", "b2", (F.col("n") > 0).alias("has")).join(classes, ["b1", "b2"], "left")
    out = out.select("doc_id", F.when(F.col("has"), F.col("rep")).alias("rep"))
    if comp is not None:
        out = out.join(small(comp, comp.count()).withColumnRenamed("id", "rep"), "rep", "left")
        group = F.coalesce("comp", "rep", "doc_id")
    else:
        group = F.coalesce("rep", "doc_id")
    out = out.select("doc_id", F.when(F.col("doc_id").isNotNull(), group).alias("group_id"))
    return out.select("doc_id", "group_id", F.coalesce(F.col("doc_id") == F.col("group_id"), F.lit(True)).alias("is_kept"))


def keep_one(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents less all but one of each group, with all their columns."""
    groups = written(near_duplicates(documents, similarity), "groups")
    gone = groups.where("not is_kept").select("doc_id").distinct()
    kept = documents.join(small(gone, gone.count()), "doc_id", "left_anti")
    repeated = written(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if (n := repeated.count()) == 0:
        return kept.select(documents.columns)
    once = kept.join(small(repeated, n), "doc_id", "left_anti").unionByName(kept.join(small(repeated, n), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return once.select(documents.columns)
