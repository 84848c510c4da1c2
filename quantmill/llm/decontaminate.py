"""Benchmark decontamination with suffix arrays over the training text.

Each shard (a run of documents of bounded size) gets a suffix array over its words. Every
suffix of every benchmark item is binary-searched in it to its own end, which yields its
longest verbatim match; where that holds a whole window, all its places are read off the
array, and from each place the longest match gives the hit words, the item and hence the
document to remove. A match that merely continues one a word earlier is not told again.

Only stretches of training words that are all known to the benchmark, and long enough
to hold a window, enter the array: a suffix elsewhere cannot match a whole window, so
nothing is lost and the array stays a small part of the shard.

The benchmark goes in blocks of bounded bytes (an item beyond that in pieces that overlap
by a window less one word), each a broadcast file that a task loads, searches and lets go;
so neither the driver nor a worker holds more than one block, and one pass over the
documents does for any number of them. The work is the product of shards and blocks.

A window is ``window`` consecutive words of an item; an item of fewer words, but not
none, is one window. Null text has no words. Rows with a null item_id count as items
without a name: their windows hit, but they are not listed. Repeated rows are judged
one by one. Empty tables give empty results or no hits. Only doc_id, text, item_id and
text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit
from .shared import in_arrow, text_bytes

WINDOW = 10
#: Bytes of benchmark text of one block.
BENCHMARK_BLOCK_BYTES = 4 << 20
#: Bytes of training text of one suffix array.
SHARD_BYTES = 4 << 20
#: Benchmark suffixes that are searched at once, and occurrences looked at at once.
SEARCHED, LOOKED_AT = 1 << 14, 1 << 18


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; a lower token sorts first."""
    n = len(tokens)
    if n == 0:
        return np.zeros(0, np.int64)
    _, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int64).reshape(-1)
    order, step = np.argsort(rank, kind="stable"), 1
    while rank.max() < n - 1 and step < n:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        step *= 2
    return order


def _compare(train: np.ndarray, at: np.ndarray, test: np.ndarray, start: np.ndarray, most: np.ndarray, width: int = 16):
    """Common prefix of train[at:] and test[start:start+most], and whether train sorts first."""
    n = len(at)
    common, less, open_ = np.zeros(n, np.int64), np.zeros(n, bool), np.ones(n, bool)
    step = np.arange(width)
    while open_.any():
        rows = np.flatnonzero(open_)
        a = train[np.minimum(at[rows, None] + common[rows, None] + step, len(train) - 1)]
        b = test[np.minimum(start[rows, None] + common[rows, None] + step, len(test) - 1)]
        left = (most[rows] - common[rows])[:, None]
        differs = (a != b) | (step >= left)
        found = differs.any(axis=1)
        where = np.argmax(differs, axis=1)
        common[rows] += np.where(found, where, width)
        done = rows[found]
        ended = common[done] >= most[done]
        less[done] = ~ended & (a[found, where[found]] < b[found, where[found]])
        open_[done] = False
    return common, less


def _search(train, order, test, start, most, low, high, after: bool) -> np.ndarray:
    """First place of order from low to high whose suffix is not below (after: is above) the test prefix."""
    out = np.empty(len(start), np.int64)
    for cut in range(0, len(start), SEARCHED):
        part = slice(cut, cut + SEARCHED)
        at, size, lo, hi = start[part], most[part], low[part].copy(), high[part].copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            common, less = _compare(train, order[mid], test, at[open_], size[open_])
            right = less | (after & (common >= size[open_]))
            lo[open_], hi[open_] = np.where(right, mid + 1, lo[open_]), np.where(right, hi[open_], mid)
        out[part] = lo
    return out


@dataclass
class Benchmark:
    """The suffixes of one block of benchmark items, as word numbers."""

    known: np.ndarray  # sorted word hashes
    words: np.ndarray  # word numbers of all items, each followed by 0
    start: np.ndarray  # of each suffix
    place: np.ndarray  # its first word's place in its item
    left: np.ndarray  # its words up to the item's end
    item: np.ndarray  # its item
    window: np.ndarray  # the words of the window that starts there; 0: none
    names: list  # of items
    shortest: int

    @classmethod
    def of(cls, items: list[tuple], window: int) -> Benchmark:
        """items: name, text, and the place of the text's first word in its item."""
        data, offsets = textkit.buffers(pa.array([t for _, t, _ in items], pa.binary()))
        h, first = textkit.words(data, offsets)
        known = np.unique(h)
        size = np.diff(first)
        row = np.repeat(np.arange(len(items)), size)
        start = np.arange(len(h)) + row
        words = np.zeros(len(h) + len(items), np.int32)
        words[start] = np.searchsorted(known, h) + 1
        at = np.arange(len(h)) - first[:-1][row]
        left = size[row] - at
        length = np.minimum(size, window)[row]
        has = (left >= window) | ((size[row] < window) & (at == 0))
        place = at + np.array([p for _, _, p in items], np.int64)[row]
        return cls(known, words, *(x.astype(np.int32) for x in (start, place, left, row, np.where(has, length, 0))), [n for n, _, _ in items], int(length.min()) if len(h) else 0)


@dataclass
class Matches:
    """Longest verbatim matches in one shard, each holding a window."""

    begin: np.ndarray  # word place in the shard
    length: np.ndarray  # words
    suffix: np.ndarray  # which benchmark suffix


def _stretches(number: np.ndarray, first: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and size of the runs of known words within a document, at least as long as the shortest window."""
    known = number > 0
    opens, closes = known.copy(), known.copy()
    opens[1:] &= ~known[:-1]
    closes[:-1] &= ~known[1:]
    inner = first[1:-1]
    inner = inner[(inner > 0) & (inner < len(known))]
    opens[inner] = known[inner]
    closes[inner - 1] = known[inner - 1]
    s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    keep = e - s >= shortest
    return s[keep], (e - s)[keep]


def scan(h: np.ndarray, first: np.ndarray, bench: Benchmark) -> Matches:
    """Search all suffixes of the benchmark block in one shard of hashed words."""
    none = np.zeros(0, np.int64)
    if not len(h) or not len(bench.known):
        return Matches(none, none, none)
    place = np.minimum(np.searchsorted(bench.known, h), len(bench.known) - 1)
    number = np.where(bench.known[place] == h, place + 1, 0).astype(np.int32)
    s, size = _stretches(number, first, bench.shortest)
    if not len(s):
        return Matches(none, none, none)
    offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    at = np.repeat(np.cumsum(size + 1) - size - 1, size) + offset
    original = np.repeat(s, size) + offset
    train, back = np.zeros(len(at) + len(size), np.int32), np.full(len(at) + len(size), -1, np.int64)
    train[at], back[at] = number[original], original
    order, sorted_words = suffix_array(train), np.sort(train)

    # every suffix to its own end: the longest match is that with one of its neighbours in the array
    word = bench.words[bench.start]
    low, high = np.searchsorted(sorted_words, word), np.searchsorted(sorted_words, word, side="right")
    wanted = np.flatnonzero(low < high)
    low, high, start, left = low[wanted], high[wanted], bench.start[wanted], bench.left[wanted]
    stands = _search(train, order, bench.words, start, left, low, high, False)
    longest = np.zeros(len(wanted), np.int64)
    for cut in range(0, len(wanted), SEARCHED):
        part = slice(cut, cut + SEARCHED)
        for near in (stands[part] - 1, stands[part]):
            common, _ = _compare(train, order[np.clip(near, 0, len(order) - 1)], bench.words, start[part], left[part])
            longest[part] = np.maximum(longest[part], common)

    # where it holds a window, all places that share that window
    window = bench.window[wanted]
    holds = np.flatnonzero((window > 0) & (longest >= window))
    wanted, start, left, window, stands = wanted[holds], start[holds], left[holds], window[holds], stands[holds]
    # the suffix may stand between places that share its window, or (if it matches to its end) before them
    begin = _search(train, order, bench.words, start, window, low[holds], stands, False)
    times = _search(train, order, bench.words, start, window, stands, high[holds], True) - begin
    found: list[tuple] = []
    total = np.concatenate([[0], np.cumsum(times)])
    lo = 0
    while lo < len(wanted):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + LOOKED_AT, side="right")) - 1)
        t = times[lo:hi]
        which = np.repeat(np.arange(lo, hi), t)
        spot = order[np.repeat(begin[lo:hi], t) + np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)]
        continues = (bench.left[wanted[which] - 1] == left[which] + 1) & (start[which] > 0) & (spot > 0) & (train[spot - 1] == bench.words[start[which] - 1])
        which, spot = which[~continues], spot[~continues]
        for cut in range(0, len(which), SEARCHED):
            w, x = which[cut : cut + SEARCHED], spot[cut : cut + SEARCHED]
            common, _ = _compare(train, x, bench.words, start[w], left[w])
            found.append((back[x], common, wanted[w]))
        lo = hi
    return Matches(*(np.concatenate(c) for c in zip(*found, strict=True))) if found else Matches(none, none, none)


def _hit_words(matches: Matches, n_words: int) -> np.ndarray:
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, matches.begin, 1)
    np.add.at(change, matches.begin + matches.length, -1)
    return np.cumsum(change)[:-1] > 0


def _pieces(text: bytes, window: int) -> Iterator[tuple[bytes, int]]:
    """A text of more than a block's bytes in pieces; every window stands in one of them. Yields the piece and its first word's place."""
    if len(text) <= BENCHMARK_BLOCK_BYTES:
        yield text, 0
        return
    begin, at, starts, end = 0, 0, [], 0
    for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", text):
        # words from `at` on; the last window - 1 of a piece also begin the next
        if m.end() - begin > BENCHMARK_BLOCK_BYTES and len(starts) >= 2 * window:
            yield text[begin:end], at
            at += len(starts) - (window - 1)
            starts = starts[len(starts) - (window - 1) :]
            begin = starts[0] if starts else m.start()
        starts.append(m.start())
        end = m.end()
    yield text[begin:end], at


def _blocks(benchmark: DataFrame, window: int) -> list[Broadcast]:
    """The benchmark in blocks of bounded bytes; the driver holds one at a time and leaves it in a file."""
    context = benchmark.sparkSession.sparkContext
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), text_bytes().alias("t"))
    out, items, size = [], [], 0
    for i, t in rows.toLocalIterator():
        for piece, place in _pieces(bytes(t), window):
            if items and size + len(piece) > BENCHMARK_BLOCK_BYTES:
                out.append(context.broadcast(Benchmark.of(items, window)))
                items, size = [], 0
            items.append((i, piece, place))
            size += len(piece)
    if items:
        out.append(context.broadcast(Benchmark.of(items, window)))
    return out


def _loaded(blocks: list[Broadcast]) -> Iterator[Benchmark]:
    """One block after the other; only a single one stays in the worker."""
    for block in blocks:
        yield block.value if len(blocks) == 1 or not block._path else block.load_from_path(block._path)


def _shards(batches, text: str) -> Iterator[tuple]:
    """Parts of batches of bounded bytes with the hashes of their words and where each row's begin."""
    for batch in batches:
        data, offsets = textkit.buffers(batch.column(text))
        for lo, hi in textkit.ranges(offsets, SHARD_BYTES, 8192):
            yield batch.slice(lo, hi - lo), *textkit.words(data, offsets[lo : hi + 1])


def _digest(names: list) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
])


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    blocks = _blocks(benchmark, window)
    rows = documents.select("doc_id", "text")

    def run(batches):
        blank = _digest([])
        for part, h, first in _shards(batches, "text"):
            hit, names = np.zeros(len(h), bool), {}
            for bench in _loaded(blocks):
                found = scan(h, first, bench)
                hit |= _hit_words(found, len(h))
                document = np.searchsorted(first, found.begin, side="right") - 1
                for d, i in np.unique(np.stack([document, bench.item[found.suffix]]), axis=1).T.tolist():
                    if bench.names[i] is not None:
                        names.setdefault(d, set()).add(bench.names[i])
            n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[first])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(first)), pa.array(n_hit), pa.array([len(names.get(k, ())) for k in range(len(n_hit))], pa.int64()), pa.array([_digest(list(names[k])) if k in names else blank for k in range(len(n_hit))], pa.string()), pa.array(n_hit > 0)],
                ["doc_id", *(f.name for f in RESULT)],
            )

    return in_arrow(rows, run, T.StructType([rows.schema["doc_id"], *RESULT.fields]))


def matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Longest verbatim matches with their places.

    One row for each match that holds a window and does not merely continue a match one
    word earlier: doc_id, item_id, doc_word, item_word, n_words. A match inside an item of
    more than a block's bytes ends where its piece does, and goes on in the next row.
    """
    blocks = _blocks(benchmark, window)
    rows = documents.select("doc_id", "text")

    def run(batches):
        for part, h, first in _shards(batches, "text"):
            for bench in _loaded(blocks):
                found = scan(h, first, bench)
                document = np.searchsorted(first, found.begin, side="right") - 1
                names = pa.array([bench.names[i] for i in bench.item[found.suffix]], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(document)), names, pa.array(found.begin - first[document]), pa.array(bench.place[found.suffix].astype(np.int64)), pa.array(found.length)], ["doc_id", "item_id", "doc_word", "item_word", "n_words"])

    return in_arrow(rows, run, T.StructType([rows.schema["doc_id"], T.StructField("item_id", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("doc_word", "item_word", "n_words"))]))


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any hit, with all their columns."""
    blocks = _blocks(benchmark, window)

    def run(batches):
        for part, h, first in _shards(batches, "text"):
            held = np.zeros(len(first) - 1, bool)
            for bench in _loaded(blocks):
                found = scan(h, first, bench)
                held[np.searchsorted(first, found.begin, side="right") - 1] = True
            yield part.filter(pa.array(~held))

    return in_arrow(documents, run, documents.schema)


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS} AS w FROM documents),
  b AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark),
  wins AS (
    SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS k
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
  g AS (
    SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
    FROM (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
  hit AS (SELECT rid, i, g.n, item_id FROM g JOIN wins USING (n, k)),
  c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
  x AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items FROM (SELECT DISTINCT rid, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN x USING (rid)
"""
