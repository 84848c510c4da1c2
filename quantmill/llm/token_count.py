"""Token counts by the whole-token shortcut.

Offline, every vocabulary string that is a pre-token by itself is encoded alone; those
that give one token are proven whole tokens. A text is cut into pre-tokens; each one
that is a proven whole token counts 1, and only the rest goes through the merges, with
a bounded memory of what they gave.

Works for byte-level BPE files of the tokenizers library (ByteLevel pre-tokenizer, no
normaliser). Special strings inside a text count as one token each, as the library does
by default. Null text counts as empty, with no tokens. Repeated rows and ties are
counted one by one; an empty table gives an empty result; only doc_id and text are read,
so other columns cannot clash.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textkit
from .shared import in_arrow, text_bytes

#: Tokens above which a document is over the limit.
LIMIT = 512
#: Remembered chunks of one Python worker; beyond it the memory starts anew.
REMEMBERED = 500_000
#: The pattern of the ByteLevel pre-tokenizer (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

RESULT = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as it is, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def read_vocabulary(path: str) -> str:
    """The vocabulary file's text; its size is fixed by the tokenizer, not by the data."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def proven_whole(spec: str) -> list[str]:
    """Vocabulary strings that are one pre-token and whose merges end in one token."""
    import regex
    from tokenizers import Tokenizer

    config = json.loads(spec)
    _require(config)
    model = Tokenizer.from_str(spec).model
    back = {c: b for b, c in byte_letters().items()}
    pattern = regex.compile(PATTERN)
    out = []
    for written in config["model"]["vocab"]:
        try:
            text = bytes(back[c] for c in written).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if pattern.fullmatch(text) and pattern.findall(text) == [text] and len(model.tokenize(written)) == 1:
            out.append(text)
    return out


def _require(config: dict) -> None:
    pre = config.get("pre_tokenizer") or {}
    if config.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or config["model"]["type"] != "BPE":
        raise ValueError("only byte-level BPE files without a normaliser or prefix space are supported")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in config["added_tokens"]):
        raise ValueError("added tokens that strip or match whole words are not supported")


def merger(spec: str):
    """A function from the bytes of a pre-token to its number of tokens after all merges.

    Where ids follow the order of the merges (checked), merging by lowest id is the same
    as merging by lowest rank, and the faster rank-file merger does it.
    """
    config = json.loads(spec)
    letters = byte_letters()
    back = {c: b for b, c in letters.items()}
    vocab, merges = config["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in config["model"]["merges"]]
    special = {t["content"] for t in config["added_tokens"]}
    plain = {w: i for w, i in vocab.items() if w not in special}
    if all(c in plain for c in back) and len(plain) == 256 + len(merges) and all(plain.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)):
        from tiktoken import _tiktoken

        core = _tiktoken.CoreBPE({bytes(back[c] for c in w): i for w, i in plain.items()}, {}, PATTERN)
        return lambda piece: len(core.encode_single_piece(piece))
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(spec).model
    return lambda piece: len(model.tokenize(piece.decode("latin-1").translate(letters)))


class _Memory(dict):
    """Chunk of text -> its number of tokens, worked out when missing."""

    def __init__(self, work, lead: str):
        super().__init__()
        self.work, self.lead = work, lead

    def __missing__(self, chunk: str) -> int:
        n = self.work(self.lead + chunk)
        if len(chunk) <= 64:
            self[chunk] = n
        return n


class Counter:
    """Counts tokens of texts; remembers the counts of short chunks between spaces.

    A space after a non-space always begins a new pre-token, so a text may be cut before
    each space and the parts counted alone, unless a space stands inside or at the end of a
    longer run of white space (`joined`): such a text goes through the pattern whole.
    """

    def __init__(self, spec: str, whole: list[str]):
        import regex

        self.whole, self.merge = frozenset(whole), merger(spec)
        self.cut = regex.compile(PATTERN).findall
        self.joined = re.compile(r"\s (?!\S)").search
        special = sorted((t["content"] for t in json.loads(spec)["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.first, self.later = _Memory(self._pieces, ""), _Memory(self._pieces, " ")

    def _piece(self, piece: str) -> int:
        return 1 if piece in self.whole else self.merge(piece.encode("utf-8"))

    def _pieces(self, text: str) -> int:
        letters = text[1:] if text[:1] == " " else text
        if letters.isalpha():  # one pre-token
            return self._piece(text)
        if letters[-1:] in (".", ",") and letters[:-1].isalpha():
            return self._piece(text[:-1]) + self._piece(text[-1])
        return sum(map(self._piece, self.cut(text)))

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        if self.joined(text):
            return self._pieces(text)
        chunks = text.split(" ")
        return self.first[chunks[0]] + sum(map(self.later.__getitem__, chunks[1:]))

    def count(self, text: str) -> int:
        if len(self.first) + len(self.later) > REMEMBERED:
            self.first.clear()
            self.later.clear()
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def count_tokens(documents: DataFrame, vocabulary_path: str, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit."""
    spec = read_vocabulary(vocabulary_path)
    shared = documents.sparkSession.sparkContext.broadcast((spec, proven_whole(spec)))
    rows = documents.select("doc_id", text_bytes().alias("t"))

    def run(batches):
        counter = Counter(*shared.value)
        for batch in batches:
            _, offsets = textkit.buffers(batch.column("t"))
            for lo, hi in textkit.ranges(offsets):
                part = batch.slice(lo, hi - lo)
                n = [counter.count(t.decode("utf-8", "replace")) for t in part.column("t").to_pylist()]
                size = offsets[lo + 1 : hi + 1] - offsets[lo:hi]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return in_arrow(rows, run, T.StructType([rows.schema["doc_id"], *RESULT]))
