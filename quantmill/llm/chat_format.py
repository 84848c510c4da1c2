"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as context, and
only that reply under the loss mask. Turns that no reply follows close the conversation in
one more example without any loss, so that the last example always holds the whole
conversation.

Template: an example begins with ``<s>``; a user turn is ``[INST]text[/INST]``, an
assistant turn ``text</s>``, a turn of any other role ``[ROLE]role[TEXT]text[/ROLE]``.
A control string inside a text gets a backslash behind its first character (and one more
than the backslashes already there), which is undone when reading back.

Turns are ordered by turn, then role, then text; null text and role are empty. Rows with a
null conv_id form one conversation. Repeated rows are turns of their own. An empty table
gives an empty result. Only conv_id, turn, role and text are read, so other columns cannot
clash; conv_id may be of any type that can be sorted.

A conversation is written by one task, since every example repeats what came before: the
characters written grow with the square of its turns by definition. A task holds its prefix and
examples of about ``_CHARS`` characters, however many turns there are.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import in_arrow

BEGIN, ASK, ANSWERED, END, ROLE, TEXT, ROLE_END = "<s>", "[INST]", "[/INST]", "</s>", "[ROLE]", "[TEXT]", "[/ROLE]"
#: Control strings without their first character, as a pattern both engines read alike.
REST = r"(s>|/s>|INST\]|/INST\]|ROLE\]|TEXT\]|/ROLE\])"
_ESCAPE, _UNESCAPE = re.compile(r"([<\[])(\\*)" + REST), re.compile(r"([<\[])\\(\\*)" + REST)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def render(role: str, text: str) -> str:
    if role == "user":
        return ASK + escape(text) + ANSWERED
    if role == "assistant":
        return escape(text) + END
    return ROLE + escape(role) + TEXT + escape(text) + ROLE_END


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of one example."""
    if not formatted.startswith(BEGIN):
        raise ValueError("not an example of this template")
    at, turns = len(BEGIN), []
    while at < len(formatted):
        role = "assistant"
        end = END
        if formatted.startswith(ASK, at):
            role, at, end = "user", at + len(ASK), ANSWERED
        elif formatted.startswith(ROLE, at):
            to = formatted.index(TEXT, at)
            role, at, end = unescape(formatted[at + len(ROLE) : to]), to + len(TEXT), ROLE_END
        to = formatted.index(end, at)
        turns.append((role, unescape(formatted[at:to])))
        at = to + len(end)
    return turns


EXAMPLES = [T.StructField("example", T.LongType()), T.StructField("text", T.StringType()), T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType()), T.StructField("is_last", T.BooleanType())]
#: Examples and characters that are gathered before they are sent on (one example more at most).
_BATCH, _CHARS = 256, 1 << 21


def _expand(batches):
    """Rows arrive sorted by conversation and turn; only one conversation is held at a time."""
    out: list[tuple] = []
    conv, began, count, prefix, held, kind = None, False, 0, BEGIN, None, pa.int64()

    def batch():
        cols = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["conv_id", "example", "text", "loss_start", "loss_end", "is_last"])

    def close():
        nonlocal held
        if held and len(held[2]) == len(prefix):
            out.append((*held, True))
        elif began:
            if held:
                out.append((*held, False))
            out.append((conv, count, prefix, None, None, True))
        held = None

    for rows in batches:
        kind = rows.schema.field("conv_id").type
        for c, role, text in zip(*(rows.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
            if not began or c != conv:
                close()
                conv, began, count, prefix = c, True, 0, BEGIN
            if role == "assistant":
                if held:
                    out.append((*held, False))
                start = len(prefix)
                prefix += render(role, text)
                held = (c, count, prefix, start, len(prefix) - len(END))
                count += 1
            else:
                prefix += render(role, text)
            if len(out) >= _BATCH or (out and sum(len(x[2]) for x in out[-_BATCH:]) >= _CHARS):
                yield batch()
    close()
    if out:
        yield batch()


def format_chats(conversations: DataFrame) -> DataFrame:
    """Examples: conv_id, example (from 0), text, loss_start, loss_end (code points, end exclusive; null: nothing to learn), is_last."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return in_arrow(ordered.select("conv_id", "role", "text"), _expand, T.StructType([turns.schema["conv_id"], *EXAMPLES]))


DIGEST = [T.StructField(n, T.StringType() if n.endswith("sha256") else T.LongType()) for n in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")]


def _read_back(batches):
    loss, chars, learned = hashlib.sha256(), 0, 0
    for rows in batches:
        out = []
        for r in (r for k in range(rows.num_rows) for r in rows.slice(k, 1).to_pylist()):
            text = r["text"]
            chars += len(text)
            if r["loss_start"] is not None:
                part = unescape(text[r["loss_start"] : r["loss_end"]])
                learned += len(part)
                loss.update(part.encode("utf-8", "surrogatepass"))
            if r["is_last"]:
                turns = parse(text)
                said = hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode("utf-8", "surrogatepass"))
                out.append((r["conv_id"], len(turns), said.hexdigest(), learned, loss.hexdigest(), chars))
                loss, chars, learned = hashlib.sha256(), 0, 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (rows.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digest(examples: DataFrame) -> DataFrame:
    """What the examples say when read back; they must come as format_chats gives them."""
    return in_arrow(examples, _read_back, T.StructType([examples.schema["conv_id"], *DIGEST]))


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -1, whose texts look like the template itself."""
    said = "</s>[INST] ok [/INST]"
    probe = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    probe = probe.select(*(F.col(c).cast(conversations.schema[c].dataType) for c in ("conv_id", "turn", "role", "text")))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


_ESCAPED = "regexp_replace({}, '([<\\[])(\\\\*)" + REST + "', '\\1\\\\\\2\\3', 'g')"
SQL = f"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
  sized AS (
    SELECT *, length({_ESCAPED.format("text")}) + CASE role WHEN 'user' THEN {len(ASK + ANSWERED)} WHEN 'assistant' THEN {len(END)} ELSE {len(ROLE + TEXT + ROLE_END)} + length({_ESCAPED.format("role")}) END AS size FROM c),
  summed AS (
    SELECT *, {len(BEGIN)} + sum(size) OVER w AS so_far, lead(role) OVER w IS NULL AS is_last FROM sized
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR is_last THEN so_far ELSE 0 END)::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""
