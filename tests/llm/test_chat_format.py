import hashlib
import random

from quantmill.llm import chat_format as c

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[TEXT]", "[/ROLE]", "\\", "<", "[", "s>", "INST]", "a", "\n", "é", ""]


def test_escaping_is_reversible_and_hides_control_strings():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 8)))
        assert c.unescape(c.escape(text)) == text
        assert not any(x in c.escape(text) for x in ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[TEXT]", "[/ROLE]"))


def conversations():
    rng = random.Random(3)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 7)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "to[TEXT]ol", None]), rng.choice([None, "".join(rng.choice(PIECES) for _ in range(6))])))
    return rows + [(None, 0, "user", "hi"), (None, 1, "assistant", "yo"), (-5, 0, "user", "only a question"), (-6, None, "assistant", "x"), (-7, 1, "assistant", "twice"), (-7, 1, "assistant", "twice")]


def test_round_trip(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    examples = c.format_chats(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    for conv, turns in by.items():
        turns = [t[2:] for t in sorted(turns)]
        mine = sorted((e for e in examples if e.conv_id == conv), key=lambda e: e.example)
        assert [e.is_last for e in mine] == [False] * (len(mine) - 1) + [True]
        assert c.parse(mine[-1].text) == turns
        assert [c.unescape(e.text[e.loss_start : e.loss_end]) for e in mine if e.loss_start is not None] == [t for r, t in turns if r == "assistant"]
        for e in mine:
            assert mine[-1].text.startswith(e.text)
    got = {r.conv_id: r for r in c.digest(c.format_chats(df)).collect()}
    assert got.keys() == by.keys()
    for conv, turns in by.items():
        turns = [t[2:] for t in sorted(turns)]
        said = [t for r, t in turns if r == "assistant"]
        r = got[conv]
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len("".join(said)), hashlib.sha256("".join(said).encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.formatted_chars == sum(len(e.text) for e in examples if e.conv_id == conv)


def test_probe_and_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert c.digest(c.format_chats(df)).count() == 0
    (r,) = c.digest(c.format_chats(c.with_probe(df))).collect()
    assert (r.conv_id, r.n_turns, r.loss_chars) == (-1, 2, 21)


def test_long_conversation_and_text_keys(spark, monkeypatch):
    monkeypatch.setattr(c, "_CHARS", 2000)
    rows = [("k", t, "user" if t % 2 == 0 else "assistant", f"turn {t} " * 20) for t in range(300)] + [("j", 0, "user", "q"), ("j", 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = {r.conv_id: r for r in c.digest(c.format_chats(df)).collect()}
    assert got.keys() == {"k", "j"} and got["k"].n_turns == 300 and got["k"].loss_chars == sum(len(r[3]) for r in rows if r[0] == "k" and r[2] == "assistant")
    assert {r.conv_id for r in c.digest(c.format_chats(c.with_probe(df))).collect()} == {"k", "j", "-1"}


def test_batches_hold_bounded_characters(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(c, "_CHARS", 3000)
    n = 400
    batch = pa.record_batch({"conv_id": pa.array([1] * n), "role": ["user", "assistant"] * (n // 2), "text": ["x" * 20] * n})
    sizes = [[len(t) for t in b.column("text").to_pylist()] for b in c._expand([batch])]
    assert sum(map(len, sizes)) == n // 2 and all(sum(s[:-1]) < 3000 for s in sizes)
