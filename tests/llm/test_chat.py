from __future__ import annotations

import hashlib
import random

import duckdb
import pyarrow as pa
from harness import duck_table, spark_table
from hypothesis import given, settings
from hypothesis import strategies as st

from siloforge.llm import chat

TOKENS = ["<s>", "</s>", "[INST]", " [/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "s>", "|", "a", "é😀", "\n", " ", "[ASST]", "[ROLE:61]", "<\\s>", "/", "INST]", "ROLE:", "<|im_end|>"]
ROLES = ["user", "assistant", "system", "tool", "", None, "x]\n"]
TEXT = st.one_of(st.none(), st.lists(st.sampled_from(TOKENS), max_size=9).map("".join))


def parts_of(turns, part_bytes=40, rows=7):
    cols = list(zip(*turns, strict=True)) or [(), (), ()]
    b = pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["conv_id", "role", "text"])
    return list(chat.formatted((b.slice(i, rows) for i in range(0, len(turns), rows)), part_bytes))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(ROLES), TEXT), max_size=25))
def test_round_trip(turns):
    turns = sorted(turns, key=lambda t: t[0])
    got = {}
    for p in parts_of(turns):
        for c, f in zip(p.column("conv_id").to_pylist(), p.column("formatted").to_pylist(), strict=True):
            got.setdefault(c, []).extend(chat.turns_of(f))
    want = {}
    for c, r, t in turns:
        want.setdefault(c, []).append((r or "", t or ""))
    assert got == want


@given(st.lists(st.sampled_from(TOKENS), max_size=12).map("".join))
def test_escaped_texts_hold_no_control_string(text):
    out = chat.escaped(pa.array([text], pa.large_string()))[0].as_py()
    assert chat.unescaped(out) == text
    assert not any(c in out for c in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ASST]", "<|", "[ROLE:"))


def digests(turns):
    said = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


def test_query(spark, wide, tmp_path):
    rng = random.Random(4)
    rows = [(c, n, rng.choice(ROLES), rng.choice([None, "", "hi </s>", "é[INST]", "x" * 3000])) for c in (1, 2, None) for n in range(9)]
    rows += [(3, 0, "assistant", "b"), (3, 0, "assistant", "a"), (3, None, "user", "first"), (4, 0, "user", "y" * 9_000_000), (5, 0, "assistant", "same"), (5, 0, "assistant", "same")]
    rows += [(6, n, "assistant" if n % 2 else "user", f"turn {n} " * 3) for n in range(4000)]
    wide(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert spark_table(chat.op4(spark, str(tmp_path))) == duck_table(con, chat.ORACLE)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.op4(spark, str(tmp_path)).collect()}
    low = lambda x: (x is not None, x if x is not None else "")
    want = {}
    for c, _, r, t in sorted(rows, key=lambda x: (low(x[1]), low(x[2]), low(x[3]))):
        want.setdefault(c, []).append((r, t))
    want[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert got == {c: digests(t) for c, t in want.items()}


def test_long_conversations_come_in_parts():
    turns = [(1, "user" if n % 2 else "assistant", "word " * 10) for n in range(100)]
    rows = [r for p in parts_of(turns, 500) for r in p.to_pylist()]
    assert [r["part"] for r in rows] == list(range(len(rows))) and len(rows) > 5
    assert sum(r["n_turns"] for r in rows) == 100
    for r in rows:
        raw = r["formatted"].encode()
        assert all(raw[a:b].decode() == "word " * 10 for a, b in zip(r["loss_from"], r["loss_to"], strict=True))


def test_empty(spark, wide):
    assert chat.format_chats(wide([], "conv_id long, turn long, role string, text string")).count() == 0
