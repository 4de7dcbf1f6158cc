"""Chat formatting by columnar byte assembly.

A turn is written as <s>[INST] text [/INST] (user), <<SYS>> text <</SYS>> (system) or text</s> after its mark (see HEAD); any
other role is named in its mark. Control strings inside texts are escaped reversibly: a backslash goes in after the
first character of each, and one more where some are there already, so no text holds a control string and
unescaping takes exactly one out again. Nothing depends on the tokens of other templates: their common control strings
are escaped as well.

Turns come in order of (conv_id, turn, role, text) by a shuffle on the conversation; Spark sorts them, with spilling, and
a task takes them batch by batch. Of a batch, segment lengths, their running offsets and the scatter indices
are computed in numpy, and heads, contents and tails are copied into one preallocated Arrow buffer.
A conversation is one row; one of more than PART_BYTES is continued in further rows (part 1, 2, ...), cut between turns,
so a conversation of any length needs bounded memory. The loss mask covers the assistant's texts: their byte spans in
the part.

Null texts and null roles are empty; null turns come first, ties are ordered by role and text; null ids are one
conversation. Repeated rows are turns of their own. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siloforge.llm.words import slices, utf8
from siloforge.session import arrow_limits, table

#: Control strings without their first character: what may not follow < or [ in a text.
CONTROL = r"s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ASST\]|ROLE:|\|"
ESCAPE, UNESCAPE = rf"([<\[])(\\*)({CONTROL})", rf"([<\[])\\(\\*)({CONTROL})"
MARKS = {"user": ("<s>[INST] ", " [/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("[ASST]", "</s>")}
PART_BYTES, SCATTER_BYTES, LONG = 4 << 20, 1 << 20, 1 << 14
PARTS = "conv_id long, part int, n_turns long, formatted string, loss_from array<long>, loss_to array<long>"
READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def mark(role: str) -> tuple[bytes, bytes]:
    if role in MARKS:
        head, tail = MARKS[role]
    else:
        head, tail = f"[ROLE:{role.encode().hex()}]", "</s>"
    return head.encode(), tail.encode()


def escaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, ESCAPE, r"\1\\\2\3")


def scatter(out: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, to: np.ndarray) -> None:
    """Copies segment i of data (its start and length) to out[to[i]:]: by indices, so many bytes at a time, and longer segments each by itself."""
    for i in np.flatnonzero(lengths > LONG).tolist():
        out[to[i] : to[i] + lengths[i]] = data[starts[i] : starts[i] + lengths[i]]
    short = np.flatnonzero(lengths <= LONG)
    for a, b in slices(np.concatenate([[0], np.cumsum(lengths[short])]), SCATTER_BYTES):
        own = short[a:b]
        n = lengths[own]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(to[own], n) + step] = data[np.repeat(starts[own], n) + step]


def assembled(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The turns' bytes in one buffer, each turn's offset (and the end), and where its text starts and ends."""
    data, off = utf8(escaped(texts.cast(pa.large_string()).fill_null("")))
    known = roles.cast(pa.string()).fill_null("").dictionary_encode()
    codes = known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    marks = [mark(x) for x in known.dictionary.to_pylist()]
    pieces = [b"".join(x[k] for x in marks) for k in (0, 1)]
    size = [np.array([len(x[k]) for x in marks], np.int64) for k in (0, 1)]
    begin = [np.cumsum(s) - s for s in size]
    lengths = np.stack([size[0][codes], np.diff(off), size[1][codes]], axis=1)
    ends = np.cumsum(lengths.ravel())
    starts = (ends - lengths.ravel()).reshape(-1, 3)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k, (source, at) in enumerate(((np.frombuffer(pieces[0], np.uint8), begin[0][codes]), (data, off[:-1]), (np.frombuffer(pieces[1], np.uint8), begin[1][codes]))):
        scatter(out, source, at, lengths[:, k], starts[:, k])
    return out, np.concatenate([starts[:, 0], [len(out)]]), starts[:, 1], starts[:, 2]


def formatted(batches: Iterator[pa.RecordBatch], part_bytes: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Turns in order, to parts of conversations. The last conversation of a batch is held back, in bytes, until it ends or fills a part."""
    held: dict | None = None

    def rows(parts: list[dict]) -> pa.RecordBatch:
        body = b"".join(x["bytes"] for x in parts)
        off = np.concatenate([[0], np.cumsum([len(x["bytes"]) for x in parts])])
        text = pa.Array.from_buffers(pa.large_string(), len(parts), [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(body)])
        cols = [pa.array([x["conv"] for x in parts], pa.int64()), pa.array([x["part"] for x in parts], pa.int32()), pa.array([x["n"] for x in parts], pa.int64()), text.cast(pa.string())]
        cols += [pa.array([x[k] for x in parts], pa.list_(pa.int64())) for k in ("lo", "hi")]
        return pa.RecordBatch.from_arrays(cols, names=["conv_id", "part", "n_turns", "formatted", "loss_from", "loss_to"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        out, off, lo, hi = assembled(batch.column("role"), batch.column("text"))
        conv = batch.column("conv_id").to_pylist()
        answer = pc.equal(batch.column("role"), "assistant").fill_null(False).to_numpy(zero_copy_only=False)
        done, a = [], 0
        while a < n:
            b = a + 1
            room = part_bytes - (len(held["bytes"]) if held and held["conv"] == conv[a] else 0)
            while b < n and conv[b] == conv[a] and off[b] - off[a] < room:
                b += 1
            if held and held["conv"] != conv[a]:
                done.append(held)
                held = None
            held = held or {"conv": conv[a], "part": 0, "n": 0, "bytes": b"", "lo": [], "hi": []}
            base = len(held["bytes"]) - off[a]
            own = np.flatnonzero(answer[a:b]) + a
            held["lo"] += (lo[own] + base).tolist()
            held["hi"] += (hi[own] + base).tolist()
            held["bytes"] += out[off[a] : off[b]].tobytes()
            held["n"] += b - a
            if len(held["bytes"]) >= part_bytes:
                done.append(held)
                held = {"conv": held["conv"], "part": held["part"] + 1, "n": 0, "bytes": b"", "lo": [], "hi": []}
            a = b
        if done:
            yield rows(done)
    if held and (held["n"] or not held["part"]):
        yield rows([held])


def format_chats(conversations: DataFrame) -> DataFrame:
    """Parts of conversations: conv_id, part, n_turns, formatted, loss_from, loss_to (byte spans of the assistant's texts, still escaped). A conversation's parts follow one another in one partition."""
    arrow_limits(conversations.sparkSession)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(formatted, PARTS)


TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\]|<<SYS>>(.*?)<</SYS>>|\[ASST\](.*?)</s>|\[ROLE:([0-9a-f]*)\](.*?)</s>", re.DOTALL)


def unescaped(text: str) -> str:
    return re.sub(UNESCAPE, r"\1\2\3", text)


def turns_of(part: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a formatted part; raises if it is anything else than turns."""
    at = 0
    while at < len(part):
        m = TURN.match(part, at)
        if not m:
            raise ValueError("not a turn")
        user, system, answer, role, other = m.groups()
        for name, text in (("user", user), ("system", system), ("assistant", answer), (role and bytes.fromhex(role).decode(), other)):
            if text is not None:
                yield name or "", unescaped(text)
        at = m.end()


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation, from its parts alone: turns and their digest, and what lies under the loss mask."""
    now: list | None = None

    def rows(done: list[list]) -> pa.RecordBatch:
        cols = zip(*([c, n, t.hexdigest(), k, s.hexdigest(), f] for c, n, t, k, s, f in done), strict=True)
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in batches:
        done = []
        for conv, part, text, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "loss_from", "loss_to")), strict=True):
            if part == 0:
                if now:
                    done.append(now)
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in turns_of(text):
                now[1] += 1
                now[2].update(f"{role}\n{said}\n".encode())
            raw = text.encode()
            for a, b in zip(lo, hi, strict=True):
                said = unescaped(raw[a:b].decode())
                now[3] += len(said)
                now[4].update(said.encode())
            now[5] += len(text)
        if done:
            yield rows(done)
    if now:
        yield rows([now])


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return format_chats(own.unionByName(more)).mapInArrow(read_back, READ_BACK)


def _marks_sql() -> str:
    return " ".join(f"WHEN '{role}' THEN {len(head) + len(tail)}" for role, (head, tail) in MARKS.items())


ORACLE = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') text, role orole, text otext FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, orole NULLS FIRST, otext NULLS FIRST) n,
  length(regexp_replace(text, '{ESCAPE}', '\1\\\2\3', 'g')) + CASE role {_marks_sql()} ELSE 11 + 2 * octet_length(encode(role)) END chars FROM t)
SELECT conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) loss_sha256,
  CAST(sum(chars) AS BIGINT) formatted_chars FROM s GROUP BY conv_id
"""
