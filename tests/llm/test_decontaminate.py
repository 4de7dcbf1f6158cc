from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from siloforge.llm import decontaminate, words


def found(texts, index):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return [r for b in decontaminate.scan(iter([batch]), index, lambda *x: decontaminate.hit_rows(*x, index.ids)) for r in b.to_pylist()]


def brute(texts, items):
    split = lambda t: [w for w in "".join(c if ord(c) > 127 else c.lower() if c.isalnum() else " " for c in t or "").split()]
    wins = {}
    for i, t in items:
        w = split(t)
        n = min(len(w), 13)
        for p in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[p : p + n]), set()).add(i)
    out = []
    for d, t in enumerate(texts):
        w, hit, own = split(t), set(), set()
        for n in {len(x) for x in wins}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in wins:
                    hit |= set(range(p, p + n))
                    own |= wins[tuple(w[p : p + n])]
        out.append((d, len(w), len(hit), sorted(map(str, own))))
    return out


def cases():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)] + ["a", "é", "東京"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 5, 13, 14, 40])))) for i in range(30)] + [(90, None), (91, "..."), (92, items_repeat := "x y z " * 30), (93, items_repeat)]
    texts = []
    for _ in range(40):
        parts = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(60)))]
        if r.random() < 0.7:
            parts.insert(r.randrange(2), (r.choice(items)[1] or "").upper() + "!")
        texts.append(" ".join(parts))
    return [*texts, None, "", " " * 500, "x" * 900, "x" * 300 + " " + "x y z " * 50, ("lone " + " " * 200) * 5, "x y z " * 400], items


@pytest.mark.parametrize("limit", [1 << 21, 50, 7])
def test_against_brute_force_whole_and_in_pieces(monkeypatch, limit):
    texts, items = cases()
    monkeypatch.setattr(words, "SLICE_BYTES", limit)
    index = decontaminate.ItemIndex([i for i, _ in items], [t for _, t in items])
    got = found(texts, index)
    assert [(r["doc_id"], r["n_words"], sum(r["hit_to"]) - sum(r["hit_from"]), r["items"]) for r in got] == brute(texts, items)
    assert all(a < b for r in got for a, b in zip(r["hit_from"], r["hit_to"], strict=True)) and all(b < a for r in got for b, a in zip(r["hit_to"], r["hit_from"][1:], strict=False))


def test_colliding_hashes_are_told_apart(monkeypatch):
    texts, items = cases()
    monkeypatch.setattr(decontaminate, "window_hashes", lambda h, at, length: h[at] % np.uint64(3))
    index = decontaminate.ItemIndex([i for i, _ in items], [t for _, t in items])
    assert [(r["doc_id"], r["n_words"], sum(r["hit_to"]) - sum(r["hit_from"]), r["items"]) for r in found(texts, index)] == brute(texts, items)


def test_index_stays_below_its_estimate(spark, wide):
    texts, items = cases()
    for rows in (items, [(1, "a b c d " * 20000)], [(i, f"a{i % 7}") for i in range(3000)], [(None, None)], []):
        df = wide(rows, "item_id long, text string")
        assert decontaminate.index_of(df).nbytes <= decontaminate.index_bytes(df)


def test_both_ways_give_the_same(spark, documents, wide):
    texts, items = cases()
    docs, tests = documents([*enumerate(texts), (0, texts[0])]), wide(items, "item_id long, text string")
    a, b = (sorted(map(str, decontaminate.contamination(docs, tests, most).collect())) for most in (decontaminate.BROADCAST_BYTES, 0))
    assert a == b and len(a) == len(texts) + 1
