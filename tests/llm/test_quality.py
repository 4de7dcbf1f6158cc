from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from siloforge.llm import quality
from siloforge.session import table


def test_held_out_accuracy(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    got = {r["doc_id"]: r for r in quality.op1(spark, big).collect()}
    assert len(got) == table(spark, big, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in got.items())
    held = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in table(spark, big, "labels").collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.95


def good(r):
    return " ".join(r.choice(["the", "and", "thing", "water", "under", "light"]) + r.choice(["", "s", "ing"]) for _ in range(60)) + "."


def test_awkward(spark, documents):
    r = random.Random(1)
    rows = [(i, good(r) if i % 3 else "BUY!! NOW!! " * 30) for i in range(200)]
    more = [(300, None), (301, ""), (302, "ab"), (None, good(r)), (303, good(r)), (303, good(r)), (304, "long text and thing " * 100_000)]
    docs = documents(rows + more)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)] + [(5, None, 0), (None, 1, 0), (7, 1, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = quality.scored(docs, model, ["doc_id"]).collect()
    assert len(got) == len(rows + more)
    s = {r["doc_id"]: r["score"] for r in got}
    assert s[300] == s[301] == s[302] == 0 and s[303] > 0.7 and s[0] < 0.3 and s[1] > 0.7 and 0 <= s[304] <= 1
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and not kept.filter("doc_id is null").isEmpty() and kept.filter("doc_id = 3").isEmpty()


def test_scores_do_not_depend_on_neighbours_in_the_batch(spark, documents):
    r = random.Random(2)
    texts = [good(r) for _ in range(40)] + ["x" * 70000, "", "ab", "abc"]
    whole = quality.term_counts(*quality.utf8(__import__("pyarrow").array(texts)))
    for i, t in enumerate(texts):
        one = quality.term_counts(*quality.utf8(__import__("pyarrow").array([t])))
        assert (whole[0][i] == one[0][0]).all() and np.allclose(whole[1][i], one[1][0])


def test_votes_against_brute_force(spark, documents):
    """Frequencies, weights, cosines and votes, one text and one voter at a time; the projection is taken as given."""
    r = random.Random(5)
    rows = [(i, good(r) if i % 3 else "BUY!! NOW!! " * r.randrange(1, 9) + good(r)[:30]) for i in range(90)] + [(200, "xy"), (201, None)]
    docs = documents(rows)
    labels = {i: int(i % 3 > 0) for i in range(90)}
    model = quality.fit(docs, spark.createDataFrame([(i, q, 0) for i, q in labels.items()], "doc_id long, quality int, toxic int"))
    learnt = sorted(i for i in labels if zlib.crc32(str(i).encode()) % 4 != 2)

    def terms(text):
        b, out = (text or "").encode(), {}
        for x, y, z in zip(b, b[1:], b[2:], strict=False):
            h = ((x * 0x9E3779B1 + y * 0x85EBCA6B + z * 0xC2B2AE35) % 2**32) >> 20
            out[h] = out.get(h, 0) + 1
        return out

    df = {}
    for _, t in rows:
        for h in terms(t):
            df[h] = df.get(h, 0) + 1

    def vector(text):
        c, b = terms(text), (text or "").encode()
        x = np.zeros(quality.TERMS + quality.SHAPES)
        for h, n in c.items():
            x[h] = np.log1p(n) * (np.log((len(rows) + 1) / (df[h] + 1)) + 1)
        x /= max(np.linalg.norm(x), 1e-9)
        kinds = [sum(map(f, map(chr, b))) / max(len(b), 1) for f in (str.isupper, lambda ch: 32 < ord(ch) < 127 and not ch.isalnum(), str.isdigit)]
        n = sum(c.values())
        x[quality.TERMS :] = [1.5 * (1 - np.log1p(len(c)) / np.log1p(max(n, 1))) if n else 0, *kinds]
        x[quality.TERMS :] /= quality.SHAPE_WEIGHT
        x = x @ model.projection
        return x / max(np.linalg.norm(x), 1e-9)

    voters = {i: vector(rows[i][1]) for i in learnt}
    share = {c: np.mean([labels[i] == c for i in learnt]) / sum(labels[i] == c for i in learnt) for c in (0, 1)}
    got = {x["doc_id"]: x["score"] for x in quality.scored(docs, model, ["doc_id"]).collect()}
    for i, t in rows:
        near = sorted(((float(vector(t) @ v), j) for j, v in voters.items()), reverse=True)[: quality.K]
        votes = [(max(s, 1e-6) ** quality.SHARPNESS * share[labels[j]], labels[j]) for s, j in near]
        want = sum(v * q for v, q in votes) / sum(v for v, _ in votes) if terms(t) else 0.0
        assert got[i] == pytest.approx(want, abs=2e-3), i


def test_packed_counts_are_the_counts():
    texts = __import__("pyarrow").array(["aaa" * 70000 + " The thing", "", "ab", "abc ABC"])
    counts, shape = quality.term_counts(*quality.utf8(texts))
    assert counts.max() > 1 << 16
    for c, s in zip(counts, shape, strict=True):
        got = quality.unpacked(quality.packed(c, s))
        assert (got[0][0] == c).all() and (got[1][0] == s).all()


def test_pieces(monkeypatch):
    texts = __import__("pyarrow").array(["abcdefg hij KLM 1!" * 9, "", "xy", "hello world " * 5])
    whole = quality.term_counts(*quality.utf8(texts))
    monkeypatch.setattr(quality, "PIECE", 13)
    cut = quality.term_counts(*quality.utf8(texts))
    assert (whole[0] == cut[0]).all() and np.allclose(whole[1], cut[1])


@pytest.mark.parametrize("labels, want", [([], 0.5), ([(1, 1, 0)], 1.0), ([(1, 0, 0)], 0.0)])
def test_few_labels(spark, documents, labels, want):
    docs = documents([(1, "some text here"), (3, "more text there")])
    got = quality.scored(docs, quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), ["doc_id"])
    assert {r["score"] for r in got.collect()} == {want}


def test_empty(spark, documents):
    docs = documents([])
    assert quality.accepted(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
