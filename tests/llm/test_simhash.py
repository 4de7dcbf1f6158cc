from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from siloforge.llm import simhash, xxh64
from siloforge.llm.components import components
from siloforge.session import table


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_hashes_are_xxh64():
    r = random.Random(8)
    data = bytes(r.randrange(256) for _ in range(5000))
    spans = [(a, a + n) for n in [*range(140), 511, 512, 513, 600, 2000] for a in (0, 1, 7, 5000 - n)]
    got = xxh64.hashes(data, np.array([a for a, _ in spans]), np.array([b for _, b in spans]), 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a:b], 42) for a, b in spans]


@pytest.mark.parametrize("piece", [1 << 19, 1000, 90])
@pytest.mark.parametrize("shingle", [1, 3, 5])
def test_sketches_whole_and_in_pieces(monkeypatch, piece, shingle):
    monkeypatch.setattr(simhash, "PIECE", piece)
    monkeypatch.setattr(simhash, "CHUNK", 50)
    r = random.Random(9)
    texts = ["", " \n", "one", "two words", "é Ü 東京 x", "A b " * 300, "w" * 5000, " " * 400 + "x" + " " * 400 + "y z", *(" ".join(str(r.randrange(50)) for _ in range(r.randrange(100))) for _ in range(8))]
    raw = [t.encode() for t in texts]
    wanted = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        wanted.append([xxhash.xxh64_intdigest(" ".join(w[i : i + shingle]).encode(), 42) for i in range(max(1, len(w) - shingle + 1))] if w else [])
    mixed = lambda h, k: simhash.mix(np.array([(x + k * simhash.ODD) % (1 << 64) for x in h], np.uint64)).tolist() if k and h else h
    sign = lambda h, k: sum(1 << b for b in range(64) if sum(x >> b & 1 for x in mixed(h, k)) * 2 > len(h))
    with np.errstate(over="ignore"):
        for repeats in (True, False):
            sigs, sets = simhash.sketches(raw, shingle, 2, repeats)
            for i, h in enumerate(wanted):
                h = h if repeats else sorted(set(h))
                assert [int(x) & (1 << 64) - 1 for x in sigs[i]] == [sign(h, 0), sign(h, 1)]
                assert repeats or sets[i].tolist() == h


def joined(n, links):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def check(spark, docs, rows):
    got = sorted(((r["doc_id"], r["fingerprint"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    prints = [fingerprint(t) for _, t in rows]
    comp = joined(len(rows), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2])
    low = {}
    for (doc, _), c in zip(rows, comp, strict=True):
        if doc is not None:
            low[c] = min(low.get(c, doc), doc)
    assert got == sorted(((doc, p, low.get(c)) for (doc, _), p, c in zip(rows, prints, comp, strict=True)), key=str)


def varied(n, seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(150, 400))] for _ in range(n // 6)]
    out = []
    for i in range(n):
        words = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        out.append((i, " ".join(words)))
    return out


def test_against_all_pairs(spark, documents):
    rows = varied(180) + [(500, None), (501, ""), (502, " \n\t"), (503, "one"), (504, "ONE  "), (505, "two words"), (505, "two words"), (None, "one"), (None, "lost"), (506, "é Ü 東京 é Ü"), (507, "A a A a " * 30000)]
    check(spark, documents(rows), rows)


def test_only_null_ids(spark, documents):
    check(spark, documents([(None, "a b c d")] * 3), [(None, "a b c d")] * 3)


def test_hot_buckets_are_tiled(spark, documents, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    rows = varied(150, 2)
    check(spark, documents(rows), rows)


@pytest.mark.parametrize("tau", [0, 1, 2, 5, 8])
def test_thresholds_keep_the_principle(tau):
    rng = np.random.default_rng(tau)
    bits = (rng.random((500, 64)) < 0.5).astype(float)
    bits[:, 10:20] = bits[:, :10]
    both = bits.T @ bits
    plans = [simhash.planned(500, both, tau), *(simhash.allotted(500, both, tau, parts)[1] for parts in range(max(1, tau // 2), tau + 2))]
    for plan in plans:
        keeps(plan, tau, rng)
    sizes = [max(len(b) for b, _ in simhash.planned(n, both * (n / 500), tau)) for n in (10**3, 10**6, 10**9, 10**12)]
    assert sizes == sorted(sizes) and (tau == 0 or sizes[0] < sizes[-1])


def keeps(plan, tau, rng):
    used = [b for part, _ in plan for b in part]
    assert len(used) == len(set(used))
    for _ in range(300):
        flips = set(rng.choice(64, tau, replace=False).tolist())
        assert any(len(flips & set(part)) <= t for part, t in plan)


def test_all_links_within_tau_are_found(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    sig = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 9), replace=False)) for b in base for _ in range(6)]
    sig = sorted(set(sig))
    df = spark.createDataFrame([(x, x) for x in sig], "node long, w0 long")
    got = components(simhash.links(df, 1, 6, 6))
    found = {r["node"]: r["component"] for r in got.collect()}
    comp = joined(len(sig), [(i, j) for i, j in itertools.combinations(range(len(sig)), 2) if ((sig[i] ^ sig[j]) & (1 << 64) - 1).bit_count() <= 6])
    assert [found.get(x, x) for x in sig] == [sig[c] for c in comp]


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(50)] + [(300, 300), (r.randrange(400, 500), r.randrange(400, 500))] * 2
    edges += [(r.randrange(600, 700), r.randrange(600, 700)) for _ in range(80)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = joined(700, edges)
    assert all(got.get(n, n) == top[n] for n in range(700))


def test_spanning_connects_the_same():
    rng = np.random.default_rng(2)
    for n in (1, 5, 200):
        a, b = rng.integers(0, 100, (2, n))
        x, y = simhash.spanning(a, b)
        assert joined(100, zip(a, b, strict=True)) == joined(100, zip(x, y, strict=True)) and len(x) <= 100
    chain = np.arange(500)
    assert len(simhash.spanning(chain[:-1], chain[1:])[0]) == 499


@pytest.mark.parametrize("keys", [0, 10**6])
def test_dedup_keeps_one_of_each_group(spark, documents, monkeypatch, keys):
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", keys)
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(500)]
    base = [[r.choice(vocabulary) for _ in range(300)] for _ in range(12)]
    rows = []
    for k, words in enumerate(base):
        rows.append((k * 10, " ".join(words)))
        for i in range(1, 4):
            own = list(words)
            own[r.randrange(300)] = "other"
            rows.append((k * 10 + i, " ".join(own) if i > 1 else " ".join(words).upper()))
    rows += [(500, "something of its own here"), (500, "something of its own here"), (None, "without any id at all"), (501, None), (502, "")]
    docs = documents(rows)
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    got = sorted((x["doc_id"] for x in kept.collect()), key=str)
    assert got == sorted([*(k * 10 for k in range(12)), 500, None, 501], key=str)


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def family(r, n, shared, own, first):
    """Texts that share a passage; each has words of its own around it."""
    passage = [f"p{r.randrange(10**6)}" for _ in range(shared)]
    word = lambda: f"o{r.randrange(10**9)}"
    return [(first + i, " ".join([word() for _ in range(own // 2)] + passage + [word() for _ in range(own - own // 2)])) for i in range(n)]


@pytest.mark.parametrize("sets", [512, 16])
def test_dedup_links_by_exact_similarity(spark, documents, monkeypatch, sets):
    monkeypatch.setattr(simhash, "SETS", sets)
    r = random.Random(11)
    rows = family(r, 60, 200, 50, 0) + family(r, 60, 200, 30, 100) + family(r, 40, 200, 10, 200) + family(r, 30, 400, 90, 300)
    for i, (_, text) in enumerate(rows[120::4]):  # a step away from the third family's
        rows.append((1000 + i, " ".join(text.split()[: -r.randrange(1, 60)])))
    sets_ = [shingles(t) for _, t in rows]
    comp = joined(len(rows), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if len(sets_[i] & sets_[j]) / len(sets_[i] | sets_[j]) >= 0.8])
    kept = [x["doc_id"] for x in simhash.dedup(documents(rows)).collect()]
    assert sorted(kept) == sorted({rows[c][0] for c in comp}) and len(kept) > 120


@pytest.mark.parametrize("sides", [1, 2])
def test_similar_against_all_pairs(sides):
    rng = np.random.default_rng(12)
    for n in (2, 30, 120):
        base = [rng.choice(400, rng.integers(1, 40), replace=False) for _ in range(n // 5 + 1)]
        sets = [np.unique(np.where(rng.random(len(b)) < 0.06, rng.integers(0, 400, len(b)), b)).astype(np.uint64) for b in (base[rng.integers(len(base))] for _ in range(n))]
        side = rng.integers(0, sides, n)
        two = side.min() != side.max()
        want = [(i, j) for i, j in itertools.combinations(range(n), 2) if (not two or side[i] != side[j]) and 10 * len(np.intersect1d(sets[i], sets[j])) >= 8 * len(np.union1d(sets[i], sets[j]))]
        assert joined(n, simhash.similar(sets, side, 0.8)) == joined(n, want)


def test_similar_takes_the_bound_itself():
    four, five = np.arange(4, dtype=np.uint64), np.arange(5, dtype=np.uint64)
    assert simhash.similar([four, five], np.zeros(2, int), 0.8) == [(0, 1)]
    assert simhash.similar([four, five, four + np.uint64(100)], np.array([0, 0, 1]), 0.8) == []
    assert simhash.similar([four, five], np.zeros(2, int), 0.81) == []
    assert simhash.similar([four[:0], five], np.zeros(2, int), 0.8) == []


def test_empty(spark, documents):
    assert simhash.near_duplicates(documents([])).count() == 0
    assert simhash.dedup(documents([])).count() == 0


def test_dedup_against_brute_force_on_documents(spark, sf_dir):
    docs = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    sets = [shingles(t) if t.split() else set() for _, t in rows]
    comp = joined(len(rows), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))])
    low = {}
    for (doc, _), c in zip(rows, comp, strict=True):
        low[c] = min(low.get(c, doc), doc)
    kept = {r["doc_id"] for r in simhash.dedup(docs).collect()}
    assert set(low.values()) <= kept  # nothing that stands alone goes
    assert len(kept) - len(low) <= 0.1 * (len(rows) - len(low))
