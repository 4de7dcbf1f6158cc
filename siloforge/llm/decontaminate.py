"""Benchmark decontamination by winnowing.

Each text keeps, of every run of WINDOW neighbouring k-grams, the smallest hash (the rightmost of equals); two
texts that share SPAN = K + WINDOW - 1 words in a row so share a kept fingerprint. Training and test fingerprints
are joined, and each hit is extended to the SPAN-word windows around it, which are then compared word by word.

A test item of fewer than SPAN words (but not none) is one window; all its length's grams are kept, so it can't
be missed either. While the test set's index takes at most BROADCAST_BYTES, by a count of its words beforehand, it is
made once and broadcast; beyond that the fingerprints and windows are joined by shuffles, where windows are compared by their MD5. Both
ways give the same rows. Long texts are hashed piece by piece.

Null and empty texts have no words and are never contaminated; items of null or empty text never occur. Repeated
rows each get their own equal row. Other columns of the inputs are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siloforge.llm.rows import map_rows
from siloforge.llm.words import WordHasher, grams, mix, utf8, word_slices
from siloforge.session import arrow_limits, cut, table

SPAN, K = 13, 7
BROADCAST_BYTES = 64 << 20
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
HITS = "doc_id long, n_words long, hit_from array<long>, hit_to array<long>, items array<string>"


def winnow(h: np.ndarray, first: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that are the least of some window of them. first: each text's first word, and the end."""
    g = grams(h, k)
    if not len(g):
        return np.zeros(0, np.int64), g
    for cutoff in range(1, k):  # grams that run into the next text
        at = first[1:-1] - cutoff
        g[at[(at >= 0) & (at < len(g))]] = TOP
    n = len(g) - window + 1
    if window == 1 or n <= 0:
        keep = np.flatnonzero(g != TOP)
        return keep, g[keep]
    least = g[:n].copy()
    for j in range(1, window):
        np.minimum(least, g[j : j + n], out=least)
    at = np.arange(n)
    for j in range(1, window):
        same = g[j : j + n] == least
        at[same] = np.flatnonzero(same) + j
    keep = np.unique(at)
    keep = keep[g[keep] != TOP]
    return keep, g[keep]


def words_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    if not len(starts):
        return b""
    base, raw = int(starts[0]), data[starts[0] : ends[-1]].tobytes()
    return b" ".join(raw[s - base : e - base] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)).lower()


def shape(length: int, span: int = SPAN, k: int = K) -> tuple[int, int]:
    """Words in a gram and grams in a winnowing window, for windows of so many words."""
    return (k, length - k + 1) if length == span else (length, 1)


def windows_around(at: np.ndarray, length: int, k: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hit gram extended: the first words of all windows of this length that hold one of these grams, and their texts."""
    at = np.unique((at[:, None] - np.arange(length - k + 1)[None, :]).ravel())
    at = at[at >= 0]
    text = np.searchsorted(first, at, "right") - 1
    ok = at + length <= first[np.minimum(text + 1, len(first) - 1)]
    ok &= text < len(first) - 1
    return at[ok], text[ok]


def window_hashes(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(length):
            out = out * np.uint64(0xD6E8FEB86659FD93) + h[at + j]
        return mix(out)


class ItemIndex:
    """Fingerprints and windows of the test items, in flat sorted arrays. Of each window length: the sorted fingerprints; the windows' sorted hashes, where each is spelt in the items' bytes, and the items that hold it."""

    def __init__(self, ids: list, texts: list[str | None], span: int = SPAN, k: int = K) -> None:
        self.span, self.k = span, k
        self.ids = ["" if i is None else str(i) for i in ids]
        self.data, off = utf8(pa.array(texts, pa.large_string()))
        self.data = self.data.copy()
        parts, at = [], 0
        for a, _, _, _, own, starts, ends, h, first in word_slices(WordHasher(), self.data, off, 0):
            parts.append((starts + at, ends + at, h, np.repeat(np.arange(a, a + len(first) - 1), np.diff(first))))
            at += len(own)
        self.starts, self.ends, hashes, owner = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(4))
        del parts
        self.windows: dict[int, tuple] = {}
        counts = np.bincount(owner.astype(np.int64), minlength=len(self.ids))
        first = np.concatenate([[0], np.cumsum(counts)])
        for length in np.unique(np.minimum(counts[counts > 0], span)).tolist():
            own = np.flatnonzero(np.minimum(counts, span) == length)
            kk, window = shape(length, span, k)
            rows = np.repeat(first[own], counts[own]) + np.arange(counts[own].sum()) - np.repeat(np.cumsum(counts[own]) - counts[own], counts[own])
            prints = np.unique(winnow(hashes[rows].astype(np.uint64), np.concatenate([[0], np.cumsum(counts[own])]), kk, window)[1])
            each = counts[own] - length + 1
            at = np.repeat(first[own], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            g = window_hashes(hashes.astype(np.uint64), at, length)
            order = np.argsort(g, kind="stable")
            self.windows[length] = prints, *self.distinct(g[order], at[order], owner[at[order]], length)
        big = len(self.data) > 1 << 31
        self.starts, self.ends = (x.astype(np.int64 if big else np.int32) for x in (self.starts, self.ends))

    def distinct(self, g: np.ndarray, at: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of windows in the order of their hashes, those of different words: hash, a place, where its items begin in the last array, the items."""
        same = np.zeros(len(g), np.int64)
        runs = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        ends = np.append(runs[1:], len(g))
        for s, e in zip(runs[ends - runs > 1].tolist(), ends[ends - runs > 1].tolist(), strict=True):  # equal words share one entry, colliding hashes get one each
            seen: dict[bytes, int] = {}
            for i in range(s, e):
                same[i] = seen.setdefault(self.spelt(int(at[i]), length), len(seen))
        order = np.lexsort((owner, same, g))
        g, at, owner, same = g[order], at[order], owner[order], same[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (same[1:] != same[:-1])])[: len(g)]
        fresh = new | np.concatenate([[True], owner[1:] != owner[:-1]])[: len(g)]
        items, begin = owner[fresh], np.cumsum(fresh)[new] - 1
        return g[new], at[new].astype(np.int32), np.append(begin, len(items)).astype(np.int32), items.astype(np.int32)

    def spelt(self, at: int, length: int) -> bytes:
        return words_of(self.data, self.starts[at : at + length], self.ends[at : at + length])

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.data, self.starts, self.ends, *(y for w in self.windows.values() for y in w))) + sum(len(x) + 60 for x in self.ids)

    def hits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, int, np.ndarray]]:
        """(text, first words, length, items): the windows of these texts that some item has, by text and length."""
        for length, (prints, g, place, begin, items) in self.windows.items():
            k, window = shape(length, self.span, self.k)
            at, own = winnow(h, first, k, window)
            at = at[found(prints, own)]
            if not len(at):
                continue
            at, text = windows_around(at, length, k, first)
            own = window_hashes(h, at, length)
            ok = found(g, own)
            at, text, lo = at[ok], text[ok], np.searchsorted(g, own[ok])
            which = np.full(len(at), -1)
            for i, (p, n) in enumerate(zip(at.tolist(), lo.tolist(), strict=True)):  # word by word
                spelt = words_of(data, starts[p : p + length], ends[p : p + length])
                while n < len(g) and g[n] == g[lo[i]]:
                    if self.spelt(int(place[n]), length) == spelt:
                        which[i] = n
                        break
                    n += 1
            at, text, which = at[which >= 0], text[which >= 0], which[which >= 0]
            for t in np.unique(text).tolist():
                mine = text == t
                yield t, at[mine] - first[t], length, np.unique(np.concatenate([items[begin[n] : begin[n + 1]] for n in np.unique(which[mine]).tolist()]))


def found(values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted values."""
    if not len(values):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


class Found:
    """What was found in a text: spans of words, joined where they touch or overlap, and numbers of items."""

    def __init__(self) -> None:
        self.spans, self.items = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)

    def add(self, at: np.ndarray, length: int, items: np.ndarray) -> None:
        self.spans = merged(np.concatenate([self.spans, np.stack([at, at + length], axis=1)]))
        self.items = np.union1d(self.items, items)

    def words(self) -> int:
        return int((self.spans[:, 1] - self.spans[:, 0]).sum())


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans (first, end) joined where they touch or overlap."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.append(np.flatnonzero(new)[1:], len(spans)) - 1]], axis=1)


def scan(batches: Iterator[pa.RecordBatch], index: ItemIndex, per_text: Callable) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        data, off = utf8(batch.column("text"))
        hits: dict[int, Found] = {}
        for a, b, base, last, own, starts, ends, h, first in word_slices(hasher, data, off, index.span - 1):
            for t, at, length, items in index.hits(own, starts, ends, h, first):
                hits.setdefault(t, Found()).add(at + base, length, items)
            if last:
                yield per_text(batch.slice(a, b - a), np.diff(first) + base, hits)
                hits = {}


def hit_rows(batch: pa.RecordBatch, counts: np.ndarray, hits: dict[int, Found], ids: list[str]) -> pa.RecordBatch:
    none = Found()
    rows = [hits.get(i, none) for i in range(batch.num_rows)]
    spans = [pa.array([x.spans[:, k].tolist() for x in rows], pa.list_(pa.int64())) for k in (0, 1)]
    items = [sorted({ids[n] for n in x.items.tolist()}) for x in rows]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), *spans, pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "hit_from", "hit_to", "items"]
    )


def index_bytes(items: DataFrame) -> int:
    """At least as many bytes as ItemIndex.nbytes of these items: their text, 40 bytes a word, and their ids."""
    words = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    own = F.coalesce(F.octet_length("text") + 40 * words, F.lit(0)) + F.coalesce(F.octet_length(F.col("item_id").cast("string")), F.lit(0)) + 128
    return items.agg(F.sum(own.cast("long"))).first()[0] or 0


def index_of(items: DataFrame) -> ItemIndex:
    rows = items.select("item_id", "text").collect()
    return ItemIndex([r[0] for r in rows], [r[1] for r in rows])


def contamination(docs: DataFrame, items: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, the hit spans of words (hit_from, hit_to: merged, end excluded) and the items with occurring windows, sorted as strings."""
    spark = docs.sparkSession
    arrow_limits(spark)
    items = items.select("item_id", "text")
    docs = docs.select("doc_id", "text")
    if index_bytes(items) > broadcast_bytes:
        return joined(docs, items).drop("k")
    held = spark.sparkContext.broadcast(index_of(items))
    return docs.mapInArrow(lambda batches: scan(batches, held.value, lambda *x: hit_rows(*x, held.value.ids)), HITS)


def key_of() -> Column:
    """A document's key by its id and text: 128 bits. Rows with equal keys have equal results."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")))))


def fingerprints(df: DataFrame, lengths: list[int], is_item: bool) -> DataFrame:
    """(k, length, print): what winnowing keeps of each text for the windows of each length. An item has the one length of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            data, off = utf8(batch.column("text"))
            for a, b, base, last, _, _, _, h, first in word_slices(hasher, data, off, SPAN - 1):
                counts = np.diff(first) + (base or SPAN * (not last))  # a text in pieces has more than SPAN words
                for length in lengths:
                    k, window = shape(length)
                    at, g = winnow(h, first, k, window)
                    text = np.searchsorted(first, at, "right") - 1
                    ok = (np.minimum(counts[text], SPAN) == length) if is_item else counts[text] >= length
                    text, g = text[ok], g[ok]
                    if len(g):
                        pairs = np.unique(np.stack([text.astype(np.uint64), g]), axis=1)
                        keys = batch.column("k").slice(a, b - a).take(pa.array(pairs[0].astype(np.int64)))
                        yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(keys), length), pa.int32()), pa.array(pairs[1].view(np.int64))], names=["k", "length", "print"])

    return df.select("k", "text").mapInArrow(run, "k binary, length int, print long")


def windows(df: DataFrame, is_item: bool) -> DataFrame:
    """(k, at, length, window): windows and the MD5 of their words. Of an item all; of a document, which has its hits as (length, prints), those around a hit fingerprint."""

    def rows(batch: pa.RecordBatch, hasher: WordHasher) -> Iterator[tuple]:
        data, off = utf8(batch.column("text"))
        hits = None if is_item else batch.column("hits").to_pylist()
        prints: dict = {}
        for a, _, base, last, own, starts, ends, h, first in word_slices(hasher, data, off, SPAN - 1):
            counts = np.diff(first) + (base or SPAN * (not last))
            for t in range(len(counts)):
                s, e = int(first[t]), int(first[t + 1])
                if is_item:
                    wanted = [(min(int(counts[t]), SPAN), None)] if counts[t] else []
                else:
                    if prints.get("row") != a + t:
                        prints = {"row": a + t, "hits": [(x["length"], np.array(sorted(x["prints"]), np.int64).view(np.uint64)) for x in hits[a + t]]}
                        prints["hits"] = [(n, np.sort(p)) for n, p in prints["hits"]]
                    wanted = prints["hits"]
                for length, known in wanted:
                    if known is None:
                        at = np.arange(max(e - s - length + 1, 0))
                    else:
                        k, window = shape(length)
                        at, g = winnow(h[s:e], np.array([0, e - s]), k, window)
                        at = windows_around(at[found(known, g)], length, k, np.array([0, e - s]))[0]
                    for p in at.tolist():
                        yield a + t, base + p, length, hashlib.md5(words_of(own, starts[s + p : s + p + length], ends[s + p : s + p + length])).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for part in itertools.batched(rows(batch, hasher), 65536):
                row, at, length, digest = zip(*part, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(row, pa.int64())), pa.array(at, pa.int64()), pa.array(length, pa.int32()), pa.array(digest, pa.binary())], names=["k", "at", "length", "window"])

    return df.mapInArrow(run, "k binary, at long, length int, window binary")


def joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """contamination() for test sets of any size, and each document's key k. Documents' fingerprints are semi-joined with the items' different ones (a row each, so a common one's side can be split); each document with hits gets its text once, gives the windows around them, and these are semi-joined with the items' different windows."""
    docs = docs.withColumn("k", key_of())
    tests = items.withColumn("k", F.encode(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "UTF-8"))
    prints = cut(fingerprints(tests, list(range(1, SPAN + 1)), True).select("length", "print").distinct(), "prints")
    present = sorted(r[0] for r in prints.select("length").distinct().collect())  # at most SPAN values
    held = cut(windows(tests.select("k", "text"), True).select("length", "window", F.decode("k", "UTF-8").alias("item")).distinct(), "windows")
    near = fingerprints(docs, present or [SPAN], False).join(prints, ["length", "print"], "left_semi").distinct()
    near = near.groupBy("k", "length").agg(F.collect_list("print").alias("prints")).groupBy("k").agg(F.collect_list(F.struct("length", "prints")).alias("hits"))
    texts = docs.select("k", "text").join(cut(near, "near"), "k").dropDuplicates(["k"])
    hits = cut(windows(texts, False).join(held.select("length", "window").distinct(), ["length", "window"], "left_semi").distinct(), "hits")
    spans = hits.groupBy("k").agg(F.collect_set(F.struct("at", (F.col("at") + F.col("length")).alias("to"))).alias("spans"))
    own = hits.select("k", "length", "window").distinct().join(held, ["length", "window"]).groupBy("k").agg(F.array_sort(F.collect_set("item")).alias("items"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            data, off = utf8(batch.column("text"))
            for a, b, base, last, _, _, _, _, first in word_slices(hasher, data, off, 0):
                if last:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).cast(pa.int64()), batch.column("k").slice(a, b - a), pa.array(np.diff(first) + base, pa.int64())], names=["doc_id", "k", "n_words"])

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged(np.array([(x["at"], x["to"]) for x in s or []], np.int64).reshape(-1, 2)) for s in batch.column("spans").to_pylist()]
            sides = [pa.array([x[:, i].tolist() for x in spans], pa.list_(pa.int64())) for i in (0, 1)]
            items_ = pa.array([x or [] for x in batch.column("items").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("doc_id"), batch.column("n_words"), *sides, items_], names=["k", "doc_id", "n_words", "hit_from", "hit_to", "items"])

    per = spans.join(own, "k")
    return docs.mapInArrow(counts, "doc_id long, k binary, n_words long").join(per, "k", "left").mapInArrow(union, f"k binary, {HITS}")


def n_hit() -> Column:
    return F.aggregate(F.zip_with("hit_to", "hit_from", lambda b, a: b - a), F.lit(0).cast("long"), lambda s, x: s + x)


def contaminated() -> Column:
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def digest(found_: DataFrame) -> DataFrame:
    return found_.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents that aren't contaminated (a hit word, and at least one word in 20), with all their columns. The verdict is made row by row, or by id and text where the test set is too large to broadcast."""
    spark = docs.sparkSession
    arrow_limits(spark)
    items = items.select("item_id", "text")
    if index_bytes(items) > broadcast_bytes:
        bad = joined(docs.select("doc_id", "text"), items).filter(contaminated()).select(F.col("k").alias("__sf_bad")).distinct()
        return docs.withColumn("__sf_key", key_of()).join(bad, F.col("__sf_key") == F.col("__sf_bad"), "left_anti").drop("__sf_key")
    held = spark.sparkContext.broadcast(index_of(items))

    def keep(batch: pa.RecordBatch, counts: np.ndarray, hits: dict[int, Found]) -> pa.RecordBatch:
        ok = np.ones(batch.num_rows, bool)
        for i, x in hits.items():
            ok[i] = 20 * x.words() < counts[i]
        return batch.filter(pa.array(ok))

    return map_rows(docs, lambda batches: scan(batches, held.value, keep))


def op6(spark, sf_dir: str) -> DataFrame:
    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) n, array_to_string(w[p : p + least(len(w), 13) - 1], ' ') g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) p FROM i WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) p FROM d, ns WHERE len(w) >= n)),
m AS (SELECT r, dw.n, p, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
hw AS (SELECT r, count(DISTINCT q) c FROM (SELECT r, unnest(range(p, p + n)) q FROM (SELECT DISTINCT r, n, p FROM m)) GROUP BY r),
it AS (SELECT r, count(*) c, string_agg(s, ',' ORDER BY s) l FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) s FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(hw.c, 0) AS BIGINT) n_hit, CAST(coalesce(it.c, 0) AS BIGINT) n_items, sha256(coalesce(it.l, '')) items_sha256,
  coalesce(hw.c, 0) > 0 AND 20 * coalesce(hw.c, 0) >= len(w) contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN it USING (r)
"""
