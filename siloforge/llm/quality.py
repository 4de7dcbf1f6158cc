"""Quality classification by nearest-neighbour voting in a latent-semantic space.

A text's terms are its byte trigrams, hashed into TERMS columns, and four shape terms (variety of trigrams, shares of
capitals, of symbols and of digits). Document frequencies are counted over all documents. A sample of labelled texts, at
most PER_CLASS of each label (the bound on what is learnt from; the rows of least hash), is weighted by them and
factored: the leading DIMENSIONS right singular vectors project any text's weighted terms, and the
projections of the sample are broadcast with their labels. Every document is multiplied with all of them in blocks;
its K nearest vote for their labels with their similarity, corrected for the sample's share of each label.

Texts are read whole. Null texts are empty; a text without a trigram has no neighbour and scores 0. Labels of a
document that occurs repeatedly count as one, by majority (ties: 1); null labels and null ids don't count. Without
labels of both kinds the score is the one label's, or 0.5 without any. Other columns are ignored, or kept by
accepted(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siloforge.llm.rows import map_rows
from siloforge.llm.words import slices, utf8
from siloforge.session import arrow_limits, cut, discard, table

TERMS, SHAPES, DIMENSIONS, PER_CLASS, K = 4096, 4, 64, 1500, 15
SHAPE_WEIGHT, SHARPNESS, ACCEPT = 0.35, 8, 0.7
PIECE, ROWS = 1 << 20, 256


def kinds() -> np.ndarray:
    """1 capital, 2 symbol, 3 digit, 0 other, for each byte."""
    out = np.zeros(256, np.int64)
    out[33:48] = out[58:65] = out[91:97] = out[123:127] = 2
    out[48:58] = 3
    out[65:91] = 1
    return out


def term_counts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: counts of its hashed trigrams, and its shape terms. A long text is counted piece by piece."""
    n = len(off) - 1
    counts, shape = np.zeros((n, TERMS), np.float32), np.zeros((n, 4))
    kind = kinds()
    for a in range(0, max(len(data), 1), PIECE):
        part = data[a : a + PIECE + 2].astype(np.uint32)
        own = np.searchsorted(off, np.arange(a, min(a + PIECE, len(data))), "right") - 1
        if not len(own):
            continue
        lo, hi = int(own[0]), int(own[-1])
        m = max(len(part) - 2, 0)
        m = min(m, len(own))
        h = (part[:m] * np.uint32(0x9E3779B1) + part[1 : m + 1] * np.uint32(0x85EBCA6B) + part[2 : m + 2] * np.uint32(0xC2B2AE35)) >> np.uint32(20)
        ok = np.arange(a, a + m) + 2 < off[own[:m] + 1]
        got = np.bincount((own[:m][ok] - lo) * TERMS + h[ok], minlength=(hi - lo + 1) * TERMS)
        counts[lo : hi + 1] += got.reshape(-1, TERMS)
        shape[lo : hi + 1] += np.bincount((own - lo) * 4 + kind[data[a : a + len(own)]], minlength=(hi - lo + 1) * 4).reshape(-1, 4)
    total = counts.sum(1)
    variety = np.log1p((counts > 0).sum(1)) / np.log1p(np.maximum(total, 1))
    share = shape / np.maximum(shape.sum(1, keepdims=True), 1)
    return counts, np.stack([np.where(total > 0, 1.5 * (1 - variety), 0), *(share[:, 1:].T)], axis=1).astype(np.float32)


def packed(counts: np.ndarray, shape: np.ndarray) -> bytes:
    """One text's shape terms, and its terms that occur with their counts, unaltered."""
    at = np.flatnonzero(counts)
    return shape.tobytes() + at.astype(np.uint16).tobytes() + counts[at].tobytes()


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What term_counts() gave for the text, as arrays of one row."""
    n = (len(raw) - 4 * SHAPES) // 6
    counts = np.zeros((1, TERMS), np.float32)
    counts[0, np.frombuffer(raw, np.uint16, n, 4 * SHAPES)] = np.frombuffer(raw[4 * SHAPES + 2 * n :], np.float32)
    return counts, np.frombuffer(raw, np.float32, SHAPES)[None]


def weighted(counts: np.ndarray, shape: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of log counts times idf, of unit length, with the shape terms beside them; all zero without a trigram."""
    x = np.log1p(counts) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return np.concatenate([x, shape / np.float32(SHAPE_WEIGHT)], axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of documents, and in how many each term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(TERMS, np.int64)
        for batch in batches:
            data, off = utf8(batch.column("text"))
            for a, b in slices(off, rows=ROWS):
                n += b - a
                df += (term_counts(data[off[a] : off[b]], off[a : b + 1] - off[a])[0] > 0).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, TERMS)), pa.array(np.concatenate([[n], df]))], names=["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect()  # TERMS + 1 rows
    got = dict(map(tuple, rows))
    return got.get(-1, 0), np.array([got.get(t, 0) for t in range(TERMS)])


class Voters:
    """The model: term weights, projection, the sample's vectors, labels and vote weights."""

    def __init__(self, idf: np.ndarray, x: np.ndarray, labels: np.ndarray, share: tuple[float, float], k: int = K) -> None:
        self.idf, self.labels, self.k = idf, labels.astype(np.float32), min(k, len(labels))
        self.projection = self.vectors = None
        have = [int((labels == c).sum()) for c in (0, 1)]
        self.weight = np.array([share[c] / max(have[c], 1) for c in labels.astype(int)], np.float32)
        if min(have):
            self.projection = leading(x, min(DIMENSIONS, *x.shape))
            self.vectors = unit(x @ self.projection)

    def score(self, counts: np.ndarray, shape: np.ndarray) -> np.ndarray:
        some = counts.any(1)
        if self.vectors is None:
            return np.where(some, self.labels.mean() if len(self.labels) else 0.5, 0.0)
        near = unit(weighted(counts, shape, self.idf) @ self.projection) @ self.vectors.T
        at = np.argpartition(-near, self.k - 1, axis=1)[:, : self.k]
        vote = np.maximum(np.take_along_axis(near, at, 1), 1e-6).astype(np.float64) ** SHARPNESS * self.weight[at]
        return np.where(some, (vote * self.labels[at]).sum(1) / vote.sum(1), 0.0)


def leading(x: np.ndarray, d: int) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    q = np.random.default_rng(7).standard_normal((x.shape[1], min(d + 16, *x.shape))).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ np.linalg.qr(q)[0]))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :d].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Voters:
    spark = docs.sparkSession
    arrow_limits(spark)
    n, df = document_frequencies(docs)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(1)
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    known = cut(known.join(docs.select("doc_id"), "doc_id", "left_semi"), "known")
    totals = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    sample = [tuple(r) for c in (0, 1) for r in known.filter(F.col("quality") == c).orderBy(*order).limit(per_class).collect()]  # bounded by per_class
    if not sample:
        discard(known)
        return Voters(idf, np.zeros((0, TERMS + SHAPES)), np.zeros(0), (0.5, 0.5))
    chosen = spark.createDataFrame(sample, "doc_id long, quality int")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column("text"))
            for a, b in slices(off, rows=ROWS):
                counts, shape = term_counts(data[off[a] : off[b]], off[a : b + 1] - off[a])
                raw = [packed(c, s) for c, s in zip(counts, shape, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("quality").slice(a, b - a), pa.array(raw, pa.binary())], names=["doc_id", "quality", "raw"])

    rows = sorted(texts.mapInArrow(run, "doc_id long, quality int, raw binary").collect())  # 2 * per_class rows of a few KB
    known_labels, x = np.array([r[1] for r in rows]), np.empty((len(rows), TERMS + SHAPES), np.float32)
    for i, (_, _, raw) in enumerate(rows):  # one by one: the counts of the whole sample are never held beside x
        x[i] = weighted(*unpacked(raw), idf)[0]
    del rows
    discard(known)
    whole = sum(totals.values())
    return Voters(idf, x, known_labels, tuple(totals.get(c, 0) / whole for c in (0, 1)))


def scored(docs: DataFrame, model: Voters, columns: list[str], keep: float | None = None) -> DataFrame:
    """These columns of the documents and their score; or, with keep, the columns of the documents that score at least so much."""
    spark = docs.sparkSession
    arrow_limits(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column("text"))
            for a, b in slices(off, rows=ROWS):
                own = batch.slice(a, b - a)
                s = held.value.score(*term_counts(data[off[a] : off[b]], off[a : b + 1] - off[a]))
                if keep is not None:
                    yield own.filter(pa.array(s >= keep))
                else:
                    yield pa.RecordBatch.from_arrays([*(own.column(c) for c in columns), pa.array(s, pa.float64())], names=[*columns, "score"])

    if keep is not None:
        return map_rows(docs, run)
    read = docs.select(*dict.fromkeys([*columns, "text"]))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return read.mapInArrow(run, f"{schema}, score double")


def accepted(docs: DataFrame, labels: DataFrame, least: float = ACCEPT) -> DataFrame:
    """The documents that score at least so much, with all their columns."""
    return scored(docs, fit(docs, labels), docs.columns, least)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
