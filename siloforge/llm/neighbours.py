"""Approximate nearest neighbours by a permutation index.

PIVOTS vectors, chosen farthest-first from a bounded sample (the SAMPLE vectors of least hash), order the space: a
vector is represented by its PREFIX nearest pivots in order. Vectors lie in blocks of about BLOCK or more (by the hash of
their id); a block posts its vectors in one inverted file a pivot, which holds the vectors that have the pivot on their list, and its
place there. A query opens the files of its own pivots; what they hold gives the footrule distances: with weight PREFIX - place, absent pivots last, the distance is a constant
less twice the sum of the smaller weights over common pivots. The nearest of a block (its FRACTION, at least LEAST, with
all ties) are reranked by exact inner products, and the blocks' best are merged. As footrule distances follow the angle only, a
block is split in bands of norms within a factor of BAND; each band gives its nearest, from the greatest norms down, until
no inner product with a band can reach the best found (|q| |x| bounds it). All vectors are indexed; queries
go to all blocks, a batch at a time. Equal vectors are indexed once and listed with all their ids.

Nearness is the inner product in double precision. Null or empty vectors, zero vectors and those with null or
non-finite components take no part, nor do null ids; vectors of another length than the query's are no candidates. Of
rows of equal id the least vector counts. Ties go to the smaller id. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siloforge.session import table

PIVOTS, PREFIX, SAMPLE, BLOCK, FRACTION, LEAST, TOP, BAND = 256, 48, 4096, 4096, 0.15, 256, 20, 1.1
BLOCKS, BLOCK_BYTES = 64, 64 << 20
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, vec, dim) of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec")).filter("vec_id IS NOT NULL AND size(vec) > 0")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    return v.filter(fine).withColumn("dim", F.size("vec"))


def chosen_pivots(sample: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Farthest-first: each pivot is the sample's vector whose nearest pivot so far is farthest, by cosine."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    taken, best = [0], x @ x[0]
    while len(taken) < min(pivots, len(x)):
        nearest = int(np.argmin(best))
        taken.append(nearest)
        best = np.maximum(best, x @ x[nearest])
    return x[taken]


def pivots_of(vectors: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """By vector length, the pivots."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("dim", "vec").collect()
    return {d: chosen_pivots(np.array([r[1] for r in rows if r[0] == d])) for d in sorted({r[0] for r in rows})}


def weights(x: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """Of each vector and pivot: prefix less the pivot's place on the vector's list, 0 if it isn't on it."""
    prefix = min(prefix, len(pivots))
    order = np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix]
    out = np.zeros((len(x), len(pivots)), np.uint16)
    np.put_along_axis(out, order, np.arange(prefix, 0, -1, dtype=np.uint16)[None, :].repeat(len(x), 0), 1)
    return out


def postings(w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The inverted files: of each pivot, the rows that have it on their list, ascending, and its weight there."""
    out = []
    for column in np.ascontiguousarray(w.T):
        rows = np.flatnonzero(column)
        out.append((rows.astype(np.int32), column[rows]))
    return out


def blocks_for(n: int, dim: int) -> int:
    """Blocks for so many vectors: of about BLOCK up to BLOCKS of them, then larger ones (as every query goes to every block), up to BLOCK_BYTES of vectors each."""
    return max(1, min(-(-n // BLOCK), max(BLOCKS, -(-8 * n * dim // BLOCK_BYTES))))


def log_norms(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    return np.log(scale[:, 0]) + np.log(np.linalg.norm(x / scale, axis=1))


class Block:
    """A block's inverted files. ids ascend."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray | None) -> None:
        rows = np.ascontiguousarray(x + 0.0).view([("", np.float64)] * x.shape[1])[:, 0]
        _, first, which = np.unique(rows, return_index=True, return_inverse=True)
        order = np.argsort(first)  # by least id
        place = np.empty(len(first), np.int64)
        place[order] = np.arange(len(first))
        self.x = x[first[order]]
        by = np.argsort(place[which], kind="stable")
        self.ids, self.start = ids[by], np.concatenate([[0], np.cumsum(np.bincount(place[which]))])
        size = log_norms(self.x)
        band = np.floor((size.max() - size) / np.log(BAND) + 1e-3).astype(np.int64)
        self.bands = [(size[at].max(), at) for at in (np.flatnonzero(band == b) for b in np.unique(band))]  # greatest norms first
        self.pivots = pivots
        self.files = None if pivots is None else postings(weights(self.x, pivots))

    def nearest(self, query: int, q: np.ndarray, w: np.ndarray | None, top: int, fraction: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and scores of the best vectors found, best first."""
        common, long = None, log_norms(q[None, :])[0]
        at, score = np.zeros(0, np.int64), np.zeros(0)
        for size, own in self.bands:
            if len(score) > top and (worst := np.partition(score, len(score) - top - 1)[len(score) - top - 1]) > 0 and np.log(worst) > long + size + 1e-9:
                break
            n = len(own)
            want = max(int(np.ceil(fraction * n)), least, top + 1)
            if self.files is not None and want < n:
                if common is None:
                    common = np.zeros(len(self.x), np.uint16)
                    for p in np.flatnonzero(w):
                        rows, held = self.files[p]
                        common[rows] += np.minimum(held, w[p])
                near = common[own]
                own = own[near >= np.partition(near, n - want)[n - want]]
            at, score = np.concatenate([at, own]), np.concatenate([score, (self.x[own] * q).sum(1)])  # row by row, so equal vectors of any block score alike
        if len(at) > top + 1:
            keep = score >= np.partition(score, len(score) - top - 1)[len(score) - top - 1]
            at, score = at[keep], score[keep]
        ids, scores = [], []
        for a, s in zip(at.tolist(), score.tolist(), strict=True):
            own = self.ids[self.start[a] : min(self.start[a + 1], self.start[a] + top + 1)]
            own = own[own != query][:top]
            ids.append(own)
            scores.append(np.full(len(own), s))
        i, s = np.concatenate(ids), np.concatenate(scores)
        best = np.lexsort((i, -s))[:top]
        return i[best], s[best]


def search(vectors: DataFrame, is_query: Column, top: int = TOP, vector: str = "embedding", fraction: float = FRACTION, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each query (a condition on vec_id) among all other vectors."""
    spark = vectors.sparkSession
    v = usable(vectors, vector)
    model = spark.sparkContext.broadcast(pivots_of(v))
    n, dim = v.agg(F.count(F.lit(1)), F.max("dim")).first()
    blocks = blocks_for(n, dim or 1)
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    both = v.select("dim", block.alias("block"), F.lit(0).alias("kind"), "vec_id", "vec").unionByName(v.filter(is_query).select("dim", every.alias("block"), F.lit(1).alias("kind"), "vec_id", "vec"))
    both = both.repartition("dim", "block").sortWithinPartitions("dim", "block", "kind", "vec_id", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, xs, now, last = None, [], [], None, None
        for batch in batches:
            dims, nos, kinds, keys = (batch.column(c).to_numpy() for c in ("dim", "block", "kind", "vec_id"))
            column = batch.column("vec")
            a = 0
            while a < batch.num_rows:
                head = (int(dims[a]), int(nos[a]), int(kinds[a]))
                same = (dims[a:] == head[0]) & (nos[a:] == head[1]) & (kinds[a:] == head[2])
                b = a + (len(same) if same.all() else int(np.argmin(same)))
                x = column.slice(a, b - a).flatten().to_numpy().reshape(b - a, head[0])
                own = keys[a:b]
                if key != head:
                    last = None
                fresh = np.concatenate([[last is None or own[0] != last], own[1:] != own[:-1]])
                last = int(own[-1])
                own, x = own[fresh], x[fresh]
                if head[2] == 0:
                    if key != head:
                        ids, xs, now = [], [], None
                    ids.append(own)
                    xs.append(x.copy())
                elif len(own):
                    if key is None or key[:2] != head[:2]:
                        ids, xs, now = [], [], None
                    if ids and now is None:
                        now = Block(np.concatenate(ids), np.concatenate(xs), model.value.get(head[0]))
                    if now:
                        w = None if now.pivots is None else weights(x, now.pivots)
                        got = [now.nearest(q, x[i], None if w is None else w[i], top, fraction, least) for i, q in enumerate(own.tolist())]
                        size = [len(g[0]) for g in got]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.repeat(own, size)), pa.array(np.concatenate([g[0] for g in got])), pa.array(np.concatenate([g[1] for g in got]))], names=["query_id", "vec_id", "score"]
                        )
                key, a = head, b

    found = both.mapInArrow(run, FOUND)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
