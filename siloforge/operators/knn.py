"""Multi-label nearest-neighbour models inside each silo: the relational path over tiles of similarities, and a batched kernel for many masks.

Ties are broken by similarity rounded to 9 digits, then by row id; a row is never its own neighbour.
"""

from __future__ import annotations

import heapq
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siloforge.functions.columns import arithmetic_hash, selected

SMOOTH, K, THRESHOLD, BLOCK = 1.0, 5, 0.5, 2048


def projected(rows: DataFrame, sel: list[int]) -> DataFrame:
    """Keeps the chosen features of x."""
    return rows.withColumn("x", selected(F.col("x"), F.array(*map(F.lit, sel))) if sel else F.array().cast("array<double>"))


def usable_silos(rows: DataFrame, min_train: int = 1, min_val: int = 1) -> DataFrame:
    """Rows of silos with at least so many training and validation rows."""
    ok = rows.groupBy("silo").agg(F.count_if(F.col("split") == "train").alias("nt"), F.count_if(F.col("split") == "val").alias("nv"))
    return rows.join(F.broadcast(ok.filter((F.col("nt") >= min_train) & (F.col("nv") >= min_val)).select("silo")), "silo", "left_semi")  # a row a silo


def flat(column: pa.ChunkedArray, dtype: type = float) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return values.reshape(len(lists), -1) if len(values) else np.zeros((len(lists), 0), dtype)


def unit(a: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    n = np.sqrt((a * a).sum(1, keepdims=True))
    return np.divide(a, n, out=np.zeros_like(a), where=n > 0)


def likeness(q: np.ndarray, x: np.ndarray, metric: str, out: np.ndarray | None = None) -> np.ndarray:
    """Inner product, or the negative squared distance, of each row of q and each of x, in out if it is given. Rows of length 1 have their cosine as inner product."""
    if metric == "cosine":
        return np.matmul(q, x.T, out=out)
    out, gap = np.zeros((len(q), len(x))), np.empty((len(q), len(x)))
    for a, b in zip(q.T, x.T, strict=True):
        np.subtract.outer(a, b, out=gap)
        gap *= gap
        out -= gap
    return out


def greatest(v: np.ndarray, k: int) -> np.ndarray:
    """The columns of each row's k greatest, ascending; of equal ones the first. No NaN."""
    least = np.partition(v, v.shape[1] - k, axis=1)[:, v.shape[1] - k, None]
    keep = v >= least
    if np.count_nonzero(keep) > k * len(v):
        same = v == least
        keep &= ~same | (same.cumsum(1, dtype=np.int32) <= k + (np.count_nonzero(same, axis=1) - np.count_nonzero(keep, axis=1))[:, None])
    return np.flatnonzero(keep).reshape(len(v), k) - np.arange(len(v))[:, None] * v.shape[1]


def nearest(q: np.ndarray, x: np.ndarray, k: int, own: np.ndarray | None = None, metric: str = "cosine", width: int = 32) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first, places, likenesses): blocks of rows of q, and for each row the places in x of its k nearest, by likeness rounded to 9 digits, then place. own: each query's own place in x, or -1; its likeness is -inf, as that of no number.

    x is cut into runs of width rows. The k nearest lie in the k runs of greatest likeness, the first of equals, so only those are searched. Place i is in column (i % width) * runs + i // width, by which the runs' greatest are maxima of whole rows.
    """
    k, runs = min(k, len(x)), max(1, -(-len(x) // width))
    place = (np.arange(runs)[None, :] * width + np.arange(width)[:, None]).ravel()
    beyond = np.flatnonzero(place >= len(x))
    dealt, odd = x[np.minimum(place, len(x) - 1)], not (np.isfinite(q).all() and np.isfinite(x).all())
    size = max(8, (1 << 17) // len(place))
    held = np.empty((size, len(place)))  # memory got anew for each block would cost as much as its search
    for a in range(0, len(q), size):
        sim = likeness(q[a : a + size], dealt, metric, held[: len(q) - a])
        sim[:, beyond] = -np.inf
        if odd:
            sim[np.isnan(sim)] = -np.inf
        row = np.arange(len(sim))
        if own is not None:
            mine = own[a : a + size]
            sim[row[mine >= 0], mine[mine >= 0] % width * runs + mine[mine >= 0] // width] = -np.inf
        sim = sim.reshape(len(sim), width, runs)
        run = greatest(np.round(sim.max(1), 9), min(k, runs))
        few = np.round(sim[row[:, None, None], np.arange(width), run[:, :, None]].reshape(len(sim), -1), 9)
        at = greatest(few, k)
        at = np.take_along_axis(at, np.argsort(-np.take_along_axis(few, at, 1), axis=1, kind="stable"), 1)
        yield a, np.take_along_axis(run, at // width, 1) * width + at % width, np.take_along_axis(few, at, 1)


def nearest_places(q: np.ndarray, x: np.ndarray, k: int, own: np.ndarray | None = None, width: int = 16, spare: int = 3) -> np.ndarray:
    """The places that nearest() finds for rows of length 1, in no order, by half as wide numbers.

    Likenesses in single precision only name k + spare candidates, whose own are made in double precision. A row is settled if its kth exceeds what any other place may have by the
    bound of single precision's error; rows that aren't (copies, very near ones) go to nearest(), and all of them once most of a block do.
    """
    (d, n), runs = x.T.shape, -(-len(x) // width)
    out, left = np.empty((len(q), min(k, n)), int), np.ones(len(q), bool)
    if d > 2 and k + spare < runs and np.isfinite(q).all() and np.isfinite(x).all():
        place = (np.arange(runs)[None, :] * width + np.arange(width)[:, None]).ravel()
        dealt, asked = np.zeros((d + 1, len(place)), np.float32), np.ones((len(q), d + 1), np.float32)
        dealt[:d, place < n], dealt[d, place >= n], asked[:, :d] = x[place[place < n]].T, -4, q  # nothing is less alike than -1
        size, error = max(8, (1 << 19) // len(place)), (d + 4) * 2.0**-24 + 2e-9
        held = np.empty((size, len(place)), np.float32)
        for a in range(0, len(q), size):
            sim = np.matmul(asked[a : a + size], dealt, out=held[: len(asked) - a])
            row = np.arange(len(sim))
            if own is not None:
                mine = own[a : a + size]
                sim[row[mine >= 0], mine[mine >= 0] % width * runs + mine[mine >= 0] // width] = -4
            run = greatest(sim.reshape(len(sim), width, runs).max(1), k + spare)
            column = (run[:, :, None] + np.arange(width) * runs).reshape(len(sim), -1)
            few = sim.ravel().take(column + row[:, None] * len(place))
            at = greatest(few, k + spare)
            most = np.take_along_axis(few, at, 1).min(1)  # of any other place
            column = np.take_along_axis(column, at, 1)
            known = np.sort(column % runs * width + column // runs, axis=1)
            exact = np.round(np.einsum("rcd,rd->rc", x[known], q[a : a + size]), 9)
            at = greatest(exact, k)
            out[a : a + size] = np.take_along_axis(known, at, 1)
            left[a : a + size] = np.take_along_axis(exact, at, 1).min(1) <= most + error
            if 2 * left[a : a + size].sum() > len(sim):
                break
    rest = np.flatnonzero(left)
    for a, top, _ in nearest(q[rest], x, k, None if own is None else own[rest]) if len(rest) else ():
        out[rest[a : a + len(top)]] = top
    return out


def spread_out(rows: DataFrame, *by: str) -> DataFrame:
    """Dealt out by these columns in as many partitions as the session shuffles into: their work is far larger than their bytes, by which adaptive execution would put them together."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def neighbours(rows: DataFrame, k: int = K, of: str = "train", metric: str = "cosine", block: int = BLOCK) -> DataFrame:
    """(silo, row_id, nbr_id, sim, rank, nbr_y): for each row of a split, its nearest training rows of its silo; k is clamped to the other training rows, at least 1.

    A silo is dealt out as tiles of about block queries and block training rows; a tile gives its own best k of each query, and the tiles' are merged.
    """
    kind = rows.schema["silo"].dataType.simpleString()
    tiles = lambda n: F.greatest(F.lit(1), F.ceil(n / block)).cast("int")
    sizes = rows.groupBy("silo").agg(F.count_if(F.col("split") == "train").alias("n"), tiles(F.count_if(F.col("split") == "train")).alias("ts"), tiles(F.count_if(F.col("split") == of)).alias("qs"))
    both = rows.select("silo", "row_id", "x", "y", "split").join(sizes, "silo")
    own, every = (lambda m: F.pmod(F.xxhash64("row_id"), F.col(m)).cast("int")), (lambda m: F.sequence(F.lit(0), F.col(m) - 1))
    # one pass, not a union of both sides: the optimizer fails to carry a captured column's constraint over a union when this is a session's first query
    none = F.array().cast("array<struct<q:int,t:int,asks:boolean>>")
    given = F.when(F.col("split") == "train", F.transform(every("qs"), lambda q: F.struct(q.alias("q"), own("ts").alias("t"), F.lit(False).alias("asks")))).otherwise(none)
    asking = F.when(F.col("split") == of, F.transform(every("ts"), lambda t: F.struct(own("qs").alias("q"), t.alias("t"), F.lit(True).alias("asks")))).otherwise(none)
    wide = both.withColumn("to", F.explode(F.concat(given, asking))).select("silo", "to.q", "to.t", "to.asks", "row_id", "x", F.when(~F.col("to.asks"), F.col("y")).alias("y"), "n")

    def tile(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("row_id")
        asks = t.column("asks").to_numpy()
        ids, x = t.column("row_id").to_numpy(), flat(t.column("x"))
        own, given = ids[asks], ids[~asks]
        empty = not len(own) or not len(given)
        out = []
        if not empty:
            most = int(np.unique(given, return_counts=True)[1].max())  # rows of one id are all a row's own
            asked, known = (unit(x[m]) if metric == "cosine" else x[m] for m in (asks, ~asks))
            for a, top, best in nearest(asked, known, k + most, metric=metric):
                keep = (best > -np.inf) & (given[top] != own[a : a + len(top), None])
                r, c = np.nonzero(keep & (keep.cumsum(1) <= k))
                out.append((r + a, top[r, c], best[r, c]))
        r, c, s = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, (int, int, float)[i]) for i in range(3))
        y = t.column("y").filter(pa.array(~asks)).take(pa.array(c))
        n = t.column("n").slice(0, 1).to_pylist() * len(r)
        return pa.table([pa.array([key[0].as_py()] * len(r), t.schema.field("silo").type), pa.array(own[r]), pa.array(given[c]), y, pa.array(s), pa.array(n, pa.int64())], names=["silo", "row_id", "nbr_id", "nbr_y", "sim", "n"])

    near = spread_out(wide, "silo", "q", "t").groupBy("silo", "q", "t").applyInArrow(tile, f"silo {kind}, row_id long, nbr_id long, nbr_y {rows.schema['y'].dataType.simpleString()}, sim double, n long")
    rank = F.row_number().over(W.partitionBy("silo", "row_id").orderBy(F.col("sim").desc(), "nbr_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).filter(F.col("rank") <= F.greatest(F.lit(1), F.col("n") - 1)).drop("n")


def label_counts(near: DataFrame) -> DataFrame:
    """(silo, row_id, l, c): of each row's neighbours, how many carry each label."""
    return near.select("silo", "row_id", F.posexplode("nbr_y").alias("l", "v")).groupBy("silo", "row_id", "l").agg(F.sum("v").alias("c"))


def priors(rows: DataFrame, smooth: float = SMOOTH) -> DataFrame:
    """(silo, l, n, pos, prior) of the training rows."""
    y = rows.filter("split = 'train'").select("silo", F.posexplode("y").alias("l", "v"))
    return y.groupBy("silo", "l").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("pos")).withColumn("prior", (smooth + F.col("pos")) / (2 * smooth + F.col("n")))


def conditionals(rows: DataFrame, k: int = K, smooth: float = SMOOTH, near: DataFrame | None = None) -> DataFrame:
    """(silo, l, c, prior, pt, pf): the odds of c neighbours with the label for rows that carry it and rows that don't, for every c up to k."""
    counts = label_counts(neighbours(rows, k) if near is None else near)
    own = rows.filter("split = 'train'").select("row_id", F.posexplode("y").alias("l", "v"))
    seen = counts.join(own, ["row_id", "l"]).groupBy("silo", "l", "c").agg(F.sum("v").alias("ct"), F.sum(1 - F.col("v")).alias("cf"))
    keff = F.greatest(F.lit(1), F.least(F.lit(k), F.col("n") - 1))
    spine = priors(rows, smooth).withColumn("k", keff).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("k"))))
    t = spine.join(seen, ["silo", "l", "c"], "left").fillna(0, ["ct", "cf"])
    pt = (smooth + F.col("ct")) / (smooth * (F.col("k") + 1) + F.col("pos"))
    pf = (smooth + F.col("cf")) / (smooth * (F.col("k") + 1) + F.col("n") - F.col("pos"))
    return t.select("silo", "l", "c", "prior", pt.alias("pt"), pf.alias("pf"))


def posteriors(rows: DataFrame, k: int = K, smooth: float = SMOOTH, of: str = "val") -> DataFrame:
    """(silo, row_id, l, p) for the rows of a split; 0.5 if neither side has odds."""
    counts = label_counts(neighbours(rows, k, of))
    j = counts.join(conditionals(rows, k, smooth), ["silo", "l", "c"])
    yes, no = F.col("prior") * F.col("pt"), (1 - F.col("prior")) * F.col("pf")
    return j.select("silo", "row_id", "l", F.when(yes + no > 0, yes / (yes + no)).otherwise(0.5).alias("p"))


def single_label(rows: DataFrame) -> DataFrame:
    """(silo, n, single): training rows, and whether there are several labels and every training row carries exactly one."""
    ones = F.aggregate("y", F.lit(0), lambda s, v: s + v)
    return rows.filter("split = 'train'").groupBy("silo").agg(F.count(F.lit(1)).alias("n"), ((F.max(F.size("y")) > 1) & F.bool_and(ones == 1)).alias("single"))


def predictions(rows: DataFrame, k: int = K, smooth: float = SMOOTH, threshold: float = THRESHOLD, of: str = "val") -> DataFrame:
    """(silo, row_id, l, p, pred): at least the threshold; in single-label silos the most probable label alone. Silos with fewer than 2 training rows have no predictions."""
    p = posteriors(rows, k, smooth, of).join(single_label(rows).filter("n > 1"), "silo")
    first = F.row_number().over(W.partitionBy("silo", "row_id").orderBy(F.round("p", 9).desc(), "l")) == 1
    return p.withColumn("first", first).select("silo", "row_id", "l", "p", F.when(F.col("single"), F.col("first")).otherwise(F.round("p", 9) >= threshold).cast("int").alias("pred"))


def counters(rows: DataFrame, predicted: DataFrame, of: str = "val") -> DataFrame:
    """(silo, l, tp, fp, fn) over a split: rows without a prediction (a silo with fewer than 2 training rows) predict nothing."""
    y = rows.filter(F.col("split") == of).select("silo", "row_id", F.posexplode("y").alias("l", "v"))
    j = y.join(predicted.select("silo", "row_id", "l", "pred"), ["silo", "row_id", "l"], "left").fillna(0, ["pred"])
    p, v = F.col("pred"), F.col("v")
    return j.groupBy("silo", "l").agg(F.sum(p * v).alias("tp"), F.sum(p * (1 - v)).alias("fp"), F.sum((1 - p) * v).alias("fn"))


def nothing_predicted(rows: DataFrame, of: str = "val") -> DataFrame:
    """Counters of an empty mask: all positives are missed."""
    y = rows.filter(F.col("split") == of).select("silo", F.posexplode("y").alias("l", "v"))
    zero = F.lit(0).cast("long")
    return y.groupBy("silo", "l").agg(F.sum("v").alias("fn")).select("silo", "l", zero.alias("tp"), zero.alias("fp"), "fn")


def mlknn(x: np.ndarray, y: np.ndarray, q: np.ndarray, k: int, smooth: float) -> np.ndarray:
    """Posteriors of the query rows, by the same rules as the relational path. The training rows are in ascending order of their ids."""

    def counts(a: np.ndarray, own: np.ndarray | None) -> np.ndarray:
        return sum((y[place] for place in nearest_places(a, xu, k, own).T), np.zeros((len(a), y.shape[1]), int))

    n, xu = len(x), unit(x)
    k = max(1, min(k, n - 1))
    own, seen = counts(xu, np.arange(n)), counts(unit(q), None)
    pos = y.sum(0)
    prior, p = (smooth + pos) / (2 * smooth + n), np.empty((len(q), y.shape[1]))
    for label in range(y.shape[1]):
        ct = np.bincount(own[y[:, label] == 1, label], minlength=k + 1)
        cf = np.bincount(own[y[:, label] == 0, label], minlength=k + 1)
        pt, pf = (smooth + ct) / (smooth * (k + 1) + pos[label]), (smooth + cf) / (smooth * (k + 1) + n - pos[label])
        yes, no = prior[label] * pt[seen[:, label]], (1 - prior[label]) * pf[seen[:, label]]
        p[:, label] = np.divide(yes, yes + no, out=np.full(len(q), 0.5), where=yes + no > 0)
    return p


@dataclass
class Dealt:
    """Rows dealt out in copies of their silos for batch_counters: rows has silo, copy (0 to copies - 1), copies and task besides; a task's rows are in one partition, in the order of silos and copies."""

    rows: DataFrame

    def of(self, silos: list) -> Dealt:
        return Dealt(self.rows.filter(F.col("silo").isin(silos)))


def hashed(i: np.ndarray) -> np.ndarray:
    """Spark's hash of ints that aren't negative (Murmur3 of four bytes, seed 42)."""
    turned = lambda v, n: (v << np.uint32(n)) | (v >> np.uint32(32 - n))
    h = turned(np.uint32(42) ^ (turned(i.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def in_partitions(n: int) -> list[int]:
    """For each of n partitions the least int that hashing puts there."""
    many = 16 * n
    while True:
        to, least = np.unique(hashed(np.arange(many)) % n, return_index=True)
        if len(to) == n:
            return least.tolist()
        many *= 4


def deal(rows: DataFrame, most: int | None = None, each: int = 4) -> Dealt:
    """Copies of the silos, of large ones more (up to most), about each for every core in all; every copy in a partition of its own, or if the silos are very many, about as much work in every partition. The work of a silo is the square of its rows."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    work = {r["silo"]: r["n"] ** 2 for r in rows.groupBy("silo").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a silo
    total = max(1, sum(work.values()))
    copies = {silo: max(1, min(most or 64, round(each * cores * w / total))) for silo, w in work.items()}
    pieces = sorted(((work[silo] / n, i, silo) for silo, n in copies.items() for i in range(n)), key=lambda p: -p[0])
    tasks = max(1, min(len(pieces), 4 * each * cores))
    name, load, given = in_partitions(tasks), [(0.0, i) for i in range(tasks)], []
    for w, i, silo in pieces:
        least, to = heapq.heappop(load)
        heapq.heappush(load, (least + w, to))
        given.append((silo, i, copies[silo], name[to]))
    kind = rows.schema["silo"].dataType.simpleString()
    table = spark.createDataFrame(given, f"to_silo {kind}, copy int, copies int, task int")
    wide = rows.join(F.broadcast(table), F.col("silo").eqNullSafe(F.col("to_silo"))).select("silo", "row_id", "split", "x", "y", "copy", "copies", "task")
    return Dealt(wide.repartition(tasks, "task").sortWithinPartitions("task", "silo", "copy", "copies"))


def batch_counters(rows: DataFrame | Dealt, masks: list[list[int]], k: int = K, smooth: float = SMOOTH, threshold: float = THRESHOLD) -> DataFrame:
    """(mask_id, silo, l, tp, fp, fn, n_val) for a batch of masks in one job. A task has a copy of a silo and its share of the masks, and makes the silo's similarities block by block; a silo must fit a Python worker here (neighbours() spreads one over tasks). Who evaluates batch after batch keeps the rows dealt."""
    dealt = rows if isinstance(rows, Dealt) else deal(rows, max(1, len(masks)))
    rows = dealt.rows
    held = rows.sparkSession.sparkContext.broadcast(sorted(enumerate(masks), key=lambda m: len(m[1])))  # so every share has small and large ones

    def run(key: tuple, t: pa.Table) -> pa.Table:
        _, silo, copy, copies = (x.as_py() for x in key)
        t = t.sort_by("row_id")
        train = t.column("split").to_numpy() == "train"
        x, y = flat(t.column("x")), flat(t.column("y"), int)
        xt, xv, yt, yv = x[train], x[~train], y[train], y[~train]
        single = y.shape[1] > 1 and len(yt) and bool((yt.sum(1) == 1).all())
        out = []
        for i, sel in held.value[copy::copies]:
            pred = np.zeros_like(yv)
            if sel and len(yt) > 1 and len(yv):
                p = np.round(mlknn(xt[:, sel], yt, xv[:, sel], k, smooth), 9)
                if single:
                    pred[np.arange(len(p)), p.argmax(1)] = 1
                else:
                    pred = (p >= threshold).astype(int)
            for label, (a, b) in enumerate(zip(pred.T, yv.T, strict=True)):
                out.append((i, silo, label, int((a & b).sum()), int((a & ~b & 1).sum()), int((~a & b & 1).sum()), len(yv)))
        cols = list(zip(*out, strict=True)) or [()] * 7
        types = (pa.int32(), t.schema.field("silo").type, pa.int32(), *[pa.int64()] * 4)
        return pa.table([pa.array(c, ty) for c, ty in zip(cols, types, strict=True)], names=["mask_id", "silo", "l", "tp", "fp", "fn", "n_val"])

    kind = rows.schema["silo"].dataType.simpleString()
    return rows.groupBy("task", "silo", "copy", "copies").applyInArrow(run, f"mask_id int, silo {kind}, l int, tp long, fp long, fn long, n_val long")


def fold_of(rows: DataFrame, folds: int) -> DataFrame:
    """Cross-validation folds inside each silo over all its rows, in the order of a portable hash: row i of n is in fold f if floor(f n / F) <= i < floor((f + 1) n / F). Small silos get fewer folds; under 4 rows only one split."""
    w = W.partitionBy("silo")
    n = F.count(F.lit(1)).over(w)
    i = F.row_number().over(w.orderBy(arithmetic_hash(F.col("row_id")), "row_id")) - 1
    t = rows.withColumn("n", n).withColumn("i", i)
    f = F.when(F.col("n") < 4, 1).when(F.col("n") < 2 * folds, F.greatest(F.lit(2), F.floor(F.col("n") / 2))).otherwise(folds)
    return t.withColumn("folds", f.cast("long")).withColumn("fold", F.call_function("div", (F.col("i") + 1) * F.col("folds") - 1, F.col("n")).cast("int")).drop("i", "n")


def silo_times(rows: DataFrame, masks: list[list[int]], k: int = K) -> DataFrame:
    """(silo, size, seconds): how long the kernel takes for these masks in each silo, measured where it runs. Feeds the scheduling replay."""
    held = rows.sparkSession.sparkContext.broadcast(masks)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        began = time.perf_counter()
        train = t.column("split").to_numpy() == "train"
        x, y = flat(t.column("x")), flat(t.column("y"), int)
        for sel in held.value:
            if sel and train.sum() > 1 and not train.all():
                mlknn(x[train][:, sel], y[train], x[~train][:, sel], k, SMOOTH)
        return pa.table({"silo": pa.array([key[0].as_py()], t.schema.field("silo").type), "size": pa.array([len(train)], pa.int64()), "seconds": [time.perf_counter() - began]})

    kind = rows.schema["silo"].dataType.simpleString()
    return rows.groupBy("silo").applyInArrow(run, f"silo {kind}, size long, seconds double")
