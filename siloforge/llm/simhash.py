"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's signature is one or more 64-bit SimHash words over its word shingles. Texts of equal signature are one class.
Classes whose signatures differ in at most tau bits are found for sure: the bits are grouped into partitions,
correlated bits together (their joint counts are taken over all classes), and each partition i gets a threshold
t_i of at least -1 (never probed), with sum(t_i) = tau - partitions + 1, by dynamic programming on the estimated
counts of rows and candidates; so is the number of partitions chosen. Two signatures within tau bits are within t_i bits in some partition i. Each class puts its value of
the partition into that bucket, and probes the greater values within t_i bits. Candidates that meet in a bucket
are verified on the whole signature. Of a bucket's links a task gives a spanning forest, not all pairs; a bucket with
more than TILE classes is dealt out as pairs of tiles. Components of the links are found in Spark.

dedup() takes the signatures' components as candidates only: inside each, texts are linked whose sets of shingles have
the wanted Jaccard similarity, counted exactly on the shingles' hashes, and the components of these links are the groups.
Candidate components of more than SETS texts, or SHINGLES shingles, are dealt out as pairs of tiles; a task's links
are a spanning forest here too. Texts of equal sets are one node. While at most BROADCAST_KEYS documents go, their keys are
broadcast and no text is shuffled; beyond that the documents are dealt out by key once.

Words are runs of anything but white space ([\\x20\\x09-\\x0D]), A-Z lower-cased. A text of fewer words than a
shingle is one shingle; a null text, or one without words, has signature zero and is linked like any other.
Repeated rows fall into one class. Other columns are ignored, or kept by dedup(), whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siloforge.llm.components import components
from siloforge.llm.words import ODD, mix, slices
from siloforge.llm.xxh64 import hashes
from siloforge.session import arrow_limits, cut, discard, table

LOWERED = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEED, PIECE, CHUNK, TILE, CELLS = 42, 1 << 19, 1 << 16, 16384, 1 << 20
ROW_COST, PAIR_COST, MOST, SMALL = 3000.0, 10.0, 4, 64
SETS, SHINGLES, BROADCAST_KEYS = 512, 1 << 20, 1 << 19


def pieces(text: bytes, shingle: int) -> Iterator[bytes]:
    """A text's words, lower-cased and joined by one space, in pieces that share shingle - 1 words."""
    at, carried = 0, b""
    while at < len(text):
        stop = at + PIECE
        while stop < len(text) and not text[stop : stop + 1].isspace():
            stop += 1
        own = (carried + b" " + text[at:stop]).translate(LOWERED).split()
        at = stop
        if len(own) >= shingle or at >= len(text):
            yield b" ".join(own)
            own = own[max(0, len(own) - shingle + 1) :]
        carried = b" ".join(own)


def hashed(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the shingles of texts whose words are joined by one space, and where each text's begin (and the end)."""
    n = np.array([x.count(b" ") + 1 if x else 0 for x in texts], np.int64)
    joined = b" ".join(x for x in texts if x)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends, first = np.concatenate([[0], gaps + 1]), np.append(gaps, len(joined)), np.concatenate([[0], np.cumsum(n)])
    each = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    begin = np.concatenate([[0], np.cumsum(each)])
    word = np.repeat(first[:-1] - begin[:-1], each) + np.arange(begin[-1])
    last = np.minimum(word + shingle, np.repeat(first[1:], each)) - 1
    return hashes(joined, starts[word], ends[last], SEED), begin


def shingle_hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """The 64-bit hashes of a text's shingles, in chunks."""
    for x in pieces(text, shingle):
        if x:
            yield hashed([x], shingle)[0]


def bit_counts(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in each text's hashes. Eight counters of a byte are added at a time, over at most 255 hashes."""
    out, size = np.zeros((len(begin) - 1, 64), np.int64), np.diff(begin)
    some = np.flatnonzero(size)
    if len(some):
        runs = -(-size[some] // 255)
        first = np.concatenate([[0], np.cumsum(runs)])
        at = np.repeat(begin[some] - 255 * first[:-1], runs) + 255 * np.arange(first[-1])
        bits = np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        parts = np.add.reduceat(bits, at, axis=0).view(np.uint8).reshape(-1, 64)
        out[some] = np.add.reduceat(parts, first[:-1], axis=0, dtype=np.int64)
    return out


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """A text's different shingle hashes, ascending."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *map(np.unique, shingle_hashes(text, shingle))]))


def word_counts(h: np.ndarray, begin: np.ndarray, words: int) -> np.ndarray:
    """bit_counts() for each word of a signature: of the hashes, and of further ones made from them."""
    with np.errstate(over="ignore"):
        return np.stack([bit_counts(mix(h + np.uint64(w * ODD & (1 << 64) - 1)) if w else h, begin) for w in range(words)], axis=1)


def sketches(texts: list[bytes], shingle: int, words: int, repeats: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each text's signature, a row of words; and without repeats, its set of shingles, which the signature is over then. Many short texts are hashed at once, a long one piece by piece."""
    off = np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)])
    out, sets = np.zeros((len(texts), words), np.int64), []
    for a, b in slices(off, PIECE):
        if off[b] - off[a] > PIECE:
            chunks = shingle_hashes(texts[a], shingle)
            if not repeats:
                sets.append(shingle_set(texts[a], shingle))
                chunks = (sets[-1][i : i + CHUNK] for i in range(0, len(sets[-1]), CHUNK))
            counts, total = np.zeros((1, words, 64), np.int64), 0
            for h in chunks:
                counts += word_counts(h, np.array([0, len(h)]), words)
                total += len(h)
            total = np.array([total])
        else:
            h, begin = hashed([b" ".join(x.translate(LOWERED).split()) for x in texts[a:b]], shingle)
            if not repeats:
                own = [np.unique(h[s:e]) for s, e in itertools.pairwise(begin.tolist())]
                sets += own
                h, begin = np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])
            counts, total = word_counts(h, begin, words), np.diff(begin)
        out[a:b] = np.packbits(counts * 2 > total[:, None, None], axis=2, bitorder="little").view("<i8")[:, :, 0]
    return out, sets


def names(words: int) -> list[str]:
    return [f"w{i}" for i in range(words)]


def key_of(docs: DataFrame) -> Column:
    """A document's key: 128 bits of its id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("null")), F.when(docs["text"].isNull(), "-").otherwise(":"), F.coalesce(docs["text"], F.lit("")))))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key_of(docs).alias("key"))


def signatures(docs: DataFrame, shingle: int, words: int = 1, repeats: bool = True) -> DataFrame:
    """(doc_id, w0, ..., node): a signature per document. node: names the signature. Without repeats there is the document's key too, and the signature is over the set of shingles, which node names then, and size counts."""
    arrow_limits(docs.sparkSession)
    given = ["doc_id"] if repeats else ["doc_id", "key"]
    fields = [*given, *names(words), *([] if repeats else ["node", "size"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, sets = sketches([x.as_py() or b"" for x in batch.column("text").cast(pa.large_binary())], shingle, words, repeats)
            cols = [*sigs.T]
            if not repeats:
                cols += [np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64), np.array([len(x) for x in sets], np.int64)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in given), *(pa.array(np.ascontiguousarray(c)) for c in cols)], names=fields)

    out = keyed(docs).select(*given, "text").mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'key' else 'long'}" for c in fields))
    return out.withColumn("node", F.col("w0") if words == 1 else F.xxhash64(*names(words))) if repeats else out


def joint_counts(classes: DataFrame, words: int) -> tuple[int, np.ndarray]:
    """The number of classes, and how many have bits i and j set: sums of one small matrix a task."""
    n_bits = 64 * words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros((n_bits, n_bits))
        for batch in batches:
            n += batch.num_rows
            bits = np.unpackbits(signature_array(batch, words).view(np.uint8), axis=1, bitorder="little").astype(np.float32)
            sums += bits.T @ bits
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, n_bits**2)), pa.array(np.concatenate([[n], sums.ravel()]).astype(np.int64))], names=["at", "n"])

    got = classes.select(*names(words)).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n")).collect()  # 4,096 rows for one word, 65,536 for four
    sums, n = np.zeros(n_bits**2), 0
    for at, x in got:
        if at < 0:
            n = x
        else:
            sums[at] = x
    return n, sums.reshape(n_bits, n_bits)


def signature_array(batch: pa.RecordBatch, words: int) -> np.ndarray:
    """(rows, words) of a batch with the columns w0, w1, ..."""
    return np.stack([batch.column(c).to_numpy().view(np.uint64) for c in names(words)], axis=1)


def grouped(n: int, both: np.ndarray, parts: int, turn: int = 0) -> list[list[int]]:
    """The bits in so many groups of about equal size; each group grows by the bit that its members correlate with most. Further turns group them by chance."""
    total = len(both)
    sizes = [total // parts + (g < total % parts) for g in range(parts)]
    if turn:
        return [x.tolist() for x in np.split(np.random.default_rng(turn).permutation(total), np.cumsum(sizes)[:-1])]
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, out = np.ones(total, bool), []
    for size in sizes:
        own: list[int] = []
        tie = corr[:, free].sum(1)
        while len(own) < size:
            own.append(int(np.argmax(np.where(free, tie, -1.0))))
            free[own[-1]] = False
            tie = corr[:, own].sum(1)
        out.append(own)
    return out


def near(n: int, both: np.ndarray, bits: list[int]) -> np.ndarray:
    """Estimated chance that two classes differ in 0, 1, ... of these bits: from each bit's odds, scaled by how much more often neighbouring bits agree together than they would apart."""
    p = np.diag(both) / max(n, 1)
    agree = p**2 + (1 - p) ** 2
    scale = 1.0
    for a, b in zip(bits, bits[1:], strict=False):
        x = both[a, b] / max(n, 1)
        cells = np.array([x, p[a] - x, p[b] - x, 1 - p[a] - p[b] + x])
        scale *= max(float((cells**2).sum()), 1e-9) / max(agree[a] * agree[b], 1e-9)
    chance = np.zeros(len(bits) + 1)
    chance[0] = 1
    for b in bits:
        chance[1:] = chance[1:] * agree[b] + chance[:-1] * (1 - agree[b])
        chance[0] *= agree[b]
    return np.minimum(chance * min(scale, 1 / max(chance[0], 1e-12)), 1)


def allotted(n: int, both: np.ndarray, tau: int, parts: int, turn: int = 0) -> tuple[float, list[tuple[list[int], int]]]:
    """The estimated cost and [(bits, threshold)] of least cost among all thresholds that the principle allows for so many partitions. Never-probed partitions are left out. The cost is infinite if no thresholds up to MOST do."""
    total, groups = tau - parts + 1, grouped(n, both, parts, turn)
    table_: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits in groups:
        chance, new = np.cumsum(near(n, both, bits)), {}
        for spent, (cost, chosen) in table_.items():
            for t in range(-1, min(tau, len(bits), MOST) + 1):
                rows = n * (1 + sum(math.comb(len(bits), x) for x in range(1, t + 1)) / 2) if t >= 0 else 0
                own = cost + ROW_COST * rows + (PAIR_COST * n * n / 2 * chance[t] if t >= 0 else 0)
                if spent + t not in new or own < new[spent + t][0]:
                    new[spent + t] = (own, [*chosen, t])
        table_ = new
    if total not in table_:
        return math.inf, []
    return table_[total][0], [(b, t) for b, t in zip(groups, table_[total][1], strict=True) if t >= 0]


def planned(n: int, both: np.ndarray, tau: int, turns: int = 1) -> list[tuple[list[int], int]]:
    """The plan of least estimated cost with any number of partitions: the more classes, the fewer and wider, so that candidates a class grow far more slowly than the classes. Further turns do the same with other groups of as many partitions."""
    parts = min(range(max(1, tau // 3), tau + 2), key=lambda parts: allotted(n, both, tau, parts)[0])
    return [x for turn in range(turns) for x in allotted(n, both, tau, parts, turn)[1]]


def project(x: np.ndarray, bits: list[int]) -> np.ndarray:
    """These bits of signatures (rows, words), as one number; mixed if they are more than 32."""
    out = np.zeros(len(x), np.uint64)
    for k, b in enumerate(bits):
        out |= ((x[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)) << np.uint64(k)
    return out


def bucket(part: int, bits: list[int], value: np.ndarray) -> np.ndarray:
    return (np.uint64(part << 40) ^ (mix(value) if len(bits) > 40 else value)).astype(np.int64)


def bucketed(classes: DataFrame, words: int, plan: list[tuple[list[int], int]], probes: bool = True) -> DataFrame:
    """(bucket, probe, node, w0, ...): each class in its buckets, and as a probe in the buckets of greater values nearby."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            carried, x = [batch.column(c) for c in ("node", *names(words))], signature_array(batch, words)
            for part, (bits, t) in enumerate(plan):
                v = project(x, bits)
                flips = [0, *(sum(1 << b for b in c) for r in range(1, t + 1) for c in combinations(range(len(bits)), r))]
                for mask in flips if probes else [0]:
                    to = v ^ np.uint64(mask)
                    rows = np.flatnonzero(to > v) if mask else np.arange(len(v))
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket(part, bits, to[rows])), pa.array(np.full(len(rows), bool(mask))), *(c.take(take) if mask else c for c in carried)], names=["bucket", "probe", "node", *names(words)]
                    )

    return classes.select("node", *names(words)).mapInArrow(run, "bucket long, probe boolean, node long, " + ", ".join(f"{c} long" for c in names(words)))


def crowded(classes: DataFrame, words: int, plan: list[tuple[list[int], int]], most: int) -> DataFrame | None:
    """(bucket, count) of the buckets with more than most home classes. Such a bucket has more than its even share in some task; only buckets that have are counted over all."""
    share = most // max(1, classes.rdd.getNumPartitions())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = [signature_array(batch, words) for batch in batches]
        if x:
            x = np.concatenate(x)
            for part, (bits, _) in enumerate(plan):
                found, n = np.unique(bucket(part, bits, project(x, bits)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found[n > share])], names=["bucket"])

    some = cut(classes.select(*names(words)).mapInArrow(run, "bucket long").distinct(), "crowded")
    if some.isEmpty():
        discard(some)
        return None
    homes = bucketed(classes, words, plan, probes=False).select("bucket").join(some, "bucket", "left_semi")
    out = cut(homes.groupBy("bucket").count().filter(F.col("count") > most), "hot")
    discard(some)
    return out


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int16)


def forest(sig: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (as positions) that connect whatever signatures are within most bits of each other, directly or in steps: each new member looks only at those not reached yet."""
    out, left = [], np.arange(len(sig))
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            hit = distance(sig[x], sig[left]) <= most
            if hit.any():
                got = left[hit]
                out.append((np.full(len(got), x), got))
                todo.extend(got.tolist())
                left = left[~hit]
    return out


def links_of(home: np.ndarray, probe: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links among a bucket's classes, and of its probes to them; positions of probes follow those of the home classes."""
    c, out = len(home), []
    step = max(1, CELLS // max(c, 1))
    everything = np.concatenate([home, probe])
    for a in range(0, len(everything), step):
        rows = everything[a : a + step]
        x, y = np.nonzero(distance(rows[:, None, :], home[None, :, :]) <= most)
        ok = y < x + a
        x, y = x[ok] + a, y[ok]
        if len(x) > 4 * (len(rows) + c):
            return forest(everything, most)
        out.append((x, y))
    return out


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as connect what these connect: from each node to the least that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        m = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, x, m)
        np.minimum.at(new, y, m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    some = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[some], nodes[low[some]]


def linked(batches: Iterator[pa.RecordBatch], words: int, most: int) -> Iterator[pa.RecordBatch]:
    """Links of rows that come sorted by bucket, tile and probe. Whole buckets are handled as they end; a bucket that outgrows memory's share goes through in parts, each with all its home classes."""
    held: list[np.ndarray] = []
    rows = 0

    def load(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("bucket", "tile", "probe", "node", *names(words))], axis=1)

    def solve(x: np.ndarray) -> pa.RecordBatch | None:
        ends = np.flatnonzero(np.concatenate([(x[1:, :2] != x[:-1, :2]).any(1), [True]])) + 1
        starts = np.concatenate([[0], ends[:-1]])
        size = ends - starts
        many = size > SMALL
        a_, b_ = [], []
        sig, home_, node = np.ascontiguousarray(x[:, 4:]).view(np.uint64), x[:, 2] == 0, x[:, 3]
        end, step = np.repeat(ends, size), 1
        at = np.flatnonzero(home_ & np.repeat(~many, size))
        while len(at := at[at + step < end[at]]):  # small buckets all at once: each home class with the one so many rows after it
            hit = at[distance(sig[at], sig[at + step]) <= most]
            a_.append(node[hit])
            b_.append(node[hit + step])
            step += 1
        for s, e in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
            c = int(home_[s:e].sum())
            if c:
                for p, q in links_of(sig[s : s + c], sig[s + c : e], most):
                    a_.append(node[s + p])
                    b_.append(node[s + q])
        if a_ and len(a := np.concatenate(a_)):
            x, y = spanning(a, np.concatenate(b_))
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
        return None

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(load(batch))
        rows += batch.num_rows
        if rows < 4 * TILE:
            continue
        x = np.concatenate(held)
        last = int(np.flatnonzero((x[:, :2] != x[-1, :2]).any(1))[-1]) + 1 if (x[0, :2] != x[-1, :2]).any() else 0
        if last:
            if (found := solve(x[:last])) is not None:
                yield found
            x = x[last:]
        if len(x) >= 4 * TILE:
            if (found := solve(x)) is not None:
                yield found
            x = x[x[:, 2] == 0]
        held, rows = [x], len(x)
    if rows and (found := solve(np.concatenate(held))) is not None:
        yield found


def links(classes: DataFrame, words: int, tau: int, most: int, turns: int = 1) -> DataFrame:
    """(a, b): links between nodes that connect the same classes as all pairs within tau bits, and pairs within most bits that meet in a bucket. Each turn groups the bits anew and gives pairs beyond tau another chance."""
    n, both = joint_counts(classes, words)
    plan = planned(n, both, tau, turns)
    rows, hot = bucketed(classes, words, plan), crowded(classes, words, plan, TILE)
    if hot is None:
        rows = rows.withColumn("tile", F.lit(0))
    else:
        tiles = hot.select("bucket", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
        k, own = F.coalesce("tiles", F.lit(1)), F.pmod(F.xxhash64("node"), F.coalesce("tiles", F.lit(1))).cast("int")
        met = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.when(F.col("probe"), j * k + j).otherwise(F.least(own, j) * k + F.greatest(own, j)))
        rows = rows.join(tiles, "bucket", "left").withColumn("tile", F.explode(met)).drop("tiles")
    order = ["bucket", "tile", "probe", "node", *names(words)]
    rows = rows.select(*order).repartition("bucket", "tile").sortWithinPartitions("bucket", "tile", "probe")
    out = cut(rows.mapInArrow(lambda batches: linked(batches, words, most), "a long, b long").distinct(), "links")
    if hot is not None:
        discard(hot)
    return out


def components_of(sigs: DataFrame, words: int, tau: int, most: int) -> DataFrame:
    """(node, component): for every signature, the component it belongs to."""
    classes = cut(sigs.groupBy("node", *names(words)).agg(F.count(F.lit(1)).alias("n")), "classes")
    edges = links(classes, words, tau, most)
    found = components(edges)
    discard(edges)
    return classes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = 3, tau: int = 2, repeats: bool = True) -> DataFrame:
    """Per document: doc_id, fingerprint (w0), component_id: the smallest doc_id reachable over links of at most tau bits, null if all are null."""
    sigs = cut(signatures(docs, shingle, 1, repeats), "signatures")
    comps = cut(components_of(sigs, 1, tau, tau), "components")
    least = sigs.groupBy("node").agg(F.min("doc_id").alias("low")).join(comps, "node").groupBy("component").agg(F.min("low").alias("component_id"))
    names_ = cut(comps.join(least, "component").select("node", "component_id"), "names")
    return sigs.join(names_, "node").select("doc_id", F.col("w0").alias("fingerprint"), "component_id")


def estimated_bits(similarity: float, words: int, slack: float = 3.5) -> int:
    """Differing bits of a signature that texts of this Jaccard similarity stay within: the expected angle, and so many standard deviations."""
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * words
    return int(bits * apart + slack * math.sqrt(bits * apart * (1 - apart)))


def similar(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (as positions) that connect whatever sets have this Jaccard similarity or more, directly or in steps. If there are two sides, only sets of different sides are compared.

    Two such sets share one of the rarest elements of either, so many that the rest alone couldn't make them similar (elements that few of these sets have count as rare). Those are posted by element; a set is compared with what it meets there and what isn't reached yet.
    """
    size = np.array([len(x) for x in sets], np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner, often = np.repeat(np.arange(len(sets)), size), np.bincount(ids)
    order = np.lexsort((ids, often[ids], owner))  # each set's elements, rarest first
    first = (np.arange(len(ids)) - begin[owner]) < (size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1)[owner]
    rare, whose = ids[order[first]], owner[first]
    mine = np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=len(sets)))])
    by = np.argsort(rare, kind="stable")
    posted, start = whose[by], np.searchsorted(rare[by], np.arange(len(often) + 1))
    held, two, out, free = np.zeros(len(often), bool), side.min() != side.max(), [], np.ones(len(sets), bool)
    for root in range(len(sets)):
        if not free[root]:
            continue
        todo, free[root] = [root], False
        while todo:
            x = todo.pop()
            own = rare[mine[x] : mine[x + 1]]
            n = start[own + 1] - start[own]
            met = np.unique(posted[np.repeat(start[own] - np.cumsum(n) + n, n) + np.arange(n.sum())])
            met = met[free[met] & (np.minimum(size[met], size[x]) >= similarity * np.maximum(size[met], size[x]) - 1e-9)]
            if two:
                met = met[side[met] != side[x]]
            if not len(met):
                continue
            held[ids[begin[x] : begin[x + 1]]] = True
            both = np.array([np.count_nonzero(held[ids[begin[y] : begin[y + 1]]]) for y in met.tolist()], np.int64)
            held[ids[begin[x] : begin[x + 1]]] = False
            got = met[both >= similarity * (size[met] + size[x] - both) - 1e-9]
            free[got] = False
            out.extend((x, y) for y in got.tolist())
            todo.extend(got.tolist())
    return out


def verified(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of sets that come sorted by component, unit, side and node. A unit is held at a time."""
    now, held = None, []

    def solve() -> Iterator[pa.RecordBatch]:
        node, side, sets = zip(*held, strict=True)
        if found := similar([np.frombuffer(x, np.uint64) for x in sets], np.array(side), similarity):
            yield pa.RecordBatch.from_arrays([pa.array([node[x] for x, _ in found], pa.int64()), pa.array([node[y] for _, y in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        for component, unit, side, node, x in zip(*(batch.column(c).to_pylist() for c in ("component", "unit", "side", "node", "shingles")), strict=True):
            if (component, unit) != now:
                if len(held) > 1:
                    yield from solve()
                now, held = (component, unit), []
            if not held or held[-1][0] != node:  # a node may come twice, from rows equal in id and text
                held.append((node, side, x))
    if len(held) > 1:
        yield from solve()


def exact_links(docs: DataFrame, classes: DataFrame, candidates: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): links that connect the same nodes as all pairs of one candidate component (node, component) whose sets of shingles have this Jaccard similarity or more."""
    texts = cut(classes.join(candidates, "node").select("node", "component", "key", "size"), "texts")
    tiles = texts.groupBy("component").agg(F.ceil(F.greatest(F.count(F.lit(1)) / SETS, F.sum("size") / SHINGLES, F.lit(1))).cast("int").alias("tiles"))
    wanted = cut(texts.join(tiles, "component").select("key", "node", "component", "tiles"), "wanted")
    discard(texts)
    keys = cut(wanted.select("key"), "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py() or b"", shingle).tobytes() for x in batch.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sets, pa.binary())], names=["key", "shingles"])

    sets = keyed(docs).select("key", "text").join(keys, "key", "left_semi").mapInArrow(run, "key binary, shingles binary")
    own, k = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"), F.col("tiles")
    met = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.struct((F.least(own, j) * k + F.greatest(own, j)).alias("unit"), (own > j).cast("int").alias("side")))
    rows = sets.join(wanted, "key").select("component", "node", F.explode(met).alias("met"), "shingles").select("component", "met.unit", "met.side", "node", "shingles")
    rows = rows.repartition("component", "unit").sortWithinPartitions("component", "unit", "side", "node")
    out = cut(rows.mapInArrow(lambda batches: verified(batches, similarity), "a long, b long").distinct(), "links")
    for x in (keys, wanted):
        discard(x)
    return out


def dedup(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, words: int = 4, tau: int = 15, turns: int = 5) -> DataFrame:
    """One document of each group of near-duplicates, with all its columns: the one of smallest doc_id (then, of smallest hash). Texts are near-duplicates if their sets of shingles have this Jaccard similarity or more; they are looked for among texts whose signatures of 64 * words bits are about as close as that makes likely."""
    sigs = cut(signatures(docs, shingle, words, repeats=False), "signatures")
    classes = cut(sigs.groupBy("node", *names(words)).agg(F.min("key").alias("key"), F.min("size").alias("size")), "classes")
    near = links(classes, words, tau, estimated_bits(similarity, words), turns)
    candidates = components(near)
    exact = exact_links(docs, classes, candidates, shingle, similarity)
    found = components(exact)
    comps = classes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    rows = cut(sigs.select("doc_id", "key", "node").join(comps, "node").select("component", "doc_id", "key"), "groups")
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    kept = cut(rows.groupBy("component").agg(F.min(first).alias("kept")).select("component", F.col("kept.key").alias("kept")), "kept")  # so that a hot component's side of the next join can be split
    verdict = rows.join(kept, "component").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("key") == F.col("kept")).cast("int")).alias("keep"))
    verdict = cut(verdict.filter("keep = 0 OR n > 1"), "verdict")
    for x in (sigs, classes, near, candidates, exact, found, rows, kept):
        discard(x)
    some = verdict.agg(F.count(F.lit(1)), F.max("keep")).first()
    told = verdict.select(F.col("key").alias("__sf_gone"), F.col("keep").alias("__sf_keep"))
    told = F.broadcast(told) if some[0] <= BROADCAST_KEYS else told
    both = docs.withColumn("__sf_key", key_of(docs)).join(told, F.col("__sf_key") == F.col("__sf_gone"), "left")
    left = both.filter("__sf_gone IS NULL")
    if some[1]:  # rows equal in id and text: one of them
        left = left.unionByName(both.filter("__sf_keep = 1").dropDuplicates(["__sf_key"]))
    return left.drop("__sf_key", "__sf_gone", "__sf_keep")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
