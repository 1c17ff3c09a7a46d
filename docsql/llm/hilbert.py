"""Most similar vectors for every vector, by shifted space-filling curves.

Vectors are scaled to unit length and rounded to 16 bits a number. Each of several orderings projects them with a random
rotation of its own, which leans towards the directions in which the vectors differ most, onto DIMS axes, shifts the grid
and takes the Hilbert index of the cell. Spark partitions each ordering by ranges of that index; within a range the vectors
lie along the curve, each is compared with those around it, and the best k of all orderings are merged and ranked. Axes and
range borders are fitted on a bounded sample (SAMPLE vectors); every vector is indexed.

Cells that hold more than a range's share are ordered by a curve of their own, through the differences of their members,
and cut into ranges by it. Vectors that are equal once rounded are one class, searched once: a class is known by its k + 1
smallest ids, which come before all others for its members. So no group of near or equal vectors, however large, comes
into one task, and the cost is linear. Windows end at the borders of ranges, which lie elsewhere in every ordering.

Defined results: vectors that are null, of another length, all zero, or hold a null, NaN or infinite number take no part;
rows with a null id are ignored; repeated rows of an id count once (if their vectors differ, the nearest counts); ties go
to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsql.runtime import cut
from docsql.runtime import spread as dealt

ORDERINGS = 10
DIMS, BITS = 10, 6
LEAN = 2.0  # the power of the variances by which rotations lean to the directions of most difference
WINDOW, BLOCK = 1024, 512
SAMPLE = 20_000
ROWS_A_RANGE = 150_000
SCALE = 32767.0


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index (uint64) of integer cells (n, dims), after Skilling's transform."""
    x = cells.astype(np.uint32).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint32(q - 1)
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p).astype(np.uint32)
            x[0] ^= np.where(up, p, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << np.uint64(1)) | ((x[i] >> b) & 1).astype(np.uint64)
    return key


def unit_rows(column: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors and their unit vectors."""
    ok = np.asarray(column.is_valid())
    offset = column.offsets.to_numpy()
    ok &= np.diff(offset) == dim
    values = column.values.cast(pa.float32()).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(ok)
    v = values[offset[:-1][at][:, None] + np.arange(dim)] if len(at) else np.zeros((0, dim), np.float32)
    v = v.astype(np.float64)
    good = np.isfinite(v).all(1) & (v != 0).any(1)
    v = v[good]
    v /= np.abs(v).max(1, keepdims=True, initial=0)  # so that squares of tiny or huge numbers stay in range
    return at[good], (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


class Curve:
    """One ordering: a rotation and a shift, the borders of its ranges, and finer curves for its dense cells."""

    def __init__(self, sample: np.ndarray, rng: np.random.Generator, ranges: int, depth: int = 3):
        dim = sample.shape[1]
        used = min(DIMS, dim)
        self.center = sample.mean(0)
        variance, axes = np.linalg.eigh(np.cov(sample.T) if len(sample) > 1 else np.eye(dim))
        variance = np.maximum(variance / max(variance.max(), 1e-12), 1e-6)
        turn = axes @ np.linalg.qr(variance[:, None] ** LEAN * rng.standard_normal((dim, used)) + 1e-9 * rng.standard_normal((dim, used)))[0]
        spread = np.maximum(((sample - self.center) @ turn).std(0), 1e-6)
        self.turn = (turn / spread).astype(np.float32)
        self.shift = ((rng.random(used) - 0.5) * 0.5).astype(np.float32)
        keys = np.sort(self.keys(sample))
        cells, first, count = np.unique(keys, return_index=True, return_counts=True)
        self.finer: dict[int, tuple[int, Curve]] = {}
        dense = np.flatnonzero((count * ranges >= 2 * len(keys)) & (count > 50)) if depth and ranges > 1 else []
        plain = np.setdiff1d(keys, cells[dense]) if len(dense) else keys
        self.borders = np.unique(plain[(np.arange(1, ranges) * len(plain)) // ranges]) if len(plain) else keys[:0]
        self.ranges = len(self.borders) + 1
        for i in dense:
            mine = self.keys(sample) == cells[i]
            inner = Curve(sample[mine], rng, max(2, round(count[i] * ranges / len(keys))), depth - 1)
            self.finer[int(cells[i])] = (self.ranges, inner)
            self.ranges += inner.ranges

    def keys(self, v: np.ndarray) -> np.ndarray:
        cells = np.floor(((v - self.center) @ self.turn + self.shift) * (1 << (BITS - 2))) + (1 << (BITS - 1))
        return hilbert_index(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64), BITS).astype(np.int64)

    def place(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(range, key) of each vector."""
        keys = self.keys(v)
        part = np.searchsorted(self.borders, keys, "right")
        for cell, (start, inner) in self.finer.items():
            at = np.flatnonzero(keys == cell)
            if len(at):
                p, keys[at] = inner.place(v[at])
                part[at] = start + p
        return part, keys


def best_in_windows(v: np.ndarray, ids: np.ndarray, asked: np.ndarray, k: int, least: float, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(id, neighbour, similarity) of the best k of each asked row among the rows around it."""
    out: list[tuple[np.ndarray, ...]] = []
    for b in range(0, len(v), BLOCK):
        rows = b + np.flatnonzero(asked[b : b + BLOCK])
        if not len(rows):
            continue
        lo, hi = max(0, b - window), min(len(v), b + BLOCK + window)
        sim = v[rows] @ v[lo:hi].T
        if least <= -1 and hi - lo > k + 1:
            near = np.argpartition(-sim, k, axis=1)[:, : k + 1]
            r, c = np.repeat(np.arange(len(rows)), k + 1), near.ravel()
        else:
            r, c = np.divmod(np.flatnonzero(sim.ravel() >= least), hi - lo)
        other = rows[r] != lo + c
        r, c = r[other], c[other]
        s, n = sim[r, c], ids[lo + c]
        order = np.lexsort((n, -s, r))
        r, s, n = r[order], s[order], n[order]
        top = np.arange(len(r)) - np.searchsorted(r, r) <= k  # one more: an id with two vectors meets itself
        out.append((ids[rows[r[top]]], n[top], s[top]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))


def _rounded(vectors: DataFrame, dim: int, asked: str) -> DataFrame:
    """id, asked, v (the unit vector in 16 bits a number) of the usable rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, v = unit_rows(b.column("embedding"), dim)
            q = np.ascontiguousarray(np.round(v * SCALE).astype(np.int16))
            packed = pa.Array.from_buffers(pa.binary(), len(q), [None, pa.py_buffer(np.arange(len(q) + 1, dtype=np.int32) * (2 * dim)), pa.py_buffer(q)])
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("asked").take(at), packed], ["id", "asked", "v"])

    base = vectors.where("id is not null and embedding is not null").select("id", "embedding", F.coalesce(F.expr(asked), F.lit(False)).alias("asked"))
    return dealt(base).mapInArrow(run, "id bigint, asked boolean, v binary")


def _vectors(packed: pa.Array, dim: int) -> np.ndarray:
    v = np.frombuffer(b"".join(packed.to_pylist()), np.int16).reshape(-1, dim).astype(np.float32)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def nearest(vectors: DataFrame, k: int = 5, dim: int = 64, least: float = -1.0, asked: str = "true", orderings: int = ORDERINGS, window: int = WINDOW) -> DataFrame:
    """(id, neighbour, similarity, rank): the k most similar other vectors of every vector for which `asked` holds.

    least: only neighbours of at least this similarity are wanted; the others are dropped before the merge.
    window: rows compared on both sides; the work is the number of asked rows times the window.
    """
    spark = vectors.sparkSession
    # a class is named by its smallest id
    rows = cut(_rounded(vectors, dim, asked), "p2-vectors")
    classes = cut(rows.groupBy("v").agg(F.min("id").alias("id"), F.bool_or("asked").alias("asked"), F.min("id").alias("least"), F.max("id").alias("most")), "p2-classes")
    many = classes.where("least < most").select("v", F.col("id").alias("first"))
    members = rows.join(many, "v").select("first", "id", "asked").groupBy("first", "id").agg(F.bool_or("asked").alias("asked"))
    members = cut(members, "p2-members")
    total = classes.count()
    ranges = max(1, -(-total // ROWS_A_RANGE), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // orderings))
    # bounded fit: SAMPLE vectors at the most, whatever the table's size
    sample = classes.select("v").sample(min(1.0, SAMPLE / max(1, total)), seed=7).limit(2 * SAMPLE).toArrow().column("v").combine_chunks()
    fitted = _vectors(sample, dim) if len(sample) else np.eye(dim, dtype=np.float32)
    rng = np.random.default_rng(7)
    curves = [Curve(fitted, rng, ranges) for _ in range(orderings)]
    starts = np.cumsum([0, *(c.ranges for c in curves)])
    shared = spark.sparkContext.broadcast((curves, starts))  # orderings * dim * DIMS numbers and the borders

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curves, starts = shared.value
        for b in batches:
            v = _vectors(b.column("v"), dim)
            for start, curve in zip(starts, curves):
                part, key = curve.place(v)
                yield pa.RecordBatch.from_arrays([pa.array((start + part).astype(np.int32)), pa.array(key), b.column("id"), b.column("asked"), b.column("v")], ["part", "key", "id", "asked", "v"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task holds its range: ROWS_A_RANGE rows, or what a sample of that share may be off by
        held = [(b.column("part").to_numpy(), b.column("id").to_numpy(), np.asarray(b.column("asked")), np.frombuffer(b"".join(b.column("v").to_pylist()), np.int16).reshape(-1, dim)) for b in batches if b.num_rows]
        if not held:
            return
        part, ids, want, q = (np.concatenate(x) for x in zip(*held))
        del held
        edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        for a, z in zip(edge[:-1], edge[1:]):
            v = q[a:z].astype(np.float32)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            i, n, s = best_in_windows(v, ids[a:z], want[a:z], k, least, window)
            for x in range(0, len(i), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(i[x : x + 50_000]), pa.array(n[x : x + 50_000]), pa.array(s[x : x + 50_000])], ["id", "neighbour", "similarity"])

    laid = classes.select("id", "asked", "v").mapInArrow(spread, "part int, key bigint, id bigint, asked boolean, v binary")
    laid = laid.repartitionById(int(starts[-1]), F.col("part")).sortWithinPartitions("part", "key", F.xxhash64("id", "part"))
    found = laid.mapInArrow(windows, "id bigint, neighbour bigint, similarity float")
    by_rank = lambda key: Window.partitionBy(key).orderBy(F.desc("similarity"), "neighbour")
    best = found.groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
    # classes are unfolded to the ids that can be among the best: k + 1 of a class, and every asked one
    few = members.withColumn("n", F.row_number().over(Window.partitionBy("first").orderBy("id"))).where(F.col("n") <= k + 1)
    few = few.groupBy("first").agg(F.collect_list("id").alias("ids"))
    own = members.select("first").distinct().select(F.col("first").alias("id"), F.col("first").alias("neighbour"), F.lit(1.0).cast("float").alias("similarity"))
    top = best.withColumn("n", F.row_number().over(by_rank("id"))).where(F.col("n") <= k + 1).drop("n").unionByName(own)
    wide = top.join(few.withColumnRenamed("first", "neighbour"), "neighbour", "left").select("id", "similarity", F.explode(F.coalesce("ids", F.array("neighbour"))).alias("neighbour"))
    # k + 1 ids serve all members of a class, as each leaves out itself only
    wide = wide.groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
    wide = wide.withColumn("n", F.row_number().over(by_rank("id"))).where(F.col("n") <= k + 1).drop("n")
    alone = wide.join(members.select(F.col("first").alias("id")).distinct(), "id", "left_anti")
    # the members of a hot class are many rows of one key on one side of an inner join, which Spark splits
    each = members.where("asked").select("first", F.col("id").alias("one")).join(wide.withColumnRenamed("id", "first"), "first").select(F.col("one").alias("id"), "neighbour", "similarity")
    every = alone.unionByName(each).where("id <> neighbour").groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))  # ids with several vectors
    return every.withColumn("rank", F.row_number().over(by_rank("id"))).where(F.col("rank") <= k)


def similar_pairs(vectors: DataFrame, k: int = 5, dim: int = 64, least: float = 0.88) -> DataFrame:
    """(id_a, id_b): pairs, smaller id first, one of which is among the k nearest of the other with at least that similarity."""
    found = nearest(vectors, k, dim, least)
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
