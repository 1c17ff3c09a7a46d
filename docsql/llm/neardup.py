"""Near-duplicate records: an exact join in the metric space of Jaccard distance between sets of word triples.

Pivots are the singleton sets of triples. A record lies at distance 1 - 1/|x| from the pivots it contains and at 1 from
all others, so its region is that of its rarest triple (ties by hash). Two records within distance 1 - t overlap so far
that they share a pivot among the nearest |x| - ceil(t|x|) + 1 of each (|x| - ceil(2t/(1+t)|x|) + 1 for the smaller one);
that window is what replicates boundary records, so no pair is lost. Within a region pairs are ruled out by size, by the
places of the pivot, and by the triangle inequality on bit sketches (each triple flips a bit, so the sketches of two
records differ in no more bits than the records in triples). Regions of frequent pivots are split into blocks whose pairs
are joined apart. Large records are joined in slices of their triples by hash: of two records as similar as t, the parts in
some slice are as similar, too, so each slice is a join of its own of small sets, for which the sketches are sharp. Pairs
that remain are verified on the whole sets.

Rarity comes from a frequency table over all records: counts by hash bucket, a byte each, exact up to 31 and in steps of
an eighth of a power of two beyond. It has twice as many buckets as there are triples, LEAST_BITS to MOST_BITS bits (64 MB at
the most), so a triple that stands in one record is mostly known as such and replicates nothing. For more than CROWDED
triples a bucket it would tell nothing; then triples are counted exactly, by an aggregate, and the counts of those in two
records or more are joined to the records. Frequencies decide only how much work there is, never which pairs come out.

Defined results: a null title or content is empty; a record of fewer than three words resembles nothing; repeated rows
of an id count once (the one received last); rows with a null id are ignored; equal sets are one class, searched once; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsql.runtime import cut, drop_path, one_per_key

LEAST_BITS, MOST_BITS = 16, 26
SLICES = 16
CROWDED = 16  # triples a bucket, at the largest size of the table, beyond which triples are counted one by one
COUNTED = 4_000_000  # triples a task counts before it hands the counts on
SKETCH_WORDS = 8
HOT, BLOCK = 4096, 2048
SLICE_SIZE = 320  # records of more triples are joined in slices: two for up to twice as many, and so on
COPIES_IN_PAIRS = 1000  # a class of more equal sets stands in pairs by its first member, with which each of the others is paired

_words = re.compile(r"[^\W_]+").findall
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class Shingler:
    """Word triples of a text as sorted distinct 64-bit hashes."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = _words(text.lower())
        if len(words) < 3:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        t = h[:-2] * _K[0] ^ (h[1:-1] * _K[1] + (h[:-2] >> np.uint64(31))) ^ (h[2:] * _K[2] + (h[1:-1] >> np.uint64(17)))
        t ^= t >> np.uint64(30)
        t *= _K[1]
        return np.unique(t ^ (t >> np.uint64(29)))


def record_sets(records: DataFrame, parts: list[str]) -> DataFrame:
    """id, n, key (hash of the set), elements (binary, sorted uint64) of records whose parts are joined by line breaks."""
    text = F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for b in batches:
            for k in range(0, b.num_rows, 500):
                s = b.slice(k, 500)
                sets = [shingles(t) for t in s.column("text").to_pylist()]
                keys = [xxhash.xxh64_intdigest(x) - (1 << 63) for x in sets]
                yield pa.RecordBatch.from_arrays([s.column("id"), pa.array([len(x) for x in sets], pa.int32()), pa.array(keys, pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "n", "key", "elements"])

    return records.select("id", text.alias("text")).mapInArrow(run, "id string, n int, key bigint, elements binary")


class Frequencies:
    """How many sets have an element of each of 2 ** bits hash buckets, as codes of one byte."""

    def __init__(self, bits: int, codes: np.ndarray):
        self.bits, self.codes = bits, codes
        k = np.arange(256)
        self.counts = np.where(k < 32, k, 32 * 2.0 ** ((k - 32) / 8)).astype(np.int64)

    @staticmethod
    def code(counts: np.ndarray) -> np.ndarray:
        big = 32 + np.floor(8 * np.log2(np.maximum(counts, 32) / 32))
        return np.minimum(np.where(counts < 32, counts, big), 255).astype(np.uint8)

    def of(self, elements: np.ndarray) -> np.ndarray:
        return self.counts[self.codes[(elements >> np.uint64(64 - self.bits)).astype(np.int64)]]


def frequency_table(sets: DataFrame) -> Frequencies | None:
    """The table; null where there are too many triples for one."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    if total > CROWDED << MOST_BITS:
        return None
    bits = min(MOST_BITS, max(LEAST_BITS, (2 * int(total)).bit_length()))
    size = (1 << bits) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            at, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.int32), np.empty(0, np.int64))
            held.clear()
            for a in range(0, len(at), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(at[a : a + 100_000]), pa.array(n[a : a + 100_000].astype(np.int32))], ["bucket", "n"])

        for b in batches:
            held.append((np.frombuffer(b"".join(b.column("elements").to_pylist()), np.uint64) >> np.uint64(64 - bits)).astype(np.int32))
            if sum(map(len, held)) > COUNTED:
                yield from flush()
        yield from flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            at, n = b.column("bucket").to_numpy(), b.column("n").to_numpy()
            for s in np.unique(at // size):
                mine = at // size == s
                total.setdefault(int(s), np.zeros(size, np.int64))
                total[int(s)] += np.bincount(at[mine] % size, n[mine], minlength=size).astype(np.int64)
        for s, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([Frequencies.code(x).tobytes()], pa.binary())], ["slice", "codes"])

    rows = sets.select("elements").mapInArrow(count, "bucket int, n int").repartitionById(SLICES, F.floor(F.col("bucket") / size).cast("int"))
    out = np.zeros(1 << bits, np.uint8)
    for r in rows.mapInArrow(add, "slice int, codes binary").collect():  # SLICES rows, 64 MB together at the most
        out[r[0] * size : (r[0] + 1) * size] = np.frombuffer(r[1], np.uint8)
    return Frequencies(bits, out)


def with_counts(sets: DataFrame) -> DataFrame:
    """key, elements, counts (binary, int64 beside each element) of sets, counted by an aggregate. A count of 1 needs no row: it is what no join finds."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                raw = b.column("elements").slice(k, 1000).to_pylist()
                e = np.frombuffer(b"".join(raw), np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("key").slice(k, 1000).to_numpy(), [len(r) // 8 for r in raw])), pa.array(e)], ["key", "element"])

    each = sets.select("key", "elements").mapInArrow(explode, "key bigint, element bigint")
    often = each.groupBy("element").agg(F.count("*").alias("c")).where("c > 1")
    held = each.join(often, "element").groupBy("key").agg(F.collect_list(F.struct("element", "c")).alias("often"))  # of one record

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = []
            for raw, rows in zip(b.column("elements").to_pylist(), b.column("often").to_pylist()):
                e, c = np.frombuffer(raw, np.uint64), np.ones(len(raw) // 8, np.int64)
                if rows:
                    at = np.array([r["element"] for r in rows], np.int64).view(np.uint64)
                    c[np.searchsorted(e, at)] = [r["c"] for r in rows]
                counts.append(c.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("elements"), pa.array(counts, pa.binary())], ["key", "elements", "counts"])

    return sets.select("key", "elements").join(held, "key", "left").mapInArrow(beside, "key bigint, elements binary, counts binary")


def _least(share: Fraction, n: int) -> int:
    return math.ceil(share * n)


def bit_sketch(elements: np.ndarray) -> np.ndarray:
    bits = np.bincount((elements & np.uint64(64 * SKETCH_WORDS - 1)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def region_pairs(part: tuple[np.ndarray, ...], t: float) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of rows sorted by (region, size, key): columns region, n, key, pos, index, block, cross, home, whole, sketch."""
    region, n, key, pos, index, block, cross, home, whole, sketch = part
    small, large = [], []
    ratio = t / (1 + t)
    at = np.arange(len(region) - 1)
    d = 1
    while len(at):
        at = at[at + d < len(region)]
        at = at[region[at] == region[at + d]]
        i = at[index[at]]
        j = i + d
        ok = (n[i] >= t * n[j] - 1e-9) & (~cross[i] | (block[i] != block[j])) & (home[i] | home[j])
        ok &= np.minimum(whole[i], whole[j]) >= t * np.maximum(whole[i], whole[j]) - 1e-9
        i, j = i[ok], j[ok]
        need = ratio * (n[i] + n[j]) - 1e-9
        ok = np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need
        i, j, need = i[ok], j[ok], need[ok]
        if len(i):
            differ = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1, dtype=np.int64)
            ok = differ <= n[i] + n[j] - 2 * need + 1e-6
            small.append(key[i[ok]])
            large.append(key[j[ok]])
        d += 1
    none = np.empty(0, np.int64)
    return (np.concatenate(small), np.concatenate(large)) if small else (none, none)


def sliced(elements: np.ndarray, t: float) -> Iterator[tuple[int, bool, np.ndarray]]:
    """(slicing and slice, home, places of its elements) of a record: in the slices of its own size class, and, as a guest, in those of
    the next class if its partners may be of that."""
    n = len(elements)
    k = 1
    while n > SLICE_SIZE * k:
        k *= 2
    for slices, home in ((k, True), (2 * k, False)):
        if home or n >= t * SLICE_SIZE * k - 1e-9:
            which = ((elements >> np.uint64(12)) & np.uint64(slices - 1)).astype(np.int64)
            for s in range(slices):
                part = np.flatnonzero(which == s)
                if len(part):
                    yield slices + s, home, part


_COLUMNS = ["region", "n", "key", "pos", "index", "block", "cross", "home", "whole"]


def candidate_pairs(sets: DataFrame, counts: Frequencies | None, t: float) -> DataFrame:
    """Distinct (a, b) keys of sets that may have a similarity of at least t; no pair that has is missing."""
    share = Fraction(t).limit_denominator(1000)
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    schema = "region bigint, n int, key bigint, pos int, index boolean, block int, cross boolean, home boolean, whole int, sketch binary"

    def rows_of(raw: bytes, key: int, known: np.ndarray, cols: list[list], sketches: list[bytes]) -> None:
        every = np.frombuffer(raw, np.uint64)
        for place, home, at in sliced(every, t):
            n, e, c = len(at), every[at], known[at]
            sketch = bit_sketch(e).tobytes()
            order = np.lexsort((e, c))[: n - _least(share, n) + 1]
            pos = np.flatnonzero(c[order] > 1)  # a bucket with one record holds no pair
            e, c = e[order][pos], c[order][pos]
            index = pos <= n - _least(2 * share / (1 + share), n)
            blocks = np.where(c > HOT, -(-c // BLOCK), 1)
            mine = key % blocks
            copies = np.repeat(np.arange(len(e)), blocks)
            other = np.arange(len(copies)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            lo, hi = np.minimum(mine[copies], other), np.maximum(mine[copies], other)
            region = e[copies] + lo.astype(np.uint64) * _K[0] + hi.astype(np.uint64) * _K[2] + np.array([place], np.uint64) * _K[1]  # arrays wrap around
            m = len(copies)
            for col, x in zip(cols, (region.astype(np.int64), np.full(m, n, np.int32), np.full(m, key), pos[copies].astype(np.int32), index[copies], mine[copies].astype(np.int32), lo != hi, np.full(m, home), np.full(m, len(every), np.int32))):
                col.append(x)
            sketches += [sketch] * m

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for b in batches:
            for k in range(0, b.num_rows, 500):
                cols: list[list] = [[] for _ in _COLUMNS]
                sketches: list[bytes] = []
                raws = b.column("elements").slice(k, 500).to_pylist()
                told = [often.of(np.frombuffer(r, np.uint64)) for r in raws] if often else [np.frombuffer(c, np.int64) for c in b.column("counts").slice(k, 500).to_pylist()]
                for key, raw, c in zip(b.column("key").slice(k, 500).to_pylist(), raws, told):
                    rows_of(raw, key, c, cols, sketches)
                if sketches:
                    yield pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(x)) for x in cols], pa.array(sketches, pa.binary())], [*_COLUMNS, "sketch"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None

        def out(part: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            a, b = region_pairs(part, t)
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            part = tuple(np.asarray(b.column(c)) for c in _COLUMNS)
            part += (np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH_WORDS),)
            if held is not None:
                part = tuple(np.concatenate(x) for x in zip(held, part))
            last = int(np.searchsorted(part[0], part[0][-1]))  # the last region may go on in the next batch
            yield out(tuple(x[:last] for x in part))
            held = tuple(x[last:] for x in part)
        if held is not None:
            yield out(held)

    laid = (sets.select("key", "elements") if counts else with_counts(sets)).mapInArrow(replicate, schema)
    laid = laid.repartition("region").sortWithinPartitions("region", "n", "key")
    return laid.mapInArrow(join, "a bigint, b bigint").distinct()


def similar_sets(sets: DataFrame, t: float) -> DataFrame:
    """(a, b, similarity) of the keys of distinct sets with a similarity of at least t, a before b."""
    share = Fraction(t).limit_denominator(1000)
    pairs = cut(candidate_pairs(sets, frequency_table(sets), t), "p5-candidates")
    left = sets.select(F.col("key").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("elements").alias("y"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a_, b_, sim = [], [], []
            for a, k, x, y in zip(*(b.column(c).to_pylist() for c in ("a", "b", "x", "y"))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                if both * share.denominator >= share.numerator * union:
                    a_.append(a)
                    b_.append(k)
                    sim.append(both / union)
            yield pa.RecordBatch.from_arrays([pa.array(a_, pa.int64()), pa.array(b_, pa.int64()), pa.array(sim, pa.float64())], ["a", "b", "similarity"])

    return pairs.join(left, "a").join(right, "b").mapInArrow(verify, "a bigint, b bigint, similarity double")


def _classes(records: DataFrame, parts: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = one_per_key(records.select("id", *parts, "received_at"), "id", "received_at")
    sets = cut(record_sets(rows, parts), "p5-sets")
    known = sets.where("n > 0").select("id", "key")
    members = known.join(known.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "key")
    one = sets.where("n > 0").join(members.where("id = first").select("id"), "id", "left_semi")
    return sets, members, one


def similar_records(records: DataFrame, t: float = 0.8, parts: tuple[str, ...] = ("title", "content")) -> DataFrame:
    """(id_a, id_b), smaller id first: records with a similarity of at least t, copies expanded (see COPIES_IN_PAIRS)."""
    _, members, one = _classes(records, list(parts))
    members = cut(members, "p5-members")
    pairs = similar_sets(one, t)
    told = members.where((F.col("copies") <= COPIES_IN_PAIRS) | (F.col("id") == F.col("first")))
    a = told.select(F.col("key").alias("a"), F.col("id").alias("i"))
    b = told.select(F.col("key").alias("b"), F.col("id").alias("j"))
    between = pairs.select("a", "b").join(a, "a").join(b, "b").select("i", "j")
    few = members.where(F.col("copies").between(2, COPIES_IN_PAIRS))
    within = few.select("key", F.col("id").alias("i")).join(few.select("key", F.col("id").alias("j")), "key").where("i < j").select("i", "j")
    star = members.where((F.col("copies") > COPIES_IN_PAIRS) & (F.col("id") != F.col("first"))).select(F.col("first").alias("i"), F.col("id").alias("j"))
    return between.unionByName(within).unionByName(star).select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, group): the smallest node that links (a, b) connect each node with. Labels spread and jump until they rest."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    state = cut(nodes.select("node", F.col("node").alias("group")), "labels")
    while True:
        seen = both.join(state.select(F.col("node").alias("b"), "group"), "b").groupBy("a").agg(F.min("group").alias("least"))
        step = state.join(seen, state["node"] == seen["a"], "left").select("node", "group", F.least("group", F.coalesce("least", "group")).alias("next"))
        jump = state.select(F.col("node").alias("next"), F.col("group").alias("far"))
        new = cut(step.join(jump, "next").select("node", F.least("next", "far").alias("group"), (F.least("next", "far") != F.col("group")).alias("moved")), "labels")
        drop_path(state)
        if not new.where("moved").limit(1).count():
            return new.drop("moved")
        state = new.drop("moved")


def record_groups(records: DataFrame, t: float = 0.8, parts: tuple[str, ...] = ("title", "content")) -> DataFrame:
    """id, group (smallest id of the group), copies (records with the same set), links (to other sets): one row per record."""
    sets, members, one = _classes(records, list(parts))
    members = cut(members, "p5-members")
    pairs = cut(similar_sets(one, t), "p5-pairs")
    links = pairs.select("a", "b")
    degree = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.count("*").alias("links"))
    groups = components(links, members.select(F.col("key").alias("node")).distinct())
    named = members.join(groups, members["key"] == groups["node"]).join(degree, F.col("key") == F.col("a"), "left")
    first = named.groupBy("group").agg(F.min("id").alias("name"))
    out = named.join(first, "group").select("id", F.col("name").alias("group"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return sets.select("id").join(out, "id", "left").select("id", F.coalesce("group", "id").alias("group"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))
