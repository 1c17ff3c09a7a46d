"""Filling of fixed-capacity containers: bulk-synchronous best fit.

Rounds go through the sizes in descending order; all items of a size are placed at once. Sizes and gaps are whole numbers
up to the capacity, so both are kept sorted and run-length encoded: how many items have a size, which containers (a range
of numbers) have a gap. In a round a sweep gives the items the successor of their size among the gaps, the narrowest that
holds them, as many items to a gap as fit in it; conflicts are resolved by rank: the items of a size are numbered, and item r
of a run goes to its container number r / (items a gap). Gaps are updated and the next round begins. This is best fit
decreasing, step by step, for any number of items.

The sweep needs the sizes only, no more entries than the capacity; the items themselves stay where they are. They are
numbered within their partitions, the numbers of equal sizes before a partition come from a window over one count per
partition and size, and each item then finds its container in the runs. A size that a third of all items have is spread
over all partitions like any other.

Defined results: an item over the capacity is cut into full containers and a rest; an item of no size gets no container
(null); null texts have no size; capacities that are null, below 1 or repeated are left out; repeated rows of an id count
once; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsql.llm.bpe import VOCABULARY, token_counts
from docsql.runtime import cut


class Gaps:
    """Containers by the room they have left: widths in order, and for each the ranges (first, count) of container numbers."""

    def __init__(self) -> None:
        self.widths: list[int] = []
        self.held: dict[int, list[tuple[int, int]]] = {}

    def put(self, width: int, first: int, count: int) -> None:
        if width and count:
            if width not in self.held:
                self.held[width] = []
                insort(self.widths, width)
            self.held[width].append((first, count))

    def take(self, size: int) -> tuple[int, int, int] | None:
        """(width, first, count) of the narrowest containers that hold `size`."""
        at = bisect_left(self.widths, size)
        if at == len(self.widths):
            return None
        width = self.widths[at]
        first, count = self.held[width].pop()
        if not self.held[width]:
            del self.held[width]
            del self.widths[at]
        return width, first, count


def sweep(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Runs (size, rank, each, first): from item `rank` of a size on, `each` items go to one container, the first to `first`.

    A run goes on to the next one of its size.
    """
    gaps, runs, opened = Gaps(), [], 0
    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            found = gaps.take(size)
            width, first, count = found or (capacity, opened, -(-left // (capacity // size)))
            opened += 0 if found else count
            each = width // size
            full = min(count, left // each)
            runs.append((size, rank, each, first))
            gaps.put(width - each * size, first, full)
            rank, left = rank + full * each, left - full * each
            if full < count and left:  # the rest of the items share one container
                gaps.put(width - left * size, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            gaps.put(width, first + full, count - full)
    return runs


def _pieces(items: DataFrame, caps: list[int]) -> DataFrame:
    """capacity, doc_id, piece, start_token, n_tokens: items over a capacity are cut."""
    n, cap = F.col("n_tokens"), F.col("capacity")
    each = items.withColumn("capacity", F.explode(F.array(*[F.lit(c) for c in caps]).cast("array<int>")))
    parts = F.expr("case when n_tokens <= capacity then array(0) else sequence(0, cast((n_tokens - 1) div capacity as int)) end")
    each = each.withColumn("piece", F.explode(parts)).withColumn("start_token", F.col("piece").cast("bigint") * cap)
    return each.select("capacity", "doc_id", "piece", "start_token", F.least(n - F.col("start_token"), cap).cast("int").alias("n_tokens"))


def _ranked(pieces: DataFrame) -> DataFrame:
    """pieces with part and rank: their number among those of their capacity and size in their partition. Nothing is moved."""
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for b in batches:
            key = b.column("capacity").to_numpy().astype(np.int64) << 32 | b.column("n_tokens").to_numpy().astype(np.int64)
            _, code, count = np.unique(key, return_inverse=True, return_counts=True)
            order = np.argsort(code, kind="stable")
            rank = np.empty(len(key), np.int64)
            rank[order] = np.arange(len(key)) - np.repeat(np.cumsum(count) - count, count)
            for k, n in zip(_, count):
                seen[int(k)] = seen.get(int(k), 0) + int(n)
            rank += np.array([seen[int(k)] - int(n) for k, n in zip(_, count)], np.int64)[code]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rank)], [*names, "rank"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.mapInArrow(run, f"{kinds}, rank bigint").withColumn("part", F.spark_partition_id())


def pack(items: DataFrame, capacities: list[int]) -> DataFrame:
    """capacity, container, doc_id, piece, start_token, n_tokens for items (doc_id, n_tokens)."""
    caps = sorted({c for c in capacities if c and c > 0})
    rows = cut(_ranked(_pieces(items, caps)), "p9-items")
    counts = cut(rows.where("n_tokens > 0 and n_tokens < capacity").groupBy("capacity", "n_tokens", "part").agg(F.count("*").alias("n")), "p9-counts")
    plan: dict[int, dict[int, int]] = {c: {} for c in caps}
    for r in counts.groupBy("capacity", "n_tokens").agg(F.sum("n").alias("n")).collect():  # at most the sum of the capacities
        plan[r[0]][r[1]] = r[2]
    runs = [(c, *r) for c in caps for r in sweep(plan[c], c)]
    where: dict[tuple[int, int], np.ndarray] = {}
    for c, size, *r in runs:
        where.setdefault((c, size), []).append(r)
    # as many runs as a size meets widths: the sizes bound them, not the items
    shared = items.sparkSession.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in where.items()})
    before = F.sum("n").over(Window.partitionBy("capacity", "n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("capacity", "n_tokens", "part", F.coalesce(before, F.lit(0)).alias("before"))
    placed = rows.join(offsets, ["capacity", "n_tokens", "part"], "left").select("capacity", "doc_id", "piece", "start_token", "n_tokens", (F.col("rank") + F.col("before")).alias("rank"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cap, size = b.column("capacity").to_numpy(), b.column("n_tokens").to_numpy()
            rank = b.column("rank").fill_null(0).to_numpy()
            number = np.full(len(cap), -1, np.int64)
            key = cap.astype(np.int64) << 32 | size.astype(np.int64)
            order = np.argsort(key, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0, True]) if len(key) else []
            for a, z in zip(edges[:-1], edges[1:]):
                at = order[a:z]
                r = shared.value.get((int(cap[at[0]]), int(size[at[0]])))
                if r is not None:
                    start, each, first = r[np.searchsorted(r[:, 0], rank[at], "right") - 1].T
                    number[at] = first + (rank[at] - start) // each
            name = [f"{c}-{n}" if n >= 0 else f"{c}-full-{d}-{p}" if s else None for c, n, s, d, p in zip(cap.tolist(), number.tolist(), size.tolist(), b.column("doc_id").to_pylist(), b.column("piece").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("capacity"), pa.array(name, pa.string()), *(b.column(c) for c in ("doc_id", "piece", "start_token", "n_tokens"))], ["capacity", "container", "doc_id", "piece", "start_token", "n_tokens"])

    return placed.mapInArrow(find, "capacity int, container string, doc_id bigint, piece int, start_token bigint, n_tokens int")


def containers(docs: DataFrame, windows: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The containers of each capacity in windows.capacity_tokens, filled with the texts of docs; see pack()."""
    caps = [r[0] for r in windows.select("capacity_tokens").distinct().collect()]  # a handful of window sizes
    sized = token_counts(docs.where("doc_id is not null").select("doc_id", "text"), "text", path)
    return pack(sized.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens")), caps)
