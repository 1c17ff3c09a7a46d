"""Operators over ordered rows of groups, none of which gathers a group in one task.

Rows are range-partitioned by (keys, order) and sorted, so a large group lies in several partitions. What a row takes from
the one before it is found while the rows stream past, a column at a time; only what crosses the partitions' borders, one or
two rows each, is put right by the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsql.runtime import cut


def _before(column: pa.Array, carried: pa.Array) -> pa.Array:
    """A column moved down by a row; `carried` is the last value of the batch before."""
    return pa.concat_arrays([carried, column.slice(0, len(column) - 1)])


def _same(a: pa.Array, b: pa.Array) -> pa.Array:
    """Equal, where null equals null."""
    return pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))


def _streamed(df: DataFrame, keys: list[str], order: list[str], values: list[str], prefix: str) -> DataFrame:
    """df in ranges of (keys, order), written: with the values before (of the row before in the range, whatever its group),
    __row (number in the range, from 0), __part, and __same (the row before is of the same group)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = df.columns
    schema = T.StructType([*df.schema.fields, *[T.StructField(prefix + v, df.schema[v].dataType) for v in values], T.StructField("__row", T.LongType()), T.StructField("__part", T.IntegerType()), T.StructField("__same", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        last: dict[str, pa.Array] = {}
        for b in batches:
            if not b.num_rows:
                continue
            cols = {c: b.column(c) for c in {*keys, *values}}
            moved = {c: _before(x, last.get(c, pa.nulls(1, x.type))) for c, x in cols.items()}
            same = pa.array([True] * b.num_rows)
            for k in keys:
                same = pc.and_(same, _same(moved[k], cols[k]))
            if not seen:
                same = pa.concat_arrays([pa.array([False]), same.slice(1)])
            last = {c: x.slice(len(x) - 1) for c, x in cols.items()}
            yield pa.RecordBatch.from_arrays([*b.columns, *(moved[v] for v in values), pa.array(range(seen, seen + b.num_rows), pa.int64()), pa.array([part] * b.num_rows, pa.int32()), same], schema.names)
            seen += b.num_rows

    return cut(df.select(*names).repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).mapInArrow(run, schema), "ranges")


def with_previous(df: DataFrame, keys: list[str], order: list[str], values: list[str], prefix: str = "prev_") -> DataFrame:
    """df with the values of the row before, within its group; null for a group's first row. The order should be total."""
    laid = _streamed(df, keys, order, values, prefix)
    # one row a range: its last one, for the first row of the next
    rows = laid.groupBy("__part").agg(F.max_by(F.struct(*keys, *values), "__row").alias("e")).orderBy("__part").collect()
    border = [(after["__part"], *[before["e"][k] for k in range(len(keys))], *[before["e"][len(keys) + v] for v in range(len(values))]) for before, after in zip(rows, rows[1:])]
    kept = [F.when(F.col("__same"), F.col(prefix + v)).alias(prefix + v) for v in values]
    if not border:
        return laid.select(*df.columns, *kept)
    ends = df.sparkSession.createDataFrame(border, T.StructType([T.StructField("__to", T.IntegerType()), *[T.StructField(f"__k{i}", df.schema[k].dataType) for i, k in enumerate(keys)], *[T.StructField(f"__b{i}", df.schema[v].dataType) for i, v in enumerate(values)]]))
    match = F.col("__row") == 0
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = laid.join(F.broadcast(ends), (F.col("__part") == F.col("__to")) & match, "left")  # at most one row a range
    return joined.select(*df.columns, *[F.when(F.col("__to").isNotNull(), F.col(f"__b{i}")).when(F.col("__same"), F.col(prefix + v)).alias(prefix + v) for i, v in enumerate(values)])


def merged_runs(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """keys, value, first, n: runs of neighbours with the same value as one row each; `first` is the run's first order struct.

    Rows that open a run are found while they stream past; a run has the rows up to the next opener of its range, and what
    a range has before its first opener of another run goes to the run that the range before left open.
    """
    laid = _streamed(df.select(*keys, *order, value), keys, order, [value], "__p_")
    opens = laid.where(~(F.col("__same") & F.col(value).eqNullSafe(F.col(f"__p_{value}"))))
    following = F.lead("__row").over(Window.partitionBy("__part").orderBy("__row"))
    size = laid.groupBy("__part").agg((F.max("__row") + 1).alias("__size"))
    runs = opens.withColumn("__next", following).join(size, "__part").withColumn("n", F.coalesce("__next", "__size") - F.col("__row")).withColumn("first", F.struct(*order))
    runs = cut(runs.select("__part", "__row", (F.col("__next").isNull()).alias("__last"), *keys, value, "first", "n"), "runs")
    # the first and the last run of each range: where the one goes on from the other, they are one
    edges = runs.where("__row = 0 or __last").select("__part", "__row", "__last", *keys, value).orderBy("__part", "__row").collect()
    goes_on, before = [], None
    for r in edges:
        root = (r["__part"], r["__row"])
        if r["__row"] == 0 and before is not None and all(r[c] == before[0][c] for c in (*keys, value)):
            root = before[1]
            goes_on.append((r["__part"], r["__row"], *root))
        if r["__last"]:
            before = (r, root)
    into = df.sparkSession.createDataFrame(goes_on, "__part int, __row bigint, __to_part int, __to_row bigint")
    roots = runs.join(F.broadcast(into), ["__part", "__row"], "left")  # at most one row a range
    roots = roots.withColumn("__p", F.coalesce("__to_part", "__part")).withColumn("__r", F.coalesce("__to_row", "__row"))
    return roots.groupBy("__p", "__r").agg(*[F.first(c).alias(c) for c in (*keys, value)], F.min("first").alias("first"), F.sum("n").alias("n")).drop("__p", "__r")
