"""Vectors, ranks, intervals and percentiles."""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RRF_K = 60  # fixed value
Z95 = 1.96  # fixed value


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is null, of another length or all zero."""
    both = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (both > 0), dot(a, b) / both)


def unit(a: Column, dims: int | None = None) -> Column:
    """Cut to `dims` numbers and scaled to length 1; a zero vector stays."""
    v = a if dims is None else F.slice(a, 1, dims)
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def rrf(rank: Column) -> Column:
    return 1.0 / (RRF_K + rank)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def half_up(x: Column, places: int = 0) -> Column:
    """Rounding half towards plus infinity."""
    f = 10.0**places
    return F.floor(x * f + 0.5) / f


def wilson(passed: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    n = F.nullif(total, F.lit(0)).cast("double")
    p = passed / n
    middle, width = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    end = lambda c: F.when(n.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / (1 + z * z / n))))
    return end(middle - width), end(middle + width)


ACCURACY = 10_000  # of the sketch; a group's candidates are about four times its rows divided by this


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per group the values at index min(n - 1, floor(p n)) of the ascending order.

    A mergeable sketch brackets each of them; what lies below the bracket is counted, and only the values inside are put in
    order, so no task sees a group whole, however large or varied it is.
    """
    held = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    ends = [min(1.0, max(0.0, p + d / ACCURACY)) for p in shares.values() for d in (-2, 2)]
    sketch = held.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile_approx("__v", ends, ACCURACY).alias("__q"))
    brackets = F.array(*[F.struct(F.lit(name).alias("name"), F.least(F.col("__n") - 1, F.floor(F.lit(p) * F.col("__n"))).alias("at"), F.col("__q")[2 * i].alias("lo"), F.col("__q")[2 * i + 1].alias("hi")) for i, (name, p) in enumerate(shares.items())])
    told = F.broadcast(sketch) if not keys else sketch  # without keys it is one row
    told = told.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], brackets.alias("__b"))
    same = functools.reduce(lambda c, i: c & F.col(keys[i]).eqNullSafe(F.col(f"__k{i}")), range(len(keys)), F.lit(True))  # a null key is a group like others
    near = held.join(told, same).select(*keys, "__v", F.explode("__b").alias("b"))
    near = near.where(F.col("__v") <= F.col("b.hi")).withColumn("__in", F.when(F.col("__v") >= F.col("b.lo"), F.col("__v")))
    counted = near.groupBy(*keys, F.col("b.name").alias("__name"), F.col("b.at").alias("__at"), "__in").agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*keys, "__name").orderBy(F.asc_nulls_first("__in")).rowsBetween(Window.unboundedPreceding, 0))
    hit = counted.withColumn("__upto", upto).where((F.col("__upto") > F.col("__at")) & (F.col("__upto") - F.col("__c") <= F.col("__at")))
    return hit.groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == name, F.col("__in"))).alias(name) for name in shares])


def mulberry(seed: Column, n: Column) -> Column:
    """The n-th number (from 1) in [0, 1) of the mulberry32 generator. The state after n steps follows from n, so rows are independent."""
    low = F.lit(0xFFFFFFFF)
    wrap = lambda x: x.bitwiseAND(low)
    shift = lambda x, k: F.shiftrightunsigned(x, k)

    def times(x: Column, y: Column) -> Column:
        # 32-bit product without overflow of 64 bits: the upper half of x only counts by its own lower 16 bits
        return wrap(wrap(shift(x, 16) * y).bitwiseAND(F.lit(0xFFFF)) * F.lit(65536) + x.bitwiseAND(F.lit(0xFFFF)) * y)

    a = wrap(seed.cast("bigint") + n.cast("bigint") * F.lit(0x6D2B79F5))
    t = times(wrap(a.bitwiseXOR(shift(a, 15))), wrap(a.bitwiseOR(F.lit(1))))
    t = wrap(t.bitwiseXOR(wrap(t + times(wrap(t.bitwiseXOR(shift(t, 7))), wrap(t.bitwiseOR(F.lit(61)))))))
    return wrap(t.bitwiseXOR(shift(t, 14))) / F.lit(4294967296.0)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _hash_embed(text: pd.Series, dims: pd.Series) -> pd.Series:
    known: dict[str, int] = {}

    def code(word: str) -> int:
        h = 2166136261
        units = word.encode("utf-16-le", "surrogatepass")
        for lo, hi in zip(units[::2], units[1::2]):
            h = ((h ^ (lo | hi << 8)) * 16777619) & 0xFFFFFFFF
        return abs(h - (1 << 32) if h >= 1 << 31 else h)

    def embed(t: str | None, d: int) -> np.ndarray:
        v = np.zeros(d)
        for w in re.findall(r"[^\W_]+", (t or "").lower()):
            if w not in known:
                known[w] = code(w)
            v[known[w] % d] += 1
        n = float(np.sqrt((v * v).sum()))
        return v / (n or 1.0)

    return pd.Series([embed(t, d) for t, d in zip(text, dims)])


def hash_embed(text: Column, dims: int = 64) -> Column:
    """Bag of words hashed into `dims` counts, scaled to length 1: a model-free embedder."""
    return _hash_embed(text, F.lit(dims))
