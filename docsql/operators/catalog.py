"""Catalogs of models as relations: which of them fit a device, and in what order.

catalog: id, runtime, memory_mb, window_mb (more for each 4,096 tokens of window beyond the first), download_mb,
context_window, quality, large_buffers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG = "id string, runtime string, memory_mb double, window_mb double, download_mb double, context_window int, quality double, large_buffers boolean"
LEAST_WINDOW, AGENT_WINDOW, SMALL_PENALTY = 4096, 8192, 15  # fixed values: tokens, and the quality that a smaller window costs
SINGLE_WEIGHTS, SINGLE_WINDOW = 1.25, 2.0  # fixed values: what single precision costs
LARGE_BUFFER_MB, MOST_DOWNLOAD_MB = 1024, 2500  # fixed values


@dataclass(frozen=True)
class Device:
    gpu: bool = True
    half_precision: bool = True
    budget_mb: float = 4096
    buffer_mb: float = 2048


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalog from JSON lines."""
    return spark.read.schema(CATALOG).json(path)


def resolved(models: DataFrame, device: Device) -> DataFrame:
    """models with window and estimated_mb: the window is halved until the model fits the device, down to LEAST_WINDOW."""
    base = F.col("memory_mb") * (1.0 if device.half_precision else SINGLE_WEIGHTS)
    more = F.col("window_mb") * (1.0 if device.half_precision else SINGLE_WINDOW)
    need = lambda w: base + more * (w / 4096 - 1)
    ladder = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.col("context_window") / F.pow(F.lit(2.0), i))
    window = F.element_at(F.filter(ladder, lambda w: (w <= LEAST_WINDOW) | (need(w) <= device.budget_mb)), 1)
    return models.withColumn("window", window.cast("int")).withColumn("estimated_mb", F.floor(need(F.col("window")) + 0.5).cast("bigint"))


def ranked(models: DataFrame, device: Device, runtime: str | None = None, most_download_mb: float | None = None, on_cpu: str = "transformers") -> DataFrame:
    """Models that fit the device, with score; the best score comes first, ties as they are named."""
    m = models if runtime is None else models.where(F.col("runtime") == runtime)
    if most_download_mb is not None:
        m = m.where(F.col("download_mb") <= most_download_mb)
    if not device.gpu:
        m = m.where(F.col("runtime") == on_cpu)
    m = resolved(m.where(~F.coalesce("large_buffers", F.lit(False)) | F.lit(device.buffer_mb >= LARGE_BUFFER_MB)), device)
    if device.gpu:
        m = m.where(F.col("estimated_mb") <= device.budget_mb)
    score = F.col("quality") - F.when(F.col("window") < AGENT_WINDOW, SMALL_PENALTY).otherwise(0)
    return m.withColumn("score", score).orderBy(F.desc("score"), "id")


def recommended(models: DataFrame, device: Device, preferred: str = "webllm", most_download_mb: float = MOST_DOWNLOAD_MB) -> DataFrame:
    """At most one model: the best of the preferred runtime, else of any."""
    every = ranked(models, device, None, most_download_mb)
    return every.orderBy(F.desc(F.col("runtime") == preferred), F.desc("score"), "id").limit(1)


def first_installed(models: DataFrame, installed: DataFrame) -> DataFrame:
    """At most one model: the best of those that are installed (id)."""
    return models.join(installed.select("id").distinct(), "id", "left_semi").orderBy(F.desc("quality"), "id").limit(1)
