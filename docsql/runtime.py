"""Session helpers: table access, shared storage and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, wherever the driver was started."""
    context, root = spark.sparkContext, Path(__file__).parent
    if context.applicationId in _shipped or not root.is_dir():
        return
    _shipped.add(context.applicationId)
    packed = Path(tempfile.mkdtemp(prefix="docsql-")) / "docsql.zip"  # on the driver; Spark copies it from there
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(packed))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A frame that is a plain scan, for work in Python: dealt out when its partitions are fewer than the cores, else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir, else one of our own (local mode only)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="docsql-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


_folders: set[str] = set()


def work_dir(spark: SparkSession) -> str:
    """The folder below shared_dir that holds what this application writes in between; it is removed when the driver ends."""
    folder = f"{shared_dir(spark)}/docsql-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_delete, spark, folder)
    return folder


def _delete(spark: SparkSession, folder: str) -> None:
    try:
        context = spark.sparkContext
        jvm = context._jvm or SparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(context._jsc.hadoopConfiguration() if context._jsc else jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone before the driver
        pass


def cut(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write df into the shared folder and read it back: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    ship(spark)
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(df: DataFrame) -> None:
    """Remove the files of a frame that came from cut(); nothing may read it afterwards."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def one_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one latest by `order`, ties by the whole row. Rows with a null key are dropped."""
    cols = df.columns
    rest = [c for c in cols if c != key]
    packed = F.struct(F.col(order).alias("__o"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(rest)])
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(packed).alias("__m"))
    return g.select(key, *[F.col(f"__m.__{i}").alias(c) for i, c in enumerate(rest)]).select(*cols)


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
