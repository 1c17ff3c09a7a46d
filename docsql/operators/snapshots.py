"""Tables that change by snapshots, a bucket at a time, and the state that names the files they consist of.

Rows lie in buckets by the hash of a key. A change writes the buckets it touches anew and then a numbered state, which
names the folder of every bucket; a state is written beside the others and gets its number by a rename, so readers see
the one before or the one after, and a crash leaves the one before. Files that no state of the last KEPT names are removed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT = 3


class Snapshots:
    """schemas: name of a table to (schema, key column). All changes of one replace() become visible together."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, tuple[str, str]], buckets: int = 16):
        self.spark, self.path, self.schemas, self.buckets = spark, path.rstrip("/"), schemas, buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(f"{self.path}/states"))

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    # -- state
    def _numbers(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/states"))]
        return sorted(int(n) for n in names if n.isdigit())

    def _load(self, number: int) -> dict:
        stream = self._fs.open(self._at(f"{self.path}/states/{number}"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def state(self) -> dict:
        """The newest state: version, tables (name to bucket to folder) and values."""
        numbers = self._numbers()
        return self._load(numbers[-1]) if numbers else {"version": 0, "tables": {}, "values": {}}

    def _commit(self, state: dict) -> None:
        number = state["version"] + 1
        draft, final = self._at(f"{self.path}/states/draft-{uuid.uuid4().hex}"), self._at(f"{self.path}/states/{number}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(state | {"version": number}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"state {number} was written by another change")
        self._sweep(number)

    def _sweep(self, newest: int) -> None:
        for n in self._numbers():
            if n <= newest - KEPT:
                self._fs.delete(self._at(f"{self.path}/states/{n}"), False)
        named = {f.rsplit("/bucket=", 1)[0].rsplit("/", 1)[-1] for n in self._numbers() for t in self._load(n)["tables"].values() for f in t.values()}
        for s in self._fs.listStatus(self._at(self.path)):
            name = s.getPath().getName()
            if name.startswith("run-") and name not in named:
                self._fs.delete(s.getPath(), True)

    # -- values
    def get(self, key: str, default: object = None) -> object:
        return self.state()["values"].get(key, default)

    def put(self, **values: object) -> None:
        state = self.state()
        self._commit(state | {"values": state["values"] | values})

    def migrate(self, scope: str, steps: list) -> int:
        """Runs the steps (functions of this store) that were not run before, in order, each recorded when it is done; gives how many."""
        done = int(self.get(f"version.{scope}", 0))
        for number, step in enumerate(steps[done:], done + 1):
            step(self)
            self.put(**{f"version.{scope}": number})
        return len(steps) - done

    # -- tables
    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of the keys (one column): as many numbers as there are buckets at the most."""
        return sorted(r[0] for r in keys.select(self.bucket(F.col(keys.columns[0]))).distinct().collect())

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        held = self.state()["tables"].get(name, {})
        paths = [f for b, f in held.items() if buckets is None or int(b) in buckets]
        schema = self.schemas[name][0]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def replace(self, changes: dict[str, tuple[DataFrame, list[int]]], **values: object) -> None:
        """changes: table to (all rows of the touched buckets, the buckets). Other buckets keep their files."""
        state = self.state()
        tables = {k: dict(v) for k, v in state["tables"].items()}
        for name, (frame, buckets) in changes.items():
            folder = f"{self.path}/run-{uuid.uuid4().hex}"
            frame.withColumn("bucket", self.bucket(F.col(self.schemas[name][1]))).repartition(max(1, len(buckets)), "bucket").write.partitionBy("bucket").parquet(folder)
            for b in buckets:
                own = f"{folder}/bucket={b}"
                tables.setdefault(name, {}).pop(str(b), None)
                if self._fs.exists(self._at(own)):
                    tables[name][str(b)] = own
        self._commit({"version": state["version"], "tables": tables, "values": state["values"] | values})
