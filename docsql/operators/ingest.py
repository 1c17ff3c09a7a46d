"""Incremental document store: documents, chunks and their vectors, changed by hash, a bucket of documents at a time.

A document is unchanged when its hash is; when only the part behind the colon differs, its metadata is updated without
chunking or embedding again. Only buckets with changed documents are written anew (see snapshots.py).

Vectors belong to an embedder, which the store names. Another embedder needs the vectors anew: at once (reindex), or in
steps beside the old ones (reindex_step), which are swapped when all are there; until then searches go by keywords.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsql.functions.numeric import hash_embed
from docsql.functions.text import content_hash, document_id, embedding_input
from docsql.operators.chunking import OVERLAP, SIZE, chunk_key, chunks
from docsql.operators.snapshots import Snapshots
from docsql.runtime import cut, latest

DOCUMENTS = "id string, collection string, title string, source string, metadata string, content string, content_hash string, chunk_count int, updated_at timestamp"
CHUNKS = "chunk_id bigint, document_id string, collection string, ordinal int, content string, embedding array<float>, embedding_next array<float>"


@dataclass(frozen=True)
class Embedder:
    """name and dimensions tell an embedder; vector gives array<float> of a text Column (built-ins, or a pandas UDF that gets batches)."""

    name: str
    dimensions: int
    vector: Callable[[Column], Column]
    format: Callable[[Column, Column], Column] = embedding_input

    def record(self) -> dict:
        return {"id": self.name, "dimensions": self.dimensions}

    def of(self, title: Column, text: Column) -> Column:
        """The vector of a chunk, checked to have the declared dimensions."""
        v = self.vector(self.format(title, text)).cast("array<float>")
        wrong = F.raise_error(F.concat(F.lit(f"the embedder {self.name} gave another size than {self.dimensions}: "), F.size(v).cast("string"))).cast("array<float>")
        return F.when(F.size(v) == self.dimensions, v).otherwise(wrong)


def hash_embedder(dimensions: int = 64) -> Embedder:
    return Embedder(f"hash-{dimensions}", dimensions, lambda text: hash_embed(text, dimensions))


def prepared(incoming: DataFrame) -> DataFrame:
    """Incoming documents with ids and hashes; of rows with one id the last received stays. A document without content is left out."""
    d = incoming.where(F.col("content").isNotNull()).select(
        F.coalesce("id", document_id(F.col("source"), F.col("content"))).alias("id"), F.coalesce("collection", F.lit("default")).alias("collection"), "title", "source", F.coalesce("metadata", F.lit("{}")).alias("metadata"), "content", "received_at"
    )
    one = latest(d, ["id"], [F.desc_nulls_last("received_at"), F.desc("content")]).drop("received_at")
    return one.withColumn("content_hash", content_hash(F.col("collection"), F.col("title"), F.col("content"), F.col("metadata")))


def changes(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """id, action: added, changed, metadata or skipped, of prepared incoming documents against stored ones."""
    s = stored.select("id", F.col("content_hash").alias("__old"))
    body = lambda c: F.split_part(c, F.lit(":"), F.lit(1))
    action = F.when(F.col("__old").isNull(), "added").when(F.col("__old") == F.col("content_hash"), "skipped").when(body(F.col("__old")) == body(F.col("content_hash")), "metadata").otherwise("changed")
    return incoming.join(s, "id", "left").select("id", action.alias("action"))


def backfilled(pieces: DataFrame, vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """pieces with the vectors (chunk_id, vector) where `column` is null."""
    return pieces.join(vectors.select("chunk_id", F.col("vector").alias("__v")), "chunk_id", "left").withColumn(column, F.coalesce(column, "__v")).drop("__v").select(*pieces.columns)


class Store:
    """Documents and chunks below one folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None, size: int = SIZE, overlap: int = OVERLAP, buckets: int = 16):
        self.spark, self.embedder, self.size, self.overlap = spark, embedder or hash_embedder(), size, overlap
        self.files = Snapshots(spark, path, {"documents": (DOCUMENTS, "id"), "chunks": (CHUNKS, "document_id")}, buckets)
        if self.files.get("embedder") is None:
            self.files.put(embedder=self.embedder.record(), next=None)

    @property
    def documents(self) -> DataFrame:
        return self.files.read("documents")

    @property
    def chunks(self) -> DataFrame:
        return self.files.read("chunks")

    # -- embedders
    def _column(self) -> str:
        """The column that the configured embedder fills; an error if the store belongs to another one."""
        own = self.embedder.record()
        values = self.files.state()["values"]
        if values.get("next"):
            if values["next"] == own:
                return "embedding_next"
        elif values["embedder"] == own:
            return "embedding"
        raise ValueError(f"the vectors are those of {values.get('next') or values['embedder']}, not of {own}: reindex first")

    @property
    def vectors_ready(self) -> bool:
        return not self.files.get("next")

    def _titled(self, pieces: DataFrame) -> DataFrame:
        return pieces.join(self.documents.select(F.col("id").alias("document_id"), F.col("title").alias("__title")), "document_id", "left")

    def _rewrite(self, column: str, rows: DataFrame, buckets: list[int], **values: object) -> None:
        vectors = self._titled(rows).select("chunk_id", self.embedder.of(F.col("__title"), F.col("content")).alias("vector"))
        self.files.replace({"chunks": (backfilled(self.files.read("chunks", buckets), vectors, column), buckets)}, **values)

    def backfill(self, limit: int | None = None, column: str = "embedding") -> int:
        """Vectors for up to `limit` chunks without one, in order of buckets and ids, so that few buckets are touched; gives how many there were."""
        bucket = self.files.bucket(F.col("document_id"))
        open_ = self.chunks.where(F.col(column).isNull()).select("chunk_id", "document_id", "content", bucket.alias("bucket"))
        if limit is not None:
            counts, seen, wanted = open_.groupBy("bucket").count().orderBy("bucket").collect(), 0, []
            for r in counts:  # a row a bucket
                if seen < limit:
                    wanted.append(r["bucket"])
                    seen += r["count"]
            open_ = open_.where(F.col("bucket").isin(wanted)).orderBy("bucket", "chunk_id").limit(limit)
        open_ = cut(open_, "to-embed")
        buckets = sorted(r[0] for r in open_.select("bucket").distinct().collect())
        if buckets:
            self._rewrite(column, open_.drop("bucket"), buckets)
        return open_.count()

    def reindex(self) -> int:
        """All vectors anew with the configured embedder, at once; gives how many."""
        pieces = self._titled(self.chunks).withColumn("embedding", self.embedder.of(F.col("__title"), F.col("content"))).withColumn("embedding_next", F.lit(None).cast("array<float>"))
        every = list(range(self.files.buckets))
        self.files.replace({"chunks": (pieces.select(*self.chunks.columns), every)}, embedder=self.embedder.record(), next=None)
        return self.chunks.count()

    def begin_reindex(self) -> None:
        """A second vector column for the configured embedder. One that was begun for a third embedder is emptied; back at the store's own, it is given up."""
        values, own = self.files.state()["values"], self.embedder.record()
        if values["embedder"] == own:
            if values.get("next"):
                self._clear_next()
                self.backfill()
                self.files.put(next=None)
        elif values.get("next") != own:
            if values.get("next"):
                self._clear_next()
            self.files.put(next=own)

    def _clear_next(self) -> None:
        empty = self.chunks.withColumn("embedding_next", F.lit(None).cast("array<float>"))
        self.files.replace({"chunks": (empty, list(range(self.files.buckets)))})

    def reindex_status(self) -> dict | None:
        """from, to, done and total of a re-embedding in steps; null when there is none."""
        values = self.files.state()["values"]
        if not values.get("next"):
            return None
        r = self.chunks.agg(F.count("*").alias("total"), F.count("embedding_next").alias("done")).first()
        return {"from": values["embedder"], "to": values["next"], "done": r["done"], "total": r["total"]}

    def reindex_step(self, limit: int = 32) -> dict | None:
        """The next `limit` chunks; the last step swaps the columns. Gives the status after it, null when nothing is left."""
        if not self.files.get("next"):
            return None
        self.backfill(limit, self._column())
        status = self.reindex_status()
        if status["done"] < status["total"]:
            return status
        swapped = self.chunks.withColumn("embedding", F.col("embedding_next")).withColumn("embedding_next", F.lit(None).cast("array<float>"))
        self.files.replace({"chunks": (swapped, list(range(self.files.buckets)))}, embedder=self.files.get("next"), next=None)
        return None

    # -- documents
    def ingest(self, incoming: DataFrame) -> dict[str, int]:
        """Takes documents in, with their chunks and vectors; a second run over the same ones skips them all. Gives the number of each action."""
        column = self._column()
        new = prepared(incoming)
        staged = cut(new.join(changes(new, self.documents), "id"), "staged")
        counts = {r[0]: r[1] for r in staged.groupBy("action").count().collect()}  # four rows at most
        touched = staged.where("action <> 'skipped'")
        buckets = self.files.touched(touched.select("id"))
        if not buckets:
            return counts
        redo = staged.where("action in ('added', 'changed')")
        pieces = chunks(redo, "id", "content", self.size, self.overlap).join(redo.select("id", "collection", "title"), "id")
        vector = self.embedder.of(F.col("title"), F.col("content"))
        fresh = pieces.select(chunk_key(F.col("id"), F.col("ordinal")).alias("chunk_id"), F.col("id").alias("document_id"), "collection", "ordinal", "content", vector.alias(column))
        other = "embedding" if column == "embedding_next" else "embedding_next"
        fresh = cut(fresh.withColumn(other, F.lit(None).cast("array<float>")).select(*self.chunks.columns), "fresh-chunks")
        number = fresh.groupBy(F.col("document_id").alias("id")).agg(F.count("*").cast("int").alias("__n"))
        before = self.files.read("documents", buckets)
        known = touched.join(number, "id", "left").join(before.select("id", F.col("chunk_count").alias("__was")), "id", "left")
        rows = known.withColumn("chunk_count", F.when(F.col("action") == "metadata", F.col("__was")).otherwise(F.coalesce("__n", F.lit(0)))).withColumn("updated_at", F.current_timestamp()).select(*before.columns)
        documents = before.join(touched.select("id"), "id", "left_anti").select(*before.columns).unionByName(rows)
        kept = self.files.read("chunks", buckets).join(redo.select(F.col("id").alias("document_id")), "document_id", "left_anti").select(*fresh.columns)
        self.files.replace({"documents": (documents, buckets), "chunks": (kept.unionByName(fresh), buckets)})
        return counts

    def remove(self, gone: DataFrame) -> int:
        """Removes documents (id) with their chunks; gives how many there were."""
        held = cut(self.documents.join(gone.select("id").distinct(), "id", "left_semi").select("id"), "removed")
        buckets = self.files.touched(held)
        if buckets:
            documents, pieces = self.files.read("documents", buckets), self.files.read("chunks", buckets)
            left = pieces.join(held.select(F.col("id").alias("document_id")), "document_id", "left_anti").select(*pieces.columns)
            self.files.replace({"documents": (documents.join(held, "id", "left_anti").select(*documents.columns), buckets), "chunks": (left, buckets)})
        return held.count()

    def clear(self, collection: str) -> int:
        return self.remove(self.documents.where(F.col("collection") == collection).select("id"))

    def collections(self) -> DataFrame:
        return self.documents.groupBy("collection").agg(F.count("*").alias("documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))
