"""Stored conversations and memory: threads with their messages in order, and facts about a user that can be recalled.

Messages are appended; a thread is created with its first message or by its title, and is deleted with its messages.
Memory is a collection of the document store, and nothing here touches documents of another one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsql.functions.detectors import looks_secret
from docsql.operators.ingest import Store
from docsql.operators.retrieval import search, with_payload
from docsql.operators.snapshots import Snapshots
from docsql.runtime import cut

THREADS = "id string, title string, metadata string, created_at timestamp, updated_at timestamp"
MESSAGES = "thread_id string, id bigint, message string, created_at timestamp"


class Threads:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.files = Snapshots(spark, path, {"threads": (THREADS, "id"), "messages": (MESSAGES, "thread_id")}, buckets)

    @property
    def threads(self) -> DataFrame:
        return self.files.read("threads")

    @property
    def messages(self) -> DataFrame:
        """Messages; replayed in the order of their ids."""
        return self.files.read("messages")

    def append(self, rows: DataFrame) -> int:
        """Messages (thread_id, id, message, created_at); ids that are there already are skipped, so a repeated append changes nothing."""
        rows = rows.where("thread_id is not null and id is not null").select("thread_id", "id", "message", "created_at").dropDuplicates(["thread_id", "id"])
        buckets = self.files.touched(rows.select("thread_id"))
        if not buckets:
            return 0
        held = self.files.read("messages", buckets)
        new = cut(rows.join(held.select("thread_id", "id"), ["thread_id", "id"], "left_anti").select(*held.columns), "new-messages")
        heads = new.groupBy(F.col("thread_id").alias("id")).agg(F.min("created_at").alias("__first"), F.max("created_at").alias("__last"))
        threads = self.files.read("threads", buckets).join(heads, "id", "full_outer").select("id", "title", F.coalesce("metadata", F.lit("{}")).alias("metadata"), F.coalesce("created_at", "__first").alias("created_at"), F.greatest("updated_at", "__last").alias("updated_at"))
        n = new.count()
        if n:
            self.files.replace({"messages": (held.unionByName(new), buckets), "threads": (threads, buckets)})
        return n

    def rename(self, titles: DataFrame) -> None:
        """New titles (id, title, at); threads that are not there are created."""
        one = titles.where("id is not null").groupBy("id").agg(F.max_by("title", "at").alias("__t"), F.max("at").alias("__at"))
        buckets = self.files.touched(one.select("id"))
        both = self.files.read("threads", buckets).join(one, "id", "full_outer")
        self.files.replace({"threads": (both.select("id", F.coalesce("__t", "title").alias("title"), F.coalesce("metadata", F.lit("{}")).alias("metadata"), F.coalesce("created_at", "__at").alias("created_at"), F.greatest("updated_at", "__at").alias("updated_at")), buckets)})

    def delete(self, gone: DataFrame) -> int:
        """Threads (id) and their messages; gives how many threads there were."""
        held = cut(self.threads.join(gone.select("id").distinct(), "id", "left_semi").select("id"), "deleted")
        buckets = self.files.touched(held)
        if buckets:
            threads, messages = self.files.read("threads", buckets), self.files.read("messages", buckets)
            left = messages.join(held.select(F.col("id").alias("thread_id")), "thread_id", "left_anti").select(*messages.columns)
            self.files.replace({"threads": (threads.join(held, "id", "left_anti").select(*threads.columns), buckets), "messages": (left, buckets)})
        return held.count()


class Memory:
    """Facts in one collection of a store."""

    def __init__(self, store: Store, collection: str = "memory"):
        self.store, self.collection = store, collection

    def remember(self, facts: DataFrame) -> DataFrame:
        """Keeps facts (id, fact, replaces, at), one each, but no blank ones and none that look like a secret; what they replace is forgotten.

        Gives id, saved, replaced.
        """
        secret = F.coalesce(looks_secret(F.col("fact")), F.lit(True)) | (F.trim("fact") == "")
        judged = cut(facts.select("id", "fact", "replaces", "at", (~secret).alias("saved")), "facts")
        good = judged.where("saved")
        self.store.ingest(good.select("id", F.lit(self.collection).alias("collection"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("source"), F.to_json(F.struct(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("createdAt"))).alias("metadata"), F.col("fact").alias("content"), F.col("at").alias("received_at")))
        old = good.where("replaces is not null and replaces <> id").select(F.col("replaces").alias("id"))
        held = cut(self._own().join(old, "id", "left_semi").select("id"), "replaced")
        self.forget(held)
        return judged.join(held.select(F.col("id").alias("replaces"), F.lit(True).alias("replaced")), "replaces", "left").select("id", "saved", F.coalesce("replaced", F.lit(False)).alias("replaced"))

    def _own(self) -> DataFrame:
        return self.store.documents.where(F.col("collection") == self.collection)

    def forget(self, gone: DataFrame) -> int:
        """Forgets facts (id); documents of other collections stay."""
        return self.store.remove(self._own().join(gone.select("id").distinct(), "id", "left_semi").select("id"))

    def recall(self, queries: DataFrame, limit: int = 5) -> DataFrame:
        """query_id, id, fact, rank for queries (query_id, text)."""
        asked = queries.select("query_id", "text", self.store.embedder.vector(F.col("text")).alias("vector"))
        own = self.store.chunks.where(F.col("collection") == self.collection)
        mode = "hybrid" if self.store.vectors_ready else "keyword"
        hits = with_payload(search(asked, own, limit, mode, dims=self.store.embedder.dimensions), own, self._own())
        return hits.select("query_id", F.col("document_id").alias("id"), F.col("content").alias("fact"), "rank")

    def recent(self, n: int = 10) -> DataFrame:
        """The facts that were kept last: id, content."""
        own = self._own().orderBy(F.desc(F.get_json_object("metadata", "$.createdAt")), "id").limit(n)
        return own.select("id").join(self.store.chunks.select(F.col("document_id").alias("id"), "content", "ordinal"), "id").select("id", "ordinal", "content")
