"""Set-oriented hybrid retrieval: many queries at once, each against all chunks in scope.

Scope filters stand below the candidate limits. Every ranking is a per-query `row_number <= k`, which Spark evaluates with
a group limit before the shuffle, so no query's candidates are gathered whole. Contents are fetched after the fusion.

Queries are a stated set; they are compared with the chunks in blocks (an Arrow function that holds the block of queries,
QUERY_BLOCK at a time), not by a cross join.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsql.functions import detectors
from docsql.functions.numeric import cosine, rrf
from docsql.functions.text import label, query_terms
from docsql.runtime import cut

QUERY_BLOCK = 4096  # queries sent to the workers at once: at most 4096 * 8 * dims bytes
FLOOR = 0.35  # fixed value: similarity below which a hit is off topic


def candidates(limit: int) -> int:
    return max(4 * limit, 20)


def top_k(score: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of scores, ties to the smaller key. Only rows with many ties at the border are sorted whole."""
    if score.shape[1] > k:
        kth = np.partition(score, score.shape[1] - k, axis=1)[:, -k, None]
        tied = int((score >= kth).sum(1).max())
        if tied < score.shape[1]:
            near = np.argpartition(-score, tied - 1, axis=1)[:, :tied]
            score, keys = np.take_along_axis(score, near, 1), np.take_along_axis(keys, near, 1)
    order = np.lexsort((keys, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(keys, order, 1)


class _Best:
    """The best k of each query so far, over the batches of a task."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.score, self.keys = np.empty((len(queries), 0)), np.empty((len(queries), 0), np.int64)

    def add(self, score: np.ndarray, keys: np.ndarray) -> None:
        keys = np.broadcast_to(keys, score.shape)
        self.score, self.keys = top_k(np.concatenate([self.score, score], 1), np.concatenate([self.keys, keys], 1), self.k)

    def rows(self, name: str) -> pa.RecordBatch:
        good = np.isfinite(self.score)
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(self.queries[:, None], good.shape)[good]), pa.array(self.keys[good]), pa.array(self.score[good])], ["query_id", "chunk_id", name])


def _blocks(queries: DataFrame) -> Iterator[pa.Table]:
    """The stated queries, QUERY_BLOCK at a time."""
    n = queries.count()
    parts = max(1, -(-n // QUERY_BLOCK))
    for b in range(parts):
        yield (queries if parts == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == b)).toArrow()


def _ranked(frames: list[DataFrame], name: str, k: int) -> DataFrame:
    out = functools.reduce(DataFrame.unionByName, frames)
    w = Window.partitionBy("query_id").orderBy(F.desc(name), "chunk_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def semantic_top(queries: DataFrame, chunks: DataFrame, k: int, dims: int = 64) -> DataFrame:
    """query_id, chunk_id, similarity, rank for queries (query_id, vector) and chunks (chunk_id, embedding): exact top k by cosine, ties by id.

    Vectors that are null, zero or of another length are left out. Queries are read in blocks; chunks are streamed once
    a block and each task keeps its best k per query, so the shuffle holds k rows a query and task.
    """
    frames = []
    for table in _blocks(queries.where("vector is not null").select("query_id", "vector")):
        ids = np.array(table.column("query_id").to_pylist(), np.int64)
        vectors = [np.asarray(v, np.float64) for v in table.column("vector").to_pylist()]
        ok = [i for i, v in enumerate(vectors) if len(v) == dims and np.isfinite(v).all() and np.any(v)]
        q = np.array([vectors[i] / np.linalg.norm(vectors[i]) for i in ok]).reshape(-1, dims)
        shared = queries.sparkSession.sparkContext.broadcast((ids[ok], q))  # QUERY_BLOCK vectors at the most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, q = shared.value
            best = _Best(qid, k)
            for batch in batches:
                c = batch.column("embedding")
                good = np.flatnonzero(np.asarray(c.is_valid()) & (np.diff(c.offsets.to_numpy()) == dims))
                if not len(good) or not len(qid):
                    continue
                v = c.values.to_numpy(zero_copy_only=False).astype(np.float64)[c.offsets.to_numpy()[:-1][good][:, None] + np.arange(dims)]
                length = np.sqrt((v * v).sum(1))
                fine = np.isfinite(length) & (length > 0)
                best.add(q @ (v[fine] / length[fine, None]).T, batch.column("chunk_id").to_numpy()[good][fine])
            yield best.rows("similarity")

        frames.append(chunks.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "query_id bigint, chunk_id bigint, similarity double"))
    return _ranked(frames, "similarity", k)


_terms = re.compile(r"[^\W_]+").findall


def keyword_top(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score, rank for queries (query_id, text) and chunks (chunk_id, content): any term matches.

    score: the share of the query's terms found, and the density of their occurrences. A block of queries is an index from
    terms to queries; the chunks stream past it, a term at a time, so a word that all queries and chunks have costs one
    addition of a matrix block a batch, and no pair of query and chunk leaves the task but the best k.
    """
    frames = []
    asked = queries.select("query_id", query_terms(F.col("text")).alias("terms")).where(F.size("terms") > 0)
    for table in _blocks(asked):
        ids, terms = np.array(table.column("query_id").to_pylist(), np.int64), table.column("terms").to_pylist()
        index: dict[str, list[int]] = {}
        for i, ws in enumerate(terms):
            for w in ws:
                index.setdefault(w, []).append(i)
        shared = queries.sparkSession.sparkContext.broadcast((ids, np.array([len(ws) for ws in terms], np.float64), {w: np.array(at) for w, at in index.items()}))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, size, index = shared.value
            best = _Best(ids, k)
            for batch in batches:
                for a in range(0, batch.num_rows, 500):
                    part = batch.slice(a, 500)
                    posted: dict[str, dict[int, int]] = {}
                    for d, text in enumerate(part.column("content").to_pylist()):
                        for w in _terms((text or "").lower()):
                            if w in index:
                                at = posted.setdefault(w, {})
                                at[d] = at.get(d, 0) + 1
                    met, times = np.zeros((len(ids), part.num_rows)), np.zeros((len(ids), part.num_rows))
                    for w, at in posted.items():
                        cells = np.ix_(index[w], np.fromiter(at, np.int64, len(at)))
                        met[cells] += 1
                        times[cells] += np.fromiter(at.values(), np.float64, len(at))
                    if len(ids):
                        best.add(np.where(met > 0, met / size[:, None] + times / (times + 100.0), -np.inf), part.column("chunk_id").to_numpy())
            yield best.rows("score")

        frames.append(chunks.where("content is not null").select(F.col("chunk_id").cast("bigint").alias("chunk_id"), "content").mapInArrow(run, "query_id bigint, chunk_id bigint, score double"))
    return _ranked(frames, "score", k)


def scope_of(available: list[str], configured: list[str] | None = None, asked: list[str] | None = None, exclude: tuple[str, ...] = ("memory",)) -> list[str]:
    """Collections to search: the configured ones, or all, of them the asked ones, without the excluded."""
    return [c for c in (available if configured is None else configured) if (asked is None or c in asked) and c not in exclude]


def in_scope(chunks: DataFrame, collections: list[str] | None = None, documents: DataFrame | list[str] | None = None, exclude: tuple[str, ...] = ("memory",)) -> DataFrame:
    """The chunks that may be searched; filters stand below every limit. documents: ids, as a list or, for many, as a frame (document_id)."""
    if collections is not None:
        chunks = chunks.where(F.col("collection").isin([c for c in collections if c not in exclude]))
    elif exclude:
        chunks = chunks.where(F.col("collection").isNull() | ~F.col("collection").isin(*exclude))
    if documents is None:
        return chunks
    if isinstance(documents, DataFrame):
        return chunks.join(documents.select("document_id").distinct(), "document_id", "left_semi")
    return chunks.where(F.col("document_id").isin(documents))


def search(queries: DataFrame, chunks: DataFrame, limit: int = 8, mode: str = "hybrid", min_similarity: float | None = None, dims: int = 64) -> DataFrame:
    """query_id, chunk_id, score, similarity, rank: reciprocal rank fusion of vectors and keywords.

    queries: query_id, text, vector; chunks: chunk_id, content, embedding. mode: hybrid, vector or keyword. The minimum
    similarity is applied after the limit, so fewer rows may come; a hit without similarity, as all of a keyword search,
    passes. A hybrid hit that only keywords found gets its similarity all the same, from its own vector.
    """
    limit = min(100, max(1, limit))
    take = candidates(limit)
    sides = []
    if mode != "keyword":
        sides.append(semantic_top(queries.select("query_id", "vector"), chunks, take, dims).select("query_id", "chunk_id", "similarity", rrf(F.col("rank")).alias("s")))
    if mode != "vector":
        sides.append(keyword_top(queries, chunks, take).select("query_id", "chunk_id", F.lit(None).cast("double").alias("similarity"), rrf(F.col("rank")).alias("s")))
    both = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])  # the full outer join on the chunk, as one aggregate
    fused = both.groupBy("query_id", "chunk_id").agg(F.sum("s").alias("score"), F.max("similarity").alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "chunk_id")
    top = fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    if mode == "hybrid":
        vectors = top.join(queries.select("query_id", "vector"), "query_id", "left").join(chunks.select("chunk_id", "embedding"), "chunk_id", "left")
        top = vectors.select("query_id", "chunk_id", "score", F.coalesce("similarity", cosine(F.col("vector"), F.col("embedding"))).alias("similarity"), "rank")
    return top if min_similarity is None else top.where(F.coalesce("similarity", F.lit(1.0)) >= min_similarity)


def given(**values: object) -> Column:
    """Every column has the value given for it; a value of None asks for nothing."""
    return functools.reduce(lambda a, kv: a & (F.col(kv[0]) == kv[1]), ((k, v) for k, v in values.items() if v is not None), F.lit(True))


class Memo:
    """Results that were made before, by what was asked: frames are written once and read again. When MOST are held, all are let go."""

    MOST = 32

    def __init__(self) -> None:
        self.held: dict[tuple, DataFrame] = {}

    def get(self, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        if key not in self.held:
            if len(self.held) >= self.MOST:
                self.held.clear()
            self.held[key] = cut(make(), "memo")
        return self.held[key]


def mode_of(asked: str | None, default: str | None = None, vectors_ready: bool = True) -> str:
    """hybrid, vector or keyword: the asked mode, else the default one; keyword while vectors are being made anew."""
    return (asked or default or "hybrid") if vectors_ready else "keyword"


def with_payload(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """hits with document_id, collection, ordinal, content of the chunk, and title, source, metadata of its document (id)."""
    c = chunks.select("chunk_id", "document_id", "collection", "ordinal", "content")
    d = documents.select(F.col("id").alias("document_id"), "title", "source", "metadata")
    return hits.join(c, "chunk_id").join(d, "document_id")


def rerank(hits: DataFrame, score: str, limit: int) -> DataFrame:
    """Hits in the order of a reranker's score, ties in the order they had."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "rank")
    return hits.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= limit).drop("rank").withColumnRenamed("__r", "rank")


def rerank_candidates(limit: int, option: int | None = None) -> int:
    return min(option if option is not None else max(3 * limit, 24), 60)


def lexical_score(query: Column, document: Column) -> Column:
    """A reranker without a model: the share of a query's terms that a document has, between 0 and 1."""
    asked = query_terms(query)
    return F.coalesce(F.size(F.array_intersect(asked, query_terms(document))) / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0))


def search_reranked(queries: DataFrame, chunks: DataFrame, documents: DataFrame, score: Callable[[Column, Column], Column] | None, limit: int = 8, mode: str = "hybrid", option: int | None = None, min_similarity: float | None = None, dims: int = 64) -> DataFrame:
    """search() with payload and, where there is a reranker, rerank_score: more candidates are found, judged by score(query, title and
    content), and cut to the limit. Keyword searches, and queries with a single hit, are not judged."""
    limit = min(100, max(1, limit))
    judge = score is not None and mode != "keyword"
    found = with_payload(search(queries, chunks, rerank_candidates(limit, option) if judge else limit, mode, min_similarity, dims), chunks, documents)
    if not judge:
        return found
    body = F.concat(F.when(F.col("title") != "", F.concat("title", F.lit("\n"))).otherwise(F.lit("")), "content")
    several = F.count("*").over(Window.partitionBy("query_id")) > 1
    judged = found.join(queries.select("query_id", F.col("text").alias("__q")), "query_id").withColumn("rerank_score", F.when(several, score(F.col("__q"), F.coalesce(body, "content")))).drop("__q")
    return rerank(judged, "rerank_score", limit)


def relevant(hits: DataFrame, floor: float = FLOOR, share: float = 0.5, min_rerank: float = 0.15, vectors_ready: bool = True) -> DataFrame:
    """What is on topic. With rerank scores: those of at least min_rerank. Else none below the floor, and from the best down only the upper share."""
    w = Window.partitionBy("query_id")
    if "rerank_score" in hits.columns:
        judged = hits.withColumn("__any", F.max(F.col("rerank_score").isNotNull()).over(w))
    else:
        judged = hits.withColumn("rerank_score", F.lit(None).cast("double")).withColumn("__any", F.lit(False))
    best = F.max(F.coalesce("similarity", F.lit(0.0))).over(w)
    judged = judged.withColumn("__best", best)
    by_vector = (F.col("__best") >= floor) & (F.coalesce("similarity", F.lit(0.0)) >= floor + (F.col("__best") - floor) * share) if vectors_ready else F.col("rank") <= 2
    return judged.where(F.when(F.col("__any"), F.coalesce("rerank_score", F.lit(0.0)) >= min_rerank).otherwise(by_vector)).drop("__any", "__best", *([] if "rerank_score" in hits.columns else ["rerank_score"]))


def rescued(hits: DataFrame, keyword: DataFrame, floor: float = FLOOR, margin: float = 0.1) -> DataFrame:
    """The best vector hit of each query that is just below the floor, where keyword search has the same chunk among its first three."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("similarity", F.lit(0.0))), "rank")
    best = hits.withColumn("__r", F.row_number().over(w)).where((F.col("__r") == 1) & (F.coalesce("similarity", F.lit(0.0)) >= floor - (1 - floor) * margin)).drop("__r")
    return best.join(keyword.where("rank <= 3").select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")


def role_hops(found: DataFrame, asked: DataFrame, chunks: DataFrame, documents: DataFrame, embed: Callable[[Column], Column], floor: float = FLOOR, dims: int = 64) -> DataFrame:
    """found with one more hit for each of up to two role titles, which the best passage of a question for a person names and the question
    does not: the best vector match of the title, if it is above the floor and of a document that is not there yet."""
    first = found.where("rank = 1").join(asked.select("query_id", F.col("text").alias("__q")), "query_id").where(F.col("__q").rlike(f"(?i){detectors.ASKS_PERSON}"))
    titles = first.select("query_id", F.posexplode(F.slice(detectors.role_titles(F.col("content"), F.col("__q")), 1, 2)).alias("n", "title"))
    named = titles.select((F.xxhash64("query_id", "n")).alias("hop"), "query_id", "n", "title")
    top = semantic_top(named.select(F.col("hop").alias("query_id"), embed(F.col("title")).alias("vector")), chunks, 1, dims).where(F.col("similarity") >= floor)
    hits = with_payload(top.select(F.col("query_id").alias("hop"), "chunk_id", "similarity"), chunks, documents).join(named.select("hop", "query_id", "n"), "hop")
    new = hits.join(found.select("query_id", "document_id").distinct(), ["query_id", "document_id"], "left_anti")
    once = new.withColumn("__r", F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy("n"))).where("__r = 1")
    last = found.groupBy("query_id").agg(F.max("rank").alias("__last"))
    more = once.join(last, "query_id").withColumn("rank", F.col("__last") + F.col("n") + 1).withColumn("score", F.lit(None).cast("double"))
    out = found.unionByName(more.select(*[c if c in more.columns else F.lit(None).alias(c) for c in found.columns]))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def retrieve(asked: DataFrame, chunks: DataFrame, documents: DataFrame, embed: Callable[[Column], Column], limit: int = 3, floor: float = FLOOR, min_similarity: float = 0.2, dims: int = 64, short: int = 12) -> DataFrame:
    """The passages for messages (query_id, latest, previous), in stages, each for the messages that are still without any.

    1. what is relevant for the latest message; 2. for a short one, what is relevant with the previous message before it;
    3. the best hit of the first stage just below the floor, if keyword search agrees. Then role titles are followed, and
    passages that address an assistant stay only where they are the best. embed gives the vector of a text.
    """
    query = lambda text: asked.select("query_id", text.alias("text"), embed(text).alias("vector"))
    ask = lambda q: cut(with_payload(search(q, chunks, limit, "hybrid", min_similarity, dims), chunks, documents), "hits")
    without = lambda q, found: q.join(found.select("query_id").distinct(), "query_id", "left_anti")
    latest = cut(query(F.col("latest")), "asked")
    hits = ask(latest)
    found = cut(relevant(hits, floor), "found")
    follow_up = asked.where(F.col("previous").isNotNull() & (F.size(F.split(F.trim("latest"), r"\s+")) <= short)).select("query_id", F.concat("previous", F.lit("\n"), "latest").alias("text"))
    again = cut(without(follow_up, found).withColumn("vector", embed(F.col("text"))), "asked-again")
    second = cut(relevant(ask(again), floor), "found-again")
    both = found.unionByName(second)
    silent = without(latest, both)
    third = rescued(hits.join(silent.select("query_id"), "query_id", "left_semi"), keyword_top(silent, chunks, 3), floor)
    every = cut(both.unionByName(third), "retrieved")
    used = latest.select("query_id", "text").join(second.select("query_id").distinct(), "query_id", "left_anti").unionByName(again.select("query_id", "text").join(second.select("query_id").distinct(), "query_id", "left_semi"))
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return without_injected(role_hops(ranked, used, chunks, documents, embed, floor, dims))


def passages(hits: DataFrame, most: int = 3600, number: str = "rank") -> DataFrame:
    """query_id, text: the leading hits (content, title, source, document_id) as numbered passages within `most` characters; the first always stays.

    A passage that addresses an assistant is told without those lines, and marked.
    """
    injected = F.coalesce(detectors.looks_injected(F.col("content")), F.lit(False))
    mark = F.when(injected, F.lit(" " + detectors.UNTRUSTED)).otherwise(F.lit(""))
    body = F.when(injected, detectors.redact_injections(F.col("content"))).otherwise(F.col("content"))
    block = F.concat(F.lit("["), F.col(number).cast("string"), F.lit("] "), label(F.col("title"), F.col("source"), F.col("document_id")), mark, F.lit("\n"), body, F.lit("\n\n"))
    fit = within_budget(hits.withColumn("__b", block).withColumn("__s", F.length("__b")), "__s", most)
    parts = F.array_sort(F.collect_list(F.struct("rank", "__b")))  # at most `most` characters and one passage
    return fit.groupBy("query_id").agg(F.trim(F.array_join(F.transform(parts, lambda p: p["__b"]), "")).alias("text")).withColumn("text", F.regexp_replace("text", r"\s+$", ""))


def without_injected(hits: DataFrame, content: str = "content") -> DataFrame:
    """Passages that address an assistant only stay where they are the best hit."""
    return hits.where((F.col("rank") == 1) | ~F.coalesce(detectors.looks_injected(F.col(content)), F.lit(False)))


def within_budget(hits: DataFrame, size: str, most: int, keys: tuple[str, ...] = ("query_id",), order: str = "rank") -> DataFrame:
    """The leading rows of each group whose sizes add up to no more than `most`; the first always stays."""
    w = Window.partitionBy(*keys).orderBy(order)
    used = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = hits.withColumn("__over", F.when((F.row_number().over(w) > 1) & (used > most), 1).otherwise(0))
    stopped = F.max("__over").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("__stop", stopped).where("__stop = 0").drop("__over", "__stop")


def numbered(citations: DataFrame, run: str, order: list[str], key: list[str]) -> DataFrame:
    """Numbers citations within each run by the first appearance of their key: run, key, n."""
    first = citations.groupBy(run, *key).agg(F.min(F.struct(*order)).alias("__first"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy(run).orderBy("__first"))).drop("__first")
