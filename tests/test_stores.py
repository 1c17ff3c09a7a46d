import datetime as dt

import pytest
from pyspark.sql import functions as F

from docsql.operators import ingest, threads
from docsql.operators.snapshots import Snapshots

T0 = dt.datetime(2026, 1, 1)
INCOMING = "id string, collection string, title string, source string, metadata string, content string, received_at timestamp"


def docs(spark, rows):
    return spark.createDataFrame([(i, c, t, None, m, x, T0) for i, c, t, m, x in rows], INCOMING)


@pytest.fixture
def store(spark, tmp_path):
    return ingest.Store(spark, f"file://{tmp_path}/s", ingest.hash_embedder(8), size=40, overlap=5, buckets=3)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_ingest_in_buckets(spark, store):
    first = docs(spark, [("a", "x", "T", "{}", "one two"), ("b", "x", None, "{}", "word " * 30), ("c", "memory", None, '{"k":1}', "three"), ("d", "x", None, None, None)])
    assert store.ingest(first) == {"added": 3} and store.ingest(first) == {"skipped": 3}
    c = {r["id"]: r["chunk_count"] for r in store.documents.collect()}
    held = {r["document_id"]: r["n"] for r in store.chunks.groupBy("document_id").agg(F.count("*").alias("n")).collect()}
    assert c == held and c["a"] == 1 and c["b"] > 3
    assert store.chunks.where("size(embedding) = 8 and embedding_next is null").count() == sum(c.values())
    files = store.files.state()["tables"]["chunks"]
    assert store.ingest(docs(spark, [("a", "x", "T", '{"new":1}', "one two"), ("c", "memory", None, '{"k":1}', "other words")])) == {"metadata": 1, "changed": 1}
    after = store.files.state()["tables"]["chunks"]
    apart = {b for b in files if files[b] == after.get(b)}
    assert apart == set(files) - {str(b) for b in store.files.touched(spark.createDataFrame([("a",), ("c",)], "id string"))}
    assert {r["content"] for r in store.chunks.where("document_id = 'c'").collect()} == {"other words"}
    assert rows(store.collections()) == [("memory", 1, 1), ("x", 2, 1 + c["b"])]
    assert store.clear("x") == 2 and store.clear("x") == 0 and store.chunks.count() == 1
    assert store.ingest(docs(spark, [])) == {}


def test_reindex(spark, store, tmp_path):
    store.ingest(docs(spark, [(f"d{i}", "x", None, "{}", f"text {i}") for i in range(7)]))
    old = {r["chunk_id"]: r["embedding"] for r in store.chunks.collect()}
    wider = ingest.Store(spark, f"file://{tmp_path}/s", ingest.hash_embedder(16), size=40, overlap=5, buckets=3)
    with pytest.raises(ValueError):
        wider.ingest(docs(spark, [("e", "x", None, "{}", "new")]))
    assert wider.reindex_step() is None and wider.vectors_ready
    wider.begin_reindex()
    assert not wider.vectors_ready and wider.reindex_status()["done"] == 0
    assert wider.reindex_step(3)["done"] == 3
    assert {r["chunk_id"]: r["embedding"] for r in wider.chunks.collect()} == old
    assert wider.ingest(docs(spark, [("e", "x", None, "{}", "new")])) == {"added": 1}
    assert wider.chunks.where("document_id = 'e' and embedding is null and size(embedding_next) = 16").count() == 1
    assert wider.reindex_status() == {"from": {"id": "hash-8", "dimensions": 8}, "to": {"id": "hash-16", "dimensions": 16}, "done": 4, "total": 8}
    store.begin_reindex()  # back to the first embedder: what only the other one had is filled
    assert store.vectors_ready and store.chunks.where("size(embedding) = 8 and embedding_next is null").count() == 8
    wider.begin_reindex()
    while wider.reindex_step(3):
        pass
    assert wider.vectors_ready and wider.chunks.where("size(embedding) = 16 and embedding_next is null").count() == 8
    assert store.reindex() == 8 and store.chunks.where("size(embedding) = 8").count() == 8
    lying = ingest.Store(spark, f"file://{tmp_path}/t", ingest.Embedder("lies", 9, lambda t: F.array(F.lit(1.0))))
    with pytest.raises(Exception, match="another size"):
        lying.ingest(docs(spark, [("e", "x", None, "{}", "new")]))


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/k", {"t": ("k string, v int", "k")}, 2)
    assert s.get("a") is None and s.read("t").count() == 0
    s.put(a=1)
    s.put(b=[2])
    assert (s.get("a"), s.get("b"), s.state()["version"]) == (1, [2], 2)
    ran = []
    steps = [lambda _: ran.append(1), lambda _: ran.append(2)]
    assert s.migrate("m", steps[:1]) == 1 and s.migrate("m", steps) == 1 and s.migrate("m", steps) == 0 and ran == [1, 2]
    for i in range(6):
        s.replace({"t": (spark.createDataFrame([("x", i)], "k string, v int"), [0, 1])})
    assert rows(s.read("t")) == [("x", 5)] and len(s._numbers()) == 3
    assert len(list((tmp_path / "k").glob("run-*"))) == 3
    stale = s.state() | {"version": 3}
    with pytest.raises(RuntimeError):
        s._commit(stale | {"version": s.state()["version"] - 1})


def test_threads(spark, tmp_path):
    t = threads.Threads(spark, f"file://{tmp_path}/c", 2)
    m = spark.createDataFrame([("a", 1, "x", T0), ("a", 2, "y", T0 + dt.timedelta(1)), ("a", 2, "y", T0), ("b", 3, "z", T0), (None, 4, "n", T0)], threads.MESSAGES)
    assert t.append(m) == 3 and t.append(m) == 0 and t.append(m.where("false")) == 0
    t.rename(spark.createDataFrame([("a", "A", T0), ("c", "C", T0)], "id string, title string, at timestamp"))
    assert rows(t.threads.select("id", "title")) == [("a", "A"), ("b", None), ("c", "C")]
    assert [r["message"] for r in t.messages.where("thread_id = 'a'").orderBy("id").collect()] == ["x", "y"]
    assert t.delete(spark.createDataFrame([("a",), ("q",)], "id string")) == 1 and rows(t.messages.select("id")) == [(3,)]


def test_memory(spark, store):
    store.ingest(docs(spark, [("doc", "x", None, "{}", "likes tea too")]))
    m = threads.Memory(store)
    fact = "id string, fact string, replaces string, at timestamp"
    got = m.remember(spark.createDataFrame([("m1", "The user likes green tea", None, T0), ("m2", "password is Tr0ub4dor&3", None, T0), ("m3", " ", None, T0)], fact))
    assert rows(got) == [("m1", True, False), ("m2", False, False), ("m3", False, False)]
    later = T0 + dt.timedelta(1)
    assert rows(m.remember(spark.createDataFrame([("m4", "The user likes black tea now", "m1", later), ("m5", "Lives in Bergen", "doc", later)], fact))) == [("m4", True, True), ("m5", True, False)]
    assert [r["id"] for r in m.recent(5).collect()] == ["m4", "m5"] and store.documents.where("id = 'doc'").count() == 1
    q = spark.createDataFrame([(1, "which tea")], "query_id bigint, text string")
    assert m.recall(q, 1).first()["id"] == "m4"
    assert m.forget(spark.createDataFrame([("m4",), ("doc",)], "id string")) == 1 and store.documents.where("id = 'doc'").count() == 1
