import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from docsql.operators import chunking, evaluation, ingest, ordered, retrieval
from docsql.runtime import cut, one_per_key, shared_dir
from docsql.streaming import windows


def test_chunks(spark):
    assert chunking.chunk_text("  \r\n ") == [] and chunking.chunk_text(None) == [] and chunking.chunk_text("a\r\nb") == ["a\nb"]
    text = "# A\n\n" + "word " * 100 + "\n\n# B\n\n" + "x" * 500
    for size in (50, 120, 400):
        got = chunking.chunk_text(text, size, 20)
        assert "".join("".join(got).split()) != "" and all(len(c) <= size + 21 for c in got)
        assert set(text.split()) - {"x" * 500} <= set(" ".join(got).split())
    df = spark.createDataFrame([("a", text, 1), ("b", None, 2), ("c", " ", 3)], "id string, content string, ordinal int")
    assert {r["id"] for r in chunking.chunks(df, "id", "content").collect()} == {"a"}


def test_column_letters(spark):
    df = spark.createDataFrame([(1,), (26,), (27,), (52,), (702,), (703,), (18278,)], "n int")
    assert [r[0] for r in df.select(chunking.column_letter(F.col("n"))).collect()] == ["A", "Z", "AA", "AZ", "ZZ", "AAA", "ZZZ"]


DOC = "id string, collection string, title string, source string, metadata string, content string, received_at timestamp"
T0 = datetime.datetime(2026, 1, 1)


def test_store(spark):
    store = ingest.Store(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    docs = [("a", "x", "t", None, None, "one " * 500, T0), ("b", "x", None, "s", "{}", "two", T0), (None, None, None, "s3", None, "three", T0), ("c", "y", None, None, None, None, T0), ("b", "x", None, "s", "{}", "two!", T0 + datetime.timedelta(1))]
    df = spark.createDataFrame(docs, DOC)
    assert store.ingest(df) == {"added": 3} and store.ingest(df) == {"skipped": 3}
    assert {r["content"] for r in store.documents.where("id = 'b'").collect()} == {"two!"}
    n = store.chunks.where("document_id = 'a'").count()
    assert n > 1
    assert store.ingest(spark.createDataFrame([("a", "x", "t", None, '{"k":1}', "one " * 500, T0), ("b", "x", None, "s", "{}", "new", T0)], DOC)) == {"metadata": 1, "changed": 1}
    assert store.chunks.where("document_id = 'a'").count() == n and store.documents.count() == 3
    assert store.clear("x") == 2 and store.documents.count() == 1 and store.chunks.count() == 1
    assert store.remove(store.documents.where("false")) == 0
    assert store.ingest(spark.createDataFrame([], DOC)) == {}


def test_search_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.standard_normal((60, 8))
    rows = [(i, list(map(float, x))) for i, x in enumerate(v)] + [(60, None), (61, [0.0] * 8), (62, [1.0]), (63, list(map(float, v[0])))]
    c = spark.createDataFrame(rows, "chunk_id bigint, embedding array<double>")
    q = spark.createDataFrame([(i, list(map(float, v[i]))) for i in range(5)] + [(9, None), (8, [0.0] * 8)], "query_id bigint, vector array<double>")
    got = retrieval.semantic_top(q, c, 4, 8).orderBy("query_id", "rank").collect()
    u = np.array([np.array(x) / np.linalg.norm(x) for _, x in rows[:60]] + [v[0] / np.linalg.norm(v[0])])
    key = [*range(60), 63]
    for i in range(5):
        sim = u @ u[i]
        best = sorted(range(61), key=lambda j: (-round(sim[j], 12), key[j]))[:4]
        assert [r["chunk_id"] for r in got if r["query_id"] == i] == [key[j] for j in best]
    assert {r["query_id"] for r in got} == set(range(5))
    assert retrieval.semantic_top(q, c.where("false"), 4, 8).count() == 0


def test_search_modes_and_relevance(spark):
    c = spark.createDataFrame([(1, "tide table of the harbour", [1.0, 0.0]), (2, "boiler room", [0.9, 0.1]), (3, None, [0.0, 1.0]), (4, "", None)], "chunk_id bigint, content string, embedding array<double>")
    q = spark.createDataFrame([(1, "tide table", [1.0, 0.0]), (2, None, None), (3, "boiler", None)], "query_id bigint, text string, vector array<double>")
    hits = retrieval.search(q, c, 2, dims=2)
    assert [(r["query_id"], r["chunk_id"]) for r in hits.orderBy("query_id", "rank").collect()] == [(1, 1), (1, 2), (3, 2)]
    assert {r["chunk_id"] for r in retrieval.search(q, c, 2, "keyword", dims=2).collect()} == {1, 2}
    assert retrieval.relevant(retrieval.search(q, c, 3, "vector", dims=2)).where("query_id = 1").count() == 2
    low = spark.createDataFrame([(1, 1, 0.33, 1), (1, 2, 0.1, 2), (2, 5, 0.2, 1)], "query_id bigint, chunk_id bigint, similarity double, rank int")
    kw = spark.createDataFrame([(1, 1, 2), (2, 5, 1)], "query_id bigint, chunk_id bigint, rank int")
    assert retrieval.relevant(low).count() == 0
    assert [tuple(r)[:2] for r in retrieval.rescued(low, kw).select("query_id", "chunk_id").collect()] == [(1, 1)]
    scored = low.withColumn("rerank_score", F.lit(0.2))
    assert retrieval.relevant(scored).count() == 3 and retrieval.rerank(scored.withColumn("s", -F.col("rank")), "s", 1).count() == 2


def test_budget(spark):
    df = spark.createDataFrame([(1, 1, 50), (1, 2, 60), (1, 3, 10), (2, 1, 500), (2, 2, 1)], "query_id int, rank int, size int")
    assert sorted(tuple(r)[:2] for r in retrieval.within_budget(df, "size", 100).select("query_id", "rank").collect()) == [(1, 1), (2, 1)]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "z", 1)], "query_id int, doc_id string, rank int")
    relevant = spark.createDataFrame([(1, "b"), (1, "c"), (2, "q"), (3, "x")], "query_id int, doc_id string")
    got = {r["query_id"]: r for r in evaluation.retrieval_metrics(ranked, relevant, 5).collect()}
    assert got[1]["recall"] == 0.5 and got[1]["reciprocal_rank"] == 0.5 and got[2]["recall"] == 0 and got[3]["ndcg"] == 0


def test_previous_and_runs(spark):
    rows = [("t" if i % 3 else "u", i, "a" if (i // 5) % 2 else "b") for i in range(200)] + [(None, 1, "a"), (None, 2, "a")]
    df = spark.createDataFrame(rows, "k string, n int, v string")
    got = {(r["k"], r["n"]): r["prev_v"] for r in ordered.with_previous(df, ["k"], ["n"], ["v"]).collect()}
    last: dict = {}
    exp, runs = {}, 0
    for k, n, v in sorted(rows, key=lambda r: r[1]):
        exp[k, n] = last.get(k)
        runs += last.get(k) != v
        last[k] = v
    assert got == exp
    assert ordered.merged_runs(df, ["k"], ["n"], "v").count() == runs
    assert ordered.with_previous(df.where("false"), ["k"], ["n"], ["v"]).count() == 0


def test_helpers(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), (None, 3, "z"), ("b", None, "y")], "id string, t int, v string")
    assert sorted((r["id"], r["v"]) for r in one_per_key(df, "id", "t").collect()) == [("a", None), ("b", "y")]
    assert cut(df).count() == 4


@pytest.mark.parametrize("n, exp", [(0, []), (100, [(0, 100)]), (300, [(0, 300)]), (301, [(0, 300), (250, 301)]), (550, [(0, 300), (250, 550)]), (551, [(0, 300), (250, 550), (500, 551)])])
def test_sample_windows(spark, n, exp):
    got = spark.createDataFrame([(n,)], "n bigint").select(windows.sample_windows(F.col("n"), 10).alias("w")).first()["w"]
    assert [tuple(w) for w in got] == exp


def test_stitching(spark):
    assert windows.words_after_overlap("we met at noon", "met at noon, and left") == "and left" and windows.words_after_overlap("a b", "c d") is None
    seg = lambda a, z, t: (float(a), float(z), t)
    rows = [("x", 0.0, 30.0, [seg(0, 5, "one two"), seg(24, 29.9, "three four fi")]), ("x", 25.0, 55.0, [seg(25, 31, "three four five"), seg(31, 34, "six")]), ("y", 0.0, 30.0, None)]
    df = spark.createDataFrame(rows, "audio_id string, start double, end double, segments array<struct<start:double,end:double,text:string>>")
    assert [r["text"] for r in windows.stitched(df).orderBy("start").collect()] == ["one two", "three four fi", "six"]


def test_registry_without_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['docsql.llm'] = None\nimport __spark_entry__ as e\nassert not any(q in e.queries() for q in ('p1_found', 'p8_ids')) and 'p4_found' in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(__import__("pathlib").Path(__file__).parents[1]))


def test_stitched_transcripts_of_whole_texts(spark, tmp_path):
    import hashlib

    from docsql.plans import pipelines

    said = {n: [f"Sentence number {k} of {n}." for k in range(n)] for n in (1, 6, 7, 12, 13, 40)}
    rows = [(n, " ".join(x), sum(map(len, x)) + n - 1) for n, x in said.items()] + [(99, None, None), (98, "", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((int(r["audio_id"]), r["start"], r["end"], r["hash"]) for r in pipelines.stitched_transcripts(spark, str(tmp_path)).collect())
    assert got == [(n, k * 5.0, k * 5.0 + 5, hashlib.sha256(t.encode()).hexdigest()) for n, x in sorted(said.items()) for k, t in enumerate(x)]
