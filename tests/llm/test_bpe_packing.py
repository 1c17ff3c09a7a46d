import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docsql.llm import bpe, packing

ODD = [None, "", " ", "\r\n\t ", "a" * 5000, "ab" * 3000, "<|endoftext|>", "I'LL we'll ''s", "x" * 300 + " " * 700 + "\n\n", "🙂" * 300, "\x1c\x1d\x85 y", "".join(map(chr, range(1, 1500)))]


@pytest.fixture(scope="module")
def table():
    return bpe.PairTable.load()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    return t


def test_same_as_library(spark, library):
    rows = [(i, t, i) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_ids(df).collect()}
    for i, t in enumerate(ODD):
        assert got[i] == library.encode(t or "", add_special_tokens=False).ids
    assert bpe.encode_ids(df.where("false")).count() == 0
    n = {r["doc_id"]: r["n_tokens"] for r in bpe.token_counts(df.drop("ids")).collect()}
    assert n == {i: len(x) for i, x in got.items()}


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    e = test_any_text.encoder = getattr(test_any_text, "encoder", None) or bpe.Encoder(bpe.PairTable.load())
    t = test_any_text.library = getattr(test_any_text, "library", None) or __import__("tokenizers").Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert e.encode([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_long_pieces_merge_alike(table):
    piece = b"abcabcaab" * 60
    short = bpe._merge_bucket([piece], table)[0]
    assert np.array_equal(short, bpe._merge_long(piece, table))


def best_fit(sizes, capacity):
    """Sequential best fit decreasing, one item after the other: the number of containers."""
    gaps, opened = [], 0
    for size in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= size]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - size)
        else:
            opened += 1
            gaps.append(capacity - size)
    return opened


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 39), max_size=80), st.integers(40, 60))
def test_sweep_is_best_fit(sizes, capacity):
    histogram = {s: sizes.count(s) for s in set(sizes)}
    runs = packing.sweep(histogram, capacity)
    held = {}
    for s, n in histogram.items():
        mine = [r for r in runs if r[0] == s]
        for rank in range(n):
            _, start, each, first = [r for r in mine if r[1] <= rank][-1]
            held[first + (rank - start) // each] = held.get(first + (rank - start) // each, 0) + s
    assert sum(held.values()) == sum(sizes) and max(held.values(), default=0) <= capacity
    assert len(held) == best_fit(sizes, capacity) and set(held) == set(range(len(held)))


def test_sweep_of_many_items_stays_small():
    assert len(packing.sweep({7: 10**12, 5: 10**12, 3: 10**12}, 100)) < 50


@pytest.mark.parametrize("parts", [1, 7])
def test_packing(spark, parts):
    rng = np.random.default_rng(3)
    sizes = [0, 1, 10, 10, 100, 101, 250, 99] + [int(x) for x in rng.integers(1, 90, 150)] + [33] * 70
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id bigint, n_tokens bigint").repartition(parts)
    got = packing.pack(df, [100, 40, None, 0, 40]).toPandas()
    for cap, q in got.groupby("capacity"):
        assert q.groupby("doc_id").n_tokens.sum().to_dict() == dict(enumerate(sizes))
        assert q[q.container.notna()].groupby("container").n_tokens.sum().max() <= cap
        cut = q.groupby("doc_id").size()
        assert all((cut[d] > 1) == (sizes[d] > cap) for d in cut.index)
        assert set(q[q.container.isna()].doc_id) == {0}
        assert q.container.nunique() == best_fit([int(n) for n in q.n_tokens if n], cap)
    assert packing.pack(df.where("false"), [10]).count() == 0


def test_two_vocabularies_in_one_session(spark, tmp_path):
    import json

    with open(bpe.VOCABULARY, encoding="utf-8") as f:
        whole = json.load(f)
    whole["model"]["merges"] = []
    (tmp_path / "none.json").write_text(json.dumps(whole), encoding="utf-8")
    df = spark.createDataFrame([(1, "hello world")], "doc_id bigint, text string")
    for _ in range(6):
        assert len(bpe.encode_ids(df).first()["ids"]) == 2 and len(bpe.encode_ids(df, path=str(tmp_path / "none.json")).first()["ids"]) == 11


def test_containers(spark):
    docs = spark.createDataFrame([(1, "one two three", 0), (1, "one two three", 0), (2, None, 0), (3, "word " * 50, 0), (None, "x", 0)], "doc_id bigint, text string, container int")
    w = spark.createDataFrame([("s", 16), ("t", 16), ("n", None)], "name string, capacity_tokens int")
    got = packing.containers(docs, w).toPandas()
    assert set(got.doc_id) == {1, 2, 3} and got[got.doc_id == 1].shape[0] == 1 and got[got.doc_id == 3].shape[0] == 4
