import itertools
import random
import re

import numpy as np
import pytest

from docsql.llm import hilbert, neardup, spans


def test_hilbert_curve_is_continuous():
    for dims, bits in ((2, 3), (3, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        key = hilbert.hilbert_index(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        way = cells[np.argsort(key)]
        assert (np.abs(np.diff(way, axis=0)).sum(1) == 1).all()


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id bigint, embedding array<float>")


def test_nearest(spark):
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((60, 64))
    v = np.concatenate([centers + 0.2 * rng.standard_normal((60, 64)) for _ in range(8)]) * rng.uniform(0.5, 3, (480, 1))
    rows = [(i, list(map(float, x))) for i, x in enumerate(v)]
    odd = [(1000, None), (1001, [0.0] * 64), (1002, [1.0]), (1003, [float("nan")] * 64), (None, rows[0][1]), rows[3], (1004, rows[4][1]), (1005, rows[4][1])]
    df = vectors(spark, rows + odd)
    u = np.concatenate([v, v[4:5], v[4:5]])
    u = (u / np.linalg.norm(u, axis=1, keepdims=True)).astype(np.float32)
    ids = np.array([*range(480), 1004, 1005])
    sim = u @ u.T
    np.fill_diagonal(sim, -2)
    exact = set()
    for i in range(len(ids)):
        for j in np.argsort(-sim[i], kind="stable")[:5]:
            if sim[i, j] >= 0.88:
                exact.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    got = {tuple(r) for r in hilbert.similar_pairs(df).collect()}
    assert len(got & exact) >= 0.9 * len(exact) and len(got - exact) <= 0.05 * len(exact)
    assert (4, 1004) in got and (1004, 1005) in got and not any(a == b for a, b in got)
    top = hilbert.nearest(df, asked="id % 20 = 0")
    assert {r["id"] for r in top.collect()} == {i for i in ids.tolist() if i % 20 == 0} and top.groupBy("id").count().where("count <> 5").count() == 0
    assert hilbert.similar_pairs(vectors(spark, [])).count() == 0 and hilbert.similar_pairs(vectors(spark, rows[:1])).count() == 0


def test_equal_vectors_are_one_class(spark):
    df = vectors(spark, [(i, [1.0] * 64) for i in range(5000)] + [(9000, [1.0] * 63 + [0.5])])
    got = hilbert.nearest(df, asked="id % 500 = 0").collect()
    for i in [*range(0, 5000, 500), 9000]:
        assert [r["neighbour"] for r in sorted((r for r in got if r["id"] == i), key=lambda r: r["rank"])] == [n for n in range(7) if n != i][:5]
    assert len(got) == 55 and hilbert.similar_pairs(df).count() == 15 + 4994 * 5 + 5


def test_dense_cells_are_cut_by_finer_curves():
    rng = np.random.default_rng(1)
    near = 1e-4 * rng.standard_normal((6000, 64)) + 3
    v = np.concatenate([rng.standard_normal((4000, 64)), near]).astype(np.float32)
    curve = hilbert.Curve(v, np.random.default_rng(2), 10)
    part, _ = curve.place(v)
    assert curve.finer and part.max() < curve.ranges and np.bincount(part).max() < 3000
    spark_free = hilbert.Curve(v[:1], np.random.default_rng(2), 4).place(v)[0]
    assert len(spark_free) == len(v)


def texts(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(n):
        t = [r.choice(words) for _ in range(r.randint(20, 60))]
        out.append(t)
        for _ in range(r.randint(0, 2)):
            u = list(t)
            for _ in range(r.randint(0, 4)):
                u[r.randrange(len(u))] = r.choice(words)
            out.append(u)
    return [" ".join(t) for t in out]


def jaccard_pairs(rows, t):
    sets = {}
    for i, title, content in rows:
        w = re.findall(r"[^\W_]+", ((title or "") + "\n" + (content or "")).lower())
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def test_frequencies_are_coded_in_a_byte():
    n = np.array([0, 1, 2, 31, 32, 33, 1000, 10**6, 2**31, 2**40])
    f = neardup.Frequencies(16, neardup.Frequencies.code(n))
    back = f.counts[f.codes]
    assert (back[:5] == n[:5]).all() and (back[:9] <= n[:9]).all() and (back[:8] * 1.1 >= n[:8]).all()


@pytest.mark.parametrize("hot, slice_size, bits", [(4096, 320, 26), (3, 320, 26), (4096, 9, 26), (3, 320, 4), (4096, 320, 0)])
def test_near_duplicates(spark, monkeypatch, hot, slice_size, bits):
    monkeypatch.setattr(neardup, "MOST_BITS", bits)
    monkeypatch.setattr(neardup, "LEAST_BITS", min(16, bits))
    if not bits:  # counted one by one
        monkeypatch.setattr(neardup, "CROWDED", 0)
    monkeypatch.setattr(neardup, "SLICE_SIZE", slice_size)
    monkeypatch.setattr(neardup, "HOT", hot)
    monkeypatch.setattr(neardup, "BLOCK", max(2, hot // 2))
    rows = [(f"d{i}", "a title" if i % 2 else None, t) for i, t in enumerate(texts(60, 1))]
    rows += [("e1", None, None), ("e2", "", ""), ("e3", "two", "words"), ("c1", "Same", "one text here, three words and more"), ("c2", "same", "ONE text here three words and more"), ("c3", "Same!", "one text here three words and more")]
    df = spark.createDataFrame([(*r, None) for r in rows] + [(*rows[5], None), (None, "x y z", "q", None)], "id string, title string, content string, received_at timestamp")
    for t in (0.6, 0.8):
        assert {tuple(r) for r in neardup.similar_records(df, t).collect()} == jaccard_pairs(rows, t)
    g = {r["id"]: r for r in neardup.record_groups(df, 0.6).collect()}
    assert len(g) == len(rows) and g["c1"]["group"] == g["c3"]["group"] == "c1" and g["c1"]["copies"] == 3 and g["e1"]["links"] == 0
    for a, b in jaccard_pairs(rows, 0.6):
        assert g[a]["group"] == g[b]["group"]
    assert neardup.similar_records(df.where("false"), 0.6).count() == 0 and neardup.record_groups(df.where("false")).count() == 0


def test_many_copies_star(spark, monkeypatch):
    monkeypatch.setattr(neardup, "COPIES_IN_PAIRS", 3)
    df = spark.createDataFrame([(f"c{i}", None, "the very same words again", None) for i in range(6)], "id string, title string, content string, received_at timestamp")
    assert {tuple(r) for r in neardup.similar_records(df, 0.6).collect()} == {("c0", f"c{i}") for i in range(1, 6)}


@pytest.mark.parametrize("in_memory", [64, 1])
def test_shared_spans(spark, monkeypatch, in_memory):
    monkeypatch.setattr(spans, "BLOCK", 2)
    monkeypatch.setattr(spans, "IN_MEMORY", in_memory)
    r = random.Random(2)
    rnd = lambda n: "".join(r.choice("abcdefgh é🙂") for _ in range(n))
    common, base = rnd(200), rnd(600)
    rows = [(1, rnd(300) + common + rnd(50)), (2, common), (3, common[:199]), (4, rnd(10) + common[1:] + rnd(300)), (5, base), (6, rnd(77) + base[100:450] + rnd(9)), (7, base[:320] + rnd(200)), (8, base), (9, None), (10, ""), (11, "z" * 900), (12, "z" * 450), (13, rnd(199))]
    df = spark.createDataFrame([(*x, "t") for x in rows] + [(*rows[0], "t"), (None, base, "t")], "doc_id bigint, text string, title string")
    have = {i: {t[k : k + 200] for k in range(len(t or "") - 199)} for i, t in rows if t}
    exact = {(a, b) for a, b in itertools.combinations(sorted(have), 2) if have[a] & have[b]}
    assert {tuple(x) for x in spans.sharing_pairs(df).collect()} == exact
    got = {x["doc_id"]: x for x in spans.shared_shares(df).collect()}
    stretches = spans.shared_stretches(df).collect()
    for i, t in rows:
        cover = np.zeros(len(t or ""), bool)
        for k in range(len(t or "") - 199):
            if any(t[k : k + 200] in h for j, h in have.items() if j != i):
                cover[k : k + 200] = True
        held = {(x["start"], x["length"]) for x in stretches if x["doc_id"] == i}
        edges = np.flatnonzero(np.diff(np.r_[False, cover, False].astype(int)))
        assert sum(n for _, n in held) == cover.sum() and {a for a, _ in held} >= set(edges[::2].tolist())
        assert got[i]["shared_chars"] == cover.sum() and got[i]["share"] == pytest.approx(cover.mean() if len(cover) else 0)
    assert spans.sharing_pairs(df.where("false")).count() == 0


def test_classes_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(spans, "COPIES_IN_PAIRS", 3)
    monkeypatch.setattr(neardup, "COPIES_IN_PAIRS", 3)
    r = random.Random(4)
    base = " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(80))
    rows = [(i, base) for i in range(6)] + [(10, base + " x1"), (11, base + " x1"), (20, "other " * 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    star = {(0, i) for i in range(1, 6)} | {(0, 10), (0, 11), (10, 11)}
    assert {tuple(x) for x in spans.sharing_pairs(df).collect()} == star
    records = df.selectExpr("cast(doc_id + 100 as string) as id", "text as content", "cast(null as string) as title", "current_timestamp() as received_at")
    assert {(int(a) - 100, int(b) - 100) for a, b in neardup.similar_records(records, 0.6).collect()} == star
