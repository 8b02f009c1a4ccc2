import numpy as np
import pytest

from arkivist.llm import ann


def vectors(spark, seed=0, n=900, dims=16, clusters=0):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, dims)).astype(np.float32)
    if clusters:
        x = x * 0.1 + rnd.normal(size=(clusters, dims)).astype(np.float32)[rnd.integers(0, clusters, n)]
    x[50:80] = x[50]  # ties
    rows = [(i * 2, x[i].tolist(), 1) for i in range(n)]
    odd = [(100001, None, 1), (100002, [0.0] * dims, 1), (100003, [float("nan")] * dims, 1), (100004, [1.0, None] + [0.0] * (dims - 2), 1), (100005, [float("inf")] * dims, 1), (100006, [1.0] * 3, 1), (None, [1.0] * dims, 1), rows[7]]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int"), np.arange(n) * 2, x.astype(np.float64)


def brute(ids, x, k=20, every=20):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (x[i] * x).sum(axis=1)
        s[i] = -np.inf
        order = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
        out[int(ids[i])] = [(r + 1, int(ids[j]), s[j]) for r, j in enumerate(order)]
    return out


@pytest.mark.parametrize("clusters", [0, 12])
def test_all_nearest_are_found(spark, clusters, monkeypatch):
    monkeypatch.setattr(ann, "RUN", 64)
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "QUERIES", 20)
    frame, ids, x = vectors(spark, clusters=clusters)
    got = {}
    for r in ann.nearest(frame).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got == brute(ids, x)


def test_windows_alone_find_what_is_clustered(spark, monkeypatch):
    monkeypatch.setattr(ann, "RUN", 128)
    frame, ids, x = vectors(spark, 1, 1500, clusters=15)
    want = brute(ids, x)
    got = {}
    for r in ann.nearest(frame, complete=False).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = np.mean([len(got[q] & {v for _, v, _ in w}) / len(w) for q, w in want.items()])
    assert recall > 0.7


def test_few_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(frame).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 0.5), (0, 2, 3, 0.0), (20, 1, 0, 0.5), (20, 2, 3, 0.5)]
    assert ann.nearest(frame.filter("vec_id < 0")).count() == 0


def test_vectors_of_double_precision_and_of_several_lengths(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, (rnd.normal(size=3 if i % 4 == 1 or i in (20, 60) else 5) / 3).tolist(), "z", 1) for i in range(120)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, d string, v int")
    got = {}
    for r in ann.nearest(frame, k=6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = {}
    for size in (3, 5):
        own = [(i, x) for i, x, *_ in rows if len(x) == size]
        want |= brute(np.array([i for i, _ in own]), np.array([x for _, x in own]), 6)
    assert got == want
