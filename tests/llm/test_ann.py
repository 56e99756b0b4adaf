"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from gridframe.llm import ann
from gridframe.llm.queries import F, op10_ann


def exact(ids, x, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
        ranked = sorted((d[j], ids[j]) for j in range(len(ids)) if ids[j] != q)
        out[q] = ranked[:k]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(40, 32))[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 32))).astype(np.float32).astype(float)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    index, quantiser = ann.build(table, words=32, books=8)
    assert index.count() == 3000
    got = ann.search(index, quantiser, index.where("id % 50 = 0").select("id", "vector"), rerank=64, block=20)
    want = exact(list(range(3000)), x, range(0, 3000, 50), 10)
    rows = got.orderBy("query_id", "rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 11)) * 60
    hits = sum((pytest.approx(r["score"]), r["vec_id"]) in want[r["query_id"]] for r in rows)
    assert hits / len(rows) >= 0.9
    for r in rows[:200]:
        assert r["score"] == pytest.approx(np.sqrt(((x[r["query_id"]] - x[r["vec_id"]]) ** 2).sum()), rel=1e-12)


def test_codes_come_near_the_vectors():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    q = ann.train(x, books=6, words=32, rounds=2)
    left = ((x - q.decode(q.encode(x))) ** 2).mean()
    greedy = ann.Quantiser(q.books, beam=1)
    assert left < 0.3 * (x**2).mean() and left <= ((x - greedy.decode(greedy.encode(x))) ** 2).mean() + 1e-6


def test_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 2.0]), (5, None), (6, [0.0, 0.0]), (7, [None, 1.0]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (10, []), (11, [1.0]), (None, [1.0, 1.0])]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, codes string")
    index, quantiser = ann.build(table)
    assert sorted(r["id"] for r in index.collect()) == [1, 2, 3, 4]
    got = ann.search(index, quantiser, index.where("id IN (1, 4)").select("id", "vector"), k=10).orderBy("query_id", "rank").collect()
    far = pytest.approx(5**0.5)
    assert [tuple(r) for r in got] == [(1, 1, 2, 0.0), (1, 2, 3, 0.0), (1, 3, 4, far), (4, 1, 1, far), (4, 2, 2, far), (4, 3, 3, far)]
    index, quantiser = ann.build(table.limit(0))
    assert ann.search(index, quantiser, index.select("id", "vector")).count() == 0


def test_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").where(F.col("embedding").isNotNull()).collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    got = op10_ann(spark, sf).collect()
    want = exact(ids, x, sorted({r["query_id"] for r in got}), 10)
    assert {q for q in ids if q % 100 == 0} == set(want)
    assert sum(r["vec_id"] in {w for _, w in want[r["query_id"]]} for r in got) / len(got) >= 0.9
