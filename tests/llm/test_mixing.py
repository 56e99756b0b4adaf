"""Mixing: the query's SQL, and targets by pouring step by step."""

import random

import pytest

from gridframe.llm import mixing, queries


def poured(sizes, weights, epochs):
    """Targets of sources in order, by sharing the excess again and again."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weight[i] for i in open_)
        over = {i for i in open_ if left * weight[i] / total > epochs * sizes[i]}
        if not over:
            for i in open_:
                target[i] = left * weight[i] / total
            break
        for i in over:
            target[i] = float(epochs * sizes[i])
        left -= sum(target[i] for i in over)
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 5, 100, 3000, 10**6]) for _ in range(rng.randrange(1, 12))]
    rows = spark.createDataFrame([(f"s{i:02}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = [r["target"] for r in mixing.targets(rows).orderBy("source").collect()]
    assert got == pytest.approx(poured(sizes, (1, 2, 3), 3))


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two", None), (4, "x " * 50_000, "B"), (5, "w\u00a0x y\tz", "a"), (6, "dup", "c"), (6, "dup", "c"), (None, "no id here", "c")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, place string")
    out = mixing.mix(docs).collect()
    sizes = sorted((r["doc_id"] or 0, r["size"], r["source_size"]) for r in out)
    assert sizes == [(0, 3, 5), (1, 0, 3), (2, 0, 3), (3, 2, 2), (4, 50_000, 50_000), (5, 3, 3), (6, 1, 5), (6, 1, 5)]
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] and r["place"] == "x" for r in out)
    aims = {r["source"]: r["target"] for r in out}
    assert [aims[s] for s in ("B", "a", "c", None)] == pytest.approx(poured([50_000, 3, 5, 2], (1, 2, 3), 3))
    assert mixing.mix(docs.limit(0)).count() == 0
    nothing = mixing.mix(docs.where("doc_id < 3")).collect()
    assert len(nothing) == 2 and all(r["taken"] == 0 and r["target"] == 0 for r in nothing)


def test_taken_comes_near_the_target_and_reruns_agree(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), "abc"[i % 3] if i % 9 else "d") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    once = mixing.mix(docs.repartition(5)).select("doc_id", "taken")
    again = mixing.mix(docs.repartition(2)).select("doc_id", "taken")
    assert sorted(once.collect()) == sorted(again.collect())
    sums = mixing.mix(docs).groupBy("source").agg(mixing.F.sum("taken").alias("taken"), mixing.F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 40 for r in sums)


def test_repeat(spark):
    docs = spark.createDataFrame([(1, "a b c", "s"), (2, "a b c", "s")], "doc_id long, text string, source string")
    out = mixing.repeat(mixing.mix(docs, budget=3.0)).groupBy("doc_id").count().collect()
    assert sorted(map(tuple, out)) == [(1, 3), (2, 3)]


def test_plan_has_no_python(spark, sf):
    plan = queries.op7_mixing(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query(spark, sf, same_as_sql):
    same_as_sql(queries.op7_mixing(spark, sf), queries.ORACLES["op7_mixing"])
