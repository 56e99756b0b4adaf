"""Toxicity: accuracy on held-out labels, and edge rows."""

import random

import pandas as pd
import pytest

from gridframe.llm import queries, toxicity
from gridframe.llm.queries import F

SF = "/root/testdata/sf0.1"  # smaller tables have too few toxic labels to learn from


@pytest.fixture(scope="module")
def scored(spark):
    return queries.op2_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").toPandas()


def test_held_out_accuracy(scored):
    known = scored[scored.held_out & scored.toxic.notna()]
    assert len(known) > 50 and known.toxic.sum() > 3
    toxic, clean = known[known.toxic == 1].score.to_numpy(), known[known.toxic == 0].score.to_numpy()
    auc = ((toxic[:, None] > clean).mean() + (toxic[:, None] == clean).mean() / 2)
    assert auc >= 0.9
    assert known[known.toxic == 1].predicted.mean() >= 0.7
    assert known[known.toxic == 0].predicted.mean() <= 0.05


def test_shape(spark, scored):
    assert len(scored) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert scored.score.between(0, 1).all() and ((scored.score >= 0.3) == (scored.predicted == 1)).all()


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(queries.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    fits = [toxicity.train(docs, x.where(~queries.held_out("doc_id"))) for x in (labels, turned)]
    assert (fits[0].weights == fits[1].weights).all() and fits[0].pair.toxic == fits[1].pair.toxic


def test_edges(spark):
    docs = spark.createDataFrame([(i, ("you vile rotten fool " if i % 2 else "a calm sunny day ") * 9 + f"n{i}") for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "", 2), (4, " \n", 3), (None, "you vile rotten fool " * 5000, 3), (5, "a calm sunny day " * 40, 3)], "doc_id long, text string, score int")
    rows = {r["doc_id"]: r for r in toxicity.score(odd, model).collect()}
    assert rows[1]["score"] == rows[2]["score"] == rows[3]["score"] == rows[4]["score"]
    assert rows[None]["score"] > 0.5 > rows[5]["score"]
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_without_labels_or_with_one_class(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert all(r["score"] < 0.01 for r in toxicity.score(docs, toxicity.train(docs, none)).collect())
    assert all(r["score"] > 0.99 for r in toxicity.score(docs, toxicity.train(docs, one)).collect())


def test_phrases_of_ordinary_words():
    rng = random.Random(4)
    phrase = "go on and see if we do it to you or to him as a big red hat is not so far off".split()
    filler = [f"{a}{b}" for a in "bcdfgklmnp" for b in ("at", "en", "ip", "ox", "um")]

    def text(toxic):
        some = list(phrase)
        if not toxic:
            rng.shuffle(some)
        before, after = (rng.choices(filler, k=rng.randrange(5, 40)) for _ in "ab")
        return " ".join([*before, *some, *after])

    rows = pd.DataFrame([(i, text(i % 2), i % 2) for i in range(300)], columns=["id", "text", "label"])
    model = toxicity.fit(rows[:200])
    scores = [model.score(x) for x in rows["text"][200:]]
    assert sum(a > b for a in scores[1::2] for b in scores[0::2]) > 0.8 * 50 * 50
