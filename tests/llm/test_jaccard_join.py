"""The Jaccard join against all pairs."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from gridframe.llm import _store, jaccard_join, queries
from gridframe.llm._components import components
from gridframe.llm.queries import op5_jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n):
    w = WORD.findall(lowered(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, words, percent):
    """(id, set size, component) by comparing all pairs."""
    sets = [shingles(t, words) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                top[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows))


def joined(spark, rows, words, percent):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = jaccard_join.linked_documents(docs, words=words, percent=percent).select("doc_id", "n_shingles", "component_id")
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize(("words", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (3, 90, 3)])
def test_near_copies(spark, words, percent, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(18):
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 20, 60, 150, 400]) if i < 14 else 900 * (i - 13))
        rows.append(base)
        for _ in range(rng.randrange(9)):
            copy = list(rng.choice([base, rows[-1]]))
            for _ in range(rng.randrange(1 + len(copy) // 12)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = rng.choices(vocabulary, k=rng.randrange(2))
            rows.append(copy)
    data = [(i, rng.choice([" ", "\n"]).join(x)) for i, x in enumerate(rows)]
    assert joined(spark, data, words, percent) == brute(data, words, percent)


def test_a_passage_that_most_texts_share(spark):
    # Most share signatures with all others, but few are similar enough.
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(24)]
    data = []
    for i in range(900):
        own = [f"o{rng.randrange(60)}" for _ in range(rng.choice([2, 4, 8, 16]))]
        data.append((i, " ".join([*own[: len(own) // 2], *passage, *own[len(own) // 2 :]])))
    assert joined(spark, data, 4, 85) == brute(data, 4, 85)


def test_rarest_signatures_are_enough():
    # Linked sets share a signature of those that each keeps, whatever the others are.
    rng = random.Random(6)
    bands = jaccard_join.Bands(80)
    for _ in range(60):
        base = rng.choices([f"w{i}" for i in range(10**4)], k=rng.choice([6, 12, 30, 90, 300, 1200]))
        texts = [" ".join(base)]
        for _ in range(20):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(copy) // 40)):
                copy[rng.randrange(len(copy))] = "x"
            texts.append(" ".join(copy))
        rows = jaccard_join._features(pa.array(texts), 5, bands).to_pylist()
        uses = Counter(s for r in rows for s in {*r["own"], *r["below"]})
        rarest = lambda x, shared: set(sorted(x, key=lambda s: (uses[s], s))[: len(x) - shared + 1])
        kept = [rarest(r["own"], r["own_shared"]) | rarest(r["below"], r["below_shared"]) for r in rows]
        sets = [shingles(t, 5) for t in texts]
        for i in range(len(texts)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    assert kept[i] & kept[j]


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    data = [(0, " ".join(base))]
    for i in range(1, 120):
        copy = list(base)
        for at in rng.sample(range(120), rng.choice([0, 1, 2, 3])):
            copy[at] = f"x{rng.randrange(60)}"
        data.append((i, " ".join(copy)))
    assert joined(spark, data, 4, 85) == brute(data, 4, 85)


def family(seed):
    """Copies that insert and delete words, so that their sizes span several bands."""
    rng = random.Random(seed)
    base = [f"f{seed}w{i}" for i in range(rng.choice([22, 30, 40, 60, 80, 100]))]

    def edit(words, times):
        words = list(words)
        for _ in range(times):
            at, n = rng.randrange(len(words)), rng.randrange(1, 5)
            if rng.random() < 0.25 and len(words) > 15:
                del words[at : at + n]
            else:
                words[at:at] = [f"f{seed}x{rng.randrange(10**6)}" for _ in range(n)]
        return words

    cores = [base]
    for _ in range(rng.randrange(3)):
        cores.append(edit(base, 1))
    hubs = [edit(rng.choice(cores), rng.choice([1, 2])) for _ in range(rng.randrange(1, 4))]
    leaves = [edit(rng.choice(cores + hubs), rng.choice([1, 2, 3])) for _ in range(rng.randrange(2, 10))]
    return cores + hubs + leaves


def test_links_to_the_centre_of_a_family(spark):
    # In these, a node's only link leads to the centre of the centre it was checked with.
    rows = [x for seed in (349, 2787, 2908) for x in family(seed)]
    data = [(i, " ".join(x)) for i, x in enumerate(rows)]
    assert joined(spark, data, 4, 85) == brute(data, 4, 85)


def test_features_of_a_batch_that_ends_outside_a_scheme():
    # A last text that takes no part in a scheme below, in which others have many empty partitions.
    for seed in (1590, 2436):
        texts = [" ".join(x) for x in family(seed)]
        run = lambda some: jaccard_join._features(pa.array(some), 5, jaccard_join.Bands(80)).to_pylist()
        alone = [run([x])[0] for x in texts]
        for kind in ("own", "below"):
            assert [sorted(x[kind]) for x in run(texts)] == [sorted(x[kind]) for x in alone]


def test_edges(spark):
    long = " ".join(f"t{i * i % 7919}" for i in range(20_000))
    data = [(9, None), (8, ""), (7, " \t\n"), (6, "One two"), (5, "one  TWO"), (4, "one two three four"), (3, "ONE two three four"), (2, long), (1, long + " more"), (10, "Ä b c d"), (11, "ä b c d")]
    got = joined(spark, data, 4, 85)
    assert got == brute(data, 4, 85)
    assert {k: c for k, _, c in got}[9] == 9 and {k: c for k, _, c in got}[6] == 5


def test_repeated_rows_null_ids_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d", "s", 1), (1, "a b c d", "s", 2), (None, "a b c d", None, None), (2, "A B C D", "s", 3)], "doc_id long, text string, node string, n int")
    got = [tuple(r) for r in jaccard_join.linked_documents(docs, words=4, percent=85).select("doc_id", "component_id").collect()]
    assert sorted(got, key=str) == [(1, 1), (1, 1), (2, 1), (None, None)]
    kept = jaccard_join.keep_one_each(docs, words=4, percent=85)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [1]


def test_keeps_unlinked_texts_of_null_and_repeated_ids(spark):
    rows = [(1, "a b c d"), (1, "p q r s"), (None, "k l m n"), (None, "k l m n"), (None, "A b c d"), (None, "t u v w"), (2, "p q r s"), (3, ""), (3, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((tuple(r) for r in jaccard_join.keep_one_each(docs, words=4, percent=85).collect()), key=str)
    assert kept == sorted([(1, "a b c d"), (1, "p q r s"), (None, "k l m n"), (None, "t u v w"), (3, ""), (3, ""), (4, None)], key=str)


def test_empty_table(spark):
    assert joined(spark, [], 5, 80) == []


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in op5_jaccard_join(spark, sf).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(rows, 4, 85)


def test_components_of_stars_and_chains(spark, monkeypatch):
    edges = [(0, i) for i in range(1, 40)] + [(1000, i) for i in range(100, 140)] + [(i, i + 1) for i in range(200, 217)] + [(7, 7), (300, 301), (301, 300), (None, 5)]
    monkeypatch.setattr(_store, "MOST_HOT", 4)
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(40)} | {i: 100 for i in [1000, *range(100, 140)]} | {i: 200 for i in range(200, 218)} | {300: 300, 301: 300}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lookup_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(_store, "MOST_HOT", 3)
    rows = spark.createDataFrame([(i % 2 if i < 90 else i, i) for i in range(100)], "k long, i long")
    table = _store.saved(rows.groupBy("k").count().withColumn("v", queries.F.col("k") * 10), "t")
    for how in ("inner", "left"):
        got = _store.lookup(rows, table, "k", "count", how)
        assert got.columns == ["k", "i", "v"] and sorted((r["i"], r["v"]) for r in got.collect()) == [(i, 10 * (i % 2 if i < 90 else i)) for i in range(100)]


def test_lookup_without_a_hot_key_reads_rows_once(spark):
    # The largest key has more than 1 / 10,000 of the rows, but little of what a task gets.
    rows = spark.range(40_000).select(queries.F.when(queries.F.col("id") < 30, 0).otherwise(queries.F.col("id")).alias("k"), queries.F.col("id").alias("i"))
    table = _store.saved(rows.groupBy("k").count(), "t")
    got = _store.lookup(rows, table, "k", "count", drop=False)
    assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 40_000 and got.where("count = 30").count() == 30


def test_jobs_of_a_join(spark):
    # What the driver keeps grows with the jobs, however small they are.
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [x for seed in range(40, 46) for x in family(seed)]
    for _ in range(30):
        base = rng.choices(vocabulary, k=60)
        rows += [base, base[1:], [*base, "end"]]
    data = [(i, " ".join(x)) for i, x in enumerate(rows)]
    spark.sparkContext.setJobGroup("jobs-of-a-join", "")
    try:
        assert joined(spark, data, 4, 85) == brute(data, 4, 85)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("jobs-of-a-join"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 245
