"""Line deduplication against a plain count of lines."""

import time
from collections import Counter

from gridframe.llm import line_dedup, queries

_UP = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(_UP)


def brute(rows, min_docs):
    split = [(i, (t or "").split("\n")) for i, t in rows]
    seen = Counter(k for _, lines in split for k in {key(x) for x in lines} if k)
    drop = {k for k, n in seen.items() if n >= min_docs}
    return sorted((str(i), len(x), sum(key(y) in drop for y in x), "\n".join(y for y in x if key(y) not in drop)) for i, x in split)


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.drop_common_lines(docs, **options).collect())


ROWS = [(i, f"Common Line\nown {i}\n\n  common line\t\nÉté") for i in range(12)] + [(20, None), (21, ""), (22, "\n"), (23, "no\nend\n"), (24, "COMMON LINE"), (25, "été\nÉTÉ"), (26, "same\nsame\nsame"), (27, ("row %d\n" * 3000) % tuple(range(3000)))]


def test_brute_force(spark):
    for least in (2, 10, 12, 13, 14):
        assert run(spark, ROWS, min_docs=least) == brute(ROWS, least), least


def test_hot_lines_are_broadcast_or_joined_alike(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MOST_HOT", 1)
    assert run(spark, ROWS, min_docs=3) == brute(ROWS, 3)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a\nb", 7, "x")] * 3 + [(None, "a\nc", None, None)], "doc_id long, text string, n_lines int, h1 string")
    out = line_dedup.drop_common_lines(docs, min_docs=4)
    assert sorted((r["text"], r["n_lines"], r["h1"] or "") for r in out.collect()) == [("b", 2, "x")] * 3 + [("c", 2, "")]
    assert line_dedup.drop_common_lines(docs.limit(0)).count() == 0


def test_runs_are_compacted(spark):
    store = line_dedup.LineRuns(spark, fanout=2)
    batches = [["a", "b"], ["b"], ["c"], ["a", "c"], ["d"]]
    hashed = lambda x: spark.createDataFrame([(y,) for y in x], "k string").select(line_dedup.line_hash(line_dedup.line_key(queries.F.col("k"))).alias("h"), "k").select("h.*", "k")
    for n, batch in enumerate(batches):
        new = {r["k"] for r in store.new_lines(hashed(batch)).collect()}
        assert new == set(batch) - {x for b in batches[:n] for x in b}
        store.add(hashed(batch))
    assert [len(x) for x in store.levels] == [1, 0, 1]
    assert sorted(r["n_docs"] for r in store.counts().collect()) == [1, 2, 2, 2]
    for name in store.runs():
        for part in spark.table(name).rdd.glom().collect():
            assert part == sorted(part)
    # Runs are merged and joined without a shuffle.
    plan = store.counts(2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    store.add(hashed(["b", "b", "b", "e"]), least=2, rows=4)
    settled = {r["n_docs"] for r in spark.table(store.levels[0][-1]).collect()} if store.levels[0] else set()
    assert sorted(r["n_docs"] for r in store.counts().collect()) == [1, 1, 2, 2, 5] and settled <= {1, 3}
    store.close()
    assert not store.runs()


def test_settled_lines_are_not_counted_again(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MOST_HOT", 1)
    store = line_dedup.LineRuns(spark, fanout=9)
    for batch in (["a"] * 3 + ["b"], ["a", "b", "c", "c"]):
        store.add(spark.createDataFrame([(ord(x), 0) for x in batch], "h1 long, h2 long"), least=3, rows=4)
    assert sorted(map(tuple, spark.table(store.runs()[-1]).collect())) == [(ord("b"), 0, 1), (ord("c"), 0, 2)]
    store.close()


def test_long_texts_take_time_in_proportion(spark):
    rows = [(i, "\n".join(f"line {j}" for j in range(100_000 if i < 2 else 50_000))) for i in range(4)]
    began = time.perf_counter()
    assert run(spark, rows, min_docs=3) == brute(rows, 3)
    assert time.perf_counter() - began < 60


def test_query(spark, sf, same_as_sql):
    same_as_sql(queries.op4_line_dedup(spark, sf), queries.ORACLES["op4_line_dedup"])
