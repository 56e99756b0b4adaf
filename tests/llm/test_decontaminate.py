"""Decontamination against a plain search for every window."""

import re

from gridframe.llm import decontaminate, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    out = []
    for doc_id, text in docs:
        w, hit, named, longest = words(text), set(), set(), 0
        for item, passage in items:
            p = words(passage)
            n = min(window, len(p))
            wins = {tuple(p[i : i + n]) for i in range(len(p) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    named.add(item)
            for i in range(len(w)):
                for j in range(len(p)):
                    k = 0
                    while i + k < len(w) and j + k < len(p) and w[i + k] == p[j + k]:
                        k += 1
                    if n and k >= n:
                        longest = max(longest, k)
        out.append((doc_id, len(w), len(hit), sorted(x for x in named if x is not None), longest))
    return sorted(out)


def scored(spark, docs, items, window):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id string, text string")
    rows = decontaminate.contaminate_columns(d, b, window=window).select("doc_id", "contamination.*").collect()
    return sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["longest"]) for r in rows)


ITEMS = [("a", "The quick brown fox, jumps over it"), ("b", "brown fox jumps"), ("c", "x"), ("d", None), ("e", ""), ("f", "zero one two three zero one two three zero"), ("a", "other words stand here now")]
DOCS = [
    (1, "See: the QUICK brown fox jumps over it. And x!"), (2, None), (3, ""), (4, "zero one two three " * 5), (5, "quick brown"), (6, "brown-fox\njumps"),
    (7, "nothing of these"), (7, "nothing of these"), (8, "other words stand here, now other words stand"), (9, ("filler words only " * 3000) + "the quick brown fox jumps"), (10, "X"),
]


def test_brute_force(spark):
    for window in (1, 3, 4, 10):
        assert scored(spark, DOCS, ITEMS, window) == brute(DOCS, ITEMS, window), window


def test_items_that_share_a_passage(spark, monkeypatch):
    items = [("A", "a b c d"), ("B", "a b c e f g"), ("C", "x y z a b c e h x y z a b c e f q")]
    docs = [(1, "a b c e f g"), (2, "x y z a b c e f q"), (3, "b c e f g"), (4, "a b c d a b c e f g")]
    for most in (1 << 20, 1):
        monkeypatch.setattr(decontaminate, "MOST_FOLLOWED", most, raising=False)
        assert scored(spark, docs, items, 3) == brute(docs, items, 3)
    import pyarrow as pa

    tests = decontaminate.Windows([x for x, _ in items], pa.array([x for _, x in items]), 3)
    found = decontaminate._search(pa.array([x for _, x in docs]), tests, 3, None).to_pylist()
    assert [(x["longest"], x["longest_at"], x["longest_item"]) for x in found] == [(6, 0, "B"), (9, 0, "C"), (5, 0, "B"), (6, 4, "B")]


def test_several_blocks_and_shards(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 60)
    assert scored(spark, DOCS, ITEMS, 4) == brute(DOCS, ITEMS, 4)


def test_spans(spark):
    d = spark.createDataFrame([(1, "a b c x a b c")], "doc_id long, text string")
    b = spark.createDataFrame([("i", "a b c")], "item_id string, text string")
    c = decontaminate.contaminate_columns(d, b, window=3).first()["contamination"]
    assert [(s["start"], s["stop"]) for s in c["spans"]] == [(0, 3), (4, 7)] and c["longest_at"] == 0 and c["longest_item"] == "i"


def test_empty_tables_null_items_and_clashing_columns(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    docs = spark.createDataFrame([(1, "a b", 5, "s"), (2, "c d", None, None)], "doc_id long, text string, contamination int, item_id string")
    assert decontaminate.decontaminate(docs, none).count() == 2
    nameless = spark.createDataFrame([(None, "a b")], "item_id string, text string")
    left = decontaminate.decontaminate(docs, nameless, window=2)
    assert [r["doc_id"] for r in left.collect()] == [2] and left.columns == docs.columns
    assert decontaminate.contaminate_columns(docs.limit(0), nameless).count() == 0


def test_query(spark, sf, same_as_sql):
    same_as_sql(queries.op6_decontaminate(spark, sf), queries.ORACLES["op6_decontaminate"])
