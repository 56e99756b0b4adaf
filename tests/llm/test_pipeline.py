"""The pipeline's stages, one by one, against plain versions on their own input."""

import inspect

import corpus_pipeline
from gridframe.llm import mixing, queries, toxicity
from gridframe.llm._store import saved

from .test_decontaminate import words as bench_words
from .test_jaccard_join import brute as all_pairs
from .test_token_output import expected


def test_stages(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        seen.append(saved(stage(spark, seen[-1], sf), name))
    assert all(x.columns == docs.columns for x in seen[:-1])
    rows = [sorted((r["doc_id"], r["text"]) for r in x.select("doc_id", "text").collect()) for x in seen[:-1]]

    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~queries.held_out("doc_id"))
    model = toxicity.train(docs, labels)
    assert rows[1] == [(i, t) for i, t in rows[0] if model.score(t) < 0.3]

    assert [i for i, _ in rows[2]] == [i for i, _, c in all_pairs(rows[1], 5, 80) if i == c]

    wins = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = bench_words(r["text"])
        wins.update(tuple(w[i : i + 10]) for i in range(max(len(w) - 9, 1)) if w)
    sizes = {len(x) for x in wins}
    leaks = lambda w: any(tuple(w[i : i + n]) in wins for n in sizes for i in range(len(w) - n + 1))
    assert rows[3] == [(i, t) for i, t in rows[2] if not leaks(bench_words(t))]

    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(seen[3]).collect()}
    assert rows[4] == sorted((i, t) for i, t in rows[3] for _ in range(copies[i]))

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    tokenizer.encode_special_tokens = True
    assert sorted(map(tuple, seen[5].collect()), key=lambda r: r[1]) == expected(rows[4], tokenizer)
