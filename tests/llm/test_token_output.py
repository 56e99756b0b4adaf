"""Token ids: a round trip through the files against the tokenizer itself."""

import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from gridframe.llm import token_output
from gridframe.llm.queries import op3_token_output, tokenizer_path

SCHEMA = "doc_id long, text string, id string, start long"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


def expected(rows, tokenizer):
    """(doc_id, start, n_tokens, crc) of rows in order."""
    at, out = 0, []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from(["bit", "byte"]))
@settings(max_examples=60, deadline=None)
def test_planes_round_trip(ids, kind):
    ids = np.array(ids, np.uint32)
    index, payload = token_output.pack(ids, kind, zstandard.ZstdCompressor())
    assert index[-1] == len(payload)
    assert (token_output.unpack(index, payload, len(ids), kind, zstandard.ZstdDecompressor()) == ids).all()


@given(st.text(alphabet=st.sampled_from(list("aZé .,'\n\t  ’s0漢!_<|>ß")) | st.characters(codec="utf-8"), max_size=80))
@settings(max_examples=300, deadline=None)
def test_pieces_encode_as_the_whole_text(text):
    import pyarrow as pa
    from tokenizers import Tokenizer

    if not hasattr(test_pieces_encode_as_the_whole_text, "encoder"):
        with open(tokenizer_path(), encoding="utf-8") as f:
            test_pieces_encode_as_the_whole_text.encoder = token_output.Encoder(f.read())
        test_pieces_encode_as_the_whole_text.whole = Tokenizer.from_file(tokenizer_path())
        test_pieces_encode_as_the_whole_text.whole.encode_special_tokens = True
    encoder, whole = test_pieces_encode_as_the_whole_text.encoder, test_pieces_encode_as_the_whole_text.whole
    ids, sizes = encoder.encode(pa.array([text, None, text + text]))
    want = [whole.encode(x, add_special_tokens=False).ids for x in (text, "", text + text)]
    assert sizes.tolist() == [len(x) for x in want]
    assert ids.tolist() == [y for x in want for y in x]


def test_added_tokens_encode_as_the_library_does(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = ["plain text, here", "ends <|endoftext|> here", None, "<|endoftext|><|endoftext|>", "a<|endoftext|>b c", "<|endof text|>", "", "last one <|endoftext|>", "more"]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op3_token_output(spark, str(tmp_path)).collect()))
    assert got == expected(rows, Tokenizer.from_file(tokenizer_path()))


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_edges(spark, tokenizer, kind, tmp_path):
    long = "long words and numbers 12345, again\n" * 4000
    data = [(5, "a b"), (3, None), (1, ""), (2, long), (4, "ends <|endoftext|> here"), (6, "it's\r\n\n  two ")]
    docs = spark.createDataFrame([(i, t, "x", 9) for i, t in data], SCHEMA)
    path = f"file://{tmp_path}/ids"
    token_output.write_tokens(docs, path, tokenizer_path(), block_ids=1000, kind=kind)
    read = token_output.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    assert [tuple(r)[:4] for r in read] == expected(sorted(data), tokenizer)
    assert read[1]["ids"][:-1] == tokenizer.encode(long, add_special_tokens=False).ids


def test_repeated_and_null_ids(spark, tokenizer):
    docs = spark.createDataFrame([(1, "b"), (1, "b"), (None, "first"), (2, "c")], "doc_id long, text string")
    got = sorted(map(tuple, token_output.tokenize_and_read(docs, tokenizer_path()).collect()), key=lambda r: r[1])
    assert got == expected([(None, "first"), (1, "b"), (1, "b"), (2, "c")], tokenizer)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_output.tokenize_and_read(docs, tokenizer_path()).collect() == []


def test_query(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert sorted(map(tuple, op3_token_output(spark, sf).collect())) == expected(docs, tokenizer)


def test_known_pieces_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    from gridframe.llm import queries
    from gridframe.llm.token_output import Encoder

    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        encoder = Encoder(f.read())
    words = [f"w{i}" for i in range(40_000)]
    texts = pa.array([" ".join(words[i : i + 100]) for i in range(0, len(words), 100)])
    want = encoder.encode(texts)
    encoder._forget()
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    got = encoder.encode(texts)
    again = encoder.encode(texts)
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before - sum(x.nbytes for x in (*got, *again))
    tracemalloc.stop()
    assert len(encoder.known) >= len(words)
    assert held < 60 * len(encoder.known)
    assert all((a == b).all() and (a == c).all() for a, b, c in zip(want, got, again, strict=True))
