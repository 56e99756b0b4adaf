"""Token ids in a compressed binary format: plane-shuffled blocks with a chunk index.

**Writing.** The documents are ordered by id over ranges, one *shard* per range.  A shard
is one stream of ids, each document followed by an end id, cut into blocks of
``block_ids`` ids; only a shard's last block is shorter.  A block is transposed into planes (bit
planes, or byte planes), so that the rarely used high bits of neighbouring ids lie
together, and each plane is compressed by zstandard on its own.

**Format.** One record per block, kept as a Parquet table that Spark's committer writes
(so a lost executor leaves no half-written file, and any store that Spark knows will do):

=========  ==========================================================
``shard``  number of the range of ids, ascending
``chunk``  number of the block in its shard
``first``  ids of the shard before this block
``n_ids``  ids in this block
``kind``   ``bit`` or ``byte``
``index``  where each plane begins in ``payload``, and its end
``payload``  the compressed planes, lowest first
``docs``   documents that begin in this block: id, start in the shard, number of ids
=========  ==========================================================

**Reading** decodes a shard's blocks in order and cuts the stream at the documents.
A reader of one range of ids needs only the blocks whose ``first`` and ``n_ids`` cover it.

Texts are encoded in pieces that are cut where the pre-tokenizer always ends a token, so
pieces encode as they do in the whole text.  A Python worker encodes a piece once and
then looks it up, in any of its tasks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import saved, scratch, ready_python
from ._words import slices

#: Text bytes in a shard, about.
SHARD_BYTES = 256 << 20
#: Pieces that a Python worker remembers with their ids.
MOST_KNOWN = 500_000

FORMAT = "shard int, chunk int, first long, n_ids int, kind string, index array<int>, payload binary, docs array<struct<id: long, start: long, n: long>>"
_BLOCK = pa.schema([
    ("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("kind", pa.string()), ("index", pa.list_(pa.int32())),
    ("payload", pa.binary()), ("docs", pa.list_(pa.struct([("id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())]))),
])
_READ = pa.schema([("shard", pa.int32()), ("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest first; those above the largest id are left out."""
    top = int(ids.max()) if ids.size else 0
    if kind == "bit":
        return [np.packbits((ids >> np.uint32(b)).astype(np.uint8) & 1).tobytes() for b in range(max(1, top.bit_length()))]
    return [row.tobytes() for row in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T[: max(1, (top.bit_length() + 7) // 8)]]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The inverse of ``to_planes``."""
    if kind == "bit":
        ids = np.zeros(n, np.uint32)
        for b, plane in enumerate(planes):
            ids |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n).astype(np.uint32) << np.uint32(b)
        return ids
    cells = np.zeros((n, 4), np.uint8)
    for b, plane in enumerate(planes):
        cells[:, b] = np.frombuffer(plane, np.uint8)
    return cells.view("<u4").ravel()


def pack(ids: np.ndarray, kind: str, compressor: zstandard.ZstdCompressor) -> tuple[list[int], bytes]:
    """A block's chunk index and payload."""
    planes = [compressor.compress(x) for x in to_planes(ids, kind)]
    return np.cumsum([0, *map(len, planes)]).tolist(), b"".join(planes)


def unpack(index: list[int], payload: bytes, n: int, kind: str, decompressor: zstandard.ZstdDecompressor) -> np.ndarray:
    return from_planes([decompressor.decompress(payload[a:b]) for a, b in zip(index[:-1], index[1:], strict=True)], n, kind)


# Kinds of bytes at which texts may be cut into pieces.
_LETTER, _MARK, _AFTER = np.zeros(256, bool), np.zeros(256, bool), np.ones(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_MARK[39] = False
_AFTER[:33] = False
_AFTER[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False


def piece_starts(raw: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pieces of texts start; ``begins``: where the texts that are not empty do.

    Only places where the pre-tokenizer ends a token whatever stands around: before a space
    that plain text follows, between a letter and a mark, before a line's end after a letter or
    mark, and between such an end and a letter.
    """
    space, line = raw == 32, raw == 10
    letter, mark = _LETTER[raw], _MARK[raw]
    cut = np.zeros(len(raw), bool)
    cut[:-1] = space[:-1] & _AFTER[raw[1:]]
    ends = line[1:] & (letter[:-1] | mark[:-1])
    cut[1:] |= (letter[:-1] & mark[1:]) | ends
    cut[2:] |= ends[:-1] & letter[2:]
    cut[begins] = True
    return np.flatnonzero(cut)


def _byte_letters() -> dict[int, str]:
    """The character that the byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Encodes columns of whole texts to one array of ids and the number of ids of each."""

    def __init__(self, tokenizer_json: str, added_tokens: bool = False):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = not added_tokens
        kind = json.loads(tokenizer_json)
        split = kind.get("pre_tokenizer") or {}
        #: Whether a word is one token of the pre-tokenizer, so that the model alone can encode it.
        self.plain = kind["model"]["type"] == "BPE" and not kind.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and not kind["model"].get("ignore_merges")
        self.letters = _byte_letters()
        #: Texts with an added token are encoded whole: what stands around it decides how it is found.
        added = [x["content"] for x in kind.get("added_tokens") or [] if added_tokens and x["content"]]
        plain_added = all(not x.get("normalized") or not kind.get("normalizer") for x in kind.get("added_tokens") or [])
        self.added = (re.compile("|".join(map(re.escape, added))) if plain_added else re.compile("")) if added else None
        self._forget()

    def _forget(self) -> None:
        #: A tenth of what the same texts take as keys of a dict.
        self.known = pa.array([], pa.large_string())
        self.ids, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _lists(self, pieces: list[str]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        rest = []
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        for i, x in enumerate(pieces):
            if self.plain and (x[1:] if x[0] == " " else x).isalpha():
                word = x.replace(" ", letters[32]) if x.isascii() else x.encode().decode("latin-1").translate(letters)
                out[i] = [t.id for t in tokenize(word)]
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _codes(self, pieces: pa.LargeStringArray) -> np.ndarray:
        """The number of each of the pieces, which are distinct; ``ids`` and ``bounds`` then hold all known ones."""
        found = pc.index_in(pieces, value_set=self.known)
        if found.null_count and len(self.known) + found.null_count > MOST_KNOWN:
            self._forget()
            found = pa.nulls(len(pieces), pa.int32())
        fresh = pieces.filter(pc.is_null(found))
        codes = pc.fill_null(found, 0).to_numpy().astype(np.int64)
        codes[found.is_null().to_numpy(zero_copy_only=False)] = np.arange(len(self.known), len(self.known) + len(fresh))
        ids, bounds = [self.ids], [self.bounds]
        for at in range(0, len(fresh), 20_000):
            lists = self._lists(fresh.slice(at, 20_000).to_pylist())
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            ids.append(np.fromiter((y for x in lists for y in x), np.uint32, int(sizes.sum())))
            bounds.append(bounds[-1][-1] + np.cumsum(sizes))
        if len(fresh):
            self.known, self.ids, self.bounds = pa.concat_arrays([self.known, fresh]), np.concatenate(ids), np.concatenate(bounds)
        return codes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pa.array(pc.fill_null(texts.cast(pa.large_string()), ""))
        if self.added is None:
            return self._in_pieces(texts)
        marked = np.flatnonzero(pc.match_substring_regex(texts, self.added.pattern).to_numpy(zero_copy_only=False))
        if not marked.size:
            return self._in_pieces(texts)
        plain = np.ones(len(texts), bool)
        plain[marked] = False
        ids, some = self._in_pieces(pc.if_else(pa.array(plain), texts, pa.scalar("", pa.large_string())))
        sizes, parts, at = some.copy(), [], 0
        ends = np.cumsum(some)
        for i in marked:
            # One text at a time; the others are empty here.
            own = np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
            parts += [ids[at : ends[i]], own]
            at, sizes[i] = ends[i], len(own)
        return np.concatenate([*parts, ids[at:]]), sizes

    def _in_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or offsets[-1] == offsets[0]:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        at = piece_starts(raw, offsets[:-1][offsets[:-1] < offsets[1:]])
        pieces = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.r_[at, len(raw)].astype(np.int64)), pa.py_buffer(raw.tobytes())).dictionary_encode()
        code = self._codes(pieces.dictionary)[pieces.indices.to_numpy()]
        ids, bounds = self.ids, self.bounds
        size = bounds[code + 1] - bounds[code]
        before = np.cumsum(size) - size
        out = ids[np.arange(int(size.sum())) - np.repeat(before, size) + np.repeat(bounds[code], size)]
        owner = np.searchsorted(offsets, at, side="right") - 1
        return out, np.bincount(owner, weights=size, minlength=len(texts)).astype(np.int64)


_encoders: dict[tuple[int, bool], Encoder] = {}


def _encoder(tokenizer_json: str, added_tokens: bool) -> Encoder:
    """This worker's encoder; what it remembers helps its later tasks."""
    key = zlib.crc32(tokenizer_json.encode()), added_tokens
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokenizer_json, added_tokens)
    return _encoders[key]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, block_ids: int = 1 << 16, kind: str = "byte", level: int = 3, added_tokens: bool = False) -> None:
    """Encodes the whole texts in ascending order of their ids and writes the format above to ``path``.

    Null texts count as empty and have only the end id.  Rows without an id come first; rows
    with the same id follow each other, ordered by a digest of their text.  An empty table
    writes an empty table.  Columns other than the two are not read.  With ``added_tokens``, what
    a text holds of the tokenizer's added tokens is one id each, as by the library's default.
    """
    spark = docs.sparkSession
    ready_python(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SHARD_BYTES + 1))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encoder, compressor = _encoder(sent.value, added_tokens), zstandard.ZstdCompressor(level=level)
        waiting, held, docs_here, first, position, chunk = [], 0, [], 0, 0, 0

        def block(ids: np.ndarray, begun: list) -> pa.RecordBatch:
            index, payload = pack(ids, kind, compressor)
            row = {"shard": shard, "chunk": chunk, "first": first, "n_ids": len(ids), "kind": kind, "index": index, "payload": payload, "docs": begun}
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

        for batch in slices(batches, "text", 4 << 20):
            ids, sizes = encoder.encode(batch.column("text"))
            pa.default_memory_pool().release_unused()  # else it keeps the most that any batch took
            ends = np.cumsum(sizes)
            ids = np.insert(ids, ends, end_id).astype(np.uint32)
            starts = position + np.r_[0, np.cumsum(sizes + 1)]
            docs_here += [{"id": i, "start": int(s), "n": int(n) + 1} for i, s, n in zip(batch.column("id").to_pylist(), starts[:-1], sizes, strict=True)]
            position = int(starts[-1])
            waiting.append(ids)
            held += len(ids)
            if held >= block_ids:
                whole = np.concatenate(waiting)
                done = 0
                while held - done >= block_ids:
                    edge = first + block_ids
                    n = next((i for i, d in enumerate(docs_here) if d["start"] >= edge), len(docs_here))
                    yield block(whole[done : done + block_ids], docs_here[:n])
                    docs_here, first, chunk, done = docs_here[n:], edge, chunk + 1, done + block_ids
                waiting, held = [whole[done:]], held - done
        if held:
            yield block(np.concatenate(waiting), docs_here)

    ranged = rows.repartitionByRange(shards, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    ranged.mapInArrow(encode, FORMAT).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Reads the format back: ``id, start, n_tokens, ids_crc32`` per document, in the files' terms.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is the CRC-32 of the
    document's ids as little-endian unsigned 32-bit numbers.  ``with_ids`` adds the ids.
    """
    blocks = spark.read.schema(FORMAT).parquet(path)
    kind = pa.schema([*_READ, ("ids", pa.list_(pa.int64()))]) if with_ids else _READ

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = zstandard.ZstdDecompressor()
        shard, open_, position = None, [], 0  # documents not ended yet: [id, start, n, crc, parts]
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    assert not open_, f"shard {shard} is cut off"
                    shard, position = row["shard"], 0
                assert row["first"] == position, f"shard {shard} lacks a block before {row['chunk']}"
                ids = unpack(row["index"], row["payload"], row["n_ids"], row["kind"], decompressor)
                open_ += [[d["id"], d["start"], d["n"], 0, []] for d in row["docs"]]
                end, rest = position + len(ids), []
                for d in open_:
                    a, b = max(d[1], position) - position, min(d[1] + d[2], end) - position
                    part = ids[a:b]
                    d[3] = zlib.crc32(part.astype("<u4").tobytes(), d[3])
                    if with_ids:
                        d[4].append(part)
                    if d[1] + d[2] > end:
                        rest.append(d)
                    else:
                        out.append((shard, *d[:4], *([np.concatenate(d[4]).tolist()] if with_ids else [])))
                open_, position = rest, end
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)
        assert not open_, f"shard {shard} is cut off"

    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "shard int, id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    decoded = blocks.repartition(parts, "shard").sortWithinPartitions("shard", "chunk").mapInArrow(decode, schema)
    out = decoded.join(saved(base, "shard-bases"), "shard")
    return out.select("id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def tokenize_and_read(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", **options) -> DataFrame:
    """Writes the documents' ids to the shared folder and reads them back from there."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, id_col=id_col, **options)
    return read_tokens(docs.sparkSession, path).withColumnRenamed("id", id_col)
