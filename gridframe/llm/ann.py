"""Approximate nearest neighbours by additive quantisation.

A vector is written as a sum of one codeword from each of ``books`` codebooks; every
codeword has the full dimension.  The books are learned on a bounded sample, first one
after the other on what the earlier ones leave, then together by least squares between
rounds of encoding.  Encoding is a beam search over the books.  The index holds for each
vector its codes, the squared norm of the sum they stand for, and the vector.

A query is scored from tables of its inner products with all codewords, one lookup per
book, plus the stored norm.  In each part of the index the best by score are measured
exactly, and the nearest of all parts are kept.  Queries are broadcast in blocks of a
fixed size and meet all rows of the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import ready_python, saved

#: Queries that are broadcast at once.
BLOCK = 4096
#: Rows of the index that are scored at once.
ROWS = 8192


@dataclass
class Quantiser:
    """Codebooks as an array ``books x words x dimension``."""

    books: np.ndarray
    beam: int = 4

    def __post_init__(self):
        m, k, d = self.books.shape
        self.flat = self.books.reshape(m * k, d)
        self.gram = (self.flat @ self.flat.T).reshape(m * k, m, k)
        self.norms = np.einsum("ij,ij->i", self.flat, self.flat).reshape(m, k)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """The codes of the rows of ``x``, by beam search."""
        m, k, _ = self.books.shape
        n = len(x)
        inner = (x @ self.flat.T).reshape(n, m, k)
        codes, cost, cross = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1)), np.zeros((n, 1, m, k), np.float32)
        for book in range(m):
            # |x - s - c|^2 grows by |c|^2 - 2 x.c + 2 s.c, with s what is chosen so far.
            step = cost[:, :, None] + self.norms[book] - 2 * inner[:, None, book] + 2 * cross[:, :, book]
            flat = step.reshape(n, -1)
            keep = min(self.beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            of, word = best // k, best % k
            row = np.arange(n)[:, None]
            cost = flat[row, best]
            codes = np.concatenate([codes[row, of], word[:, :, None]], 2)
            if book + 1 < m:
                cross = cross[row, of] + self.gram[book * k + word]
        return codes[np.arange(n), cost.argmin(1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[b][codes[:, b]] for b in range(codes.shape[1]))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    if len(centres) < k:
        centres = np.concatenate([centres, np.zeros((k - len(centres), x.shape[1]), x.dtype)])
    for _ in range(rounds):
        near = (np.einsum("ij,ij->i", centres, centres) - 2 * x @ centres.T).argmin(1)
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = count > 0
        centres[full] = sums[full] / count[full, None]
    return centres


def train(x: np.ndarray, *, books: int = 16, words: int = 128, beam: int = 4, rounds: int = 2, seed: int = 7) -> Quantiser:
    """Codebooks for the rows of ``x`` (float32)."""
    rng = np.random.default_rng(seed)
    words = max(1, min(words, len(x)))
    left, found = x.copy(), []
    for _ in range(books):
        c = _kmeans(left, words, rng)
        near = (np.einsum("ij,ij->i", c, c) - 2 * left @ c.T).argmin(1)
        left -= c[near]
        found.append(c)
    q = Quantiser(np.stack(found).astype(np.float32), beam)
    for _ in range(rounds):
        codes = np.concatenate([q.encode(x[i : i + 512]) for i in range(0, len(x), 512)])
        # The best books for these codes: normal equations of a sparse 0/1 matrix, slightly ridged.
        place = codes + np.arange(books) * words
        a = np.zeros((books * words, books * words), np.float32)
        b = np.zeros((books * words, x.shape[1]), np.float32)
        for i in range(books):
            np.add.at(b, place[:, i], x)
            for j in range(books):
                np.add.at(a, (place[:, i], place[:, j]), 1)
        a[np.diag_indices_from(a)] += 0.1
        better = np.linalg.solve(a, b + 0.1 * q.flat).reshape(books, words, -1)
        q = Quantiser(better.astype(np.float32), beam)
    return q


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector`` of the vectors that take part: finite, not null, not zero."""
    ok = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where("id IS NOT NULL AND vector IS NOT NULL").where(ok & F.exists("vector", lambda x: x != 0))


def build(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", most_rows: int = 10_000, **options) -> tuple[DataFrame, Quantiser | None]:
    """The index of all usable vectors, and its quantiser.

    The quantiser is fitted to at most ``most_rows`` vectors, those with the smallest hash of
    the id.  Vectors of another length than the sample's most frequent take no part.
    The index has ``id, vector, codes, norm`` and is written to the shared folder.
    """
    ready_python(vectors.sparkSession)
    rows = usable(vectors, id_col, vector_col)
    few = rows.orderBy(F.xxhash64(F.lit("sample"), "id"), "id").limit(most_rows).toPandas()
    if not len(few):
        return rows.withColumns({"codes": F.array().cast("array<int>"), "norm": F.lit(0.0)}), None
    sizes = few["vector"].map(len)
    size = int(sizes.mode()[0])
    quantiser = train(np.stack(few["vector"][sizes == size].to_numpy()).astype(np.float32), **options)
    sent = rows.sparkSession.sparkContext.broadcast((quantiser.books, quantiser.beam))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = Quantiser(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = _matrix(part.column("vector"), size)
                codes = q.encode(x.astype(np.float32))
                total = q.decode(codes)
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * codes.shape[1])
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("vector"), pa.ListArray.from_arrays(offsets, pa.array(codes.ravel().astype(np.int32))), pa.array(np.einsum("ij,ij->i", total, total).astype(np.float64))], names=["id", "vector", "codes", "norm"])

    index = rows.where(F.size("vector") == size).mapInArrow(encode, "id long, vector array<double>, codes array<int>, norm double")
    return saved(index, "ann-index"), quantiser


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


class _Best:
    """The nearest rows so far, for a block of queries."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, rerank: int, quantiser: Quantiser):
        self.ids, self.queries, self.k, self.rerank = ids, queries, k, rerank
        m, words, _ = quantiser.books.shape
        self.tables = (queries.astype(np.float32) @ quantiser.flat.T).reshape(len(ids), m, words)
        self.near = np.full((len(ids), k), np.inf)
        self.which = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")  # so that ties go to the smaller id
        ids, vectors, codes, norms = ids[order], vectors[order], codes[order], norms[order]
        most = min(self.rerank, len(ids))
        for at in range(0, len(self.ids), 256):
            own = slice(at, at + 256)
            score = np.broadcast_to(norms.astype(np.float32), (len(self.ids[own]), len(ids))).copy()
            for m in range(codes.shape[1]):
                score -= 2 * self.tables[own, m][:, codes[:, m]]
            score[self.ids[own, None] == ids[None]] = np.inf
            edge = np.partition(score, most - 1, axis=1)[:, most - 1]
            for i in range(len(score)):
                chosen = np.flatnonzero(score[i] <= edge[i])
                if len(chosen) > most:
                    below = score[i, chosen] < edge[i]
                    chosen = np.sort(np.r_[chosen[below], chosen[~below][: most - below.sum()]])
                q = at + i
                chosen = chosen[ids[chosen] != self.ids[q]]
                apart = vectors[chosen] - self.queries[q]
                near = np.r_[self.near[q], np.sqrt((apart * apart).sum(1))]
                which = np.r_[self.which[q], ids[chosen]]
                best = np.lexsort((which, near))[: self.k]
                self.near[q], self.which[q] = near[best], which[best]

    def rows(self) -> pa.RecordBatch:
        real = np.isfinite(self.near)
        query = np.repeat(self.ids, self.k).reshape(real.shape)
        return pa.RecordBatch.from_arrays([pa.array(query[real]), pa.array(self.which[real]), pa.array(self.near[real])], names=["query_id", "vec_id", "score"])


def search(index: DataFrame, quantiser: Quantiser | None, queries: DataFrame, *, k: int = 10, rerank: int = 512, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest rows of the index.

    ``queries``: ``id, vector`` like the index's.  Nearness is the Euclidean distance in double
    precision, ties go to the smaller id, and a query does not find its own id.  With fewer
    candidates there are fewer rows.  ``rerank`` rows of each part of the index (of at most
    ROWS rows) are measured exactly.  Repeated ids are separate rows of the index.
    """
    spark = index.sparkSession
    schema = "query_id long, vec_id long, score double"
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if quantiser is None:
        return nothing
    m, _, size = quantiser.books.shape
    queries = queries.where(F.size("vector") == size).dropDuplicates(["id"])
    blocks = int(1 + queries.count() // block)
    queries = saved(queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), "ann-queries")
    found = []
    for b in range(blocks):
        own = queries.where(F.col("block") == b).select("id", "vector").toArrow()
        if not own.num_rows:
            continue
        sent = spark.sparkContext.broadcast((own.column("id").to_numpy(), _matrix(own.column("vector").combine_chunks(), size), quantiser.books, quantiser.beam))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, vectors, books, beam = sent.value
            best, held, n = None, [], 0

            def flush() -> None:
                nonlocal best, held, n
                best = best or _Best(ids, vectors, k, rerank, Quantiser(books, beam))
                table = pa.Table.from_batches(held).combine_chunks()
                best.add(table.column("id").to_numpy(), _matrix(table.column("vector").combine_chunks(), size), _matrix(table.column("codes").combine_chunks(), m), table.column("norm").to_numpy())
                held, n = [], 0

            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                if n >= ROWS:
                    flush()
            if n:
                flush()
            if best:
                yield best.rows()

        part = index.mapInArrow(scan, schema)
        found.append(saved(part, "ann-found") if blocks > 1 else part)
    if not found:
        return nothing
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
