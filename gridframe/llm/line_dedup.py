"""Line deduplication over levelled sorted runs of line hashes.

A store holds *runs*: tables ``(h1, h2, n_docs)`` by a 128-bit hash of a line's
key, where ``n_docs`` counts documents of a batch that hold the line.  Runs are bucketed by the hash
and sorted in their buckets, all into the same number of buckets: they are merged with each other and
joined with a batch bucket by bucket, without a shuffle of the runs.  New runs enter level 0; when a level has
``fanout`` runs they are merged into one run of the next level.

A new batch is counted, merge-anti-joined with the runs, and adds its own: what the runs already know
to be in enough documents is settled and needs no more counts.  Only lines so frequent in the
batch that a join must treat them apart are counted on.

What is shuffled is one hash per distinct line of a document, not its text.  A line in a
third of all documents is counted with partial sums; to bring frequent lines back
to their documents, the lines above a share of all rows are broadcast (there are at
most ``1 / share`` of them, whatever the data), and the others, of which none has
more rows than twice that share, are joined by a shuffle.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import drop, saved, scratch

_STRIP = "\x20\x09\x0a\x0b\x0c\x0d"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: At most this many keys have more rows than 1 / MOST_HOT of all, so they can be broadcast.
MOST_HOT = 20_000


def split_lines(text: str | Column) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    text = F.col(text) if isinstance(text, str) else text
    return F.split(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(-1))


def line_key(line: Column) -> Column:
    """A line stripped of white space at both ends, with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_STRIP)), _UPPER, _LOWER)


def line_hash(key: Column) -> Column:
    """128 bits of a key, as two numbers."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))


class LineRuns:
    """Levelled sorted runs in the cluster's shared folder; ``close()`` deletes them."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self._paths: dict[str, str] = {}

    def _write(self, counts: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self._paths[name] = scratch(self.spark, "line-run")
        counts.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self._paths[name]).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop(self.spark, self._paths.pop(name))

    def add(self, lines: DataFrame, least: int | None = None, rows: int | None = None) -> None:
        """Adds a batch, ``(h1, h2)`` once for each distinct line of each document.

        With ``least``, lines in that many documents of the runs are settled and left out, unless they are
        in more than a share of 1 / MOST_HOT of the batch's ``rows``.
        """
        counts = lines.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"))
        if least is not None and self.runs():
            settled = self.counts(least).select(F.col("h1").alias("s1"), F.col("h2").alias("s2"))
            known = (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2")) & (F.col("n_docs") <= max(1, (rows or 0) // MOST_HOT))
            counts = counts.join(settled.hint("merge"), known, "left_anti")
        self._put(0, self._write(counts))

    def _put(self, level: int, run: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        runs = self.levels[level]
        runs.append(run)
        if len(runs) >= self.fanout:
            merged = self._write(self._merged(runs))
            for old in runs:
                self._drop(old)
            runs.clear()
            self._put(level + 1, merged)

    def _merged(self, runs: list[str]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long, n_docs long")
        # The filter makes rows of each scan's columns: only a union of rows keeps its buckets together.
        each = [self.spark.table(x).where("n_docs > 0") for x in runs]
        return reduce(DataFrame.unionAll, each).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))

    def runs(self) -> list[str]:
        return [x for level in self.levels for x in level]

    def counts(self, least: int = 1) -> DataFrame:
        """Documents by line hash over all runs, for lines with at least ``least``."""
        return self._merged(self.runs()).where(F.col("n_docs") >= least)

    def new_lines(self, lines: DataFrame, least: int = 1) -> DataFrame:
        """The anti-join: rows of ``lines`` (``h1, h2, ...``) not in ``least`` documents yet."""
        return lines.join(self.counts(least), ["h1", "h2"], "left_anti")

    def close(self) -> None:
        for name in self.runs():
            self._drop(name)
        self.levels.clear()

    def known_lines(self, lines: DataFrame, least: int = 1) -> DataFrame:
        """The rows of ``lines`` that are in at least ``least`` documents of the runs.

        Safe for any skew: see the module's note on broadcasting.
        """
        known = saved(self.counts(least), "line-known")
        total = known.agg(F.sum("n_docs")).first()[0] or 0
        edge = max(least, total // MOST_HOT)
        hot = known.where(F.col("n_docs") > edge).select("h1", "h2")
        rest = known.where(F.col("n_docs") <= edge).select("h1", "h2")
        few = lines.join(F.broadcast(hot), ["h1", "h2"], "left_semi")
        if not rest.take(1):
            return few
        cool = lines.join(F.broadcast(hot), ["h1", "h2"], "left_anti")
        return few.unionByName(cool.join(rest, ["h1", "h2"], "left_semi"))


def drop_common_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 3) -> DataFrame:
    """Removes every line whose key is found in at least ``min_docs`` documents.

    Replaces ``text_col`` by the lines that stay, joined by newlines, and adds
    ``n_lines`` (before) and ``n_dropped``.  Keys under ``min_chars`` code points are never
    dropped.  A null or empty text is one empty line and becomes an empty text.  Each row
    counts as a document of its own, so repeated rows count as often as they occur; rows
    with the same id (or without one) are told apart by their text.  An empty table
    gives an empty result; columns named like the new ones are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in ("n_lines", "n_dropped") if c not in (id_col, text_col)])
    # A row is known by its id and text: equal rows have equal lines, so they may share a key.
    key = [F.xxhash64(F.col(id_col), F.lit("row"), F.col(text_col)).alias("row1"), F.xxhash64(F.lit("other"), F.col(text_col), F.col(id_col)).alias("row2")]
    # One hash per line, in order; null where the key is too short to be dropped.
    hashed = lambda x: F.when(F.char_length(line_key(x)) >= min_chars, line_hash(line_key(x)))
    # Distinct by the keys: Spark finds equal strings by hashing, but compares structs with all others.
    once = F.transform(F.array_distinct(F.filter(F.transform(split_lines(text_col), line_key), lambda k: F.char_length(k) >= min_chars)), line_hash)
    hashes = docs.select(*key, F.transform(split_lines(text_col), hashed).alias("lines"), once.alias("once"))
    # The copies of a row agree in their batch, and no batch depends on how files are cut.
    hashes = hashes.withColumn("batch", F.pmod("row1", F.lit(batches)).cast("int"))
    path = scratch(spark, "line-hashes")
    hashes.write.partitionBy("batch").parquet(path)
    hashes = spark.read.schema(hashes.schema).parquet(path)
    rows = {r[0]: r[1] for r in hashes.groupBy("batch").agg(F.sum(F.size("once"))).collect()}
    store = LineRuns(spark, fanout)
    for b in sorted(rows):
        store.add(hashes.where(F.col("batch") == b).select(F.inline("once")), min_docs, rows[b])
    each = hashes.select("row1", "row2", F.posexplode("lines").alias("place", "h")).where("h IS NOT NULL").select("row1", "row2", "place", "h.*")
    known = store.known_lines(each, min_docs)
    hits = saved(known.groupBy("row1", "row2").agg(F.collect_set("place").alias("hits")), "line-hits")
    store.close()
    joined = docs.withColumns({"__row1": key[0], "__row2": key[1]}).join(hits.withColumnsRenamed({"row1": "__row1", "row2": "__row2"}), ["__row1", "__row2"], "left")
    # Split once: the optimizer would copy the expression into the lambda, but does not look through a generator.
    joined = joined.select("*", F.explode(F.array(split_lines(text_col))).alias("__lines")).withColumn("n_lines", F.size("__lines").cast("long"))
    # By places, so that the work is in proportion to the lines.
    stay = F.array_except(F.sequence(F.lit(0), F.col("n_lines").cast("int") - 1), F.col("hits"))
    kept = F.when(F.col("hits").isNull(), F.col("__lines")).otherwise(F.transform(stay, lambda i: F.get("__lines", i)))
    out = joined.withColumn("__stay", kept)
    out = out.withColumn("n_dropped", F.col("n_lines") - F.size("__stay"))
    return out.withColumn(text_col, F.array_join("__stay", "\n")).select(*docs.columns, "n_lines", "n_dropped")
