"""Benchmark decontamination with suffix arrays of the training text.

The documents are worked through in shards of some megabytes, right where they are
read; nothing is shuffled.  A shard's words become 64-bit numbers, and its suffix array (all
word positions, ordered by the words that follow) comes from prefix doubling: sort
by 1, 2, 4, 8 and 16 words.  Every window of a benchmark item is the start of a test
suffix; a binary search gives its range in the suffix array, hence all places where
it occurs verbatim, and each match is then followed to its full length.

Test suffixes go to the tasks as broadcast blocks of a fixed number of words.  A
benchmark larger than one block takes one pass over the documents per block, and
each pass merges its hits with those before it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import saved, ready_python
from ._words import ALNUM, hashed_words

#: Bytes of benchmark text that are broadcast at once.
BLOCK_BYTES = 32 << 20
#: Bytes of training text in one suffix array.
SHARD_BYTES = 8 << 20
#: Matches that are followed at once, about.
MOST_FOLLOWED = 1 << 20

_RESULT = "struct<n_words: long, n_hit: long, items: array<string>, longest: long, longest_at: long, longest_item: string, spans: array<struct<start: long, stop: long>>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("longest_at", pa.int64()), ("longest_item", pa.string()), ("spans", _SPANS)])


class Windows:
    """The distinct windows of a block of benchmark items, ready for searching."""

    def __init__(self, items: list[str | None], texts: pa.Array, window: int):
        hashes, bounds = hashed_words(texts, ALNUM)
        sizes = np.diff(bounds)
        starts, owner, length = [], [], []
        for i, n in enumerate(sizes):
            if n:
                at = np.arange(bounds[i], bounds[i + 1] - min(n, window) + 1)
                starts.append(at)
                owner.append(np.full(len(at), i))
                length.append(np.full(len(at), min(n, window)))
        none = [np.zeros(0, np.int64)]
        self.words, self.items, self.bounds = hashes, items, bounds
        self.start, self.owner, self.length = (np.concatenate(x or none) for x in (starts, owner, length))
        # Equal windows are searched once; group: the window's number, owners: its items.
        rows = np.zeros((len(self.start), window + 1), np.uint64)
        rows[:, window] = self.length
        for d in range(window):
            there = d < self.length
            rows[there, d] = hashes[self.start[there] + d]
        packed = np.ascontiguousarray(rows).view([("", np.uint64)] * (window + 1)).ravel()
        _, first, group = np.unique(packed, return_index=True, return_inverse=True)
        self.first = first
        # Every place of each distinct window, for following matches.
        self.places, self.place_from = np.argsort(group, kind="stable"), np.r_[0, np.cumsum(np.bincount(group, minlength=len(first)))]
        order = np.lexsort((self.owner, group))
        pairs = np.stack([group[order], self.owner[order]], 1) if len(order) else np.zeros((0, 2), np.int64)
        pairs = np.unique(pairs, axis=0)
        self.owners, self.owner_from = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``words`` in the order of the words from there on, to ``depth`` words at least."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.r_[False, words[order][1:] != words[order][:-1]])
    step = 1
    while step < depth:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key)
        sorted_key = key[order]
        rank[order] = np.cumsum(np.r_[False, sorted_key[1:] != sorted_key[:-1]])
        if rank[order[-1]] == n - 1:
            break
        step *= 2
    return order


def _bound(words: np.ndarray, order: np.ndarray, tests: Windows, after: bool) -> np.ndarray:
    """For each distinct window: how many suffixes are below it (``after``: or begin with it)."""
    which = tests.first
    start, length = tests.start[which], tests.length[which]
    low, high = np.zeros(len(which), np.int64), np.full(len(which), len(order), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        place, sign = order[middle], np.zeros(len(open_), np.int8)
        for d in range(int(length.max())):
            todo = np.flatnonzero((sign == 0) & (d < length[open_]))
            if not todo.size:
                break
            at = place[todo] + d
            mine = np.where(at < len(words), words[np.minimum(at, len(words) - 1)], 0)
            theirs = tests.words[start[open_[todo]] + d]
            sign[todo] = np.where(mine < theirs, -1, np.where(mine > theirs, 1, 0))
        up = (sign < 0) | ((sign == 0) & after)
        low[open_[up]] = middle[up] + 1
        high[open_[~up]] = middle[~up]
    return low


def _best(words: np.ndarray, tests: Windows, place: np.ndarray, group: np.ndarray, before: list[np.ndarray], doc_of: np.ndarray) -> list[np.ndarray]:
    """Place, length and window of each document's longest match, of ``before`` and of windows ``group`` at ``place``."""
    uses = np.diff(tests.place_from)[group]
    src = tests.places[np.repeat(tests.place_from[group], uses) + np.arange(int(uses.sum())) - np.repeat(np.cumsum(uses) - uses, uses)]
    place = np.repeat(place, uses)
    start = tests.start[src]
    item_end, item_begin = tests.bounds[1:][tests.owner[src]], tests.bounds[:-1][tests.owner[src]]
    inner = (start > item_begin) & (place > 0)
    heads = ~(inner & (words[np.maximum(place - 1, 0)] == tests.words[np.maximum(start - 1, 0)]))
    place, start, item_end, src = place[heads], start[heads], item_end[heads], src[heads]
    length = tests.length[src].copy()
    live = np.arange(len(place))
    while live.size:
        a, b = place[live] + length[live], start[live] + length[live]
        more = (b < item_end[live]) & (a < len(words))
        live, a, b = live[more], a[more], b[more]
        live = live[words[a] == tests.words[b]]
        length[live] += 1
    place, length, src = (np.r_[x, y] for x, y in zip(before, (place, length, src), strict=True))
    order = np.lexsort((src, place, -length, doc_of[place]))
    order = order[np.unique(doc_of[place[order]], return_index=True)[1]]
    return [place[order], length[order], src[order]]


def _search(texts: pa.Array, tests: Windows, window: int, before: pa.Array | None) -> pa.Array:
    """Scores one shard of texts."""
    hashes, bounds = hashed_words(texts, ALNUM)
    n_docs, sizes = len(texts), np.diff(bounds)
    # A word that no text has (0) ends each document, so no match runs across.
    words = np.zeros(len(hashes) + n_docs, np.uint64)
    begins = bounds[:-1] + np.arange(n_docs)
    words[np.arange(len(hashes)) + np.repeat(np.arange(n_docs), sizes)] = np.maximum(hashes, 1)
    doc_of = np.repeat(np.arange(n_docs), sizes + 1)
    cover = np.zeros(len(words) + 1, np.int64)
    items: list[set] = [set() for _ in range(n_docs)]
    longest, longest_at, longest_item = np.zeros(n_docs, np.int64), np.full(n_docs, -1), np.full(n_docs, -1)
    if len(tests.first) and len(hashes):
        order = suffix_array(words, window)
        low, high = _bound(words, order, tests, False), _bound(words, order, tests, True)
        count = high - low
        found = np.flatnonzero(count)
        if found.size:
            group = np.repeat(found, count[found])
            place = order[np.repeat(low[found], count[found]) + np.arange(len(group)) - np.repeat(np.cumsum(count[found]) - count[found], count[found])]
            src = tests.first[group]
            np.add.at(cover, place, 1)
            np.add.at(cover, place + tests.length[src], -1)
            for d, g in np.unique(np.stack([doc_of[place], group], 1), axis=0):
                items[d].update(tests.owners[tests.owner_from[g] : tests.owner_from[g + 1]])
            # Follow the matches at every place of their window; those that a match in front of them continues are skipped.
            best = [np.zeros(0, np.int64)] * 3
            uses = np.diff(tests.place_from)[group]
            step = np.r_[0, np.flatnonzero(np.diff(np.cumsum(uses) // MOST_FOLLOWED)) + 1, len(group)]
            for a, b in zip(step[:-1], step[1:], strict=True):
                best = _best(words, tests, place[a:b], group[a:b], best, doc_of)
            docs = doc_of[best[0]]
            longest[docs], longest_at[docs], longest_item[docs] = best[1], best[0] - begins[docs], tests.owner[best[2]]
    names = [sorted({tests.items[i] for i in x if tests.items[i] is not None}) for x in items]
    best_item = [tests.items[i] if i >= 0 else None for i in longest_item]
    if before is not None:
        for d, old in enumerate(before.to_pylist()):
            for s in old["spans"]:
                cover[begins[d] + s["start"]] += 1
                cover[begins[d] + s["stop"]] -= 1
            names[d] = sorted({*names[d], *old["items"]})
            if old["longest"] > longest[d]:
                longest[d], longest_at[d], best_item[d] = old["longest"], old["longest_at"], old["longest_item"]
    hit = np.cumsum(cover)[:-1] > 0
    n_hit = np.bincount(doc_of[hit], minlength=n_docs)
    edge = np.diff(np.r_[False, hit, False].astype(np.int8))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = doc_of[starts]
    spans = pa.StructArray.from_arrays([pa.array(starts - begins[owner]), pa.array(stops - begins[owner])], names=["start", "stop"])
    offsets = pa.array(np.searchsorted(owner, np.arange(n_docs + 1)).astype(np.int32))
    return pa.StructArray.from_arrays([
        pa.array(sizes, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(longest, pa.int64()),
        pa.array(longest_at, pa.int64()), pa.array(best_item, pa.string()), pa.ListArray.from_arrays(offsets, spans).cast(_SPANS),
    ], names=[f.name for f in _ARROW]).cast(_ARROW)


def _shards(texts: pa.Array) -> list[tuple[int, int]]:
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    edges = np.r_[0, np.flatnonzero(np.diff(np.cumsum(size) // SHARD_BYTES)) + 1, len(texts)]
    return [(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def contaminate_columns(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """Adds a struct ``contamination`` to every document.

    Its fields: ``n_words``; ``n_hit``, the words inside any occurrence of a window;
    ``items``, the sorted ids (as strings) of items of which a window occurs; ``longest``,
    ``longest_at`` and ``longest_item``, the longest verbatim match, where it begins and of
    which item (0, -1, null without any); ``spans``, the hit runs of words.

    A window is ``window`` words in a row; an item with fewer words is one window, one with
    none has none.  Null texts have no words.  A hit by an item without an id counts but is
    not listed; items with the same id are listed once.  Repeated documents are each
    scored.  Empty tables give no hits, or no rows.  A column of that name is replaced.
    """
    spark = docs.sparkSession
    ready_python(spark)
    bench = benchmark.select(F.col(item_id_col).cast("string").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    total = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = 1 + total // BLOCK_BYTES
    bench = bench.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    if blocks > 1:
        bench = saved(bench, "benchmark")
    out = docs.drop("contamination") if text_col != "contamination" else docs
    for block in range(blocks):
        rows = bench.where(F.col("block") == block).select("item", "text").toArrow()
        sent = spark.sparkContext.broadcast((rows.column("item").to_pylist(), rows.column("text").combine_chunks()))
        cached: dict[int, Windows] = {}

        def tests(sent=sent, cached=cached) -> Windows:
            if 0 not in cached:
                cached[0] = Windows(*sent.value, window)
            return cached[0]

        if block == 0:

            @F.arrow_udf(_RESULT)
            def search(texts: pa.Array) -> pa.Array:
                parts = [_search(texts.slice(a, b - a), tests(), window, None) for a, b in _shards(texts)]
                return pa.chunked_array(parts, _ARROW).combine_chunks() if parts else pa.array([], _ARROW)

            out = out.withColumn("contamination", search(text_col))
        else:

            @F.arrow_udf(_RESULT)
            def search_on(texts: pa.Array, before: pa.Array) -> pa.Array:
                parts = [_search(texts.slice(a, b - a), tests(), window, before.slice(a, b - a)) for a, b in _shards(texts)]
                return pa.chunked_array(parts, _ARROW).combine_chunks() if parts else pa.array([], _ARROW)

            out = out.withColumn("contamination", search_on(text_col, "contamination"))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that no window of the benchmark occurs in; options as above."""
    scored = contaminate_columns(docs, benchmark, **options)
    return scored.where(F.col("contamination.n_hit") == 0).select(*docs.columns)
