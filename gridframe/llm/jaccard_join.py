"""Jaccard self-join of word n-gram sets with PartEnum signatures.

Sizes are cut into bands ``[l, l / t]``.  Scheme ``j`` serves the pairs whose smaller set
lies in band ``j``; a set takes part in the schemes of its own band and the one below.
Two linked sets of a scheme differ in at most ``k`` elements, so with the feature domain
cut into ``p > k`` partitions by hash at least ``p - k`` partitions hold the same elements
in both.  A signature is the scheme, a partition and what the set has in it; all partitions
are enumerated, however long the text.  Empty ones say nothing and give no signature: a set
with ``e`` of them still shares ``p - k - e`` signatures with each set it links with.  If that is
less than one, the set also gives signatures under further partitionings, and under the last
one the empty partitions count too.

As ``s = p - k - e`` signatures are shared and not just one, a set keeps its rarest signatures and
leaves out the ``s - 1`` that most sets have: of the shared ones at least one stays in both.  So what
many texts have in common gives no large groups, unless they are close to linking.

Equal sets are one node from the start.  Candidates are checked exactly on the sets, after an
exact lower bound on their difference from 512-bit parity sketches.  Groups that share a
signature are not expanded to pairs:

*  Every node is checked against its *centre*, the member of its groups that shares most
   with the others.  That unites most groups of near copies.
*  Nodes with one centre ``c`` are compared by what they differ in from it.  With ``D(x)`` the
   symmetric difference of ``x`` and ``c``, two of them link if
   ``|D(x)| + |D(y)| - 2 |D(x) & D(y)|`` is small enough.  If both are linked to ``c`` they are in
   one component already; else they must share a known part of their differences, so it is
   enough to join on prefixes of these, rare elements first (what a node adds to ``c``
   before what it lacks).
*  Only pairs with different centres and in different components are taken from the groups.

A join on something that many rows can have (a signature, a centre, a node with many copies)
broadcasts the few keys with more than a share of all rows; see ``_store.lookup``.  Pairs are turned so that
``a`` is the node in more pairs: then ``b`` is in at most the square root of twice all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._components import components
from ._store import discard, lookup, ready_python, saved, shuffled_joins
from ._words import NON_SPACE, hashed_words, mix

#: Partitionings: the first, and further ones for sets with many empty partitions.
SEEDS = 4
_SHARD = 4 << 20
_FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_FEATURES = "struct<n: long, node: long, sketch: array<long>, own: array<long>, below: array<long>, own_shared: int, below_shared: int>"
_ARROW = pa.struct([
    ("n", pa.int64()), ("node", pa.int64()), ("sketch", pa.list_(pa.int64())), ("own", pa.list_(pa.int64())), ("below", pa.list_(pa.int64())), ("own_shared", pa.int32()), ("below_shared", pa.int32()),
])


class Bands:
    """The size bands of a threshold in percent, as far as sizes go."""

    def __init__(self, percent: int, most: int = 1):
        self.percent, self.low = percent, [1]
        self.grow(most)

    def grow(self, most: int) -> None:
        while self.low[-1] <= most + 1:
            self.low.append(max(self.low[-1] * 100 // self.percent, self.low[-1]) + 1)
        low = np.array(self.low)
        self.starts, high = low, np.r_[low[1:] - 1, low[-1] * 100 // self.percent]
        self.partner = high * 100 // self.percent
        self.k = (high + self.partner) * (100 - self.percent) // (100 + self.percent)
        self.parts = np.where(self.k == 0, 1, np.ceil(1.2 * (self.k + 1)).astype(np.int64) + 1)

    def of(self, size: np.ndarray) -> np.ndarray:
        if size.size and size.max() >= self.low[-1]:
            self.grow(int(size.max()))
        return np.searchsorted(self.starts, size, side="right") - 1


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams."""
    hashes, bounds = hashed_words(texts, NON_SPACE)
    if len(hashes) >= words:
        rolled = np.zeros(len(hashes) - words + 1, np.uint64)
        for j in range(words):
            rolled += hashes[j : j + len(rolled)] * _FACTORS[j % 64] + np.uint64(j)
        rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            out.append(mix((hashes[a:b] * _FACTORS[: b - a]).sum(dtype=np.uint64).reshape(1) + np.uint64(0xF00D + b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _scheme_signatures(flat: np.ndarray, owner: np.ndarray, docs: np.ndarray, scheme: np.ndarray, bands: Bands, n_docs: int) -> tuple[pa.ListArray, np.ndarray]:
    """For all ``n_docs`` the signatures of documents ``docs`` in one scheme each, and how many of them any linked set shares.

    ``flat``: elements of ``owner``.
    """
    shared = np.ones(n_docs, np.int64)
    parts, k = bands.parts[scheme], bands.k[scheme]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    open_ = np.ones(len(docs), bool)
    for seed in range(SEEDS):
        live = np.flatnonzero(open_)
        if not live.size:
            break
        slot = np.full(n_docs, -1)
        slot[docs[live]] = np.arange(len(live))
        mine = slot[owner]
        inside = mine >= 0
        h, mine = flat[inside], mine[inside]
        p = parts[live]
        h = h if seed == 0 else mix(h + np.uint64(seed))
        part = (((h >> np.uint64(32)) * p.astype(np.uint64)[mine]) >> np.uint64(32)).astype(np.int64)
        offset = np.r_[0, np.cumsum(p)]
        cell = offset[mine] + part
        sums, count = np.zeros(offset[-1], np.uint64), np.bincount(cell, minlength=offset[-1])
        np.add.at(sums, cell, mix(h ^ np.uint64(0x5DEECE66D)))
        of = np.repeat(np.arange(len(live)), p)
        which = np.arange(offset[-1]) - offset[of]
        left = p - k[live] - np.bincount(of[count == 0], minlength=len(live))
        if seed == 0:
            shared[docs[live]] = np.maximum(left, 1)
        use = (count > 0) | (seed == SEEDS - 1)
        tag = scheme[live][of].astype(np.uint64) * np.uint64(1 << 40) + which.astype(np.uint64) * np.uint64(8) + np.uint64(seed)
        found.append((docs[live][of[use]], mix(sums[use] + mix(tag[use]))))
        open_[live[left > 0]] = False
    doc, signature = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    order = np.argsort(doc, kind="stable")
    offsets = np.searchsorted(doc[order], np.arange(n_docs + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(signature[order].view(np.int64))), shared


def _features(texts: pa.Array, words: int, bands: Bands) -> pa.Array:
    sets = shingle_sets(texts, words)
    n = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), n)
    full = n > 0
    starts = np.r_[0, np.cumsum(n)][:-1][full]
    node = np.zeros(len(sets), np.uint64)
    if full.any():
        node[full] = mix(np.add.reduceat(mix(flat ^ np.uint64(0xABCDEF)), starts) + n[full].astype(np.uint64))
    bits = np.zeros(len(sets) * 512, np.uint8)
    np.bitwise_xor.at(bits, owner * 512 + (flat & np.uint64(511)).astype(np.int64), 1)
    sketch = np.packbits(bits).view(np.int64)
    band = bands.of(n)
    docs = np.flatnonzero(full)
    lower = docs[band[docs] > 0]
    lower = lower[n[lower] <= bands.partner[band[lower] - 1]]
    own, own_shared = _scheme_signatures(flat, owner, docs, band[docs], bands, len(sets))
    below, below_shared = _scheme_signatures(flat, owner, lower, band[lower] - 1, bands, len(sets))
    return pa.StructArray.from_arrays([
        pa.array(n), pa.array(node.view(np.int64), mask=~full), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * 8), pa.array(sketch)),
        own, below, pa.array(own_shared, pa.int32()), pa.array(below_shared, pa.int32()),
    ], names=[f.name for f in _ARROW]).cast(_ARROW)


def _shards(texts: pa.Array) -> list[pa.Array]:
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    edges = np.r_[0, np.flatnonzero(np.diff(np.cumsum(size) // _SHARD)) + 1, len(texts)]
    return [texts.slice(int(a), int(b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def features(text: str | Column, words: int, percent: int) -> Column:
    """The struct of a text's set size, node (a hash of the set), sketch and signatures."""
    bands = Bands(percent)

    @F.arrow_udf(_FEATURES)
    def run(texts: pa.Array) -> pa.Array:
        parts = [_features(x, words, bands) for x in _shards(texts)]
        return pa.chunked_array(parts, _ARROW).combine_chunks() if parts else pa.array([], _ARROW)

    return run(text)


def hashed_set(text: str | Column, words: int) -> Column:
    """A text's set of n-gram hashes, and its node."""
    kind = pa.struct([("node", pa.int64()), ("set", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<node: long, set: array<long>>")
    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for x in _shards(texts):
            sets = shingle_sets(x, words)
            node = [int(mix(mix(s ^ np.uint64(0xABCDEF)).sum(dtype=np.uint64).reshape(1) + np.uint64(len(s))).view(np.int64)[0]) if len(s) else None for s in sets]
            offsets = pa.array(np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32))
            flat = pa.array(np.concatenate(sets).view(np.int64))
            parts.append(pa.StructArray.from_arrays([pa.array(node, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], names=["node", "set"]).cast(kind))
        return pa.chunked_array(parts, kind).combine_chunks() if parts else pa.array([], kind)

    return run(text)


class _Links:
    """Candidate groups, checked pairs and the components so far."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, words: int, percent: int):
        self.percent = percent
        schemes = F.array(F.struct(F.lit(0).alias("below"), F.col("f.own_shared").alias("shared"), F.col("f.own").alias("s")), F.struct(F.lit(1).alias("below"), F.col("f.below_shared").alias("shared"), F.col("f.below").alias("s")))
        exploded = nodes.select("node", F.inline(schemes)).select("node", (2 * F.col("shared") + F.col("below")).alias("mark"), F.explode("s").alias("signature"))
        counts = saved(exploded.groupBy("signature").agg(F.count("*").alias("size")).where("size > 1"), "signatures")
        common = lookup(exploded, counts, "signature", "size", drop=False)
        # Of the signatures that any link must share, all but one may go: those of most nodes.
        most = Window.partitionBy("node", F.col("mark") % 2).orderBy(F.desc("size"), "signature")
        self.members = saved(common.withColumn("place", F.row_number().over(most)).where("place >= mark div 2").select("signature", "node"), "members")
        own = saved(self.members.select("node").distinct(), "member-nodes")
        about = saved(nodes.select("node", "rep", "f.n", "f.sketch").join(own, "node", "left_semi"), "sketches")
        self.sketches = about.select("node", "n", "sketch")
        discard(counts)
        # One document of each node in question gives its set.
        texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text"))
        found = texts.join(about.select("rep", "node"), "rep").select("node", hashed_set("text", words).alias("s")).where(F.col("node") == F.col("s.node"))
        self.sets = saved(found.select("node", F.col("s.set").alias("set")).dropDuplicates(["node"]), "sets")
        self.comps = own.select("node", F.col("node").alias("comp"))
        self.tried: DataFrame | None = None

    def _to_centres(self, best: DataFrame) -> DataFrame:
        """The pairs of ``x`` and its centre ``y``, once each; ``a`` is the centre, so that no node is ``b`` twice."""
        ends = best.groupBy(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).agg(F.min("x").alias("b"))
        return saved(ends.select(F.when(F.col("b") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("a"), "b"), "pairs")

    def _new(self, pairs: DataFrame) -> DataFrame:
        """The pairs that were not checked, once each, turned so that ``a`` is the node in more of them."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs = saved(pairs, "new-pairs")
        degree = saved(pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("uses")), "pair-degrees")
        of = lambda x: degree.select(F.col("node").alias(x), F.col("uses").alias(f"uses_{x}"))
        both = lookup(lookup(pairs, of("a"), "a", "uses_a", drop=False), of("b"), "b", "uses_b", drop=False)
        turned = F.when(F.col("uses_a") >= F.col("uses_b"), F.struct("a", "b")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        return saved(both.select(turned.alias("t")).select("t.a", "t.b"), "pairs")

    def _sketched(self, rows: DataFrame, node: str, x: str) -> DataFrame:
        own = self.sketches.select(F.col("node").alias(node), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
        return rows.join(own, node)

    def _close(self) -> Column:
        """Whether two sketched sets can be near enough: equal parities bound their difference from below."""
        apart = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        return apart * (100 + self.percent) <= (F.col("n_a") + F.col("n_b")) * (100 - self.percent)

    def check(self, pairs: DataFrame, last: bool = False) -> None:
        """Checks new pairs ``a, b`` exactly and unites the components of those that link."""
        if not last:
            done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            self.tried = done if self.tried is None else self.tried.unionByName(done)
        close = self._sketched(self._sketched(pairs, "a", "a"), "b", "b").where(self._close()).select("a", "b", "n_a", "n_b")
        close = saved(close, "close")
        if not close.take(1):
            return
        degree = saved(close.groupBy("a").agg(F.count("*").alias("uses")), "degrees")
        mine = saved(self.sets.withColumnRenamed("node", "a").join(degree, "a").withColumnRenamed("set", "set_a"), "sets-a")
        with_a = lookup(close, mine, "a", "uses")
        both = with_a.join(self.sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
        common = F.size(F.array_intersect("set_a", "set_b"))
        linked = both.where(100 * common >= self.percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")
        linked = saved(linked, "linked")
        discard(close, degree, mine)
        if not linked.take(1):
            return
        side = lambda x: self.comps.select(F.col("node").alias(x), F.col("comp").alias(f"c_{x}"))
        merged = components(linked.join(side("a"), "a").join(side("b"), "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")))
        merged = saved(merged.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "merged")
        self.comps = saved(self.comps.join(merged, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "comps")

    def apart(self) -> DataFrame:
        """The members of groups that still hold several components."""
        placed = self.members.join(self.comps, "node")
        several = placed.groupBy("signature").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("signature", "size")
        return saved(lookup(placed, saved(several, "several"), "signature", "size", drop=False), "apart")

    def by_centre(self, groups: DataFrame) -> DataFrame:
        """``x, y``: for each node ``x`` the best centre ``y`` of its groups that it was not checked with."""
        sized = groups
        if "size" not in groups.columns:
            sizes = saved(groups.groupBy("signature").agg(F.count("*").alias("size")), "group-sizes")
            sized = lookup(groups, sizes, "signature", "size", drop=False)
        groups = groups.drop("size")
        score = saved(sized.groupBy("node").agg(F.sum("size").alias("score")), "scores")
        scored = groups.join(score, "node")
        centre = scored.groupBy("signature").agg(F.max(F.struct("score", "node", "comp")).alias("c"), F.count("*").alias("size")).select("signature", "size", F.col("c.node").alias("centre"), F.col("c.comp").alias("centre_comp"))
        placed = lookup(groups, saved(centre, "centres"), "signature", "size")
        pairs = placed.where("comp <> centre_comp").groupBy(F.col("node").alias("x"), F.col("centre").alias("y")).agg(F.count("*").alias("shared"))
        if self.tried is not None:
            keyed = pairs.withColumn("a", F.least("x", "y")).withColumn("b", F.greatest("x", "y"))
            pairs = keyed.join(self.tried, ["a", "b"], "left_anti")
        best = pairs.groupBy("x").agg(F.max(F.struct("shared", "y")).alias("m")).select("x", F.col("m.y").alias("y"))
        return saved(best, "best-centres")

    def families(self, best: DataFrame) -> None:
        """``node, centre``: the first centre of each node, or that centre's own if the two are linked."""
        own = best.select(F.col("x").alias("node"), F.col("y").alias("centre"))
        comp = lambda x: self.comps.select(F.col("node").alias(x), F.col("comp").alias(f"c_{x}"))
        above = own.select(F.col("node").alias("centre"), F.col("centre").alias("above")).join(comp("centre"), "centre").join(comp("above"), "above").where("c_centre = c_above").select("centre", "above")
        self.family = saved(own.join(above, "centre", "left").select("node", F.coalesce("above", "centre").alias("centre")), "families")

    def by_difference(self, groups: DataFrame) -> DataFrame:
        """Pairs of a family, its centre included, in different components that can link, by their differences from the centre."""
        nodes = saved(groups.select("node", "comp").distinct().join(self.family, "node"), "apart-nodes")
        uses = saved(nodes.groupBy("centre").agg(F.count("*").alias("uses")), "centre-uses")
        middle = saved(self.sets.select(F.col("node").alias("centre"), F.col("set").alias("c_set")).join(uses, "centre"), "centre-sets")
        placed = lookup(nodes, middle, "centre", "uses").where("node <> centre").join(self.sets, "node")
        r = (100 - self.percent) / (100 + self.percent)
        ordered = lambda x, y: F.array_sort(F.array_except(x, y))
        differ = placed.withColumn("diff", F.concat(ordered("set", "c_set"), ordered("c_set", "set")))
        # Two nodes link if they share (excess + excess) / 2 of their differences at least.
        differ = differ.withColumn("excess", F.size("diff") - r * F.size("set"))
        differ = saved(differ.withColumn("far", F.size("diff") > r * (F.size("set") + F.size("c_set")) + 1e-9).select("node", "comp", "centre", "diff", "excess", "far"), "differences")
        least = differ.groupBy("centre").agg(F.min("excess").alias("any_least"), F.min(F.when(F.col("far"), F.col("excess"))).alias("far_least"), F.count("*").alias("uses")).where("far_least IS NOT NULL")
        bounded = self._sketched(lookup(differ, saved(least, "least-excess"), "centre", "uses"), "node", "b")
        share = lambda other: F.greatest(F.ceil((F.col("excess") + F.col(other)) / 2 - 1e-9), F.lit(1))
        prefix = lambda other: F.slice("diff", F.lit(1), F.greatest(F.size("diff") - share(other) + 1, F.lit(0)).cast("int"))
        far = bounded.where("far").select("centre", F.col("node").alias("a"), F.col("comp").alias("c_a"), F.col("n_b").alias("n_a"), F.col("s_b").alias("s_a"), F.explode(prefix("any_least")).alias("element"))
        near = bounded.select("centre", F.col("node").alias("b"), F.col("comp").alias("c_b"), "n_b", "s_b", F.explode(prefix("far_least")).alias("element"))
        both = far.join(near, ["centre", "element"]).where((F.col("c_a") != F.col("c_b")) & self._close()).select("a", "b")
        # A family's centre may be its first centre's own, which the node was not checked with.
        heads = self.comps.select(F.col("node").alias("centre"), F.col("comp").alias("c_centre"))
        to_centre = differ.where(~F.col("far")).select("node", "comp", "centre").join(heads, "centre").where("comp <> c_centre")
        return both.unionByName(to_centre.select(F.col("node").alias("a"), F.col("centre").alias("b")))

    def across(self, groups: DataFrame) -> DataFrame:
        """Pairs of a group's members in different components and with different centres."""
        counts = groups.groupBy("signature", "comp").agg(F.count("*").alias("n"))
        major = saved(counts.groupBy("signature").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("size")).select("signature", "size", F.col("m.comp").alias("major")), "majors")
        own = self.family.select("node", "centre")
        placed = groups.drop("size").join(own, "node", "left").withColumn("centre", F.coalesce("centre", "node"))
        placed = saved(lookup(placed, major, "signature", "size"), "in-groups")
        # Groups of one family are done.
        several = placed.groupBy("signature").agg(F.min("centre").alias("lo"), F.max("centre").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("signature", "size")
        placed = saved(self._sketched(lookup(placed, saved(several, "several"), "signature", "size"), "node", "b"), "placed")
        minor = placed.where("comp <> major").select("signature", F.col("node").alias("x"), F.col("comp").alias("c_x"), F.col("centre").alias("f_x"), F.col("n_b").alias("n_a"), F.col("s_b").alias("s_a"))
        other = F.expr("c_x <> comp AND f_x <> centre AND (comp = major OR x < node)")
        return minor.join(placed, "signature").where(other & self._close()).select(F.col("x").alias("a"), F.col("node").alias("b"))


def linked_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, centre_rounds: int = 2) -> DataFrame:
    """One row per document: ``id_col, n_shingles, class_id, component_id``.

    Two documents link when the Jaccard similarity of their sets of ``words``-grams is at
    least ``percent`` / 100.  ``class_id`` tells equal sets apart; ``component_id`` is the
    smallest id reachable by links.  A text with fewer words is one n-gram; null and empty
    texts have the empty set, no class, and link with nothing.  Rows with one id are
    separate rows of that id; a row without an id gets no component.  An empty table gives
    an empty result.  Other columns play no part.
    """
    spark = docs.sparkSession
    ready_python(spark)
    with shuffled_joins(spark):
        return _linked(docs, id_col, text_col, words, percent, centre_rounds)


def _linked(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, centre_rounds: int) -> DataFrame:
    rows = saved(docs.select(F.col(id_col).alias("id"), features(text_col, words, percent).alias("f")), "features")
    known = rows.where(F.col("f.node").isNotNull() & F.col("id").isNotNull())
    # Equal sets have equal features.
    nodes = known.groupBy(F.col("f.node").alias("node")).agg(F.min("id").alias("rep"), F.count("*").alias("uses"), F.first("f").alias("f"))
    nodes = saved(nodes, "nodes")
    slim = saved(rows.select("id", "f.n", "f.node"), "document-nodes")
    discard(rows)
    reps = saved(nodes.select("node", "rep", "uses"), "reps")
    links = _Links(docs, id_col, text_col, nodes, words, percent)
    discard(nodes)
    groups = links.members.withColumn("comp", F.col("node"))
    for turn in range(max(centre_rounds, 1)):
        best = links.by_centre(groups)
        links.check(links._to_centres(best))
        if turn == 0:
            links.families(best)
        groups = links.apart()
        if not groups.take(1):
            break
    else:
        rest = links.by_difference(groups).unionByName(links.across(groups))
        links.check(links._new(rest), last=True)
    placed = reps.join(links.comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = saved(placed.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count("*").alias("nodes")), "least-ids")
    final = saved(lookup(placed, least, "comp", "nodes").select("node", "component_id", "uses"), "node-components")
    plain = slim.where(F.col("node").isNull() | F.col("id").isNull()).withColumn("component_id", F.when(F.col("node").isNull(), F.col("id")))
    some = slim.where(F.col("node").isNotNull() & F.col("id").isNotNull())
    out = lookup(some, final, "node", "uses").select("id", "n", "node", "component_id").unionByName(plain)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("node").alias("class_id"), "component_id")


def keep_one_each(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that are the smallest of their component; one row of it each.

    Rows are known by id and text: different texts with one id are separate documents, and so
    are texts without an id, which come after all others.  Texts without words are linked with
    nothing, so every row of them stays.
    """
    text_col = options.get("text_col", "text")
    keyed = docs.withColumn("__key", F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie")))
    linked = linked_documents(keyed, id_col="__key", **options)
    kept = linked.where(F.col("__key") == F.col("component_id")).select("__key", (F.col("n_shingles") == 0).alias("__none")).distinct()
    each = F.when(F.col("__none"), F.monotonically_increasing_id()).otherwise(F.lit(0))
    return keyed.join(kept, "__key").withColumn("__each", each).dropDuplicates(["__key", "__each"]).select(*docs.columns)
