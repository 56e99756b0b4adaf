"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a ceiling of ``max_epochs`` times its own size.  The
whole budget is shared by weight; what a source cannot use is shared again among the
others by weight, until no source is above its ceiling.  That fixed point is a water
level: a source gets ``min(ceiling, level * weight)``.  With the sources ordered by
``ceiling / weight`` the level follows from running sums, so nothing iterates.

A source's words are then taken as whole repetitions of all its documents and one
fractional repetition: its documents in a seeded order, up to the words still missing.
The cut in that order is found from sums over 4096 ranges of the order and a running
sum inside the one range that holds the cut, so no task sees a whole source.

Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import saved

#: The order's keys have 60 bits; the upper 12 of them number its ranges.
_RANGE_BITS = 48


def words(text: str | Column) -> Column:
    """How many runs of characters other than white space a text has; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(key: str | Column, seed: int) -> Column:
    """A document's place in the seeded order: 60 bits of a digest of its id."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string") if isinstance(key, str) else key, F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3, budget: float = 1.0) -> DataFrame:
    """Adds ``weight`` and ``target`` to one row per source (``source, source_size``).

    Sources take the weights in turn, by code point, null last.  ``budget`` is the
    share of all words that is mixed.  Sources of size 0 get 0.
    """
    one = Window.partitionBy()
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    ranked = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    ranked = ranked.withColumn("ceiling", F.col("source_size") * F.lit(float(max_epochs))).withColumn("whole", F.sum("source_size").over(one) * F.lit(float(budget)))
    order = Window.orderBy((F.col("ceiling") / F.col("weight")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("whole") - F.coalesce(F.sum("ceiling").over(order), F.lit(0.0))
    rest = F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(order), F.lit(0.0))
    levels = ranked.withColumn("level", left / rest)
    # The first source that the level of those before it does not fill sets the level.
    level = F.min(F.when(F.col("ceiling") / F.col("weight") >= F.col("level"), F.struct(F.col("ceiling") / F.col("weight"), F.col("level").alias("level")))).over(one)["level"]
    filled = levels.withColumn("target", F.coalesce(F.least("ceiling", level * F.col("weight")), F.col("ceiling")))
    return filled.select("source", "source_size", "weight", "target")


def plan(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3, budget: float = 1.0) -> DataFrame:
    """One row per source: its target, whole repetitions, and the cut of the last one.

    ``sizes``: ``source, size, place`` per document.  A document is repeated ``times``
    times, and once more if its place lies before the cut: in a range below ``cut_range``,
    or in that range and at most at ``cut``.
    """
    places = sizes.withColumn("range", F.shiftright("place", _RANGE_BITS))
    ranges = saved(places.groupBy("source", "range").agg(F.sum("size").alias("size")), "mix-ranges")
    aims = targets(ranges.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs, budget)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    aims = saved(aims.withColumn("times", times).withColumn("missing", F.col("target") - F.col("times") * F.col("source_size")), "mix-aims")
    within = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    running = ranges.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    edges = running.join(aims, same(running, aims)).where((F.col("before") <= F.col("missing")) & (F.col("missing") < F.col("before") + F.col("size"))).select(running["source"], "range", "before", "missing")
    edges = saved(edges, "mix-edges")
    near = places.join(edges, places["source"].eqNullSafe(edges["source"]) & (places["range"] == edges["range"])).select(places["source"], places["range"], "place", places["size"], "before", "missing")
    near = near.groupBy("source", "range", "place", "before", "missing").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("middle", F.col("before") + F.sum("size").over(order) - F.col("size") / 2)
    cuts = near.groupBy("source", F.col("range").alias("cut_range")).agg(F.max(F.when(F.col("middle") <= F.col("missing"), F.col("place"))).alias("cut"))
    return saved(aims.join(cuts, same(aims, cuts), "left").select(aims["source"], "source_size", "target", "times", F.coalesce("cut_range", F.lit(-1)).alias("cut_range"), F.coalesce("cut", F.lit(-1)).alias("cut")), "mix-plan")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3, budget: float = 1.0, seed: int = 7) -> DataFrame:
    """Adds ``size, source_size, target, copies, taken`` to every document.

    A document's size is its number of words; a null or empty text has size 0 and takes
    nothing, and so does every document where all sizes are 0.  A null source is a
    source of its own and comes last.  Rows with one id share a place in the seeded order,
    so they are taken or left together; with a null id likewise.  An empty table gives
    an empty result.  Columns of ``docs`` that have these names are replaced.
    """
    new = ["size", "source_size", "target", "copies", "taken"]
    docs = docs.drop(*[c for c in new if c not in (id_col, text_col, source_col)])
    sized = docs.select(F.col(source_col).alias("source"), words(text_col).alias("size"), draw(id_col, seed).alias("place"))
    aims = plan(saved(sized, "mix-sizes"), weights, max_epochs, budget).withColumnRenamed("source", "__source")
    place, at = draw(id_col, seed), F.col("cut_range")
    extra = (F.shiftright(place, _RANGE_BITS) < at) | ((F.shiftright(place, _RANGE_BITS) == at) & (place <= F.col("cut")))
    out = docs.join(aims, F.col(source_col).eqNullSafe(F.col("__source")))
    out = out.withColumn("size", words(text_col)).withColumn("copies", F.col("times") + extra.cast("long")).withColumn("taken", F.col("size") * F.col("copies"))
    return out.select(*[docs[c] for c in docs.columns], *new)


def repeat(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document of ``mix()`` as many times as it is taken."""
    return mixed.where("copies > 0").withColumn("repetition", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
