"""Which chunks a query can need: index ranges on axes, and a manifest of chunks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.grid import conjuncts, references


def axis_ranges(coordinates: Mapping[str, DataFrame], *predicates: str) -> DataFrame:
    """``axis, start, stop``: the runs of indices that the predicates keep, per constrained axis.

    ``coordinates``: per axis a frame ``pos`` and a column named like the axis.  Predicates are split at AND; parts that use
    other columns, or several, constrain nothing; null coordinates are dropped.
    """
    predicates = [c for p in predicates for c in conjuncts(p)]
    found = None
    for axis, frame in coordinates.items():
        others = [c for a in coordinates for c in (a,) if a != axis]
        own = [p for p in predicates if references(p, [axis]) and not references(p, others) and _only(p, axis)]
        if not own:
            continue
        kept = frame.where(" AND ".join(f"({p})" for p in own))
        runs = kept.withColumn("run", F.col("pos") - F.row_number().over(Window.orderBy("pos"))).groupBy("run").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"))
        part = runs.select(F.lit(axis).alias("axis"), "start", "stop")
        found = part if found is None else found.unionByName(part)
    if found is None:
        spark = next(iter(coordinates.values())).sparkSession
        return spark.createDataFrame([], "axis string, start int, stop int")
    return found


def _only(predicate: str, axis: str) -> bool:
    """Whether no other identifier stands in a predicate."""
    words = "and or not is null true false between in like case when then else end div".split()
    import re

    names = re.findall(r"(?<![\w.'])[A-Za-z_]\w*", re.sub(r"'[^']*'", "", predicate))
    return all(n.lower() in (*words, axis.lower()) for n in names)


def needed(manifest: DataFrame, ranges: DataFrame, constrained: list[str]) -> DataFrame:
    """The chunks of a manifest that overlap the ranges on every constrained axis.

    ``manifest``: one row per chunk with ``placement``, a map from axis to ``struct<origin, size>``.
    An axis that a chunk lacks does not count.  The ranges of one query are few; they are sent
    to the scan as literals, so they can prune files and row groups of the manifest.
    """
    rows = [(r["axis"], r["start"], r["stop"]) for r in ranges.collect()]
    out = manifest
    for axis in constrained:
        at = F.col("placement")[axis]
        test = F.lit(False)
        for _, start, stop in (r for r in rows if r[0] == axis):
            test = test | ((F.lit(start) < at["origin"] + at["size"]) & (at["origin"] < F.lit(stop)))
        out = out.where(at.isNull() | test)
    return out
