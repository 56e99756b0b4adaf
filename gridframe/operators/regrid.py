"""One output grid from chunks that arrive in any order.

The grid's coordinates on an axis are the distinct ones of all chunks, sorted as declared.  A
chunk's placement is where its coordinates are in these.  Positions come from joins on
coordinates, so chunks never gather in one place; only an axis' distinct coordinates do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.storagelevel import StorageLevel

from ..sources.encoding import coordinates
from .frame import NdFrame, NdPlanError


class OverlapError(ValueError):
    """Two chunks that write the same cell."""


@dataclass(frozen=True)
class Regridded:
    """The output grid: a coordinate table per axis (``value, pos``) and the placed cells."""

    axes: tuple[str, ...]
    coordinates: dict[str, DataFrame]
    cells: DataFrame  # flat rows: the columns, and pos_<axis> of each axis

    def overlaps(self, chunk: str) -> DataFrame:
        """The cells that several chunks write: positions and the chunks' keys."""
        at = [f"pos_{a}" for a in self.axes]
        return self.cells.groupBy(*at).agg(F.array_sort(F.collect_set(chunk)).alias("chunks")).where(F.size("chunks") > 1)

    def check(self, chunk: str) -> Regridded:
        """Raises if two chunks write a cell."""
        found = self.overlaps(chunk).orderBy(*[f"pos_{a}" for a in self.axes]).take(1)
        if found:
            raise OverlapError(f"chunks {found[0]['chunks']} overlap at " + ", ".join(f"{a} {found[0][f'pos_{a}']}" for a in self.axes))
        return self

    def dense(self) -> DataFrame:
        """Every cell of the output grid, with its coordinates; what no chunk wrote is null."""
        frames = [self.coordinates[a].select(F.col("value").alias(a), F.col("pos").alias(f"pos_{a}")) for a in self.axes]
        grid = reduce(DataFrame.crossJoin, frames)  # the product of the axes is the output itself
        at = [f"pos_{a}" for a in self.axes]
        return grid.join(self.cells.drop(*self.axes), at, "left")

    def write(self, sink: Callable[[DataFrame], DataFrame | None]) -> DataFrame:
        """Hands the placed cells to a sink, or every cell of the grid if it ``requires_grid``; gives one row ``count``.

        What the sink returns is what it wrote, and is counted; a sink that returns nothing has the cells computed for it again.
        """
        cells = self.dense() if getattr(sink, "requires_grid", False) else self.cells
        written = sink(cells)
        return (cells if written is None else written).agg(F.count("*").alias("count"))


@dataclass(frozen=True)
class TableSink:
    """Writes cells as a table of files and reads it back; ``requires_grid`` asks for every cell of the output grid."""

    path: str
    requires_grid: bool = False
    format: str = "parquet"
    mode: str = "errorifexists"

    def __call__(self, cells: DataFrame) -> DataFrame:
        cells.write.format(self.format).mode(self.mode).save(self.path)
        return cells.sparkSession.read.format(self.format).schema(cells.schema).load(self.path)


def _placed(frame: NdFrame, axes: tuple[tuple[str, bool], ...], known: dict[str, str]) -> tuple[dict[str, DataFrame], NdFrame]:
    compact = frame.with_coordinates().compact()
    # Read once per axis and once for the cells; also ends the expressions above.
    compact = replace(compact, df=compact.df.persist(StorageLevel.MEMORY_AND_DISK))
    missing = [a for a, _ in axes if known.get(a) not in compact.shown]
    if missing:
        raise NdPlanError(f"the coordinates of {', '.join(missing)} are not selected")
    tables = {}
    for a, descending in axes:
        values = compact.df.select(F.explode(F.col(known[a])["values"]).alias("value")).distinct()
        checked = values.select(F.when(F.col("value").isNull(), F.raise_error(F.lit(f"axis {a} has a null coordinate"))).otherwise(F.col("value")).alias("value"))
        order = F.col("value").desc() if descending else F.col("value").asc()
        tables[a] = checked.withColumn("pos", F.row_number().over(Window.orderBy(order)) - 1)
    return tables, compact


def regrid(frame: NdFrame) -> Regridded:
    """Places the selected cells of all chunks on one grid.

    The frame must declare its grid axes, its columns must lie on these only, and their
    coordinates must be in the schema.  Null coordinates and a coordinate that repeats in a
    chunk are errors.
    """
    if frame.grid_axes is None:
        raise NdPlanError("regrid needs declared grid axes")
    known = coordinates(frame.df.schema)
    names = tuple(a for a, _ in frame.grid_axes)
    beyond = [a for a in frame.axes() if a not in names]
    if beyond:
        raise NdPlanError(f"axes {', '.join(beyond)} are not declared")
    lacking = [a for a in names if a not in known]
    if lacking:
        raise NdPlanError(f"axes {', '.join(lacking)} have no coordinate column")
    spanned = tuple((a, d) for a, d in frame.grid_axes if a in frame.axes())
    tables, compact = _placed(frame, spanned, known)
    unique = [F.size(F.array_distinct(F.col(known[a])["values"])) == F.size(F.col(known[a])["values"]) for a, _ in spanned]
    ok = reduce(lambda x, y: x & y, unique, F.lit(True))
    safe = compact.df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("a coordinate repeats in a chunk"))))
    flat = NdFrame.of(safe, compact.dims).to_df()
    for a, _ in spanned:
        flat = flat.join(tables[a].select(F.col("value").alias(f"__v_{a}"), F.col("pos").alias(f"pos_{a}")), F.col(known[a]) == F.col(f"__v_{a}")).drop(f"__v_{a}")
    return Regridded(tuple(a for a, _ in spanned), tables, flat)
