"""Expressions over grid columns: references, axis sizes, strides, selections.

A grid column is ``struct<values: array<T>, dim_sizes: array<int>, dim_names: array<string>>``,
values in row-major order.  Axes are matched by name, so a chunk may have them in any order, may
lack some, or may lack the column (a null struct is a null on no axis).
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|`[^`]+`|(?<![A-Za-z0-9_.])[A-Za-z_][A-Za-z0-9_]*(?!\s*\()")
#: Functions whose value changes from row to row.
_VOLATILE = re.compile(r"\b(rand|randn|random|randstr|uniform|uuid|shuffle|monotonically_increasing_id|spark_partition_id)\s*\(", re.I)


def references(expression: str, names: Sequence[str]) -> list[str]:
    """The columns of ``names`` that an SQL expression uses, in the order of their first use."""
    known = {n.lower(): n for n in names}
    found = (known.get(m[0].strip("`").lower()) for m in _TOKEN.finditer(expression) if m[0][0] != "'")
    return list(dict.fromkeys(x for x in found if x))


def rewritten(expression: str, replacements: Mapping[str, str]) -> str:
    """The expression with columns replaced by other SQL."""
    known = {n.lower(): r for n, r in replacements.items()}
    return _TOKEN.sub(lambda m: known.get(m[0].strip("`").lower(), m[0]) if m[0][0] != "'" else m[0], expression)


def is_volatile(expression: str) -> bool:
    """Whether it must be evaluated once per flat row."""
    return bool(_VOLATILE.search(expression))


def conjuncts(predicate: str) -> list[str]:
    """The parts of a predicate that AND joins at its top, as Spark parses it; itself if there is one."""
    spark = SparkSession.getActiveSession()
    if spark is None or not re.search(r"\band\b", predicate, re.I):
        return [predicate]
    parser = spark._jsparkSession.sessionState().sqlParser()

    def parts(e) -> list[str]:
        return [*parts(e.left()), *parts(e.right())] if e.nodeName() == "And" else [e.sql()]

    found = parts(parser.parseExpression(predicate))
    return found if len(found) > 1 else [predicate]


def target_axes(columns: Mapping[str, Sequence[str]]) -> list[str]:
    """The axes of the grid that columns span: the widest column's (the last of several), then others by first use."""
    widest: Sequence[str] = ()
    for axes in columns.values():
        if len(axes) >= len(widest):
            widest = axes
    return list(dict.fromkeys([*widest, *(a for axes in columns.values() for a in axes)]))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _place(column: str, axis: str) -> str:
    return f"cast(coalesce(array_position({quoted(column)}.dim_names, '{axis}'), 0) AS int)"


def axis_size(column: str, axis: str) -> str:
    """SQL of a column's size on an axis; null where a chunk's column lacks it."""
    return f"get({quoted(column)}.dim_sizes, {_place(column, axis)} - 1)"


def grid_size(columns: Sequence[str], axis: str) -> str:
    """SQL of the grid's size on an axis; 1 where no column has it.  Sizes other than 1 must agree."""
    sizes = ", ".join(axis_size(c, axis) for c in columns)
    wrong = f"cast(raise_error('sizes of axis {axis} do not match') AS int)"
    return f"aggregate(array({sizes}), 1, (__m, __n) -> CASE WHEN __n IS NULL OR __n = 1 OR __n = __m THEN __m WHEN __m = 1 THEN __n ELSE {wrong} END)"


def stride(column: str, axis: str) -> str:
    """SQL of how far the next index on an axis is in a column's values; 0 if it does not advance."""
    sizes = f"{quoted(column)}.dim_sizes"
    after = f"slice({sizes}, {_place(column, axis)} + 1, size({sizes}))"
    return f"if(coalesce({axis_size(column, axis)}, 1) = 1, 0, aggregate({after}, 1, (__x, __y) -> __x * __y))"


def indices(size: str) -> str:
    """SQL of ``[0, size)``; ``sequence`` alone would count down."""
    return f"if({size} <= 0, cast(array() AS array<int>), sequence(0, cast({size} - 1 AS int)))"


def cell_index(cell: str, axes: Sequence[str], axis: str) -> str:
    """SQL of a row-major cell number's index on an axis, with sizes in columns ``__n_<axis>``."""
    inner = axes[list(axes).index(axis) + 1 :]
    step = " * ".join([quoted(f"__n_{a}") for a in inner]) or "1"
    return f"cast({cell} div ({step}) % {quoted(f'__n_{axis}')} AS int)"


# Selections as arrays of row-major cell numbers, ascending.


def intersect_cells(a: str | Column, b: str | Column) -> Column:
    """Cells of both selections."""
    return F.array_intersect(a, b)


def slice_cells(cells: str | Column, offset: int | Column, count: int | Column) -> Column:
    """``count`` selected cells from the ``offset``-th on; fewer at the end."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    count = F.lit(count) if isinstance(count, int) else count
    return F.slice(cells, (offset + 1).cast("int"), F.greatest(count, F.lit(0)).cast("int"))


def axis_indices(cells: str, axes: Sequence[str], axis: str) -> str:
    """SQL of the indices on an axis that selected cells have, ascending."""
    return f"array_sort(array_distinct(transform({cells}, __c -> {cell_index('__c', axes, axis)})))"


def selection_kind(cells: str, axes: Sequence[str]) -> str:
    """SQL of the coarsest kind that says the same: ``full``, ``axis``, ``ragged`` or ``mask``.

    ``axis``: a product of index sets.  ``ragged``: for each outer cell the first few cells on the
    last axis.
    """
    if not axes:
        return f"if(size({cells}) = 1, 'full', 'mask')"
    total = " * ".join(quoted(f"__n_{a}") for a in axes)
    product = " * ".join(f"size({axis_indices(cells, axes, a)})" for a in axes)
    inner = quoted(f"__n_{axes[-1]}")
    # Every kept cell but a first one follows another kept cell of its outer cell.
    prefix = f"forall({cells}, __c -> __c % {inner} = 0 OR array_contains({cells}, __c - 1))"
    return f"CASE WHEN size({cells}) = {total} THEN 'full' WHEN size({cells}) = {product} THEN 'axis' WHEN {prefix} THEN 'ragged' ELSE 'mask' END"


def axis_order(values: str | Column) -> Column:
    """``ascending``, ``descending`` or ``unordered``; nulls are unordered, short and constant arrays ascend."""
    v = F.col(values) if isinstance(values, str) else values
    steps = lambda test: F.forall(F.zip_with(F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), test)
    return F.when(F.exists(v, lambda x: x.isNull()), "unordered").when(steps(lambda s: s["a"] <= s["b"]), "ascending").when(steps(lambda s: s["a"] >= s["b"]), "descending").otherwise("unordered")
