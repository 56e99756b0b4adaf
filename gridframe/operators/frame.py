"""Frames of grid chunks: filter, project, limit and reduce on the compact form.

An ``NdFrame`` is a DataFrame of encoded chunks and what has been selected of them.  Filters on
one axis become index lists, computed once per axis and chunk; other filters and the grid itself
appear only at the boundary, ``to_df()``, as one ``explode`` per axis.  Everything is a column
expression, so Catalyst prunes columns and keeps the whole boundary in generated code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.grid import axis_indices, cell_index, conjuncts, grid_size, indices, is_volatile, quoted, references, rewritten, selection_kind, stride, target_axes
from ..sources.encoding import KEY, coordinates, dims_of, encode, is_encoded, validate

_REDUCE = ("mean", "min", "max", "first")


class NdPlanError(ValueError):
    """A plan that cannot be: an unknown column or axis, or schemas that do not fit."""


def _computed(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Adds columns that are computed once, whatever uses them.

    The optimizer would copy long expressions into each of their uses; it does not look through a
    generator, here of one row.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__made")
    kept = [c for c in df.columns if c not in columns]
    return df.select("*", made).select(*kept, *[F.col("__made")[n].alias(n) for n in columns])


@dataclass(frozen=True)
class NdFrame:
    """Chunks, one a row.  ``dims``: axes of grid columns; other columns are scalars of their chunk."""

    df: DataFrame
    dims: Mapping[str, tuple[str, ...]]
    shown: tuple[str, ...]
    used: tuple[str, ...]
    on_axis: tuple[tuple[str, str], ...] = ()  # (axis, predicate)
    residual: tuple[str, ...] = ()
    per_row: tuple[tuple[str, str], ...] = ()  # volatile expressions and their names
    grid_axes: tuple[tuple[str, bool], ...] | None = None  # (axis, descending)
    cells: str | None = None  # a column with the selected cells, once they are fixed,
    cell_axes: tuple[str, ...] = ()  # and the grid that these number
    notes: tuple[str, ...] = field(default=("source",))

    # Making and describing

    @staticmethod
    def of(df: DataFrame, dims: Mapping[str, Sequence[str]] | None = None, grid_axes: Sequence[str | tuple[str, bool]] | None = None) -> NdFrame:
        """A frame from encoded chunks.  ``dims`` gives axes that the schema's metadata does not."""
        found = {}
        for f in df.schema:
            validate(f)
            if is_encoded(f):
                axes = (dims or {}).get(f.name, dims_of(f))
                if axes is None:
                    raise NdPlanError(f"the axes of {f.name} are not known; give them as dims")
                found[f.name] = tuple(axes)
        axes = None if grid_axes is None else tuple((a, False) if isinstance(a, str) else tuple(a) for a in grid_axes)
        return NdFrame(df, found, tuple(df.columns), (), grid_axes=axes)

    def explain(self) -> str:
        """What happens on chunks, in order, and the grid at the boundary."""
        return f"boundary: grid=[{', '.join(self.axes())}] region=[{', '.join(reversed(self.notes))}]" + (f" grid_axes=[{', '.join(a for a, _ in self.grid_axes)}]" if self.grid_axes else "")

    def _noted(self, note: str, **changes) -> NdFrame:
        return replace(self, notes=(*self.notes, note), **changes)

    def _in_grid(self) -> dict[str, tuple[str, ...]]:
        """The columns that span the grid: those shown, and those that a filter used."""
        return {c: self.dims[c] for c in self.df.columns if c in self.dims and (c in self.shown or c in self.used)}

    def axes(self) -> list[str]:
        """The grid's axes."""
        return list(self.cell_axes) if self.cells else target_axes(self._in_grid())

    # Operators on chunks

    def filter(self, *predicates: str) -> NdFrame:
        """Keeps the cells for which every predicate (SQL) is true; false and null both drop.

        Predicates are split at AND; a part whose columns lie on one and the same axis selects indices of it.  The columns
        of a predicate count for the grid like selected ones.
        """
        out = self
        for p in (c for whole in predicates for c in conjuncts(whole)):
            columns = references(p, self.df.columns)
            used = (*out.used, *(c for c in columns if c not in out.used))
            axes = {a for c in columns for a in self.dims.get(c, ())}
            if out.cells:
                if is_volatile(p) or not axes <= set(out.cell_axes):
                    raise NdPlanError(f"after a limit, {p} needs flat rows")
                out = out._noted(f"filter {p}", used=used, df=_computed(out.df, {out.cells: out._tested(out.cells, out.cell_axes, [p])}))
            elif len(axes) == 1 and not is_volatile(p):
                out = out._noted(f"filter {p} on {min(axes)}", used=used, on_axis=(*out.on_axis, (min(axes), p)))
            else:
                out = out._noted(f"filter {p}", used=used, residual=(*out.residual, p))
        return out

    def _tested(self, cells: str, axes: Sequence[str], predicates: Sequence[str]) -> Column:
        """Those of the cells for which the predicates are true."""
        index = {a: cell_index("__cell", axes, a) for a in axes}
        value = {c: f"get({quoted(c)}.values, cast({' + '.join([f'{index[a]} * {stride(c, a)}' for a in axes if a in self.dims[c]]) or '0'} AS int))" for c in self.dims}
        test = " AND ".join(f"({rewritten(p, value)})" for p in predicates)
        return F.expr(f"filter({quoted(cells)}, __cell -> {test})")

    def select(self, *columns: str | tuple[str, str]) -> NdFrame:
        """Columns by name, or ``(expression, name)``.

        An expression is evaluated on the axes of its own columns only; a volatile one per flat
        row.  A literal lies on no axis.
        """
        shown, made, per_row = [], {}, []
        for c in columns:
            if isinstance(c, str):
                if c not in self.df.columns:
                    raise NdPlanError(f"no column {c}")
                shown.append(c)
                continue
            expression, name = c
            shown.append(name)
            if is_volatile(expression):
                per_row.append((expression, name))
            else:
                made[name] = expression
        out = self
        for name, expression in made.items():
            hidden = f"__own_{name}"
            if name in self.df.columns:  # what filters use stays as it was
                out = replace(out, df=out.df.withColumn(hidden, F.col(quoted(name))), dims={**out.dims, **({hidden: out.dims[name]} if name in out.dims else {})}, used=tuple(hidden if u == name else u for u in out.used),
                              on_axis=tuple((a, rewritten(p, {name: hidden})) for a, p in out.on_axis), residual=tuple(rewritten(p, {name: hidden}) for p in out.residual))
        base = self
        dims, values = dict(out.dims), {}
        for name, expression in made.items():
            values[name], axes = base._footprint(expression, name)
            dims.pop(name, None)
            if axes is not None:
                dims[name] = axes
        # Else the boundary, or an expression on one of these, would compute them once per cell.
        df = _computed(out.df, values) if values else out.df
        more = [c for e, _ in per_row for c in references(e, self.df.columns)]
        return out._noted("project", df=df, dims=dims, shown=tuple(shown), used=tuple(dict.fromkeys([*out.used, *more])), per_row=tuple(per_row))

    def _footprint(self, expression: str, name: str):
        """A grid column of an expression on the union of its columns' axes; the axes (None: a scalar)."""
        columns = [c for c in references(expression, self.df.columns) if c in self.dims]
        axes = target_axes({c: self.dims[c] for c in self.df.columns if c in columns})
        if not columns:
            return F.expr(expression), None
        size = {a: grid_size(columns, a) for a in axes}
        total = " * ".join(f"({s})" for s in size.values()) or "1"
        place, after = {}, []
        for a in reversed(axes):
            place[a] = f"(__i div ({' * '.join(after) or '1'}) % ({size[a]}))"
            after.insert(0, f"({size[a]})")
        value = {c: f"get({quoted(c)}.values, cast({' + '.join([f'{place[a]} * {stride(c, a)}' for a in axes]) or '0'} AS int))" for c in columns}
        values = F.expr(f"transform({indices(total)}, __i -> {rewritten(expression, value)})")
        return encode(values, [F.expr(size[a]) for a in axes], axes, name), tuple(axes)

    def union(self, *others: NdFrame) -> NdFrame:
        """All chunks of frames with the same columns; each chunk keeps its grid."""
        df, first = self._settled().df, self
        for o in others:
            if o.shown != self.shown or [o.dims.get(c) for c in o.shown] != [self.dims.get(c) for c in self.shown]:
                raise NdPlanError("union needs the same columns on the same axes")
            df = df.unionByName(o._settled().df)
        same = all(o.grid_axes == first.grid_axes for o in others)
        settled = self._settled()
        return replace(settled, df=df, grid_axes=first.grid_axes if same else None)._noted("union")

    def repartition(self, n: int, *by: str) -> NdFrame:
        """Deals out whole chunks, round robin or by scalar columns."""
        return self._noted(f"repartition {n}", df=self.df.repartition(n, *by))

    def coalesce(self, n: int = 1) -> NdFrame:
        """Merges partitions of whole chunks."""
        return self._noted(f"coalesce {n}", df=self.df.coalesce(n))

    def limit(self, count: int, offset: int = 0, *, order: Sequence[str]) -> NdFrame:
        """The kept cells from the ``offset``-th on, at most ``count``, over chunks in the order of scalar columns.

        Only one number per chunk goes to the running total.
        """
        fixed = self._fixed()
        kept = fixed.df.withColumn("__kept", F.size(fixed.cells).cast("long"))
        before = F.coalesce(F.sum("__kept").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = kept.select(*order, "__kept").withColumn("__before", before).drop("__kept").withColumnsRenamed({o: f"__o_{o}" for o in order})
        match = [F.col(o).eqNullSafe(F.col(f"__o_{o}")) for o in order]
        cut = kept.join(sums, match).where((F.col("__before") < offset + count) & (F.col("__before") + F.col("__kept") > offset))
        start = F.greatest(F.lit(offset) - F.col("__before"), F.lit(0))
        stop = F.least(F.lit(offset + count) - F.col("__before"), F.col("__kept"))
        cut = cut.withColumn(fixed.cells, F.slice(fixed.cells, F.greatest(start + 1, F.lit(1)).cast("int"), F.greatest(stop - start, F.lit(0)).cast("int")))
        return fixed._noted(f"limit {count} offset {offset}", df=cut.drop("__kept", "__before", *[f"__o_{o}" for o in order]))

    def limit_rows(self, count: int) -> DataFrame:
        """Any ``count`` flat rows; Spark stops the scan early."""
        return self.to_df().limit(count)

    # Selections

    def _sized(self) -> tuple[DataFrame, list[str]]:
        grid = self._in_grid()
        axes = target_axes(grid)
        return self.df.withColumns({f"__n_{a}": F.expr(grid_size(list(grid), a)) for a in axes}), axes

    def _kept_indices(self, axis: str) -> str:
        """SQL of an axis' indices that the predicates on it keep."""
        own = [p for a, p in self.on_axis if a == axis]
        every = indices(quoted(f"__n_{axis}"))
        if not own:
            return every
        value = {c: f"get({quoted(c)}.values, cast(__i * {stride(c, axis)} AS int))" for c in self.dims}
        return f"filter({every}, __i -> {' AND '.join(f'({rewritten(p, value)})' for p in own)})"

    def _fixed(self) -> NdFrame:
        """The frame with a column of selected cells in place of predicates."""
        if self.cells:
            return self
        df, axes = self._sized()
        product = F.expr("array(cast(0 AS int))")
        for a in axes:
            product = (lambda p, kept, n: F.flatten(F.transform(p, lambda c: F.transform(kept, lambda i: c * n + i))))(product, F.expr(self._kept_indices(a)), F.col(quoted(f"__n_{a}")))
        if not self.residual:
            df = _computed(df, {"__selected": product})
        else:
            df = _computed(_computed(df, {"__selected": product}), {"__selected": self._tested("__selected", axes, self.residual)})
        return replace(self, df=df, on_axis=(), residual=(), cells="__selected", cell_axes=tuple(axes))

    def selection(self) -> DataFrame:
        """Each chunk's scalars with ``kept`` cells, of ``total``, and the ``kind`` of its selection."""
        fixed = self._fixed()
        axes = fixed.axes()
        total = " * ".join(quoted(f"__n_{a}") for a in axes) or "1"
        scalars = [c for c in self.df.columns if c not in self.dims]
        return fixed.df.select(*scalars, F.size(fixed.cells).cast("long").alias("kept"), F.expr(f"cast({total} AS long)").alias("total"), F.expr(selection_kind(fixed.cells, axes)).alias("kind"))

    def _settled(self) -> NdFrame:
        """The frame compacted if anything is selected, else its shown columns."""
        if self.on_axis or self.residual or self.cells:
            return self.compact()
        if self.per_row:
            raise NdPlanError("a volatile expression needs flat rows")
        return replace(self, df=self.df.select(*self.shown), used=())

    def compact(self) -> NdFrame:
        """Chunks cut to what is selected; chunks with nothing left go.

        A selection that is a product of index sets becomes a smaller dense grid.  Any other
        keeps its grid, and columns that span the whole grid are null in the dropped cells.
        """
        if self.per_row:
            raise NdPlanError("a volatile expression needs flat rows")
        fixed = self._fixed()
        axes = fixed.axes()
        cells = quoted(fixed.cells)
        df = _computed(fixed.df.where(F.size(fixed.cells) > 0), {f"__k_{a}": F.expr(axis_indices(cells, axes, a)) for a in axes} | {"__one": F.lit(1)})
        product = " * ".join(f"size({quoted(f'__k_{a}')})" for a in axes) or "1"
        total = " * ".join(quoted(f"__n_{a}") for a in axes) or "1"
        box = f"{product} = size({cells})"
        df = _computed(df, {"__box": F.expr(box), "__mask": F.expr(f"if({box}, null, map_from_arrays({cells}, transform({cells}, __c -> true)))")})
        out, made = [], {}
        for c in self.shown:
            if c not in self.dims:
                out.append(F.col(c))
                continue
            own = self.dims[c]
            kept = {a: f"if({stride(c, a)} = 0, array(0), {quoted(f'__k_{a}')})" for a in own}
            place, after = {}, []
            for a in reversed(own):
                place[a] = f"get({kept[a]}, cast(__i div ({' * '.join(after) or '1'}) % size({kept[a]}) AS int))"
                after.insert(0, f"size({kept[a]})")
            count = " * ".join(after) or "1"
            at = " + ".join(f"{place[a]} * {stride(c, a)}" for a in own) or "0"
            boxed = f"transform({indices(count)}, __i -> get({quoted(c)}.values, cast({at} AS int)))"
            sizes = f"array({', '.join(f'size({kept[a]})' for a in own)})" if own else "cast(array() AS array<int>)"
            names = f"array({', '.join(repr(a) for a in own)})" if own else "cast(array() AS array<string>)"
            kept_value = f"named_struct('values', {boxed}, 'dim_sizes', {sizes}, 'dim_names', {names})"
            masked = f"{quoted(c)}"
            if set(own) == set(axes):
                at = " + ".join(f"{cell_index('__i', axes, a)} * {stride(c, a)}" for a in axes) or "0"
                whole = f"transform({indices(f'cast({total} AS int)')}, __i -> if(try_element_at(__mask, __i), get({quoted(c)}.values, cast({at} AS int)), null))"
                masked = f"named_struct('values', {whole}, 'dim_sizes', array({', '.join(quoted(f'__n_{a}') for a in axes)}), 'dim_names', array({', '.join(repr(a) for a in axes)}))"
            made[f"__new_{c}"] = F.expr(f"if({quoted(c)} IS NULL, null, if(__box, {kept_value}, {masked}))")
            out.append(F.col(quoted(f"__new_{c}")).alias(c, metadata={KEY: {"version": 1, "dims": list(own)}}))
        return NdFrame((_computed(df, made) if made else df).select(*out), {c: self.dims[c] for c in self.shown if c in self.dims}, self.shown, (), grid_axes=self.grid_axes, notes=(*self.notes, "compact"))

    def to_encoded(self) -> DataFrame:
        """Encoded chunks of what is selected; see ``compact``."""
        return self._settled().df

    def coarsen(self, factors: Mapping[str, int], how: str = "mean") -> NdFrame:
        """Blocks of ``factors`` cells on the named axes reduced to one each, within chunks.

        The last block may be short.  Nulls are left out; a block of nulls is null.  ``mean`` makes
        every numeric column a double; ``min`` and ``max`` pass over NaN beside numbers; columns that
        are not numbers take the first value, and so does ``first``.  An unknown axis changes
        nothing.
        """
        if how not in _REDUCE or any(f < 1 for f in factors.values()):
            raise NdPlanError("coarsen needs factors of 1 or more and one of " + ", ".join(_REDUCE))
        base = self._settled()
        types = {f.name: f.dataType["values"].dataType.elementType.simpleString() for f in base.df.schema if f.name in base.dims}
        out, made = [], {}
        for c in base.shown:
            if c not in base.dims:
                out.append(F.col(c))
                continue
            own = base.dims[c]
            numeric = types[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or types[c].startswith("decimal")
            size = {a: f"coalesce({grid_size([c], a)}, 1)" for a in own}
            factor = {a: f"if({size[a]} = 1, 1, {factors.get(a, 1)})" for a in own}
            blocks = {a: f"cast(ceil({size[a]} / {factor[a]}) AS int)" for a in own}
            at, inside, after, within = [], [], [], []
            for a in reversed(own):
                index = f"((__o div ({' * '.join(after) or '1'}) % {blocks[a]}) * {factor[a]} + (__j div ({' * '.join(within) or '1'}) % {factor[a]}))"
                at.append(f"{index} * {stride(c, a)}")
                inside.append(f"{index} < {size[a]}")
                after.insert(0, blocks[a])
                within.insert(0, factor[a])
            cell = f"get({quoted(c)}.values, cast({' + '.join(at) or '0'} AS int))"
            members = f"transform({indices(' * '.join(within) or '1')}, __j -> if({' AND '.join(inside) or 'true'}, {cell}, null))"
            if how == "first" or not numeric:
                reduced = f"get({members}, 0)"
            elif how == "mean":
                reduced = f"aggregate({members}, named_struct('s', 0D, 'n', 0L), (__a, __v) -> if(__v IS NULL, __a, named_struct('s', __a.s + cast(__v AS double), 'n', __a.n + 1L)), __a -> if(__a.n = 0, null, __a.s / __a.n))"
            else:
                there = f"filter({members}, __v -> __v IS NOT NULL)"
                if types[c] in ("float", "double"):
                    there = f"if(exists({there}, __v -> NOT isnan(__v)), filter({there}, __v -> NOT isnan(__v)), {there})"
                reduced = f"array_{how}({there})"
            values = f"transform({indices(' * '.join(after) or '1')}, __o -> {reduced})"
            sizes = f"array({', '.join(blocks[a] for a in own)})" if own else "cast(array() AS array<int>)"
            names = f"array({', '.join(repr(a) for a in own)})" if own else "cast(array() AS array<string>)"
            made[f"__new_{c}"] = F.expr(f"if({quoted(c)} IS NULL, null, named_struct('values', {values}, 'dim_sizes', {sizes}, 'dim_names', {names}))")
            out.append(F.col(quoted(f"__new_{c}")).alias(c, metadata={KEY: {"version": 1, "dims": list(own)}}))
        return replace(base, df=(_computed(base.df, made) if made else base.df).select(*out))._noted(f"coarsen {dict(factors)} {how}")

    def with_coordinates(self) -> NdFrame:
        """Also shows the coordinate columns of the shown columns' axes."""
        known = coordinates(self.df.schema)
        spanned = target_axes({c: self.dims[c] for c in self.shown if c in self.dims})
        return replace(self, shown=(*self.shown, *(known[a] for a in spanned if a in known and known[a] not in self.shown)))

    # The boundary

    def to_df(self) -> DataFrame:
        """Flat rows, one for each selected cell: a chunk's columns on the grid of the used ones.

        A used column with other than as many values as its sizes multiply to is an error.
        """
        grid = self._in_grid()
        df, axes = (self.df, self.axes()) if self.cells else self._sized()
        whole = [f"{quoted(c)}.values IS NULL OR size({quoted(c)}.values) = aggregate({quoted(c)}.dim_sizes, 1L, (x, y) -> x * y)" for c in grid if not c.startswith("__")]
        if whole:
            wrong = F.raise_error(F.lit("a grid column has more or fewer values than its sizes say"))
            df = df.where(F.when(F.expr(" AND ".join(f"({x})" for x in whole)), F.lit(True)).otherwise(wrong))
        scalars = [c for c in df.columns if c not in self.dims and (c in self.shown or c in self.used or c.startswith("__") or any(c in references(p, [c]) for p in (*self.residual, *(e for e, _ in self.per_row))))]
        df = df.withColumns({f"__s_{c}_{a}": F.expr(stride(c, a)) for c, own in grid.items() for a in own})
        steps = [f"__s_{c}_{a}" for c, own in grid.items() for a in own]
        if self.cells:
            df = df.select(*scalars, *grid, *steps, F.explode(self.cells).alias("__cell"))
            df = df.withColumns({f"__i_{a}": F.expr(cell_index("__cell", axes, a)) for a in axes})
        else:
            df = df.select(*dict.fromkeys(scalars), *grid, *steps, *[F.expr(self._kept_indices(a)).alias(f"__k_{a}") for a in axes])
            for a in axes:
                df = df.select("*", F.explode(f"__k_{a}").alias(f"__i_{a}")).drop(f"__k_{a}")
        value = {c: F.expr(f"get({quoted(c)}.values, {' + '.join([f'{quoted(f"__i_{a}")} * {quoted(f"__s_{c}_{a}")}' for a in own]) or '0'})").alias(c) for c, own in grid.items()}
        flat = df.select(*[c for c in dict.fromkeys(scalars) if not c.startswith("__")], *value.values())
        for p in self.residual:
            flat = flat.where(F.expr(p))
        extra = dict((n, e) for e, n in self.per_row)
        return flat.select(*[F.expr(extra[c]).alias(c) if c in extra else F.col(quoted(c)) for c in self.shown])

    def count(self) -> DataFrame:
        """``count``: how many cells of the full grid are selected, without building them."""
        fixed = self._fixed()
        return fixed.df.agg(F.coalesce(F.sum(F.size(fixed.cells).cast("long")), F.lit(0)).alias("count"))

    def work(self) -> DataFrame:
        """Per chunk: ``cells`` of the grid, ``stored`` values, and ``compared``, the values that axis filters read."""
        df, axes = self._sized()
        scalars = [c for c in df.columns if c not in self.dims and not c.startswith("__")]
        stored = " + ".join(f"coalesce(size({quoted(c)}.values), 0)" for c in self._in_grid()) or "0"
        compared = " + ".join(quoted(f"__n_{a}") for a, _ in self.on_axis) or "0"
        total = " * ".join(quoted(f"__n_{a}") for a in axes) or "1"
        return df.select(*scalars, F.expr(f"cast({total} AS long)").alias("cells"), F.expr(f"cast({stored} AS long)").alias("stored"), F.expr(f"cast({compared} AS long)").alias("compared"))
