"""The encoded form of grids: one row per chunk, one struct per column.

Field metadata ``{"nd.array": {"version": 1, "dims": [...]}}`` names a column's axes at plan time.
Any Spark file format that keeps nested types stores encoded chunks; Parquet also keeps the
metadata.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY, VERSION = "nd.array", 1


def encoded_type(element: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("values", T.ArrayType(element)), T.StructField("dim_sizes", T.ArrayType(T.IntegerType())), T.StructField("dim_names", T.ArrayType(T.StringType()))])


def encoded_field(name: str, element: T.DataType, dims: Sequence[str] | None = None) -> T.StructField:
    """A grid column's field; ``dims`` are its axes, if they are known."""
    about: dict[str, Any] = {"version": VERSION} | ({"dims": list(dims)} if dims is not None else {})
    return T.StructField(name, encoded_type(element), True, {KEY: about})


def is_encoded(field: T.StructField) -> bool:
    kind = field.dataType
    return isinstance(kind, T.StructType) and kind.fieldNames() == ["values", "dim_sizes", "dim_names"] and isinstance(kind["values"].dataType, T.ArrayType)


def validate(field: T.StructField) -> None:
    """Raises if a field that calls itself a grid column is not one this version can read."""
    about = field.metadata.get(KEY)
    if about is not None and about.get("version", VERSION) != VERSION:
        raise ValueError(f"{field.name}: encoding version {about['version']} is not {VERSION}")
    if about is not None and not is_encoded(field):
        raise ValueError(f"{field.name}: not struct<values, dim_sizes, dim_names>")
    if is_encoded(field):
        sizes, names = field.dataType["dim_sizes"].dataType, field.dataType["dim_names"].dataType
        if not isinstance(sizes, T.ArrayType) or not isinstance(sizes.elementType, T.IntegerType) or not isinstance(names, T.ArrayType) or not isinstance(names.elementType, T.StringType):
            raise ValueError(f"{field.name}: dim_sizes must be array<int> and dim_names array<string>")
    dims = (about or {}).get("dims")
    if dims is not None and (len(set(dims)) < len(dims) or "" in dims):
        raise ValueError(f"{field.name}: axis names must be distinct and not empty")


def dims_of(field: T.StructField) -> list[str] | None:
    return field.metadata.get(KEY, {}).get("dims")


def logical_schema(encoded: T.StructType) -> T.StructType:
    """The flat schema: elements for grid columns, all nullable; only the grid metadata stays."""
    return T.StructType([T.StructField(f.name, f.dataType["values"].dataType.elementType, True, {KEY: f.metadata[KEY]} if KEY in f.metadata else None) if is_encoded(f) else T.StructField(f.name, f.dataType, True) for f in encoded])


def coordinates(encoded: T.StructType) -> dict[str, str]:
    """Axis by coordinate column: the column named like the axis that lies on it alone."""
    return {f.name: f.name for f in encoded if is_encoded(f) and dims_of(f) == [f.name]}


def encode(values: Column | str, sizes: Sequence[int | Column], names: Sequence[str], alias: str) -> Column:
    """A grid column from an array column."""
    size = F.array(*[(F.lit(s) if isinstance(s, int) else s).cast("int") for s in sizes]) if sizes else F.array().cast("array<int>")
    name = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    column = F.struct((F.col(values) if isinstance(values, str) else values).alias("values"), size.alias("dim_sizes"), name.alias("dim_names"))
    return column.alias(alias, metadata={KEY: {"version": VERSION, "dims": list(names)}})


def chunks(spark: SparkSession, columns: Mapping[str, tuple[str, Sequence[str]]], rows: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Encoded chunks from Python lists: ``columns`` gives type and axes, a row's value is ``(values, sizes)`` or None."""
    schema = T.StructType([encoded_field(n, T._parse_datatype_string(kind), dims) for n, (kind, dims) in columns.items()])
    data = [tuple(None if (v := row.get(n)) is None else (list(v[0]), list(v[1]), list(v[2]) if len(v) > 2 else list(columns[n][1])) for n in columns) for row in rows]
    return spark.createDataFrame(data, schema)


def _part(name: str):
    return lambda x: x[name]


def _cell(name: str):
    return lambda k: F.try_element_at(F.col("__cells"), k)[name]


def dense(df: DataFrame, chunk: Sequence[Column], axes: Mapping[str, DataFrame], values: Mapping[str, Column], extra: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """Encoded chunks from rows that hold one cell each.

    ``chunk``: what tells chunks apart (named columns).  ``axes``: per axis a frame with one column
    of that name, its coordinates, the same in every chunk (they are broadcast, so keep them
    small).  ``values``: aggregates that give a cell's values; cells without rows are null.
    ``extra``: more columns on one axis, as ``name: (axis, column of that axis' frame)``.
    """
    names = list(axes)
    keyed = df.groupBy(*chunk, *names).agg(*[v.alias(n) for n, v in values.items()])
    keys = [c for c in keyed.columns if c not in names and c not in values]
    grid = keyed.select(*keys).distinct()
    sized = {}
    for a, frame in axes.items():
        packed = frame.agg(F.array_sort(F.collect_list(F.struct(a, *[c for c in frame.columns if c != a]))).alias(f"__all_{a}"))
        grid = grid.crossJoin(F.broadcast(packed))  # one row
        sized[a] = F.size(f"__all_{a}")
    cells = keyed.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.struct(*names).alias("k"), F.struct(*values).alias("v")))).alias("__cells"))
    grid = grid.join(cells, keys)
    place = F.transform(f"__all_{names[0]}", lambda x: F.struct(x[names[0]].alias(names[0])))
    for a in names[1:]:
        place = (lambda p, a: F.flatten(F.transform(p, lambda k: F.transform(f"__all_{a}", lambda x: F.struct(*[k[b].alias(b) for b in names[: names.index(a)]], x[a].alias(a))))))(place, a)
    grid = grid.withColumn("__keys", place)
    out = [F.col(k) for k in keys]
    out += [encode(F.transform(f"__all_{a}", _part(a)), [sized[a]], [a], a) for a in names]
    out += [encode(F.transform(f"__all_{a}", _part(c)), [sized[a]], [a], n) for n, (a, c) in (extra or {}).items()]
    out += [encode(F.transform("__keys", _cell(n)), list(sized.values()), names, n) for n in values]
    return grid.select(*out)
