"""SQL over grid tables.

How many rows a grid table has depends on the columns a query uses, so a plain view will not
do.  A query is first analysed over empty tables of the same flat schemas; the columns its
scans still read after optimisation are those it uses.  Then each table's boundary over just
these columns becomes the view that the query runs on.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.frame import NdFrame, NdPlanError
from ..sources.encoding import logical_schema


class NdSession:
    """Registers frames by name and runs Spark SQL over them (not under Spark Connect)."""

    def __init__(self, spark: SparkSession):
        self.spark, self.frames = spark, {}
        self._probe = "file://" + tempfile.mkdtemp(prefix="gridframe-probe-")

    def register(self, name: str, frame: NdFrame) -> None:
        self.frames[name.lower()] = frame

    def used_columns(self, query: str) -> Mapping[str, list[str]]:
        """The columns of each registered table that a query uses; empty for a bare ``count(*)``."""
        marks = {}
        for k, (name, frame) in enumerate(self.frames.items()):
            fields = logical_schema(frame.df.select(*frame.shown).schema).fields
            marks[f"__t{k}"] = name
            schema = T.StructType([T.StructField(f.name, f.dataType, True, {"table": f"__t{k}"}) for f in fields])
            self.spark.read.schema(schema).parquet(self._probe).createOrReplaceTempView(name)
        leaves = self.spark.sql(query)._jdf.queryExecution().sparkPlan().collectLeaves()
        used: dict[str, list[str]] = {}
        for i in range(leaves.size()):
            leaf = leaves.apply(i)
            if not leaf.nodeName().startswith("Scan"):
                continue
            schema = T.StructType.fromJson(json.loads(leaf.requiredSchema().json()))
            whole = T.StructType.fromJson(json.loads(leaf.relation().schema().json()))
            name = marks.get(whole.fields[0].metadata.get("table"))
            if name is None:
                continue
            own = schema.fieldNames()
            if name in used and set(used[name]) != set(own):
                raise NdPlanError(f"{name} is used twice with different columns; register two selections of it")
            used[name] = own
        return used

    def sql(self, query: str) -> DataFrame:
        """A query over the registered tables."""
        for name, columns in self.used_columns(query).items():
            frame = self.frames[name]
            view = frame.select(*columns) if columns else frame
            view.to_df().createOrReplaceTempView(name)
        return self.spark.sql(query)
