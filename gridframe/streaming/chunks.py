"""Encoded chunks as a stream.

Filters, projections, coarsening and the boundary work on one chunk at a time, so they run on a
streaming frame as they are.  Placing chunks on one output grid needs all of them, so
that is done per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.frame import NdFrame
from ..operators.regrid import Regridded, regrid


def read_chunks(spark: SparkSession, path: str, schema: StructType, dims: Mapping[str, Sequence[str]] | None = None, **options: str) -> NdFrame:
    """A frame over Parquet files of chunks as they arrive."""
    return NdFrame.of(spark.readStream.schema(schema).options(**options).parquet(path), dims)


def regrid_batches(frame: NdFrame, write: Callable[[Regridded, int], None], checkpoint: str) -> StreamingQuery:
    """Regrids every micro-batch of chunks and hands it to ``write`` with the batch's number."""
    flat = frame.to_encoded()

    def one(batch: DataFrame, number: int) -> None:
        write(regrid(NdFrame.of(batch, frame.dims, frame.grid_axes)), number)

    return flat.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
