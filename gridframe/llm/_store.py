"""Scratch tables in the folder that the whole cluster shares.

Intermediate results that are read more than once are written as Parquet, so that a
lost executor costs a re-read and not a re-computation, and so that later plans
prune columns.  The place is ``spark.checkpoint.dir``; only a session without one (as
in tests) gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, set to a new folder if the session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="gridframe-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a scratch table; it goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/gridframe/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop.getParent())
    fs.deleteOnExit(hadoop)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Sets the session's configurations while the block runs; ``__`` stands for a dot."""
    before = {k: spark.conf.get(k, None) for k in (x.replace("__", ".") for x in values)}
    for k, v in zip(before, values.values(), strict=True):
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to a scratch table and reads it back.

    What was shuffled for it goes as soon as it is written; until then a lost executor's part can be made again.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables from ``saved`` that nothing reads any more, so that large ones do not add up."""
    for x in tables:
        drop(x.sparkSession, x.scratch_path)


def ready_python(spark: SparkSession) -> None:
    """Prepares a session for functions that run on whole texts in Python workers.

    Arrow batches are kept small, unless the session has limits of its own, and this
    package is sent to the executors, which need not have it installed.
    """
    for key, default, value in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", None, str(32 << 20))):
        key = f"spark.sql.execution.arrow.{key}"
        if default is None or spark.conf.get(key, default) == default:
            spark.conf.set(key, value)
    package = Path(__file__).parents[1]
    name = f"{package.name}-package.zip"
    if not any(x.endswith(name) for x in spark.sparkContext.listFiles):
        file = Path(tempfile.mkdtemp()) / name
        with zipfile.ZipFile(file, "w") as z:
            for x in [package / "__init__.py", *(package / "llm").glob("*.py")]:
                z.write(x, x.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(file))


@contextmanager
def shuffled_joins(spark: SparkSession) -> Iterator[None]:
    """While jobs run in this block, only sides with a proven bound are broadcast.

    Spark would broadcast what happens to be small; then a plan, and what it costs the driver,
    changes with the size of the input.
    """
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1"):
        yield


#: In ``lookup``, at most this many keys are broadcast, and tables of fewer rows are joined as they are.
MOST_HOT = 10_000
#: A key is hot from this part of a task's fair share of the rows.
HOT_PART = 4


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, how: str = "inner", drop: bool = True) -> DataFrame:
    """Joins ``rows`` with a saved ``table`` that has one row per key, whatever the skew.

    ``weight`` is a column of ``table`` with the number of ``rows`` that have the key; the result
    has it unless it is dropped.  Keys with more than 1 / HOT_PART of what a task gets on average are
    broadcast: there cannot be more than HOT_PART times the tasks of them, nor more than MOST_HOT.  For the
    others no task gets a large group.  Without a hot key it is a plain join, and nothing is read twice.
    """
    total, largest = table.agg(F.coalesce(F.sum(weight), F.lit(0)), F.max(weight)).first()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edge = max(1, total // min(MOST_HOT, HOT_PART * tasks))
    if total <= MOST_HOT or largest <= edge:
        # Without a key above the edge; or so few rows that their keys may be anything.
        return rows.join(table.drop(weight) if drop else table, key, how)
    hot, cool = table.where(F.col(weight) > edge), table.where(F.col(weight) <= edge)
    if drop:
        hot, cool = hot.drop(weight), cool.drop(weight)
    marks = hot.select(key)
    few = rows.join(F.broadcast(hot), key, "inner" if how == "left" else how)
    rest = rows.join(F.broadcast(marks), key, "left_anti")
    return few.unionByName(rest.join(cool, key, how))
