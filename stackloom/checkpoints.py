"""Written intermediate tables, and running totals over partitions that such a table has fixed."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode alone."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="stackloom-"))
    return context.getCheckpointDir()


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Executions that begin inside delete their shuffle files as they end."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


#: Tables written since the innermost ``temporary`` began.
_written: ContextVar[list[DataFrame] | None] = ContextVar("written", default=None)


@contextmanager
def temporary() -> Iterator[None]:
    """Tables that ``cut`` writes inside are deleted at its end, whoever wrote them: results must be read or written by then."""
    tables: list[DataFrame] = []
    token = _written.set(tables)
    try:
        yield
    finally:
        _written.reset(token)
        drop(*tables)


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, and its shuffle files are gone.

    The shared folder is that of ``spark.checkpoint.dir``; a local master without that setting takes a temporary one.
    The table is deleted by ``drop`` or, unless ``keep``, at the end of ``temporary``, else by nothing, as lazy results may read it for as long as they live.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    if not keep and (tables := _written.get()) is not None:
        tables.append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote and nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def running_total(df: DataFrame, size: Column, order: list[str], name: str) -> DataFrame:
    """``df`` with the total of ``size`` over all rows before each row: by partition, inside one by ``order``.

    Rows and partition numbers are written together, so totals and rows see the same partitions; ``drop`` of the result deletes that table.
    """
    fixed = cut(df.withColumns({"_part": F.spark_partition_id(), "_size": size.cast("long")}))
    until = (Window.unboundedPreceding, -1)
    parts = fixed.groupBy("_part").agg(F.sum("_size").alias("_all"))
    # One row a partition.
    parts = parts.select("_part", F.coalesce(F.sum("_all").over(Window.orderBy("_part").rowsBetween(*until)), F.lit(0)).alias("_earlier"))
    own = F.coalesce(F.sum("_size").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(*until)), F.lit(0))
    out = fixed.withColumn("_own", own).join(F.broadcast(parts), "_part").withColumn(name, F.col("_earlier") + F.col("_own")).drop("_part", "_size", "_own", "_earlier")
    out._written = fixed._written
    return out
