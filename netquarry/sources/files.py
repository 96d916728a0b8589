"""Files in any store that pyarrow knows: local and mounted folders, S3, GCS, HDFS."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def located(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri.replace("file:/", "file:///", 1)
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri))


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir; only on one machine, where none is set, in its temporary folder."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir")
    if shared is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or tempfile.gettempdir()}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the folder that all executors share, so that later jobs survive lost executors; Spark drops it once it isn't used."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or scratch(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def running_totals(rows: DataFrame, order: str, value: str) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over all rows that come earlier in the order of a text column without repeats. Sorted by ranges; the tasks' totals are broadcast."""
    field = rows.schema[order].name
    wanted = T.StructType([*rows.schema.fields, T.StructField("before", T.LongType()), T.StructField("pid", T.IntegerType())])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, pid = 0, TaskContext.get().partitionId()
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = total + np.cumsum(values)
            total = int(ends[-1]) if len(ends) else total
            yield pa.record_batch([*batch.columns, pa.array(ends - values), pa.array(np.full(len(values), pid), pa.int32())], names=[f.name for f in wanted])

    local = cut(rows.repartitionByRange(field).sortWithinPartitions(field).mapInArrow(summed, wanted))
    tasks = local.groupBy("pid").agg(F.sum(value).alias("of_task"))
    tasks = tasks.select("pid", F.coalesce(F.sum("of_task").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return local.join(F.broadcast(tasks), "pid").withColumn("before", F.col("before") + F.col("offset")).drop("pid", "offset")
