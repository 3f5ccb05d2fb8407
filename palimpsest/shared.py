"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of the tables that a plan reads for each task that writes its result; such tasks for each core at least.
TASK_BYTES, TASKS = 2 << 20, 4

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one of this process, which only a local master can read."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="palimpsest-"))
        found = _own[0]
    return found


def few_files(df: DataFrame) -> DataFrame:
    """``df``, dealt anew where shuffles have more partitions than what its plan reads is worth; large tables stay as they are.

    A local folder's file system starts processes for each file, and each has, until it runs, the executor's whole memory as its own. (``coalesce`` would need no
    shuffle, but the tasks that it joins keep the memory of all their parts.)
    """
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    most = max(TASKS * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    return df.repartition(most) if most < int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def materialize(df: DataFrame, tag: str, deal: bool = True) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, survives lost executors. ``deal``: by :func:`few_files`, which a plan without shuffles does not need."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    (few_files(df) if deal else df).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._palimpsest_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes tables made by :func:`materialize` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_palimpsest_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def short_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, with Arrow batches of whole texts kept short in its session, so that Python workers hold little at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, rows)
    return df


def give_back() -> None:
    """Gives memory that is free in this worker back to the system, as other tasks' leavings count beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps what is free below a block in use
        trim(0)
