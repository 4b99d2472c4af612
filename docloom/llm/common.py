"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A side is broadcast only when it was counted and holds at most this many bytes.
BROADCAST_BYTES = 32 << 20


#: Limits of an Arrow batch: the JVM and the worker each hold a few, outside the heap. Rows alone are no limit, as texts
#: and packed rows are long.
BATCH_ROWS, BATCH_BYTES = 1024, 2 << 20
#: Rows of a batch of the Parquet reader, and bytes of a row group that a task builds before it writes it: by default 4096
#: rows, which for texts are arrays of tens of MB, and 128 MB.
READ_ROWS, GROUP_BYTES = 512, 16 << 20


def tuned(spark: SparkSession) -> None:
    """Set the session's limits of an Arrow batch and of the reader's, unless they are lower; every operator calls this."""
    limits = {"execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "execution.arrow.maxBytesPerBatch": BATCH_BYTES, "parquet.columnarReaderBatchSize": READ_ROWS}
    for name, most in limits.items():
        name = f"spark.sql.{name}"
        held = spark.conf.get(name, None)
        if not str(held).isdigit() or int(held) <= 0 or int(held) > most:
            spark.conf.set(name, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tuned(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Only where it is unset, as in
    tests, a temporary one is made and set for this session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex[:12]}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its store's scheme, for readers that do not know the cluster's default one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return str(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString())


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder: lost executors cost no recomputation."""
    tuned(df.sparkSession)
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def width(df: DataFrame) -> int:
    """Shuffle width: the session's own setting, or the number of input partitions if larger."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast hint for a side whose counted rows fit; any larger side is shuffled instead."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def fresh(df: DataFrame, name: str) -> str:
    """The name, or, where the table has such a column, the name with signs added until it has none."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def plus(schema: StructType, ddl: str) -> StructType:
    """A schema with further fields, given as DDL."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def lean(run):
    """For a function over Arrow batches: buffers come from the system's allocator, and what a task has
    freed goes back to the system when it ends, as workers are kept for other tasks."""

    @functools.wraps(run)
    def task(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            gc.collect()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library: it keeps its own habits

    return task
