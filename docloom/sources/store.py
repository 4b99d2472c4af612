"""Tables on a store that the cluster shares: versioned writes with a pointer, guards, scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class IndexNotFoundError(FileNotFoundError):
    pass


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset, a temporary folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """The frame as a written table: lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/docloom/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_version(tables: dict[str, DataFrame], root: str, force: bool = False, meta: dict | None = None) -> str:
    """Write the tables to a new version folder, then add the pointer row that makes it the current one. Readers
    see the whole old or the whole new version. Without ``force`` an existing index is an error."""
    spark = next(iter(tables.values())).sparkSession
    if exists(spark, f"{root}/pointer") and not force:
        raise FileExistsError(f"{root} holds an index; use force to replace it")
    version = uuid.uuid4().hex[:12]
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{version}/{name}")
    row = spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("built_at"), *[F.lit(v).alias(k) for k, v in (meta or {}).items()])
    row.coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    return version


def current_version(spark: SparkSession, root: str) -> str:
    if not exists(spark, f"{root}/pointer"):
        raise IndexNotFoundError(root)
    return spark.read.parquet(f"{root}/pointer").orderBy(F.desc("built_at"), "version").head()["version"]


def read_version(spark: SparkSession, root: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    version = current_version(spark, root)
    missing = [n for n in names if not exists(spark, f"{root}/{version}/{n}")]
    if missing:
        raise TypeError(f"the index at {root} lacks {', '.join(missing)}")
    return {n: spark.read.parquet(f"{root}/{version}/{n}") for n in names}


def seed(df: DataFrame, path: str, force: bool = False) -> None:
    """Copy if absent, or replace."""
    df.write.mode("overwrite" if force else "ignore").parquet(path)
