"""Incremental ingest: a stream of raw records, each micro-batch appended with a rebuild of the statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..config import SearchConfig
from ..operators import index
from ..sources import store


def json_stream(spark: SparkSession, path: str) -> DataFrame:
    """Raw records of JSON files that arrive in a folder."""
    return spark.readStream.schema(schema.RAW).option("multiLine", True).json(path)


def upsert(batch: DataFrame, root: str, config: SearchConfig = SearchConfig()) -> None:
    """Append a batch's documents whose ids are new (a repeated batch adds nothing); within it the last row of an id
    counts. The first batch makes the index."""
    new = index.enrich(batch, config)
    new = new.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("text")))).where("r = 1").drop("r")
    if not store.exists(batch.sparkSession, f"{root}/pointer"):
        index.build(new, root, config=config)
        return
    old = store.read_version(batch.sparkSession, root, ("docs",))["docs"]
    fresh = store.scratch_table(new.join(old.select("id"), "id", "left_anti").select(*old.columns), "fresh")
    if fresh.head(1):
        index.append(fresh, root, config)


def ingest(stream: DataFrame, root: str, checkpoint: str, config: SearchConfig = SearchConfig()) -> StreamingQuery:
    return stream.writeStream.foreachBatch(lambda df, _: upsert(df, root, config)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
