"""Corpus scans and sinks: JSON arrays, markdown digests, embedding vectors and their cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import schema
from ..functions import text as X

#: Courts of a digest's second-level headings.
COURTS = ("СКГД ВС РФ", "СКЭС ВС РФ", "ВС РФ")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records. A file that is no array of objects with ids is an error."""
    df = spark.read.schema(schema.RAW).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return df.withColumn("id", F.coalesce("id", F.raise_error(F.lit("a record has no id")).cast("long")))


def write_json(df: DataFrame, path: str, force: bool = False) -> None:
    df.write.mode("overwrite" if force else "errorifexists").json(path)


def coerce(raw: DataFrame) -> DataFrame:
    """Defaults of the model: empty strings and arrays, whole years, case_ids filled from case_id."""
    kinds = dict(raw.dtypes)
    out = raw
    for name, kind in kinds.items():
        if kind == "string":
            out = out.withColumn(name, F.coalesce(name, F.lit("")))
        elif kind == "array<string>":
            out = out.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    if "year" in kinds:
        out = out.withColumn("year", F.col("year").try_cast("int"))
    if {"case_id", "case_ids"} <= kinds.keys():
        out = out.withColumn("case_ids", F.when((F.size("case_ids") == 0) & (F.col("case_id") != ""), F.array("case_id")).otherwise(F.col("case_ids")))
    return out


def read_digest(spark: SparkSession, path: str, start_id: int = 1) -> DataFrame:
    """Markdown digests as raw records. Lines are numbered per file; the current court and case are the last
    heading seen (forward fill), a case ends at a heading of either level or at a line of three dashes, and the body
    is what follows the body field. All windows are per file."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    body = F.regexp_replace("value", "\n$", "")
    lines = files.select("file", F.posexplode(F.split(body, "\n", -1)).alias("n", "line"))
    sofar = W.partitionBy("file").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    court_name = F.regexp_extract("line", r"(?U)^##\s+([^\n(]+?)\s*\(\s*\d+\s*\)\s*$", 1)
    lines = lines.withColumn("court_line", court_name != "")
    known = F.when(F.trim(court_name).isin(*COURTS), F.trim(court_name)).otherwise(F.lit(""))
    lines = lines.withColumn("court", F.last(F.when(F.col("court_line"), known), ignorenulls=True).over(sofar))
    head = r"(?U)^###\s+\d+\.\s+(\d{1,2}\.\d{1,2}\.\d{4})\s+[—-]\s+(.+?)\s*$"
    lines = lines.withColumn("case_line", ~F.col("court_line") & (F.coalesce("court", F.lit("")) != "") & F.col("line").rlike(head))
    closes = F.col("court_line") | (X.strip(F.col("line")) == "---")
    lines = lines.withColumn("block", F.sum((F.col("case_line") | closes).cast("int")).over(sofar))
    own = W.partitionBy("file", "block").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("opened", F.max(F.col("case_line")).over(own)).where("opened")
    field = r"(?U)^\*\*(Реквизиты|Теги|Нормы|Источник|Текст обзора):\*\*\s*(.*)$"
    lines = lines.withColumn("field", F.when(~F.col("case_line"), F.regexp_extract("line", field, 1)).otherwise(F.lit("")))
    lines = lines.withColumn("value", X.strip(F.regexp_extract("line", field, 2)))
    lines = lines.withColumn("starts", F.sum((F.col("field") == "Текст обзора").cast("int")).over(own))
    cases = W.partitionBy("file", "block")
    lines = lines.withColumn("last_start", F.max("starts").over(cases))
    inside = (F.col("field") == "") & ~F.col("case_line") & (F.col("starts") > 0) & (F.col("starts") == F.col("last_start"))
    last_of = lambda name: F.coalesce(F.max_by("value", F.when(F.col("field") == name, F.col("n"))), F.lit("")).alias(name)
    case = lines.groupBy("file", "block").agg(
        F.min("n").alias("n"),
        F.max(F.when(F.col("case_line"), F.col("court"))).alias("court"),
        F.max(F.when(F.col("case_line"), F.regexp_extract("line", head, 1))).alias("date"),
        F.max(F.when(F.col("case_line"), X.strip(F.regexp_extract("line", head, 2)))).alias("title"),
        *[last_of(x) for x in ("Реквизиты", "Теги", "Нормы", "Источник")],
        F.array_sort(F.collect_list(F.when(inside, F.struct("n", "line")))).alias("body"),
    )
    text = X.collapse_lines(X.strip(F.array_join(F.transform("body", lambda x: x["line"]), "\n")))
    # ids run through the files in order: only one row a file meets in one place
    files_ = case.groupBy("file").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(W.partitionBy("file").orderBy("n"))
    numbered = case.withColumn("place", place).join(files_.select("file", "before"), "file").withColumn("id", (F.col("place") + F.col("before") + (start_id - 1)).cast("long"))
    return numbered.select("id", "court", "date", "title", F.col("Реквизиты").alias("case_number"), text.alias("text"), X.clean_hashtags(X.split_csv(F.col("Теги"))).alias("hashtags"), X.split_csv(F.col("Нормы")).alias("articles"), X.channel(F.col("Источник")).alias("source_channel"))


class Embedder(Protocol):
    """Vectors of texts, one row each; must be picklable."""

    def embed(self, texts: list[str], kind: str) -> np.ndarray: ...


def embed(texts: DataFrame, embedder: Embedder, key: str = "id", text: str = "text", batch: int = 32, attempts: int = 4, wait: Callable[[float], None] | None = None) -> DataFrame:
    """doc_id, embedding (unit length) from a pluggable service, ``batch`` texts a call, with waits of 2, 4, 8 s
    after failures that may pass (ConnectionError, TimeoutError). Parallelism is the frame's partitions."""
    import time

    pause = wait or time.sleep

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                for k in range(attempts):
                    try:
                        v = np.asarray(embedder.embed(part["t"].tolist(), "document"), np.float32)
                        break
                    except (ConnectionError, TimeoutError):
                        if k == attempts - 1:
                            raise
                        pause(2.0 ** (k + 1))
                n = np.linalg.norm(v, axis=1, keepdims=True)
                n[n == 0] = 1
                yield pd.DataFrame({"doc_id": part["k"].to_numpy(), "embedding": list(v / n)})

    return texts.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, "doc_id long, embedding array<float>")


def cardinality_gap(docs: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """One row: documents without a vector and vectors without a document."""
    d, v = docs.select(F.col(key).alias("doc_id")), vectors.select("doc_id")
    both = d.withColumn("d", F.lit(1)).join(v.withColumn("v", F.lit(1)), "doc_id", "full_outer")
    return both.agg(F.count_if(F.col("v").isNull()).alias("no_vector"), F.count_if(F.col("d").isNull()).alias("no_document"))


def cached_vectors(queries: DataFrame, cache: DataFrame, now, dim: int) -> DataFrame:
    """queries with the cache's vector (half precision, read back) where it is fresh and has dim components."""
    from ..functions.vectors import from_half

    fresh = cache.where((F.col("expires_at") > F.lit(now)) & (F.octet_length("vec") == 2 * dim)).select("key", from_half("vec").alias("vector"))
    keyed = queries.withColumn("key", X.query_key(F.col("query")))
    return keyed.join(fresh, "key", "left").withColumn("hit", F.col("vector").isNotNull())
