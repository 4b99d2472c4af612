"""Corpus statistics, tags and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stats(docs: DataFrame, courts: tuple[str, str] = ("СКГД", "СКЭС")) -> DataFrame:
    """One row. A document of both courts counts in both, and the rest is what is left of the total."""
    a, b = (F.count_if(F.contains("court", F.lit(c))) for c in courts)
    tags = docs.select(F.explode("hashtags").alias("t")).agg(F.count_distinct("t").alias("unique_tags"))
    year = F.when(F.col("year") >= 2000, F.col("year"))
    one = docs.agg(
        F.count("*").alias("total"),
        a.alias("court_a"),
        b.alias("court_b"),
        F.min(year).alias("year_min"),
        F.max(year).alias("year_max"),
        F.count_if(F.length("sections.vs_position") > 0).alias("with_vs_position"),
        F.count_distinct(F.when(F.col("case_id") != "", F.col("case_id"))).alias("unique_cases"),
    )
    return one.withColumn("court_other", F.col("total") - F.col("court_a") - F.col("court_b")).crossJoin(tags)


def list_tags(docs: DataFrame, min_count: int = 1) -> DataFrame:
    """tag, count, in order of frequency, then of first appearance. Repeats within a document count."""
    if not 1 <= min_count <= 1000:
        raise ValueError("min_count is 1 to 1000")
    each = docs.select("doc_idx", F.posexplode("hashtags").alias("pos", "tag"))
    counted = each.groupBy("tag").agg(F.count("*").alias("count"), F.min(F.struct("doc_idx", "pos")).alias("first"))
    return counted.where(F.col("count") >= min_count).orderBy(F.desc("count"), "first").select("tag", "count")


def get_case(docs: DataFrame, case: int) -> DataFrame:
    """All fields but the words; no row where there is none. Of repeated ids the last counts."""
    if case < 0:
        raise ValueError("ids are not negative")
    return docs.where(F.col("id") == case).orderBy(F.desc("doc_idx")).limit(1).drop("lemmas")
