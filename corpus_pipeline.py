"""A corpus pipeline of five operators. Every stage takes the documents that its predecessor kept and gives
documents in the same columns; the last gives token ids. Each stage's result is a written table.

Defined results, for all stages: null and empty texts, null ids, repeated rows, empty tables and further columns
of any name pass through; what a stage removes is said below. No SQL states the model-based stages, so
``ORACLE_SQL`` is None and the stages are tested against brute-force versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, decontamination, language_id, ngram_join, pii
from docloom.llm.common import fresh, maybe_broadcast, table, written

#: A document stays if the languages found in it together explain at least this share of its text, the background
#: the rest; within this many standard errors of the share, as a short text has few trigrams to tell it from.
LEAST_SHARE = 0.3
ERRORS = 2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in no known language: null texts, texts without a letter, and texts of which the background
    explains more than 1 - LEAST_SHARE, however many languages share the rest. A missing language label is filled in. Without labels nothing can be learned, and all stay."""
    model = language_id.fit(docs.where(language_id.fold(F.col("doc_id"), 4) != 2))
    if not model.languages:
        return docs
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), "text")
    found = language_id.identify(rows, model, keep=("_doc",)).where(F.col("lang_pred") != language_id.UND)
    known = F.least(F.lit(1.0), F.aggregate("languages", F.lit(0.0), lambda s, x: s + x["share"]))
    n = F.greatest(F.lit(1), F.length(F.trim(F.regexp_replace("_doc.text", r"\P{L}+", " "))))
    found = found.where((known >= LEAST_SHARE) | (known + ERRORS * F.sqrt(known * (1 - known) / n) >= LEAST_SHARE))
    lang = fresh(docs, "_lang")
    return found.select("_doc.*", F.col("lang_pred").alias(lang)).withColumn("lang", F.coalesce("lang", lang)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document of the smallest id (null ids last). Documents without
    words are in no group and stay."""
    tag = fresh(docs, "_tag")
    rows = written(docs.withColumn(tag, F.monotonically_increasing_id()), "pipeline-tagged")
    keyed = rows.select(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col(tag).alias("tag")).alias("_key"), "text")
    found = ngram_join.jaccard_join(keyed, key="_key")
    gone = written(found.where(F.col("_key.tag") != F.col("component_id.tag")).select(F.col("_key.tag").alias(tag)), "pipeline-copies")
    return rows.join(maybe_broadcast(gone, gone.count(), 16), tag, "left_anti").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words at least one in twenty stands in a benchmark window."""
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), "text")
    found = decontamination.decontaminate(rows, table(spark, sf_dir, "benchmark"), key="_doc")
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.where(~((hit > 0) & (20 * hit >= F.col("n_words")))).select("_doc.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; n_chars follows the text."""
    masked = pii.mask(docs, pii.find(docs))
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text that they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    found = bpe.encode(docs, path, keep=("doc_id", "lang", "source"), decoded=True)
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", benchmark),
    ("pii", personal_data),
    ("bpe", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
