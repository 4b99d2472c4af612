"""Lexical and vector layers, rank fusion, boosts, and order-aware deduplication, for batches of queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import SECTIONS, SearchConfig
from ..functions import dates, text
from ..functions.vectors import dot


def query_terms(queries: DataFrame, config: SearchConfig = SearchConfig(), lemma: Column | None = None) -> DataFrame:
    """query_id, term, qtf: repeats of a word in a query count."""
    words = queries.select("query_id", F.explode(text.tokens(F.col("query"), config, lemma)).alias("term"))
    return words.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def lexical(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, doc_idx, score: weighted BM25 of all documents with a positive total. Sections are added in a fixed
    order. Filters come later: they do not touch the statistics."""
    met = postings.join(terms, "term").groupBy("query_id", "doc_idx").agg(*[F.sum(F.when(F.col("section") == s, F.col("qtf") * F.col("part"))).alias(s) for s in SECTIONS])
    total = sum((F.coalesce(F.col(s), F.lit(0.0)) for s in SECTIONS[1:]), F.coalesce(F.col(SECTIONS[0]), F.lit(0.0)))
    return met.select("query_id", "doc_idx", total.alias("score")).where("score > 0")


def semantic(queries: DataFrame, vectors: DataFrame, positive: bool = True) -> DataFrame:
    """query_id, doc_idx, score: cosine of unit vectors. The query batch is a stated set, met by all vectors; it is
    broadcast block by block of the vectors' partitions."""
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", "vector")
    met = vectors.select(F.col("doc_id").alias("doc_idx"), "embedding").crossJoin(F.broadcast(asked))
    out = met.select("query_id", "doc_idx", dot(F.col("embedding"), F.col("vector")).alias("score"))
    return out.where("score > 0") if positive else out


def top(scores: DataFrame, n: int) -> DataFrame:
    """The n best of each query, ties by doc_idx, with their ranks. Scores that differ by less than 1e-9 are ties: a
    distributed sum has no fixed order."""
    order = W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_idx")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def fuse(layers: list[DataFrame], weights: list[float] | None = None, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion. layers: query_id, doc_idx, rank. Returns query_id, doc_idx, score (times 1000) and
    ord: the order of first appearance. A layer of weight 0 or less is left out."""
    if weights is not None and len(weights) != len(layers):
        raise ValueError("as many weights as layers are asked for")
    used = [(i, d, w) for i, (d, w) in enumerate(zip(layers, weights or [1.0] * len(layers), strict=True)) if w > 0]
    if not used:
        return layers[0].select("query_id", "doc_idx", F.lit(0.0).alias("score"), F.lit(0).cast("double").alias("ord")).limit(0)
    rows = None
    for i, d, w in used:
        part = d.select("query_id", "doc_idx", (F.lit(float(w)) / (k + F.col("rank"))).alias("s"), (F.lit(i * 1e9) + F.col("rank")).alias("o"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("query_id", "doc_idx").agg((F.sum("s") * 1000).alias("score"), F.min("o").alias("ord"))


def proximity(words: Column, asked: Column, config: SearchConfig = SearchConfig()) -> Column:
    """Best share, over four sections, of the query's neighbouring word pairs that stand within a few words of each
    other; title and position count half as much again; at most 1."""
    pairs = F.filter(F.transform(asked, lambda a, i: F.struct(a.alias("a"), F.get(asked, i + 1).alias("b"))), lambda p: p["b"].isNotNull())

    def share(section: Column) -> Column:
        held = F.filter(F.transform(section, lambda x, i: F.struct(i.alias("i"), x.alias("w"))), lambda x: F.array_contains(asked, x["w"]))
        # of words at different places within the window, no more than the window stand between in this list
        around = lambda h: F.transform(h, lambda x, k: F.struct(x["w"].alias("w"), F.transform(F.filter(F.slice(h, F.greatest(F.lit(1), k + 1 - config.window), F.lit(2 * config.window + 1)), lambda y: F.abs(x["i"] - y["i"]).between(1, config.window)), lambda y: y["w"]).alias("near")))
        met = text.let(held, lambda h: text.let(around(h), lambda a: F.filter(pairs, lambda p: F.exists(a, lambda x: (x["w"] == p["a"]) & F.array_contains(x["near"], p["b"])))))
        return F.size(met) / F.size(pairs)

    best = F.greatest(share(words["title"]) * config.section_factor, share(words["vs_position"]) * config.section_factor, share(words["fabula"]), share(words["full"]))
    return F.when(F.size(asked) < 2, 0.0).otherwise(F.least(best, F.lit(1.0)))


def boosted(scored: DataFrame, docs: DataFrame, asked: DataFrame, config: SearchConfig = SearchConfig(), few: bool = False) -> DataFrame:
    """Scores times freshness, structure and proximity. asked: query_id, words. Queries without words stay. few: the
    scored rows are the best of each query only."""
    wide = docs.select("doc_idx", "year", "sections.vs_position", "lemmas")
    met = (F.broadcast(scored) if few else scored).join(asked, "query_id").join(wide, "doc_idx")
    factor = dates.freshness(F.col("year"), config) * F.when(F.length("vs_position") > 0, config.structured).otherwise(1.0) * (1 + config.proximity * proximity(F.col("lemmas"), F.col("words"), config))
    return met.withColumn("factor", F.when(F.size("words") > 0, factor).otherwise(1.0)).withColumn("score", F.col("score") * F.col("factor")).drop("year", "vs_position", "lemmas", "words")


def deduplicate(ranked: DataFrame) -> DataFrame:
    """Greedy leaders in score order. ranked: query_id, pos, doc_idx, score, ids, channel, limit, deduplicate.

    Returns query_id, rank, doc_idx, score, alternative_channels. A hit that has an id of an earlier leader is that
    leader's duplicate (the first of its ids decides), gives it its channel and all its ids; two leaders are never
    merged. A query stops at its limit of leaders. Rows stream in order: what is held is a query's leaders."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query, leaders, seen = None, [], {}

        def flush():
            if leaders:
                yield pd.DataFrame([(query, i + 1, d, s, list(c)) for i, (d, s, c) in enumerate(leaders)], columns=["query_id", "rank", "doc_idx", "score", "alternative_channels"])

        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if r.query_id != query:
                    yield from flush()
                    query, leaders, seen = r.query_id, [], {}
                if len(leaders) >= r.limit:
                    continue
                ids = list(r.ids) if r.deduplicate else []
                leader = next((seen[x] for x in ids if x in seen), None)
                if leader is None:
                    for x in ids:
                        seen[x] = len(leaders)
                    leaders.append((r.doc_idx, r.score, {}))
                else:
                    if r.channel:
                        leaders[leader][2].setdefault(r.channel)
                    for x in ids:
                        seen.setdefault(x, leader)
        yield from flush()

    rows = ranked.select("query_id", "pos", "doc_idx", "score", "ids", "channel", "limit", "deduplicate")
    n = int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "query_id").sortWithinPartitions("query_id", "pos").mapInPandas(fold, "query_id long, rank int, doc_idx long, score double, alternative_channels array<string>")
