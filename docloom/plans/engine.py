"""The search engine: five read-only operations over an index, each a lazily composed plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import schema
from ..config import SearchConfig
from ..functions import dates, text
from ..functions.vectors import dot
from ..operators import catalog, filters, ranking
from ..sources import store

MODES = ("hybrid", "bm25", "semantic")


@dataclass(frozen=True)
class Query:
    query_id: int
    query: str = ""
    court: str | None = None
    tag: str | None = None
    article: str | None = None
    year_from: int | None = None
    year_to: int | None = None
    limit: int = 10
    deduplicate: bool = True
    vector: Sequence[float] | None = None

    def __post_init__(self) -> None:
        if not 1 <= self.limit <= 50:
            raise ValueError("limit is 1 to 50")
        for y in (self.year_from, self.year_to):
            if y is not None and y != 0 and not 2000 <= y <= 2100:
                raise ValueError("years are 2000 to 2100")

    @property
    def filtered(self) -> bool:
        return bool(self.tag or self.article or self.court or self.year_from or self.year_to)


class SearchEngine:
    """``docs`` and ``postings`` as the index has them (postings may be a function that gives them once a query needs
    them); chosen: a function that gives the documents of a table of ids, where docs are no table that is written;
    ``vectors``: doc_id, embedding (unit length), or None."""

    def __init__(self, spark: SparkSession, docs: DataFrame, postings: DataFrame | Callable[[], DataFrame], vectors: DataFrame | None = None, config: SearchConfig = SearchConfig(), courts: tuple[str, ...] = filters.COURTS, lemma: Column | None = None, chosen: Callable[[DataFrame], DataFrame] | None = None):
        self._chosen = chosen
        self.spark, self.docs, self._postings, self.vectors, self.config, self.courts, self.lemma = spark, docs, postings, vectors, config, courts, lemma

    @property
    def postings(self) -> DataFrame:
        return self._postings() if callable(self._postings) else self._postings

    @classmethod
    def load(cls, spark: SparkSession, root: str, vectors: DataFrame | None = None, config: SearchConfig = SearchConfig()) -> SearchEngine:
        t = store.read_version(spark, root, ("docs", "postings"))
        return cls(spark, t["docs"], t["postings"], vectors, config)

    def effective_mode(self, mode: str, batch: list[Query]) -> str:
        """Without vectors everything is bm25. Without query vectors hybrid is bm25, and semantic is an error."""
        if mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        if self.vectors is None or mode == "bm25":
            return "bm25"
        if any(q.query and q.vector is None for q in batch):
            if mode == "semantic":
                raise RuntimeError("a query has no vector")
            return "bm25"
        return mode

    def frame(self, batch: list[Query]) -> DataFrame:
        names = schema.QUERIES.fieldNames()
        rows = [tuple(list(map(float, v)) if n == "vector" and v is not None else v for n, v in ((n, asdict(q)[n]) for n in names)) for q in batch]
        return self.spark.createDataFrame(rows, schema.QUERIES)

    def chosen(self, scored: DataFrame, few: bool) -> DataFrame:
        """The documents that are scored, chosen before words are made or wide columns dealt out. few: at most so many as
        the layers give each query; they are broadcast."""
        ids = F.broadcast(scored.select("doc_idx")) if few else scored.select("doc_idx")
        return self._chosen(ids) if self._chosen else self.docs.join(ids, "doc_idx", "left_semi")

    def _known(self) -> DataFrame:
        """The vectors that have a document: others take no rank."""
        return self.vectors.join(self.docs.select(F.col("doc_idx").alias("doc_id")), "doc_id", "left_semi")

    def _eligible(self, scored: DataFrame, queries: DataFrame, batch: list[Query]) -> DataFrame:
        """Scored rows whose document passes its query's filters. Wide text is met only if a query asks for it."""
        if not any(q.filtered for q in batch):
            return scored
        met = scored.join(F.broadcast(queries.select("query_id", F.col("court").alias("q_court"), F.col("tag").alias("q_tag"), F.col("article").alias("q_article"), "year_from", "year_to")), "query_id").join(self._narrow(batch), "doc_idx")
        return met.where(self._passes()).select(*scored.columns)

    def _narrow(self, batch: list[Query]) -> DataFrame:
        """What filters look at; of the text, only which of the batch's articles it has, so that no text is dealt out."""
        asked = sorted({q.article for q in batch if q.article})
        held = F.array_compact(F.array(*[F.when(filters.article(F.lit(a), F.col("text")), F.lit(a)) for a in asked])) if asked else F.array().cast("array<string>")
        return self.docs.select("doc_idx", "court", "hashtags", "year", held.alias("articles_met"))

    def _passes(self) -> Column:
        ok = filters.court(F.col("q_court"), F.col("court"), self.courts) & filters.tag(F.col("q_tag"), F.col("hashtags")) & filters.years(F.col("year_from"), F.col("year_to"), F.col("year"))
        return ok & ((F.coalesce("q_article", F.lit("")) == "") | F.array_contains("articles_met", F.col("q_article")))

    def _listing(self, queries: DataFrame, asked: DataFrame, batch: list[Query]) -> DataFrame:
        """Filters without words: the eligible documents in corpus order, with score 0."""
        filtered = [q.query_id for q in batch if q.filtered]
        q = queries.join(asked, "query_id").where((F.size("words") == 0) & F.col("query_id").isin(filtered) & (F.length(F.coalesce("query", F.lit(""))) == 0))
        q = q.select("query_id", F.col("court").alias("q_court"), F.col("tag").alias("q_tag"), F.col("article").alias("q_article"), "year_from", "year_to")
        met = self._narrow(batch).join(F.broadcast(q), self._passes())
        return met.select("query_id", "doc_idx", F.lit(0.0).alias("score"), F.col("doc_idx").cast("double").alias("ord"), F.lit(1.0).alias("factor"))

    def ranked(self, batch: list[Query], mode: str = "hybrid") -> DataFrame:
        """query_id, pos, doc_idx, score, factor: every candidate in final order, before deduplication."""
        mode = self.effective_mode(mode, batch)
        queries, c = self.frame(batch), self.config
        asked = queries.select("query_id", text.tokens(F.col("query"), c, self.lemma).alias("words"))
        lex = sem = None
        if not any(q.query for q in batch):
            lex = sem = queries.select("query_id", F.lit(0).cast("long").alias("doc_idx"), F.lit(0.0).alias("score")).limit(0)
        elif mode != "semantic":
            lex = self._eligible(ranking.lexical(ranking.query_terms(queries, c, self.lemma), self.postings), queries, batch)
        if mode != "bm25" and sem is None:
            sem = self._eligible(ranking.semantic(queries, self._known()), queries, batch)
        if mode == "hybrid":
            scored = ranking.fuse([ranking.top(lex, c.top), ranking.top(sem, c.top)], list(c.layer_weights), c.rrf_k)
        else:
            one = lex if mode == "bm25" else sem.withColumn("score", F.col("score") * 100)
            scored = one.withColumn("ord", F.col("doc_idx").cast("double"))
        scored = ranking.boosted(scored, self.chosen(scored, mode == "hybrid"), F.broadcast(asked), c, mode == "hybrid")
        if any(q.filtered and not q.query for q in batch):
            scored = scored.unionByName(self._listing(queries, asked, batch))
        order = W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "ord")
        return scored.withColumn("pos", F.row_number().over(order)).select("query_id", "pos", "doc_idx", "score", "factor")

    def search(self, batch: list[Query], mode: str = "hybrid") -> DataFrame:
        """query_id, rank and the fields of a hit. Wide columns are met only by the hits."""
        queries = self.frame(batch).select("query_id", "limit", "deduplicate")
        ids = F.array_distinct(F.concat("case_ids", F.when(F.col("case_id") != "", F.array("case_id")).otherwise(F.array().cast("array<string>"))))
        keys = self.docs.select("doc_idx", ids.alias("ids"), F.col("source_channel").alias("channel"))
        leaders = ranking.deduplicate(self.ranked(batch, mode).join(keys, "doc_idx").join(F.broadcast(queries), "query_id"))
        return self._hits(leaders)

    def explain(self, batch: list[Query], mode: str = "hybrid") -> DataFrame:
        """Every candidate with the parts of its score: ranks and scores of both layers, boosts, and the final score."""
        c, queries = self.config, self.frame(batch)
        mode = self.effective_mode(mode, batch)
        parts = self.ranked(batch, mode)
        none = F.lit(None)
        if mode != "semantic":
            lex = ranking.top(self._eligible(ranking.lexical(ranking.query_terms(queries, c, self.lemma), self.postings), queries, batch), c.top)
            parts = parts.join(lex.select("query_id", "doc_idx", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score")), ["query_id", "doc_idx"], "left")
        else:
            parts = parts.withColumns({"bm25_rank": none.cast("int"), "bm25_score": none.cast("double")})
        if mode != "bm25":
            sem = ranking.top(self._eligible(ranking.semantic(queries, self._known()), queries, batch), c.top)
            parts = parts.join(sem.select("query_id", "doc_idx", F.col("rank").alias("sem_rank"), F.col("score").alias("sem_sim")), ["query_id", "doc_idx"], "left")
        else:
            parts = parts.withColumns({"sem_rank": none.cast("int"), "sem_sim": none.cast("double")})
        asked = queries.select("query_id", text.tokens(F.col("query"), c, self.lemma).alias("words"))
        few = mode == "hybrid" and not any(q.filtered and not q.query for q in batch)
        wide = self.chosen(parts, few).select("doc_idx", "year", (F.length("sections.vs_position") > 0).alias("structured_vs"), "lemmas")
        met = parts.join(F.broadcast(asked), "query_id").join(wide, "doc_idx")
        near = 1 + c.proximity * ranking.proximity(F.col("lemmas"), F.col("words"), c)
        return met.select("query_id", "pos", "doc_idx", "bm25_rank", "bm25_score", "sem_rank", "sem_sim", "structured_vs", near.alias("proximity_x"), dates.freshness(F.col("year"), c).alias("freshness_x"), "factor", F.col("score").alias("final"))

    def _hits(self, leaders: DataFrame) -> DataFrame:
        d = self.docs.select("doc_idx", "id", "title", "court", "date", text.strip(F.regexp_replace("case_number", "\n", " ")).alias("case_number"), text.snippet(F.col("sections.vs_position"), F.col("sections.residual"), F.col("title"), self.config.snippet).alias("snippet"), F.col("hashtags").alias("tags"), "case_id")
        met = F.broadcast(leaders).join(d, "doc_idx")  # at most a limit's for each query
        return met.select("query_id", "rank", "id", "title", "court", "date", "case_number", F.round("score", 4).alias("score"), "snippet", "tags", "case_id", "alternative_channels")

    def find_similar(self, case: int, limit: int = 10) -> DataFrame:
        """The nearest by stored vectors, the anchor left out; scores are cosines times 100; no boosts."""
        if self.vectors is None:
            raise RuntimeError("there are no vectors")
        if not 1 <= limit <= 20 or case < 0:
            raise ValueError("limit is 1 to 20, ids are not negative")
        anchor = self.vectors.where(F.col("doc_id") == case).limit(1).select(F.col("embedding").alias("a"))
        rest = self._known().where(F.col("doc_id") != case)
        near = rest.crossJoin(F.broadcast(anchor)).select(F.lit(0).cast("long").alias("query_id"), F.col("doc_id").alias("doc_idx"), (dot(F.col("embedding"), F.col("a")) * 100).alias("score"))
        near = near.orderBy(F.desc("score"), "doc_idx").limit(limit)
        ranks = near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_idx"))).withColumn("alternative_channels", F.array().cast("array<string>"))
        return self._hits(ranks)

    def get_case(self, case: int) -> DataFrame:
        return catalog.get_case(self.docs, case)

    def list_tags(self, min_count: int = 1) -> DataFrame:
        return catalog.list_tags(self.docs, min_count)

    def stats(self) -> DataFrame:
        return catalog.stats(self.docs)


def card(hit: dict) -> str:
    """A hit as a text card."""
    also = f" (also: {', '.join(hit['alternative_channels'])})" if hit["alternative_channels"] else ""
    return f"{hit['rank']}. [{hit['score']}] {hit['title']}\n   {hit['court']}, {hit['date']}, {hit['case_number'][:120]}{also}\n   {hit['snippet']}"
