"""Index build: enrichment, postings with precomputed weights, statistics, identifier groups, increments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from ..config import SECTIONS, SearchConfig
from ..functions import dates, text
from ..sources import store


def lemmas(sections: Column, title: Column, hashtags: Column, config: SearchConfig, lemma: Column | None = None) -> Column:
    """Words of each section. Without position and facts the residual stands for the position, so that it counts twice
    in the full text."""
    parts = {"title": title, **{s: sections[s] for s in ("fabula", "lower_courts", "vs_position", "residual")}, "tags": F.array_join(hashtags, " ")}

    def of(w: Column) -> Column:
        vs = F.when((F.size(w["vs_position"]) == 0) & (F.size(w["fabula"]) == 0), w["residual"]).otherwise(w["vs_position"])
        full = F.concat(w["title"], w["fabula"], w["lower_courts"], vs, w["residual"])
        return F.struct(*[w[s].alias(s) for s in ("title", "fabula", "lower_courts")], vs.alias("vs_position"), full.alias("full"), w["tags"].alias("tags"))

    return text.let(F.struct(*[text.tokens(c, config, lemma).alias(s) for s, c in parts.items()]), of)


def enrich(raw: DataFrame, config: SearchConfig = SearchConfig(), lemma: Column | None = None) -> DataFrame:
    """Raw records to documents: sections, words, case numbers, dates. doc_idx, the tie-breaker, is the id."""
    from ..sources.corpus import coerce

    d = coerce(raw).withColumn("doc_idx", F.col("id")).withColumn("sections", text.sections(F.col("text")))
    d = d.withColumn("iso_date", dates.iso_date(F.col("date"))).withColumn("year", dates.iso_year(F.col("iso_date")))
    if config.reconcile_years:
        d = d.withColumn("year", dates.reconcile(F.col("year"), dates.year_from_anchor(F.col("text")), dates.year_from_case(F.col("case_number"))))
    d = d.withColumn("case_ids", text.case_ids(F.col("case_number"), F.col("text"))).withColumn("case_id", text.primary_id(F.col("case_ids")))
    return d.withColumn("lemmas", lemmas(F.col("sections"), F.col("title"), F.col("hashtags"), config, lemma))


def _words(section: str) -> Column:
    """A section's words; an empty section holds the empty word."""
    held = F.col(f"lemmas.{section}")
    return F.when(F.size(held) == 0, F.array(F.lit(""))).otherwise(held)


def section_words(docs: DataFrame) -> DataFrame:
    """doc_idx and by section a struct of words and lens. Rows of one id (or of none) are one document to the counts of
    words, while each of them keeps its length: only such rows are shuffled."""
    each = docs.select("doc_idx", *[F.struct(_words(s).alias("words"), F.array(F.size(_words(s))).alias("lens")).alias(s) for s in SECTIONS])
    again = docs.groupBy("doc_idx").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc_idx").alias("again"))
    if not again.head(1):
        return each
    same = F.col("doc_idx").eqNullSafe(F.col("again"))
    both = [F.struct(*[F.flatten(F.collect_list(f"{s}.{x}")).alias(x) for x in ("words", "lens")]).alias(s) for s in SECTIONS]
    return each.join(again, same, "left_anti").unionByName(each.join(again, same, "left_semi").groupBy("doc_idx").agg(*both))


def statistics(docs: DataFrame, config: SearchConfig = SearchConfig()) -> dict[str, DataFrame]:
    """doc_len, section_stats, term_stats and postings. Words are counted in one pass, whose result, a row for each
    section and word, is written; no word of a text is shuffled but as a count of its task."""
    doc_len = docs.select("doc_idx", F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.size(_words(s)).alias("dl")) for s in SECTIONS])).alias("p")).select("p.section", "doc_idx", "p.dl")
    words = section_words(docs)
    # beside its distinct words, each text gives a row of the null word, with its length
    each = words.select(F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.col(f"{s}.words").alias("words"), F.col(f"{s}.lens").alias("lens")) for s in SECTIONS])).alias("p")).select("p.*")
    total = F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)
    each = each.select("section", F.size("lens").alias("n"), total.alias("dl"), F.explode(F.array_append(F.array_distinct("words"), F.lit(None).cast("string"))).alias("term"))
    text_row = F.col("term").isNull()
    counted = each.groupBy("section", "term").agg(F.sum(F.when(text_row, F.col("n")).otherwise(1)).alias("df"), F.sum(F.when(text_row, F.col("dl"))).alias("dl"))
    counted = store.scratch_table(counted, "counted")
    sizes = counted.where("term is null").select("section", F.col("df").alias("n"), (F.col("dl") / F.col("df")).alias("avgdl"))
    idf0 = counted.where("term is not null").join(F.broadcast(sizes), "section").withColumn("idf0", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf0.groupBy("section").agg(F.avg("idf0").alias("avg_idf"))
    section_stats = sizes.join(mean, "section").withColumn("eps", F.lit(config.epsilon) * F.col("avg_idf"))
    term_stats = idf0.join(F.broadcast(section_stats.select("section", "eps")), "section").select("section", "term", "df", F.when(F.col("idf0") < 0, F.col("eps")).otherwise(F.col("idf0")).alias("idf"))
    return {"doc_len": doc_len, "section_stats": section_stats, "term_stats": term_stats, "postings": postings(words, term_stats, section_stats, config)}


def postings(words: DataFrame, term_stats: DataFrame, section_stats: DataFrame, config: SearchConfig = SearchConfig(), only: list[str] | None = None) -> DataFrame:
    """section, term, doc_idx, tf, part. words: of section_words(). A posting carries its whole contribution to a score (``part``), so that a query
    is one lookup by word and one sum. only: the words that a batch asks for; statistics are of the whole corpus."""

    def counts(s: str) -> Column:
        held = F.col(f"{s}.words") if only is None else F.filter(f"{s}.words", lambda w: w.isin(*only))
        return F.transform(text.word_counts(held), lambda x: F.struct(F.lit(s).alias("section"), x["term"].alias("term"), x["tf"].alias("tf"), F.col(f"{s}.lens").alias("lens")))

    counted = words.where("doc_idx is not null").select("doc_idx", F.explode(F.concat(*[counts(s) for s in SECTIONS])).alias("p"))
    counted = counted.select("doc_idx", "p.section", "p.term", "p.tf", F.explode("p.lens").alias("dl"))
    terms = term_stats if only is None else F.broadcast(term_stats.where(F.col("term").isin(*only)))
    long = counted.join(terms, ["section", "term"]).join(F.broadcast(section_stats.select("section", "avgdl")), "section")
    weight = F.create_map(*[x for s in SECTIONS for x in (F.lit(s), F.lit(float(config.weights.get(s, 0.0))))])
    part = F.col("idf") * F.col("tf") * (config.k1 + 1) / (F.col("tf") + config.k1 * (1 - config.b + config.b * F.col("dl") / F.col("avgdl"))) * weight[F.col("section")]
    return long.select("section", "term", "doc_idx", "tf", part.alias("part"))


def case_groups(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("case_ids").alias("case_id"), "id").groupBy("case_id").agg(F.sort_array(F.collect_set("id")).alias("doc_ids"))


def lemma_map(table: DataFrame, most: int = 200_000) -> Column:
    """A lemma dictionary (token, lemma) of at most ``most`` rows as a map literal; larger ones are an error, to be
    joined on distinct words instead."""
    rows = table.select("token", "lemma").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} lemmas: join them on distinct words")
    return F.create_map(*[x for r in rows for x in (F.lit(r["token"]), F.lit(r["lemma"]))])


TABLES = ("docs", "postings", "doc_len", "section_stats", "term_stats", "case_groups")


def build(docs: DataFrame, root: str, force: bool = False, config: SearchConfig = SearchConfig(), schema_version: int = 3) -> str:
    """Write the whole index as a new version under root. Postings are laid out by word, so that a lookup prunes."""
    stats = statistics(docs, config)
    stats["postings"] = stats["postings"].repartitionByRange("term").sortWithinPartitions("term", "section")
    return store.write_version({"docs": docs, **stats, "case_groups": case_groups(docs)}, root, force, {"schema_version": schema_version})


def collisions(new: DataFrame, old: DataFrame) -> DataFrame:
    """New ids that are there already; an increment with any is refused."""
    return new.select("id").join(old.select("id"), "id", "left_semi")


def append(new: DataFrame, root: str, config: SearchConfig = SearchConfig()) -> str:
    """Add enriched documents and rebuild the statistics over the whole corpus."""
    spark = new.sparkSession
    old = store.read_version(spark, root, ("docs",))["docs"]
    clash = collisions(new, old).limit(5).collect()
    if clash:
        raise ValueError(f"ids are taken: {[r['id'] for r in clash]}")
    return build(old.unionByName(new.select(*old.columns)), root, True, config)


def next_id(docs: DataFrame) -> DataFrame:
    return docs.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))


def section_presence(docs: DataFrame) -> DataFrame:
    has = lambda s: F.length(F.col(f"sections.{s}")) > 0
    return docs.agg(F.count("*").alias("n_docs"), *[F.count_if(has(s)).alias(f"with_{s}") for s in ("fabula", "lower_courts", "vs_position")], F.count_if(has("residual") & ~has("fabula") & ~has("lower_courts") & ~has("vs_position")).alias("residual_only"))


def duplicate_groups(docs: DataFrame) -> DataFrame:
    sizes = docs.select(F.explode("case_ids").alias("c"), "id").groupBy("c").agg(F.count_distinct("id").alias("n"))
    return sizes.where("n > 1").agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_members"))


def migrate_case_ids(docs: DataFrame) -> DataFrame:
    """Counters of the multi-id migration: documents that gain an id, and those with several."""
    ids = text.case_ids(F.col("case_number"), F.col("text"))
    d = docs.select(F.size(ids).alias("n"), (F.coalesce("case_id", F.lit("")) == "").alias("none"))
    return d.agg(F.count_if((F.col("n") > 0) & F.col("none")).alias("added"), F.count_if(F.col("n") > 1).alias("multi_id"))


def migrate_years(docs: DataFrame) -> DataFrame:
    """id, year, new_year and the sign that decided, for the year migration."""
    d = docs.select("id", "year", dates.year_from_anchor(F.col("text")).alias("anchor"), dates.year_from_case(F.col("case_number")).alias("case_year"))
    new = dates.reconcile(F.col("year"), F.col("anchor"), F.col("case_year"))
    sign = F.when(F.col("anchor").isNull() & F.col("case_year").isNull(), "no_signal").when(new == F.col("anchor"), "anchor").when(new == F.col("case_year"), "case").otherwise("date")
    return d.withColumn("new_year", new).withColumn("sign", sign)




def embedding_meta(docs: DataFrame) -> DataFrame:
    """One row: documents to embed, and the mean length of their texts, rounded down."""
    c = lambda n: F.col(f"sections.{n}")
    body = text.embedding_text(F.col("title"), c("vs_position"), c("fabula"), c("residual"), F.col("text"))
    return docs.agg(F.count("*").alias("n_texts"), F.floor(F.avg(F.length(body))).cast("long").alias("mean_length"))
