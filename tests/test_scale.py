"""What keeps the engine's queries in proportion to their input: what is shuffled, what is built, and how often."""

import re
import time

import duckdb
import pytest
from docloom.operators import index, ranking
from docloom.plans import fixture
from docloom.plans.queries import ORACLES, QUERIES
from pyspark.sql import functions as F


def shuffles(df):
    """Keys by which a plan deals out rows."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return re.findall(r"Exchange (?:hash|range)partitioning\((.*?), \d+\)", plan)


@pytest.fixture
def unbuilt(monkeypatch):
    monkeypatch.setattr(fixture, "_BUILT", {})
    return monkeypatch


@pytest.mark.parametrize("name", ["adjacent_pairs", "cardinality_guard", "duplicate_groups", "cosine_topk", "semantic_hits", "case_groups", "find_similar", "embedding_meta", "filter_listing"])
def test_no_index_where_none_is_asked(spark, sf, unbuilt, name):
    def never(*_):
        raise AssertionError("the index was built")

    unbuilt.setattr(index, "statistics", never)
    QUERIES[name](spark, sf).collect()


@pytest.mark.parametrize("name", ["bm25_topk", "bm25_weighted_sections", "candidate_union", "rrf_hybrid", "search_hits"])
def test_queries_do_not_write_documents(spark, sf, unbuilt, name):
    wrote, write = [], fixture.scratch_table
    unbuilt.setattr(fixture, "scratch_table", lambda df, what: wrote.append(what) or write(df, what))
    QUERIES[name](spark, sf).collect()
    assert wrote == ["section_stats", "term_stats", "postings"]
    asked = {w for _, q, _ in fixture.ASKED for w in q.split()}
    assert {r.term for r in fixture.postings(spark, sf).select("term").distinct().collect()} <= asked


def test_words_are_counted_where_they_stand(spark, sf):
    got = index.statistics(fixture.documents(spark, sf))
    assert not any("doc_idx" in x for x in shuffles(got["postings"]))
    few = index.postings(index.section_words(fixture.documents(spark, sf)), got["term_stats"], got["section_stats"], only=["license"])
    assert shuffles(few) == [] or not any("term" in x and "doc_idx" in x for x in shuffles(few))
    rounded = lambda df: sorted((*r[:4], round(r.part, 9)) for r in df.where("term = 'license'").select("section", "term", "doc_idx", "tf", "part").collect())
    assert rounded(few) == rounded(got["postings"]) and few.count() > 0


def test_repeated_ids_as_in_sql(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    texts = ["the license\nlicense version the\nx y", "apache apache version\nthe", None, "", "gnu license and\n\n\npublic license", "reserved"]
    ids = [1, 1, 2, None, None, 3]
    spark.createDataFrame([(i, t, "en", "src1", 0) for i, t in zip(ids, texts, strict=True)], schema).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("bm25_term_stats", "bm25_section_stats", "bm25_topk", "bm25_weighted_sections", "append_rebuild"):
        df = QUERIES[name](spark, f"file://{tmp_path}")
        got = con.execute(ORACLES[name])
        names = [x[0] for x in got.description]
        plain = lambda r: tuple(round(x, 4) if isinstance(x, float) else x for x in r)
        assert sorted((plain(r) for r in df.select(*names).collect()), key=repr) == sorted((plain(r) for r in got.fetchall()), key=repr), name


def test_filters_deal_out_no_text(spark, sf):
    e, b = fixture.engine(spark, sf), fixture.batch(spark, sf, article="License")
    assert "text" not in e._narrow(b).columns
    scored = spark.range(5).select(F.lit(1).cast("long").alias("query_id"), F.col("id").alias("doc_idx"), F.lit(1.0).alias("score"))
    want = {r.doc_idx for r in e.docs.where("doc_idx < 5 and contains(lower(text), 'license')").collect()}
    assert {r.doc_idx for r in e._eligible(scored, e.frame(b), b).collect()} == want


def test_words_of_candidates_only(spark, sf):
    e = fixture.engine(spark, sf)
    plan = e.chosen(spark.range(3).withColumnRenamed("id", "doc_idx"), True).select("doc_idx", "lemmas")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp_extract_all") < plan.index("LeftSemi")  # the words are made above the choice of rows


def test_proximity_of_a_common_word_is_linear(spark):
    words = "struct<title:array<string>,fabula:array<string>,vs_position:array<string>,full:array<string>>"
    row = spark.createDataFrame([(["a", "b"], ([], [], [], ["a"] * 30_000 + ["x", "x", "x", "b"]))], f"asked array<string>, words {words}")
    began = time.time()
    assert row.select(ranking.proximity(F.col("words"), F.col("asked"))).first()[0] == 0.0
    assert time.time() - began < 20


def test_fold_meets_leaders_only(spark, sf, monkeypatch):
    met, fold = [], ranking.deduplicate
    monkeypatch.setattr(ranking, "deduplicate", lambda df: met.append(df.count()) or fold(df))
    assert QUERIES["dedup_leader"](spark, sf).count() > 0
    assert met[0] <= 10 * len(fixture.ASKED)
