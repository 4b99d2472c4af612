import random

import pytest
from docloom.config import SearchConfig
from docloom.operators import catalog, index, ranking
from docloom.plans.engine import Query, SearchEngine
from docloom.sources import corpus, store
from docloom.streaming import ingest
from pyspark.sql import functions as F

WORDS = "аренда залог неустойка поставка подряд хищение наследство опека банкротство налог пошлина страхование вексель ипотека".split()


def raw(spark, n=14):
    rows = []
    for i in range(1, n + 1):
        w = WORDS[(i - 1) % len(WORDS)]
        text = f"Фабула дела: спор о {w} номер{i}. Позиция ВС: {w} {w} подлежит пересмотру и {WORDS[i % len(WORDS)]}."
        rows.append((i, "СКЭС ВС РФ" if i % 2 else "СКГД ВС РФ", f"{i}.03.{2015 + i % 10}", f"Спор {w}", f"305-ЭС24-{10 + i // 2}", text, [f"тег_{i % 3}"], ["ст. 333 ГК"], f"канал{i % 4}"))
    from docloom import schema

    return spark.createDataFrame(rows, schema.RAW)


@pytest.fixture(scope="module")
def engine(spark):
    docs = store.scratch_table(index.enrich(raw(spark)), "t-docs")
    rnd = random.Random(1)
    vec = []
    for i in range(1, 15):
        v = [rnd.gauss(0, 1) for _ in range(8)]
        n = sum(x * x for x in v) ** 0.5
        vec.append((i, [x / n for x in v]))
    vectors = spark.createDataFrame(vec, "doc_id long, embedding array<float>")
    return SearchEngine(spark, docs, index.statistics(docs)["postings"], vectors)


def test_relevance_and_dedup(engine):
    hits = engine.search([Query(1, "наследство опека")], "bm25").orderBy("rank").collect()
    assert {h.id for h in hits[:2]} & {7, 8}
    plain = engine.search([Query(1, "спор", deduplicate=False)], "bm25").count()
    led = engine.search([Query(1, "спор")], "bm25").collect()
    assert plain >= len(led)
    ids = [h.case_id for h in led]
    assert len(ids) == len(set(ids))


def test_filters(engine):
    q = dict(query="пересмотру налог залог аренда", limit=50, deduplicate=False)
    every = {h.id for h in engine.search([Query(1, **q)], "bm25").collect()}
    skes = {h.id for h in engine.search([Query(1, court="скэс", **q)], "bm25").collect()}
    other = {h.id for h in engine.search([Query(1, court="прочее", **q)], "bm25").collect()}
    assert skes == {i for i in every if i % 2} and other == every
    assert {h.id for h in engine.search([Query(1, tag="ТЕГ 1", **q)], "bm25").collect()} == {i for i in every if i % 3 == 1}
    assert {h.id for h in engine.search([Query(1, year_from=2018, year_to=2019, **q)], "bm25").collect()} == {i for i in every if 2015 + i % 10 in (2018, 2019)}
    assert {h.id for h in engine.search([Query(1, article="номер3", **q)], "bm25").collect()} == {i for i in every if "3" in str(i) or i == 3}


def test_listing_and_guard(engine):
    assert [h.id for h in engine.search([Query(1, tag="тег2", limit=50, deduplicate=False)], "bm25").orderBy("rank").collect()] == [2, 5, 8, 11, 14]
    assert engine.search([Query(1)], "bm25").count() == 0


def test_modes(engine):
    assert engine.effective_mode("hybrid", [Query(1, "x")]) == "bm25"
    with pytest.raises(RuntimeError):
        engine.effective_mode("semantic", [Query(1, "x")])
    with pytest.raises(ValueError):
        engine.effective_mode("lexical", [])
    v = [1.0] + [0.0] * 7
    hits = engine.search([Query(1, "залог аренда", vector=v), Query(2, "налог", vector=v, limit=3)]).collect()
    assert {h.query_id for h in hits} == {1, 2} and sum(h.query_id == 2 for h in hits) <= 3


def test_similar_and_lookup(engine):
    got = engine.find_similar(3, 5).orderBy("rank").collect()
    assert len(got) == 5 and 3 not in {h.id for h in got} and [h.score for h in got] == sorted((h.score for h in got), reverse=True)
    assert engine.find_similar(999).count() == 0
    case = engine.get_case(4).collect()
    assert len(case) == 1 and "lemmas" not in case[0].asDict() and engine.get_case(999).count() == 0
    assert engine.list_tags().first()["count"] == 5
    assert engine.stats().first()["total"] == 14
    with pytest.raises(ValueError):
        catalog.list_tags(engine.docs, 0)


def test_fuse(spark):
    layer = lambda ids: spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(ids)], "query_id long, doc_idx long, rank int")
    order = lambda df: [r.doc_idx for r in df.orderBy(F.desc("score"), "ord").collect()]
    assert order(ranking.fuse([layer([5, 1, 3])])) == [5, 1, 3]
    got = order(ranking.fuse([layer([1, 2, 3, 4]), layer([3, 1, 2, 5])]))
    assert got[0] == 1 and got[-1] in (4, 5)
    assert order(ranking.fuse([layer([1, 2, 3]), layer([9, 8, 7])], [1, 0])) == [1, 2, 3]
    assert order(ranking.fuse([layer([]), layer([])])) == []
    with pytest.raises(ValueError):
        ranking.fuse([layer([1]), layer([2])], [1])


def test_dedup_against_loop(spark):
    rnd = random.Random(7)
    rows, want = [], {}
    for q in range(60):
        limit, leaders, seen = rnd.choice([1, 3, 10]), [], {}
        for p in range(rnd.randint(0, 20)):
            ids, ch = rnd.sample("abcdefg", rnd.randint(0, 3)), rnd.choice(["", "x", "y", "z"])
            rows.append((q, p, p, 1.0, ids, ch, limit, True))
            if len(leaders) >= limit:
                continue
            hit = next((i for i in ids if i in seen), None)
            if hit is None:
                for i in ids:
                    seen[i] = len(leaders)
                leaders.append((p, []))
            else:
                at = seen[hit]
                if ch and ch not in leaders[at][1]:
                    leaders[at][1].append(ch)
                for i in ids:
                    seen.setdefault(i, at)
        want[q] = leaders
    df = spark.createDataFrame(rows, "query_id long, pos int, doc_idx long, score double, ids array<string>, channel string, limit int, deduplicate boolean")
    got: dict = {q: [] for q in want}
    for r in ranking.deduplicate(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_idx, list(r.alternative_channels)))
    assert got == want


def test_proximity(spark):
    schema = "asked array<string>, words struct<title:array<string>,fabula:array<string>,vs_position:array<string>,full:array<string>>"
    rows = [(["a", "b"], ([], ["a", "x", "x", "b"], [], [])), (["a", "b"], ([], ["a", "x", "x", "x", "b"], [], [])), (["a", "b"], (["a", "b"], [], [], [])), (["a", "a"], ([], ["a"], [], [])), (["a", "a"], ([], ["a", "a"], [], [])), (["a"], (["a"], [], [], [])), (["a", "b", "c"], ([], [], [], ["a", "b"]))]
    got = [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(ranking.proximity(F.col("words"), F.col("asked"))).collect()]
    assert got == [1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.5]


def test_index_versions_and_append(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    docs = index.enrich(raw(spark))
    with pytest.raises(store.IndexNotFoundError):
        store.current_version(spark, root)
    index.build(docs.where("id <= 10"), root)
    with pytest.raises(FileExistsError):
        index.build(docs, root)
    with pytest.raises(ValueError):
        index.append(docs.where("id = 3"), root)
    index.append(docs.where("id > 10"), root)
    got = store.read_version(spark, root, index.TABLES)
    want = index.statistics(docs)
    for name in ("term_stats", "section_stats"):
        key = sorted(got[name].columns)
        rounded = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*key).collect())
        assert rounded(got[name]) == rounded(want[name])
    assert SearchEngine.load(spark, root).stats().first()["total"] == 14


def test_streaming_ingest_equals_batch(spark, tmp_path):
    root, src = f"file://{tmp_path}/index", f"{tmp_path}/in"
    corpus.write_json(raw(spark).where("id <= 9").coalesce(1), src)
    run = lambda: ingest.ingest(spark.readStream.schema(raw(spark).schema).json(src), root, f"{tmp_path}/ck").awaitTermination(120)
    run()
    raw(spark).where("id >= 8").coalesce(1).write.mode("append").json(src)
    run()
    docs = store.read_version(spark, root, ("docs",))["docs"]
    assert sorted(r.id for r in docs.select("id").collect()) == list(range(1, 15))


def test_digest(spark, tmp_path):
    (tmp_path / "a.md").write_text(
        "## СКЭС ВС РФ (2)\n### 1. 01.02.2024 — Первый\n**Реквизиты:** 305-ЭС24-1\n**Теги:** #а, #б\n**Нормы:** ст. 1 ГК; ст. 2 ГК\n**Источник:** канал «Новости ВС РФ»\n**Текст обзора:** мимо\nстрока\n\n\n\nконец\n---\nвне\n"
        "### 2. 3.4.2023 - Второй\n**Текст обзора:**\nтело\n### не заголовок\n## Прочее (1)\n### 3. 1.1.2020 — Нет суда\n## ВС РФ (1)\n### 4. 1.1.2021 — Третий\n",
        encoding="utf-8",
    )
    got = [r.asDict() for r in corpus.read_digest(spark, f"file://{tmp_path}/a.md", 10).orderBy("id").collect()]
    assert [(r["id"], r["court"], r["date"], r["title"]) for r in got] == [(10, "СКЭС ВС РФ", "01.02.2024", "Первый"), (11, "СКЭС ВС РФ", "3.4.2023", "Второй"), (12, "ВС РФ", "1.1.2021", "Третий")]
    assert got[0]["text"] == "строка\n\nконец" and got[0]["hashtags"] == ["а", "б"] and got[0]["articles"] == ["ст. 1 ГК", "ст. 2 ГК"] and got[0]["source_channel"] == "Новости ВС РФ"
    assert got[1]["text"] == "тело\n### не заголовок" and got[2]["text"] == ""


def test_embedder_retries_and_half_precision(spark):
    from docloom.functions.vectors import from_half, to_half

    class Flat:
        def embed(self, texts, kind):
            import numpy as np

            return np.array([[3.0, 4.0]] * len(texts))

    out = corpus.embed(spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string"), Flat()).orderBy("doc_id").collect()
    assert [round(x, 4) for x in out[0].embedding] == [0.6, 0.8]
    v = spark.createDataFrame([([0.1, -0.5],)], "v array<float>").select(from_half(to_half("v")).alias("v")).first().v
    assert abs(v[0] - 0.1) < 1e-3 and v[1] == -0.5


def test_migrations_and_counts(spark):
    docs = index.enrich(raw(spark), SearchConfig(reconcile_years=True))
    assert docs.where("year < 2024").count() == 0
    assert index.next_id(docs).first()[0] == 15
    assert index.section_presence(docs).first()["with_vs_position"] == 14
    assert index.duplicate_groups(docs).first()["n_groups"] == 6
    assert index.migrate_case_ids(docs.withColumn("case_id", F.lit(""))).first()["added"] == 14
    assert index.migrate_years(docs).groupBy("sign").count().count() >= 1
