"""The pipeline's stages against brute force over few documents."""

import re

import corpus_pipeline as cp
from docloom.llm import decontamination, ngram_join, pii
from docloom.llm.common import written


def run_stages(spark, docs, sf):
    out = {}
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, sf), "test-stage")
        out[name] = docs
    return out


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = run_stages(spark, docs, sf)
    rows = {n: {r.doc_id: r for r in d.collect()} for n, d in out.items()}
    assert all(out[n].columns == docs.columns for n, _ in cp.STAGES[:-1])
    start = {r.doc_id: r.text for r in docs.collect()}
    assert set(rows["language_id"]) == {i for i, t in start.items() if re.search(r"[^\W\d_]", t or "")}

    before = rows["language_id"]
    sets = {i: ngram_join.shingles((r.text or "").encode()) for i, r in before.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert set(rows["ngram_jaccard_join"]) == {i for i in sets if find(i) == i}

    wm = decontamination.WuManber([(str(r.item_id), r.text.encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])

    def hit(t):
        w = decontamination.words_of((t or "").encode())
        n = sum(z - a for a, z in wm.search(w)[0])
        return n > 0 and 20 * n >= len(w)

    assert set(rows["decontamination"]) == {i for i, r in rows["ngram_jaccard_join"].items() if not hit(r.text)}
    for i, r in rows["pii"].items():
        assert not pii.base_spans(r.text) or "[" in r.text
        assert r.n_chars == len(r.text)
    assert set(rows["bpe"]) == set(rows["pii"]) and all(r.n_tokens == len(r.ids) for r in rows["bpe"].values())


def test_language_keeps_a_text_in_four_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts: dict = {}
    for r in docs.orderBy("doc_id").collect():
        if r.lang and r.text:
            texts[r.lang] = texts.get(r.lang, "") + " " + r.text
    four = " ".join(texts[x][:600] for x in ("de", "en", "es", "fr"))
    more = spark.createDataFrame([(10**9, four, None, "s", len(four)), (10**9 + 1, "xqzj wvkp qqzx zzkw " * 30, None, "s", 600)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in cp.language(spark, docs.select(*more.columns).unionByName(more), sf).select("doc_id").collect()}
    assert 10**9 in kept and 10**9 + 1 not in kept


def test_odd_rows_and_clashing_columns(spark, sf):
    docs = spark.createDataFrame([(1, "the same text of six words", "en", "s", 1, 5, "x"), (1, "the same text of six words", "en", "s", 1, 5, "x"), (2, "The same text of six words", None, None, None, None, None), (None, "the same text of six words", "en", "s", 1, 1, "y"), (3, None, "en", "s", 1, 1, "y"), (4, "", "en", "s", 1, 1, "y"), (5, "call +1 (234) 555-1234 or the other one", "en", "s", 1, 1, "y")], "doc_id long, text string, lang string, source string, n_chars long, score int, spans string")
    out = run_stages(spark, docs, sf)
    kept = out["ngram_jaccard_join"].collect()
    assert sorted(r.doc_id for r in kept) == [1, 5] and all(out[n].columns == docs.columns for n, _ in cp.STAGES[:-1])
    assert [r.text for r in out["pii"].collect() if r.doc_id == 5] == ["call [phone] or the other one"]
    assert run_stages(spark, docs.limit(0), sf)["bpe"].collect() == []


def test_readers_and_writers_hold_little(spark):
    """A task holds a small batch of what it reads, and writes its rows in small groups."""
    import glob

    import pyarrow.parquet as pq

    wide = spark.range(0, 40_000, 1, 1).selectExpr(*[f"sha2(cast(id + {i} as string), 512) as c{i}" for i in range(8)])
    found = written(wide, "test-groups")
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512
    (file,) = glob.glob(found.scratch_path.removeprefix("file:") + "/*.parquet")
    assert pq.ParquetFile(file).metadata.num_row_groups > 1 and found.count() == 40_000
