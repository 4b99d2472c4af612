"""Operators of the llm subpackage against SQL and brute force, and their defined results for odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from docloom.llm import ann, bpe, decontamination, language_id, license_scan, ngram_join, pii, registry, substring_dedup, token_store, toxicity
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " \n\t ", "word", "a b c d", "a b c d e f", "a b c d e f", "é 日本  x", "x" * 50_000, ("alpha beta gamma delta " * 4000).strip()]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A data folder of few, odd rows, and one of empty tables."""
    out = {}
    for name, keep in (("odd", True), ("empty", False)):
        d = f"file://{tmp_path_factory.mktemp(name)}"
        df = docs(spark, ODD + ODD[3:6], [*range(len(ODD)), 3, 90, None]).withColumn("score", F.lit(1)).withColumn("kept", F.lit("clash")).withColumn("uid", F.lit(None).cast("string"))
        (df if keep else df.limit(0)).write.parquet(f"{d}/documents.parquet")
        b = spark.createDataFrame([(1, "a b c"), (2, None), (None, "word"), (3, "")], "item_id long, text string")
        (b if keep else b.limit(0)).write.parquet(f"{d}/benchmark.parquet")
        lab = spark.createDataFrame([(3, 1, 1), (4, None, 0), (5, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
        (lab if keep else lab.limit(0)).write.parquet(f"{d}/labels.parquet")
        e = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (50, [0.5, 0.5]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<float>").withColumn("node", F.lit("x"))
        (e if keep else e.limit(0)).write.parquet(f"{d}/embeddings.parquet")
        out[name] = d
    return out


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_odd_rows(name, spark, small):
    got = registry.QUERIES[name](spark, small["odd"]).collect()
    if name.startswith("op6"):
        assert {r.query_id for r in got} == {0, 50} and [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0] == [1, 50, 2]
    else:
        assert sorted(str(r.doc_id) for r in got) == sorted(str(x) for x in [*range(len(ODD)), 3, 90, None])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(name, spark, small):
    assert registry.QUERIES[name](spark, small["empty"]).collect() == []


def brute_components(rows, n=5):
    sets = {i: ngram_join.shingles((t or "").encode(), n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_join_of_edited_copies(spark, monkeypatch):
    """Sizes of every band, edits around the threshold, and a crowd of near copies; crowded and not."""
    rnd = random.Random(11)
    texts = []
    for size in [1, 3, 5, 6, 8, 9, 11, 15, 20, 30, 45, 70, 120, 200, 400]:
        base = [rnd.choice("qwertyuiop") + str(rnd.randint(0, 99999)) for _ in range(size)]
        for k in range(10):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, max(1, size // 50), max(1, size // 40)])):
                p, act = rnd.randrange(len(w)), rnd.choice("sid")
                if act == "s":
                    w[p] = f"new{rnd.randint(0, 10**6)}"
                elif act == "i":
                    w.insert(p, f"new{rnd.randint(0, 10**6)}")
                elif len(w) > 1:
                    del w[p]
            texts.append(" ".join(w).upper() if k == 3 else " ".join(w))
    base = [f"c{i}" for i in range(160)]
    for _ in range(70):
        w = list(base)
        for p in rnd.sample(range(160), rnd.randint(1, 7)):
            w[p] = f"e{rnd.randint(0, 10**6)}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    want = brute_components(rows)
    for crowd, cell, stars in ((48, 1024, 3), (3, 8, 0)):
        monkeypatch.setattr(ngram_join, "CROWD", crowd)
        monkeypatch.setattr(ngram_join, "CELL", cell)
        monkeypatch.setattr(ngram_join, "STARS", stars)
        got = ngram_join.jaccard_join(docs(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) > 20 and max(Counter(c for _, c in want.values()).values()) > 20


def test_join_compares_components_as_they_stand(spark, monkeypatch):
    """Drawn links that join one crowd of many: the rest is compared with that crowd's classes as one component."""
    rnd = random.Random(3)
    texts = []
    for _ in range(12):
        base = [f"w{rnd.randint(0, 10**9)}" for _ in range(60)]
        texts += [" ".join([*base, f"e{rnd.randint(0, 10**9)}"]) for _ in range(12)]
    first = [ngram_join._uid(ngram_join.Hasher(5)(t.encode())).hex().upper() for t in texts[:12]]
    best, drawn, planned, labels = ngram_join._best, ngram_join._drawn, ngram_join._planned, []

    def draw(hot, turn, num, den):
        monkeypatch.setattr(ngram_join, "_best", best)
        return drawn(hot, turn, num, den).where(F.hex("a").isin(first))

    def plan(pairs, hot, sizes):
        labels.extend(r.label for r in sizes.where(F.hex("uid").isin(first)).collect())
        per = hot.groupBy("sig").agg(F.countDistinct("label").alias("n")).agg(F.min("n"), F.max("n")).head()
        assert per[0] > 1 and per[1] == 12
        return planned(pairs, hot, sizes)

    monkeypatch.setattr(ngram_join, "CROWD", 8)
    monkeypatch.setattr(ngram_join, "_best", lambda met, num, den: best(met, num, den).limit(0))
    monkeypatch.setattr(ngram_join, "_drawn", draw)
    monkeypatch.setattr(ngram_join, "_planned", plan)
    got = ngram_join.jaccard_join(docs(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(list(enumerate(texts)))
    assert len(set(labels)) < max(2, len(labels))


def test_join_through_rows_without_a_key(spark):
    """Two documents that only one with a null key links, and copies of null keys alone."""
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words[a:z]) for a, z in ((0, 90), (5, 95), (14, 100))] + ["other words " + " ".join(words[::-1])] * 2
    got = ngram_join.jaccard_join(docs(spark, texts, [1, None, 2, None, None])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("1", "1"), ("2", "1"), ("None", "1"), ("None", "None"), ("None", "None")]


def test_join_signatures_find_every_similar_pair():
    """The pigeonhole itself: any similar pair has a signature in common, and as many as promised."""
    rnd = np.random.default_rng(5)
    for size in [*range(1, 60), 90, 150, 333, 700, 1500]:
        for _ in range(4):
            a = np.unique(rnd.integers(0, 2**63, size * 2, dtype=np.uint64))[:size]
            most = ngram_join.most_different(len(a))
            gone = int(rnd.integers(0, most + 1))
            b = np.unique(np.concatenate([a[: len(a) - gone // 2], rnd.integers(0, 2**63, gone - gone // 2, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both):
                continue
            (sa, fa), (sb, fb) = ngram_join.signatures(a), ngram_join.signatures(b)
            assert len(np.intersect1d(sa, sb)) >= min(fa, fb) >= 1


def test_join_allocates_neighbourhoods():
    """Wherever many differences are allowed, segments carry their subsets, of several shingles on average."""
    for band in range(3, 25):
        segments, cells, need, most = ngram_join.allocation(band)
        lo, hi = ngram_join.band_range(band)
        assert most == ngram_join.most_different(hi) and segments >= need == (most + 1 if cells == 1 else most // 2 + 1)
        assert cells > 2 or most < 15, (band, cells)
        assert cells == 1 or lo / segments * (cells - 1) / cells > 2.5


def test_dedup_hot_passage_by_either_way(spark, monkeypatch):
    rnd = random.Random(2)
    word = lambda: f"w{rnd.randint(0, 10**6)}"
    passage = [word() for _ in range(75)]
    texts = [" ".join([word() for _ in range(rnd.randint(0, 90))] + passage[rnd.randint(0, 5) :] + [word() for _ in range(rnd.randint(0, 40))]) for _ in range(40)] + ["same " * 130] * 3 + [None, "short"]

    def brute():
        first, split = {}, [(t or "").split() for t in texts]
        for i, w in enumerate(split):
            for s in range(len(w) - 49):
                first.setdefault(tuple(w[s : s + 50]), i)
        out = []
        for i, w in enumerate(split):
            gone = {p for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < i for p in range(s, s + 50)}
            out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
        return out

    want = brute()
    for group, room in ((4000, 32 << 20), (5, 32 << 20), (5, 0)):
        monkeypatch.setattr(substring_dedup, "GROUP", group)
        monkeypatch.setattr(substring_dedup, "BROADCAST_BYTES", room)
        got = substring_dedup.deduplicate(docs(spark, texts)).orderBy("doc_id").collect()
        assert [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got] == want


def test_license_places(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows |= {10_001: "MIT License, mit license CC BY", 10_002: "gnu general public licenses", 10_003: "The Apache\nLicense. GNU GENERAL PUBLIC LICENSE", 10_004: None}
    for r in license_scan.license_scan(docs(spark, list(rows.values()), list(rows))).collect():
        w = re.findall(license_scan.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), rows[r.doc_id] or ""))
        want = sorted((i, label) for p, label in license_scan.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert (r.n_words, sorted((m.start, m.label) for m in r.matches if m.base)) == (len(w), want)
        assert all(0 <= m.coverage <= 1 for m in r.matches)


def test_license_added_labels(spark, sf):
    """All matches, of every template, against each alignment tried in a loop; and a text of 200,000 matching words."""
    rnd = random.Random(3)
    templates = license_scan.catalogue()
    weight = license_scan.idf(templates)
    texts = []
    for _ in range(60):
        w = []
        for _ in range(rnd.randint(1, 4)):
            own = list(rnd.choice(templates).words)
            for _ in range(rnd.choice([0, 0, 1, 3])):
                own[rnd.randrange(len(own))] = rnd.choice(["x", "license", "mit", "É"])
            w += own[rnd.choice([0, 0, 1]) :] + ["and"] * rnd.randint(0, 2)
        texts.append(" ".join(w).upper() if rnd.random() < 0.2 else ", ".join(w))
    for r in license_scan.license_scan(docs(spark, texts)).collect():
        w = re.findall(license_scan.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id]))
        want = set()
        for t in templates:
            for s in range(-len(t.words), len(w)):
                there = [0 <= s + j < len(w) and w[s + j] == x for j, x in enumerate(t.words)]
                share = sum(weight[x] for x, ok in zip(t.words, there, strict=True) if ok) / sum(weight[x] for x in t.words)
                if all(there[t.key_at : t.key_at + len(t.key)]) and share >= 0.6:
                    want.add((t.label, s, s + t.key_at, round(min(1.0, share), 9)))
        assert {(m.label, m.start, m.at, round(m.coverage, 9)) for m in r.matches} == want and len(r.matches) == len(want)
    long = license_scan.license_scan(docs(spark, ["mit license " * 100_000])).collect()[0]
    assert long.n_words == 200_000 and sum(m.label == "mit" for m in long.matches) == 100_000


def brute_pii(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2]) and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_base_fuzz():
    rnd = random.Random(4)
    bits = ["@", "a", "1", "12", "255", "4111 1111 1111 1111", ".", "-", " ", "+", "+1", "(", "3", "99", "b.c", "é", "%"]
    for _ in range(8000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 16)))
        assert pii.base_spans(t) == brute_pii(t)


def test_pii_bootstraps_and_masks(spark):
    """Held-out identifiers in contexts that seeds taught; contexts in which words stand teach nothing."""
    seeds = [f"please write to user{i}@mail.example.com today" for i in range(12)]
    keys = [f"token = {hashlib.sha1(str(i).encode()).hexdigest()} is set" for i in range(12)]
    loose = [f"as sent by user{i}@mail.example.com then" for i in range(6)] + [f"as sent by {w} then" for w in ("us", "them", "nobody", "all", "some", "one", "post")]
    odd = ["Please write to user77(at)mail, today", "numbers 12345 are harmless", "please write to 8827-ax-91 today", None, "", 'a token = "hunter-two" İ token = kept; b']
    texts = seeds + keys + loose + odd + [odd[0]]
    df = docs(spark, texts).withColumns({"_mark": F.lit(1), "_spans": F.lit("x")})
    found = pii.find(df)
    spans = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end], s.base) for s in r.spans] for r in found.collect()}
    at = len(texts) - len(odd) - 1
    assert spans[0] == [("email", "user0@mail.example.com", True)] and spans[12] == [("secret", keys[0].split()[2], False)]
    assert spans[at] == spans[at + 6] == [("email", "user77(at)mail", False)] and spans[at + 2] == [("email", "8827-ax-91", False)]
    assert spans[at + 1] == spans[at + 3] == spans[at + 4] == [] and spans[at + 5] == [("secret", "hunter-two", False), ("secret", "kept", False)]
    assert not any(spans[i] for i in range(30, 37))
    masked = {r.doc_id: r.text for r in pii.mask(df, found).collect()}
    assert masked[0] == "please write to [email] today" and masked[at] == "Please write to [email], today" and masked[at + 1] == odd[1] and masked[at + 3] is None


def brute_learn(rows):
    """Patterns of rows (kind, value, patterns), scored by loops."""
    edges = {}
    for kind, value, patterns in rows:
        for p in patterns:
            edges.setdefault(p, {})[value] = max(kind or "", edges.get(p, {}).get(value) or "") or None
    scores = {v: (k, 1.0) for vs in edges.values() for v, k in vs.items() if k}
    known, good = dict(scores), {}
    for _ in range(pii.ROUNDS):
        good = {}
        for p, vs in edges.items():
            best = max(((sum(scores[v][1] for v in vs if v in scores and scores[v][0] == k) / (len(vs) + 0.5), k, sum(v in scores and scores[v][0] == k and scores[v][1] >= 0.5 for v in vs)) for k in pii.KINDS + pii.MORE))
            if best[0] >= pii.CONFIDENT and best[2] >= pii.SUPPORT:
                good[p] = best[1], best[0]
        unseen = {}
        for p, (k, c) in good.items():
            for v, own in edges[p].items():
                if not own and v not in known:
                    unseen.setdefault(v, {}).setdefault(k, []).append(1 - min(c, 0.999))
        scores = known | {v: max(((1 - float(np.prod(x)), k) for k, x in ks.items()))[::-1] for v, ks in unseen.items()}
    return good


def test_pii_query_equals_brute_force(spark, sf, tmp_path):
    """The whole query on a small table, hashes and spans, against loops over its texts."""
    rnd = random.Random(9)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kinds = {"reach me at": "u%d@mail.example.com", "the token =": "%040xe", "from host": "10.0.0.%d", "go to the": "w%d"}
    for i in range(160):
        context = rnd.choice(list(kinds))
        value = kinds[context] % i if rnd.random() < 0.9 else rnd.choice(["word", f"x-{i}", f"8{i}"])
        texts[10_000 + i] = f"{context} {value} {rnd.choice(['now', 'today'])} and so on"
    df = docs(spark, list(texts.values()), list(texts))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    first = {i: pii.instances(t, [x for part in pii.seeds(t) for x in part]) for i, t in texts.items()}
    kept = brute_learn([(k, v, p) for rows in first.values() for k, _, _, v, p in rows])
    second = {}
    for i, t in texts.items():
        low = pii._folded(t or "")
        tokens = [(m.start(), m.end()) for m in re.finditer(r"\S+", t or "")]
        word = lambda k: (lambda a, z: low[a:z])(*pii._core(low, *tokens[k])) if 0 <= k < len(tokens) else ""  # noqa: E731, B023
        own = [x for part in pii.seeds(t) for x in part]
        second[i] = []
        for k, (a, z) in enumerate(tokens):
            a, z = pii._core(t, a, z)
            if a == z or not word(k - 1):
                continue
            seed = next((x for x in own if x[1] < z and a < x[2]), None)
            b, e = (seed[1], seed[2]) if seed else (a, z)
            after = next((j for j, (x, _) in enumerate(tokens) if x >= e), len(tokens))
            ps = [p for p in pii._patterns((word(k - 2), word(k - 1), word(after))) if p in kept]
            if ps:
                second[i].append((seed[0] if seed else None, b, e, t[b:e].lower(), ps))
    good = brute_learn([(k, v, p) for rows in second.values() for k, _, _, v, p in rows])
    added = 0
    for r in registry.QUERIES["op4_pii"](spark, f"file://{tmp_path}").collect():
        t = texts[r.doc_id]
        base, more = pii.seeds(t)
        assert base == brute_pii(t or "")
        more = more + [(max((good[p][1], good[p][0]) for p in ps if p in good)[1], a, z) for k, a, z, _, ps in second[r.doc_id] if k is None and any(p in good for p in ps)]
        order = {k: i for i, k in enumerate(pii.KINDS + pii.MORE)}
        write = lambda xs: ",".join(f"{k}:{a}:{z}" for k, a, z in sorted(set(xs), key=lambda x: (order[x[0]], x[1], x[2])))
        assert (r.base_sha256, r.spans) == (sha(write(base)), write(base + more)), t
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        added += len(more)
    assert good and added


def test_bpe_equals_library(spark, sf, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rnd = random.Random(1)
    bits = [" ", "  ", "\n", "\t", "a", "'s", "1", "é", "!", "\xa0", "<|endoftext|>", "́", "\x1c", "日", "Don", "\r\n", "Σ", "İ", "</w>"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(400)] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(80).collect()] + [None]
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 20_000)
    got = bpe.decode(bpe.encode(docs(spark, texts).repartition(3), path), path).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == tok.decode(ids, skip_special_tokens=False)


def test_token_store_round_trip(spark, sf):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(900, "a<|endoftext|> b  \n c"), (901, None)]
    store = token_store.TokenStore.write(docs(spark, [t for _, t in rows], [i for i, _ in rows]), path)
    found = store.read(store.locate(store.directory.select("key", "occurrence", "h1", "h2")), lambda ids: zlib.crc32(ids.tobytes()), "crc long").orderBy("key").collect()
    start = 0
    for r, (i, t) in zip(found, sorted(rows, key=lambda x: x[0]), strict=True):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        assert (r.key, r.start, r.length, r.crc) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = store.get([900, 901, 123_456])
    assert got == {900: tok.encode(rows[-2][1], add_special_tokens=False).ids + [0], 901: [0]}


def test_perfect_hash():
    rnd = np.random.default_rng(1)
    h1, h2 = rnd.integers(0, 2**64, 5000, dtype=np.uint64), rnd.integers(0, 2**64, 5000, dtype=np.uint64)
    h1[7] = h1[8]  # equal first hashes go to the exact list
    at = np.arange(5000)
    raw = token_store.dump_index(h1, h2, at % 5, at, at + 1)
    got = token_store.lookup(raw, h1, h2)
    assert (got["offset"] == at).all() and (got["length"] == at + 1).all() and (got["shard"] == at % 5).all()
    mph, left = token_store.PerfectHash.build(h1)
    slots = mph.slots(np.delete(h1, left))
    assert sorted(slots) == list(range(mph.n)) and len(left) == 2
    absent = token_store.lookup(raw, rnd.integers(0, 2**64, 2000, dtype=np.uint64), rnd.integers(0, 2**64, 2000, dtype=np.uint64))
    assert (absent["length"] == np.uint64(2**64 - 1)).sum() >= 1990


def test_ann_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got: dict = {}
    for r in ann.op6_nearest_neighbours(spark, sf).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hit = total = 0
    for q in ids[ids % 50 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -2
        best = ids[np.lexsort((ids, -s))[:5]]
        hit += len(set(best) & {v for v, _ in got[q].values()})
        total += 5
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
    assert hit / total >= 0.9


def test_ann_copies(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(40)] + [(100 + i, [float(i), 1.0, 0.0]) for i in range(10)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5] and all(abs(r.score - 1) < 1e-12 for r in got)


def test_ann_hot_near_copies(spark):
    """A third of the vectors are near copies of one, closer than 8-bit steps tell apart."""
    rnd = np.random.default_rng(1)
    x = rnd.standard_normal((3000, 32))
    x[:1000] = x[0] + 1e-4 * rnd.standard_normal((1000, 32))
    x = x.astype(np.float32)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    got: dict = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = []
    for q in range(0, 3000, 20):
        s = y @ y[q]
        s[q] = -2
        hits.append(len(set(np.argsort(-s)[:5].tolist()) & got[q]))
    assert sum(hits[:50]) / 250 >= 0.9 and sum(hits[50:]) / 500 >= 0.9


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in language_id.op7_language_id(spark, sf).collect() if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held) and len(held) > 150
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.98


def test_language_mixture(spark):
    rows = [(i, t, lang, "s", 1) for i, (t, lang) in enumerate([("the cat and the dog were there then", "en"), ("der hund und die katze waren nicht da", "de"), (None, "fr"), ("ignored", None)] * 8)]
    model = language_id.fit(spark.createDataFrame(rows, DOCS))
    assert model.languages == ["de", "en"]
    lang, share, found = model.predict("the dog and the cat " * 20 + "und die katze und der hund " * 20)
    assert {a for a, _ in found} == {"de", "en"} and 0.3 < share < 0.8
    assert model.predict("12345 !!")[0] == "und" and model.predict("the cat")[0] == "en"


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in toxicity.op10_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    pos, neg = ([r.score for r in rows if labels[r.doc_id] == y] for y in (1, 0))
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.9 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_kernel_tolerates_gaps():
    k = toxicity.Kernel(["<idiot>", "<clown>"])
    of = lambda t: max((float(v[0]) for v in k.near(sorted(toxicity.words_of(t)))[1]), default=0.0)
    assert of("idiot") > 0.999 and of("what an i d i o t !") > 0.999 and of("id.i-ot***") > 0.999 and of("idxiot") > 0.55 and of("harmless sentence") == 0
    brute = lambda s, t: sum(x * feats(t).get(f, 0) for f, x in feats(s).items())

    def feats(w):
        out: dict = {}
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for m in range(j + 1, len(w)):
                    if m - i < toxicity.SPAN:
                        out[w[i] + w[j] + w[m]] = out.get(w[i] + w[j] + w[m], 0) + toxicity.DECAY ** (m - i + 1)
        return out

    for w in ("<idiots>", "<idioot>", "<iidiot>"):
        want = brute(w, "<idiot>") / (brute(w, w) * brute("<idiot>", "<idiot>")) ** 0.5
        assert abs(float(k.near([w])[1][0][0]) - want) < 1e-4


def test_toxicity_by_sentence(spark):
    """Features, the fitted machine and the whole decision on a small table, against loops; ties score alike."""
    rnd = random.Random(8)
    plain = ["bread", "river", "window", "garden", "paper", "yellow", "idiom", "market"]
    texts = []
    for i in range(80):
        w = [[rnd.choice(plain) for _ in range(6)] for _ in range(rnd.randint(1, 5))]
        if i % 4 == 0:
            rnd.choice(w).insert(2, rnd.choice(["idiot", "stupid", "id.iot", "stuupid", "i d i o t"]))
        texts.append(". ".join(" ".join(x) for x in w))
    texts += [texts[0], None, ""]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    found = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    root, w = model.root, model.w

    def brute(t):
        best = w[-1]
        for sentence in re.split(r"[.!?]+\s+|\n+", t or ""):
            values = [v for x in toxicity.words_of(sentence) for v in model.kernel.near([x])[1]]
            if values:
                best = max(best, float(np.max(values, axis=0) @ root @ w[:-1] + w[-1]))
        return 1 / (1 + np.exp(-np.clip(model.a * best + model.b, -40, 40)))

    assert all(abs(found[i].score - brute(t)) < 1e-5 for i, t in enumerate(texts))
    assert abs(found[80].score - found[0].score) < 1e-9 and abs(found[81].score - found[82].score) < 1e-9
    toxic, clean = ([found[i].score for i in range(80) if (i % 4 == 0) == own] for own in (True, False))
    assert np.mean([(p > n) + 0.5 * (p == n) for p in toxic for n in clean]) > 0.95
    # the machine minimises its objective: no step in any direction is better
    x = np.c_[np.random.default_rng(0).normal(size=(60, 3)), np.ones(60)]
    s = np.where(x[:, 0] + 0.3 * x[:, 1] > 0.1, 1.0, -1.0)
    share = np.ones(60)
    weight = np.where(s > 0, 60 / (2 * (s > 0).sum()), 60 / (2 * (s < 0).sum()))
    loss = lambda v: 0.5 * (v[:-1] @ v[:-1]) + 0.5 * weight @ np.maximum(0, 1 - s * (x @ v)) ** 2
    at = toxicity._machine(x, s, share, 1.0)
    assert all(loss(at) <= loss(at + d) + 1e-6 for d in np.random.default_rng(1).normal(size=(200, 4)) * 0.05)


def test_wu_manber_slices(spark, sf, monkeypatch):
    whole = sorted(decontamination.op9_decontamination(spark, sf).collect())
    monkeypatch.setattr(decontamination, "SLICE_BYTES", 2000)
    assert sorted(decontamination.op9_decontamination(spark, sf).collect()) == whole


def test_ann_starts_from_near_blocks(spark, monkeypatch):
    """The graph that the rounds start from has most true neighbours already, and its blocks hold near copies of one vector
    in bounded numbers."""
    rnd = np.random.default_rng(3)
    x = rnd.standard_normal((6000, 64))
    x[:2500] = x[0] + 1e-3 * rnd.standard_normal((2500, 64))
    x = x.astype(np.float32)
    monkeypatch.setattr(ann, "BLOCK", 512)
    kept, merged = [], ann._merged
    monkeypatch.setattr(ann, "_merged", lambda offers, k, n: kept.append(merged(offers, k, n)) or kept[-1])
    nodes, members = ann.nodes_of(spark.createDataFrame(list(enumerate(x.tolist())), "id long, v array<float>"), "id", "v", 1)
    ann.neighbour_graph(nodes, changed=1.0)  # no round
    own = {r.node: r.id for r in members.collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    got = {own[r.node]: {own[i] for i in r.ids} for r in kept[0].collect()}
    hits = []
    for q in range(2500, 6000, 50):
        s = y @ y[q]
        s[q] = -2
        hits.append(len(set(np.argsort(-s)[:5].tolist()) & got[q]))
    assert len(kept) == 1 and sum(hits) / (5 * len(hits)) >= 0.6


def test_ann_walk_does_not_deal_out_vectors(spark, sf, monkeypatch):
    """A step of the walk joins pairs of ids with nodes and broadcast queries."""
    plans, written = [], ann.written
    monkeypatch.setattr(ann, "written", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or written(df, name))
    ann.op6_nearest_neighbours(spark, sf)
    beams = [p for name, p in plans if name == "ann-beam"]
    assert beams and all("rightHint=(strategy=broadcast)" in p and "zip_with" not in p for p in beams)
