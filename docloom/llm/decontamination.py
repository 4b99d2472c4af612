"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows (13 consecutive words of an item, or the whole of a shorter
one), grouped by length. For each length m a table gives, for every block of up to three words, how
far the search may skip (m - 3 + 1 for a block that no pattern holds); at shift 0 the block, which is
the suffix of some patterns, selects a bucket of test windows, and the words are compared directly.

The benchmark is read in slices of at most ``SLICE_BYTES`` of text, each broadcast on its own; with
one slice (the usual case) documents are scanned once and nothing is shuffled. With more, each slice
is one scan and the hits of a document are merged by (key, text), so any benchmark size is searched
whole.

Defined results: null texts and texts without words have no words and no hits; items without words
have no window; an item with a null id marks words but is not listed; repeated documents are each
reported; empty tables give empty results or no hits; other columns are left out.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, plus, table, tuned, union_all, written

N = 13
BLOCK = 3
SLICE_BYTES = 16 << 20

#: Bytes of UTF-8: A-Z to lower case, every other ASCII byte that is no letter or digit to a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


class WuManber:
    """Shift tables and suffix buckets of one slice of patterns."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int = N):
        patterns: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for key, text in items:
            w = words_of(text)
            m = min(n, len(w))
            for i in range(len(w) - m + 1 if m else 0):
                patterns[m][tuple(w[i : i + m])].add(key)
        self.tables = []
        for m, found in sorted(patterns.items()):
            b = min(BLOCK, m)
            shift: dict[bytes, int] = {}
            buckets: dict[bytes, list] = defaultdict(list)
            for p, keys in found.items():
                for j in range(b, m + 1):
                    block = b" ".join(p[j - b : j])
                    if m - j < shift.get(block, m):
                        shift[block] = m - j
                buckets[b" ".join(p[m - b :])].append((list(p), sorted(k for k in keys if k is not None)))
            self.tables.append((m, b, shift, dict(buckets)))

    def search(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged word ranges [start, end) inside occurrences, and ids of the items that occur."""
        spans, ids = [], set()
        for m, b, shift, buckets in self.tables:
            longest, at, n, look = m - b + 1, m, len(w), shift.get
            while at <= n:
                block = b" ".join(w[at - b : at])
                skip = look(block, longest)
                if skip:
                    at += skip
                    continue
                window = w[at - m : at]
                for p, keys in buckets[block]:
                    if p == window:
                        spans.append((at - m, at))
                        ids.update(keys)
                at += 1
        merged: list[tuple[int, int]] = []
        for a, z in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(z, merged[-1][1]))
            else:
                merged.append((a, z))
        return merged, ids


def _slices(bench: DataFrame, item: str, text: str):
    """The benchmark, slice by slice; a slice is what one broadcast may hold."""
    rows = bench.select(F.col(item).cast("string").alias("item"), F.col(text).cast("binary").alias("text")).where(F.col("text").isNotNull())
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    n = max(1, -(-total // SLICE_BYTES))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else rows
        yield [(r["item"], bytes(r["text"])) for r in part.collect()]


def _scan(docs: DataFrame, key: str, text: str, items: list, n: int, extra: list) -> DataFrame:
    """One pass over the documents with one slice; ``extra`` columns are handed through."""
    tuned(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((items, n))
    rows = docs.select(F.col(text).cast("binary").alias("_text"), F.col(key), *extra)
    kept = rows.schema.names[1:]
    schema = plus(rows.drop("_text").schema, "n_words long, hits array<struct<start:long,end:long>>, items array<string>")
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        wm = WuManber(*held.value)
        for b in batches:
            counts, hits, found = [], [], []
            for t in b.column(0).to_pylist():
                w = words_of(t)
                spans, ids = wm.search(w)
                counts.append(len(w))
                hits.append([{"start": a, "end": z} for a, z in spans])
                found.append(sorted(ids))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(counts, pa.int64()), pa.array(hits, spans_type), pa.array(found, pa.list_(pa.string()))], names=[*kept, "n_words", "hits", "items"])

    return rows.mapInArrow(lean(run), schema)


def _merged(spans):
    """Union of word ranges, as a fold over the sorted ranges."""
    first = F.array().cast("array<struct<start:long,end:long>>")

    def put(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (x["start"] <= last["end"]), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), first, put)


def decontaminate(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = N) -> DataFrame:
    """key, n_words, hits (merged word ranges, end exclusive), items (sorted ids with occurring windows)."""
    slices = list(_slices(bench, item, item_text))
    if len(slices) == 1:
        return _scan(docs, key, text, slices[0], n, [])
    mark = F.sha2(F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary")), 256).alias("_mark")
    found = union_all([written(_scan(docs, key, text, s, n, [mark]).where(F.size("hits") > 0), "decontamination") for s in slices])
    each = found.groupBy(F.col(key).alias("_key"), F.col("_mark").alias("_m")).agg(F.array_distinct(F.flatten(F.collect_set("hits"))).alias("_hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_items"))
    rows = _scan(docs, key, text, [], n, [mark])
    joined = rows.join(each, rows[key].eqNullSafe(each["_key"]) & (rows["_mark"] == each["_m"]), "left")
    none = F.array()
    return joined.select(rows[key], "n_words", _merged(F.coalesce("_hits", none.cast("array<struct<start:long,end:long>>"))).alias("hits"), F.coalesce("_items", none.cast("array<string>")).alias("items"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS win
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS s
        FROM (SELECT item_id, w, least(13, len(w)) AS m FROM b WHERE len(w) > 0))),
dw AS (
  SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s
        FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hit AS (SELECT doc_id, item_id, dw.m, s FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""
