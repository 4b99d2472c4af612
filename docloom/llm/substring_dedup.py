"""Substring deduplication with prefix-partitioned suffix trees.

A window is ``W`` consecutive words. A window that also starts in a document with a smaller key is
removed, word by word; all windows are judged on the input.

Only suffixes that can matter go into trees. Each window has an anchor: its ``GRAM``-word piece of the
smallest hash (the first, on ties), so that equal windows have anchors at the same place in them. Anchors
stand in about one of 22 positions. The suffix of a window start is filed under the prefix that ends with
its anchor: between ``GRAM`` and ``W`` words long. Three steps:

1. anchors are counted (partial sums); only those of at least two documents are shared. A fixed-size
   bit filter (at most ``FILTER_BYTES``) tells the second pass; its false positives cost work, not rows;
2. suffixes under a shared anchor are grouped by it, and groups are put together to pieces of
   ``PIECE_WORDS``. Each piece's suffixes are sorted by prefix doubling, to depth ``W``: suffixes that agree
   so far hang below one internal node, whose smallest key decides;
3. a group of over ``GROUP`` suffix runs would be too large for a piece: its prefixes are lengthened to the
   full window, where a node is one key of a partial minimum; so no task holds a hot group.

Defined results: a null text has no words; documents with null keys are reported and keep every word;
of rows with one key none is smaller; repeated rows are each reported; empty tables give no rows; other
columns are left out. Keys are whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, lean, maybe_broadcast, plus, table, tuned, width, written

W = 50
GRAM = 8
GROUP = 4_000
PIECE_WORDS = 1_500_000
FILTER_BYTES = 32 << 20
MEMO = 200_000
_U = np.uint64


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split()  # ASCII white space: blank and 09 to 0D


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Words:
    """64-bit hashes of a text's words; MEMO bounds what is remembered."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        try:
            return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in words:
                if w not in memo:
                    memo[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k hashes."""
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * _U(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
    return _mix(out)


def anchors(h: np.ndarray, w: int = W, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text of at least w words: anchor hashes, and the first and last window start of each."""
    g = rolled(h, gram)
    span = w - gram + 1
    at = np.lib.stride_tricks.sliding_window_view(g, span).argmin(axis=1) + np.arange(len(g) - span + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    return g[at[first]], first, last


def _filter(shared: DataFrame, rows: int) -> tuple[int, np.ndarray]:
    """A bit for every hash of the column h: (mask, bits). Each task makes its own slice of it. The place is
    in a hash's low bits: anchors are smallest hashes, so that their high bits are mostly zero."""
    bits = min(FILTER_BYTES * 8, 1 << max(16, (16 * max(rows, 1)).bit_length()))
    bits = 1 << bits.bit_length() - 1
    slices = 16
    per = bits // slices

    def mark(pdf):
        own = np.zeros(per, bool)
        own[pdf["bit"].to_numpy() % per] = True
        pdf = pdf[["slice"]].iloc[:1].copy()
        pdf["bits"] = [np.packbits(own).tobytes()]
        return pdf

    at = shared.select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("bit")).distinct().select("bit", F.expr(f"cast(bit div {per} as int)").alias("slice"))
    whole = np.zeros(bits // 8, np.uint8)
    for r in at.groupBy("slice").applyInPandas(mark, "slice int, bits binary").toLocalIterator():
        whole[r["slice"] * per // 8 : (r["slice"] + 1) * per // 8] = np.frombuffer(r["bits"], np.uint8)
    return bits - 1, whole


def _marked(hashes: np.ndarray, held: tuple[int, np.ndarray]) -> np.ndarray:
    mask, bits = held
    at = (hashes & _U(mask)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def deep_nodes(word: np.ndarray, begin: np.ndarray, count: np.ndarray, doc: np.ndarray, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a piece, sorted to depth w by prefix doubling.

    word: hashes of all segments' words, one after the other; begin: each segment's place; count: its
    window starts (it has count + w - 1 words); doc: its key. Returns, of the window starts whose node
    (the suffixes that agree in w words) has a smaller key than theirs, the segment and place in it."""
    rank = np.unique(word, return_inverse=True)[1].astype(np.int64)
    n, depth = len(rank), 1
    while depth < w:
        step = min(depth, w - depth)
        pair = rank[: n - step] * (n + 1) + rank[step:] + 1
        tail = rank[n - step :] * (n + 1)  # runs over the end: no window starts there
        rank = np.unique(np.concatenate([pair, tail]), return_inverse=True)[1].astype(np.int64)
        depth += step
    seg = np.repeat(np.arange(len(begin)), count)
    place = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
    node = rank[begin[seg] + place]
    low = np.full(int(node.max()) + 1 if len(node) else 0, np.iinfo(np.int64).max)
    np.minimum.at(low, node, doc[seg])
    gone = low[node] < doc[seg]
    return seg[gone], place[gone]


def _runs(seg: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring places of a segment: segment, first, last."""
    first = np.flatnonzero(np.concatenate([[True], (seg[1:] != seg[:-1]) | (place[1:] != place[:-1] + 1)])) if len(seg) else np.array([], np.int64)
    last = np.append(first[1:], len(seg)) - 1 if len(first) else first
    return seg[first], place[first], place[last]


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", w: int = W) -> DataFrame:
    """row (hash of key and text), start, end: word ranges covered by windows that start in a smaller key."""
    tuned(docs.sparkSession)
    rows = docs.select(F.col(text).cast("binary").alias("text"), F.col(key).cast("long").alias("doc")).where(F.col("text").isNotNull() & F.col("doc").isNotNull())
    rows = rows.withColumn("row", F.xxhash64("doc", "text"))
    n = width(docs)

    def list_anchors(batches):
        hashes = Words()
        for b in batches:
            hs, ds, cs = [], [], []
            for t, d in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                words = words_of(t.as_py())
                if len(words) < w:
                    continue
                h, c = np.unique(anchors(hashes(words), w)[0], return_counts=True)
                hs.append(h)
                cs.append(c)
                ds.append(np.full(len(h), d, np.int64))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view("<i8")), pa.array(np.concatenate(ds)), pa.array(np.concatenate(cs).astype("i8"))], names=["h", "doc", "c"])

    listed = rows.select("text", "doc").mapInArrow(lean(list_anchors), "h long, doc long, c long")
    shared = listed.groupBy("h").agg(F.min("doc").alias("x"), F.max("doc").alias("y"), F.sum("c").alias("c")).where("x < y").select("h", (F.col("c") > GROUP).alias("big"))
    shared = written(shared, "dedup-shared")
    sizes = shared.agg(F.count("*").alias("n"), F.count_if("big").alias("big")).head()
    context = docs.sparkSession.sparkContext
    filters = context.broadcast((_filter(shared, sizes["n"]), _filter(shared.where("big"), sizes["big"])))

    def cut(batches):
        """Kind 0: a segment under an anchor (h, words); kind 1: the windows of a hot anchor, by their hashes."""
        hashes = Words()
        some, hot = filters.value
        names = ["kind", "h", "doc", "row", "start", "words"]
        for b in batches:
            out = ([], [], [], [], [])
            wide = ([], [], [], [])
            for t, d, r in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = words_of(t.as_py())
                if len(words) < w:
                    continue
                own = hashes(words)
                h, first, last = anchors(own, w)
                ok = _marked(h, some)
                big = ok & _marked(h, hot)
                for i in np.flatnonzero(ok & ~big):
                    for x, v in zip(out, (h[i], d, r, first[i], b" ".join(words[first[i] : last[i] + w])), strict=True):
                        x.append(v)
                if big.any():
                    full = rolled(own, w)
                    for i in np.flatnonzero(big):
                        for x, v in zip(wide, (d, r, first[i], full[first[i] : last[i] + 1].tobytes()), strict=True):
                            x.append(v)
            if out[0]:
                k = len(out[0])
                yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int8()), pa.array(np.array(out[0], np.uint64).view("<i8")), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(np.array(out[3], np.int64)), pa.array(out[4], pa.binary())], names=names)
            if wide[0]:
                k = len(wide[0])
                yield pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int8()), pa.nulls(k, pa.int64()), pa.array(wide[0], pa.int64()), pa.array(wide[1], pa.int64()), pa.array(np.array(wide[2], np.int64)), pa.array(wide[3], pa.binary())], names=names)

    def trees(batches):
        hashes = Words()
        held: list[tuple] = []
        words, last = 0, None

        def judge():
            own = [hashes(x[3].split()) for x in held]
            sizes = np.array([len(x) for x in own])
            seg, place = deep_nodes(np.concatenate(own), np.cumsum(sizes) - sizes, sizes - w + 1, np.array([x[0] for x in held], np.int64), w)
            seg, a, z = _runs(seg, place)
            start = np.array([x[2] for x in held], np.int64)[seg]
            return pa.RecordBatch.from_arrays([pa.array(np.array([x[1] for x in held], np.int64)[seg]), pa.array(start + a), pa.array(start + z + w)], names=["row", "start", "end"])

        for b in batches:
            for h, d, r, s, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if h != last and words >= PIECE_WORDS:
                    yield judge()
                    held.clear()
                    words = 0
                last = h
                held.append((d, r, s, t))
                words += t.count(b" ") + 1
        if held:
            yield judge()

    parts = written(rows.mapInArrow(lean(cut), "kind byte, h long, doc long, row long, start long, words binary"), "dedup-suffixes")
    segments = parts.where("kind = 0").select("h", "doc", "row", "start", "words")
    small = segments.repartition(n, "h").sortWithinPartitions("h").mapInArrow(lean(trees), "row long, start long, end long")
    large = _hot(parts.where("kind = 1").select("doc", "row", "start", F.col("words").alias("windows")), w)
    return small.unionByName(large)


def _hot(runs: DataFrame, w: int) -> DataFrame:
    """row, start, end for runs of windows of hot anchors (doc, row, start, windows: their hashes, packed).
    The smallest key of each window is a partial minimum, by batch, task and then hash."""

    def minima(batches):
        for b in batches:
            doc = b.column(0).to_numpy()
            packed = b.column(1).to_pylist()
            h = np.frombuffer(b"".join(packed), "<i8")
            doc = np.repeat(doc, [len(x) // 8 for x in packed])
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.array([], np.int64)
            last = np.append(first[1:], len(h)) - 1 if len(first) else first
            yield pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(doc[first]), pa.array(doc[last])], names=["h", "low", "high"])

    low = runs.select("doc", "windows").mapInArrow(lean(minima), "h long, low long, high long")
    low = written(low.groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("h", "low"), "dedup-low")
    if low.count() * 16 > BROADCAST_BYTES:  # too many to broadcast: one row a window, joined by its hash

        def unpack(batches):
            for b in batches:
                for d, r, s, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    h = np.frombuffer(x, "<i8")
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), d)), pa.array(np.full(len(h), r)), pa.array(s + np.arange(len(h)))], names=["h", "doc", "row", "start"])

        every = runs.select("doc", "row", "start", "windows").mapInArrow(lean(unpack), "h long, doc long, row long, start long")
        return every.join(low, "h").where("low < doc").select("row", "start", (F.col("start") + w).alias("end"))
    rows = low.toPandas().sort_values("h")
    held = runs.sparkSession.sparkContext.broadcast((rows["h"].to_numpy(), rows["low"].to_numpy()))

    def judge(batches):
        keys, lows = held.value
        for b in batches:
            packed = b.column(3).to_pylist()
            sizes = [len(x) // 8 for x in packed]
            h = np.frombuffer(b"".join(packed), "<i8")
            run = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
            gone = (keys[at] == h) & (lows[at] < b.column(0).to_numpy()[run]) if len(keys) else np.zeros(len(h), bool)
            run, a, z = _runs(run[gone], place[gone])
            start = b.column(2).to_numpy()[run]
            # neighbouring anchors' ranges of one document overlap: one row for each run of them
            row, a, z = b.column(1).to_numpy()[run], start + a, start + z + w
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (a[1:] > z[:-1]) | (a[1:] < a[:-1])])) if len(row) else np.array([], np.int64)
            last = np.append(first[1:], len(row)) - 1 if len(first) else first
            yield pa.RecordBatch.from_arrays([pa.array(row[first]), pa.array(a[first]), pa.array(z[last])], names=["row", "start", "end"])

    return runs.select("doc", "row", "start", "windows").mapInArrow(lean(judge), "row long, start long, end long")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", w: int = W) -> DataFrame:
    """key, n_words, n_removed, kept (the remaining words joined by a blank), removed array<struct<start, end>>
    (merged word ranges)."""
    ranges = written(repeats(docs, key, text, w), "dedup-ranges")
    by_row = written(ranges.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("ranges")), "dedup-rows")
    touched = by_row.count()
    rows = docs.select(F.col(key), F.col(text).cast("binary").alias("_text"))
    rows = rows.withColumn("_row", F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key).cast("long"), "_text")))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(batches):
        for b in batches:
            n_words, n_removed, kept, removed = [], [], [], []
            for t, spans in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                words = words_of(t.as_py())
                merged: list[list[int]] = []
                for x in spans or []:
                    if merged and x["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["end"])
                    else:
                        merged.append([x["start"], x["end"]])
                at, rest = 0, []
                for a, z in merged:
                    rest += words[at:a]
                    at = z
                rest += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(rest))
                kept.append(b" ".join(rest))
                removed.append([{"start": a, "end": z} for a, z in merged])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(removed, kind)], names=[b.schema.names[0], "n_words", "n_removed", "kept", "removed"])

    schema = plus(docs.select(key).schema, "n_words long, n_removed long, kept string, removed array<struct<start:long,end:long>>")
    small = maybe_broadcast(by_row.select(F.col("row").alias("_row")), touched, 16)
    none = F.lit(None).cast("array<struct<start:long,end:long>>").alias("ranges")
    clean = rows.join(small, "_row", "left_anti").select(key, "_text", none)
    marked = rows.join(small, "_row", "left_semi").join(by_row.withColumnRenamed("row", "_row"), "_row").select(key, "_text", "ranges")
    return clean.unionByName(marked).mapInArrow(lean(remove), schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, s, sha256(array_to_string(w[s:s + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
low AS (SELECT h, min(doc_id) AS low FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 50)) AS p FROM win JOIN low USING (h) WHERE low < doc_id)),
word AS (SELECT doc_id, p, w[p] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t
  FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
