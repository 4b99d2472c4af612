"""N-gram Jaccard join by universe-partition pigeonhole.

A document is its set of distinct word shingles. Sizes fall into bands; a pair belongs to the band of
its larger set, and a set takes part in each band that a partner of up to size / threshold can have.
In a band whose largest set has h shingles a similar pair differs in at most H = floor(2 h (1 - t) /
(1 + t)) shingles. The shingle universe is hashed into segments, and a segment into cells. A segment's
signatures are its subsets of all cells but one: its one-deletion neighbourhood, cell by cell. Two sets
that differ in one shingle of a segment, or only within one cell, agree in the subset without it, so a
segment uses up 2 of the H differences, and some floor(H / 2) + 1 segments are enough. With one cell the
signature is the whole segment, which uses up 1. ``allocation`` chooses segments and cells per band by
cost: signatures written against the chance meetings that short subsets bring.

Subsets of few shingles meet by chance, so each set leaves out those of fewer than q, with the largest q for
which it still has as many full segments (all subsets of at least q) as it needs. That loses nothing: of
a similar pair take the set of the larger q; one of its full segments has at most one difference, and the subset
that both have there has at least that q, so that the other set writes it too.

Signatures are packed by hash part with numpy, and only those that two different sets share are kept.
Equal sets are one class from the start (128-bit hash of the set), so copies cost one entry a task and
hash part. The links are then found among classes:

1. every class is compared with one partner, the one of most shared signatures among each signature's
   first class; what is similar is one component from then on;
2. signatures that still more than ``CROWD`` classes of several components share draw a class each, and every
   class is compared with the drawn one of another component with which it shares most; the signatures of which a tenth
   stands in components that grew by it draw again, in up to ``STARS`` rounds;
3. what signatures still share across components, as these stand by then, is compared whole. A pair has at least the smaller of
   two promised numbers of common signatures. Pairs are counted where signatures are not crowded; what
   crowded ones could add to the count is granted. Of crowded signatures a class keeps those among its
   rarest, as many as leave no pair without a common one; its classes meet block by block, in tasks
   that write no pairs, only links that join components. Classes that hang together by such pairs and
   crowds are compared pair by pair and crowd by crowd, or, where that costs more, all with all, each text sent
   once a block: whichever is cheaper for them (``_planned``), so that neither many crowds of the same
   classes nor a long chain of candidates is paid in full.

Only verified links make components; candidates never do. Checks are exact, on the shingles of the texts
themselves. No cap is set on candidates or partners.

Defined results: a null text, or one without words, has an empty set, links with nothing and is its own
component; fewer words than ``n`` are one shingle; repeated rows and null keys are each reported, null
keys never being a component's smallest; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import drop, lean, maybe_broadcast, table, tuned, width, written
from .graph import components

N = 5
#: The threshold as a fraction of integers: similar when DEN * intersection >= NUM * union.
NUM, DEN = 80, 100
BAND = 1.4
CHUNK = 1024
MEMO = 100_000
SIG_BITS = 40

#: Cost model, in signatures written: of one chance meeting, and how fast meetings fall a shingle of a subset. The
#: weights are those of a corpus of some 1e9 documents; on the test tables (5e4 documents) 10 % of the
#: subsets of one shingle are shared, 7 % of those of three, and 5 % of any length, by true copies.
MEETING_COST, MEETING_DECAY = 60.0, 0.2
MOST_CELLS = 8
SLACK = 1.2
#: A signature that more classes of several components share is crowded; CELL, CELL_SHINGLES: about so many classes and
#: shingles in a block.
CROWD = 48
CELL = 1024
CELL_SHINGLES = 300_000
#: So many pairs that meet in a block cost as much as a text sent there.
MEETS = 128
STARS = 3
#: A further round for so many classes costs more than to compare them whole.
FEW = 1_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_U = np.uint64


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LOWER).split()


def shingles(text: bytes | None, n: int = N) -> set[bytes]:
    """The set itself, for exact checks: words hold no blank, so joining by one is unambiguous."""
    w = words_of(text)
    if not w:
        return set()
    if len(w) < n:
        return {b" ".join(w)}
    return {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Hasher:
    """Sorted distinct 64-bit shingle hashes of a text; MEMO bounds the remembered word hashes."""

    def __init__(self, n: int):
        self.n, self.memo = n, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.empty(0, np.uint64)
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        try:
            h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in words:
                if w not in memo:
                    memo[w] = xxhash.xxh3_64_intdigest(w)
            h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        k = min(self.n, len(words))
        out = np.full(len(words) - k + 1, k, np.uint64)
        for i in range(k):
            out *= _U(0x9E3779B97F4A7C15)
            out += h[i : len(h) - k + 1 + i]
        out = _mix(out)
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


@lru_cache(maxsize=None)
def band_range(band: int) -> tuple[int, int]:
    lo = 1
    for _ in range(band):
        lo = max(lo + 1, int(lo * BAND) + 1)
    return lo, max(lo + 1, int(lo * BAND) + 1) - 1


def band_of(size: int) -> int:
    b = 0
    while band_range(b)[1] < size:
        b += 1
    return b


def most_different(size: int, num: int = NUM, den: int = DEN) -> int:
    """Largest symmetric difference of a similar pair whose larger set has this size."""
    return (2 * size * (den - num)) // (den + num)


@lru_cache(maxsize=None)
def allocation(band: int, num: int = NUM, den: int = DEN) -> tuple[int, int, int, int]:
    """Segments, cells of each, how many segments must be full, and the most differences of a similar pair.

    Sizes of subsets are taken as Poisson. SLACK: segments for each needed one, so that a set may leave out thin ones."""
    lo, hi = band_range(band)
    most = most_different(hi, num, den)
    best = None
    for cells in range(1, MOST_CELLS + 1):
        need = most + 1 if cells == 1 else most // 2 + 1
        segments = math.ceil(SLACK * need) if need > 1 else 1
        subset = lo / segments * ((cells - 1) / cells if cells > 1 else 1)
        cost = segments * cells * (1 + MEETING_COST * math.exp(-(1 - MEETING_DECAY) * subset))
        if best is None or cost < best[0]:
            best = cost, segments, cells, need
    return *best[1:], most


def signatures(h: np.ndarray, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, int]:
    """64-bit signatures of a set in all its bands, and the promised number: any similar set has at least the
    smaller of both sets' numbers in common with it."""
    size = len(h)
    if not size:
        return np.empty(0, np.uint64), 1
    promised = None
    x = _mix(h + _U(0x632BE59BD9B4E019))
    out = []
    for band in range(band_of(size), band_of(size * den // num) + 1):
        m, cells, need, most = allocation(band, num, den)
        cell = (((h >> _U(32)) * _U(m * cells)) >> _U(32)).astype(np.int64)
        n = np.bincount(cell, minlength=m * cells).reshape(m, cells)
        sums = np.zeros(m * cells, np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))  # ascending, as h is
        sums[cell[starts]] = np.add.reduceat(x, starts)
        sums = sums.reshape(m, cells)
        if cells > 1:
            n, sums = n.sum(axis=1, keepdims=True) - n, sums.sum(axis=1, keepdims=True) - sums
        least = np.sort(n.min(axis=1))[::-1]
        q = least[need - 1]
        full = int((least >= q).sum())
        # a difference costs all subsets of its segment but one; a second one in the segment the rest
        common = (cells * full - (cells - 1) * most if most <= full else 2 * full - most) if cells > 1 else full - most
        promised = max(1, common if promised is None else min(promised, common))
        i = np.flatnonzero(n.ravel() >= q)
        out.append(_mix(sums.ravel()[i] + (i.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15) + _U(band * 0xD6E8FEB86659FD93 & (1 << 64) - 1)))
    return np.concatenate(out), promised


def _pack(sig: np.ndarray, doc: np.ndarray, uid: np.ndarray, size: np.ndarray, floor: np.ndarray, press) -> bytes:
    """Signatures in order as differences; the bytes of equal weight stand together."""
    order = np.argsort(sig, kind="stable")
    used, doc = np.unique(doc[order], return_inverse=True)
    d = np.diff(sig[order], prepend=_U(0))
    planes = np.frombuffer(d.astype("<u8").tobytes(), np.uint8).reshape(-1, 8).T[: SIG_BITS // 8]
    head = np.array([len(used), len(d)], "<u4").tobytes()
    return press.compress(head + uid[used].tobytes() + size[used].astype("<u4").tobytes() + floor[used].astype("<u4").tobytes() + planes.tobytes() + doc.astype("<u2").tobytes())


def _unpack(raw: bytes) -> tuple[np.ndarray, ...]:
    docs, n = (int(x) for x in np.frombuffer(raw, "<u4", 2))
    uid = np.frombuffer(raw, _UID, docs, 8)
    size = np.frombuffer(raw, "<u4", docs, 8 + 16 * docs)
    floor = np.frombuffer(raw, "<u4", docs, 8 + 20 * docs)
    at = 8 + 24 * docs
    planes = np.zeros((8, n), np.uint8)
    planes[: SIG_BITS // 8] = np.frombuffer(raw, np.uint8, n * (SIG_BITS // 8), at).reshape(-1, n)
    sig = np.cumsum(np.frombuffer(planes.T.tobytes(), "<u8"), dtype=np.uint64)
    doc = np.frombuffer(raw, "<u2", n, at + n * (SIG_BITS // 8))
    return sig, doc.copy(), uid.copy(), size.copy(), floor.copy()  # not the whole of raw with them


#: A class: the 128-bit hash of its set, in two halves; big-endian, so that they sort as their bytes do.
_UID = np.dtype([("high", ">u8"), ("low", ">u8")])


def _uid(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def _binary(raw: np.ndarray) -> pa.Array:
    """16-byte records, in any byte order, as an Arrow binary column."""
    n = len(raw)
    at = np.arange(0, 16 * (n + 1), 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(raw.astype(_UID).tobytes())])


def _mark(text: str) -> Column:
    """A text's hash: with the key, which may be null, it finds a row again."""
    return F.xxhash64(F.col(text).cast("binary"))


def _signed(docs: DataFrame, key: str, text: str, n: int, num: int, den: int) -> DataFrame:
    """One pass over the texts. Rows of kind 0: key, mark (the text's hash), uid (the set's hash; null: empty set) and
    n_shingles of every document; of kind 1: entries (sig, uid, n_shingles, floor, and uid, size and floor of the
    signature's first class) of signatures that two sets share."""
    parts = width(docs)
    kind = docs.schema[key].dataType

    def sign(batches):
        hasher, press = Hasher(n), zstandard.ZstdCompressor(1)
        held: list[tuple[bytes, np.ndarray, int, int]] = []
        known: set[bytes] = set()
        turn = 0

        def flush():
            sig = np.concatenate([x[1] for x in held])
            doc = np.repeat(np.arange(len(held)), [len(x[1]) for x in held])
            uid = np.frombuffer(b"".join(x[0] for x in held), _UID)
            size, floor = (np.array([x[k] for x in held], np.uint32) for k in (2, 3))
            held.clear()
            known.clear()
            part = (sig % _U(parts)).astype(np.int32)
            sig = (sig // _U(parts)) & _U((1 << SIG_BITS) - 1)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            out = [(p, _pack(sig[o], doc[o], uid, size, floor, press)) for p in range(parts) if len(o := order[ends[p] : ends[p + 1]])]
            k = len(out)
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([1] * k, pa.int8()), pa.nulls(k, key_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), pa.array([x for _, x in out], pa.binary())], names=names)

        names = ["part", "kind", "key", "mark", "uid", "n_shingles", "blob"]
        key_type = None
        waiting = 0
        for b in batches:
            key_type = b.column(1).type
            uids, counts = [], []
            for t in b.column(0):
                h = hasher(t.as_py())
                counts.append(len(h))
                if not len(h):
                    uids.append(None)
                    continue
                uid = _uid(h)
                uids.append(uid)
                if uid in known:
                    continue
                known.add(uid)
                sig, floor = signatures(h, num, den)
                held.append((uid, sig, len(h), floor))
                waiting += len(sig)
                if len(held) == CHUNK or waiting > 1 << 20:
                    yield flush()
                    waiting = 0
            k = len(uids)
            yield pa.RecordBatch.from_arrays([pa.array((np.arange(k) + turn) % parts, pa.int32()), pa.array([0] * k, pa.int8()), b.column(1), b.column(2), pa.array(uids, pa.binary()), pa.array(counts, pa.int64()), pa.nulls(k, pa.binary())], names=names)
            turn += k
        if held:
            yield flush()

    def share(batches):
        unpress = zstandard.ZstdDecompressor()
        names = ["kind", "key", "mark", "uid", "n_shingles", "floor", "sig", "b_uid", "b_n", "b_floor"]
        got: list = []
        at = None
        key_type = None

        def entries():
            # What no other signature equals goes first: it needs only the signatures themselves.
            sigs = np.concatenate([x[0] for x in got])
            order = np.argsort(sigs, kind="stable")
            ranked = sigs[order]
            same = ranked[1:] == ranked[:-1]
            keep = np.zeros(len(sigs), bool)
            keep[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            del order, ranked, same
            sig = sigs[keep]
            ends = np.cumsum([len(x[0]) for x in got])
            picked = [keep[e - len(x[0]) : e] for x, e in zip(got, ends, strict=True)]
            uid, size, floor = (np.concatenate([x[k][x[1][p]] for x, p in zip(got, picked, strict=True)]) for k in (2, 3, 4))
            got.clear()
            order = np.lexsort((uid["low"], uid["high"], sig))
            sig, uid, size, floor = sig[order], uid[order], size[order].astype("i8"), floor[order].astype("i8")
            new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (uid[1:] != uid[:-1])])[: len(sig)]
            sig, uid, size, floor = sig[new], uid[new], size[new], floor[new]
            first = np.concatenate([[True], sig[1:] != sig[:-1]])[: len(sig)]
            run = np.cumsum(first) - 1
            many = np.flatnonzero(np.bincount(run)[run] > 1) if len(run) else run
            # each class meets the signature's first class, which itself meets the second
            other = np.flatnonzero(first)[run] + first if len(run) else run
            for a in range(0, len(many), 20_000):
                r = many[a : a + 20_000]
                o = other[r]
                k = len(r)
                yield pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int8()), pa.nulls(k, key_type), pa.nulls(k, pa.int64()), _binary(uid[r]), pa.array(size[r]), pa.array(floor[r]), pa.array((np.int64(at) << 40) + sig[r].astype("i8")), _binary(uid[o]), pa.array(size[o]), pa.array(floor[o])], names=names)

        for b in batches:
            key_type = b.column(2).type
            plain = b.filter(pc.equal(b.column(1), 0))
            if plain.num_rows:
                k = plain.num_rows
                nulls = pa.nulls(k, pa.int64())
                yield pa.RecordBatch.from_arrays([plain.column(1), plain.column(2), plain.column(3), plain.column(4), plain.column(5), nulls, nulls, pa.nulls(k, pa.binary()), nulls, nulls], names=names)
            packed = b.filter(pc.equal(b.column(1), 1))
            for p, blob in zip(packed.column(0).to_pylist(), packed.column(6), strict=True):
                if p != at and got:
                    yield from entries()
                    got.clear()
                at = p
                got.append(_unpack(unpress.decompress(blob.as_py())))
        if got:
            yield from entries()

    k = kind.simpleString()
    source = docs.select(F.col(text).cast("binary").alias("_text"), F.col(key).alias("_key"), _mark(text).alias("_mark"))
    packed = source.mapInArrow(lean(sign), f"part int, kind byte, key {k}, mark long, uid binary, n_shingles long, blob binary")
    return packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(lean(share), f"kind byte, key {k}, mark long, uid binary, n_shingles long, floor long, sig long, b_uid binary, b_n long, b_floor long")


def _texts(wanted: DataFrame, members: DataFrame, docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """uid, text: the text of one document of each wanted class (uid)."""
    one = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "mark")).alias("one")
    chosen = members.join(wanted, "uid", "left_semi").groupBy("uid").agg(one)
    chosen = written(chosen.select("uid", F.col("one.key").alias("_key"), F.col("one.mark").alias("_mark")), "join-wanted")
    few = maybe_broadcast(chosen, chosen.count(), 40)
    rows = docs.select(F.col(key).alias("_key"), _mark(text).alias("_mark"), F.col(text).cast("binary").alias("_text"))
    # of documents with the same key and mark the one whose text has the class's set is taken
    texts = rows.join(few, (rows["_mark"] == few["_mark"]) & rows["_key"].eqNullSafe(few["_key"]))

    def own(batches):
        hasher = Hasher(n)
        for b in batches:
            keep = []
            for uid, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                keep.append(_uid(hasher(t.as_py())) == uid)
            yield b.filter(pa.array(keep, pa.bool_()))

    return texts.select("uid", F.col("_text").alias("text")).mapInArrow(lean(own), "uid binary, text binary").dropDuplicates(["uid"])


def _bridges(ids: list[bytes], labels: list[bytes], texts: list[bytes], side: np.ndarray, n: int, num: int, den: int) -> list[tuple[bytes, bytes]]:
    """Links between the components (labels) of one cell's classes: enough of them to join what is linked.
    side: 0 and 1 are two blocks, which meet; all 2 is one block, which meets itself."""
    hasher = Hasher(n)
    sets = [hasher(t) for t in texts]
    sizes = np.array([len(x) for x in sets])
    root = {x: x for x in labels}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    index = np.flatnonzero(side != 1)
    h = np.concatenate([sets[i] for i in index])
    owner = np.repeat(np.arange(len(index)), sizes[index])
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    known: dict[int, set[bytes]] = {}
    out = []
    for j in np.flatnonzero(side != 0):
        lo, hi = np.searchsorted(h, sets[j], "left"), np.searchsorted(h, sets[j], "right")
        width_ = hi - lo
        at = np.repeat(lo - np.cumsum(width_) + width_, width_) + np.arange(int(width_.sum()))
        common = np.bincount(owner[at], minlength=len(index))
        for k in np.flatnonzero(den * common >= num * (sizes[index] + sizes[j] - common)):
            i = int(index[k])
            if find(labels[i]) == find(labels[j]):
                continue
            mine, other = (known.setdefault(x, shingles(texts[x], n)) for x in (i, j))
            both = len(mine & other)
            if den * both >= num * (len(mine) + len(other) - both):
                root[find(labels[i])] = find(labels[j])
                out.append((ids[i], ids[j]))
    return out


def _verified(pairs: DataFrame, texts: DataFrame, parts: int, n: int, num: int, den: int) -> DataFrame:
    """The similar ones of pairs a, b (distinct, written). texts: uid, text of all their classes (written).

    A class that many others meet (b) is dealt to blocks of about CELL partners, so that no task holds more than its text
    and one partner's. Each pair costs one text, each block one more."""
    blocks = written(pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(CELL)).cast("int").alias("blocks")), "join-blocks")
    few = maybe_broadcast(blocks, blocks.count(), 32)
    own = pairs.join(few, "b").select("b", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"), F.col("a").alias("uid"), F.lit(1).alias("side"))
    hubs = blocks.select("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("b").alias("uid"), F.lit(0).alias("side"))
    sent = own.unionByName(hubs).join(texts, "uid").select("b", "block", "side", "uid", "text")

    def judge(batches):
        hasher, hub, mine, exact = Hasher(n), None, None, None
        for b in batches:
            left, right = [], []
            for u, _, side, v, t in zip(*(c.to_pylist() if i < 4 else c for i, c in enumerate(b.columns)), strict=True):
                t = t.as_py()
                if not side:
                    hub, mine, exact, whole = u, hasher(t), None, t
                    continue
                if u != hub:
                    raise RuntimeError("a pair's text is missing")
                h = hasher(t)
                both = len(np.intersect1d(mine, h, assume_unique=True))
                if den * both < num * (len(mine) + len(h) - both):
                    continue
                exact = exact or shingles(whole, n)
                other = shingles(t, n)
                both = len(exact & other)
                if den * both >= num * (len(exact) + len(other) - both):
                    left.append(u)
                    right.append(v)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    dealt = sent.repartition(parts, "b", "block").sortWithinPartitions("b", "block", "side")
    return dealt.mapInArrow(lean(judge), "a binary, b binary")


def _met(crowds: DataFrame, members: DataFrame, docs: DataFrame, key: str, text: str, n: int, num: int, den: int) -> DataFrame:
    """a, b: links among the classes (uid, n, and their component's label) of each crowd (sig), enough of them to join
    what is linked.

    A crowd is dealt to blocks of about CELL classes or CELL_SHINGLES shingles by hash, and every two blocks meet in a
    task of their own, by an index of their shingles. So no task holds more than two blocks, and no pairs are written."""
    blocks = crowds.groupBy("sig").agg(F.ceil(F.greatest(F.count("*") / F.lit(CELL), F.sum("n") / F.lit(CELL_SHINGLES))).cast("int").alias("blocks"))
    placed = crowds.join(blocks, "sig").select("uid", "sig", "label", "blocks", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int").alias("block"))
    texts = _texts(placed.select("uid").distinct(), members, docs, key, text, n)
    sent = placed.join(texts, "uid").select("sig", "uid", "label", "text", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = sent.select("sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"), "uid", "label", "text")

    def meet(batches):
        cell, rows = None, []

        def judged():
            ids, labels, texts_, side = [r[4] for r in rows], [r[5] for r in rows], [r[6] for r in rows], np.array([r[3] for r in rows])
            got = _bridges(ids, labels, texts_, side, n, num, den) if len(set(labels)) > 1 and ((side != 1).any() and (side != 0).any()) else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.binary()), pa.array([y for _, y in got], pa.binary())], names=["a", "b"])

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[:3] != cell and rows:
                    yield judged()
                    rows.clear()
                cell = r[:3]
                rows.append(r)
        if rows:
            yield judged()

    dealt = cells.repartition(width(docs), "sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return dealt.mapInArrow(lean(meet), "a binary, b binary")


def _enough(num: int, den: int) -> Column:
    """A pair's sizes allow similarity, and it has as many common signatures (c) as were promised."""
    return (den * F.least("n", "b_n") >= num * F.greatest("n", "b_n")) & (F.col("c") >= F.least("floor", "b_floor"))


def _best(met: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: of each class (b), the met class (a) of most common signatures; each pair once."""
    counted = met.groupBy("uid", "n", "floor", "b_uid", "b_n", "b_floor").agg(F.count("*").alias("c")).where(_enough(num, den))
    best = counted.groupBy(F.col("uid").alias("a")).agg(F.max_by("b_uid", F.struct("c", "b_uid")).alias("b"))
    # of two that chose each other one pair is enough
    return best.select("a", "b", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).groupBy("x", "y").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")


def _mixed(entries: DataFrame, label: DataFrame) -> DataFrame:
    """Entries of signatures that more than one component has, with their component (label) and the number of the
    signature's entries (crowd)."""
    named = label.select(F.col("node").alias("uid"), "label")
    labelled = entries.select("uid", "n", "floor", "sig").join(maybe_broadcast(named, label.count(), 48), "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    # labels differ if one of two hashes does: longs, unlike bytes, are aggregated by hash
    x, y = F.xxhash64("label"), F.xxhash64(F.lit(1), "label")
    several = labelled.groupBy("sig").agg(F.min(x).alias("a"), F.max(x).alias("b"), F.min(y).alias("c"), F.max(y).alias("d"), F.count("*").alias("crowd")).where("a < b or c < d").select("sig", "crowd")
    return written(labelled.join(several, "sig"), "join-mixed")


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (node, label) after further links, which are drawn between components: the label stands for its nodes."""
    to = label.select(F.col("node").alias("a"), F.col("label").alias("x"))
    ends = links.join(to, "a", "left").join(to.select(F.col("a").alias("b"), F.col("x").alias("y")), "b", "left")
    up = written(components(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))), "join-raised")
    raised = label.join(up.select(F.col("node").alias("label"), F.col("label").alias("up")), "label", "left")
    out = raised.select("node", F.coalesce("up", "label").alias("label")).unionByName(up.join(label, "node", "left_anti"))
    return written(out, "join-labels")


def _labelled(rows: DataFrame, label: DataFrame, uid: str = "uid", name: str = "label") -> DataFrame:
    """Rows with the component of their class (uid) as it stands now."""
    to = label.select(F.col("node").alias(uid), F.col("label").alias(name))
    return rows.drop(name).join(maybe_broadcast(to, label.count(), 48), uid, "left").withColumn(name, F.coalesce(name, uid))


def _several(crowds: DataFrame, label: DataFrame, grown: DataFrame | None = None) -> DataFrame:
    """sig, uid, n, label of the signatures that several components still have, with the labels as they stand now; with
    ``grown`` (label), only of those that at least a tenth of their entries' components are among."""
    rows = _labelled(crowds.select("sig", "uid", "n"), label).withColumn("grown", F.lit(1))
    if grown is not None:
        few = maybe_broadcast(grown.select("label", F.lit(1).alias("grown")), grown.count(), 32)
        rows = rows.drop("grown").join(few, "label", "left")
    rows = written(rows, "join-relabelled")
    x, y = F.xxhash64("label"), F.xxhash64(F.lit(1), "label")
    met = rows.groupBy("sig").agg(F.min(x).alias("a"), F.max(x).alias("b"), F.min(y).alias("c"), F.max(y).alias("d"), F.count("*").alias("all"), F.count("grown").alias("grown"))
    return rows.join(met.where("(a < b or c < d) and 10 * grown >= all").select("sig"), "sig", "left_semi").select("sig", "uid", "n", "label")


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (a, b) whose components still differ."""
    return _labelled(_labelled(pairs, label, "a", "x"), label, "b", "y").where("x <> y").select("a", "b")


def _drawn(hot: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """a, b: each class with the class of another component that its signatures drew, the one of most common ones."""
    drawn = hot.groupBy("sig").agg(F.min_by(F.struct("uid", "n", "label"), F.xxhash64("uid", F.lit(turn))).alias("d"))
    met = hot.join(drawn, "sig").where(F.col("label") != F.col("d.label"))
    return _best(met.select("uid", "n", F.lit(0).alias("floor"), F.col("d.uid").alias("b_uid"), F.col("d.n").alias("b_n"), F.lit(0).alias("b_floor")), num, den)


def _rarest(mixed: DataFrame) -> DataFrame:
    """Of classes with crowded signatures their rarest ones, all but one less than the common ones that any partner has."""
    sizes = mixed.groupBy("sig").agg(F.min("floor").alias("low"))
    able = mixed.where(F.col("crowd") > CROWD).select("uid").distinct()
    rows = mixed.join(able, "uid", "left_semi").join(sizes, "sig")
    own = W.partitionBy("uid")
    rows = rows.withColumns({"c": F.count("*").over(own), "t": F.least(F.min("low").over(own), F.col("floor")), "r": F.row_number().over(own.orderBy("crowd", "sig"))})
    return rows.where((F.col("r") <= F.col("c") - F.col("t") + 1) & (F.col("crowd") > CROWD)).select("sig", "uid", "n", "label")


def _pairs(mixed: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: pairs of different components with enough common signatures, if those that are crowded (h of a class) are
    taken as common."""
    few = mixed.where(F.col("crowd") <= CROWD)
    crowded = mixed.where(F.col("crowd") > CROWD).groupBy("uid").agg(F.count("*").alias("h"))
    few = few.join(crowded, "uid", "left").withColumn("h", F.coalesce("h", F.lit(0)))
    r = few.select("sig", "uid", "n", "floor", "label", "h")
    s = few.select("sig", *[F.col(c).alias(f"b_{c}") for c in ("uid", "n", "floor", "label", "h")])
    near = (r["sig"] == s["sig"]) & (F.col("label") < F.col("b_label")) & (den * F.least("n", "b_n") >= num * F.greatest("n", "b_n"))
    counted = r.join(s, near).groupBy("uid", "b_uid").agg(F.count("*").alias("c"), F.first(F.least("floor", "b_floor")).alias("floor"), F.first(F.least("h", "b_h")).alias("h"))
    return counted.where("c + h >= floor").select(F.col("uid").alias("a"), F.col("b_uid").alias("b"))


def _planned(pairs: DataFrame, hot: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs to compare one by one, crowds to compare whole): the cheaper way for each group that hangs together.

    Costs are texts sent, and a share of one for every two classes that meet in a block. sizes: uid, n, label."""
    ties = pairs.unionByName(hot.select(F.col("uid").alias("a"), F.min("uid").over(W.partitionBy("sig")).alias("b")).where("a <> b"))
    group = written(components(ties).select(F.col("node").alias("uid"), F.col("label").alias("group")), "join-groups")

    def cost(rows: DataFrame, by: str) -> DataFrame:
        k, blocks = F.count("*"), F.ceil(F.greatest(F.count("*") / F.lit(CELL), F.sum("n") / F.lit(CELL_SHINGLES)))
        return rows.groupBy(by).agg((k * blocks + k * k / F.lit(MEETS)).alias("cost"))

    named = group.join(sizes, "uid")
    whole = cost(named, "group").select("group", F.col("cost").alias("whole"))
    crowds = cost(hot, "sig").join(hot.groupBy("sig").agg(F.min("uid").alias("uid")), "sig").join(group, "uid").select("sig", "group", "cost")
    placed = pairs.join(group.withColumnRenamed("uid", "a"), "a")
    apart = crowds.select("group", "cost").unionByName(placed.select("group", F.lit(1.0).alias("cost"))).groupBy("group").agg(F.sum("cost").alias("apart"))
    plan = written(whole.join(apart, "group").select("group", (F.col("whole") < F.col("apart")).alias("all")), "join-plan")
    pairs = placed.join(plan.where("not all"), "group", "left_semi").select("a", "b")
    left = hot.join(crowds.join(plan.where("not all"), "group", "left_semi").select("sig"), "sig", "left_semi")
    together = named.join(plan.where("all"), "group", "left_semi").select(F.xxhash64("group").alias("sig"), "uid", "n", "label")
    return pairs, left.select("sig", "uid", "n", "label").unionByName(together)


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """key, n_shingles, class_id (hash of the set), component_id (smallest key reachable by links)."""
    tuned(docs.sparkSession)
    all_rows = written(_signed(docs, key, text, n, num, den), "join-signed")
    members = all_rows.where("kind = 0").select("key", "mark", "uid", "n_shingles")
    entries = all_rows.where("kind = 1").select("uid", F.col("n_shingles").alias("n"), "floor", "sig", "b_uid", "b_n", "b_floor")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "join-pairs")
        ends = pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))).distinct()
        texts = written(_texts(ends, members, docs, key, text, n), "join-texts")
        found = written(_verified(pairs, texts, width(docs), n, num, den), "join-links")
        drop(pairs, texts)
        return found

    label = written(components(verified(_best(entries, num, den))), "join-labels")
    mixed = _mixed(entries, label)
    hot, found, held = mixed.where(F.col("crowd") > CROWD), 0, 0
    for turn in range(STARS):
        left = hot.select("uid").distinct().count()
        if left <= (FEW if turn else 0):
            break
        held = held or left
        more = verified(_drawn(hot, turn, num, den))
        now = more.count()
        if not now:
            break
        found += now
        label = _joined(label, more)
        grown = written(_labelled(more.select(F.col("a").alias("uid")), label).select("label").distinct(), "join-grown")
        # a few crowds of near copies among many others are no reason to draw again from all
        hot = written(_several(hot, label, grown), "join-hot")
    if found * 10 >= max(held, 1):
        mixed = _mixed(mixed, label)

    # what several components still share, whole
    pairs, hot, sizes = _pairs(mixed, num, den), _rarest(mixed), mixed.select("uid", "n", "label").distinct()
    if 0 < found * 10 < held:  # mixed has the labels from before
        pairs, hot, sizes = _apart(pairs, label), _several(hot, label), _labelled(sizes, label).select("uid", "n", "label")
    pairs, hot = written(pairs, "join-pairs"), written(hot, "join-crowds")
    pairs, crowds = _planned(pairs, hot, sizes)
    more = verified(pairs)
    more = more.unionByName(written(_met(written(crowds, "join-crowds"), members, docs, key, text, n, num, den), "join-links"))
    if more.head(1):
        label = _joined(label, more)

    classes = members.where("uid is not null").groupBy("uid").agg(F.min("key").alias("low"))
    classes = classes.join(label.select(F.col("node").alias("uid"), "label"), "uid", "left").select("uid", "low", F.coalesce("label", "uid").alias("label"))
    low = classes.groupBy("label").agg(F.min("low").alias("component_id"))
    found = classes.join(low, "label").select("uid", "component_id")
    return members.join(found, "uid", "left").select(F.col("key").alias(key), "n_shingles", F.col("uid").alias("class_id"), F.coalesce("component_id", "key").alias("component_id"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN z zx ON zx.doc_id = x JOIN z zy ON zy.doc_id = y WHERE 100 * c >= 80 * (zx.n + zy.n - c)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM d JOIN r ON r.doc_id = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id GROUP BY d.doc_id, z.n
"""
