"""Token-id output: raw id shards plus a minimal perfect hash index for keyed access.

Files in one folder of a store that Spark's cluster shares (any URI pyarrow.fs reads):

* ``shard-NNNNN.bin``: ``DLTK``, u16 version, u16 bytes per id, then raw little-endian ids. Documents
  stand in ascending key order within and across shards, each closed by ``end_id``.
* ``index-NNNNN.bin``: a minimal perfect hash over the keys whose first hash falls in this bucket:
  per level a bit array and its ranks, then for each slot a 32-bit fingerprint (from an independent
  hash), shard, offset and length. A lookup reads one bit per level (about 1.6 on average) and one slot.

The key of a document is (key column, occurrence): repeated keys are stored one after the other and
numbered 0, 1, ..., so every row is kept and can be reached. A null key is a key of its own and sorts
first. Null text is the empty text: the end id alone. An empty table gives no shard and no rows.
Every shard and index file is written to an attempt's own name and renamed, so a task that is run
again, or twice, leaves the same file.
"""

from __future__ import annotations

import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, qualified, scratch, table, width, written

MAGIC, INDEX_MAGIC, VERSION = b"DLTK", b"DLIX", 1
HEAD = 8
GAMMA = 2.0
LEVELS = 64


def byte_ranks(tokenizer_json: str) -> dict[bytes, int] | None:
    """The vocabulary as merge ranks, if the file is plain byte-level BPE whose ids are in merge order (then
    tiktoken, given these ranks and the same split pattern, has the same ids); else None."""
    t = json.loads(tokenizer_json)
    pre, model = t.get("pre_tokenizer") or {}, t["model"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not t.get("normalizer")
    if not plain or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in printable]
    byte = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(rest)}
    special = {a["content"] for a in t.get("added_tokens", [])}
    vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [vocab.get(x + y) for x, y in merges]
    if made != sorted(x for x in made if x is not None) or any(not set(w) <= byte.keys() for w in vocab if w not in special):
        return None
    return {bytes(byte[c] for c in w): i for w, i in vocab.items() if w not in special}


#: The split pattern of byte-level BPE (public, of the first tokenizer of this kind).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Ids of whole texts, as the tokenizers library gives them (add_special_tokens=False). Where the file
    is plain byte-level BPE the same vocabulary runs in tiktoken, about four times as fast; texts that
    hold an added token's string, and any other file, go through the tokenizers library itself."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads also each keep memory
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(tokenizer_json)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.kind = "<u2" if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.added = [a.content for a in self.tok.get_added_tokens_decoder().values()]
        ranks, self.fast = byte_ranks(tokenizer_json), None
        if ranks is not None:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.fast is not None and not any(a in text for a in self.added):
            return np.array(self.fast.encode_ordinary(text), self.kind).tobytes()
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes()


def key_hashes(keys: list, occurrences: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each (key, occurrence)."""
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(f"{k!r}\x00{n}") for k, n in zip(keys, occurrences, strict=True)), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _slot_hash(h: np.ndarray, level: int) -> np.ndarray:
    x = h ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit hashes: a cascade of bit arrays; a key's slot is the rank
    of its bit. Hashes that no level separates (equal ones) are ``left`` to an exact list."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            self.ranks.append(total + np.concatenate([[0], np.cumsum(bits, dtype=np.int64)]))
            total += int(bits.sum())
        self.n = total

    @classmethod
    def build(cls, h: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        levels, rest = [], np.arange(len(h))
        for level in range(LEVELS):
            if not len(rest):
                break
            size = max(2, int(GAMMA * len(rest)))
            at = (_slot_hash(h[rest], level) % np.uint64(size)).astype(np.int64)
            count = np.bincount(at, minlength=size)
            levels.append(count == 1)
            rest = rest[count[at] != 1]
        return cls(levels), rest

    def slots(self, h: np.ndarray) -> np.ndarray:
        """-1 where no level holds the key."""
        out, rest = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = (_slot_hash(h[rest], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[rest[hit]] = ranks[at[hit]]
            rest = rest[~hit]
        return out

    def dump(self) -> bytes:
        return struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<Q", len(b)) + np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def load(cls, raw: bytes, at: int) -> tuple[PerfectHash, int]:
        (n,), at, levels = struct.unpack_from("<I", raw, at), at + 4, []
        for _ in range(n):
            (size,), at = struct.unpack_from("<Q", raw, at), at + 8
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, -(-size // 8), at), count=size).astype(bool))
            at += -(-size // 8)
        return cls(levels), at


#: Of a slot, and of the exact list for hashes that no level separates.
SLOT = np.dtype([("finger", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("length", "<u8")])
EXACT = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("shard", "<u4"), ("offset", "<u8"), ("length", "<u8")])


def dump_index(h1, h2, shard, offset, length) -> bytes:
    mph, left = PerfectHash.build(h1)
    slots, keyed = np.zeros(mph.n, SLOT), np.setdiff1d(np.arange(len(h1)), left)
    at = mph.slots(h1[keyed])
    for name, x in (("finger", h2 & np.uint64(0xFFFFFFFF)), ("shard", shard), ("offset", offset), ("length", length)):
        slots[name][at] = x[keyed]
    exact = np.zeros(len(left), EXACT)
    for name, x in (("h1", h1), ("h2", h2), ("shard", shard), ("offset", offset), ("length", length)):
        exact[name] = x[left]
    return INDEX_MAGIC + struct.pack("<HHQQ", VERSION, 0, len(slots), len(exact)) + mph.dump() + slots.tobytes() + exact.tobytes()


def lookup(raw: bytes, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Slots of the keys; length is -1 (as unsigned) where the fingerprint says that a key is not there."""
    _, _, n, m = struct.unpack_from("<HHQQ", raw, 4)
    mph, at = PerfectHash.load(raw, 24)
    slots = np.frombuffer(raw, SLOT, n, at)
    exact = np.frombuffer(raw, EXACT, m, at + n * SLOT.itemsize)
    out = np.zeros(len(h1), SLOT)
    out["length"] = np.uint64(2**64 - 1)
    where = mph.slots(h1)
    ok = np.flatnonzero(where >= 0)
    ok = ok[slots["finger"][where[ok]] == (h2[ok] & np.uint64(0xFFFFFFFF)).astype(np.uint32)]
    out[ok] = slots[where[ok]]
    for x in exact:
        for i in np.flatnonzero((h1 == x["h1"]) & (h2 == x["h2"])):
            out[i] = (h2[i] & np.uint64(0xFFFFFFFF), x["shard"], x["offset"], x["length"])
    return out


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def _put(uri: str, name: str, parts) -> None:
    """Write under the attempt's own name, then rename."""
    fs, root = _open(uri)
    ctx = TaskContext.get()
    own = f"{root}/.{name}.{ctx.taskAttemptId() if ctx else 0}"
    with fs.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
    fs.move(own, f"{root}/{name}")


def read_file(uri: str, name: str, at: int = 0, size: int | None = None) -> bytes:
    fs, root = _open(uri)
    with fs.open_input_file(f"{root}/{name}") as f:
        return f.read_at(size if size is not None else f.size() - at, at)


class TokenStore:
    """A written store: its folder, its number of index buckets, and where each shard starts."""

    def __init__(self, uri: str, buckets: int, starts: dict[int, int], directory: DataFrame):
        self.uri, self.buckets, self.starts, self.directory = uri, buckets, starts, directory

    @classmethod
    def write(cls, docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = 0, uri: str | None = None) -> TokenStore:
        spark = docs.sparkSession
        uri = qualified(spark, uri or scratch(spark, "tokens"))
        fs, root = _open(uri)
        fs.create_dir(root, recursive=True)
        tokenizer = spark.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())
        n = width(docs)

        def write_shard(batches):
            shard = TaskContext.get().partitionId()
            enc = None
            log: list[pa.RecordBatch] = []
            state = {"at": 0, "last": None, "n": 0}

            def parts():
                nonlocal enc
                for b in batches:
                    if enc is None:
                        enc = Encoder(tokenizer.value)
                        yield MAGIC + struct.pack("<HH", VERSION, np.dtype(enc.kind).itemsize)
                    end = np.array([end_id], enc.kind).tobytes()
                    wide = len(end)
                    for i in range(0, b.num_rows, 256):
                        keys, texts = b.column(0).slice(i, 256).to_pylist(), b.column(1).slice(i, 256).to_pylist()
                        offset, length, occurrence = [], [], []
                        for k, raw in zip(keys, (enc(t or "") for t in texts), strict=True):
                            state["n"] = state["n"] + 1 if state["last"] == (k,) else 0
                            state["last"] = (k,)
                            offset.append(state["at"])
                            length.append(len(raw) // wide + 1)
                            occurrence.append(state["n"])
                            state["at"] += length[-1]
                            yield raw + end
                        h1, h2 = key_hashes(keys, occurrence)
                        log.append(pa.RecordBatch.from_arrays([b.column(0).slice(i, 256), pa.array(occurrence, pa.int64()), pa.array(h1.view("<i8")), pa.array(h2.view("<i8")), pa.array([shard] * len(length), pa.int32()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names=["key", "occurrence", "h1", "h2", "shard", "offset", "length"]))

            stream = parts()
            first = next(stream, None)
            if first is not None:
                _put(uri, f"shard-{shard:05d}.bin", (x for part in ([first], stream) for x in part))
            yield from log

        kind = docs.schema[key].dataType.simpleString()
        rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).repartitionByRange(n, "key").sortWithinPartitions("key", "text")
        directory = written(rows.mapInArrow(lean(write_shard), f"key {kind}, occurrence long, h1 long, h2 long, shard int, offset long, length long"), "token-directory")
        starts, at = {}, 0
        for r in directory.groupBy("shard").agg(F.sum("length").alias("n")).orderBy("shard").collect():  # one row a shard
            starts[r["shard"]], at = at, at + r["n"]

        def write_index(pdf):
            b = int(pdf["bucket"].iloc[0])
            u = lambda c, k="<u8": pdf[c].to_numpy().astype("<i8").view("<u8").astype(k)
            _put(uri, f"index-{b:05d}.bin", [dump_index(u("h1"), u("h2"), u("shard", "<u4"), u("offset"), u("length"))])
            return pdf[["bucket"]].iloc[:1]

        entries = directory.select(F.pmod("h1", F.lit(n)).cast("int").alias("bucket"), "h1", "h2", "shard", "offset", "length")
        entries.groupBy("bucket").applyInPandas(write_index, "bucket int").agg(F.count("*")).collect()
        return cls(uri, n, starts, directory)

    def locate(self, keys: DataFrame) -> DataFrame:
        """keys: key, occurrence, h1, h2. Adds shard, offset and length; keys that are not there are left out."""
        uri = self.uri
        n = self.buckets

        def find(pdf):
            u = lambda c: pdf[c].to_numpy().astype("<i8").view("<u8")
            found = lookup(read_file(uri, f"index-{int(pdf['bucket'].iloc[0]):05d}.bin"), u("h1"), u("h2"))
            out = pdf[["key", "occurrence"]].copy()
            out["shard"] = found["shard"].astype("i4")
            out["offset"] = found["offset"].astype("i8")
            out["length"] = found["length"].view("<i8")
            return out[out["length"] >= 0]

        kind = keys.schema["key"].dataType.simpleString()
        return keys.select(F.pmod("h1", F.lit(n)).cast("int").alias("bucket"), "key", "occurrence", "h1", "h2").groupBy("bucket").applyInPandas(find, f"key {kind}, occurrence long, shard int, offset long, length long")

    def read(self, located: DataFrame, digest=None, column: str = "ids array<int>") -> DataFrame:
        """Raw payloads of located keys, each shard read in runs of neighbouring documents. ``digest``
        turns a document's ids (numpy, unsigned 32 bit) into the value of ``column``."""
        uri, starts = self.uri, self.starts
        digest = digest or (lambda ids: ids.astype("i4").tolist())
        kind = located.schema["key"].dataType.simpleString()
        name = column.split()[0]

        def load(batches):
            files: dict[int, tuple] = {}
            for b in batches:
                pdf = b.to_pandas()
                values = []
                for shard, offset, length in zip(pdf["shard"], pdf["offset"], pdf["length"], strict=True):
                    if shard not in files:
                        for f, _ in files.values():
                            f.close()
                        files.clear()
                        fs, root = _open(uri)
                        f = fs.open_input_file(f"{root}/shard-{shard:05d}.bin")
                        magic, _, wide = struct.unpack("<4sHH", f.read_at(HEAD, 0))
                        if magic != MAGIC:
                            raise ValueError(f"shard {shard} is no token shard")
                        files[shard] = (f, wide)
                    f, wide = files[shard]
                    raw = f.read_at(int(length) * wide, HEAD + int(offset) * wide)
                    values.append(digest(np.frombuffer(raw, f"<u{wide}").astype("<u4")))
                pdf["start"] = [starts[s] + o for s, o in zip(pdf["shard"], pdf["offset"], strict=True)]
                pdf[name] = values
                yield pa.RecordBatch.from_pandas(pdf[["key", "occurrence", "start", "length", name]], schema=pa.schema([("key", b.schema.field("key").type), ("occurrence", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), (name, out_type)]), preserve_index=False)

        from pyspark.sql.pandas.types import to_arrow_type
        from pyspark.sql.types import StructType

        out_type = to_arrow_type(StructType.fromDDL(column)[0].dataType)
        return located.repartitionByRange(width(located), "shard", "offset").sortWithinPartitions("shard", "offset").mapInArrow(lean(load), f"key {kind}, occurrence long, start long, length long, {column}")

    def get(self, keys: list) -> dict:
        """Keyed access from the driver: ids of a few keys (their first occurrence); absent keys are left out."""
        h1, h2 = key_hashes(keys, [0] * len(keys))
        out = {}
        for b in {int(x) for x in (h1.view("<i8") % self.buckets)}:
            at = np.flatnonzero(h1.view("<i8") % self.buckets == b)
            try:
                found = lookup(read_file(self.uri, f"index-{b:05d}.bin"), h1[at], h2[at])
            except FileNotFoundError:
                continue
            for i, x in zip(at, found, strict=True):
                if int(x["length"]) < 2**63:
                    wide = struct.unpack("<4sHH", read_file(self.uri, f"shard-{x['shard']:05d}.bin", 0, HEAD))[2]
                    out[keys[i]] = np.frombuffer(read_file(self.uri, f"shard-{x['shard']:05d}.bin", HEAD + int(x["offset"]) * wide, int(x["length"]) * wide), f"<u{wide}").tolist()
        return out


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    store = TokenStore.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    keys = store.directory.select("key", "occurrence", "h1", "h2")
    found = store.read(store.locate(keys), digest=lambda ids: zlib.crc32(ids.tobytes()), column="ids_crc32 long")
    return found.select(F.col("key").alias("doc_id"), "start", F.col("length").alias("n_tokens"), "ids_crc32")
