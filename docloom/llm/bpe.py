"""BPE encoding and decoding through a distinct-word table.

Encoding: every task cuts its rows into blocks of about ``BLOCK_BYTES`` of text and lists each block's
distinct words. The lists are dealt by word, so that each distinct word of the corpus is encoded once;
its ids go back to the blocks that asked, and each block joins them to its documents by word position.
What is shuffled is the texts once, packed, and each block's distinct words and their ids; no task holds
more than one block's words. A hot word is one row a block.

Words are runs without space or line feed: no token of the tokenizer spans either (checked when the
operator starts), so a text's ids are its words' ids in order. A block whose words do not arrive, as
when the input is dealt otherwise when it is read again, encodes them itself: results never depend on it.

Decoding joins each id to its piece (the tokenizer's vocabulary, a fixed table) and puts the pieces
together as the tokenizer's decoder does.

Defined results: null text is the empty text (no ids, empty decoded text); repeated rows and null keys
are each kept; an empty table gives no rows; of further columns, only those named in ``keep`` are taken.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, plus, table, tuned, width

BLOCK_BYTES = 6 << 20


def load_tokenizer(tokenizer_json: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads also each keep memory
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokenizer_json)
    tok.no_truncation()
    tok.no_padding()
    return tok


def words_of(text: str) -> list[str]:
    return [w for w in text.replace("\n", " ").split(" ") if w]


def spans_no_blank(tokenizer_json: str) -> bool:
    """No token holds or needs a blank: the pre-tokenizer drops white space around its words."""
    tok = load_tokenizer(tokenizer_json)
    probe = ["a", "b's", "1.2", "é!", "x-y"]
    ids = lambda t: tok.encode(t, add_special_tokens=False).ids
    return all(ids(sep.join(probe)) == [i for p in probe for i in ids(p)] for sep in (" ", "\n", " \n ", "  ")) and not ids(" \n")


class _Packer:
    """zstd-packed rows: a column of texts and the kept columns as one Arrow stream."""

    @staticmethod
    def pack(batch: pa.RecordBatch) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as w:
            w.write_batch(batch)
        return sink.getvalue().to_pybytes()

    @staticmethod
    def unpack(raw: bytes) -> pa.Table:
        return pa.ipc.open_stream(raw).read_all()


def _blocks(batches):
    """(block id, rows) of a task: block ids are unique to the input's partition (the last column) and the place in it."""
    part, seq, held, size = 0, 0, [], 0
    for b in batches:
        at = 0
        if b.num_rows:
            part = b.column(b.num_columns - 1)[0].as_py()
        lengths = pc.fill_null(pc.binary_length(b.column(0)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        while at < b.num_rows:
            done = int(ends[at - 1]) if at else 0
            n = max(1, int(np.searchsorted(ends, done + BLOCK_BYTES - size, "right")) - at)
            held.append(b.slice(at, n))
            size += int(ends[at + n - 1]) - done
            at += n
            if size >= BLOCK_BYTES or at < b.num_rows:
                yield (part << 24) + seq, held
                seq, held, size = seq + 1, [], 0
    if held:
        yield (part << 24) + seq, held


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """The kept columns and ids array<int>; with ``decoded``, also the text that they decode to, joined in the same
    task (as decode() does for a table of ids)."""
    tuned(docs.sparkSession)
    tokenizer_json = open(tokenizer_path, encoding="utf-8").read()
    if not spans_no_blank(tokenizer_json):
        raise ValueError("the tokenizer keeps white space in its tokens: words cannot be encoded one by one")
    held = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    narrow = "<u2" if load_tokenizer(tokenizer_json).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
    n = width(docs)
    # The input's own partition number: below a union the task's number is another one.
    source = docs.select(F.col(text).alias("_text"), *keep, F.spark_partition_id().alias("_part"))

    def ask(batches):
        press = zstandard.ZstdCompressor(6)
        for block, rows in _blocks(batches):
            seen: set[str] = set()
            for b in rows:
                for i in range(0, b.num_rows, 256):
                    for t in b.column(0).slice(i, 256).to_pylist():
                        if t:
                            seen.update(words_of(t))
            # crc32 deals words evenly and alike in every process
            parts: list[list[bytes]] = [[] for _ in range(n)]
            from zlib import crc32

            for w in seen:
                raw = w.encode()
                parts[crc32(raw) % n].append(raw)
            out = [(p, press.compress(b"\n".join(sorted(ws)))) for p, ws in enumerate(parts) if ws]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([block] * len(out), pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["part", "block", "blob"])

    def answer(batches):
        tok, unpress, press = None, zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(6)
        known: dict[bytes, bytes] = {}
        last = None
        for b in batches:
            tok = tok or load_tokenizer(held.value)
            blocks, blobs = [], []
            for part, block, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if part != last:
                    known, last = {}, part
                words = unpress.decompress(blob).split(b"\n")
                new = [w for w in words if w not in known]
                for i in range(0, len(new), 5_000):
                    some = new[i : i + 5_000]
                    for w, e in zip(some, tok.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                        known[w] = np.array(e.ids, "<u4").tobytes()
                ids = [known[w] for w in words]
                counts = np.array([len(x) // 4 for x in ids], "<u4")
                blocks.append(block)
                blobs.append(press.compress(len(words).to_bytes(4, "little") + counts.tobytes() + np.frombuffer(b"".join(ids), "<u4").astype(narrow).tobytes() + b"\n".join(words)))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([0] * len(blocks), pa.int8()), pa.array(blobs, pa.binary())], names=["block", "kind", "blob"])

    def ship(batches):
        for block, rows in _blocks(batches):
            for b in rows:
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([1], pa.int8()), pa.array([_Packer.pack(b)], pa.binary())], names=["block", "kind", "blob"])

    def join(batches):
        unpress, tok = zstandard.ZstdDecompressor(), None
        pieces = Pieces(held.value) if decoded else None
        known: dict[str, bytes] = {}
        last = None
        for b in batches:
            for block, kind, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if block != last:
                    known, last = {}, block
                if kind == 0:
                    raw = unpress.decompress(blob.as_py())
                    k = int.from_bytes(raw[:4], "little")
                    counts = np.frombuffer(raw, "<u4", k, 4)
                    total = int(counts.sum())
                    flat = np.frombuffer(raw, narrow, total, 4 + 4 * k).astype("<u4").tobytes()
                    ends = (np.cumsum(counts, dtype=np.int64) * 4).tolist()
                    words = raw[4 + 4 * k + np.dtype(narrow).itemsize * total :].decode().split("\n")
                    at = 0
                    for w, end in zip(words, ends, strict=True):
                        known[w] = flat[at:end]
                        at = end
                    continue
                for rows in _Packer.unpack(blob.as_py()).to_batches():
                    for i in range(0, rows.num_rows, 128):
                        some = rows.slice(i, 128)
                        split = [words_of(t) if t else [] for t in some.column(0).to_pylist()]
                        try:
                            ids = [b"".join([known[w] for w in ws]) for ws in split]
                        except KeyError:
                            tok = tok or load_tokenizer(held.value)
                            new = list({w for ws in split for w in ws if w not in known})
                            for w, e in zip(new, tok.encode_batch_fast(new, add_special_tokens=False), strict=True):
                                known[w] = np.array(e.ids, "<u4").tobytes()
                            ids = [b"".join([known[w] for w in ws]) for ws in split]
                        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype("i4")
                        values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
                        found = pa.ListArray.from_arrays(pa.array(offsets), values)
                        more = [pieces.texts(found)] if decoded else []
                        yield pa.RecordBatch.from_arrays([*some.columns[1:-1], found, *more], names=[*keep, "ids", *["decoded"] * decoded])

    asked = source.select("_text", "_part").mapInArrow(lean(ask), "part int, block long, blob binary")
    answered = asked.repartition(n, "part").sortWithinPartitions("part").mapInArrow(lean(answer), "block long, kind byte, blob binary")
    shipped = source.mapInArrow(lean(ship), "block long, kind byte, blob binary")
    return answered.unionByName(shipped).repartition(n, "block").sortWithinPartitions("block", "kind").mapInArrow(lean(join), plus(source.drop("_text", "_part").schema, "ids array<int>" + ", decoded string" * decoded))


class Pieces:
    """The id-to-piece table of a tokenizer, and the texts that rows of ids decode to (special tokens kept)."""

    def __init__(self, tokenizer_json: str):
        tok = load_tokenizer(tokenizer_json)
        decoder = json.loads(tokenizer_json).get("decoder")
        if decoder is not None and decoder.get("type") != "ByteLevel":
            raise ValueError(f"decoder {decoder.get('type')} is not supported")
        piece = [tok.id_to_token(i) for i in range(tok.get_vocab_size(with_added_tokens=True))]
        self.bytewise = decoder is not None
        if self.bytewise:
            printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
            rest = [x for x in range(256) if x not in printable]
            byte = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(rest)}
            piece = [bytes(byte[c] for c in p) if all(c in byte for c in p) else p.encode() for p in piece]
        self.table = pa.array(piece, pa.binary() if self.bytewise else pa.string())

    def texts(self, ids: pa.ListArray) -> pa.Array:
        ids = pc.fill_null(ids, pa.scalar([], ids.type))
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype("i4")
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), self.table.take(ids.flatten())), b"" if self.bytewise else " ")
        if self.bytewise:
            joined = pa.array([x.as_py().decode("utf-8", "replace") for x in joined], pa.string())
        return joined


def decode(tokens: DataFrame, tokenizer_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """tokens and the decoded text of each row's ids (special tokens kept)."""
    tuned(tokens.sparkSession)
    tokenizer_json = open(tokenizer_path, encoding="utf-8").read()
    Pieces(tokenizer_json)  # refuses a decoder that it does not know
    held = tokens.sparkSession.sparkContext.broadcast(tokenizer_json)
    at = tokens.columns.index(ids)
    schema = plus(tokens.schema, f"{into} string")

    def run(batches):
        pieces = Pieces(held.value)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                some = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays([*some.columns, pieces.texts(some.column(at))], names=schema.names)

    return tokens.mapInArrow(lean(run), schema)


def op5_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), decoded=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
