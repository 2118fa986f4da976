"""Token-id files: one compressed frame per document under a shared dictionary, with an offset index."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FREE_SHUFFLES, count_rows, id_bounds, setting, ship, small_batches, table, table_path, tokenizer_path
from .tokens import encoder

MAGIC, VERSION = b"VTOK", 2
#: magic, version, bytes per id, dictionary's SHA-256, documents, those of them (the first) whose doc_id is null,
#: tokens of the shard before this block
HEAD = struct.Struct("<4sHH32sQQQ")
BLOCK_BYTES = 4 << 20


@dataclass(frozen=True)
class Dictionary:
    """A zstandard dictionary, and the hash by which files name it. Empty bytes: none."""

    data: bytes
    level: int = 3

    @property
    def digest(self) -> bytes:
        return hashlib.sha256(self.data).digest()

    def _shared(self):
        import zstandard

        return zstandard.ZstdCompressionDict(self.data) if self.data else None

    def compressor(self):
        import zstandard

        if (d := self._shared()) is None:
            return zstandard.ZstdCompressor(level=self.level)
        d.precompute_compress(level=self.level)
        return zstandard.ZstdCompressor(level=self.level, dict_data=d)

    def decompressor(self):
        import zstandard

        return zstandard.ZstdDecompressor(dict_data=self._shared()) if self.data else zstandard.ZstdDecompressor()


def pack_block(docs: list[tuple[int | None, int, bytes]], width: int, digest: bytes, before: int) -> bytes:
    """A block from (doc_id, tokens, frame), null ids first: header; doc ids, token counts and frame offsets;
    frames."""
    nulls = sum(d is None for d, _, _ in docs)
    ids = np.array([0] * nulls + [d for d, _, _ in docs[nulls:]], dtype="<i8")
    counts = np.array([n for _, n, _ in docs], dtype="<u8")
    offsets = np.concatenate(([0], np.cumsum([len(f) for _, _, f in docs]))).astype("<u8")
    return b"".join([HEAD.pack(MAGIC, VERSION, width, digest, len(docs), nulls, before), ids.tobytes(), counts.tobytes(), offsets.tobytes(), *(f for _, _, f in docs)])


class Block:
    """A block read back. ``ids(i)`` opens the frame of document i alone, ``find(doc_id)`` says which it is."""

    def __init__(self, data: bytes, dictionary: Dictionary, decompressor=None) -> None:
        magic, version, self.width, digest, n, self.nulls, self.before = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token block of this version")
        if digest != dictionary.digest:
            raise ValueError("the block was written with another dictionary")
        at = HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.counts = np.frombuffer(data, "<u8", n, at + 8 * n)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at + 16 * n)
        self.data, self.body = data, at + 16 * n + 8 * (n + 1)
        self.opener = decompressor or dictionary.decompressor()

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else int(self.doc_ids[i])

    def find(self, doc_id: int | None) -> range:
        """The documents of an id, by bisection."""
        if doc_id is None:
            return range(self.nulls)
        known = self.doc_ids[self.nulls :]
        return range(self.nulls + int(np.searchsorted(known, doc_id)), self.nulls + int(np.searchsorted(known, doc_id, "right")))

    def ids(self, i: int) -> np.ndarray:
        a, b = self.body + int(self.offsets[i]), self.body + int(self.offsets[i + 1])
        raw = self.opener.decompress(self.data[a:b], max_output_size=int(self.counts[i]) * self.width)
        out = np.frombuffer(raw, f"<u{self.width}")
        if len(out) != self.counts[i]:
            raise ValueError(f"document {i} has another length than its index says")
        return out


def _encoded(text: str | None, path: str, end_id: int, width: int) -> tuple[int, bytes]:
    ids = np.append(encoder(path).encode(text or ""), np.uint32(end_id))
    return len(ids), ids.astype(f"<u{width}").tobytes()


def _samples(batches, path: str, end_id: int, width: int, most: int):
    for batch in small_batches(batches):
        raw = [_encoded(t, path, end_id, width)[1] for t in batch.column(0).to_pylist()]
        # a training sample of a long document is a stretch from its middle; files always hold whole documents
        cut = [r if len(r) <= most else r[(at := (len(r) - most) // 2 // width * width) : at + most] for r in raw]
        yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary())], ["ids"])


def train_dictionary(rows: DataFrame, path: str, *, end_id: int, width: int, slots: int = 1024, sample_bytes: int = 8192, size: int = 32768) -> Dictionary:
    """Trains on the serialized ids of at most ``slots`` documents, chosen by the hash of their ids, at most
    ``sample_bytes`` of each: the bound of what reaches the driver. Too few documents: no dictionary."""
    import zstandard

    known = rows.where("doc_id is not null")
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(slots))
    chosen = known.groupBy(slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("doc_id", F.lit(1)).alias("h"), "doc_id")).alias("m")).select(F.col("m.doc_id").alias("doc_id"))
    picked = known.join(F.broadcast(chosen), "doc_id").select("text")
    samples = sorted(bytes(r.ids) for r in picked.mapInArrow(lambda it: _samples(it, path, end_id, width, sample_bytes), "ids binary").collect())
    try:
        return Dictionary(zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 else b"")
    except zstandard.ZstdError:
        return Dictionary(b"")


@dataclass(frozen=True)
class Shards:
    """The shards of id ranges, in ascending order of ids: first ``nulls`` shards of null ids, then for each range
    one shard, and after it, where its greatest id is worth several ranges by itself, that many more for that id
    alone. Rows of such an id, and of null, are dealt by their frames' checksums."""

    bounds: np.ndarray
    weight: np.ndarray
    nulls: int

    def first(self) -> np.ndarray:
        sizes = 1 + np.where(self.weight > 1, self.weight, 0)
        return self.nulls + np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)

    def count(self) -> int:
        return max(1, int(self.first()[-1]))

    def of(self, doc_id: int | None, frame: bytes, first: np.ndarray) -> int:
        if doc_id is None:
            return zlib.crc32(frame) % max(1, self.nulls)
        k = int(np.searchsorted(self.bounds, doc_id))
        if self.weight[k] > 1 and self.bounds[k] == doc_id:
            return int(first[k]) + 1 + zlib.crc32(frame) % int(self.weight[k])
        return int(first[k])


def _frames(batches, path: str, end_id: int, width: int, dictionary: Dictionary, shards: Shards):
    press, first = dictionary.compressor(), shards.first()
    for batch in small_batches(batches):
        docs = batch.column(0).to_pylist()
        made = [_encoded(t, path, end_id, width) for t in batch.column(1).to_pylist()]
        frames = [press.compress(raw) for _, raw in made]
        places = [shards.of(d, f, first) for d, f in zip(docs, frames)]
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(docs, pa.int64()), pa.array([n for n, _ in made], pa.int64()), pa.array(frames, pa.binary())], ["shard", "doc_id", "n_tokens", "frame"])


def _blocks(batches, width: int, digest: bytes):
    """Rows come sorted by shard and document; a block closes at about BLOCK_BYTES or with its shard."""
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())])
    held: list[tuple] = []
    shard, block, before, size = None, 0, 0, 0

    def close():
        nonlocal block, before, size
        tokens = sum(n for _, n, _ in held)
        out = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([next((d for d, _, _ in held if d is not None), None)], pa.int64()), pa.array([held[-1][0]], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([tokens], pa.int64()), pa.array([pack_block(held, width, digest, before)], pa.binary())], schema=schema)
        block, before, size = block + 1, before + tokens, 0
        held.clear()
        return out

    for batch in small_batches(batches):
        for s, doc, n, frame in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (s != shard or size >= BLOCK_BYTES):
                yield close()
            if s != shard:
                shard, block, before = s, 0, 0
            held.append((doc, n, frame))
            size += len(frame)
    if held:
        yield close()


def write(docs: DataFrame, path: str, tokenizer: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int | None = None, shard_docs: int = 8192) -> Dictionary:
    """Writes the ids of whole texts, ``end_id`` after each document, to ``path``: ``path/blocks`` (blocks of
    whole documents in ascending doc_id order, shard by shard), ``path/dictionary`` and ``path/index`` (one
    row per shard: documents, tokens, and tokens of all shards before it).

    Ids take two bytes where the vocabulary allows. Each document is encoded once, and only its compressed
    frame is shuffled, each shard to a task of its own. Quantiles of the doc_ids set the shards (``Shards``); only
    they, and the index, reach the driver. Null text is taken as empty. Null doc_ids come first. Rows that
    repeat a doc_id stand in the order of their lengths and frames (of an id that fills several shards: inside
    each). Very long texts are one frame each. Other columns are ignored, whatever their names; an empty table
    gives empty files.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    width = width or (2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4)
    dictionary = train_dictionary(rows, tokenizer, end_id=end_id, width=width)
    shards = Shards(*id_bounds(rows, shard_docs), -(-count_rows(rows.where("doc_id is null")) // shard_docs))
    frames = rows.mapInArrow(lambda it: _frames(it, tokenizer, end_id, width, dictionary, shards), "shard int, doc_id long, n_tokens long, frame binary")
    dealt = frames.repartitionById(shards.count(), "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "n_tokens", "frame")
    digest = dictionary.digest
    blocks = dealt.mapInArrow(lambda it: _blocks(it, width, digest), "shard int, block int, first_id long, last_id long, n_docs long, n_tokens long, data binary")
    with setting(spark, FREE_SHUFFLES, "true"):
        blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(digest.hex(), dictionary.data)], "sha256 string, data binary").coalesce(1).write.parquet(f"{path}/dictionary")
    found = sorted(spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_docs"), F.sum("n_tokens")).collect())
    index, before = [], 0
    for shard, n, tokens in found:
        index.append((shard, n, tokens, before))
        before += tokens
    spark.createDataFrame(index, "shard int, n_docs long, n_tokens long, start long").coalesce(1).write.parquet(f"{path}/index")
    return dictionary


def open_dictionary(spark: SparkSession, path: str) -> Dictionary:
    row = spark.read.parquet(f"{path}/dictionary").first()
    found = Dictionary(bytes(row.data))
    if found.digest.hex() != row.sha256:
        raise ValueError("the dictionary's hash is wrong")
    return found


def _documents(batches, dictionary: Dictionary, starts: dict[int, int], with_ids: bool):
    opener = dictionary.decompressor()
    for batch in small_batches(batches):
        for shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            block = Block(data, dictionary, opener)
            at, rows = starts[shard] + block.before, []
            for i in range(len(block.doc_ids)):
                raw = block.ids(i).astype("<u4").tobytes()
                n = len(raw) // 4
                rows.append((block.doc_id(i), at, n, zlib.crc32(raw), raw if with_ids else None))
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def read(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, ids)`` of every document from the files: start counts the ids
    of all documents before it, ids are little-endian unsigned 32-bit numbers."""
    ship(spark)
    dictionary = open_dictionary(spark, path)
    starts = {r.shard: r.start for r in spark.read.parquet(f"{path}/index").collect()}
    blocks = spark.read.parquet(f"{path}/blocks").select("shard", "data")
    return blocks.mapInArrow(lambda it: _documents(it, dictionary, starts, with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def lookup(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents of one id: the blocks whose range of ids holds it are read (their statistics let
    Spark skip the others), and in them only that document's frames are opened."""
    dictionary = open_dictionary(spark, path)
    found = spark.read.parquet(f"{path}/blocks").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).select("data")
    out = []
    for r in found.toLocalIterator():  # one block, unless the id is repeated
        block = Block(bytes(r.data), dictionary)
        out += [block.ids(i) for i in block.find(doc_id)]
    return out


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "token-files")
    write(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return read(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
