"""A compressed store of token ids: shards with one zstandard frame for each document and a shared dictionary.

A shard file is: 8 bytes `QTOKSH01`; the 32 bytes of the dictionary's sha256 (zeros: no dictionary); one byte, the bytes
of an id; the frames, one after the other; the index, for each document 8 bytes offset of its frame and 8 bytes number of
ids; 8 bytes number of documents and 8 bytes offset of the index. All integers are little-endian. A single document is
read with two short reads, whatever the shard's size. Dictionary and shards lie in one folder that all machines share.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import lean, parts, small_batches, steps, text_size, work_dir
from quarry.llm.tokens import BATCH, encoder

MAGIC = b"QTOKSH01"
#: Texts from which the dictionary is trained (those of least hash of the id) and bytes of the longest that may be among
#: them: it is short documents that a dictionary helps. Then its own bytes and the level of compression.
SAMPLE, SAMPLE_BYTES, DICT_BYTES, LEVEL = 600, 64 << 10, 64 << 10, 3
#: Bytes of text and documents in a shard, about; shards whose totals one task adds up.
SHARD_BYTES, SHARD_DOCS, SHARD_BLOCK = 32 << 20, 200_000, 1024


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _get(path: str) -> bytes:
    system, at = _fs(path)
    with system.open_input_file(at) as f:
        return f.read()


def _put(path: str, data: bytes, attempt: str) -> None:
    """Whole or not at all: a retried or doubled task replaces the file by the same bytes."""
    system, at = _fs(path)
    with system.open_output_stream(f"{at}.{attempt}") as f:
        f.write(data)
    system.move(f"{at}.{attempt}", at)


def _id_type(width: int) -> np.dtype:
    return np.dtype(f"<u{width}")


def train(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str, text: str) -> bytes:
    """A dictionary from the id arrays of SAMPLE texts; empty if they are too few to train one."""
    import zstandard

    short = docs.where(F.col(doc_id).isNotNull() & (F.octet_length(text) <= SAMPLE_BYTES))
    ids = short.select(doc_id).orderBy(F.xxhash64(doc_id), doc_id).limit(SAMPLE).distinct()
    rows = [r[0] for r in short.join(F.broadcast(ids), doc_id, "left_semi").orderBy(doc_id, text).select(text).limit(SAMPLE).collect()]
    e = encoder(tokenizer)
    samples = [np.append(x, e.kind.type(end_id)).tobytes() for x in e.encode([t or "" for t in rows])]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


class ShardWriter:
    def __init__(self, dictionary: bytes, width: int):
        import zstandard

        kept = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if kept:
            kept.precompute_compress(level=LEVEL)
        self.zip = zstandard.ZstdCompressor(level=LEVEL, dict_data=kept)
        self.width = width
        self.head = MAGIC + (hashlib.sha256(dictionary).digest() if dictionary else bytes(32)) + bytes([width])
        self.frames, self.at, self.size = [], [], len(self.head)

    def add(self, ids: np.ndarray) -> None:
        frame = self.zip.compress(ids.astype(_id_type(self.width), copy=False).tobytes())
        self.at.append((self.size, len(ids)))
        self.frames.append(frame)
        self.size += len(frame)

    def done(self) -> bytes:
        index = np.array(self.at, dtype="<u8").tobytes()
        return b"".join([self.head, *self.frames, index, struct.pack("<QQ", len(self.at), self.size)])


class ShardReader:
    """Reads all documents, or one by its place in the shard."""

    def __init__(self, path: str, dictionary: bytes):
        import zstandard

        system, at = _fs(path)
        self.file = system.open_input_file(at)
        size = self.file.size()
        n, index = struct.unpack("<QQ", self.file.read_at(16, size - 16))
        head = self.file.read_at(41, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{path} is no shard of token ids")
        if head[8:40] != (hashlib.sha256(dictionary).digest() if dictionary else bytes(32)):
            raise ValueError(f"{path} was written with another dictionary")
        self.kind = _id_type(head[40])
        self.zip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        self.index = np.frombuffer(self.file.read_at(16 * n, index), "<u8").reshape(n, 2)
        self.ends = np.append(self.index[1:, 0], np.uint64(index)) if n else np.zeros(0, "<u8")

    def __len__(self) -> int:
        return len(self.index)

    def document(self, i: int) -> np.ndarray:
        at, n = int(self.index[i, 0]), int(self.index[i, 1])
        return np.frombuffer(self.zip.decompress(self.file.read_at(int(self.ends[i]) - at, at), max_output_size=n * self.kind.itemsize), self.kind)

    def all(self, step: int = 8 << 20) -> Iterator[np.ndarray]:
        """Every document in order; frames are read some MB at a time."""
        i = 0
        while i < len(self.index):
            start = int(self.index[i, 0])
            j = i + max(1, int(np.searchsorted(self.ends[i:], start + step, "right")))
            data = self.file.read_at(int(self.ends[j - 1]) - start, start)
            for k in range(i, j):
                at, n = int(self.index[k, 0]) - start, int(self.index[k, 1])
                yield np.frombuffer(self.zip.decompress(data[at : int(self.ends[k]) - start], max_output_size=n * self.kind.itemsize), self.kind)
            i = j


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes all documents in ascending order of id (null first; equal ids by a hash of the text) and returns the shards' manifest.

    A null text counts as empty: its ids are the end id alone. The manifest has, for each shard in order, `shard`, `path`,
    `dictionary` (path), `doc_ids`, `n_docs`, `n_tokens`; it lies as Parquet in the folder. An empty table gives no shard.
    Other columns are not stored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or work_dir(spark, "tokens")
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    n, size = text_size(docs)
    dictionary = train(docs, tokenizer, end_id, "doc_id", "text") if n else b""
    system, at = _fs(folder)
    system.create_dir(at, recursive=True)
    dict_path = f"{folder}/{hashlib.sha256(dictionary).hexdigest()}.dict"
    _put(dict_path, dictionary, "driver")
    n_shards = max(parts(spark), -(-size // SHARD_BYTES), -(-n // SHARD_DOCS))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, context = encoder(tokenizer), TaskContext.get()
        out, ids, total = ShardWriter(_get(dict_path), e.kind.itemsize), [], 0
        end = np.array([end_id], e.kind)
        for batch in batches:
            ids.extend(batch.column("doc_id").to_pylist())
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for i, j in steps(texts, BATCH):
                for x in e.encode(texts[i:j]):
                    out.add(np.concatenate((x, end)))
                    total += len(x) + 1
        if ids:
            shard = context.partitionId()
            _put(path := f"{folder}/shard-{shard:08d}.qtok", out.done(), f"a{context.taskAttemptId()}")
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "dictionary": [dict_path], "doc_ids": [ids], "n_docs": [len(ids)], "n_tokens": [total]}, schema=kind)

    schema = f"shard long, path string, dictionary string, doc_ids array<{id_type}>, n_docs long, n_tokens long"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(schema))
    # the ranges are cut by keys that a sample carries to the driver: ids and hashes, not texts
    keyed = docs.withColumn("hash", F.xxhash64("text"))
    laid = keyed.repartitionByRange(n_shards, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")
    laid.mapInArrow(lean(write), schema).write.parquet(f"{folder}/manifest")
    return spark.read.schema(schema).parquet(f"{folder}/manifest")


def _starts(manifest: DataFrame) -> DataFrame:
    """(shard, base): ids in all shards before it, by sums within blocks of shards and over the blocks."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    told = manifest.select("shard", "n_tokens", F.floor(F.col("shard") / SHARD_BLOCK).alias("block"))
    blocks = told.groupBy("block").agg(F.sum("n_tokens").alias("total"))
    # one small row for each SHARD_BLOCK shards
    blocks = blocks.select("block", F.coalesce(F.sum("total").over(before(Window.orderBy("block"))), F.lit(0)).alias("base"))
    inside = told.withColumn("inside", F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("block").orderBy("shard"))), F.lit(0)))
    return inside.join(blocks, "block").select("shard", (F.col("inside") + F.col("base")).alias("base"))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document, from the shards: doc_id, `start` (ids before it in the whole store), `n_tokens`, `ids_crc32`, `ids`.

    Documents come as they were stored: null ids, empty texts (the end id alone) and repeated rows each with an own place. An
    empty manifest gives no rows.
    """
    n_shards = manifest.count()
    id_type = manifest.schema["doc_ids"].dataType.elementType.simpleString()

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                reader, at = ShardReader(r["path"], _get(r["dictionary"])), r["base"]
                held, size = [], 0
                for key, ids in zip(r["doc_ids"], reader.all(), strict=True):
                    wide = ids.astype("<u4")
                    held.append((key, at, len(ids), zlib.crc32(wide.tobytes()), wide))
                    at, size = at + len(ids), size + len(ids)
                    if size > 1 << 20:
                        yield _rows(held, batch.schema.field("doc_ids").type.value_type)
                        held, size = [], 0
                if held:
                    yield _rows(held, batch.schema.field("doc_ids").type.value_type)

    joined = manifest.join(_starts(manifest), "shard").select("shard", "path", "dictionary", "doc_ids", "base")
    return joined.repartition(max(1, min(n_shards, 100_000)), "shard").mapInArrow(lean(load), f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long, ids array<int>")


def _rows(held: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    keys, at, n, crc, ids = zip(*held, strict=True)
    flat = pa.array(np.concatenate(ids).astype(np.int32))
    cuts = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.ListArray.from_arrays(cuts, flat)], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
