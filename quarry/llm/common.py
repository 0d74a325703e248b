"""Shared parts of the training-data operators: staging folders, Arrow batches and vectorised word hashing."""

from __future__ import annotations

import ctypes
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of text that one vectorised step handles at once (a longer single text is handled alone).
STEP_BYTES = 1 << 19
#: Powers of a base that a worker keeps; longer tables are made for one text and let go.
KEPT_POWERS = 1 << 20
#: A word is a run of bytes other than space and the five ASCII controls 9 to 13.
WHITE = bytes([9, 10, 11, 12, 13, 32])

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(WHITE)] = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Where that is unset, an own folder serves a local master, whose threads share the machine; a cluster raises an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master", "").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:///tmp/quarry-work"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage is cut, nothing depends on one executor."""
    spark, path = df.sparkSession, work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of rows with whole texts: few rows each, so that a worker's memory holds some long ones."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def row_hash(df: DataFrame, names: list[str] | None = None) -> F.Column:
    """A hash of whole rows; columns that hold maps or variants, which Spark does not hash, count by their JSON."""
    columns = [f for f in df.schema if names is None or f.name in names]
    odd = lambda kind: "map<" in kind or "variant" in kind
    quoted = lambda name: F.col("`" + name.replace("`", "``") + "`")
    return F.xxhash64(*[F.to_json(F.struct(quoted(f.name))) if odd(f.dataType.simpleString()) else quoted(f.name) for f in columns])


def with_fields(fields: list[StructField], ddl: str) -> StructType:
    """The schema of fields that pass through, names and nested types as they are, and of new ones."""
    return StructType([*fields, *StructType.fromDDL(ddl).fields])


def text_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and bytes of text."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def crc_bucket(column: str, n: int) -> F.Column:
    """crc32 of the column's text form, modulo n; a null counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def blobs(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def steps(texts: list[bytes | str | None], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about `limit` bytes."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or b"") + 1
        if size and size + n > limit:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, math.ceil(math.log2(max(n, 2))))
        base = _BASES[which]
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            pair.append(p)
        have = (pair[0], pair[1])
        if size <= KEPT_POWERS:
            _powers[which] = have
    return have


def release() -> None:
    """Gives the worker's free memory back to the system: workers outlive their tasks and stand beside the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not every C library has it


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, after whose last batch the worker's free memory is given back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return run


def lean_group(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """f on a group, after which the worker's free memory is given back."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return f(table)
        finally:
            release()

    return run


def lean_cogroup(f: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """f on two groups of one key, after which the worker's free memory is given back."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return f(left, right)
        finally:
            release()

    return run


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & _MASK)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of some texts: hash of each word, and where each text's words begin."""

    def __init__(self, texts: list[bytes | None]):
        buf = b" ".join([t or b"" for t in texts]) + b" "
        self.bytes = a = np.frombuffer(buf, dtype=np.uint8)
        lengths = np.fromiter((len(t or b"") + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.text_at = np.concatenate(([0], np.cumsum(lengths)))
        word = ~_SPACE[a]
        edge = np.diff(np.concatenate(([False], word)).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.starts, self.text_at)
        p, q = powers(len(a) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * p[: len(a)])))
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * q[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def windows(self, length: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the `length` words from each word on, and whether they lie in one text. Positions past the last window are left out."""
        n = max(0, len(self.hashes) - length + 1)
        p, q = powers(len(self.hashes) + 1, which)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(self.hashes, 7 + which) * p[: len(self.hashes)])))
        h = mix((sums[length : length + n] - sums[:n]) * q[:n], length + 101 * which)
        own = self.owner()
        return h, own[:n] == own[length - 1 : length - 1 + n]
