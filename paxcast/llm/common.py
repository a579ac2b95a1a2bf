"""Helpers shared by the operators: tables, shared folder, text chunks, hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised operators hold in one working set.
CHUNK_BYTES = 2 << 20

#: ASCII white space, the separators of ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Odd base of the polynomial hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors
    share. Only a session that names none (tests) gets a scratch folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="llm-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def materialise(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: later
    jobs, and tasks retried after the loss of an executor, read the files."""
    spark = df.sparkSession
    folder = folder or shared_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def bucket_count(spark: SparkSession, rows: int, per_bucket: int, least: int = 1) -> int:
    """How many buckets hold ``rows`` at about ``per_bucket`` each."""
    return max(least, -(-rows // per_bucket))


class Chunk:
    """Consecutive rows of an Arrow batch with their texts as one byte array."""

    def __init__(self, batch: pa.RecordBatch, text: str):
        self.batch = batch
        column = pc.fill_null(batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).cast(pa.large_binary()), b"")
        buffers = column.buffers()
        offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + len(column) + 1]
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
        self.data = data[offsets[0]:offsets[-1]]
        self.offsets = offsets - offsets[0]

    def __len__(self):
        return self.batch.num_rows

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Rows in runs of about ``limit`` text bytes; a longer text is a run of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64))
        at = 0
        while at < n:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield Chunk(batch.slice(at, to - at), text)
            at = to


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, power=None, inverse=None) -> np.ndarray:
    """64-bit content hashes of data[starts[i]:ends[i]]; equal contents hash
    alike wherever they stand, in every task."""
    n = len(data)
    power = powers(BASE, n) if power is None else power[:n]
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=prefix[1:])
    inverse = powers(BASE_INVERSE, n + 1) if inverse is None else inverse[:n + 1]
    raw = (prefix[ends] - prefix[starts]) * inverse[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


class Words:
    """The words ``[^\x20\x09-\x0D]+`` of a chunk: bounds, 64-bit hashes and
    the row each stands in. A word never crosses rows."""

    def __init__(self, chunk: Chunk, lower: bool):
        data, offsets = chunk.data, chunk.offsets
        solid = ~SPACE[data]
        n = len(data)
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        row_starts = offsets[:-1][offsets[:-1] < n]
        first[row_starts] = solid[row_starts]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        row_ends = offsets[1:][offsets[1:] > 0] - 1
        last[row_ends] = solid[row_ends]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.rows = np.searchsorted(offsets, self.starts, side="right") - 1
        self.hashes = segment_hashes(LOWER[data] if lower else data, self.starts, self.ends)
        self.solid = solid
        self.counts = np.bincount(self.rows, minlength=len(chunk))
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one per byte) over each row's bytes."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of ``width`` consecutive word hashes from each position that has them."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9FB21C651E98DF25) + hashes[k:k + n]
    return mix(out)


def signed(h: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as Arrow longs (the same bits)."""
    return pa.array(np.ascontiguousarray(h).view(np.int64))


def held_out(doc_id: str, modulus: int, remainder: int):
    """The fold rule: crc32 of the id as text; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus) == remainder
