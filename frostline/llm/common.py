"""Reading, intermediate tables and Arrow helpers shared by the document operators."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from frostline.streaming.workspace import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """df written as a table in the shared folder and read back, in at most `files` files if given.

    The rows no longer depend on executors that may be lost, and nothing before this point is computed twice.
    """
    path = new_folder(df.sparkSession, name)
    (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of about `limit` bytes of text, so that work arrays stay small.

    A single longer text is a piece of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(byte_lengths(batch.column(text)))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def byte_lengths(column: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text; 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column joined, and the n + 1 offsets of its rows; null counts as empty."""
    lengths = byte_lengths(column)
    offsets = np.zeros(len(column) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    if column.null_count:
        data = b"".join(x.encode() for x in column.to_pylist() if x is not None)
        return np.frombuffer(data, np.uint8), offsets
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    own = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
    if not len(own) or own[-1] == own[0]:
        return np.zeros(0, np.uint8), offsets
    return np.frombuffer(column.buffers()[2], np.uint8)[own[0] : own[-1]], offsets


def byte_pieces(data: bytes, size: int = 4 << 20) -> Iterator[bytes]:
    """The bytes in pieces of about `size`, cut at blanks, so that lists of words stay short."""
    start = 0
    while start < len(data):
        cut = data.find(b" ", start + size)
        cut = len(data) if cut < 0 else cut
        yield data[start:cut]
        start = cut


def crc32_ids(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
