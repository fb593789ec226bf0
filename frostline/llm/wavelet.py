"""Token-id files: a wavelet matrix per shard, with access, rank and select on the compressed bytes.

File format (little-endian): the 8 bytes `WMTOKEN2`; uint64 number of tokens n, of documents m, of planes p and of
length of the zstd-compressed document table; that table (int64 doc_id, uint8 doc_id is null, int64 tokens of each
document, as three arrays). Then for each plane, from the highest bit of an id to the lowest: uint64 number of zeros; for
each chunk of 32,768 positions, and once more for the end, uint32 ones before it; for each chunk, and for the end, uint32
start of its body; and the bodies, each the zstd-compressed bits of a chunk (8 positions a byte, first position in the
highest bit). The counts are the rank directory: a query unpacks one chunk a plane and step, whatever the size of the
file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm.common import crc32_ids, slices, stored
from frostline.llm.tokens import encoder, tokenizer_path

MAGIC = b"WMTOKEN2"
#: Positions of a chunk, the part of a plane that is unpacked at once.
CHUNK = 1 << 15


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The file of a shard: documents in order, and all their ids joined."""
    press = zstandard.ZstdCompressor(level=3).compress
    null = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    table = press(keys.tobytes() + null.tobytes() + np.asarray(lengths, "<i8").tobytes())
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    out = [MAGIC, struct.pack("<4Q", len(ids), len(doc_ids), planes, len(table)), table]
    rest = ids.astype(np.uint16) if planes <= 16 else ids
    for plane in reversed(range(planes)):
        bits = (rest >> plane) & 1 != 0
        rest = np.concatenate([rest[~bits], rest[bits]])
        packed = np.packbits(bits)
        chunks = [packed[at : at + CHUNK // 8] for at in range(0, len(packed), CHUNK // 8)]
        bodies = [press(c.tobytes()) for c in chunks]
        ones = np.cumsum([0, *(int(np.bitwise_count(c).sum()) for c in chunks)])
        starts = np.cumsum([0, *map(len, bodies)])
        out += [struct.pack("<Q", len(bits) - int(ones[-1])), ones.astype("<u4").tobytes(), starts.astype("<u4").tobytes(), *bodies]
    return b"".join(out)


class WaveletMatrix:
    """A shard file opened for reading. Planes stay compressed; `unpacked` counts the bytes that queries have unpacked."""

    def __init__(self, data: bytes, held_chunks: int = 64):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.data, self.unpacked = data, 0
        self.expand = zstandard.ZstdDecompressor().decompress
        self.n, m, planes, size = struct.unpack_from("<4Q", data, 8)
        head = self.expand(data[40 : 40 + size])
        null = np.frombuffer(head, np.uint8, m, 8 * m)
        self.doc_ids = [None if x else int(d) for d, x in zip(np.frombuffer(head, "<i8", m), null, strict=True)]
        self.lengths = np.frombuffer(head, "<i8", m, 9 * m)
        self.starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.lengths)])
        at, chunks = 40 + size, -(-self.n // CHUNK)
        self.zeros, self.before, self.bodies = [], [], []
        for _ in range(planes):
            self.zeros.append(struct.unpack_from("<Q", data, at)[0])
            counts, starts = np.frombuffer(data, "<u4", 2 * (chunks + 1), at + 8).astype(np.int64).reshape(2, -1)
            at += 8 + 8 * (chunks + 1)
            self.before.append(counts)
            self.bodies.append(at + starts)
            at += int(starts[-1])
        self.held: dict[tuple[int, int], np.ndarray] = {}
        self.held_chunks = held_chunks

    def _chunk(self, plane: int, chunk: int) -> np.ndarray:
        """The packed bits of a chunk; the last ones used are held."""
        bits = self.held.pop((plane, chunk), None)
        self.held[plane, chunk] = bits = self._unpack(plane, chunk) if bits is None else bits
        if len(self.held) > self.held_chunks:
            del self.held[next(iter(self.held))]
        return bits

    def _unpack(self, plane: int, chunk: int) -> np.ndarray:
        """The packed bits of a chunk."""
        start, stop = self.bodies[plane][chunk : chunk + 2]
        bits = np.frombuffer(self.expand(self.data[start:stop]), np.uint8)
        self.unpacked += len(bits)
        return bits

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first i positions of a plane."""
        chunk, rest = divmod(i, CHUNK)
        count = int(self.before[plane][chunk])
        if rest:
            packed = self._chunk(plane, chunk)
            count += int(np.bitwise_count(packed[: rest // 8]).sum())
            count += int(packed[rest // 8] >> (8 - rest % 8)).bit_count() if rest % 8 else 0
        return count

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) `bit` of a plane."""
        ones = self.before[plane]
        counts = ones if bit else np.minimum(np.arange(len(ones)) * CHUNK, self.n) - ones
        chunk = int(np.searchsorted(counts, k, side="right")) - 1
        bits = np.unpackbits(self._chunk(plane, chunk))
        return chunk * CHUNK + int(np.flatnonzero(bits == bit)[k - int(counts[chunk])])

    def access(self, i: int) -> int:
        """The id at position i of the shard."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane, zeros in enumerate(self.zeros):
            bit = int(self._chunk(plane, i // CHUNK)[i % CHUNK // 8]) >> (7 - i % 8) & 1
            ones = self._rank1(plane, i)
            value, i = 2 * value + bit, zeros + ones if bit else i - ones
        return value

    def _narrow(self, token: int, start: int, stop: int) -> tuple[int, int]:
        for plane, zeros in enumerate(self.zeros):
            a, b = self._rank1(plane, start), self._rank1(plane, stop)
            one = token >> (len(self.zeros) - 1 - plane) & 1
            start, stop = (zeros + a, zeros + b) if one else (start - a, stop - b)
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of an id in positions start to stop."""
        if token >> len(self.zeros):
            return 0
        first, last = self._narrow(token, start, self.n if stop is None else stop)
        return last - first

    def locate(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._narrow(token, 0, 0)[0] + k
        for plane in reversed(range(len(self.zeros))):
            bit = token >> (len(self.zeros) - 1 - plane) & 1
            at = self._select(plane, bit, at - self.zeros[plane] if bit else at)
        return at

    def tokens(self) -> np.ndarray:
        """All ids of the shard in order. From the lowest plane up, each plane tells how the two parts that the plane
        below it was made of have been dealt."""
        value = np.zeros(self.n, np.uint16 if len(self.zeros) <= 16 else np.uint32)
        for plane in reversed(range(len(self.zeros))):
            packed = [self._unpack(plane, c) for c in range(len(self.bodies[plane]) - 1)]
            ones = np.unpackbits(np.concatenate(packed), count=self.n).view(bool) if packed else np.zeros(0, bool)
            parts, zeros = value, self.zeros[plane]
            value = np.empty_like(parts)
            value[~ones] = parts[:zeros]
            value[ones] = parts[zeros:] | value.dtype.type(1 << (len(self.zeros) - 1 - plane))
        return value.astype(np.uint32)


def write_shards(
    docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, shard_tokens: int = 1 << 18
) -> DataFrame:
    """Encode docs (doc_id, text), append end_id to each, and write shard files in ascending doc_id order.

    Returns the written table (part, shard, n_tokens, file): `file` is the complete file of a shard, a row each, so that
    any store Spark writes to can hold them; part and shard order the shards. A shard ends with the document that fills
    it, so a longer text makes a shard of its own; a task holds one shard and the ids of about a megabyte of text. Null
    doc_ids come first, rows with the same doc_id are ordered by the first 32 characters of their text and then by a hash,
    and can lie in several tasks, also if very many rows are equal; a null text is empty.
    """
    path = tokenizer_path(tokenizer)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = named.withColumns({"key0": F.left("text", F.lit(32)), "key1": F.xxhash64("text"), "key2": F.monotonically_increasing_id()})
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "key0", "key1", "key2")]
    ordered = named.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, own = TaskContext.get().partitionId(), 0, encoder(path)
        keys: list[int | None] = []
        sizes, ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

        def file(m: int) -> pa.RecordBatch:
            """The first m documents as a shard."""
            n = int(sizes[:m].sum())
            data = [[part], [shard], [n], [pack(keys[:m], sizes[:m], ids[:n])]]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(data, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                ["part", "shard", "n_tokens", "file"],
            )

        for batch in slices(batches, "text", 1 << 20):
            new, lengths = own.encode([t or "" for t in batch.column("text").to_pylist()])
            keys += batch.column("doc_id").to_pylist()
            ids = np.concatenate([ids, np.insert(new, np.cumsum(lengths), end_id)])
            sizes = np.concatenate([sizes, lengths + 1])
            while len(ids) >= shard_tokens:
                m = int(np.searchsorted(np.cumsum(sizes), shard_tokens)) + 1
                yield file(m)
                keys, sizes, ids, shard = keys[m:], sizes[m:], ids[int(sizes[:m].sum()) :], shard + 1
        if keys:
            yield file(len(keys))

    return stored(ordered.mapInArrow(build, "part long, shard long, n_tokens long, file binary"), "token-files")


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shard files alone."""
    totals = files.select("part", "shard", "n_tokens")  # one row a file, of some megabytes
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", "shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, data in zip(*(batch.column(c) for c in ("part", "shard", "file")), strict=True):
                matrix = WaveletMatrix(data.as_py())
                ids, starts = matrix.tokens(), matrix.starts
                sums = [crc32_ids(ids[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                m = len(sums)
                columns = [[part.as_py()] * m, [shard.as_py()] * m, matrix.doc_ids, starts[:-1], matrix.lengths, sums]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns],
                    ["part", "shard", "doc_id", "own_start", "n_tokens", "ids_crc32"],
                )

    found = files.select("part", "shard", "file").mapInArrow(
        read, "part long, shard long, doc_id long, own_start long, n_tokens long, ids_crc32 long"
    )
    return found.join(bases, ["part", "shard"]).select(
        "doc_id", (F.col("base") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32"
    )
