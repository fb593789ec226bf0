"""Long repeated passages by a logarithmic family of sparse suffix arrays.

Documents come in batches of ascending doc_id. A batch gives sorted arrays of suffix fingerprints, cut by key range; for
each range the arrays of all batches meet in one place, where a family of sorted levels is kept: a new array is
merge-scanned against every level, what it adds becomes a level, and levels of equal size merge, so a range has few
levels and an entry moves a logarithmic number of times. Each batch gets back one bit per entry.

The suffixes are those at minimizers: every window of 50 bytes has a smallest 26-byte gram, and windows in a row with the
same one form a run. Four scans go from runs to single windows, each over what the ones before have left open:
 1. grams of all runs: a run whose gram is in no other document cannot repeat;
 2. whole runs: one found in an earlier document is covered, and its windows are known from there;
 3. grams of the runs still open: again those of one document alone are done;
 4. the windows of the rest.
Fingerprints have 64 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm import words as W
from frostline.llm.common import slices, text_bytes

_U = np.uint64
LENGTH = 50
GRAM = 26
SCANS = 4
_SENT = "bucket int, batch int, scan int, data binary"
_SENT_NAMES = [f.split()[0] for f in _SENT.split(", ")]
_SLICE = 1 << 18


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of `width` values from each position on."""
    out, done = values.copy(), 1
    while done < width:
        step = min(done, width - done)
        np.minimum(out[:-step], out[step:], out=out[:-step])
        done += step
    return out


def _hashes(sums: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return W.mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start and end of every run of windows, the fingerprints of its gram and of all its bytes."""
    sums, down = W.prefix_sums(data)
    n = max(0, len(data) - GRAM + 1)
    gram = W.mix((sums[GRAM:] - sums[:n]) * down[:n])
    low = _least((gram & _U(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64), LENGTH - GRAM + 1)
    outside = np.zeros(len(data) + 1, np.int32)  # positions whose window would leave the text
    np.add.at(outside, np.maximum(offsets[:-1], offsets[1:] - LENGTH + 1), 1)
    np.add.at(outside, offsets[1:], -1)
    windows = np.flatnonzero(np.cumsum(outside[:-1]) == 0)
    anchor = (low[windows] & _U(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(windows, prepend=-2) != 1))
    start, end = windows[new], windows[np.append(new[1:], len(windows))[: len(new)] - 1] + LENGTH
    return start, end, gram[anchor[new]], _hashes(sums, down, start, end)


class Scan:
    """A batch of texts and what is known of its runs from the bits of earlier scans."""

    def __init__(self, batch: pa.Table, bits: dict[int, dict[int, bytes]], shift: int):
        self.shift, self.bits = shift, bits
        ids = batch.column("doc_id").to_pandas()
        order = np.argsort(ids.fillna(np.iinfo(np.int64).max).to_numpy(), kind="stable")
        self.rows = batch.take(pa.array(order)).combine_chunks()
        ids = ids.iloc[order]
        # Rows of one doc_id share a number; those without one come last and share one too.
        self.order = pd.factorize(ids, use_na_sentinel=False)[0]
        pieces = self.rows.select(["doc_id", "text"]).to_batches()
        self.parts = [text_bytes(p.column("text")) for p in slices(iter(pieces), "text", _SLICE)]
        sizes = [len(p[0]) for p in self.parts]
        self.base = np.cumsum([0, *sizes])
        found = [_runs(*p) for p in self.parts]
        join = lambda k: np.concatenate([f[k] + b if k < 2 else f[k] for f, b in zip(found, self.base, strict=False)])
        self.start, self.end, self.gram, self.whole = (join(k) for k in range(4)) if found else [np.zeros(0, np.int64)] * 4
        lengths = np.concatenate([np.diff(p[1]) for p in self.parts]) if found else np.zeros(0, np.int64)
        self.offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        self.row = np.searchsorted(self.offsets, self.start, side="right") - 1

    def _known(self, scan: int, keys: np.ndarray) -> np.ndarray:
        """The bits of a scan for sorted distinct keys."""
        buckets, counts = np.unique(keys >> _U(self.shift) if self.shift < 64 else keys * _U(0), return_counts=True)
        got = self.bits.get(scan, {})
        parts = [np.unpackbits(np.frombuffer(got[b], np.uint8), count=n) for b, n in zip(buckets.tolist(), counts.tolist(), strict=True)]
        return np.concatenate([np.zeros(0, np.uint8), *parts]).astype(bool)

    def _judge(self, scan: int, keys: np.ndarray, order: np.ndarray, earlier: bool) -> np.ndarray:
        """For every occurrence: is its key in an earlier document, or else in any other document?"""
        distinct, at = np.unique(keys, return_inverse=True)
        first = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(first, at, order)
        known = self._known(scan, distinct)
        if earlier:
            return known[at] | (order > first[at])
        last = np.zeros(len(distinct), np.int64)
        np.maximum.at(last, at, order)
        return (known | (last > first))[at]

    def entries(self, scan: int) -> np.ndarray:
        """The sorted distinct keys that a scan compares."""
        keys, order, self.covered = self.gram, self.order[self.row], (self.start[:0], self.end[:0])
        if scan == 1:
            return np.unique(keys)
        open_ = np.flatnonzero(self._judge(1, keys, order, earlier=False))
        if scan == 2:
            return np.unique(self.whole[open_])
        done = self._judge(2, self.whole[open_], order[open_], earlier=True)
        self.covered = self.start[open_[done]], self.end[open_[done]]
        open_ = open_[~done]
        if scan == 3:
            return np.unique(keys[open_])
        open_ = open_[self._judge(3, keys[open_], order[open_], earlier=False)]
        counts = self.end[open_] - self.start[open_] - LENGTH + 1
        windows = np.repeat(self.start[open_] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        value = np.zeros(len(windows), np.uint64)
        part = np.searchsorted(self.base, windows, side="right") - 1
        for k in np.unique(part).tolist():
            mine = part == k
            at = windows[mine] - self.base[k]
            value[mine] = _hashes(*W.prefix_sums(self.parts[k][0]), at, at + LENGTH)
        if scan == 4:
            return np.unique(value)
        hit = windows[self._judge(4, value, np.repeat(order[open_], counts), earlier=True)]
        self.covered = np.append(self.covered[0], hit), np.append(self.covered[1], hit + LENGTH)
        return np.zeros(0, np.uint64)

    def results(self, with_kept: bool) -> pa.Table:
        """The table of results: removed bytes are those covered after all scans."""
        self.entries(SCANS + 1)
        edges = np.zeros(self.base[-1] + 1, np.int32)
        np.add.at(edges, self.covered[0], 1)
        np.add.at(edges, self.covered[1], -1)
        gone = np.cumsum(edges[:-1]) > 0
        data = np.concatenate([np.zeros(0, np.uint8), *(p[0] for p in self.parts)])
        rows = []
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            own = gone[a:b]
            kept = data[a:b][~own].tobytes()
            runs = int(np.count_nonzero(own[1:] & ~own[:-1])) + int(b > a and own[0])
            rows.append((b - a, int(own.sum()), runs, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
        columns = [self.rows.column("doc_id").combine_chunks()]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        columns += [pa.array([r[k] for r in rows], kinds[k]) for k in range(5 if with_kept else 4)]
        return pa.Table.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(columns)])


def squeeze(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed differences, byte by byte of their weight."""
    steps = np.diff(keys, prepend=_U(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


class Family:
    """Sorted levels of keys, each at least twice as large as the next."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Which of the sorted distinct keys are in a level already; the others become a level, and levels merge."""
        found = np.zeros(len(keys), bool)
        for level in self.levels:
            at = np.searchsorted(level, keys)
            found |= level[np.minimum(at, len(level) - 1)] == keys
        new = keys[~found]
        while len(new) and self.levels and len(self.levels[-1]) < 2 * len(new):
            new = np.sort(np.concatenate([self.levels.pop(), new]), kind="stable")
        if len(new):
            self.levels.append(new)
        return found


def _meet(scan: int, earlier: bool) -> Callable[[pa.Table], pa.Table]:
    """The arrays of one key range, batch by batch; bits of earlier scans, in ranges below 0, pass through."""

    def meet(sent: pa.Table) -> pa.Table:
        if sent.column("bucket")[0].as_py() < 0:
            return sent.set_column(0, "bucket", pa.array([-1 - b for b in sent.column("bucket").to_pylist()], pa.int32()))
        sent = sent.sort_by("batch")
        family, shared, arrays, bits = Family(), [], [], []
        for data in sent.column("data").to_pylist():
            keys = unsqueeze(data)
            found = family.add(keys)
            if earlier:
                bits.append(found)
            else:
                arrays.append(keys)
                shared.append(keys[found])
        if not earlier:
            both = np.unique(np.concatenate(shared))
            for keys in arrays:
                at = np.minimum(np.searchsorted(both, keys), max(0, len(both) - 1))
                bits.append(both[at] == keys if len(both) else np.zeros(len(keys), bool))
        return sent.set_column(3, "data", pa.array([np.packbits(b).tobytes() for b in bits], pa.binary()))

    return meet


def _bits(sent: pa.Table) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {}
    for row in sent.to_pylist():
        out.setdefault(row["scan"], {})[row["bucket"]] = row["data"]
    return out


def find_repeats(
    docs: DataFrame, with_kept: bool = False, batch_bytes: int = 8 << 20, most_batches: int = 4096, range_bytes: int = 2 << 30
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs (doc_id, text); kept (binary) on demand.

    A byte is removed if some 50-byte string over it also starts in a document with a smaller doc_id. Texts are shuffled
    once, to their batches, and every scan reads that shuffle again; what moves beside it are compressed fingerprints one
    way and a bit for each the other way. A very frequent passage costs one entry for each batch it occurs in. Batches
    hold about batch_bytes, or total / most_batches if that is more; key ranges about range_bytes of text each, and not
    fewer than the session's shuffle partitions.

    A null text is empty. Rows of one doc_id do not remove each other's bytes; rows without doc_id count as larger than
    all and do not remove each other's bytes either. An empty table gives no rows.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    n = max(1, min(most_batches, math.ceil(total / batch_bytes)))
    cuts = own.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n).alias("q")).first()["q"] if n > 1 else []
    bounds = np.unique(np.array(cuts or [], np.int64))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / range_bytes))
    width = max(0, math.ceil(math.log2(ranges)))
    shift = 64 - width

    @F.pandas_udf("int")
    def batch_of(ids: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, ids.fillna(0).to_numpy().astype(np.int64), side="left")
        return pd.Series(np.where(ids.isna(), len(bounds) + 1, at).astype(np.int32))

    texts = own.withColumn("batch", batch_of("doc_id")).repartition("batch")

    def entries(scan: int, batch: pa.Table, bits: pa.Table | None) -> pa.Table:
        number = batch.column("batch")[0].as_py()
        keys = Scan(batch, _bits(bits) if bits is not None else {}, shift).entries(scan)
        found, starts = np.unique(keys >> _U(shift) if shift < 64 else keys * _U(0), return_index=True)
        parts = [squeeze(k) for k in np.split(keys, starts[1:])] if len(keys) else []
        columns = [found.astype(np.int32), [number] * len(parts), [scan] * len(parts), parts]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
        out = pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _SENT_NAMES)
        if bits is None:
            return out
        back = pa.array([-1 - b for b in bits.column("bucket").to_pylist()], pa.int32())
        return pa.concat_tables([out, bits.set_column(0, "bucket", back)])

    def first(batch: pa.Table) -> pa.Table:
        return entries(1, batch, None)

    def later(scan: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        return lambda batch, bits: entries(scan, batch, bits)

    by_batch = texts.groupBy("batch")
    known = by_batch.applyInArrow(first, _SENT).groupBy("bucket").applyInArrow(_meet(1, earlier=False), _SENT)
    for scan in range(2, SCANS + 1):
        sent = by_batch.cogroup(known.groupBy("batch")).applyInArrow(later(scan), _SENT)
        known = sent.groupBy("bucket").applyInArrow(_meet(scan, earlier=scan % 2 == 0), _SENT)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    last = lambda a, b: Scan(a, _bits(b), shift).results(with_kept)
    return by_batch.cogroup(known.groupBy("batch")).applyInArrow(last, schema)
