"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned by token windows, hits verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline.llm import words as W
from frostline.llm.common import slices, stored, text_bytes

WINDOW = 10
#: Benchmark text that one broadcast holds; a larger benchmark is scanned in blocks of this size.
BLOCK_BYTES = 16 << 20


class WindowSet:
    """All windows of some benchmark items, for exact lookup."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        self.owners: dict[int, dict[bytes, set[str]]] = {}
        for item, text in items:
            own = _words_of(text or "")
            m = min(size, len(own))
            for i in range(len(own) - m + 1 if m else 0):
                owners = self.owners.setdefault(m, {}).setdefault(b" ".join(own[i : i + m]), set())
                if item is not None:
                    owners.add(item)
        self.hashes = {m: _hashes(list(found), m) for m, found in self.owners.items()}

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, set[str]]]:
        """For each text: number of words, the words hit, the items found."""
        data = W.LOWER[data]
        starts, ends, first = W.spans(data, offsets, W.ALPHANUMERIC)
        hashed = W.word_hashes(data, starts, ends)
        edges = np.zeros(len(starts) + 1, np.int64)
        found: dict[int, set[str]] = {}
        for m, known in self.hashes.items():
            value, at = W.windows(hashed, first, m)
            place = np.searchsorted(known, value)
            place[place == len(known)] = 0
            for i in at[known[place] == value].tolist():
                own = [data[a:b].tobytes() for a, b in zip(starts[i : i + m], ends[i : i + m], strict=True)]
                owners = self.owners[m].get(b" ".join(own))
                if owners is not None:
                    edges[i] += 1
                    edges[i + m] -= 1
                    found.setdefault(int(np.searchsorted(first, i, side="right")) - 1, set()).update(owners)
        hit = np.cumsum(edges)[:-1] > 0
        for row in range(len(offsets) - 1):
            yield int(first[row + 1] - first[row]), hit[first[row] : first[row + 1]], found.get(row, set())


def _words_of(text: str) -> list[bytes]:
    data = W.LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = W.spans(data, np.array([0, len(data)]), W.ALPHANUMERIC)
    return [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]


def _hashes(windows: list[bytes], m: int) -> np.ndarray:
    """Sorted hashes of windows given as their words joined by blanks."""
    data = np.frombuffer(b" ".join(windows), np.uint8)
    offsets = np.cumsum([0, *(len(w) + 1 for w in windows)])
    offsets[-1] = len(data)
    starts, ends, first = W.spans(data, offsets, W.ALPHANUMERIC)
    return np.sort(W.windows(W.word_hashes(data, starts, ends), first, m)[0])


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The items with text, in blocks of about block_bytes."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("text").isNotNull())
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    n = total // block_bytes + 1
    return [items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def mark_hits(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], size: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The kept columns of docs (with a column text) as struct `row`, with n_words, hits (a byte 0 or 1 for each word)
    and items (ids of the items with occurring windows).

    Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. A benchmark item gives windows of
    `size` consecutive words; one with fewer words, but not none, is one window. A hash match counts only when the words
    are equal. The benchmark is broadcast in blocks of about block_bytes of text; with more than one block the state is
    stored between them, so a benchmark of any size is scanned whole with bounded memory.

    Null and empty texts have no words and no hits. An item without id marks words but is not listed. Repeated rows are
    judged row by row; nothing is shuffled.
    """
    spark = docs.sparkSession
    state = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.lit(0).cast("long").alias("n_words"),
        F.lit(None).cast("binary").alias("hits"),
        F.array().cast("array<string>").alias("items"),
    )
    blocks = _blocks(benchmark, block_bytes)
    kept = docs.select(F.struct(*keep).alias("row")).schema["row"].dataType
    for k, items in enumerate(blocks):
        shared = spark.sparkContext.broadcast(WindowSet([(r.item_id, r.text) for r in items.toLocalIterator()], size))
        if k:
            state = stored(state, "contamination")
        last = k == len(blocks) - 1
        row = T.StructField("row", kept) if last else state.schema["row"]
        schema = T.StructType([row, *state.schema.fields[1:]])
        state = state.mapInArrow(_scanner(shared, k, keep if last else docs.columns), schema)
    return state


def _scanner(shared, k: int, keep: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            row = batch.column("row")
            flat = pa.RecordBatch.from_arrays(row.flatten(), [f.name for f in row.type])
            flat = flat.append_column("_hits", batch.column("hits")).append_column("_items", batch.column("items"))
            for piece in slices(iter([flat]), "text", 1 << 20):
                found = list(windows.scan(*text_bytes(piece.column("text"))))
                hits, items = [r[1].astype(np.uint8) for r in found], [r[2] for r in found]
                if k:
                    before = [np.frombuffer(h, np.uint8) for h in piece.column("_hits").to_pylist()]
                    hits = [h | old for h, old in zip(hits, before, strict=True)]
                    items = [i.union(old) for i, old in zip(items, piece.column("_items").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.StructArray.from_arrays([piece.column(c) for c in keep], keep),
                        pa.array([r[0] for r in found], pa.int64()),
                        pa.array([h.tobytes() for h in hits], pa.binary()),
                        pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                    ],
                    ["row", "n_words", "hits", "items"],
                )

    return scan


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of docs (doc_id, text).

    items_sha256 is the SHA-256 of the ids of the items found, sorted as text and joined by commas.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = mark_hits(own, benchmark, ["doc_id"], size, block_bytes)
    return _digest(marked)


def _digest(marked: DataFrame) -> DataFrame:
    n_hit = F.octet_length(F.translate(F.hex("hits"), "0", "")).cast("long")  # a hit word is the byte 01
    return marked.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def remove_hits(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", size: int = WINDOW) -> DataFrame:
    """docs without benchmark passages, all columns kept.

    mode `documents` drops every row with a hit; mode `spans` keeps all rows and cuts each run of hit words out of the
    text. Null texts stay as they are.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(mode)
    marked = mark_hits(docs, benchmark, docs.columns, size)
    if mode == "documents":
        return marked.where(F.octet_length(F.translate(F.hex("hits"), "0", "")) == 0).select("row.*")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            text = row.field("text")
            new = [
                t if t is None or not any(h) else _without(t, np.frombuffer(h, np.uint8) > 0)
                for t, h in zip(text.to_pylist(), batch.column("hits").to_pylist(), strict=True)
            ]
            names = [f.name for f in row.type]
            columns = [pa.array(new, text.type) if n == "text" else row.field(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return marked.select("row", "hits").mapInArrow(cut, docs.schema)


def _without(text: str, hit: np.ndarray) -> str:
    data = text.encode()
    low = W.LOWER[np.frombuffer(data, np.uint8)]
    starts, ends, _ = W.spans(low, np.array([0, len(low)]), W.ALPHANUMERIC)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    at, out = 0, []
    for a, b in edges.reshape(-1, 2):
        out.append(data[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, data[at:]]).decode()
