"""Ranked lexical search by presence masks.

One scan writes an index: blocks of some thousand documents with their lengths and, for every query term, the documents
of the block that hold it. Collection figures (documents, terms, documents of each term) are sums over the blocks. Then
each block is searched for each item. A document's mask tells which of the item's terms it holds; bitmaps of the terms
are turned into masks, and documents are grouped by them. No document scores more than its mask allows, which is the sum
of the block's best contribution of each term, so masks are opened from the highest such maximum down, and the search of
the block ends at the first mask that cannot reach the worst of the documents kept so far.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from frostline.llm.common import byte_pieces, slices, stored
from frostline.llm.words import ALPHANUMERIC, LOWER

#: Everything but letters, digits and bytes beyond ASCII becomes a blank; A-Z become a-z.
_TERM_BYTES = bytes(LOWER[b] if ALPHANUMERIC[LOWER[b]] else 32 for b in range(256))
INDEX = "block long, n_docs long, doc_ids binary, no_id binary, lengths binary, terms binary, counts binary, places binary, times binary"


def term_counts(text: str | None) -> Counter:
    """The terms of a text, as lower-case bytes, and how often each occurs. A long text is taken in pieces."""
    counts: Counter = Counter()
    for piece in byte_pieces((text or "").encode().translate(_TERM_BYTES)):
        counts.update(piece.split())
    return counts


def item_terms(items: DataFrame) -> DataFrame:
    """item (a number of its own for every item_id), item_id, term, times: the terms of items (item_id, text), stored.

    Rows with the same item_id are one item, and so are rows without one.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            for item_id, text in zip(batch.column("item_id"), batch.column("text").to_pylist(), strict=True):
                found = term_counts(text)
                columns = [
                    pa.array([item_id.as_py()] * len(found), batch.schema.field("item_id").type),
                    pa.array(list(found), pa.binary()),
                    pa.array(list(found.values()), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "term", "times"])

    kind = items.schema["item_id"].dataType.simpleString()
    terms = items.select("item_id", "text").mapInArrow(count, f"item_id {kind}, term binary, times long")
    return stored(terms.groupBy("item_id", "term").agg(F.sum("times").alias("times")), "item-terms")


def build_index(docs: DataFrame, terms: list[bytes], block_docs: int = 4096) -> DataFrame:
    """Blocks of docs (doc_id, text) with the postings of `terms`, a row each, as a stored table.

    Arrays of a row are binary: doc_id and whether it is null, terms in each document; the numbers of the terms that occur
    (places in `terms`), how many documents of the block hold each, and those documents with the term's occurrences.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = {term: i for i, term in enumerate(terms)}
        part, block = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        lengths: list[int] = []
        term, place, times = [], [], []  # a posting in each position

        def flush() -> pa.RecordBatch:
            at, docs_at, n = np.array(term, np.int32), np.array(place, np.int32), np.array(times, np.int64)
            order = np.argsort(at, kind="stable")
            have, counts = np.unique(at, return_counts=True)
            row = [
                np.array([d or 0 for d in ids], np.int64),
                np.array([d is None for d in ids], bool),
                np.array(lengths, np.int64),
                have,
                counts.astype(np.int32),
                docs_at[order],
                n[order],
            ]
            arrays = [pa.array([(part << 32) + block]), pa.array([len(ids)]), *(pa.array([x.tobytes()], pa.binary()) for x in row)]
            return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in INDEX.split(", ")])

        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = term_counts(text)
                for word in found.keys() & number.keys():
                    term.append(number[word])
                    place.append(len(ids))
                    times.append(found[word])
                ids.append(doc_id)
                lengths.append(found.total())
                if len(ids) == block_docs:
                    yield flush()
                    ids, lengths, term, place, times, block = [], [], [], [], [], block + 1
        if ids:
            yield flush()

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(chosen.mapInArrow(index, INDEX), "search-index")


def collection_figures(index: DataFrame) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, all their terms, and for each query term the documents that hold it."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = Counter(), 0, 0
        for row in _rows(batches):
            lengths = np.frombuffer(row["lengths"], np.int64)
            n, size = n + int(np.count_nonzero(lengths)), size + int(lengths.sum())
            held.update(dict(zip(np.frombuffer(row["terms"], np.int32).tolist(), np.frombuffer(row["counts"], np.int32).tolist(), strict=True)))
        sums = [*held.items(), (-1, n), (-2, size)]
        yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in sums], pa.int64()) for i in (0, 1)], ["term", "n"])

    sums = index.select("lengths", "terms", "counts").mapInArrow(add_up, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r.term: r.n for r in sums.collect()}  # a row for each query term of the block of items
    return found.pop(-1, 0), found.pop(-2, 0), found


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


class Block:
    """A block of the index, opened: what each posting contributes to the score of its document."""

    def __init__(self, row: dict, weights: np.ndarray, n_all: int, size_all: int):
        self.n = row["n_docs"]
        self.ids = np.frombuffer(row["doc_ids"], np.int64)
        self.no_id = np.frombuffer(row["no_id"], bool)
        lengths = np.frombuffer(row["lengths"], np.int64)
        terms, counts = (np.frombuffer(row[c], np.int32) for c in ("terms", "counts"))
        self.places = np.frombuffer(row["places"], np.int32)
        times = np.frombuffer(row["times"], np.int64)
        self.ends = np.cumsum(counts, dtype=np.int64)
        self.starts = self.ends - counts
        self.slot = {t: i for i, t in enumerate(terms.tolist())}
        m = 25 + (75 * lengths * n_all) // max(size_all, 1)
        self.points = np.repeat(weights[terms], counts) * ((1_000_000_000 * times) // (1000 * times + 8 * m[self.places]))
        self.most = np.maximum.reduceat(self.points, self.starts) if len(terms) else self.points
        self.scored = 0  # documents whose mask was opened

    def search(self, terms: list[int], times: np.ndarray, floor: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the documents that may be among the best `limit`; those below `floor` may be left out."""
        known = [(self.slot[t], k) for t, k in zip(terms, times.tolist(), strict=True) if t in self.slot]
        none = np.zeros(0, np.int64)
        if not known:
            return none, none
        slots, repeats = (np.array(x, np.int64) for x in zip(*known, strict=True))
        sizes = self.ends[slots] - self.starts[slots]
        own = np.repeat(self.starts[slots] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        places, row = self.places[own], np.repeat(np.arange(len(slots)), sizes)

        bitmaps = np.zeros((-(-len(slots) // 64) * 64, self.n), bool)  # a row a term, a column a document
        bitmaps[row, places] = True
        masks = np.packbits(bitmaps, axis=0, bitorder="little").T.copy().view(np.uint64)
        group = np.unique(masks[:, 0], return_inverse=True)[1]
        for k in range(1, masks.shape[1]):
            other, inverse = np.unique(masks[:, k], return_inverse=True)
            group = np.unique(group * len(other) + inverse, return_inverse=True)[1]
        first = np.zeros(group.max() + 1, np.int64)
        first[group] = np.arange(self.n)
        most = self.most[slots] * repeats @ bitmaps[: len(slots), first].astype(np.int64)  # what a mask allows

        best_first = np.argsort(-most, kind="stable")
        most = most[best_first]
        rank = np.empty_like(best_first)
        rank[best_first] = np.arange(len(best_first))
        opens_at = rank[group]  # of each document, when its mask is opened
        points = self.points[own] * repeats[row]
        kept, scores, opened, step = none, none, 0, 16
        floor = max(floor, 1)
        while opened < (able := int(np.searchsorted(-most, -floor, side="right"))):
            upto = min(able, opened + step)
            chosen = (opens_at >= opened) & (opens_at < upto)
            self.scored += int(np.count_nonzero(chosen))
            use = chosen[places]
            total = np.zeros(self.n, np.int64)
            np.add.at(total, places[use], points[use])
            found = np.flatnonzero(chosen & (total >= floor))
            kept, scores = np.concatenate([kept, found]), np.concatenate([scores, total[found]])
            if len(scores) >= limit:
                floor = max(floor, int(np.partition(scores, -limit)[-limit]))
                kept, scores = kept[scores >= floor], scores[scores >= floor]
            opened, step = upto, step * 2
        return kept, scores


def _best(found: list[tuple], limit: int) -> list[tuple]:
    """The first `limit` of (-score, has no id, id)."""
    return sorted(found)[:limit]


def _search_items(
    index: DataFrame, items: list[tuple[list[int], np.ndarray]], weights: np.ndarray, figures: tuple[int, int], limit: int
) -> DataFrame:
    """item, doc_id, score: for each task of the index the best `limit` documents of each item."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in items]
        for row in _rows(batches):
            block = Block(row, weights, *figures)
            for i, (terms, times) in enumerate(items):
                floor = -best[i][-1][0] if len(best[i]) == limit else 1
                places, scores = block.search(terms, times, floor, limit)
                if len(places):
                    new = zip((-scores).tolist(), block.no_id[places].tolist(), block.ids[places].tolist(), strict=True)
                    best[i] = _best([*best[i], *new], limit)
        found = [(i, None if none else doc, -less) for i, own in enumerate(best) for less, none, doc in own]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], ["item", "doc_id", "score"])

    return index.mapInArrow(search, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, limit: int = 10, block_bytes: int = 8 << 20, block_docs: int = 4096) -> DataFrame:
    """item_id, rank, doc_id, score: the best `limit` documents of docs (doc_id, text) for each of items (item_id, text).

    A term is a run of letters, digits and characters beyond ASCII, A-Z in lower case. A term of df of the N documents
    with a term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))); tf occurrences in a document of n of all L terms add
    w * (10^9 tf div (1000 tf + 8 m)), m = 25 + (75 n N) div L, for each time the term is in the item. Only scores above
    0 are returned, equal ones in the order of doc_id (null last).

    Items are dealt to blocks by a hash so that the distinct terms of a block take about `block_bytes` at most (a single
    item's always stay together); each block is one scan of docs, and only its terms are sent to all tasks. A task keeps
    `limit` documents an item. Null or empty texts have no terms: such documents are not counted, such items get no rows.
    Repeated rows and rows with the same doc_id are documents of their own. Empty tables give no rows.
    """
    spark = docs.sparkSession
    terms = item_terms(items)
    size = terms.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    kind = items.schema["item_id"].dataType
    blocks = -(-size // block_bytes)
    found = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    for k in range(blocks):
        own: dict = {}
        for r in terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect():
            own.setdefault(r.item_id, []).append((bytes(r.term), r.times))
        if not own:
            continue
        words = sorted({word for held in own.values() for word, _ in held})
        number = {word: i for i, word in enumerate(words)}
        lists = [([number[w] for w, _ in held], np.array([n for _, n in held], np.int64)) for held in own.values()]
        index = build_index(docs, words, block_docs)
        n_all, size_all, held = collection_figures(index)
        df = np.array([held.get(i, 0) for i in range(len(words))], np.int64)
        weights = np.floor(1000 * np.log((2 * n_all + 2) / (2 * df + 1))).astype(np.int64)
        best = _search_items(index, lists, weights, (n_all, size_all), limit)
        top = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = best.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= limit)
        names = spark.createDataFrame([(i, name) for i, name in enumerate(own)], StructType().add("item", "long").add("item_id", kind))
        part = ranked.join(F.broadcast(names), "item")  # the items of this block, whose size is bounded
        found = found.union(part.select("item_id", "rank", "doc_id", "score"))
    return found


ORACLE = r"""
with terms as (
  select doc_id, row_no, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select *, row_number() over () as row_no from documents)),
item_terms as (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
sizes as (select row_no, any_value(doc_id) as doc_id, count(*) as n from terms group by row_no),
figures as (select count(*) as n_all, sum(n)::bigint as size_all from sizes),
wanted as (select item_id, term, count(*) as times from item_terms group by all),
tf as (select row_no, term, count(*) as tf from terms where term in (select term from wanted) group by all),
df as (select term, count(*) as df from tf group by term),
weights as (select term, floor(1000 * ln((2 * n_all + 2)::double / (2 * df + 1)::double))::bigint as w from df, figures),
scored as (
  select item_id, s.doc_id, s.row_no, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_all) // size_all))))::bigint as score
  from wanted join weights using (term) join tf using (term) join sizes s using (row_no), figures group by all),
ranked as (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""
