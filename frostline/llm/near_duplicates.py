"""MinHash near-duplicates by a multi-index Hamming join: signatures are split by pigeonhole and chunk errors enumerated.

A signature has `chunks` chunks of `slots` b-bit minima. Two signatures that differ in at most
chunks * (errors + 1) - 1 slots agree in some chunk up to `errors` slots, so they share a key among those that leave out
every choice of `errors` slots of every chunk. With the defaults (48 minima, 12 chunks, one error) that holds for every
distance up to 23. Each minimum differs with probability 1 - similarity, so two sets of similarity 0.75 have distance 12
in the mean; a pair at 0.75 exactly shares no key with probability 1e-7, and is farther apart than the threshold
`max_distance` with probability 2e-7. Pairs up to the threshold are compared on their full sets, and a link is given out
after a comparison of the shingles themselves. Pairs are never given out one by one: what leaves a task is at most one
row less than it holds nodes, enough to join those that belong together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm import words as W
from frostline.llm.common import slices, stored
from frostline.llm.components import components

_U = np.uint64


@dataclass(frozen=True)
class Params:
    shingle: int = 5
    percent: int = 75
    chunks: int = 12
    slots: int = 4
    errors: int = 1
    #: Slots that the signatures of a link may differ in, and those of the pairs that are checked first.
    max_distance: int = 28
    first_distance: int = 20
    #: Nodes of a block of a key, which are compared by their small signatures.
    signed_block: int = 2048
    #: Nodes and shingles of a block of a cluster, and partners of one document checked in one task.
    block: int = 512
    block_shingles: int = 1_000_000
    partners: int = 2000
    #: Documents for each file of the small intermediate tables.
    file_rows: int = 20_000
    #: Larger tables than this are joined by shuffle rather than broadcast.
    broadcast_rows: int = 500_000

    @property
    def minima(self) -> int:
        return self.chunks * self.slots

    @property
    def left_out(self) -> list[tuple[int, ...]]:
        """The choices of slots of a chunk that a key leaves out."""
        return list(combinations(range(self.slots), self.errors))

    @property
    def tag_bits(self) -> int:
        return (self.chunks * len(self.left_out) - 1).bit_length()


#: White space becomes a blank, A-Z become a-z.
_WORD_BYTES = bytes(W.LOWER[b] if W.SPACED[b] else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


def real_shingles(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves; fewer words, but not none, are one."""
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size)), strict=False))


def shingle_rows(texts: list[list[bytes]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each list of words as 64-bit values, and the list of each, in this order."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(texts)), np.uint64, int(first[-1]))
    length = np.minimum(n, size)
    value, row = [], []
    for own in range(1, size + 1):  # texts with fewer words than a shingle have a window of their own length
        texts_here = np.flatnonzero(length == own)
        count = n[texts_here] - own + 1
        at = np.repeat(first[texts_here] - np.cumsum(count) + count, count) + np.arange(count.sum())
        hashed = np.full(len(at), _U(own))
        for k in range(own):
            hashed = W.mix(hashed * _U(0x9E3779B97F4A7C15) + words[at + k])
        value.append(hashed)
        row.append(np.repeat(texts_here, count))
    value, row = np.concatenate(value), np.concatenate(row)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], row[new]


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """rid, n_shingles, words_a and words_b (128 bits of the SHA-256 of all words), signature, for rows of docs (rid, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.Generator(np.random.PCG64(75))
        scale = random.integers(1 << 62, 1 << 63, p.minima, dtype=np.uint64) * _U(2) + _U(1)
        shift = random.integers(0, 1 << 63, p.minima, dtype=np.uint64)
        for batch in slices(batches, "text", 1 << 20):
            texts = [words_of(t) for t in batch.column("text").to_pylist()]
            prints = np.frombuffer(b"".join(hashlib.sha256(b" ".join(t)).digest()[:16] for t in texts), np.int64)
            value, row = shingle_rows(texts, p.shingle)
            have, starts = np.unique(row, return_index=True)
            minima = np.zeros((batch.num_rows, p.minima), np.uint16)
            if len(have):
                for j in range(p.minima):
                    minima[have, j] = np.minimum.reduceat(value * scale[j] + shift[j], starts) >> _U(48)
            columns = [
                batch.column("rid"),
                pa.array(np.bincount(row, minlength=batch.num_rows), pa.int64()),
                pa.array(prints[::2]),
                pa.array(prints[1::2]),
                pa.array([m.tobytes() for m in minima], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "n_shingles", "words_a", "words_b", "signature"])

    schema = "rid long, n_shingles long, words_a long, words_b long, signature binary"
    return docs.select("rid", "text").mapInArrow(sign, schema)


def chunk_keys(nodes: DataFrame, p: Params) -> DataFrame:
    """key, node: a key for every chunk of a signature and every choice of `errors` slots to leave out.

    The lowest bits of a key number the chunk and the choice.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            minima = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(n, p.chunks, p.slots)
            found = []
            for chunk in range(p.chunks):
                for k, left_out in enumerate(p.left_out):
                    tag = chunk * len(p.left_out) + k
                    key = np.full(n, _U(tag))
                    for slot in set(range(p.slots)).difference(left_out):
                        key = W.mix(key * _U(0x9E3779B97F4A7C15) + minima[:, chunk, slot])
                    found.append((key << _U(p.tag_bits) | _U(tag)).view(np.int64))
            for key in found:
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("node")], ["key", "node"])

    return nodes.select("node", "signature").mapInArrow(keys, "key long, node long")


def _promising(pairs: DataFrame, nodes: DataFrame, p: Params) -> DataFrame:
    """The distinct pairs (hub, node) that are worth a look before all others: near by signature, and similar in size.

    Which pairs these are only decides what cross_links still has to do; it leaves out none.
    """
    one = nodes.select("node", F.col("n_shingles").alias("n"), "signature")
    hub = nodes.select(F.col("node").alias("hub"), F.col("n_shingles").alias("hub_n"), F.col("signature").alias("hub_signature"))
    both = pairs.distinct().join(one, "node").join(hub, "hub")
    both = both.where(F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * p.percent)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, p.minima) for c in ("signature", "hub_signature"))
            yield batch.select(["hub", "node"]).filter(pa.array((x != y).sum(axis=1) <= p.first_distance))

    return both.select("hub", "node", "signature", "hub_signature").mapInArrow(near, "hub long, node long")


def _linked(same: int, n: int, m: int, p: Params) -> bool:
    return same > 0 and 100 * same >= p.percent * (n + m - same)


def confirmed(pairs: DataFrame, docs: DataFrame, p: Params, files: int) -> DataFrame:
    """The pairs (hub, node) that are links on their real shingle sets, as a stored table (a, b).

    Texts go to the hubs they are compared with. A hub with many partners is split: its text goes to each part. A task
    holds one hub's set and reads partners one by one.
    """
    pairs = stored(pairs, "pairs", files)
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / p.partners).alias("parts"))
    split = pairs.join(parts, "hub").withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    split = stored(split.select("hub", "node", "part"), "split-pairs", files)
    sides = split.select(F.col("node").alias("rid"), "hub", "part", F.lit(1).alias("side")).union(
        split.select(F.col("hub").alias("rid"), "hub", "part", F.lit(0)).distinct()
    )
    sides = stored(sides, "pair-sides", files)
    few = sides.count() <= p.broadcast_rows
    placed = (
        docs.select("rid", "text")
        .join(F.broadcast(sides) if few else sides, "rid")
        .repartition("hub", "part")
        .sortWithinPartitions("hub", "part", "side")
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, set()
        for batch in slices(batches, "text", 1 << 20):
            found = []
            for hub, part, side, rid, text in zip(*(batch.column(c).to_pylist() for c in _SIDE), strict=True):
                own = real_shingles(words_of(text), p.shingle)
                if side == 0:
                    at, held = (hub, part), own
                elif at == (hub, part) and _linked(len(own & held), len(own), len(held), p):
                    found.append((hub, rid))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"]
            )

    return stored(placed.select(*_SIDE).mapInArrow(check, "a long, b long"), "links")


_SIDE = ["hub", "part", "side", "rid", "text"]


def _open_keys(keyed: DataFrame, labels: DataFrame, files: int) -> DataFrame:
    """key, node, component, of keys whose nodes are not all in one component yet."""
    known = keyed.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    open_ = (
        known.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
        .where("low != high")
        .select("key", "size")
    )
    return stored(known.join(open_, "key"), "open-keys", files)


def _merged(labels: DataFrame, links: DataFrame, files: int) -> DataFrame:
    """labels (node, component) after adding links (a, b) between nodes."""
    label = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
    between = (
        links.join(label("a"), "a", "left")
        .join(label("b"), "b", "left")
        .select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
        .where("a != b")
    )
    joined = components(between, files)
    renamed = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
    moved = labels.join(renamed, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    fresh = joined.join(labels.select("node"), "node", "left_anti")
    return stored(moved.union(fresh), "components", files)


_SIGNED = ["key", "i", "j", "own", "node", "component", "n_shingles", "signature"]


def _near_stars(rows: pa.Table, p: Params) -> list[tuple[int, int]]:
    """Stars (a, b) of what pairs that are near by signature join, between two blocks of a key or within one.

    Only pairs of different components and of similar size count. Nodes that they join are given out with the smallest of
    them, so most pairs of a dense group need not be looked at, and keys with the same nodes give the same rows.
    """
    node, part, own, n = (rows.column(c).to_numpy() for c in ("node", "component", "own", "n_shingles"))
    minima = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint16).reshape(-1, p.minima)
    first, second = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    other_side = np.where(own == first, second, first)
    group = np.arange(len(node))
    for a in np.flatnonzero(own == first).tolist():
        able = (own == other_side[a]) & (part != part[a]) & (group != group[a])
        able &= np.minimum(n, n[a]) * 100 >= np.maximum(n, n[a]) * p.percent
        b = np.flatnonzero(able)
        for c in b[(minima[b] != minima[a]).sum(axis=1) <= p.max_distance].tolist():
            if group[c] != group[a]:
                group[group == group[c]] = group[a]
    least = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(least, group, node)
    return [(a, b) for a, b in zip(least[group].tolist(), node.tolist(), strict=True) if a != b]


def near_clusters(opened: DataFrame, nodes: DataFrame, p: Params, files: int) -> DataFrame:
    """node, cluster: the nodes that are near a node of another component by signature, by what joins them.

    The nodes of an open key are dealt to blocks, and each pair of blocks is compared in a cell of its own, so no task
    holds a whole key. What the stars of all cells join are the clusters.
    """
    sizes = opened.groupBy("key").agg(F.ceil(F.count("*") / p.signed_block).cast("int").alias("blocks"))
    cells = (
        opened.join(sizes, "key")
        .join(nodes.select("node", "n_shingles", "signature"), "node")
        .withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        .select(*_SIGNED)
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if batch.num_rows:
                own = pa.Table.from_batches([batch])
                held = own if held is None else pa.concat_tables([held, own])
                marks = np.stack([held.column(c).to_numpy() for c in ("key", "i", "j")])
                cuts = [0, *(np.flatnonzero((np.diff(marks) != 0).any(axis=0)) + 1).tolist()]
                yield _links_out(link for a, b in zip(cuts[:-1], cuts[1:], strict=True) for link in _near_stars(held.slice(a, b - a), p))
                held = held.slice(cuts[-1]).combine_chunks()
        if held is not None:
            yield _links_out(_near_stars(held, p))

    stars = stored(cells.mapInArrow(compare, "a long, b long").distinct(), "near-stars", files)
    return components(stars, files).select("node", F.col("component").alias("cluster"))


def _links_out(links) -> pa.RecordBatch:
    found = list(links)
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


class _Cell:
    """Two blocks of a cluster, or one with itself: finds links between the components their nodes are in."""

    def __init__(self, rows: list[tuple], p: Params):
        self.p, self.nodes = p, [r[0] for r in rows]
        first, second = rows[0][3], rows[0][4]
        self.own = np.array([r[2] for r in rows])
        self.other_side = np.where(self.own == first, second, first)
        self.texts = [words_of(r[5]) for r in rows]
        names: dict[int, int] = {}
        self.group = np.array([names.setdefault(r[1], len(names)) for r in rows])  # component of each node, so far
        self.real: dict[int, set] = {}

    def _same(self, a: int, b: int) -> bool:
        """Whether two nodes are linked by their shingles themselves."""
        for k in (a, b):
            if k not in self.real:
                self.real[k] = real_shingles(self.texts[k], self.p.shingle)
        x, y = self.real[a], self.real[b]
        return _linked(len(x & y), len(x), len(y), self.p)

    def links(self) -> list[tuple[int, int]]:
        value, row = shingle_rows(self.texts, self.p.shingle)
        size = np.bincount(row, minlength=len(self.texts))
        ends = np.cumsum(size)
        # Nodes of each shingle, and for each node the numbers of its shingles.
        order = np.argsort(value, kind="stable")
        number = np.empty(len(value), np.int64)
        number[order] = np.cumsum(np.concatenate([np.zeros(1, np.int64), value[order][1:] != value[order][:-1]]))
        holders = row[order]
        held_ends = np.cumsum(np.bincount(number))
        held_starts = np.concatenate([np.zeros(1, np.int64), held_ends[:-1]])

        found = []
        largest = np.bincount(self.group).argmax()
        # Nodes of the largest component need not look around: whoever is outside looks at them.
        for a in np.flatnonzero(self.group != largest).tolist():
            own = number[ends[a] - size[a] : ends[a]]
            counts = held_ends[own] - held_starts[own]
            at = np.repeat(held_starts[own] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            same = np.bincount(holders[at], minlength=len(self.texts))
            able = (self.group != self.group[a]) & (self.own == self.other_side[a])
            able &= (same > 0) & (100 * same >= self.p.percent * (size + size[a] - same))
            for b in np.flatnonzero(able).tolist():
                if self.group[b] != self.group[a] and self._same(a, b):
                    found.append((self.nodes[a], self.nodes[b]))
                    self.group[self.group == self.group[a]] = self.group[b]
            self.real.pop(a, None)
        return found


_CELL = ["cluster", "i", "j", "node", "component", "own", "text"]


def cross_links(opened: DataFrame, nodes: DataFrame, docs: DataFrame, p: Params, files: int) -> DataFrame:
    """Links (a, b) between nodes of different components, enough of them to join all that are linked.

    A cluster's nodes (see near_clusters) are dealt to blocks of bounded size, and every pair of blocks is compared in a
    cell of its own: no task holds a whole cluster, and a text is read once for each block rather than once a key. A cell
    counts common shingles by the nodes that hold them and gives out a link only where it joins two components, so its
    rows are fewer than its nodes, whatever the cluster looks like.
    """
    clusters = near_clusters(opened, nodes, p, files)
    labels = opened.select("node", "component").distinct()
    known = stored(clusters.join(labels, "node").join(nodes.select("node", "n_shingles"), "node"), "clusters", files)
    room = F.greatest(F.count("*") / p.block, F.sum("n_shingles") / p.block_shingles)
    blocks = known.groupBy("cluster").agg(F.ceil(room).cast("int").alias("blocks"))
    dealt = (
        known.join(blocks, "cluster")
        .withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "component", "own")
    )
    dealt = stored(dealt, "cells", files)
    few = dealt.count() <= p.broadcast_rows
    cells = (
        docs.select(F.col("rid").alias("node"), "text")
        .join(F.broadcast(dealt) if few else dealt, "node")
        .select(*_CELL)
        .repartition("cluster", "i", "j")
        .sortWithinPartitions("cluster", "i", "j")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        for batch in slices(batches, "text", 1 << 20):
            for cluster, i, j, node, component, own, text in zip(*(batch.column(c).to_pylist() for c in _CELL), strict=True):
                if (cluster, i, j) != at:
                    if rows:
                        yield _links_out(_Cell(rows, p).links())
                    at, rows = (cluster, i, j), []
                rows.append((node, component, own, i, j, text))
        if rows:
            yield _links_out(_Cell(rows, p).links())

    return stored(cells.mapInArrow(compare, "a long, b long"), "links")


def numbered(docs: DataFrame) -> DataFrame:
    """docs with rid, a number of each row, as a stored table, so that a row keeps its number."""
    return stored(docs.withColumn("rid", F.monotonically_increasing_id()), "numbered-rows")


def classes(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """rid, doc_id, n_shingles, words_a, words_b, component for every row of a stored table rows (rid, doc_id, text), stored.

    Rows with the same words form a class, named by its smallest rid, before anything is compared; rows with the same
    doc_id are joined as well. Then the nodes of a key are compared with its smallest, if they look promising; keys whose
    nodes are in one component by then are done, and what is left in the others is compared in cells, all of it. So most
    of a group of near copies costs one comparison a document, and no link between different components is lost.
    component is the smallest rid of the class names reachable.
    """
    signed = stored(signatures(rows, p), "signatures")
    files = max(4, signed.count() // p.file_rows)
    some = signed.where("n_shingles > 0")
    named = some.groupBy("words_a", "words_b").agg(F.min("rid").alias("node"))
    own_signature = F.when(F.col("rid") == F.col("node"), F.col("signature"))
    members = some.join(named, ["words_a", "words_b"])
    members = stored(members.select("rid", "n_shingles", "words_a", "words_b", "node", own_signature.alias("signature")), "word-classes", files)
    nodes = stored(members.where("signature is not null").select("node", "n_shingles", "signature"), "nodes", files)
    keyed = stored(chunk_keys(nodes, p), "chunk-keys")

    placed = members.select("rid", "n_shingles", "words_a", "words_b", "node").union(
        signed.where("n_shingles = 0").select("rid", "n_shingles", "words_a", "words_b", F.col("rid").alias("node"))
    )
    placed = stored(placed.join(rows.select("rid", "doc_id"), "rid"), "placed-rows", files)
    repeated = placed.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.count("*").alias("n"))
    repeated = placed.join(repeated.where("n > 1"), "doc_id").where("a != node").select("a", F.col("node").alias("b"))
    none = rows.sparkSession.createDataFrame([], "node long, component long")
    labels = _merged(none, repeated.distinct(), files)

    opened = _open_keys(keyed, labels, files)
    met = opened.join(opened.groupBy("key").agg(F.min("node").alias("hub")), "key").where("node != hub")
    links = confirmed(_promising(met.select("hub", "node"), nodes, p), rows, p, files)
    labels = _merged(labels, links, files)
    links = cross_links(_open_keys(keyed, labels, files), nodes, rows, p, files)
    labels = _merged(labels, links, files)
    linked = placed.join(labels, "node", "left")
    return stored(
        linked.select("rid", "doc_id", "n_shingles", "words_a", "words_b", F.coalesce("component", "node").alias("component")),
        "near-duplicates",
        files,
    )


def _heads(found: DataFrame, p: Params) -> DataFrame:
    """component, least (its smallest doc_id), head (the rid that stands for it) of components with several rows.

    Few are broadcast, many are joined by shuffle, where Spark splits a component with very many rows.
    """
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "words_a", "words_b", "rid")
    heads = found.groupBy("component").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.min_by("rid", first).alias("head"))
    heads = stored(heads.where("n > 1").drop("n"), "heads")
    return F.broadcast(heads) if heads.count() <= p.broadcast_rows else heads


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Documents are linked if 100 * common shingles >= 75 * all shingles of both; component_id is the smallest doc_id
    reachable by links, kept tells whether it is the row's own. A null or empty text has no shingles and no links. Rows
    with the same doc_id are one document with several texts. A row without doc_id can link others; its component_id is
    the smallest doc_id there is, or null, and then it is kept. Any 64-bit doc_id will do. An empty table gives no rows.
    """
    found = classes(numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), p)
    least = F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    out = found.join(_heads(found, p), "component", "left").select("doc_id", "n_shingles", least.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def drop_near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """docs with one row of each component, columns unchanged: that with the smallest doc_id, rows without one last; of
    those the first by a hash of its words.

    The rows to drop are stored and counted: few are broadcast, many joined by shuffle, with the same result.
    """
    rows = numbered(docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = classes(rows, p)
    dropped = found.join(_heads(found, p), "component").where("rid != head").select("rid")
    dropped = stored(dropped, "dropped")
    few = dropped.count() <= p.broadcast_rows
    return rows.join(F.broadcast(dropped) if few else dropped, "rid", "left_anti").select("row.*")
