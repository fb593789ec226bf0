"""Language-model scores by context-tree weighting over bytes.

A byte is decomposed into its eight bits, each predicted at a node: the bytes before it (the context, 0 to `depth` of
them) and the bits of the byte seen so far. A node's own estimate is that of Krichevsky and Trofimov from its counts of
zeros and ones; its weighted probability is half that of its own and half the product of those of the nodes with one more
byte of context. All of it depends on counts alone, so training is an aggregation: grams of depth + 1 bytes are counted
over the training texts, counts of nodes are sums of those of longer contexts, and weighted probabilities go up the tree
level by level. Going down again gives every gram the probability of its last byte after the others, mixed over all
depths. Grams that only occur in other texts are in the tree with count 0, where the mixture falls back by itself.

Texts are kept in blocks of some megabytes. A block counts its distinct grams and words, these meet the corpus counts in
joins, and each block gets back its own part of the model: nothing that grows with the corpus is broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm.common import byte_pieces, slices, stored, text_bytes
from frostline.llm.words import LOWER, SPACED

#: Stands before the first byte of a text and after its last; it is in no UTF-8 text.
EDGE = 255
_CHUNK = 1 << 20
_WORD_BYTES = bytes(b if SPACED[b] else 32 for b in range(256))
BLOCKS = "block long, doc_ids binary, no_id binary, held_out binary, lengths binary, texts binary"


def text_blocks(docs: DataFrame, block_bytes: int = 32 << 20) -> DataFrame:
    """The texts of docs (doc_id, text, held_out), A-Z in lower case, in blocks of about block_bytes; stored.

    The texts of a block are one zstd body, which is a third of their size wherever the block is sent.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, held = TaskContext.get().partitionId(), 0, 0
        rows: list[list[bytes]] = [[] for _ in range(5)]

        def flush() -> pa.RecordBatch:
            bodies = [b"".join(x) for x in rows]
            bodies[-1] = zstandard.ZstdCompressor(level=3).compress(bodies[-1])
            arrays = [pa.array([(part << 32) + block]), *(pa.array([x], pa.binary()) for x in bodies)]
            return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in BLOCKS.split(", ")])

        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            ids = batch.column("doc_id")
            new = [
                ids.fill_null(0).to_numpy().astype(np.int64),
                ids.is_null().to_numpy(zero_copy_only=False),
                batch.column("held_out").to_numpy(zero_copy_only=False),
                np.diff(offsets),
                LOWER[data],
            ]
            for own, x in zip(rows, new, strict=True):
                own.append(x.tobytes())
            held += len(data)
            if held >= block_bytes:
                yield flush()
                rows, block, held = [[] for _ in range(5)], block + 1, 0
        if rows[0]:
            yield flush()

    return stored(docs.select("doc_id", "text", "held_out").mapInArrow(gather, BLOCKS), "text-blocks")


class _Texts:
    """A block, opened."""

    def __init__(self, row: dict):
        self.block, self.texts = row["block"], zstandard.ZstdDecompressor().decompress(row["texts"]) if row["texts"] else b""
        self.ids = np.frombuffer(row["doc_ids"], np.int64)
        self.no_id, self.held = (np.frombuffer(row[c], bool) for c in ("no_id", "held_out"))
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.ends = np.cumsum(self.lengths)

    def grams(self, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """In chunks: a number for each byte and its `depth` bytes before, the latest in the lowest bits, and its text.

        A text's bytes are followed by EDGE and, like that, predicted; its first bytes have EDGE before them.
        """
        n = len(self.lengths)
        stream = np.full(len(self.texts) + n * (depth + 1), EDGE, np.uint8)
        shift = np.arange(n) * (depth + 1) + depth
        for a, b, by in zip((self.ends - self.lengths).tolist(), self.ends.tolist(), shift.tolist(), strict=True):
            stream[a + by : b + by] = np.frombuffer(self.texts, np.uint8, b - a, a)
        first = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.lengths + 1)])
        for start in range(0, int(first[-1]), _CHUNK):
            stop = min(start + _CHUNK, int(first[-1]))
            i, j = int(np.searchsorted(first, start, "right")) - 1, int(np.searchsorted(first, stop, "left"))
            text = np.repeat(np.arange(i, j), np.diff(np.clip(first[i : j + 1], start, stop)))
            place = np.arange(start, stop) + text * depth
            base = int(place[0])
            wide = stream[base : int(place[-1]) + depth + 1].astype(np.uint64)
            size = len(wide) - depth
            gram = wide[:size].copy()
            for k in range(1, depth + 1):
                gram <<= np.uint64(8)
                gram |= wide[k : k + size]
            yield gram[place - base].view(np.int64), text

    def words(self) -> Iterator[tuple[int, list[bytes]]]:
        """The words of each text, in lists of some megabytes of text: number of the text, words."""
        texts = self.texts.translate(_WORD_BYTES)
        for i, (end, n) in enumerate(zip(self.ends.tolist(), self.lengths.tolist(), strict=True)):
            for piece in byte_pieces(texts[end - n : end]):
                yield i, piece.split()


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[_Texts]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Texts({name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)})


class _Values:
    """A value for each of many numbers: a hash table in arrays, at most a quarter full, asked with arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)  # grams are not negative
        self.values = np.zeros(1 << self.bits)
        left, slot = np.arange(len(keys)), self._first(keys)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]  # of several for one slot the last stays
            there = self.keys[slot] == keys[left]
            self.values[slot[there]] = values[left[there]]
            left, slot = left[~there], (slot[~there] + 1) & (len(self.keys) - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, all of which are known."""
        slot = self._first(keys)
        missed = np.flatnonzero(self.keys[slot] != keys)
        while len(missed):
            slot[missed] = (slot[missed] + 1) & (len(self.keys) - 1)
            missed = missed[self.keys[slot[missed]] != keys[missed]]
        return self.values[slot]


def _counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams = np.sort(grams)
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(grams)), bool), grams[1:] != grams[:-1]]))
    return grams[starts], np.diff(np.append(starts, len(grams)))


def _added_up(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, n = np.concatenate(grams), np.concatenate(counts)
    order = np.argsort(every)
    every = every[order]
    starts = np.flatnonzero(np.concatenate([np.ones(1, bool), every[1:] != every[:-1]]))
    return every[starts], np.add.reduceat(n[order], starts)


def gram_counts(blocks: DataFrame, depth: int) -> DataFrame:
    """block, gram, n: the grams of each block and how often they occur in its training texts (0 in others only)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _opened(batches):
            found: tuple[list, list] = ([], [])
            for gram, text in texts.grams(depth):
                held = texts.held[text]
                for own, n in (_counted(gram[~held]), _counted(gram[held])):
                    found[0].append(own)
                    found[1].append(n if len(found[0]) % 2 else np.zeros_like(n))  # first those of training texts
                if len(found[0]) >= 16:
                    every, n = _added_up(*found)
                    found = ([every, every[:0]], [n, n[:0]])
            gram, n = _added_up(*found)
            for i in range(0, len(gram), 1 << 18):
                own = gram[i : i + (1 << 18)]
                columns = [np.full(len(own), texts.block), own, n[i : i + len(own)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["block", "gram", "n"])

    return stored(blocks.mapInArrow(count, "block long, gram long, n long"), "block-grams")


def word_counts(blocks: DataFrame) -> DataFrame:
    """block, word, c, once: the words of each block and how often they occur in all training texts, as a stored table.

    The rows with a null word count the training texts. `once` marks one of a word's rows. The rows of a word, one a
    block, meet in a window, so they are shuffled once for their sum and need no join to have it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _opened(batches):
            held = texts.held.tolist()
            counts, others = Counter(), set()
            for i, words in texts.words():
                if held[i]:
                    others.update(words)
                else:
                    counts.update(words)
            counts.update(dict.fromkeys(others, 0))
            words = [None, *counts]
            n = [len(held) - sum(held), *counts.values()]
            for i in range(0, len(words), 1 << 18):
                own = words[i : i + (1 << 18)]
                columns = [pa.array([texts.block] * len(own)), pa.array(own, pa.binary()), pa.array(n[i : i + len(own)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "word", "n"])

    counted = blocks.mapInArrow(count, "block long, word binary, n long")
    of_word = Window.partitionBy("word")
    summed = counted.select("block", "word", F.sum("n").over(of_word).alias("c"), (F.min("block").over(of_word) == F.col("block")).alias("once"))
    return stored(summed, "block-words")


def _log_gamma(x: Column) -> Column:
    """Stirling's series, eight places further up."""
    y, rest = x + 8, x
    for k in range(1, 8):
        rest = rest * (x + k)
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.ln(y) - y + float(0.5 * np.log(2 * np.pi)) + series - F.ln(rest)


def _own_estimate() -> Column:
    """ln of the probability that Krichevsky and Trofimov give zeros and ones in any order."""
    return _log_gamma(F.col("zeros") + 0.5) + _log_gamma(F.col("ones") + 0.5) - _log_gamma(F.col("zeros") + F.col("ones") + 1.0) - float(np.log(np.pi))


def _at_depth(depth: int) -> Column:
    """A node with only the latest `depth` bytes of its context; the lowest byte is the place in the predicted byte."""
    return F.col("node").bitwiseAND(F.lit((1 << (8 * depth + 8)) - 1))


def byte_probabilities(counts: DataFrame, depth: int) -> DataFrame:
    """gram, logp for every row of counts (gram, n): log10 of the probability of the last byte after the others."""
    split = counts.select("gram", "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    bits = split.select(
        "gram",
        "n",
        F.expr("((gram >> 8) << 8) | (1L << i) | ((gram & 255) >> (8 - i))").alias("node"),
        F.expr("(gram >> (7 - i)) & 1").alias("bit"),
    )
    leaves = bits.groupBy("node").agg(F.sum(F.col("n") * (1 - F.col("bit"))).alias("zeros"), F.sum(F.col("n") * F.col("bit")).alias("ones"))
    levels = [stored(leaves.withColumn("own", _own_estimate()).withColumn("weighted", F.col("own")), "tree-level")]
    for d in reversed(range(depth)):
        inner = levels[0].groupBy(_at_depth(d).alias("node")).agg(
            F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("longer")
        )
        inner = inner.withColumn("own", _own_estimate())
        high, low = F.greatest("own", "longer"), F.least("own", "longer")
        both = high + F.log1p(F.exp(low - high)) - float(np.log(2))
        levels.insert(0, stored(inner.withColumn("weighted", both).drop("longer"), "tree-level"))

    mixed = None
    for d, level in enumerate(levels):
        n = F.col("zeros") + F.col("ones") + 1.0
        stop = F.lit(1.0) if d == depth else F.exp(F.col("own") - F.col("weighted") - float(np.log(2)))
        level = level.select("node", stop.alias("stop"), ((F.col("zeros") + 0.5) / n).alias("zero"), ((F.col("ones") + 0.5) / n).alias("one"))
        if mixed is None:
            level = level.withColumns({"left": F.lit(1.0), "zero_so_far": F.lit(0.0), "one_so_far": F.lit(0.0)})
        else:
            level = level.withColumn("shorter", _at_depth(d - 1)).join(mixed, "shorter")
        here = F.col("left") * F.col("stop")
        mixed = level.select(
            F.col("node").alias("shorter"),
            (F.col("left") * (1 - F.col("stop"))).alias("left"),
            (F.col("zero_so_far") + here * F.col("zero")).alias("zero_so_far"),
            (F.col("one_so_far") + here * F.col("one")).alias("one_so_far"),
        )
    chance = F.when(F.col("bit") == 1, F.col("one_so_far")).otherwise(F.col("zero_so_far"))
    found = bits.select("gram", "node", "bit").join(mixed.withColumnRenamed("shorter", "node"), "node")
    return stored(found.groupBy("gram").agg(F.sum(F.log10(chance)).alias("logp")), "byte-probabilities")


def scores(docs: DataFrame, depth: int = 4, held_one_in: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte for every row of docs
    (doc_id, text).

    A row is held out of training if crc32 of its doc_id as text divides by held_one_in. score is the log10 probability
    of the text's bytes, A-Z in lower case, and of its end; bits_per_byte is its code length over n_bytes + 1. base_score
    sums log10((c + 0.1) / (N + 0.1 (V + 1))) over the words and the end of a text, with a word's count c and the number
    N of all and V of different words and ends in training texts. n_tokens counts a text's words and its end, n_known
    those with c > 0.

    A null or empty text has its end alone. A null doc_id counts as empty text in the hash, so such rows are held out.
    Repeated rows are texts of their own. Without training texts all counts are 0 and every bit has probability 1/2. An
    empty table gives no rows. A task holds one block, or one longer text.
    """
    if not 0 <= depth <= 6:
        raise ValueError("a gram of depth + 1 bytes must fit a long")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % held_one_in == 0
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held)
    blocks = text_blocks(chosen, block_bytes)
    grams, words = gram_counts(blocks, depth), word_counts(blocks)

    logp = byte_probabilities(grams.groupBy("gram").agg(F.sum("n").alias("n")), depth)
    totals = words.where("once").agg(F.sum("c"), F.count_if(F.col("c") > 0), F.sum(F.when(F.col("word").isNull(), F.col("c"))))
    n, v, ends = (x or 0 for x in totals.first())
    known = grams.join(logp, "gram").select("block", "gram", F.lit(None).cast("binary").alias("word"), "logp", F.lit(None).cast("long").alias("c"))
    known = known.union(
        words.where("word is not null").select("block", F.lit(None).cast("long"), "word", F.lit(None).cast("double"), "c")
    )
    log_n = float(np.log10(n + 0.1 * (v + 1)))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        is_word = right.column("gram").is_null()
        grams_here, words_here = right.filter(right.column("word").is_null()), right.filter(is_word)
        logp_of = _Values(*(grams_here.column(c).to_numpy() for c in ("gram", "logp")))
        count = dict(zip(words_here.column("word").to_pylist(), words_here.column("c").to_pylist(), strict=True))
        out = []
        for batch in left.to_batches():
            for texts in _opened(iter([batch])):
                m = len(texts.lengths)
                total, base, tokens, seen = np.zeros(m), np.zeros(m), np.ones(m, np.int64), np.full(m, int(ends > 0))
                for own, text in texts.grams(depth):
                    first = int(text[0])
                    found = np.bincount(text - first, weights=logp_of.of(own))
                    total[first : first + len(found)] += found
                base += np.log10(ends + 0.1) - log_n
                for i, own in texts.words():
                    c = np.fromiter(map(count.__getitem__, own), np.int64, len(own))
                    tokens[i] += len(own)
                    seen[i] += np.count_nonzero(c)
                    base[i] += (np.log10(c + 0.1) - log_n).sum()
                columns = [
                    pa.array(texts.ids, mask=texts.no_id),
                    pa.array(texts.held),
                    pa.array(tokens),
                    pa.array(seen),
                    pa.array(np.full(m, n)),
                    pa.array(base),
                    pa.array(total),
                    pa.array(texts.lengths),
                    pa.array(-total / np.log10(2) / (texts.lengths + 1)),
                ]
                out.append(pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCORES.split(", ")]))
        return pa.Table.from_batches(out)

    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, SCORES)


SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
    "n_bytes long, bits_per_byte double"
)
