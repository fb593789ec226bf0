"""Packing by cutting stock: column generation over a length histogram, patterns assigned to ranked pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm.common import crc32_ids, slices, stored
from frostline.llm.tokens import encoder, tokenizer_path

CAPACITY = 1024
UNIT = 4


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, unit: int) -> DataFrame:
    """Every document as pieces of `capacity` ids and a rest, stored with a rank inside (part, size class).

    A class holds the lengths that take the same number of units of `unit` ids. part is the task that made the piece.
    """
    path = tokenizer_path(tokenizer)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "part", "part_rank"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part = encoder(path), TaskContext.get().partitionId()
        used = np.zeros(capacity // unit + 1, np.int64)
        for batch in slices(batches, "text", 1 << 20):
            ids, lengths = own.encode([t or "" for t in batch.column("text").to_pylist()])
            ids, lengths = np.insert(ids, np.cumsum(lengths), end_id), lengths + 1
            n = -(-lengths // capacity)
            row = np.repeat(np.arange(len(n)), n)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * capacity
            length = np.minimum(lengths[row] - start, capacity)
            begin = np.repeat(np.cumsum(lengths) - lengths, n) + start
            sums = [crc32_ids(ids[a : a + b]) for a, b in zip(begin.tolist(), length.tolist(), strict=True)]
            kind = -(-length // unit)
            order = np.argsort(kind, kind="stable")
            sizes = np.bincount(kind, minlength=len(used))
            rank = np.empty(len(kind), np.int64)
            rank[order] = np.arange(len(kind)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            rank += used[kind]
            used += sizes
            keys = batch.column("doc_id").take(pa.array(row))
            numbers = [start, length, sums, lengths[row], kind, np.full(len(row), part), rank]
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(x, pa.int64()) for x in numbers)], names)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        cut, ", ".join(f"{n} long" for n in names)
    )
    return stored(found, "packing-pieces")


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items within capacity, by dynamic programming; items of positive value only."""
    use = np.flatnonzero(values > 1e-12)
    use = use[np.argsort(sizes[use])]
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    own, gain = sizes[use], values[use]
    for room in range(1, capacity + 1):
        n = np.searchsorted(own, room, side="right")
        best[room] = best[room - 1]
        if n:
            total = best[room - own[:n]] + gain[:n]
            k = int(total.argmax())
            if total[k] > best[room] + 1e-12:
                best[room], taken[room] = total[k], k
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            counts[use[taken[room]]] += 1
            room -= int(own[taken[room]])
    return float(best[capacity]), counts


def linear_program(
    sizes: np.ndarray, need: np.ndarray, capacity: int, max_steps: int = 3000
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The basis (a column per pattern), how much of each column is used, its cost, and the dual price of each size.

    Column generation: a knapsack over the dual prices finds the pattern that improves most, until none does;
    `max_steps` ends it early with the best plan so far. The work depends on the number of sizes alone.
    """
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)  # one pattern of equal pieces for each size
    inverse, cost = np.diag(1 / basis.diagonal()), np.ones(m)
    amount = inverse @ need
    for _ in range(max_steps):
        price = cost @ inverse
        if price.min() < -1e-9:
            column, own = np.zeros(m), 0.0  # a surplus: more places than pieces of that size
            column[price.argmin()] = -1
        else:
            worth, counts = knapsack(price, sizes, capacity)
            if worth <= 1 + 1e-7:
                break
            column, own = counts.astype(float), 1.0
        step = inverse @ column
        rising = np.flatnonzero(step > 1e-9)
        if not len(rising):
            break
        out = rising[np.argmin(amount[rising] / step[rising])]
        theta = amount[out] / step[out]
        amount = np.maximum(amount - theta * step, 0)
        amount[out] = theta
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
        basis[:, out], cost[out] = column, own
    return basis, amount, cost, cost @ inverse


def patterns(demand: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """How often each pattern (size -> pieces) is used, so that every piece of `demand` (size -> number) has a place.

    The counts of the linear program are rounded down; the few pieces left over are packed first-fit by decreasing size.
    """
    sizes = np.array(sorted(demand), np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[s] for s in sizes.tolist()], float)
    basis, amount, cost, _ = linear_program(sizes, need, capacity)
    plan: list[tuple[int, dict[int, int]]] = []
    left = need.astype(np.int64)
    for k in np.argsort(-amount, kind="stable").tolist():
        counts, times = basis[:, k].astype(np.int64), int(amount[k] + 1e-9)
        have = np.flatnonzero((counts > 0) & (left > 0)) if cost[k] else []
        times = min(times, max((int(-(-left[i] // counts[i])) for i in have), default=0))
        if times:
            taken = np.minimum(left, counts * times)
            left -= taken
            plan.append((times, {int(sizes[i]): int(counts[i]) for i in np.flatnonzero(taken)}))
    return plan + _first_fit({int(s): int(n) for s, n in zip(sizes, left, strict=True) if n}, capacity)


def _first_fit(demand: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    plan, left = [], dict(demand)
    while left:
        room, counts = capacity, {}
        for size in sorted(left, reverse=True):
            if n := min(left[size], room // size):
                counts[size], room = n, room - n * size
        times = min(left[s] // n for s, n in counts.items())
        plan.append((times, counts))
        left = {s: n - times * counts.get(s, 0) for s, n in left.items() if n > times * counts.get(s, 0)}
    return plan


def _places(plan: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (class, first rank, first sequence, pieces per sequence), sorted by class and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, counts in plan:
        for size, n in counts.items():
            rows.append((size, used.get(size, 0), sequence, n))
            used[size] = used.get(size, 0) + times * n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 0,
    capacity: int = CAPACITY,
    unit: int = UNIT,
) -> DataFrame:
    """All rows of docs (doc_id, text), encoded with end_id after each, in sequences of at most `capacity` ids.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A longer document is cut
    into pieces of `capacity` and a rest; lengths are rounded up to `unit` ids for the histogram, so a sequence wastes
    less than `unit` ids a piece beside what the patterns leave. The driver sees the histogram, of capacity / unit
    numbers, and solves the cutting-stock program on it. Ranks of pieces in their class come from counts per task, so no
    class is gathered in one place, and a sequence is at most capacity / unit pieces. Texts are never shuffled.

    A null text is empty and has the end id alone. Null doc_ids and repeated rows are packed like any other row. An
    empty table gives no pieces.
    """
    cut = pieces(docs, tokenizer, end_id, capacity, unit)
    sizes = cut.groupBy("part", "class").agg(F.count("*").alias("n"))
    demand = {r["class"]: r["n"] for r in sizes.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    places = _places(patterns(demand, capacity // unit))
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", "class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["part", "class"]).withColumn("rank", F.col("base") + F.col("part_rank"))
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = places[:, 0] << 48 | places[:, 1]
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, batch.column("class").to_numpy() << 48 | rank, side="right") - 1
            sequence = places[at, 2] + (rank - places[at, 1]) // places[at, 3]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequence)], [*kept, "sequence_id"]
            )

    placed = ranked.select(*kept, "class", "rank").mapInArrow(
        assign, ", ".join(f"{c} long" for c in [*kept, "sequence_id"])
    )
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start")
    inside = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("offset", F.coalesce(inside, F.lit(0)))
