"""Finite automata over ordered rows, for keys of any size.

A row moves its key from one state to the next, whatever the state is: it is a map of states, kept as a number with four
bits a state. Maps of neighbouring rows compose to a map, so rows need not be walked through one by one: a chunk of a hot
key reduces to one map, the maps of its chunks are composed in order to give the state each chunk starts in, and inside a
chunk the map from its start through every row comes from about log2(rows) compositions of whole arrays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from frostline.operators.ordered import CHUNK, hot_rows, split_hot_keys

_BITS = 4
MOST_STATES = 15


def move(targets: Sequence[int]) -> int:
    """The map that takes state i to targets[i]."""
    if len(targets) > MOST_STATES:
        raise ValueError(f"an automaton has at most {MOST_STATES} states")
    return sum(to << (_BITS * i) for i, to in enumerate(targets))


def _composed(moves: np.ndarray, starts: np.ndarray, carry: np.ndarray) -> np.ndarray:
    """For each row the map from the start of its key through it. Rows before the first start continue `carry`."""
    through, closed = moves.copy(), starts.copy()
    through[0] = through[0] if closed[0] else through[0][carry]
    closed[0] = True
    step = 1
    while step < len(through) and not closed.all():
        # A row that does not yet reach back to its start takes in what the row `step` before it has put together.
        open_ = np.flatnonzero(~closed[step:]) + step
        longer = np.take_along_axis(through[open_], through[open_ - step], axis=1)
        reached = closed[open_ - step]
        through[open_], closed[open_] = longer, reached
        step *= 2
    return through


def composed(rows: DataFrame, keys: list[str], order: str, moved: str, states: int) -> DataFrame:
    """Add `before` and `through`: the maps from the start of the key to a row, without and with the row's own.

    Rows of a key are sorted by Spark and stream through in record batches, of which one at a time is held.
    """
    starts = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1
    flagged = rows.withColumn("starts_key", starts)
    shifts = np.arange(states, dtype=np.int64) * _BITS
    same = np.arange(states)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = same
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(moved).to_numpy()
            begins = batch.column("starts_key").to_numpy(zero_copy_only=False)
            through = _composed((codes[:, None] >> shifts) & (2**_BITS - 1), begins, carry)
            before = np.vstack([carry[None, :], through[:-1]])
            before[begins] = same
            carry = through[-1]
            for name, maps in (("before", before), ("through", through)):
                batch = batch.append_column(name, pa.array((maps << shifts).sum(axis=1), pa.int64()))
            yield batch

    maps = [StructField(name, LongType()) for name in ("before", "through")]
    schema = StructType([*flagged.schema.fields, *maps])
    return flagged.mapInArrow(walk, schema).drop("starts_key")


def _applied(maps: str, state: Column) -> Column:
    return F.call_function("shiftright", F.col(maps), (state * _BITS).cast("int")).bitwiseAND(F.lit(2**_BITS - 1)).cast("int")


def scan_states(rows: DataFrame, keys: list[str], order: str, moved: str, states: int, chunk_rows: int) -> DataFrame:
    """Add `state_before` and `state_after` to rows whose column `moved` holds their map (see `move`).

    Every key starts in state 0 and is walked through in the order of the unique integer column `order`. No key is ever in
    one task as a whole; what is broadcast has a row per chunk of a hot key, at most rows / chunk_rows rows.
    """
    split = split_hot_keys(rows, keys, order, chunk_rows)
    in_chunk = [*keys, CHUNK]
    hot = composed(hot_rows(split).select(*in_chunk, order, moved), in_chunk, order, moved, states)
    chunks = hot.groupBy(*in_chunk).agg(F.max_by("through", order).alias(moved))
    entered = composed(chunks, keys, CHUNK, moved, states).select(*in_chunk, _applied("before", F.lit(0)).alias("entry"))
    walked = composed(split.select(*rows.columns, CHUNK), in_chunk, order, moved, states)
    entry = F.coalesce("entry", F.lit(0))
    return walked.join(F.broadcast(entered), in_chunk, "left").select(
        *rows.columns, _applied("before", entry).alias("state_before"), _applied("through", entry).alias("state_after")
    )
