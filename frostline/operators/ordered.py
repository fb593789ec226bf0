"""Ordered computations over keys of any size.

Lateness, running aggregates and alert runs depend on the order in which the rows of one key arrived.
A plain window function would send a whole key to one task, which fails once a single truck holds a
large share of the data. Here:

* keys with at most `chunk_rows` rows keep one chunk, so they cost one exchange and nothing more;
* a larger ("hot") key is cut by its order column into chunks of at most `chunk_rows` rows;
* each hot chunk is reduced to a small summary, the summaries are scanned in order, and what a chunk
  must know about the rows before it comes back as *carry rows* placed ahead of its own rows.

The windows then run per (key, chunk). Carry rows are marked by a column of their own and have a null order column, so
they sort first; they are dropped from the result. A real row without an order value sorts after them and is kept. When no key is hot the summary branches are empty and adaptive execution removes
them from the plan.

The order column must be a unique integer within the key, such as a log offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from frostline.streaming.workspace import materialised

CHUNK = "chunk"
_HOT = "in_hot_key"
_WIDTH = "chunk_width"
_CARRY = "is_carry"


def dense_order(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Add `name`: 0, 1, 2, ... in the order of several columns, nulls first, as ordered operators need it.

    Rows are range-partitioned and sorted, and written with their place in their partition, so that the places no longer
    change when a task runs again. A window over one count per partition then gives what comes before each. Rows that
    are equal in all of `by` get different numbers.
    """
    order = [F.col(c).asc_nulls_first() for c in by]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranged.withColumns(
        {"order_part": F.spark_partition_id(), "order_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}
    )
    placed = materialised(placed, "ordered")
    counts = placed.groupBy("order_part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("order_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("order_part", F.coalesce(before, F.lit(0)).alias("order_base"))  # a row per partition
    numbered = placed.join(F.broadcast(bases), "order_part")
    return numbered.select(*rows.columns, (F.col("order_base") + F.col("order_place")).alias(name))


def log_order(wire: DataFrame, log: list[str], offset: str = "offset") -> DataFrame:
    """One row per log partition (`log`: topic and partition) with `before`: how many places lie ahead of its first offset,
    and `high`, its last offset.

    `before + offset` is a unique order of arrival over all partitions of a log: partitions one after another, each in
    the order of its offsets. It needs the smallest and largest offset of each partition and neither sort nor shuffle of
    the records. There are as many rows as partitions, so the result is small.
    """
    ends = wire.groupBy(*log).agg(F.min(offset).alias("low"), F.max(offset).alias("high"))
    ahead = Window.orderBy(*[F.col(c).asc_nulls_first() for c in log]).rowsBetween(Window.unboundedPreceding, -1)
    places = F.coalesce(F.sum(F.col("high") - F.col("low") + 1).over(ahead), F.lit(0))
    return ends.select(*log, (places - F.col("low")).alias("before"), "high")


def find_hot_keys(rows: DataFrame, keys: list[str], chunk_rows: int) -> DataFrame:
    """Keys with more than chunk_rows rows.

    There are at most total rows / chunk_rows of them, which is what makes this list safe to broadcast:
    10**12 rows give at most 250,000 entries at the default size.
    """
    return (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("key_rows"))
        .where(F.col("key_rows") > chunk_rows)
        .select(*keys, F.lit(True).alias(_HOT))
    )


def chunk_widths(rows: DataFrame, keys: list[str], order: str, chunk_rows: int, hot: DataFrame) -> DataFrame:
    """Hot keys (find_hot_keys) with `width`: how many places in the order make a chunk.

    chunk_rows places never hold more rows than that, but a key whose rows lie far apart would get chunks of one row, and
    as many carry rows as rows. Such a key gets chunks as wide as hold half of chunk_rows on average, unless one of them
    has more than chunk_rows. Costs two more passes over the hot rows.
    """
    hot = hot.select(*keys, _HOT)
    places = (F.max(order) - F.min(order) + 1) / (2 * F.count(F.lit(1))) * F.lit(chunk_rows)
    wide = F.greatest(F.lit(chunk_rows), F.coalesce(F.floor(places), F.lit(0))).cast("bigint").alias(_WIDTH)
    widths = rows.join(F.broadcast(hot), keys).groupBy(*keys).agg(wide)
    chunk = F.coalesce(F.floor(F.col(order) / F.col(_WIDTH)), F.lit(0))
    counts = rows.join(F.broadcast(widths), keys).groupBy(*keys, _WIDTH, chunk).agg(F.count(F.lit(1)).alias("n"))
    fits = F.when(F.max("n") <= chunk_rows, F.col(_WIDTH)).otherwise(F.lit(chunk_rows))
    return counts.groupBy(*keys, _WIDTH).agg(fits.alias("fitting")).select(
        *keys, F.lit(True).alias(_HOT), F.col("fitting").cast("bigint").alias(_WIDTH)
    )


def split_hot_keys(
    rows: DataFrame, keys: list[str], order: str, chunk_rows: int, hot: DataFrame | None = None
) -> DataFrame:
    """Add `chunk`: 0 for ordinary keys, order div chunk_rows, or div the width that `hot` gives, for hot ones."""
    hot = find_hot_keys(rows, keys, chunk_rows) if hot is None else hot
    width = F.col(_WIDTH) if _WIDTH in hot.columns else F.lit(chunk_rows)
    # Rows without an order value go before all others, to the first chunk.
    place = F.coalesce(F.floor(F.col(order) / width), F.lit(0))
    chunk = F.when(F.col(_HOT), place).otherwise(F.lit(0)).cast("bigint")
    return rows.join(F.broadcast(hot), keys, "left").withColumn(CHUNK, chunk).drop(_WIDTH)


def one_chunk(rows: DataFrame) -> DataFrame:
    """Add `chunk` to rows of which no key is hot."""
    return rows.withColumns({_HOT: F.lit(None).cast("boolean"), CHUNK: F.lit(0).cast("bigint")})


def seed_chunks(carried: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """Give carry rows from an earlier run their chunk: 0 for ordinary keys, and for hot ones -1, a chunk before all
    others, from which the summaries pass them on."""
    chunk = F.when(F.col(_HOT), F.lit(-1)).otherwise(F.lit(0)).cast("bigint")
    return carried.join(F.broadcast(hot.select(*keys, _HOT)), keys, "left").withColumn(CHUNK, chunk)


def hot_rows(split: DataFrame) -> DataFrame:
    """Rows of hot keys only. Null-rejecting, so the optimizer turns the tagging join into an inner join."""
    return split.where(F.col(_HOT))


def with_carry(split: DataFrame, *carry: DataFrame) -> DataFrame:
    """Put carry rows next to the rows they precede. Columns a side lacks are null."""
    out = split.drop(_HOT).withColumn(_CARRY, F.lit(False))
    for rows in carry:
        out = out.unionByName(rows.drop(_HOT).withColumn(_CARRY, F.lit(True)), allowMissingColumns=True)
    return out


def is_real() -> Column:
    """Rows of the input, not carry rows."""
    return ~F.col(_CARRY)


def drop_carry(rows: DataFrame) -> DataFrame:
    return rows.where(is_real()).drop(CHUNK, _CARRY)


def before_chunk(keys: list[str]) -> WindowSpec:
    """All earlier chunk summaries of the key."""
    return Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def earlier_chunks(keys: list[str]) -> WindowSpec:
    """As before_chunk, where a chunk has several summaries: those of all earlier chunks."""
    return Window.partitionBy(*keys).orderBy(CHUNK).rangeBetween(Window.unboundedPreceding, -1)


def through_chunk(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, 0)


def after_chunk(keys: list[str]) -> WindowSpec:
    """All later chunk summaries of the key."""
    return Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)


def _in_chunk(keys: list[str], *order: Column) -> WindowSpec:
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def _forward(order: str) -> list[Column]:
    return [F.col(_CARRY).desc(), F.col(order).asc_nulls_first()]


def up_to_here(keys: list[str], order: str) -> WindowSpec:
    return _in_chunk(keys, *_forward(order)).rowsBetween(Window.unboundedPreceding, 0)


def before_here(keys: list[str], order: str) -> WindowSpec:
    return _in_chunk(keys, *_forward(order)).rowsBetween(Window.unboundedPreceding, -1)


def after_here(keys: list[str], order: str) -> WindowSpec:
    """Later rows, nearest first; trailing carry rows (null order) come first so they are 'furthest back'."""
    last = [F.col(_CARRY).desc(), F.col(order).desc_nulls_last()]
    return _in_chunk(keys, *last).rowsBetween(Window.unboundedPreceding, -1)


def running_totals(
    rows: DataFrame,
    keys: list[str],
    order: str,
    totals: dict[str, str],
    chunk_rows: int,
    whole: dict[str, str] | None = None,
) -> DataFrame:
    """Add cumulative sums (`totals`: source column -> new column) in order within each key, of any size.

    `whole` adds the sum over the complete key in the same way, without gathering the key.
    """
    whole = whole or {}
    split = split_hot_keys(rows, keys, order, chunk_rows)
    sums = hot_rows(split).groupBy(*keys, CHUNK).agg(*[F.sum(c).alias(c) for c in {**totals, **whole}])
    carried = sums.select(
        *keys,
        CHUNK,
        *[F.sum(c).over(before_chunk(keys)).alias(c) for c in {**totals, **whole}],
        *[F.sum(c).over(after_chunk(keys)).alias(f"after_{new}") for c, new in whole.items()],
    )
    here, chunk = up_to_here(keys, order), Window.partitionBy(*keys, CHUNK)
    summed = with_carry(split, carried)
    added = {new: F.sum(c).over(here) for c, new in totals.items()}
    for c, new in whole.items():
        added[new] = F.sum(c).over(chunk) + F.coalesce(F.max(f"after_{new}").over(chunk), F.lit(0))
    return drop_carry(summed.withColumns(added)).drop(*[f"after_{new}" for new in whole.values()])
