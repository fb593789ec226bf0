"""Sharding: global byte-size prefix sums from per-partition totals, cut at equal targets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm.common import stored


def balanced_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Contiguous shards of nearly equal bytes over docs (doc_id, text), in the order of doc_id.

    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, law (`bytes`), shard (0 to shards - 1), slot (gapless from 0 in
    its shard) and grown_shard (null: only a law by key has one).

    Sizes are measured in the scan; texts are never shuffled. The small rows are range-partitioned by doc_id, summed
    inside each partition, and stored with their running sums, so that partition numbers stay what they are when a task
    runs again. A window over one total per partition gives each partition's start. A row goes to the shard that holds
    the middle of its bytes: no shard is further from total / shards than half a row at each of its two cuts.

    A null text has size 1 and crc32 0. Rows with a null doc_id come first, rows with the same doc_id are ordered by
    size and crc32; repeated rows take a slot each. Equal texts are not kept together: the cut follows doc_id alone. An
    empty table gives no rows.
    """
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("size").asc(), F.col("text_crc32").asc()]
    ranged = sized.repartitionByRange(*order).sortWithinPartitions(*order)
    names = [*ranged.columns, "part", "rows_before", "bytes_before"]

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, rows, used = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            size = batch.column("size").to_numpy()
            before = used + np.cumsum(size) - size
            at = rows + np.arange(len(size))
            numbers = [np.full(len(size), part), at, before]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in numbers)], names)
            rows, used = rows + len(size), used + int(size.sum())

    kept = stored(
        ranged.mapInArrow(
            running, "doc_id long, size long, text_crc32 long, part long, rows_before long, bytes_before long"
        ),
        "shard-sizes",
    )
    totals = kept.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "part",
        F.sum("b").over(Window.partitionBy()).alias("whole"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row_base"),
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias("byte_base"),
    )
    placed = (
        kept.join(starts, "part")
        .withColumn("rank", F.col("row_base") + F.col("rows_before"))
        .withColumn("middle", F.col("byte_base") + F.col("bytes_before") + F.expr("size div 2"))
        .withColumn("shard", F.expr(f"cast(cast(middle as decimal(38,0)) * {shards} div whole as int)"))
        .select("doc_id", "size", "text_crc32", "shard", "rank")
    )
    first = placed.groupBy("shard").agg(F.min("rank").alias("first_rank"))
    return placed.join(F.broadcast(first), "shard").select(  # one row per shard
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rank") - F.col("first_rank")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
