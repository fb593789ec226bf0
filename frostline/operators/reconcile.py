"""Round-trip reconciliation of what was sent with what arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_events(sent: DataFrame, received: DataFrame, key: str = "event_id") -> DataFrame:
    """Sent rows that never arrived."""
    return sent.join(received.select(key), key, "left_anti")


def changed_buckets(sent: DataFrame, received: DataFrame, key: str = "event_id", buckets: int = 65_536) -> DataFrame:
    """Hash buckets of keys in which the two sides differ, with the keys and a checksum of each side.

    A side is reduced to one row per bucket before anything is shuffled: how many keys, the sum of a hash of each, and
    the exclusive or of another. Buckets that agree in all three hold the same keys, but for a chance of about 2^-128.
    """

    def sums(rows: DataFrame, side: str) -> DataFrame:
        return rows.groupBy(_bucket(key, buckets)).agg(
            F.count(F.lit(1)).alias(f"{side}_keys"),
            F.sum(F.xxhash64(key, F.lit(1)).cast("decimal(38,0)")).alias(f"{side}_sum"),
            F.bit_xor(F.xxhash64(F.lit(2), key)).alias(f"{side}_xor"),
        )

    both = sums(sent, "sent").join(sums(received, "received"), "bucket", "full")
    same = F.lit(True)
    for figure in ("keys", "sum", "xor"):
        same = same & F.col(f"sent_{figure}").eqNullSafe(F.col(f"received_{figure}"))
    return both.where(~same)


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


def missing_events_by_checksum(
    sent: DataFrame, received: DataFrame, key: str = "event_id", buckets: int = 65_536
) -> DataFrame:
    """missing_events for sides that nearly agree: only rows in buckets that differ are joined.

    Which buckets differ is a table of at most `buckets` rows, so it is broadcast; rows of the other buckets are dropped in
    the scan and never shuffled. Three lost events among 10^12 cost the join of three buckets, not of both tables.
    """
    differing = changed_buckets(sent, received, key, buckets).select("bucket")
    narrowed = [
        rows.withColumn("bucket", _bucket(key, buckets)).join(F.broadcast(differing), "bucket", "left_semi").drop("bucket")
        for rows in (sent, received.select(key))
    ]
    return narrowed[0].join(narrowed[1], key, "left_anti")


def roundtrip_counts(sent: DataFrame, received: DataFrame, key: str = "event_id") -> DataFrame:
    """One row: how many were sent, received, lost, and received too often. Both sides are reduced per key before they meet."""
    both = (
        sent.select(key, F.lit(1).alias("s"), F.lit(0).alias("r"))
        .unionByName(received.select(key, F.lit(0).alias("s"), F.lit(1).alias("r")))
        .groupBy(key)
        .agg(F.sum("s").alias("s"), F.sum("r").alias("r"))
    )
    total = both.agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("produced"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("consumed"),
        F.coalesce(F.sum(F.greatest(F.col("s") - F.col("r"), F.lit(0))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.greatest(F.col("r") - F.col("s"), F.lit(0))), F.lit(0)).alias("duplicated"),
    )
    return total.withColumn("complete", (F.col("missing") == 0) & (F.col("duplicated") == 0))
