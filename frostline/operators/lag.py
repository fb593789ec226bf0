"""Consumer lag: committed offsets against log end offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.config import Settings
from frostline.functions import ratio

GROUP = "consumer_group"


def lag_report(
    group_topics: DataFrame, latest: DataFrame, committed: DataFrame, cfg: Settings = Settings()
) -> DataFrame:
    """Lag of every group on every partition of its topics.

    `group_topics(consumer_group, topic)` says which topics a group is measured on. A partition without a committed
    offset, or with a negative one, counts as committed at 0. The first replica leads the partition.
    """
    at = F.greatest(F.coalesce(F.col("committed"), F.lit(-1)), F.lit(0)).cast("bigint")
    lag = F.greatest(F.col("latest") - at, F.lit(0)).cast("bigint")
    return (
        latest.join(group_topics, "topic")
        .join(committed, [GROUP, "topic", "partition"], "left")
        .select(
            GROUP,
            "topic",
            "partition",
            at.alias("current_offset"),
            F.col("latest").alias("latest_offset"),
            lag.alias("lag"),
            F.try_element_at("replicas", F.lit(1)).alias("broker"),
            (lag > F.lit(cfg.lag_limit)).alias("warning"),
        )
    )


def lag_summary(report: DataFrame, cfg: Settings = Settings(), groups: DataFrame | None = None) -> DataFrame:
    """Totals per group with both health flags: by worst partition (service) and by total (dashboard).

    `groups(consumer_group)` names groups to report in any case; one without partitions has no lag and is healthy.
    """
    if groups is not None:
        report = report.unionByName(groups.select(GROUP).distinct(), allowMissingColumns=True)
    n, none = F.count("partition"), F.lit(0).cast("bigint")
    total, worst = F.coalesce(F.sum("lag"), none), F.coalesce(F.max("lag"), none)
    return report.groupBy(GROUP).agg(
        n.alias("partitions"),
        total.alias("total_lag"),
        worst.alias("max_partition_lag"),
        F.coalesce(ratio(F.sum("lag"), n, 1), F.lit(0.0)).alias("average_partition_lag"),
        F.when(worst < cfg.lag_limit, "healthy").otherwise("degraded").alias("partition_status"),
        F.when(total > cfg.lag_limit, "degraded").otherwise("healthy").alias("total_status"),
    )


def worker_lag(report: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Lag per worker: the first half of the partitions belongs to worker 1, the rest to worker 2."""
    first = F.col("partition") < F.lit(cfg.partitions // 2)
    return report.groupBy(GROUP).agg(
        F.coalesce(F.sum(F.when(first, F.col("lag"))), F.lit(0)).alias("worker1_lag"),
        F.coalesce(F.sum(F.when(~first, F.col("lag"))), F.lit(0)).alias("worker2_lag"),
    )


def group_assignments(members: DataFrame) -> DataFrame:
    """Members and assigned partitions per group. A member without an assignment counts zero partitions."""
    assigned = F.coalesce(F.size(F.coalesce("assignment", F.array().cast("array<int>"))), F.lit(0))
    return members.groupBy(GROUP).agg(
        F.count(F.lit(1)).alias("members"), F.sum(assigned).alias("assigned_partitions")
    )


def group_overview(groups: DataFrame, members: DataFrame, report: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """One row for every group known from anywhere: its state, members, assigned partitions and lag.

    `groups(consumer_group, state)` is what the cluster says of its groups; a group it does not describe has the state
    `unknown`. Groups without members or partitions have zeros.
    """
    known = groups.select(GROUP).union(members.select(GROUP)).union(report.select(GROUP)).distinct()
    none = F.lit(0).cast("bigint")
    return (
        lag_summary(report, cfg, known)
        .join(group_assignments(members), GROUP, "left")
        .join(groups.groupBy(GROUP).agg(F.max("state").alias("state")), GROUP, "left")
        .select(
            GROUP,
            F.coalesce("state", F.lit("unknown")).alias("state"),
            F.coalesce("members", none).alias("members"),
            F.coalesce("assigned_partitions", none).alias("assigned_partitions"),
            "partitions",
            "total_lag",
            "max_partition_lag",
            "average_partition_lag",
            "partition_status",
        )
    )


def group_union(spark: SparkSession, discovered: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Discovered groups and configured ones, each once, in order."""
    configured = spark.range(1).select(F.explode(F.split(F.lit(cfg.lag_groups), ",")).alias(GROUP))
    return discovered.select(GROUP).union(configured).distinct().orderBy(GROUP)


def find_group(rows: DataFrame, group_id: str) -> DataFrame:
    """Rows of one group; no rows means the group is unknown."""
    return rows.where(F.col(GROUP) == group_id)
