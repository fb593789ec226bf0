"""Relational fleet data: owners, trucks, drivers and trips.

Joins carry no broadcast hints. Spark broadcasts a dimension whose size it knows to be under
`spark.sql.autoBroadcastJoinThreshold`, and otherwise sort-merges with adaptive splitting of skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trip_fact(trips: DataFrame, trucks: DataFrame, owners: DataFrame, drivers: DataFrame) -> DataFrame:
    """Every trip with its truck, owner and driver."""
    truck = trucks.select("truck_id", "plate_number", F.concat_ws(" ", "make", "model").alias("vehicle"))
    owner = owners.select("owner_id", F.col("company_name").alias("owner"))
    driver = drivers.select(
        "driver_id",
        F.concat_ws(" ", "first_name", "last_name").alias("driver"),
        F.col("status").alias("driver_status"),
    )
    return (
        trips.join(truck, "truck_id")
        .join(owner, "owner_id")
        .join(driver, "driver_id")
        .select(
            "trip_id",
            "plate_number",
            "vehicle",
            "owner",
            "driver",
            "driver_status",
            "origin",
            "destination",
            "trip_status",
            "distance_km",
            "revenue",
            "actual_start_time",
        )
    )


def plate_history(fact: DataFrame, plate: str) -> DataFrame:
    """Trips of one vehicle by number plate, newest first; no rows means the plate is unknown.

    One flat row per trip, so a vehicle with very many trips is still a distributed result.
    """
    mine = fact.where(F.col("plate_number") == plate.strip().upper())
    seen = mine.groupBy("plate_number").agg(F.max("actual_start_time").alias("last_seen"))
    return _history(mine.join(seen, "plate_number"))


def _history(rows: DataFrame) -> DataFrame:
    return (
        rows.select(
            F.col("plate_number").alias("plate"),
            "vehicle",
            "owner",
            "driver",
            "driver_status",
            "last_seen",
            "trip_id",
            F.substring("actual_start_time", 1, 10).alias("date"),
            F.concat_ws(" - ", "origin", "destination").alias("route"),
            F.initcap(F.replace("trip_status", F.lit("_"), F.lit(" "))).alias("status"),
            F.concat(F.round("distance_km").cast("bigint").cast("string"), F.lit(" km")).alias("distance"),
        )
        .orderBy(F.col("date").desc(), F.col("trip_id").desc())
    )


def plate_trips(
    trips: DataFrame, trucks: DataFrame, owners: DataFrame, drivers: DataFrame, plate: str
) -> DataFrame:
    """plate_history straight from the tables: the plate is resolved to its truck first, and trips are read once.

    The trucks of a plate are few and broadcast by their size; their ids filter the scan of trips at run time, so trips
    laid out by truck (`write_trips`) are read in one bucket's files only, and no exchange moves trips of other trucks.
    """
    own = trucks.where(F.col("plate_number") == plate.strip().upper())
    truck = own.select("truck_id", "plate_number", F.concat_ws(" ", "make", "model").alias("vehicle"))
    mine = trips.join(F.broadcast(truck), "truck_id")
    owner = owners.select("owner_id", F.col("company_name").alias("owner"))
    driver = drivers.select(
        "driver_id", F.concat_ws(" ", "first_name", "last_name").alias("driver"), F.col("status").alias("driver_status")
    )
    fact = mine.join(owner, "owner_id").join(driver, "driver_id")
    seen = F.max("actual_start_time").over(Window.partitionBy("plate_number"))
    return _history(fact.withColumn("last_seen", seen))


def write_trips(trips: DataFrame, table: str, buckets: int) -> None:
    """Trips as a table bucketed and sorted by truck: joins and groups by truck need no exchange of trips."""
    trips.repartition(buckets, "truck_id").write.mode("overwrite").bucketBy(buckets, "truck_id").sortBy("truck_id").saveAsTable(table)


def first_trip(trips: DataFrame) -> DataFrame:
    return trips.select("trip_id", "origin", "destination", "trip_status").orderBy("trip_id").limit(1)
