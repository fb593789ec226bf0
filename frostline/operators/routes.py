"""Vehicle routes: filters, trips, distances, summaries and fleet figures.

Vehicles follow schemas.VEHICLES; `route` is the array of points of one vehicle's current route.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.config import Settings
from frostline.functions import js_round
from frostline.operators.ordered import (
    dense_order,
    CHUNK,
    before_chunk,
    before_here,
    drop_carry,
    hot_rows,
    split_hot_keys,
    with_carry,
)

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lng2 - lng1) / 2), F.lit(2.0)
    )
    return F.lit(EARTH_KM) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def route_length_km(route: Column) -> Column:
    """Length of an array of points, two decimals; 0 for fewer than two points."""
    n = F.size(route)
    legs = F.zip_with(
        F.slice(route, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(route, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda p, q: haversine_km(p["lat"], p["lng"], q["lat"], q["lng"]),
    )
    total = F.aggregate(legs, F.lit(0.0), lambda acc, leg: acc + leg)
    return F.when(n > 1, F.round(total, 2)).otherwise(0.0)


def route_distance(points: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Length of the track of every vehicle from `points(vehicle_id, seq, lat, lng)`, two decimals.

    A very long track is cut into chunks; each chunk gets the last point of the previous one as a carry row.
    """
    key = ["vehicle_id"]
    split = split_hot_keys(points, key, "seq", cfg.chunk_rows)
    last_points = (
        hot_rows(split)
        .groupBy(*key, CHUNK)
        .agg(F.max_by(F.struct("lat", "lng"), "seq").alias("p"))
        .select(*key, CHUNK, F.last("p").over(before_chunk(key).rowsBetween(-1, -1)).alias("p"))
        .where(F.col("p").isNotNull())
        .select(*key, CHUNK, "p.lat", "p.lng")
    )
    previous = before_here(key, "seq").rowsBetween(-1, -1)
    legs = drop_carry(
        with_carry(split, last_points).withColumns(
            {"lat0": F.last("lat").over(previous), "lng0": F.last("lng").over(previous)}
        )
    )
    km = haversine_km(F.col("lat0"), F.col("lng0"), F.col("lat"), F.col("lng"))
    return legs.groupBy(*key).agg(
        F.count(F.lit(1)).alias("points"), F.round(F.coalesce(F.sum(km), F.lit(0.0)), 2).alias("distance_km")
    )


def route_filter(
    vehicles: DataFrame,
    truck_id: str | None = None,
    date: str | None = None,
    route: str | None = None,
    truck_type: str | None = None,
) -> DataFrame:
    """Vehicles that match every given value; the date exactly, the others whatever the case."""
    if truck_id:
        vehicles = vehicles.where(F.lower("id") == truck_id.lower())
    if date:
        vehicles = vehicles.where(F.col("telemetry_date") == date)
    if route:
        vehicles = vehicles.where(F.lower("route_name") == route.lower())
    if truck_type:
        vehicles = vehicles.where(F.lower("truck_type") == truck_type.lower())
    return vehicles


def fleet_search(vehicles: DataFrame, text: str = "", status: str = "all") -> DataFrame:
    """Vehicles whose name and id contain the text, whatever the case, and that have the status."""
    wanted = text.strip().lower()
    if wanted:
        vehicles = vehicles.where(F.contains(F.lower(F.concat_ws(" ", "name", "id")), F.lit(wanted)))
    return vehicles if status == "all" else vehicles.where(F.col("status") == status)


def with_point_times(vehicles: DataFrame, as_of: float) -> DataFrame:
    """Give every route point a time: the last point is now, each earlier one a minute before."""
    n = F.size("route")
    timed = F.transform(
        "route",
        lambda p, i: F.struct(
            p["lat"].alias("lat"),
            p["lng"].alias("lng"),
            (F.lit(float(as_of)) - (n - i - 1) * 60.0).alias("timestamp"),
        ),
    )
    return vehicles.withColumn("route", timed)


def route_points(vehicles: DataFrame, as_of: float) -> DataFrame:
    """One row per route point."""
    return with_point_times(vehicles, as_of).select("id", F.posexplode("route").alias("point", "p")).select(
        "id", "point", "p.lat", "p.lng", "p.timestamp"
    )


def trips(vehicles: DataFrame, as_of: float) -> DataFrame:
    """Trip records of the vehicles on their routes."""
    return vehicles.select(
        F.concat(F.lit("trip-"), "id").alias("trip_id"),
        F.col("id").alias("vehicle_id"),
        F.col("name").alias("vehicle"),
        F.when(F.col("status") == "moving", "IN_PROGRESS").otherwise("PAUSED").alias("status"),
        "route",
        F.struct("lat", "lng").alias("current_location"),
        F.col("speed").alias("speed_kmh"),
        route_length_km(F.col("route")).alias("distance_km"),
        "route_name",
        F.lit(float(as_of)).alias("updated_at"),
    )


def find_trip(trip_rows: DataFrame, trip_id: str) -> DataFrame:
    """The trip with this id; no rows means not found."""
    return trip_rows.where(F.col("trip_id") == trip_id)


def first_trips(trip_rows: DataFrame, limit: int = 4) -> DataFrame:
    return trip_rows.orderBy("trip_id").limit(limit)


def route_summary(vehicles: DataFrame) -> DataFrame:
    """Completion, thermal variance, arrival estimate and alert count of every vehicle."""
    delayed = F.col("status") == "delayed"
    points = F.when(F.coalesce(F.size("route"), F.lit(0)) < 1, 1).otherwise(F.size("route"))
    completion = F.least(
        F.greatest(F.lit(60) + points * 8 + F.when(delayed, -10).otherwise(8), F.lit(52)), F.lit(98)
    )
    # The variance is a whole number of hundredths (speed is an integer), so it is rounded on integers.
    hundredths = F.lit(180) + F.col("speed") * 4 + F.when(delayed, 170).otherwise(80)
    eta = F.greatest(F.lit(32) - F.col("speed") / 2 + F.when(delayed, 12).otherwise(0), F.lit(8.0))
    return vehicles.withColumns(
        {
            "completion": completion.cast("bigint"),
            "thermal_variance": F.floor((hundredths + 5) / 10) / 10.0,
            "eta_minutes": js_round(eta),
            "alerts": F.when(delayed, 2).otherwise(0).cast("bigint"),
        }
    )


SORTS = {
    "name": lambda: [F.collate("name", "UNICODE"), F.col("id")],
    "speed": lambda: [F.col("speed").desc(), F.col("id")],
    "eta": lambda: [F.col("eta_minutes"), F.col("id")],
    "thermal": lambda: [F.col("thermal_variance").desc(), F.col("id")],
}


def fleet_positions(summary: DataFrame) -> DataFrame:
    """Each truck with its place, from 1, in all four orders of the fleet list; the id breaks ties.

    Places come from one distributed sort per order (dense_order), never from one task that ranks the whole fleet.
    """
    keyed = summary.withColumns(
        {
            "by_name": F.collate("name", "UNICODE"),
            "by_speed": -F.col("speed"),
            "by_eta": F.col("eta_minutes"),
            "by_thermal": -F.col("thermal_variance"),
        }
    )
    for order in ("name", "speed", "eta", "thermal"):
        keyed = dense_order(keyed, [f"by_{order}", "id"], f"{order}_position").withColumn(f"{order}_position", F.col(f"{order}_position") + 1)
    return keyed.drop("by_name", "by_speed", "by_eta", "by_thermal")


def fleet_sorted(summary: DataFrame, by: str = "name") -> DataFrame:
    """Fleet list in one of the four orders. A range-partitioned sort; the id breaks ties."""
    return summary.orderBy(*SORTS[by]())


def fleet_kpis(summary: DataFrame) -> DataFrame:
    """One row of fleet figures; zeros for an empty fleet."""
    n = F.count(F.lit(1))
    delayed = F.count_if(F.col("status") == "delayed")
    return summary.agg(
        n.alias("total_trucks"),
        F.count_if(F.col("status") == "moving").alias("moving"),
        delayed.alias("delayed"),
        F.when(n > 0, js_round(F.sum("speed") / n)).otherwise(0).alias("average_speed"),
        F.when(n > 0, js_round((n - delayed) * 100 / n)).otherwise(0).alias("on_time_percent"),
        F.coalesce(F.max("thermal_variance"), F.lit(0.0)).alias("max_thermal_variance"),
        F.count_if(F.col("alerts") > 0).alias("trucks_with_alerts"),
    )
