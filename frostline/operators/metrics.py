"""Counters and gauges of the dashboards, computed from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.config import Settings
from frostline.functions import ratio
from frostline.operators.anomalies import latest_readings


def events_by_customer(telemetry: DataFrame) -> DataFrame:
    return telemetry.groupBy("customer_id").agg(F.count(F.lit(1)).alias("events"))


def dashboard_metrics(telemetry: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Gauges as (metric, value) rows: active trucks, events per second in the newest window, open temperature
    alerts, and uptime as the share of time windows that have data. Two scans: one by window, one by truck."""
    slots = telemetry.groupBy(F.call_function("div", F.col("event_us"), F.lit(cfg.window_us)).alias("slot")).agg(
        F.count(F.lit(1)).alias("n")
    )
    span = F.max("slot") - F.min("slot") + 1

    def gauges(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
        one = rows.agg(*[F.coalesce(v.cast("double"), F.lit(0.0)).alias(name) for name, v in values.items()])
        cells = [c for name in values for c in (F.lit(name), F.col(name))]
        return one.select(F.stack(F.lit(len(values)), *cells).alias("metric", "value"))

    by_window = {
        "events_per_second": ratio(F.max_by("n", "slot"), F.lit(cfg.window_seconds), 3),
        "uptime_percent": ratio(F.count(F.lit(1)) * 100, span, 1),
    }
    by_truck = {"active_trucks": F.count(F.lit(1)), "temperature_alerts": F.count_if("hot")}
    return gauges(slots, by_window).unionByName(gauges(latest_readings(telemetry, cfg), by_truck))
