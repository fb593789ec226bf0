"""Alerts on single readings and on sustained high temperature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.config import MICROS, Settings
from frostline.functions import is_finite, micros_to_seconds
from frostline.operators.ordered import (
    CHUNK,
    before_chunk,
    drop_carry,
    hot_rows,
    split_hot_keys,
    through_chunk,
    up_to_here,
    with_carry,
)
from frostline.operators.windows import ORDER, TRUCK, arrival_states


def classify(
    temperature: Column, previous_temperature: Column, compressor_status: Column, cfg: Settings = Settings()
) -> Column:
    """Alert type of a reading, null if it is normal. The first rule that holds decides.

    Limits are strict, the rise is inclusive, and a missing or non-finite previous temperature disables the rise.
    """
    rise = temperature - previous_temperature
    return (
        F.when(compressor_status == "FAULT", "COMPRESSOR_FAILURE")
        .when(temperature > F.lit(cfg.safe_temp_max), "HIGH_TEMPERATURE")
        .when(temperature < F.lit(cfg.safe_temp_min), "LOW_TEMPERATURE")
        .when(is_finite(previous_temperature) & (rise >= F.lit(cfg.spike_tolerance)), "RAPID_THERMAL_RISE")
    )


def severity(alert_type: Column) -> Column:
    return F.when(alert_type == "COMPRESSOR_FAILURE", "CRITICAL").when(alert_type.isNotNull(), "WARNING")


def describe(
    alert_type: Column, truck_id: Column, temperature: Column, rise: Column, cfg: Settings = Settings()
) -> Column:
    """Operator-facing text of an alert."""
    return (
        F.when(
            alert_type == "COMPRESSOR_FAILURE",
            F.concat(F.lit("Truck reports a compressor fault: "), truck_id),
        )
        .when(
            alert_type == "HIGH_TEMPERATURE",
            F.concat(
                F.lit("Too warm on truck "),
                truck_id,
                F.lit(": "),
                temperature.cast("string"),
                F.lit(f" is over {cfg.safe_temp_max}"),
            ),
        )
        .when(
            alert_type == "LOW_TEMPERATURE",
            F.concat(
                F.lit("Too cold on truck "),
                truck_id,
                F.lit(": "),
                temperature.cast("string"),
                F.lit(f" is under {cfg.safe_temp_min}"),
            ),
        )
        .when(
            alert_type == "RAPID_THERMAL_RISE",
            F.concat(
                F.lit("Warming fast on truck "),
                truck_id,
                F.format_string(f": %.2f degrees, allowed are {cfg.spike_tolerance}", rise),
            ),
        )
    )


def alerts_from_states(states: DataFrame, cfg: Settings = Settings(), *extra: str) -> DataFrame:
    """Alerts of readings that already carry `previous_temperature`, with `extra` columns of theirs. Late readings are
    checked as well."""
    kind = classify(F.col("temperature"), F.col("previous_temperature"), F.col("compressor_status"), cfg)
    rise = F.col("temperature") - F.col("previous_temperature")
    return (
        states.withColumn("alert_type", kind)
        .where(F.col("alert_type").isNotNull())
        .select(
            *extra,
            ORDER,
            *TRUCK,
            severity(F.col("alert_type")).alias("severity"),
            "alert_type",
            F.col("temperature").alias("trigger_temperature"),
            "target_temperature",
            F.lit(cfg.safe_temp_max).alias("threshold_limit"),
            "compressor_status",
            micros_to_seconds(F.col("event_us")).alias("timestamp"),
            describe(F.col("alert_type"), F.col("truck_id"), F.col("temperature"), rise, cfg).alias("message"),
            F.lit(False).alias("acknowledged"),
        )
    )


def anomaly_alerts(telemetry: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    return alerts_from_states(arrival_states(telemetry, cfg), cfg)


def alerts_by_type(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity", "alert_type").agg(F.count(F.lit(1)).alias("alerts"))


def _run_columns(rows: DataFrame) -> DataFrame:
    """Number of resets so far, and the start of the run a reading belongs to."""
    rows = rows.withColumn("resets", F.count_if(~F.col("hot")).over(up_to_here(TRUCK, ORDER)))
    return rows.withColumn(
        "started_us",
        F.first(F.when(F.col("hot"), F.col("event_us")), ignorenulls=True).over(up_to_here([*TRUCK, "resets"], ORDER)),
    )


def _with_runs(telemetry: DataFrame, cfg: Settings) -> DataFrame:
    """Every reading with `hot` and, for those above the threshold, the start of its uninterrupted run."""
    hot = F.col("temperature") > F.lit(cfg.sustained_threshold)
    split = split_hot_keys(telemetry.withColumn("hot", hot), TRUCK, ORDER, cfg.chunk_rows)

    # Per hot-key chunk: was the run reset inside it, and where did the run that is open at its end start?
    # A chunk without a reset hands on the run it was given, or its own first reading above the threshold.
    chunk_runs = (
        _run_columns(with_carry(hot_rows(split)))
        .groupBy(*TRUCK, CHUNK, "resets")
        .agg(F.min("started_us").alias("started_us"))
        .groupBy(*TRUCK, CHUNK)
        .agg(F.max("resets").alias("resets"), F.max_by("started_us", "resets").alias("open_us"))
        .withColumn("epoch", F.count_if(F.col("resets") > 0).over(through_chunk(TRUCK)))
        .withColumn("open_us", F.first("open_us", ignorenulls=True).over(through_chunk([*TRUCK, "epoch"])))
        .withColumn("event_us", F.last("open_us").over(before_chunk(TRUCK).rowsBetween(-1, -1)))
        .where(F.col("event_us").isNotNull())
        .select(*TRUCK, CHUNK, "event_us", F.lit(True).alias("hot"))
    )
    return drop_carry(_run_columns(with_carry(split, chunk_runs)))


def sustained_runs(telemetry: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Every reading above the threshold with the start of its uninterrupted run and the run's age in seconds.

    A run starts at the first reading above the threshold and ends at the first one at or below it, in arrival
    order. Age is measured in event time, whole seconds, never negative. Other columns, such as a position, are kept.
    """
    runs = _with_runs(telemetry, cfg).where("hot")
    return runs.select(*telemetry.columns, "started_us", _age().alias("duration_seconds"))


def _age() -> Column:
    return F.greatest(F.lit(0).cast("bigint"), _whole_seconds(F.col("event_us") - F.col("started_us")))


def _whole_seconds(micros: Column) -> Column:
    return F.call_function("div", micros, F.lit(MICROS))


def sustained_alerts(telemetry: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """One row per reading at which the sustained high-temperature alert of its truck fires."""
    return sustained_runs(telemetry, cfg).where(F.col("duration_seconds") >= cfg.sustained_seconds)


POSITION = ("latitude", "longitude")


def latest_readings(telemetry: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """The newest reading of every truck: `hot`, temperature, start and age of its run, position if readings have one.

    One scan. A truck of any size is read in chunks, each of which gives its newest reading to a partial maximum.
    """
    wanted = ["hot", "temperature", "event_us", "started_us", *(c for c in POSITION if c in telemetry.columns)]
    newest = _with_runs(telemetry, cfg).groupBy(*TRUCK).agg(F.max_by(F.struct(*wanted), ORDER).alias("latest"))
    return newest.select(*TRUCK, "latest.*").withColumn("duration_seconds", _age())


def active_temperature_alerts(telemetry: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """The open run of every truck whose newest reading is above the threshold, fired or not."""
    return latest_readings(telemetry, cfg).where("hot").select(
        *TRUCK,
        "temperature",
        F.lit(cfg.sustained_threshold).alias("threshold"),
        F.lit("TRIGGERED").alias("status"),
        micros_to_seconds(F.col("started_us")).alias("started_at"),
        "duration_seconds",
        *(c for c in POSITION if c in telemetry.columns),
    )
