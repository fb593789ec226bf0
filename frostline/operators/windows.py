"""Event-time windows per truck with exact out-of-order handling.

Input rows need `customer_id, truck_id, arrival_seq BIGINT, event_us BIGINT, temperature DOUBLE,
target_temperature DOUBLE`; other columns pass through. `arrival_seq` is the order of arrival within a truck.

Rules reproduced here, per truck and in arrival order:

* the watermark is the largest event time seen so far minus the grace period;
* an event older than the watermark is late, whatever window it falls in, and changes no aggregate;
* every other event updates its own window, even if newer windows are already open;
* the *head* window is the one that holds the largest event time seen so far; a late event reports it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.config import Settings
from frostline.functions import fixed_point, mean_from_fixed, micros_to_seconds, round_half_away, window_floor
from frostline.operators.ordered import (
    CHUNK,
    before_chunk,
    before_here,
    drop_carry,
    earlier_chunks,
    find_hot_keys,
    hot_rows,
    is_real,
    one_chunk,
    seed_chunks,
    split_hot_keys,
    up_to_here,
    with_carry,
)

TRUCK = ["customer_id", "truck_id"]
ORDER = "arrival_seq"


def valid_readings(telemetry: DataFrame) -> DataFrame:
    """A reading of exactly zero is a sensor fault, not a temperature."""
    return telemetry.where(F.col("temperature") != 0)


def _judge(rows: DataFrame, cfg: Settings) -> DataFrame:
    """Watermark state, lateness and the window each row reports to, inside its chunk."""
    return (
        rows.withColumn("max_event_us", F.max("event_us").over(up_to_here(TRUCK, ORDER)))
        .withColumn("late", F.col("event_us") < F.col("max_event_us") - F.lit(cfg.grace_us))
        .withColumn("own_window_us", window_floor(F.col("event_us"), cfg.window_us))
        .withColumn("head_window_us", window_floor(F.col("max_event_us"), cfg.window_us))
    )


def _watermark_carry(split: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """One carry row per hot chunk: the largest event time of all earlier chunks."""
    summary = hot_rows(split).groupBy(*TRUCK, CHUNK).agg(F.max("event_us").alias("chunk_max_us"))
    if seeds is not None:
        known = hot_rows(seeds).where(F.col("event_us").isNotNull())
        summary = summary.unionByName(known.select(*TRUCK, CHUNK, F.col("event_us").alias("chunk_max_us")))
    return (
        summary.withColumn("event_us", F.max("chunk_max_us").over(before_chunk(TRUCK)))
        .where(F.col("event_us").isNotNull())
        .select(*TRUCK, CHUNK, "event_us")
    )


def judge_lateness(telemetry: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Add `max_event_us`, `late`, `own_window_us`, `head_window_us` to every reading."""
    split = split_hot_keys(telemetry, TRUCK, ORDER, cfg.chunk_rows)
    return drop_carry(_judge(with_carry(split, _watermark_carry(split)), cfg))


def late_events(telemetry: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Readings older than their truck's watermark on arrival."""
    return judge_lateness(telemetry, cfg).where("late")


def window_aggregates(telemetry: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Final aggregate per (truck, window) over the readings that were not late."""
    judged = judge_lateness(telemetry, cfg).where(~F.col("late"))
    state = (
        judged.withColumnRenamed("own_window_us", "window_us")
        .groupBy(*TRUCK, "window_us")
        .agg(
            F.count(F.lit(1)).alias("sample_count"),
            F.sum(fixed_point(F.col("temperature"))).alias("sum_fixed"),
            F.min("temperature").alias("min_raw"),
            F.max("temperature").alias("max_raw"),
            F.max_by("target_temperature", ORDER).alias("target_raw"),
        )
    )
    return finish_aggregate(state, cfg)


def finish_aggregate(state: DataFrame, cfg: Settings = Settings(), *extra: str) -> DataFrame:
    """Window state to the published aggregate. The breach test looks at the rounded average."""
    average = mean_from_fixed(F.col("sum_fixed"), F.col("sample_count"))
    return state.select(
        *extra,
        *TRUCK,
        micros_to_seconds(F.col("window_us")).alias("window_start"),
        micros_to_seconds(F.col("window_us") + F.lit(cfg.window_us)).alias("window_end"),
        "sample_count",
        average.alias("avg_temperature"),
        round_half_away(F.col("min_raw")).alias("min_temperature"),
        round_half_away(F.col("max_raw")).alias("max_temperature"),
        round_half_away(F.col("target_raw")).alias("target_temperature"),
        ((average > F.lit(cfg.safe_temp_max)) | (average < F.lit(cfg.safe_temp_min))).alias("is_breached"),
    )


def breached_windows(telemetry: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    return window_aggregates(telemetry, cfg).where("is_breached")


def latest_window(telemetry: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """The newest window of every truck."""
    aggregates = window_aggregates(telemetry, cfg)
    value = [c for c in aggregates.columns if c not in TRUCK]
    return (
        aggregates.groupBy(*TRUCK)
        .agg(F.max_by(F.struct(*value), "window_start").alias("newest"))
        .select(*TRUCK, "newest.*")
    )


def _report(judged: DataFrame) -> DataFrame:
    """What each row adds to which window.

    A late reading adds nothing and reports the head window. A carry row adds what earlier chunks left behind.
    """
    real = is_real()
    own = real & ~F.col("late")
    head = own & (F.col("own_window_us") == F.col("head_window_us"))

    def added(reading, carried: str):
        return F.when(own, reading).when(~real, F.col(f"carry.{carried}"))

    return judged.withColumns(
        {
            "window_us": F.when(real & F.col("late"), F.col("head_window_us"))
            .when(real, F.col("own_window_us"))
            .otherwise(F.col("carry.window_us")),
            "add_count": added(F.lit(1).cast("bigint"), "n"),
            "add_fixed": added(fixed_point(F.col("temperature")), "total"),
            "add_min": added(F.col("temperature"), "low"),
            "add_max": added(F.col("temperature"), "high"),
            "add_target": added(F.col("target_temperature"), "target"),
            "head_temperature": F.when(head, F.col("temperature")).when(~real, F.col("carry.head")),
        }
    )


_CARRY = (
    "struct<window_us: bigint, n: bigint, total: bigint, low: double, high: double, target: double, head: double>"
)


def _carry(**fields) -> Column:
    names = ("window_us", "n", "total", "low", "high", "target", "head")
    return F.struct(*[fields.get(n, F.lit(None)).alias(n) for n in names]).cast(_CARRY).alias("carry")


_PARTS = ("n", "total", "low", "high", "target")


def _chunk_carry(reported: DataFrame, seeds: DataFrame | None) -> DataFrame:
    """Carry rows with what earlier chunks left behind: one for each window that a chunk reports to, with the aggregate of
    that window, the largest event time and the last head-window temperature. One pass over the hot rows gives all three."""
    at_head = F.when(F.col("head_temperature").isNotNull(), F.col(ORDER))
    summary = reported.groupBy(*TRUCK, "window_us", CHUNK).agg(
        F.sum("add_count").alias("n"),
        F.sum("add_fixed").alias("total"),
        F.min("add_min").alias("low"),
        F.max("add_max").alias("high"),
        F.max_by("add_target", F.when(F.col("add_count").isNotNull(), F.col(ORDER))).alias("target"),
        F.max("event_us").alias("top"),
        F.max_by("head_temperature", at_head).alias("head"),
        F.max(at_head).alias("head_at"),
    )
    if seeds is not None:
        parts = [F.col(f"carry.{c}").alias(c) for c in _PARTS]
        none = F.lit(None).cast("bigint").alias("head_at")
        summary = summary.unionByName(
            hot_rows(seeds).select(*TRUCK, "carry.window_us", CHUNK, *parts, F.col("event_us").alias("top"), "carry.head", none)
        )
    in_window = before_chunk([*TRUCK, "window_us"])
    in_truck = earlier_chunks(TRUCK)
    head = F.when(F.col("head").isNotNull(), F.struct(CHUNK, "head_at", "head"))
    return (
        summary.select(
            *TRUCK,
            CHUNK,
            "window_us",
            F.max("top").over(in_truck).alias("event_us"),
            F.max(head).over(in_truck).getField("head").alias("head"),
            F.sum("n").over(in_window).alias("n"),
            F.sum("total").over(in_window).alias("total"),
            F.min("low").over(in_window).alias("low"),
            F.max("high").over(in_window).alias("high"),
            F.last("target", ignorenulls=True).over(in_window).alias("target"),
        )
        .where(F.col("event_us").isNotNull() | F.col("head").isNotNull() | F.col("n").isNotNull())
        .select(*TRUCK, CHUNK, "event_us", _carry(**{c: F.col(c) for c in ("window_us", *_PARTS, "head")}))
    )


def arrival_states(
    telemetry: DataFrame,
    cfg: Settings = Settings(),
    carried: DataFrame | None = None,
    hot_keys: DataFrame | None = None,
    any_hot: bool = True,
) -> DataFrame:
    """The state each reading left its truck in, one row per reading.

    Adds `max_event_us`, `late`, `window_us`, the running `sample_count, sum_fixed, min_raw, max_raw, target_raw` of
    that window, `previous_temperature`: the last temperature of the truck's newest window before the reading, and
    `head_temperature`, the same after it. `carried` continues from the result of `carry_over` on earlier readings.
    Who has counted them already gives `hot_keys` (find_hot_keys), or says with `any_hot` that there are none.
    """
    none = F.lit(None).cast(_CARRY)
    if any_hot:
        hot_keys = find_hot_keys(telemetry, TRUCK, cfg.chunk_rows) if hot_keys is None else hot_keys
        split = split_hot_keys(telemetry, TRUCK, ORDER, cfg.chunk_rows, hot_keys).withColumn("carry", none)
        seeds = seed_chunks(carried, TRUCK, hot_keys) if carried is not None else None
        hot = _report(_judge(with_carry(hot_rows(split), _watermark_carry(split, seeds)), cfg)).where(is_real())
        carry = [_chunk_carry(hot, seeds)]
        if seeds is not None:
            carry.append(seeds.where(F.col(CHUNK) == 0))
    else:
        split = one_chunk(telemetry).withColumn("carry", none)
        carry = [one_chunk(carried)] if carried is not None else []
    rows = with_carry(split, *carry)

    here = up_to_here([*TRUCK, "window_us"], ORDER)
    head = F.last("head_temperature", True)
    stated = (
        _report(_judge(rows, cfg))
        .withColumns(
            {
                "previous_temperature": head.over(before_here(TRUCK, ORDER)),
                "latest_head": head.over(up_to_here(TRUCK, ORDER)),
            }
        )
        .withColumns(
            {
                "sample_count": F.sum("add_count").over(here),
                "sum_fixed": F.sum("add_fixed").over(here),
                "min_raw": F.min("add_min").over(here),
                "max_raw": F.max("add_max").over(here),
                "target_raw": F.last("add_target", True).over(here),
            }
        )
    )
    return drop_carry(stated).select(
        *telemetry.columns,
        "max_event_us",
        "late",
        "window_us",
        "sample_count",
        "sum_fixed",
        "min_raw",
        "max_raw",
        "target_raw",
        "previous_temperature",
        F.col("latest_head").alias("head_temperature"),
    )


def carry_over(states: DataFrame, cfg: Settings = Settings(), carried: DataFrame | None = None) -> DataFrame:
    """What later readings must know of `states` (from arrival_states) and of what was carried into it.

    A row per truck and window that an accepted reading can still reach, or one for a truck without any. One of them also
    holds the truck's largest event time and last head temperature. Readings are merged by one ordinary aggregate, so
    what is gathered per truck is its windows.
    """
    parts = dict(zip(_PARTS, ("sample_count", "sum_fixed", "min_raw", "max_raw", "target_raw"), strict=True))
    spans = states.select(
        *TRUCK,
        "window_us",
        F.col("max_event_us").alias("top"),
        F.col("head_temperature").alias("head"),
        F.col(ORDER).alias("head_at"),
        *[F.col(c).alias(name) for name, c in parts.items()],
        F.col(ORDER).alias("at"),
    )
    if carried is not None:
        earlier = F.lit(-1).cast("bigint")
        old = carried.select(
            *TRUCK,
            "carry.window_us",
            F.col("event_us").alias("top"),
            "carry.head",
            F.when(F.col("carry.head").isNotNull(), earlier).alias("head_at"),
            *[F.col(f"carry.{c}").alias(c) for c in _PARTS],
            F.when(F.col("carry.window_us").isNotNull(), earlier).alias("at"),
        )
        spans = spans.unionByName(old)

    # Values one by one and not as a struct: they fit a hash aggregate, which need not sort the readings.
    windows = spans.groupBy(*TRUCK, "window_us").agg(
        F.max("top").alias("top"),
        F.max_by("head", "head_at").alias("head"),
        F.max("head_at").alias("head_at"),
        *[F.max_by(c, "at").alias(c) for c in _PARTS],
    )
    truck = Window.partitionBy(*TRUCK)
    known = F.col("customer_id").isNotNull() & F.col("truck_id").isNotNull()
    reach = F.col("event_us") - F.lit(cfg.grace_us)
    kept = known & (F.col("window_us") + F.lit(cfg.window_us + cfg.grace_us) >= reach)
    first, kept_if = F.col("first"), lambda c: F.when(F.col("kept"), F.col(c))
    return (
        windows.withColumns(
            {
                "event_us": F.max("top").over(truck),
                "head": F.max_by("head", "head_at").over(truck),
                "first": F.row_number().over(truck.orderBy("window_us")) == 1,
            }
        )
        .withColumn("kept", F.coalesce(kept, F.lit(False)))
        .where(first | F.col("kept"))
        .select(
            *TRUCK,
            F.when(first, F.col("event_us")).alias("event_us"),
            _carry(**{c: kept_if(c) for c in ("window_us", *_PARTS)}, head=F.when(first, F.col("head"))),
        )
    )


def running_aggregates(telemetry: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """The aggregate published after every reading, with the reading that caused it."""
    return finish_aggregate(arrival_states(telemetry, cfg), cfg, ORDER, "late")


def sliding_aggregates(telemetry: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Aggregate per (truck, sliding window).

    Readings are first reduced to panes one slide wide, and only the panes are copied into the windows that
    cover them, so the copies grow with trucks x time and not with the number of readings.
    """
    if cfg.window_us % cfg.slide_us:
        raise ValueError("window_seconds must be a multiple of slide_seconds")
    panes = (
        telemetry.groupBy(*TRUCK, window_floor(F.col("event_us"), cfg.slide_us).alias("pane_us"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(fixed_point(F.col("temperature"))).alias("total"),
            F.min("temperature").alias("low"),
            F.max("temperature").alias("high"),
            F.max_by(F.struct("target_temperature", ORDER), ORDER).alias("last"),
        )
    )
    starts = F.sequence(
        F.col("pane_us") - F.lit(cfg.window_us - cfg.slide_us), F.col("pane_us"), F.lit(cfg.slide_us).cast("bigint")
    )
    state = (
        panes.withColumn("window_us", F.explode(starts))
        .groupBy(*TRUCK, "window_us")
        .agg(
            F.sum("n").alias("sample_count"),
            F.sum("total").alias("sum_fixed"),
            F.min("low").alias("min_raw"),
            F.max("high").alias("max_raw"),
            F.max_by("last.target_temperature", f"last.{ORDER}").alias("target_raw"),
        )
    )
    return finish_aggregate(state, cfg)
