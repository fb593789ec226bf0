import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from frostline.config import Settings
from frostline.operators import anomalies, windows
from tests.model import sustained_model, truck_model

B = 1_787_725_800
COLUMNS = (
    "arrival_seq BIGINT, customer_id STRING, truck_id STRING, event_us BIGINT, temperature DOUBLE, "
    "target_temperature DOUBLE, compressor_status STRING"
)


def readings(spark, rows):
    """rows: (seconds after B, temperature[, truck[, customer[, status]]]) in arrival order."""
    defaults = (None, None, "t1", "c1", "RUNNING")
    data = []
    for seq, row in enumerate(rows):
        seconds, temperature, truck, customer, status = row + defaults[len(row) :]
        data.append((seq, customer, truck, int((B + seconds) * 1_000_000), float(temperature), -18.0, status))
    return spark.createDataFrame(data, COLUMNS)


def running(spark, rows, cfg=Settings()):
    return windows.running_aggregates(readings(spark, rows), cfg).orderBy("arrival_seq").collect()


def test_window_bounds_are_aligned_to_the_epoch(spark):
    (row,) = running(spark, [(12.5, -18)])
    assert (row.window_start, row.window_end) == (B, B + 300)


def test_running_aggregate_of_one_truck(spark):
    rows = running(spark, [(10, -18), (60, -12), (120, -15)])
    assert [(r.sample_count, r.avg_temperature) for r in rows] == [(1, -18.0), (2, -15.0), (3, -15.0)]
    assert (rows[2].min_temperature, rows[2].max_temperature, rows[2].is_breached) == (-18.0, -12.0, False)


def test_trucks_are_kept_apart_by_customer_and_truck(spark):
    rows = running(spark, [(5, -20, "t1", "c1"), (10, -14, "t2", "c1"), (15, -16, "t1", "c2")])
    assert [(r.customer_id, r.truck_id, r.sample_count) for r in rows] == [
        ("c1", "t1", 1),
        ("c1", "t2", 1),
        ("c2", "t1", 1),
    ]


def test_next_window_starts_afresh(spark):
    rows = running(spark, [(100, -18), (350, -22)])
    assert (rows[1].window_start, rows[1].sample_count, rows[1].avg_temperature) == (B + 300, 1, -22.0)


def test_out_of_order_within_grace_updates_its_own_window(spark):
    data = [(299, -18), (320, -22), (299.5, -14)]
    third = running(spark, data)[2]
    assert (third.late, third.window_start, third.sample_count, third.avg_temperature) == (False, B, 2, -16.0)
    (newest,) = windows.latest_window(readings(spark, data)).collect()
    assert newest.window_start == B + 300


def test_late_event_repeats_the_newest_window(spark):
    third = running(spark, [(100, -18), (350, -22), (100, -14)])[2]
    assert (third.late, third.window_start, third.sample_count, third.avg_temperature) == (True, B + 300, 1, -22.0)


def test_late_even_if_its_window_is_open(spark):
    data = [(299, -18), (320, -18), (299.5, -18), (100, -18), (900, -18)]
    (first,) = windows.window_aggregates(readings(spark, data)).where(f"window_start = {B}").collect()
    assert first.sample_count == 2


def test_event_exactly_at_the_watermark_is_accepted(spark):
    rows = running(spark, [(100, -18), (70, -20), (69.999999, -20)])
    assert [r.late for r in rows] == [False, False, True]


def test_event_exactly_at_the_window_end_is_in_the_next(spark):
    assert running(spark, [(300, -18)])[0].window_start == B + 300


@pytest.mark.parametrize("temperature, breached", [(5.0, True), (-10.0, False), (-25.0, False), (-25.01, True), (-9.99, True)])
def test_breach_limits_are_strict(spark, temperature, breached):
    assert running(spark, [(10, temperature)])[0].is_breached is breached


def test_breach_looks_at_the_rounded_average(spark):
    # The average is -9.996 and rounds to -10.0, which is inside the limit.
    rows = running(spark, [(i, t) for i, t in enumerate([-10.0, -10.0, -10.0, -10.0, -9.98])])
    assert (rows[-1].avg_temperature, rows[-1].is_breached) == (-10.0, False)


def alerts(spark, rows):
    found = anomalies.anomaly_alerts(readings(spark, rows)).orderBy("arrival_seq").collect()
    return [(r.arrival_seq, r.alert_type, r.severity) for r in found]


def test_alert_rules_and_their_limits(spark):
    assert alerts(spark, [(0, -5)]) == [(0, "HIGH_TEMPERATURE", "WARNING")]
    assert alerts(spark, [(0, -30)]) == [(0, "LOW_TEMPERATURE", "WARNING")]
    assert alerts(spark, [(0, -10.0), (1, -25.0)]) == []
    assert alerts(spark, [(0, -18), (1, -14)]) == [(1, "RAPID_THERMAL_RISE", "WARNING")]
    assert alerts(spark, [(0, -18), (1, -15)]) == [(1, "RAPID_THERMAL_RISE", "WARNING")]
    assert alerts(spark, [(0, -18), (1, -15.01)]) == []
    assert alerts(spark, [(0, -13.01), (1, -10.01)]) == [(1, "RAPID_THERMAL_RISE", "WARNING")]
    assert alerts(spark, [(0, -5, "t", "c", "FAULT")]) == [(0, "COMPRESSOR_FAILURE", "CRITICAL")]


def test_low_alert_still_reports_the_upper_limit(spark):
    (row,) = anomalies.anomaly_alerts(readings(spark, [(0, -30)])).collect()
    assert row.threshold_limit == -10.0
    assert row.message == "Too cold on truck t1: -30.0 is under -25.0"


def test_late_event_is_still_checked(spark):
    data = [(100, -18), (350, -22), (100, -5)]
    assert alerts(spark, data) == [(2, "HIGH_TEMPERATURE", "WARNING")]
    assert running(spark, data)[2].sample_count == 1


def test_rise_compares_with_the_newest_window_only(spark):
    # The reading at 299.5 lands in the older window, so -22 stays the previous temperature.
    assert alerts(spark, [(299, -18), (320, -22), (299.5, -12), (321, -19)]) == [
        (2, "RAPID_THERMAL_RISE", "WARNING"),
        (3, "RAPID_THERMAL_RISE", "WARNING"),
    ]


def random_events(seed, n, trucks, hot_share):
    rng = random.Random(seed)
    clock, events = B * 1_000_000, []
    for seq in range(n):
        clock += rng.randint(0, 8_000_000)
        truck = "t0" if rng.random() < hot_share else f"t{rng.randrange(trucks)}"
        delay = rng.choice([0, 0, 0, 1, 10, 29, 30, 31, 90]) * 1_000_000
        cents = rng.choice([-3001, -2500, -2200, -1800, -1500, -1301, -1000, -999, -400]) + rng.randint(-1, 1)
        events.append((seq, truck, clock - delay, cents, -18.0 + seq % 3))
    return events


def to_frame(spark, events):
    data = [(s, "c1", k, us, c / 100, t, "RUNNING") for s, k, us, c, t in events]
    return spark.createDataFrame(data, COLUMNS)


@pytest.mark.parametrize("chunk_rows", [1, 7, 50, 1_000_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_states_match_the_event_model_for_any_chunk_size(spark, seed, chunk_rows):
    events = random_events(seed, 600, 6, 0.4)
    cfg = Settings(chunk_rows=chunk_rows)
    states = windows.arrival_states(to_frame(spark, events), cfg)
    finished = windows.finish_aggregate(states, cfg, "arrival_seq", "late", "window_us", "previous_temperature")
    got = {
        r.arrival_seq: (
            r.late,
            r.window_us,
            r.sample_count,
            r.avg_temperature,
            r.min_temperature,
            r.max_temperature,
            r.target_temperature,
            r.previous_temperature,
        )
        for r in finished.collect()
    }
    expected = {e["arrival_seq"]: tuple(list(e.values())[1:]) for e in truck_model(events)}
    assert got == expected
    assert any(e[0] for e in expected.values())


@pytest.mark.parametrize("chunk_rows", [1, 5, 1_000_000])
def test_sustained_alerts_match_the_event_model(spark, chunk_rows):
    rng = random.Random(5)
    events, clock = [], B * 1_000_000
    for seq in range(500):
        clock += rng.randint(0, 6_000_000)
        cents = rng.choice([-800, -750, -999]) if rng.random() < 0.85 else rng.choice([-1000, -1800])
        events.append((seq, f"t{min(rng.randrange(5), 2)}", clock, cents, -18.0))
    fired = anomalies.sustained_alerts(to_frame(spark, events), Settings(chunk_rows=chunk_rows))
    got = {(r.arrival_seq, r.started_us, r.duration_seconds) for r in fired.collect()}
    expected = set(sustained_model([(s, k, us, c) for s, k, us, c, _ in events]))
    assert got == expected and expected


def test_sustained_alert_fires_again_and_shows_the_latest_reading(spark):
    rows = readings(spark, [(0, -8.0), (31, -7.5), (32, -7.4)])
    assert [r.arrival_seq for r in anomalies.sustained_alerts(rows).orderBy("arrival_seq").collect()] == [1, 2]
    (active,) = anomalies.active_temperature_alerts(rows).collect()
    assert (active.temperature, active.duration_seconds) == (-7.4, 32)


def test_sustained_alert_ends_at_the_threshold(spark):
    cfg = replace(Settings(), sustained_seconds=0)
    rows = readings(spark, [(0, -8.0), (0, -10.0)])
    assert anomalies.sustained_alerts(rows, cfg).count() == 1
    assert anomalies.active_temperature_alerts(rows, cfg).count() == 0


def test_active_alerts_include_runs_that_have_not_fired_yet(spark):
    (active,) = anomalies.active_temperature_alerts(readings(spark, [(0, -8.0), (3, -9.0)])).collect()
    assert (active.duration_seconds, active.started_at, active.status) == (3, B, "TRIGGERED")


def test_sliding_windows_through_panes_equal_direct_expansion(spark):
    events = random_events(9, 300, 3, 0.3)
    rows = to_frame(spark, events)
    cfg = Settings(window_seconds=60, slide_seconds=20)
    got = {
        (r.truck_id, r.window_start): (r.sample_count, r.avg_temperature)
        for r in windows.sliding_aggregates(rows, cfg).collect()
    }
    expanded = {}
    for _, truck, us, cents, _ in events:
        for start in range(us - us % 20_000_000 - 40_000_000, us + 1, 20_000_000):
            expanded.setdefault((truck, start / 1e6), []).append(cents)
    assert {k: len(v) for k, v in expanded.items()} == {k: v[0] for k, v in got.items()}


def test_no_hot_key_means_one_exchange_of_readings(spark):
    """Without hot keys the adaptive plan keeps a single exchange that carries readings."""
    rows = to_frame(spark, random_events(3, 200, 5, 0.0))
    df = windows.running_aggregates(rows)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Final Plan") : plan.index("Initial Plan")]
    assert final.count("Exchange hashpartitioning") == 1
    assert "Union" not in final


def test_fixed_point_mean_rounds_half_away_from_zero(spark):
    from frostline.functions import mean_from_fixed

    df = spark.createDataFrame([(-15_125_000 * 2, 2), (15_125_000, 1), (-15_124_999, 1)], "s BIGINT, n BIGINT")
    got = [r.m for r in df.select(mean_from_fixed(F.col("s"), F.col("n")).alias("m")).collect()]
    assert got == [-15.13, 15.13, -15.12]
