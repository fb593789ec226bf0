import random

import pytest
from pyspark.sql import functions as F

from frostline.config import Settings
from frostline.functions import mean_from_fixed, ratio
from frostline.operators import bottleneck, performance
from frostline.operators.ordered import running_totals
from tests.model import bottleneck_model, lifecycle_model, percentile_model


def samples(spark, values, run="r"):
    rows = [(run, float(v), False, i * 1_000_000) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "run STRING, latency_ms DOUBLE, failed BOOLEAN, event_us BIGINT")


def test_percentile_interpolates(spark):
    (row,) = performance.latency_percentiles(samples(spark, [1, 2, 3, 4]), ["run"]).collect()
    assert (row.samples, row.p50) == (4, 2.5)


def test_percentiles_of_no_samples_are_no_rows(spark):
    assert performance.latency_percentiles(samples(spark, []), ["run"]).collect() == []


@pytest.mark.parametrize("chunk_rows", [1, 1_000_000])
def test_samples_without_latency(spark, chunk_rows):
    rows = [("r", v, False, i) for i, v in enumerate([1.0, 2.0, 3.0, 4.0, None])]
    rows += [("r", None, True, 9), ("lost", None, True, 1)]
    df = spark.createDataFrame(rows, "run STRING, latency_ms DOUBLE, failed BOOLEAN, event_us BIGINT")
    (row,) = performance.latency_percentiles(df, ["run"], cfg=Settings(chunk_rows=chunk_rows)).collect()
    assert (row.run, row.samples, row.p50) == ("r", 4, 2.5)
    got = {r.run: r for r in performance.throughput_summary(df, ["run"], Settings(chunk_rows=chunk_rows)).collect()}
    assert (got["r"].processed, got["r"].error_count, got["r"].average_latency_ms) == (5, 1, 2.5)
    assert got["r"].failure_rate == 0.166667 and (got["lost"].average_latency_ms, got["lost"].p95_latency_ms) == (0.0, 0.0)


def test_rates_of_very_long_runs(spark):
    one = spark.range(1).select(
        ratio(F.lit(10**11).cast("decimal(20,0)") * 10**6, F.lit(5 * 10**6).cast("bigint"), 2).alias("rate"),
        mean_from_fixed((F.lit(10**11) * F.lit(150)).cast("decimal(30,0)") * 10**6, F.lit(10**11), 3).alias("mean"),
    )
    assert tuple(one.first()) == (2e10, 150.0)


@pytest.mark.parametrize("chunk_rows", [2, 1000])
def test_running_totals_keep_rows_without_order(spark, chunk_rows):
    rows = [("k", None, 5), ("k", 4, 1), ("k", 1, 2), ("k", 2, 3), ("k", 7, 4), ("other", None, 1)]
    df = spark.createDataFrame(rows, "key STRING, seq BIGINT, n BIGINT")
    got = running_totals(df, ["key"], "seq", {"n": "so_far"}, chunk_rows, {"n": "whole"}).collect()
    assert {(r.key, r.seq): (r.so_far, r.whole) for r in got} == {
        ("k", None): (5, 15), ("k", 1): (7, 15), ("k", 2): (10, 15), ("k", 4): (11, 15), ("k", 7): (15, 15), ("other", None): (1, 1)
    }


def test_transitions_apply_to_alerts_of_the_rule(spark):
    rows = [("n", i, i * 10, 900.0 if bad else 1.0, 0.0, 5.0, 1.0) for i, bad in enumerate([1, 1, 1, 0, 1, 1])]
    columns = "node_id STRING, seq BIGINT, completed_us BIGINT, p95_latency_ms DOUBLE, failure_rate DOUBLE, actual_rate DOUBLE, target_rate DOUBLE"
    alerts = bottleneck.bottleneck_alerts(spark.createDataFrame(rows, columns))
    moves = [("n:LATENCY_SPIKE:1", 1, "ACKNOWLEDGED", 15), ("n:LATENCY_SPIKE:1", 2, "RESOLVED", 99), ("n:LATENCY_SPIKE:5", 1, "RESOLVED", 55)]
    state = bottleneck.alert_state(alerts, spark.createDataFrame(moves, "id STRING, seq BIGINT, status STRING, at_us BIGINT"))
    got = {r.id: (r.status, r.acknowledged_us, r.resolved_us) for r in state.collect()}
    assert got == {"n:LATENCY_SPIKE:1": ("RESOLVED", 15, 30), "n:LATENCY_SPIKE:5": ("RESOLVED", None, 55)}
    assert bottleneck.failure_counters(state, 0).first().resolved_today == 2


@pytest.mark.parametrize("chunk_rows", [3, 1_000_000])
def test_percentiles_match_a_sorted_list(spark, chunk_rows):
    rng = random.Random(4)
    data = {f"r{i}": [round(rng.expovariate(0.02), rng.choice([0, 2])) for _ in range(n)] for i, n in enumerate([1, 2, 50, 400])}
    df = None
    for run, values in data.items():
        part = samples(spark, values, run)
        df = part if df is None else df.union(part)
    got = performance.latency_percentiles(df, ["run"], cfg=Settings(chunk_rows=chunk_rows)).collect()
    for r in got:
        for p in (50, 95, 99):
            assert r[f"p{p}"] == percentile_model(data[r.run], p), (r.run, p)


def test_throughput_summary(spark):
    df = samples(spark, [10, 20, 30, 40]).withColumn("failed", F.col("latency_ms") == 40)
    (r,) = performance.throughput_summary(df, ["run"]).collect()
    assert (r.processed, r.error_count, r.duration_seconds, r.actual_rate) == (3, 1, 3.0, 1.0)
    assert (r.average_latency_ms, r.p95_latency_ms, r.failure_rate) == (25.0, 38.5, 0.25)


def test_histogram_is_cumulative(spark):
    rows = performance.latency_histogram(samples(spark, [1, 5, 6, 700, 9000])).collect()
    assert {r.le: r.samples for r in rows} == {
        "0.001": 1, "0.005": 2, "0.01": 3, "0.05": 3, "0.1": 3, "0.5": 3, "1.0": 4, "5.0": 4, "+Inf": 5,
    }


def test_samples_without_latency_are_in_no_bucket(spark):
    rows = [("r", v, False, i) for i, v in enumerate([1.0, None, None])]
    df = spark.createDataFrame(rows, "run STRING, latency_ms DOUBLE, failed BOOLEAN, event_us BIGINT")
    assert {r.le: r.samples for r in performance.latency_histogram(df).collect()}["+Inf"] == 1


def test_sketches_merge_and_stay_near(spark):
    """Sketches of parts, merged, against exact ranks over far more samples than a sketch holds."""
    rng = random.Random(12)
    values = [rng.expovariate(0.01) for _ in range(30_000)]
    df = spark.createDataFrame([("r", i % 7, v) for i, v in enumerate(values)] + [("r", 0, None), ("none", 0, None)], "run STRING, part INT, latency_ms DOUBLE")
    parts = performance.latency_sketches(df, ["run", "part"])
    (row,) = performance.sketched_percentiles(performance.merge_sketches(parts, ["run"]), ["run"]).collect()
    assert (row.run, row.timed) == ("r", 30_000)
    for p in (50, 95, 99):
        rank = sum(v <= row[f"p{p}"] for v in values) / len(values)
        assert abs(rank - p / 100) < 0.0133
    assert parts.agg(F.max(F.octet_length("sketch"))).first()[0] < 20_000


@pytest.mark.parametrize("chunk_rows", [1, 1_000_000])
def test_delivery_totals_run_across_windows(spark, chunk_rows):
    rows = [("t", s * 1_000_000, ok) for s, ok in [(0, True), (1, False), (6, True), (21, True)]]
    reports = spark.createDataFrame(rows, "topic STRING, event_us BIGINT, delivered BOOLEAN")
    got = performance.delivery_stats(reports, 5, Settings(chunk_rows=chunk_rows)).orderBy("window_start").collect()
    assert [(r.window_start, r.published, r.delivered, r.errors) for r in got] == [(0, 2, 1, 1), (5, 3, 2, 1), (20, 4, 3, 1)]
    assert [(r.delivery_percent, r.current_rate, r.overall_rate) for r in got] == [(50.0, 0.4, 0.4), (66.67, 0.2, 0.3), (75.0, 0.2, 0.2)]


TESTS = (
    "node_id STRING, seq BIGINT, completed_us BIGINT, p95_latency_ms DOUBLE, failure_rate DOUBLE, actual_rate DOUBLE, "
    "target_rate DOUBLE, average_latency_ms DOUBLE"
)


def test_third_violation_raises_nothing_new(spark):
    rows = [("processor", i, i, 10.0, 0.0, 400.0, 1000.0, 1.0) for i in range(3)]
    (alert,) = bottleneck.bottleneck_alerts(spark.createDataFrame(rows, TESTS)).collect()
    assert (alert.triggered_us, alert.alert_type, alert.severity, alert.status) == (1, "THROUGHPUT_DROP", "HIGH", "TRIGGERED")
    assert (alert.current_value, alert.threshold) == (400.0, 700.0)
    assert alert.description == "Throughput Drop detected during throughput test."


@pytest.mark.parametrize("chunk_rows", [1, 3, 1_000_000])
def test_bottlenecks_match_the_test_by_test_model(spark, chunk_rows):
    rng = random.Random(8)
    by_node = {}
    for node in ("a", "b"):
        by_node[node] = [
            {
                "seq": i,
                "completed_us": 1000 + i,
                "p95_latency_ms": rng.choice([10.0, 10.0, 10.0, 501.0]),
                "failure_rate": rng.choice([0.0, 0.0, 0.06]),
                "actual_rate": rng.choice([900.0, 900.0, 100.0]),
                "target_rate": 1000.0,
            }
            for i in range(200 if node == "a" else 40)
        ]
    rows = [(n, *t.values(), 1.0) for n, tests in by_node.items() for t in tests]
    got = bottleneck.bottleneck_alerts(spark.createDataFrame(rows, TESTS), Settings(chunk_rows=chunk_rows)).collect()
    found = sorted((r.node_id, r.triggered_us - 1000, r.alert_type, r.severity, r.resolved_us or 0) for r in got)
    expected = sorted((n, s, k, v, at or 0) for n, t in by_node.items() for s, k, v, at in bottleneck_model(t))
    assert found == expected and len(expected) > 10


def test_alert_life_cycle_matches_row_updates(spark):
    rng = random.Random(3)
    moves = [(f"a{rng.randrange(40)}", i, rng.choice(["ACKNOWLEDGED", "ACKNOWLEDGED", "RESOLVED"]), i * 10) for i in range(120)]
    alerts = spark.createDataFrame([(f"a{i}", "n", "HIGH", i) for i in range(45)], "id STRING, node_id STRING, severity STRING, triggered_us BIGINT")
    state = bottleneck.alert_state(alerts, spark.createDataFrame(moves, "id STRING, seq BIGINT, status STRING, at_us BIGINT"))
    got = {r.id: (r.status, r.acknowledged_us, r.resolved_us) for r in state.collect()}
    expected = {f"a{i}": lifecycle_model([(s, at) for a, _, s, at in moves if a == f"a{i}"]) for i in range(45)}
    assert got == expected

    active = [k for k, v in expected.items() if v[0] != "RESOLVED"]
    newest = bottleneck.alert_history(state, active_only=True, limit=3).collect()
    assert [r.id for r in newest] == sorted(active, key=lambda a: -int(a[1:]))[:3]


def test_node_status(spark):
    tests = spark.createDataFrame([("p", 0, 0, 9.0, 0.0, 5.0, 5.0, 2.0), ("p", 1, 7, 8.0, 0.1, 4.0, 5.0, 3.0), ("q", 0, 1, 1.0, 0.0, 1.0, 1.0, 1.0)], TESTS)
    alerts = spark.createDataFrame([("x", "p", "CRITICAL", "ACKNOWLEDGED", 5), ("y", "q", "HIGH", "RESOLVED", 6)], "id STRING, node_id STRING, severity STRING, status STRING, triggered_us BIGINT")
    got = {r.node_id: (r.status, r.severity, r.throughput, r.measured_us) for r in bottleneck.node_status(tests, alerts).collect()}
    assert got == {"p": ("BOTTLENECK", "CRITICAL", 4.0, 7), "q": ("HEALTHY", "INFO", 1.0, 1)}
