"""The bottleneck rule with operators acting on its alerts, automata over ordered rows, and dense orders."""

import random

import pytest
from pyspark.sql import functions as F

from frostline.config import Settings
from frostline.operators import bottleneck
from frostline.operators.automaton import move, scan_states
from frostline.operators.ordered import dense_order, log_order
from tests.model import bottleneck_lifecycle_model, first_violation

TESTS = (
    "node_id STRING, seq BIGINT, completed_us BIGINT, p95_latency_ms DOUBLE, failure_rate DOUBLE, actual_rate DOUBLE, "
    "target_rate DOUBLE"
)
MOVES = "node_id STRING, alert_type STRING, seq BIGINT, status STRING, at_us BIGINT"
FIGURES = ("seq", "completed_us", "p95_latency_ms", "failure_rate", "actual_rate", "target_rate")


def lifecycle(spark, tests, moves, **limits):
    found = bottleneck.bottleneck_lifecycle(spark.createDataFrame(tests, TESTS), spark.createDataFrame(moves, MOVES), Settings(**limits))
    return found.collect()


def drop(seq, at):
    return ("processor", seq, at, 10.0, 0.0, 400.0, 1000.0)


def test_resolving_by_hand_arms_the_rule_again(spark):
    tests = [drop(i, 10 * i) for i in range(6)]
    rows = lifecycle(spark, tests, [("processor", "THROUGHPUT_DROP", 1, "RESOLVED", 25)])
    got = sorted((r.id, r.status, r.triggered_us, r.resolved_us, r.resolved_by) for r in rows)
    # Raised by the second drop, resolved after the third; the count starts anew, so the fifth raises the next one.
    assert got == [
        ("processor:THROUGHPUT_DROP:1", "RESOLVED", 10, 25, "OPERATOR"),
        ("processor:THROUGHPUT_DROP:4", "TRIGGERED", 40, None, None),
    ]


def test_acknowledging_keeps_the_alert_open(spark):
    moves = [("processor", "THROUGHPUT_DROP", i, "ACKNOWLEDGED", at) for i, at in enumerate([5, 15, 25])]
    (row,) = lifecycle(spark, [drop(i, 10 * i) for i in range(6)], moves)
    assert (row.status, row.triggered_us, row.acknowledged_us, row.resolved_us) == ("ACKNOWLEDGED", 10, 25, None)


def test_acts_without_an_open_alert_do_nothing(spark):
    moves = [
        ("processor", "THROUGHPUT_DROP", 1, "RESOLVED", 5),  # one violation so far
        ("processor", "LATENCY_SPIKE", 2, "RESOLVED", 15),  # another type
        ("elsewhere", "THROUGHPUT_DROP", 3, "RESOLVED", 15),  # another node
        ("processor", "THROUGHPUT_DROP", 4, "CLOSED", 15),  # no such status
        (None, None, 5, "RESOLVED", None),
    ]
    (row,) = lifecycle(spark, [drop(0, 0), drop(1, 10), drop(2, 20)], moves)
    assert (row.id, row.status) == ("processor:THROUGHPUT_DROP:1", "TRIGGERED")


def test_an_act_at_the_time_of_the_test_comes_after_it(spark):
    (row,) = lifecycle(spark, [drop(0, 0), drop(1, 10)], [("processor", "THROUGHPUT_DROP", 0, "RESOLVED", 10)])
    assert (row.triggered_us, row.resolved_us, row.resolved_by) == (10, 10, "OPERATOR")


def test_missing_figures_break_no_limit(spark):
    """A test without latencies is judged by its other figures: two limits broken are critical, none is clean."""
    tests = [("n", i, i, None, 0.5, 100.0, 1000.0) for i in range(2)] + [("n", 2, 2, None, None, None, None)]
    for found in (lifecycle(spark, tests, []), bottleneck.bottleneck_alerts(spark.createDataFrame(tests, TESTS)).collect()):
        (row,) = found
        assert (row.alert_type, row.severity, row.status, row.resolved_us) == ("ERROR_RATE_SPIKE", "CRITICAL", "RESOLVED", 2)


def random_node(rng, n):
    tests = [
        (i, 20 * i + rng.randrange(20), rng.choice([10.0, 10.0, 501.0, None]), rng.choice([0.0, 0.0, 0.06]), rng.choice([900.0, 100.0]), 1000.0)
        for i in range(n)
    ]
    kinds = ["LATENCY_SPIKE", "ERROR_RATE_SPIKE", "THROUGHPUT_DROP"]
    acts = [(rng.choice(kinds), i, rng.choice(["ACKNOWLEDGED", "RESOLVED"]), rng.randrange(20 * n)) for i in range(n)]
    return tests, acts


@pytest.mark.parametrize("chunk_rows, needed", [(1, 2), (5, 2), (64, 3), (1_000_000, 2), (7, 1)])
def test_lifecycle_matches_the_step_by_step_model(spark, chunk_rows, needed):
    """A hot node with most of all rows, small ones, one without acts; chunks of one row up to whole nodes."""
    rng = random.Random(chunk_rows + needed)
    nodes = {"hot": random_node(rng, 300), "small": random_node(rng, 30), "quiet": (random_node(rng, 25)[0], []), "one": random_node(rng, 1)}
    tests = [(n, *t) for n, (own, _) in nodes.items() for t in own]
    moves = [(n, kind, seq, status, at) for n, (_, acts) in nodes.items() for kind, seq, status, at in acts]
    want = []
    for n, (own, acts) in nodes.items():
        steps = []
        for t in own:
            figures = dict(zip(FIGURES, t, strict=True))
            figures["p95_latency_ms"] = figures["p95_latency_ms"] or 0.0
            steps.append((t[1], 0, t[0], ("TEST", t[0], t[1], *first_violation(figures, 500.0, 0.05, 0.7))))
        steps += [(at, 1, seq, (status, seq, at, kind)) for kind, seq, status, at in acts]
        want += [(n, *a) for a in bottleneck_lifecycle_model([s[3] for s in sorted(steps, key=lambda s: s[:3])], needed)]
    rows = lifecycle(spark, tests, moves, chunk_rows=chunk_rows, violations_to_raise=needed)
    got = [
        (r.node_id, r.alert_type, int(r.id.split(":")[-1]), r.severity, r.status, r.triggered_us, r.acknowledged_us, r.resolved_us, r.resolved_by)
        for r in rows
    ]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 30
    assert {r.resolved_by for r in rows} >= {"RULE", "OPERATOR"}


def test_without_acts_it_is_the_rule(spark):
    rng = random.Random(2)
    tests = spark.createDataFrame([(n, *t) for n in "abc" for t in random_node(rng, 80)[0]], TESTS)
    plain = bottleneck.bottleneck_alerts(tests, Settings(chunk_rows=9))
    acted = bottleneck.bottleneck_lifecycle(tests, spark.createDataFrame([], MOVES), Settings(chunk_rows=9))
    assert sorted(map(tuple, acted.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))


def test_tests_that_end_together_raise_one_alert(spark):
    """Two tests of a node complete in the same microsecond; only the one that raised the alert names the node."""
    rows = [(*drop(i, 5), f"t{i}", 1.0, 1.0, 1.0, 0, "COMPLETED", 0) for i in range(3)]
    more = ", id STRING, duration_seconds DOUBLE, average_latency_ms DOUBLE, p99_latency_ms DOUBLE, error_count BIGINT, status STRING, started_us BIGINT"
    tests = spark.createDataFrame(rows, TESTS + more)
    stored = bottleneck.test_rows(tests, bottleneck.bottleneck_alerts(tests)).collect()
    assert {r.id: r.bottleneck_node for r in stored} == {"t0": None, "t1": "processor", "t2": None}


# --- automata and orders -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk_rows", [1, 13, 100, 1_000_000])
def test_states_match_a_walk(spark, chunk_rows):
    rng = random.Random(chunk_rows)
    states = 5
    maps = [[rng.randrange(states) for _ in range(states)] for _ in range(6)] + [list(range(states)), [1, 2, 3, 4, 0]]
    rows = [(k, i, rng.randrange(len(maps))) for k, n in (("hot", 700), (None, 40), ("b", 3), ("c", 1)) for i in rng.sample(range(3000), n)]
    want, state = {}, {}
    for k, i, m in sorted(rows, key=lambda r: r[1]):
        before = state.get(k, 0)
        state[k] = maps[m][before]
        want[(k, i)] = (before, state[k])
    df = spark.createDataFrame([(k, i, move(maps[m])) for k, i, m in rows], "k STRING, i BIGINT, m BIGINT").repartition(4)
    got = scan_states(df, ["k"], "i", "m", states, chunk_rows).collect()
    assert {(r.k, r.i): (r.state_before, r.state_after) for r in got} == want
    assert len(got) == len(rows)


def test_an_automaton_has_few_states():
    with pytest.raises(ValueError):
        move(range(16))


def test_long_keys_in_one_task_are_walked_in_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        df = spark.range(5000).select(F.lit("k").alias("k"), "id", F.lit(move([1, 2, 0])).alias("m"))
        got = scan_states(df, ["k"], "id", "m", 3, 1_000_000)
        assert got.where(F.col("state_before") != F.col("id") % 3).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_dense_order(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, 3, None])) for _ in range(500)]
    got = dense_order(spark.createDataFrame(rows, "x STRING, y INT").repartition(7), ["x", "y"], "n").collect()
    assert sorted(r.n for r in got) == list(range(500))
    assert [(r.x, r.y) for r in sorted(got, key=lambda r: r.n)] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0))
    assert dense_order(spark.createDataFrame([], "x STRING"), ["x"], "n").collect() == []


def test_log_order_runs_through_partitions(spark):
    rows = [("t", p, o) for p, low, n in ((0, 100, 4), (1, 7, 3), (2, 50, 1)) for o in range(low, low + n)] + [("a", 9, 0)]
    log = spark.createDataFrame(rows, "topic STRING, partition INT, offset BIGINT")
    places = log.join(log_order(log, ["topic", "partition"]), ["topic", "partition"]).withColumn("n", F.expr("before + offset")).collect()
    assert [(r.topic, r.partition, r.offset) for r in sorted(places, key=lambda r: r.n)] == sorted(rows)
    assert sorted(r.n for r in places) == list(range(9))
