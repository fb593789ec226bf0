"""Bottleneck alerts over throughput tests, and the life cycle of alerts.

Tests need `node_id, seq BIGINT, completed_us, p95_latency_ms, failure_rate, actual_rate, target_rate`; `seq` is the
order of the tests of a node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.config import Settings
from frostline.functions import alert_label, iso_utc, round_half_away
from frostline.operators.automaton import move, scan_states
from frostline.operators.ordered import (
    CHUNK,
    after_chunk,
    after_here,
    before_chunk,
    dense_order,
    hot_rows,
    is_real,
    running_totals,
    split_hot_keys,
    through_chunk,
    up_to_here,
    with_carry,
)

NODE = ["node_id"]
ORDER = "seq"
KINDS = ("LATENCY_SPIKE", "ERROR_RATE_SPIKE", "THROUGHPUT_DROP")
# Fixed value: how the description of an alert ends, after the label of its type.
DESCRIPTION = " detected during throughput test."


def _violations(tests: DataFrame, cfg: Settings) -> DataFrame:
    """First violation of each test in priority order, how many there are, and the figures to report.

    A figure that is missing breaks no limit.
    """
    floor = F.col("target_rate") * F.lit(cfg.throughput_ratio_limit)
    beyond = {
        "LATENCY_SPIKE": F.col("p95_latency_ms") > cfg.p95_limit_ms,
        "ERROR_RATE_SPIKE": F.col("failure_rate") > cfg.failure_rate_limit,
        "THROUGHPUT_DROP": F.col("actual_rate") < floor,
    }
    broken = {kind: F.coalesce(flag, F.lit(False)) for kind, flag in beyond.items()}
    figure = {
        "LATENCY_SPIKE": (F.col("p95_latency_ms"), F.lit(cfg.p95_limit_ms)),
        "ERROR_RATE_SPIKE": (F.col("failure_rate"), F.lit(cfg.failure_rate_limit)),
        "THROUGHPUT_DROP": (F.col("actual_rate"), floor),
    }

    def first(pick) -> Column:
        chosen = F.when(broken[KINDS[0]], pick(KINDS[0]))
        for kind in KINDS[1:]:
            chosen = chosen.when(broken[kind], pick(kind))
        return chosen

    judged = tests.select(
        *NODE,
        ORDER,
        "completed_us",
        first(F.lit).alias("alert_type"),
        sum((broken[k].cast("int") for k in KINDS), F.lit(0)).alias("violations"),
        first(lambda k: figure[k][0]).alias("current_value"),
        first(lambda k: figure[k][1]).alias("threshold"),
    )
    clean = F.col("alert_type").isNull()
    return judged.withColumns(
        {
            "clean": clean,
            "clean_us": F.when(clean, F.col("completed_us")),
            **{f"is_{k}": F.when(F.col("alert_type") == k, F.lit(1).cast("bigint")) for k in KINDS},
        }
    )


def _counts(rows: DataFrame) -> DataFrame:
    """Clean tests so far, and per kind the violations since the last clean test."""
    rows = rows.withColumn("epoch", F.count_if("clean").over(up_to_here(NODE, ORDER)))
    here = up_to_here([*NODE, "epoch"], ORDER)
    return rows.withColumns({f"n_{k}": F.coalesce(F.sum(f"is_{k}").over(here), F.lit(0)) for k in KINDS})


def bottleneck_alerts(tests: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Alerts raised by an ordered series of tests.

    Only the first violation of a test counts. The alert of a kind is raised at the n-th such test since the last
    clean one and not again until a clean test has resolved it.
    """
    split = split_hot_keys(_violations(tests, cfg), NODE, ORDER, cfg.chunk_rows)

    # What a chunk hands on: violations per kind since its last clean test, added up back to the latest chunk
    # that had a clean test. Looking back from the end, the first clean test of the chunks that follow.
    summary = (
        _counts(with_carry(hot_rows(split)))
        .groupBy(*NODE, CHUNK)
        .agg(
            F.max("epoch").alias("cleans"),
            F.min_by("clean_us", F.when(F.col("clean"), F.col(ORDER))).alias("first_clean_us"),
            *[F.max_by(f"n_{k}", ORDER).alias(f"n_{k}") for k in KINDS],
        )
        .withColumn("span", F.count_if(F.col("cleans") > 0).over(through_chunk(NODE)))
        .withColumns({f"n_{k}": F.sum(f"n_{k}").over(through_chunk([*NODE, "span"])) for k in KINDS})
    )
    ahead = summary.select(
        *NODE,
        CHUNK,
        F.lit(False).alias("clean"),
        *[F.last(f"n_{k}").over(before_chunk(NODE).rowsBetween(-1, -1)).alias(f"is_{k}") for k in KINDS],
        F.last("first_clean_us", ignorenulls=True).over(after_chunk(NODE)).alias("clean_us"),
    )
    # The same carry row serves both directions: a null order sorts first going up and first going down.
    counted = _counts(with_carry(split, ahead)).withColumn(
        "resolved_us", F.last("clean_us", ignorenulls=True).over(after_here(NODE, ORDER))
    )
    limit = F.lit(cfg.violations_to_raise)
    reached = F.lit(False)
    for k in KINDS:
        reached = reached | ((F.col("alert_type") == k) & (F.col(f"n_{k}") == limit))
    raised = counted.where(is_real() & reached)
    status = F.when(F.col("resolved_us").isNull(), "TRIGGERED").otherwise("RESOLVED")
    return raised.select(*_alert_columns(status), F.col("completed_us").alias("triggered_us"), "resolved_us")


def _alert_columns(status: Column) -> list[Column]:
    """The columns of an alert, from the row of the test that raised it."""
    return [
        F.concat_ws(":", "node_id", "alert_type", ORDER).alias("id"),
        F.col("alert_type"),
        F.when(F.col("violations") > 1, "CRITICAL").otherwise("HIGH").alias("severity"),
        F.col("node_id"),
        F.lower("alert_type").alias("metric"),
        round_half_away(F.col("current_value"), 4).alias("current_value"),
        round_half_away(F.col("threshold"), 4).alias("threshold"),
        status.alias("status"),
        F.concat(alert_label(F.col("alert_type")), F.lit(DESCRIPTION)).alias("description"),
    ]


KIND = [*NODE, "alert_type"]


def bottleneck_lifecycle(tests: DataFrame, moves: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Alerts of the rule and what operators did with them, with each acting on the other.

    `moves(node_id, alert_type, seq, status, at_us)` acknowledge or resolve the alert that is open for their node and type
    at their time; without one they do nothing. The rule is armed again once its alert is resolved, by a clean test or by
    hand: the count of violations starts anew, and the next alert is a new one. Acknowledging again moves the time.

    Every (node, type) is an automaton of violations_to_raise + 1 states: so many violations, or an open alert. Tests
    and moves are merged by time, tests first, then by seq; tests of a node complete in the order of seq. Other statuses
    and null nodes or types of moves do nothing.
    """
    armed = cfg.violations_to_raise
    states = range(armed + 1)
    violated, clean, kept = move([min(i + 1, armed) for i in states]), move([0 for _ in states]), move(list(states))
    resolved = move([i % armed for i in states])
    judged = _violations(tests, cfg)
    kinds = F.when(F.col("clean"), F.array(*[F.lit(k) for k in KINDS])).otherwise(F.array("alert_type"))
    by_rule = judged.select(
        *NODE,
        F.explode(kinds).alias("alert_type"),
        F.col("completed_us").alias("at_us"),
        F.lit(0).alias("by_hand"),
        F.col(ORDER).cast("bigint").alias(ORDER),
        F.when(F.col("clean"), "CLEAN").otherwise("VIOLATION").alias("step"),
        "violations",
        "current_value",
        "threshold",
    )
    by_hand = moves.where(F.col("status").isin("ACKNOWLEDGED", "RESOLVED")).select(
        *KIND, "at_us", F.lit(1).alias("by_hand"), F.col(ORDER).cast("bigint").alias(ORDER), F.col("status").alias("step")
    )
    steps = dense_order(
        by_rule.unionByName(by_hand, allowMissingColumns=True), ["at_us", "by_hand", ORDER, *KIND, "step"], "place"
    )
    step = F.col("step")
    code = F.when(step == "VIOLATION", violated).when(step == "CLEAN", clean).when(step == "RESOLVED", resolved).otherwise(kept)
    stated = scan_states(steps.withColumn("moved", code.cast("bigint")), KIND, "place", "moved", len(states), cfg.chunk_rows)

    was_open, is_open = F.col("state_before") == armed, F.col("state_after") == armed
    raises, closes = is_open & ~was_open, was_open & ~is_open
    acts = stated.withColumns({"raises": raises.cast("bigint"), "closes": closes}).where(
        raises | closes | (was_open & (step == "ACKNOWLEDGED"))
    )
    # Alerts of a (node, type) follow one another, so the number of alerts so far tells which one a row belongs to.
    numbered = running_totals(acts, KIND, "place", {"raises": "alert_no"}, cfg.chunk_rows)
    raised = F.col("raises") == 1
    alerts = numbered.groupBy(*KIND, "alert_no").agg(
        *[F.max(F.when(raised, F.col(c))).alias(c) for c in (ORDER, "violations", "current_value", "threshold")],
        F.max(F.when(raised, F.col("at_us"))).alias("triggered_us"),
        F.max_by("at_us", F.when(step == "ACKNOWLEDGED", F.col("place"))).alias("acknowledged_us"),
        F.max(F.when(F.col("closes"), F.col("at_us"))).alias("resolved_us"),
        F.max(F.when(F.col("closes"), F.when(step == "CLEAN", "RULE").otherwise("OPERATOR"))).alias("resolved_by"),
    )
    status = (
        F.when(F.col("resolved_by").isNotNull(), "RESOLVED")
        .when(F.col("acknowledged_us").isNotNull(), "ACKNOWLEDGED")
        .otherwise("TRIGGERED")
    )
    return alerts.select(*_alert_columns(status), "triggered_us", "acknowledged_us", "resolved_us", "resolved_by")


def test_rows(tests: DataFrame, alerts: DataFrame) -> DataFrame:
    """The stored row of every throughput test: its figures, ISO times, and the node whose alert it raised, if any.

    A test runs at one rate throughout, so its peak rate is its actual rate.
    """
    seq = F.element_at(F.split("id", ":"), -1).cast("bigint")
    raised = alerts.select(*NODE, seq.alias(ORDER), F.lit(True).alias("raised")).distinct()
    iso = lambda c: iso_utc(F.timestamp_micros(c))
    return tests.join(raised, [*NODE, ORDER], "left").select(
        "id",
        "target_rate",
        "duration_seconds",
        "actual_rate",
        F.col("actual_rate").alias("peak_rate"),
        "average_latency_ms",
        "p95_latency_ms",
        "p99_latency_ms",
        "error_count",
        "failure_rate",
        iso("started_us").alias("started_at"),
        iso("completed_us").alias("completed_at"),
        "status",
        F.when(F.col("raised"), F.col("node_id")).alias("bottleneck_node"),
    )


def alert_state(alerts: DataFrame, transitions: DataFrame) -> DataFrame:
    """Alerts with the transitions applied: `transitions(id, seq, status, at_us)` in `seq` order per alert.

    RESOLVED is final, so only transitions up to the first one count. A repeated acknowledgement moves its time. Alerts
    of `bottleneck_alerts` may come resolved by a clean test: the earlier of both resolutions holds, and an
    acknowledgement counts only before it.
    """
    by_rule = F.col("by_rule_us") if "resolved_us" in alerts.columns else F.lit(None).cast("bigint")
    alerts = alerts.withColumnRenamed("resolved_us", "by_rule_us").drop("status", "acknowledged_us")
    resolved = transitions.groupBy("id").agg(
        F.min(F.when(F.col("status") == "RESOLVED", F.col("seq"))).alias("resolved_seq"),
        F.min_by("at_us", F.when(F.col("status") == "RESOLVED", F.col("seq"))).alias("resolved_us"),
    )
    acknowledged = (
        transitions.where(F.col("status") == "ACKNOWLEDGED")
        .join(resolved.select("id", "resolved_seq"), "id")
        .where(F.col("resolved_seq").isNull() | (F.col("seq") < F.col("resolved_seq")))
        .groupBy("id")
        .agg(F.max_by("at_us", "seq").alias("acknowledged_us"))
    )
    return (
        alerts.join(acknowledged, "id", "left")
        .join(resolved.select("id", "resolved_us"), "id", "left")
        .withColumn("resolved_us", F.least("resolved_us", by_rule))
        .withColumn(
            "acknowledged_us",
            F.when(by_rule.isNull() | (F.col("acknowledged_us") < by_rule), F.col("acknowledged_us")),
        )
        .drop("by_rule_us")
        .withColumn(
            "status",
            F.when(F.col("resolved_us").isNotNull(), "RESOLVED")
            .when(F.col("acknowledged_us").isNotNull(), "ACKNOWLEDGED")
            .otherwise("TRIGGERED"),
        )
    )


def is_active() -> Column:
    return F.col("status").isin("TRIGGERED", "ACKNOWLEDGED")


def alert_history(alerts: DataFrame, active_only: bool = False, limit: int = 50) -> DataFrame:
    """Newest alerts first. Runs as a top-k, no global sort."""
    chosen = alerts.where(is_active()) if active_only else alerts
    return chosen.orderBy(F.col("triggered_us").desc(), F.col("id")).limit(limit)


def node_status(tests: DataFrame, alerts: DataFrame) -> DataFrame:
    """Latest test of every node and whether an alert is open on it."""
    figures = ["actual_rate", "average_latency_ms", "p95_latency_ms", "failure_rate", "completed_us"]
    latest = tests.groupBy(*NODE).agg(F.max_by(F.struct(*figures), ORDER).alias("test"))
    open_alert = (
        alerts.where(is_active())
        .groupBy(*NODE)
        .agg(F.max_by("severity", F.struct("triggered_us", "id")).alias("open_severity"))
    )
    return latest.join(open_alert, NODE, "left").select(
        *NODE,
        F.when(F.col("open_severity").isNull(), "HEALTHY").otherwise("BOTTLENECK").alias("status"),
        F.coalesce("open_severity", F.lit("INFO")).alias("severity"),
        F.col("test.actual_rate").alias("throughput"),
        F.col("test.average_latency_ms").alias("latency"),
        F.col("test.p95_latency_ms").alias("p95_latency"),
        F.col("test.failure_rate").alias("error_rate"),
        F.col("test.completed_us").alias("measured_us"),
    )


def failure_counters(alerts: DataFrame, as_of_us: int) -> DataFrame:
    """Open alerts, those triggered and resolved on the day of `as_of_us`, and open critical ones."""
    day = 86_400_000_000
    start = as_of_us - as_of_us % day

    def today(column: str) -> Column:
        return (F.col(column) >= start) & (F.col(column) < start + day)

    return alerts.agg(
        F.count_if(is_active()).alias("active"),
        F.count_if(today("triggered_us")).alias("today"),
        F.count_if(today("resolved_us")).alias("resolved_today"),
        F.count_if(is_active() & (F.col("severity") == "CRITICAL")).alias("critical"),
    )
