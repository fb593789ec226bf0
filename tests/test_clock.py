"""Streams with a clock, trucks in several log partitions, and trucks that fill most of a micro-batch."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from frostline.config import Settings
from frostline.operators import anomalies, windows
from frostline.streaming import queries as streams
from tests.test_streaming import ONCE, rows_of, source, write_parts
from tests.test_windows import B, random_events, to_frame

CLOCKED = (
    "arrival_seq BIGINT, customer_id STRING, truck_id STRING, event_us BIGINT, temperature DOUBLE, "
    "target_temperature DOUBLE, compressor_status STRING, received TIMESTAMP"
)
LOGGED = "key BINARY, value BINARY, topic STRING, partition INT, offset BIGINT, timestamp TIMESTAMP"


@pytest.fixture(scope="module")
def live(spark):
    return streams.stream_session(spark)


def at(seconds):
    return datetime.fromtimestamp(B + seconds, UTC).replace(tzinfo=None)


def clocked(spark, path, *batches):
    """Batches of (truck, seconds, temperature), one file and so one micro-batch each, received as they happen."""
    seq = 0
    for rows in batches:
        out = []
        for truck, second, temperature in rows:
            out.append((seq, "c", truck, (B + second) * 1_000_000, temperature, -18.0, "RUNNING", at(second)))
            seq += 1
        spark.createDataFrame(out, CLOCKED).coalesce(1).write.mode("append").parquet(path)


def telemetry(live, path):
    return live.readStream.schema(CLOCKED).option("maxFilesPerTrigger", 1).parquet(path)


def test_a_silent_truck_leaves_the_state(spark, live, tmp_path):
    data, out, cp = (f"{tmp_path}/{n}" for n in ("in", "out", "cp"))
    cfg = Settings(idle_seconds=100, clock_delay_seconds=0)

    def run():
        states = streams.truck_states(telemetry(live, data), cfg, clock="received")
        streams.start_states(states, out, cp, cfg, ONCE).awaitTermination()

    clocked(spark, data, [("quiet", 0, -18.0), ("busy", 0, -18.0)], [("quiet", 50, -17.0), ("busy", 90, -18.0)])
    run()
    assert {r.truck_id for r in streams.current_state(spark, cp).collect()} == {"quiet", "busy"}
    clocked(spark, data, [("busy", 170, -18.0)])  # 150 is past now: the quiet truck was last heard of at 50
    run()
    assert {r.truck_id for r in streams.current_state(spark, cp).collect()} == {"busy"}
    clocked(spark, data, [("quiet", 180, -18.0)])  # it returns, and starts anew: no previous temperature, no alert
    run()
    assert {r.truck_id for r in streams.current_state(spark, cp).collect()} == {"quiet", "busy"}
    counts = spark.read.parquet(f"{out}/aggregates").where("truck_id = 'quiet'").orderBy("batch_id").collect()
    assert [r.sample_count for r in counts] == [1, 2, 1]


def test_all_trucks_silent_leaves_no_state(spark, live, tmp_path):
    """Once the clock is past everything, only the truck that moved the clock is left; with it gone too, none."""
    data, out, cp = (f"{tmp_path}/{n}" for n in ("in", "out", "cp"))
    cfg = Settings(idle_seconds=60, clock_delay_seconds=0, sustained_seconds=30)
    clocked(spark, data, [(f"t{i}", i, -5.0) for i in range(20)], [("last", 500, -18.0)])
    fired = streams.sustained_alerts(telemetry(live, data), cfg, "received")
    streams.start_table(fired, out, cp, ONCE).awaitTermination()
    left = spark.read.format("statestore").option("stateVarName", "run").load(cp)
    assert left.count() == 0
    assert {r.truck_id for r in spark.read.parquet(out).collect()} == {f"t{i}" for i in range(20)}


def test_a_run_fires_without_a_reading(spark, live, tmp_path):
    data, out, cp = (f"{tmp_path}/{n}" for n in ("in", "out", "cp"))
    cfg = Settings(sustained_seconds=30, clock_delay_seconds=0)
    clocked(
        spark,
        data,
        [("warm", 0, -5.0), ("warm", 10, -4.0), ("cooled", 0, -5.0), ("cooled", 5, -18.0), ("long", 0, -5.0), ("long", 30, -5.0)],
        [("clock", 31, -18.0)],
        [("clock", 40, -18.0)],  # now the clock is past 30
        [("warm", 45, -3.0), ("clock", 100, -18.0)],
        [("clock", 200, -18.0)],
    )
    fired = streams.sustained_alerts(telemetry(live, data), cfg, "received")
    streams.start_table(fired, out, cp, ONCE).awaitTermination()
    got = sorted(
        (r.truck_id, r.arrival_seq if r.arrival_seq is not None else -1, r.event_us // 1_000_000 - B, r.temperature, r.duration_seconds)
        for r in spark.read.parquet(out).collect()
    )
    # The warm truck fires at second 30 by the clock, with its latest temperature, once; then again with its next reading.
    assert got == [("long", 5, 30, -5.0, 30), ("warm", -1, 30, -4.0, 30), ("warm", 8, 45, -3.0, 45)]


def test_a_truck_that_fills_most_of_a_micro_batch(spark, live, tmp_path):
    """Four fifths of the readings are one truck's; the stream gives the rows of the batch operator."""
    events = [(seq, "t0" if i % 5 else "t1", *rest) for i, (seq, _, *rest) in enumerate(random_events(5, 1500, 3, 0.4))]
    write_parts(spark, events, f"{tmp_path}/in", 0, 1500, 500)
    streams.start_states(streams.truck_states(source(live, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/cp", trigger=ONCE).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/aggregates").drop("batch_id", "aggregate_id", "created_at")
    batch = to_frame(spark, events)
    assert rows_of(got) == rows_of(windows.running_aggregates(batch).select(got.columns))
    alerts = spark.read.parquet(f"{tmp_path}/out/alerts").drop("batch_id", "alert_id")
    assert rows_of(alerts) == rows_of(anomalies.anomaly_alerts(batch).select(alerts.columns))


def test_many_windows_in_one_micro_batch(spark, live, tmp_path):
    """Every reading in a window of its own, and all readings in one."""
    for name, step in (("wide", 400), ("narrow", 0.01)):
        events = [(i, "t0", int((B + i * step) * 1_000_000), -1800 + i % 7, -18.0) for i in range(400)]
        write_parts(spark, events, f"{tmp_path}/{name}", 0, 400, 200)
        states = streams.truck_states(source(live, f"{tmp_path}/{name}"))
        streams.start_states(states, f"{tmp_path}/{name}-out", f"{tmp_path}/{name}-cp", trigger=ONCE).awaitTermination()
        got = spark.read.parquet(f"{tmp_path}/{name}-out/aggregates").drop("batch_id", "aggregate_id", "created_at")
        assert rows_of(got) == rows_of(windows.running_aggregates(to_frame(spark, events)).select(got.columns))


def test_sliding_windows_of_a_stream_equal_the_batch(spark, live, tmp_path):
    """Five micro-batches of readings out of order, with windows far apart, and panes that leave the state."""
    events = random_events(8, 500, 3, 0.5)
    events += [(500 + i, "t0", int((B + 50_000 + 3 * i) * 1_000_000), -1800 - i, -18.0) for i in range(60)]
    write_parts(spark, events, f"{tmp_path}/in", 0, 560, 112)
    for cfg in (Settings(), Settings(window_seconds=60, slide_seconds=20)):
        name = f"{tmp_path}/{cfg.window_seconds}"
        states = streams.sliding_states(source(live, f"{tmp_path}/in"), cfg)
        streams.start_table(states, f"{name}/out", f"{name}/cp", ONCE).awaitTermination()
        got = streams.latest_windows(spark.read.parquet(f"{name}/out"), cfg)
        assert rows_of(got) == rows_of(windows.sliding_aggregates(to_frame(spark, events), cfg))
        kept = spark.read.format("statestore").option("stateVarName", "panes").load(f"{name}/cp")
        assert kept.agg(F.max(F.size("value.panes"))).first()[0] <= (3600 + cfg.window_seconds) // cfg.slide_seconds + 1


# --- one truck in two log partitions -----------------------------------------------------------------------------


def two_partitions():
    """The same offsets in both partitions, and temperatures that tell the order."""
    rows = []
    for partition in (1, 0):
        for offset in range(4):
            value = {"customer_id": "c", "truck_id": "t", "temperature": -18.0 + 4 * partition + offset, "timestamp": B + offset}
            rows.append((b"c:t", json.dumps(value).encode(), "raw", partition, offset, at(offset)))
    return rows


def test_two_partitions_in_a_batch(spark):
    checked = streams.check_wire(spark.createDataFrame(two_partitions(), LOGGED))
    readings = streams.readings(checked)
    places = {(r.partition, r.offset): r.arrival_seq for r in readings.collect()}
    assert places == {(p, o): 4 * p + o for p in (0, 1) for o in range(4)}
    states = windows.arrival_states(readings)
    rows = streams.published_aggregates(states).orderBy("arrival_seq").collect()
    assert [r.sample_count for r in rows] == list(range(1, 9)) and len({r.aggregate_id for r in rows}) == 8


@pytest.mark.parametrize("by_sets", [True, False])
def test_two_partitions_in_a_stream(spark, live, tmp_path, by_sets):
    spark.createDataFrame(two_partitions(), LOGGED).repartition(3).write.parquet(f"{tmp_path}/in")
    checked = streams.check_wire(live.readStream.schema(LOGGED).parquet(f"{tmp_path}/in"))
    readings, out, cp = streams.readings(checked), f"{tmp_path}/out", f"{tmp_path}/cp"
    if by_sets:
        streams.start_set_states(readings, out, cp, trigger=ONCE).awaitTermination()
    else:
        streams.start_states(streams.truck_states(readings), out, cp, trigger=ONCE).awaitTermination()
    rows = spark.read.parquet(f"{out}/aggregates").orderBy("sample_count").collect()
    assert [r.max_temperature for r in rows] == [-18.0 + i for i in range(8)]
    batch = streams.published_aggregates(windows.arrival_states(streams.readings(streams.check_wire(spark.read.parquet(f"{tmp_path}/in")))))
    assert {r.aggregate_id for r in rows} == {r.aggregate_id for r in batch.collect()} and len({r.aggregate_id for r in rows}) == 8
    alerts = spark.read.parquet(f"{out}/alerts").collect()
    assert len({a.alert_id for a in alerts}) == len(alerts)


def test_places_go_on_over_micro_batches(spark, live, tmp_path):
    for k in range(3):
        rows = [(*r[:4], r[4] + 4 * k, r[5]) for r in two_partitions()]
        spark.createDataFrame(rows, LOGGED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = live.readStream.schema(LOGGED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streams.start_set_states(streams.readings(streams.check_wire(stream)), f"{tmp_path}/out", f"{tmp_path}/cp", trigger=ONCE).awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out/aggregates")
    assert sorted(r.arrival_seq for r in rows.collect()) == list(range(24))
    assert rows.agg(F.count_distinct("aggregate_id")).first()[0] == 24


def test_old_dead_letters_are_refused(spark, live, tmp_path):
    spark.range(1).write.parquet(f"{tmp_path}/dead/batch_id=0")
    spark.createDataFrame(two_partitions(), LOGGED).write.parquet(f"{tmp_path}/in")
    checked = streams.check_wire(live.readStream.schema(LOGGED).parquet(f"{tmp_path}/in"))
    with pytest.raises(ValueError, match="another query"):
        streams.start_dead_letters(checked, f"{tmp_path}/dead", f"{tmp_path}/new", trigger=ONCE)


# --- progress ----------------------------------------------------------------------------------------------------


def test_progress_of_a_log_query_becomes_lag(spark):
    from types import SimpleNamespace

    from frostline.operators import lag

    source = {"latestOffset": {"raw": {"0": 50, "1": 9}}, "endOffset": json.dumps({"raw": {"0": 40}})}
    query = SimpleNamespace(name="states", id="x", lastProgress={"sources": [source]})
    committed, latest = streams.progress_offsets(spark, query, "raw")
    report = lag.lag_report(committed.select("consumer_group", "topic").distinct(), latest, committed)
    assert {(r.partition, r.current_offset, r.lag) for r in report.collect()} == {(0, 40, 10), (1, 0, 9)}
    nothing = SimpleNamespace(name=None, id="x", lastProgress=None)
    assert [d.count() for d in streams.progress_offsets(spark, nothing, "raw")] == [0, 0]


def test_changes_of_the_state_name_the_forgotten(spark, live, tmp_path):
    data, out, cp = (f"{tmp_path}/{n}" for n in ("in", "out", "cp"))
    cfg = Settings(idle_seconds=60, clock_delay_seconds=0)
    clocked(spark, data, [("quiet", 0, -18.0), ("busy", 0, -18.0)], [("busy", 100, -18.0)], [("busy", 110, -18.0)])
    states = streams.truck_states(telemetry(live, data), cfg, clock="received")
    streams.start_states(states, out, cp, cfg, ONCE).awaitTermination()
    assert {r.truck_id for r in streams.current_state(spark, cp, 0).collect()} == {"quiet", "busy"}
    changes = [(r.change_type, r.truck_id, r.max_event_us) for r in streams.state_changes(spark, cp, 1, 2).collect()]
    assert ("delete", "quiet", None) in changes and ("update", "busy", (B + 110) * 1_000_000) in changes
