import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from frostline.config import Settings
from frostline.operators import anomalies, windows
from frostline.schemas import WIRE
from frostline.streaming import queries as streams
from tests.test_windows import B, COLUMNS, random_events, to_frame

ONCE = {"availableNow": True}
DROPPED = ("batch_id", "aggregate_id", "created_at", "alert_id")


@pytest.fixture(scope="module")
def live(spark):
    return streams.stream_session(spark)


def write_parts(spark, events, path, first, last, size):
    """Write readings first..last as files of `size` readings each, one micro-batch per file."""
    for start in range(first, last, size):
        to_frame(spark, events[start : min(start + size, last)]).coalesce(1).write.mode("append").parquet(path)


def source(live, path):
    return live.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(path)


def rows_of(df):
    return sorted(tuple(r) for r in df.drop(*DROPPED).collect())


def start_by_state(telemetry, out, checkpoint, chunk_rows):
    return streams.start_states(streams.truck_states(telemetry), out, checkpoint, trigger=ONCE)


def start_by_sets(telemetry, out, checkpoint, chunk_rows):
    return streams.start_set_states(telemetry, out, checkpoint, Settings(chunk_rows=chunk_rows), ONCE)


@pytest.mark.parametrize(
    "start, size, chunk_rows",
    [(start_by_state, 40, 0), (start_by_state, 150, 0), (start_by_sets, 70, 10), (start_by_sets, 150, 1_000_000)],
)
def test_stream_equals_batch_and_survives_a_restart(spark, live, tmp_path, start, size, chunk_rows):
    events = random_events(11, 300, 4, 0.5)
    data, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))

    def run():
        start(source(live, data), out, checkpoint, chunk_rows).awaitTermination()

    write_parts(spark, events, data, 0, 150, size)
    run()
    write_parts(spark, events, data, 150, 300, size)
    run()

    batch = to_frame(spark, events)
    aggregates = spark.read.parquet(f"{out}/aggregates")
    columns = [c for c in aggregates.columns if c not in DROPPED]
    assert rows_of(aggregates) == rows_of(windows.running_aggregates(batch).select(columns))
    alerts = spark.read.parquet(f"{out}/alerts")
    columns = [c for c in alerts.columns if c not in DROPPED]
    assert rows_of(alerts) == rows_of(anomalies.anomaly_alerts(batch).select(columns))

    last = aggregates.groupBy("truck_id", "window_start").agg(F.max_by("sample_count", "sample_count").alias("n"))
    final = windows.window_aggregates(batch).select("truck_id", "window_start", F.col("sample_count").alias("n"))
    assert rows_of(last) == rows_of(final)

    if start is start_by_sets:
        return
    state = streams.current_state(spark, checkpoint).groupBy("truck_id").agg(F.max("window_start").alias("w"))
    assert rows_of(state) == rows_of(windows.latest_window(batch).select("truck_id", F.col("window_start").alias("w")))


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    rows = spark.createDataFrame([(1,), (2,)], "x BIGINT")
    for _ in range(2):
        streams.write_batch(rows, str(tmp_path / "t"), 7)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_seeded_truck_without_open_windows_shows_its_seed(spark, live, tmp_path):
    """A late reading of a truck that has a watermark but no open window changes nothing and does not fail."""
    seeds = live.createDataFrame(
        [("c1", "t1", (B + 100) * 1_000_000, B * 1_000_000, 1, -18_000_000, -18.0, -18.0, -18.0)],
        "customer_id STRING, truck_id STRING, max_event_us BIGINT, window_us BIGINT, sample_count BIGINT, "
        "sum_fixed BIGINT, min_raw DOUBLE, max_raw DOUBLE, target_raw DOUBLE",
    )
    row = (0, "c1", "t1", (B + 10) * 1_000_000, -16.0, -18.0, "RUNNING")
    spark.createDataFrame([row], COLUMNS).coalesce(1).write.parquet(f"{tmp_path}/in")
    states = streams.truck_states(source(live, f"{tmp_path}/in"), seeds=seeds)
    streams.start_states(states, f"{tmp_path}/out", f"{tmp_path}/cp", trigger=ONCE).awaitTermination()
    (got,) = spark.read.parquet(f"{tmp_path}/out/aggregates").collect()
    assert (got.late, got.window_start, got.sample_count, got.avg_temperature) == (True, B, 1, -18.0)
    (state,) = streams.current_state(spark, f"{tmp_path}/cp").collect()
    assert state.max_event_us == (B + 100) * 1_000_000


def test_state_forgets_windows_no_reading_can_reach(spark, live, tmp_path):
    events = [(i, "t0", (B + i * 200) * 1_000_000, -1800, -18.0) for i in range(30)]
    write_parts(spark, events, f"{tmp_path}/in", 0, 30, 30)
    states = streams.truck_states(source(live, f"{tmp_path}/in"))
    streams.start_states(states, f"{tmp_path}/out", f"{tmp_path}/cp", trigger=ONCE).awaitTermination()
    assert streams.current_state(spark, f"{tmp_path}/cp").count() <= 2


def test_sustained_alerts_as_a_stream(spark, live, tmp_path):
    events = random_events(21, 200, 3, 0.5)
    write_parts(spark, events, f"{tmp_path}/in", 0, 200, 70)
    cfg = Settings(sustained_threshold=-19.0, sustained_seconds=5)
    fired = streams.sustained_alerts(source(live, f"{tmp_path}/in"), cfg)
    streams.start_table(fired, f"{tmp_path}/out", f"{tmp_path}/cp", ONCE).awaitTermination()
    columns = ["arrival_seq", "truck_id", "started_us", "duration_seconds"]
    got = rows_of(spark.read.parquet(f"{tmp_path}/out").select(columns))
    assert got and got == rows_of(anomalies.sustained_alerts(to_frame(spark, events), cfg).select(columns))


def test_shared_watermark_counts_a_late_reading_while_its_window_is_open(spark, live, tmp_path):
    """The documented difference between the native windows and the exact ones."""
    events = [(i, "t0", int((B + s) * 1_000_000), -1800, -18.0) for i, s in enumerate([299, 320, 299.5, 100, 900])]
    data = f"{tmp_path}/in"
    write_parts(spark, events, data, 0, 5, 1)
    counted = streams.native_windows(source(live, data)).select("window_us", "sample_count")
    streams.start_table(counted, f"{tmp_path}/out", f"{tmp_path}/cp", ONCE).awaitTermination()
    native = {r.window_us: r.sample_count for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    exact = {int(r.window_start * 1e6): r.sample_count for r in windows.window_aggregates(to_frame(spark, events)).collect()}
    assert native[B * 1_000_000] == 3 and exact[B * 1_000_000] == 2


def wire_rows():
    good = lambda i, t, **more: json.dumps(
        {"customer_id": "c", "truck_id": "t", "temperature": t, "timestamp": B + i, **more}
    ).encode()
    values = [good(0, -18.0), b"not-json", good(1, -14.0), None, good(2, 0.0), good(3, "-5.0"), good(4, -18.0, door_open=1)]
    return [(b"c:t", v, 0, i, None) for i, v in enumerate(values)]


def test_messages_to_aggregates_alerts_and_dead_letters(spark, live, tmp_path):
    spark.createDataFrame(wire_rows(), WIRE).coalesce(1).write.parquet(f"{tmp_path}/in")
    checked = streams.check_wire(live.readStream.schema(WIRE).parquet(f"{tmp_path}/in"))
    streams.start_states(
        streams.truck_states(streams.readings(checked)), f"{tmp_path}/out", f"{tmp_path}/cp1", trigger=ONCE
    ).awaitTermination()
    from frostline.operators.contract import dead_letters

    streams.start_table(dead_letters(checked), f"{tmp_path}/dead", f"{tmp_path}/cp2", ONCE).awaitTermination()

    aggregates = spark.read.parquet(f"{tmp_path}/out/aggregates").orderBy("arrival_seq").collect()
    assert [(r.arrival_seq, r.sample_count, r.avg_temperature) for r in aggregates] == [
        (0, 1, -18.0),
        (2, 2, -16.0),
        (5, 3, -12.33),
        (6, 4, -13.75),
    ]
    assert len({r.aggregate_id for r in aggregates}) == 4
    alerts = spark.read.parquet(f"{tmp_path}/out/alerts").orderBy("arrival_seq").collect()
    assert [(r.arrival_seq, r.alert_type) for r in alerts] == [(2, "RAPID_THERMAL_RISE"), (5, "HIGH_TEMPERATURE")]
    dead = spark.read.parquet(f"{tmp_path}/dead").orderBy("offset").collect()
    assert [(r.offset, r.payload, r.error.split(":")[0]) for r in dead[:2]] == [
        (1, "not-json", "ValidationError"),
        (3, "null", "TypeError"),
    ]
    assert dead[2].error == "ValueError: temperature must be non-zero"


def test_gate_stops_the_stream_after_writing_dead_letters(spark, live, tmp_path):
    spark.createDataFrame(wire_rows(), WIRE).coalesce(1).write.parquet(f"{tmp_path}/in")
    checked = streams.check_wire(live.readStream.schema(WIRE).parquet(f"{tmp_path}/in"))

    def run(name, **limits):
        query = streams.start_dead_letters(checked, f"{tmp_path}/{name}", f"{tmp_path}/{name}-cp", Settings(**limits), ONCE)
        query.awaitTermination()

    run("calm", gate_min_records=50)
    with pytest.raises(StreamingQueryException, match="quality gate tripped"):
        run("strict", gate_min_records=5, gate_error_rate=0.4)
    for name in ("calm", "strict"):
        assert spark.read.parquet(f"{tmp_path}/{name}").count() == 3


def test_outgoing_messages_are_keyed_json(spark):
    rows = spark.createDataFrame([("c", "t", None, 1.5)], "customer_id STRING, truck_id STRING, note STRING, x DOUBLE")
    (m,) = streams.to_messages(rows).collect()
    assert bytes(m.key) == b"c:t" and json.loads(bytes(m.value)) == {"customer_id": "c", "truck_id": "t", "note": None, "x": 1.5}


def test_state_partitions_are_those_of_the_session(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "77")
    try:
        assert streams.stream_session(spark).conf.get("spark.sql.shuffle.partitions") == "77"
        assert streams.stream_session(spark, 5).conf.get("spark.sql.shuffle.partitions") == "5"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_output_of_another_query_is_refused(spark, tmp_path):
    spark.range(1).write.parquet(f"{tmp_path}/out/aggregates/batch_id=0")
    with pytest.raises(ValueError, match="another query"):
        streams.refuse_old_output(spark, f"{tmp_path}/out", f"{tmp_path}/new")
    (tmp_path / "old" / "offsets").mkdir(parents=True)
    streams.refuse_old_output(spark, f"{tmp_path}/out", f"{tmp_path}/old")
    streams.refuse_old_output(spark, f"{tmp_path}/empty", f"{tmp_path}/new")


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    from types import SimpleNamespace

    from frostline.streaming.workspace import new_folder

    def session(master, folder):
        conf = SimpleNamespace(get=lambda *a: folder)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        new_folder(session("spark://host:7077", None), "x")
    assert new_folder(session("spark://host:7077", "/shared/"), "x").startswith("/shared/x-")
    assert new_folder(session("local[2]", None), "x")
