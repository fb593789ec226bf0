"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.config import Settings
from frostline.functions import iso_micros, seconds_between
from frostline.operators import anomalies, bottleneck, contract, fleet, lag, metrics, performance, reconcile, routes
from frostline.operators import windows
from frostline.plans import adapters
from frostline.sources import tables, wire
from frostline.streaming import committed
from frostline.streaming import queries as streams
from frostline.streaming.workspace import new_folder

CFG = Settings()
# Limits under which the derived throughput tests both pass and fail.
TEST_CFG = replace(CFG, p95_limit_ms=165.0, failure_rate_limit=0.25)
# Chunks so small that every key is treated as a hot one.
SPLIT_CFG = replace(CFG, chunk_rows=64)
AS_OF = 1_790_000_000.0
FAILURE_DAY_US = 962_409_600_000_000  # 2000-07-01

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.table(spark, sf, "events")


def _telemetry(spark: SparkSession, sf: str) -> DataFrame:
    return windows.valid_readings(adapters.telemetry(spark, sf))


def _seconds(rows: DataFrame) -> DataFrame:
    """Event time as seconds and without helper columns."""
    return rows.withColumn("timestamp", F.col("event_us") / F.lit(1e6)).drop("event_us")


# --- windows -----------------------------------------------------------------------------------------------------


@query
def window_aggregates(spark, sf):
    return windows.window_aggregates(_telemetry(spark, sf), CFG)


@query
def window_aggregates_split(spark, sf):
    return windows.window_aggregates(_telemetry(spark, sf), SPLIT_CFG)


@query
def breached_windows(spark, sf):
    return windows.breached_windows(_telemetry(spark, sf), CFG)


@query
def latest_window(spark, sf):
    return windows.latest_window(_telemetry(spark, sf), CFG)


@query
def late_events(spark, sf):
    late = windows.late_events(_telemetry(spark, sf), CFG)
    return _seconds(late.select("arrival_seq", "customer_id", "truck_id", "event_us", "temperature"))


@query
def running_aggregates(spark, sf):
    return windows.running_aggregates(_telemetry(spark, sf), CFG)


@query
def running_aggregates_split(spark, sf):
    return windows.running_aggregates(_telemetry(spark, sf), SPLIT_CFG)


@query
def log_running_aggregates(spark, sf):
    """Running aggregates of trucks whose readings are in several partitions of a log."""
    log = streams.in_log_order(adapters.dealt_log(adapters.telemetry(spark, sf)))
    return windows.running_aggregates(windows.valid_readings(log), CFG)


@query
def sliding_aggregates(spark, sf):
    return windows.sliding_aggregates(_telemetry(spark, sf), CFG)


# --- alerts ------------------------------------------------------------------------------------------------------


@query
def anomaly_alerts(spark, sf):
    return anomalies.anomaly_alerts(_telemetry(spark, sf), CFG)


@query
def anomaly_alerts_split(spark, sf):
    return anomalies.anomaly_alerts(_telemetry(spark, sf), SPLIT_CFG)


@query
def alerts_by_type(spark, sf):
    return anomalies.alerts_by_type(anomaly_alerts(spark, sf))


def _sustained(rows: DataFrame) -> DataFrame:
    return _seconds(rows).select(
        "arrival_seq",
        "customer_id",
        "truck_id",
        "temperature",
        "timestamp",
        (F.col("started_us") / F.lit(1e6)).alias("started_at"),
        "duration_seconds",
    )


@query
def sustained_alerts(spark, sf):
    return _sustained(anomalies.sustained_alerts(_telemetry(spark, sf), CFG))


@query
def sustained_alerts_split(spark, sf):
    return _sustained(anomalies.sustained_alerts(_telemetry(spark, sf), SPLIT_CFG))


@query
def active_temperature_alerts(spark, sf):
    return anomalies.active_temperature_alerts(_telemetry(spark, sf), CFG)


# --- contract ----------------------------------------------------------------------------------------------------


def _wire(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.wire_from_telemetry(adapters.telemetry(spark, sf))


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    return contract.check_reading(contract.parse_raw(_wire(spark, sf)))


@query
def parse_raw(spark, sf):
    parsed = contract.parse_raw(_wire(spark, sf))
    return parsed.select("arrival_seq", "customer_id", "truck_id", "temperature", F.size("errors").alias("problems"))


@query
def valid_telemetry(spark, sf):
    return contract.with_partition_key(contract.valid_telemetry(_checked(spark, sf))).select(
        "arrival_seq", "partition_key", "event_id", "timestamp", "temperature"
    )


@query
def normalize(spark, sf):
    return contract.normalize(contract.valid_telemetry(_checked(spark, sf)))


@query
def wire_window_aggregates(spark, sf):
    readings = contract.to_readings(contract.normalize(contract.valid_telemetry(_checked(spark, sf))))
    return windows.window_aggregates(readings, CFG)


@query
def dead_letters(spark, sf):
    return contract.dead_letters(_checked(spark, sf), CFG).select(
        "arrival_seq", "original_key", "payload", "error", "source_topic"
    )


@query
def quality_gate(spark, sf):
    batches = _checked(spark, sf).withColumn("batch_id", F.floor(F.col("arrival_seq") / 1000))
    return contract.quality_gate(batches, ["batch_id"], replace(CFG, gate_error_rate=0.083))


@query
def wire_encode(spark, sf):
    readings = _telemetry(spark, sf)
    fields = ["arrival_seq", "customer_id", "truck_id", "compressor_status"]
    return wire.encode(readings, fields).select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")
    )


@query
def bounded_read(spark, sf):
    read = wire.bounded_read(_wire(spark, sf), 5, "arrival_seq")
    return read.select(
        "arrival_seq",
        F.try_variant_get("payload", "$.event_id", "string").alias("event_id"),
        F.try_variant_get("payload", "$.raw_message", "string").alias("raw_message"),
    )


@query
def roundtrip_reconcile(spark, sf):
    sent = adapters.telemetry(spark, sf).select(F.concat(F.lit("evt-"), F.col("arrival_seq")).alias("event_id"))
    received = contract.valid_telemetry(_checked(spark, sf)).select("event_id")
    return reconcile.roundtrip_counts(sent, received)


@query
def missing_events(spark, sf):
    sent = adapters.telemetry(spark, sf).select(F.concat(F.lit("evt-"), F.col("arrival_seq")).alias("event_id"))
    received = contract.valid_telemetry(_checked(spark, sf)).select("event_id")
    return reconcile.missing_events(sent, received)


@query
def missing_events_by_checksum(spark, sf):
    sent = adapters.telemetry(spark, sf).select(F.concat(F.lit("evt-"), F.col("arrival_seq")).alias("event_id"))
    received = contract.valid_telemetry(_checked(spark, sf)).select("event_id")
    return reconcile.missing_events_by_checksum(sent, received)


# --- metrics -----------------------------------------------------------------------------------------------------


@query
def events_by_customer(spark, sf):
    return metrics.events_by_customer(adapters.telemetry(spark, sf))


@query
def dashboard_metrics(spark, sf):
    return metrics.dashboard_metrics(_telemetry(spark, sf), CFG)


# --- lag ---------------------------------------------------------------------------------------------------------


def _lag(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf)
    committed = adapters.committed_offsets(events)
    pairs = committed.select("consumer_group", "topic").distinct()
    return lag.lag_report(pairs, adapters.latest_offsets(events), committed, CFG)


@query
def lag_report(spark, sf):
    return _lag(spark, sf)


@query
def lag_summary(spark, sf):
    return lag.lag_summary(_lag(spark, sf), CFG)


@query
def group_overview(spark, sf):
    """Groups with state, members and lag, among them one without partitions and one that nobody describes."""
    members = adapters.worker_members(_events(spark, sf))
    return lag.group_overview(adapters.described_groups(spark), members, _lag(spark, sf), CFG)


@query
def worker_lag(spark, sf):
    return lag.worker_lag(_lag(spark, sf), CFG)


@query
def group_assignments(spark, sf):
    return lag.group_assignments(adapters.group_members(adapters.table(spark, sf, "supplier")))


@query
def group_union(spark, sf):
    groups = replace(CFG, lag_groups="telemetry-worker,replay-worker")
    return lag.group_union(spark, adapters.committed_offsets(_events(spark, sf)), groups)


# --- throughput tests and bottlenecks ----------------------------------------------------------------------------


@query
def latency_percentiles(spark, sf):
    return performance.latency_percentiles(adapters.latency_samples(_events(spark, sf)), ["run_id"])


@query
def latency_percentiles_split(spark, sf):
    return performance.latency_percentiles(adapters.latency_samples(_events(spark, sf)), ["run_id"], cfg=SPLIT_CFG)


@query
def throughput_summary(spark, sf):
    return performance.throughput_summary(adapters.latency_samples(_events(spark, sf)), ["run_id"], CFG)


@query
def latency_histogram(spark, sf):
    return performance.latency_histogram(adapters.latency_samples(_events(spark, sf)))


@query
def timed_out_histogram(spark, sf):
    return performance.latency_histogram(adapters.timed_out_samples(_events(spark, sf)))


@query
def timed_out_summary(spark, sf):
    """Runs whose failures have no latency, and one without any."""
    return performance.throughput_summary(adapters.timed_out_samples(_events(spark, sf)), ["run_id"], CFG)


@query
def sketched_latencies(spark, sf):
    """Sketches of each run and day merged to the run's, and whether the ranks of what they give are near enough."""
    samples = adapters.latency_samples(_events(spark, sf))
    kept = performance.latency_sketches(samples, ["run_id", "seq"])
    found = performance.sketched_percentiles(performance.merge_sketches(kept, ["run_id"]), ["run_id"])
    checked = []
    for p in (50, 95, 99):
        below, through = F.count_if(F.col("latency_ms") < F.col(f"p{p}")), F.count_if(F.col("latency_ms") <= F.col(f"p{p}"))
        error = F.greatest(below / F.first("timed") - p / 100.0, p / 100.0 - through / F.first("timed"))
        checked.append((error <= 0.0133).alias(f"p{p}_is_near"))
    return samples.join(found, "run_id").groupBy("run_id").agg(F.count("*").alias("samples"), F.max("timed").alias("timed"), *checked)


@query
def delivery_stats(spark, sf):
    return performance.delivery_stats(adapters.delivery_reports(_events(spark, sf)), 5, CFG)


@query
def throughput_overview(spark, sf):
    return performance.throughput_overview(adapters.telemetry(spark, sf), CFG)


def _tests(spark: SparkSession, sf: str) -> DataFrame:
    samples = adapters.latency_samples(_events(spark, sf))
    return adapters.with_targets(performance.throughput_summary(samples, ["node_id", "seq"], CFG))


TEST_COLUMNS = ("id", "node_id", "seq", "actual_rate", "p95_latency_ms", "p99_latency_ms", "failure_rate", "status")


@query
def recent_tests(spark, sf):
    return performance.recent_tests(_tests(spark, sf), 20).select(*TEST_COLUMNS)


@query
def bottleneck_alerts(spark, sf):
    return bottleneck.bottleneck_alerts(_tests(spark, sf), TEST_CFG)


@query
def throughput_test_rows(spark, sf):
    tests = _tests(spark, sf)
    return bottleneck.test_rows(tests, bottleneck.bottleneck_alerts(tests, TEST_CFG))


@query
def bottleneck_lifecycle(spark, sf):
    """Alerts of the rule, acknowledged and resolved by hand, and raised again after that."""
    moves = adapters.moves_from_events(_events(spark, sf))
    return bottleneck.bottleneck_lifecycle(_tests(spark, sf), moves, TEST_CFG)


@query
def test_durations(spark, sf):
    """Seconds that tests took, from the ISO times of their stored rows."""
    started, completed = iso_micros(F.col("started_at")), iso_micros(F.col("completed_at"))
    rows = throughput_test_rows(spark, sf)
    return rows.select("id", started.alias("started_us"), seconds_between(started, completed).alias("seconds"))


@query
def bottleneck_alerts_split(spark, sf):
    return bottleneck.bottleneck_alerts(_tests(spark, sf), replace(TEST_CFG, chunk_rows=4))


def _alerts(spark: SparkSession, sf: str) -> DataFrame:
    alerts = adapters.alerts_from_orders(adapters.table(spark, sf, "orders"))
    transitions = adapters.transitions_from_lineitem(adapters.table(spark, sf, "lineitem"))
    return bottleneck.alert_state(alerts, transitions)


@query
def alert_state(spark, sf):
    return _alerts(spark, sf)


@query
def alert_history(spark, sf):
    return bottleneck.alert_history(_alerts(spark, sf))


@query
def active_alerts(spark, sf):
    return bottleneck.alert_history(_alerts(spark, sf), active_only=True)


@query
def failure_counters(spark, sf):
    return bottleneck.failure_counters(_alerts(spark, sf), FAILURE_DAY_US)


@query
def node_status(spark, sf):
    return bottleneck.node_status(_tests(spark, sf), _alerts(spark, sf))


@query
def export_alerts(spark, sf):
    alerts = _alerts(spark, sf).withColumn("triggered_at", F.col("triggered_us"))
    return tables.csv_lines(alerts, tables.ALERT_EXPORT)


@query
def export_tests(spark, sf):
    return tables.csv_lines(throughput_test_rows(spark, sf), tables.TEST_EXPORT)


# --- fleet and routes --------------------------------------------------------------------------------------------


def _fact(spark: SparkSession, sf: str) -> DataFrame:
    t = adapters.fleet_tables(spark, sf)
    return fleet.trip_fact(t["trips"], t["trucks"], t["owners"], t["drivers"])


@query
def trip_fact(spark, sf):
    return _fact(spark, sf)


@query
def plate_history(spark, sf):
    return fleet.plate_history(_fact(spark, sf), " fl-71 ")


@query
def plate_trips(spark, sf):
    t = adapters.fleet_tables(spark, sf)
    return fleet.plate_trips(t["trips"], t["trucks"], t["owners"], t["drivers"], " fl-71 ")


@query
def first_trip(spark, sf):
    return fleet.first_trip(adapters.fleet_tables(spark, sf)["trips"])


@query
def table_counts(spark, sf):
    return performance.table_counts(adapters.fleet_tables(spark, sf))


def _vehicles(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.vehicles_from_events(_events(spark, sf))


def _trips(spark: SparkSession, sf: str) -> DataFrame:
    return routes.trips(_vehicles(spark, sf), AS_OF).select(
        "trip_id",
        "vehicle_id",
        "vehicle",
        "status",
        F.size("route").cast("bigint").alias("points"),
        F.col("current_location.lat").alias("lat"),
        F.col("current_location.lng").alias("lng"),
        "speed_kmh",
        "distance_km",
        "route_name",
    )


@query
def trips(spark, sf):
    return _trips(spark, sf)


@query
def trip_detail(spark, sf):
    return routes.find_trip(_trips(spark, sf), "trip-truck-7")


@query
def first_trips(spark, sf):
    return routes.first_trips(_trips(spark, sf))


@query
def route_filter(spark, sf):
    found = routes.route_filter(_vehicles(spark, sf), None, "2024-03-05", "coastal LOOP", "CHILLED")
    return found.select("id", "telemetry_date", "route_name", "truck_type", "speed")


@query
def fleet_search(spark, sf):
    return routes.fleet_search(_vehicles(spark, sf), "  TRUCK 1", "moving").select("id", "name", "status", "speed")


@query
def route_points(spark, sf):
    return routes.route_points(_vehicles(spark, sf), AS_OF)


SUMMARY_COLUMNS = ("id", "name", "status", "speed", "completion", "thermal_variance", "eta_minutes", "alerts")


@query
def route_summary(spark, sf):
    return routes.route_summary(_vehicles(spark, sf)).select(*SUMMARY_COLUMNS)


@query
def fleet_sorted(spark, sf):
    return routes.fleet_sorted(routes.route_summary(_vehicles(spark, sf)), "name").select("id", "name", "eta_minutes")


@query
def fleet_positions(spark, sf):
    found = routes.fleet_positions(routes.route_summary(_vehicles(spark, sf)))
    return found.select("id", "name_position", "speed_position", "eta_position", "thermal_position")


@query
def fleet_kpis(spark, sf):
    return routes.fleet_kpis(routes.route_summary(_vehicles(spark, sf)))


@query
def route_distance(spark, sf):
    return routes.route_distance(adapters.points_from_events(_events(spark, sf)), CFG)


@query
def route_distance_split(spark, sf):
    return routes.route_distance(adapters.points_from_events(_events(spark, sf)), SPLIT_CFG)


# --- streams: the events table is read as a stream until it is exhausted, the result table is returned ------------


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = _events(spark, sf).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _telemetry_stream(spark: SparkSession, sf: str) -> DataFrame:
    return windows.valid_readings(adapters.telemetry_from_events(_event_stream(spark, sf)))


ALL_AT_ONCE = {"availableNow": True}
MICRO_BATCHES, FILES = 4, 2
#: Rows of a file of the log, on average: a file is the least that a task reads, so longer logs have more of them.
FILE_ROWS = 100_000


def _log_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream of several micro-batches in order of arrival, from a copy in the shared folder.

    Every micro-batch has the same number of files, which grows with the events.
    """
    events = _events(spark, sf)
    path, size = new_folder(spark, "event-log"), events.agg(F.max("event_id").alias("last"), F.count("*").alias("rows")).first()
    files = max(FILES, -(-size.rows // (MICRO_BATCHES * FILE_ROWS)))
    part = F.call_function("div", F.col("event_id") * MICRO_BATCHES, F.lit(size.last) + 1)
    for k in range(MICRO_BATCHES):
        rows = events.where(part == k)
        if size.last is not None and size.last >= 0:  # the same rows, in a form that leaves out parts of a file
            first, after = (-(-i * (size.last + 1) // MICRO_BATCHES) for i in (k, k + 1))
            rows = rows.where(F.col("event_id") < after)
            rows = rows.where(F.col("event_id") >= first) if k else rows
        rows.repartition(files).write.mode("append").parquet(path)
        if files > FILES:  # a part with few events can have left files out
            written = spark.read.schema(events.schema).parquet(path).inputFiles()
            for _ in range(files * (k + 1) - len(written)):
                events.limit(0).write.mode("append").parquet(path)
    return streams.stream_session(spark).readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path)


def _run_states(spark: SparkSession, sf: str, table: str) -> DataFrame:
    folder = new_folder(spark, table)
    states = streams.truck_states(_telemetry_stream(streams.stream_session(spark), sf), CFG)
    streams.start_states(states, folder, f"{folder}/checkpoint", CFG, ALL_AT_ONCE).awaitTermination()
    return spark.read.parquet(f"{folder}/{table}").drop("batch_id")


@query
def stream_running_aggregates(spark, sf):
    return _run_states(spark, sf, "aggregates").drop("aggregate_id", "created_at")


@query
def stream_anomaly_alerts(spark, sf):
    return _run_states(spark, sf, "alerts").drop("alert_id")


@query
def stream_set_running_aggregates(spark, sf):
    folder = new_folder(spark, "sets")
    telemetry = windows.valid_readings(adapters.telemetry_from_events(_log_stream(spark, sf)))
    streams.start_set_states(telemetry, folder, f"{folder}/checkpoint", SPLIT_CFG, ALL_AT_ONCE).awaitTermination()
    return spark.read.parquet(f"{folder}/aggregates").drop("batch_id", "aggregate_id", "created_at")


@query
def stream_fan_out(spark, sf):
    """Aggregates and dead letters of one parsed stream, from committed and compacted tables."""
    folder = new_folder(spark, "fan-out")
    log = adapters.wire_from_telemetry(adapters.telemetry_from_events(_log_stream(spark, sf)))
    checked = contract.check_reading(contract.parse_raw(log))
    streams.start_log(checked, folder, f"{folder}/checkpoint", CFG, ALL_AT_ONCE, "arrival_seq").awaitTermination()
    none = F.lit(None)
    committed.compact(spark, folder)
    committed.drop_compacted(spark, folder)
    found = committed.read_table(spark, folder, "aggregates").select(
        F.lit("aggregate").alias("kind"), "arrival_seq", "sample_count", none.cast("string").alias("error")
    )
    letters = committed.read_table(spark, folder, "dead_letters")
    return found.union(letters.select(F.lit("dead letter"), "arrival_seq", none.cast("bigint"), "error"))


def _run_table(spark: SparkSession, name: str, rows: DataFrame) -> DataFrame:
    folder = new_folder(spark, name)
    streams.start_table(rows, f"{folder}/rows", f"{folder}/checkpoint", ALL_AT_ONCE).awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


@query
def stream_sustained_alerts(spark, sf):
    telemetry = _telemetry_stream(streams.stream_session(spark), sf)
    return _sustained(_run_table(spark, "sustained", streams.sustained_alerts(telemetry, CFG)))


@query
def stream_messages(spark, sf):
    """How many messages a stream sends to each topic under each key, one per reading, alert and dead letter."""
    folder = new_folder(spark, "messages")
    log = adapters.wire_from_telemetry(adapters.telemetry_from_events(_log_stream(spark, sf)))
    checked = contract.check_reading(contract.parse_raw(log))
    send = lambda rows: rows.write.mode("append").parquet(f"{folder}/sent")
    streams.start_log(checked, folder, f"{folder}/checkpoint", CFG, ALL_AT_ONCE, "arrival_seq", send).awaitTermination()
    sent = spark.read.parquet(f"{folder}/sent")
    return sent.groupBy("topic", F.col("key").cast("string").alias("key")).agg(F.count("*").alias("messages"))


@query
def stream_progress(spark, sf):
    """Records and rejected ones of each micro-batch, counted by the stream that writes the dead letters."""
    folder = new_folder(spark, "progress")
    log = adapters.wire_from_telemetry(adapters.telemetry_from_events(_log_stream(spark, sf)))
    checked = streams.counted(contract.check_reading(contract.parse_raw(log)))
    running = streams.start_table(contract.dead_letters(checked, CFG), f"{folder}/rows", f"{folder}/checkpoint", ALL_AT_ONCE)
    running.awaitTermination()
    return streams.progress_rows(spark, running).drop("duration_ms")


def _states_run(spark: SparkSession, sf: str) -> str:
    folder = new_folder(spark, "states")
    telemetry = windows.valid_readings(adapters.telemetry_from_events(_log_stream(spark, sf)))
    states = streams.truck_states(telemetry, CFG)
    streams.start_states(states, folder, f"{folder}/checkpoint", CFG, ALL_AT_ONCE).awaitTermination()
    return f"{folder}/checkpoint"


@query
def stream_state_at(spark, sf):
    """Open windows of all trucks after the second of four micro-batches, read after the stream has ended."""
    return streams.current_state(spark, _states_run(spark, sf), batch_id=1)


@query
def stream_state_changes(spark, sf):
    """The largest event times that the last two micro-batches gave to trucks."""
    return streams.state_changes(spark, _states_run(spark, sf), 2, 3)


# A clock without delay, since arrival times never go back, and trucks that are never forgotten.
CLOCK_CFG = replace(CFG, clock_delay_seconds=0, idle_seconds=1_000_000)


@query
def stream_silent_heat(spark, sf):
    """Sustained alerts, also of trucks that have gone silent, by the clock at the end of each micro-batch."""
    log = _log_stream(spark, sf)
    telemetry = windows.valid_readings(adapters.telemetry_from_events(log, adapters.received(log)))
    return _sustained(_run_table(spark, "silent", streams.sustained_alerts(telemetry, CLOCK_CFG, "received")))


@query
def stream_native_windows(spark, sf):
    """Windows on Spark's shared watermark, those that are closed at the end of four micro-batches."""
    telemetry = windows.valid_readings(adapters.telemetry_from_events(_log_stream(spark, sf)))
    closed = streams.native_windows(telemetry, CFG).select("customer_id", "truck_id", "window_us", "sample_count", "sum_fixed")
    return _run_table(spark, "native", closed)


@query
def stream_sliding_aggregates(spark, sf):
    """Sliding windows kept as panes over four micro-batches."""
    telemetry = windows.valid_readings(adapters.telemetry_from_events(_log_stream(spark, sf)))
    return streams.latest_windows(_run_table(spark, "sliding", streams.sliding_states(telemetry, CFG)), CFG)


@query
def stream_log_aggregates(spark, sf):
    """Running aggregates of trucks whose readings are in several log partitions, in the order of each micro-batch."""
    folder = new_folder(spark, "logs")
    log = adapters.dealt_log(windows.valid_readings(adapters.telemetry_from_events(_log_stream(spark, sf))))
    telemetry = log.withColumnRenamed("offset", "arrival_seq")
    streams.start_set_states(telemetry, folder, f"{folder}/checkpoint", CFG, ALL_AT_ONCE).awaitTermination()
    return spark.read.parquet(f"{folder}/aggregates").drop("batch_id", "aggregate_id", "created_at", "arrival_seq")


@query
def stream_dead_letters(spark, sf):
    wire_stream = adapters.wire_from_telemetry(
        adapters.telemetry_from_events(_event_stream(streams.stream_session(spark), sf))
    )
    checked = contract.check_reading(contract.parse_raw(wire_stream))
    letters = _run_table(spark, "dead-letters", contract.dead_letters(checked, CFG))
    return letters.select("arrival_seq", "original_key", "payload", "error", "source_topic")
