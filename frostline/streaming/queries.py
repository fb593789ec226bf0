"""Streaming queries: raw messages in; aggregates, alerts and dead letters out."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from frostline.config import Settings
from frostline.functions import fixed_point, micros_to_seconds, partition_key
from frostline.operators import anomalies, contract, windows
from frostline.operators.ordered import chunk_widths, find_hot_keys, log_order
from frostline.operators.windows import ORDER, TRUCK
from frostline.streaming import committed
from frostline.streaming.processors import (
    RUN_COLUMNS,
    SLIDING_COLUMNS,
    STATE_COLUMNS,
    SlidingPanes,
    SustainedHeat,
    TruckWindows,
)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session for stateful streams: RocksDB state that uploads changes, not whole snapshots, per micro-batch.

    The number of state partitions is fixed at the first start of a query and stays with its checkpoint. Unless given,
    it is the session's number of shuffle partitions.
    """
    session = spark.newSession()
    if state_partitions is None:
        state_partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return session


LOG = ("topic", "partition")


def _log(rows: DataFrame) -> list[str]:
    """The columns that tell log partitions apart, as far as the rows have them."""
    return [c for c in LOG if c in rows.columns]


def check_wire(wire: DataFrame) -> DataFrame:
    """Parse and check raw messages. Missing ids and times come from the record's place in the log."""
    place = F.sha2(F.concat_ws(":", *_log(wire), "offset"), 256)
    received = F.unix_micros("timestamp") / F.lit(1e6)
    stamped = wire.withColumns({"received_at": received, "record_id": place}).withColumnRenamed("timestamp", "received")
    return contract.check_reading(contract.parse_raw(stamped, F.col("record_id"), F.col("received_at")))


def readings(checked: DataFrame) -> DataFrame:
    """Valid records in the form the window operators take.

    The order of arrival is that of the log: partitions one after another by topic and number, each by its offsets. In a
    batch `arrival_seq` is a unique number in that order, dense but for gaps in the offsets. In a stream it is the offset,
    and topic and partition stay with the readings: micro-batches follow one another, and each is in the same order.
    """
    valid = contract.to_readings(contract.normalize(contract.valid_telemetry(checked)), "offset")
    return valid if checked.isStreaming else in_log_order(valid)


def in_log_order(rows: DataFrame) -> DataFrame:
    """Rows of a bounded log with `arrival_seq`, their place in it: partitions one after another, each by its offsets.

    Rows are neither sorted nor shuffled; the join is with a row for each partition.
    """
    log = _log(rows)
    if not log:
        return rows.withColumn(ORDER, F.col("offset"))
    placed = rows.join(F.broadcast(log_order(rows, log)), log)
    return placed.withColumn(ORDER, F.col("before") + F.col("offset")).drop("before", "high")


def _with_clock(telemetry: DataFrame, clock: str | None, cfg: Settings) -> DataFrame:
    if clock is None:
        return telemetry
    timed = telemetry.withWatermark(clock, f"{cfg.clock_delay_seconds} seconds")
    return timed.withColumn("received_us", F.unix_micros(clock))


def _packing(columns: str) -> str:
    """The columns of results as the processors send them: an array for each column but those of the truck."""
    named = [c.split() for c in columns.split(", ")]
    return ", ".join(f"{name} {kind if name in TRUCK else f'ARRAY<{kind}>'}" for name, kind in named)


def unpacked(packed: DataFrame, columns: str) -> DataFrame:
    """One row per result, with the given columns, from rows of arrays."""
    names = [c.split()[0] for c in columns.split(", ")]
    results = F.inline(F.arrays_zip(*[c for c in names if c not in TRUCK]))
    return packed.select(*TRUCK, results).select(*names)


def truck_states(
    telemetry: DataFrame, cfg: Settings = Settings(), seeds: DataFrame | None = None, clock: str | None = None
) -> DataFrame:
    """Streaming form of windows.arrival_states: the state each reading leaves its truck in.

    `clock` names a TIMESTAMP column with the time of arrival, such as that of the log. With it a truck leaves the state
    once it has been silent for idle_seconds of that time. Spark leaves out readings that arrive more than
    clock_delay_seconds behind the clock, so the delay must cover the lag between partitions.
    """
    columns = [*TRUCK, ORDER, "event_us", "temperature", "target_temperature", "compressor_status"]
    extra = [c for c in (*LOG, "record_id") if c in telemetry.columns]
    kept = [clock, "received_us"] if clock else []
    packed = (
        _with_clock(telemetry, clock, cfg)
        .select(*columns, *extra, *kept)
        .groupBy(*TRUCK)
        .transformWithState(
            TruckWindows(cfg, clock is not None),
            outputStructType=_packing(STATE_COLUMNS),
            outputMode="append",
            timeMode="EventTime" if clock else "None",
            initialState=seeds.groupBy(*TRUCK) if seeds is not None else None,
        )
    )
    return unpacked(packed, STATE_COLUMNS)


def sustained_alerts(telemetry: DataFrame, cfg: Settings = Settings(), clock: str | None = None) -> DataFrame:
    """Streaming form of anomalies.sustained_alerts, with the latest position when the readings have one.

    With a `clock` (see truck_states) a run that has not fired when it has lasted long enough by that time fires then,
    with a null arrival_seq: a truck that goes silent while too warm is reported.
    """
    for name in ("latitude", "longitude"):
        if name not in telemetry.columns:
            telemetry = telemetry.withColumn(name, F.lit(None).cast("double"))
    columns = [*TRUCK, ORDER, "event_us", "temperature", "latitude", "longitude", *_log(telemetry)]
    kept = [clock, "received_us"] if clock else []
    return (
        _with_clock(telemetry, clock, cfg)
        .select(*columns, *kept)
        .groupBy(*TRUCK)
        .transformWithStateInPandas(
            SustainedHeat(cfg, clock is not None),
            outputStructType=RUN_COLUMNS,
            outputMode="append",
            timeMode="EventTime" if clock else "None",
        )
    )


def sliding_states(telemetry: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Streaming form of windows.sliding_aggregates: each window that a micro-batch has changed, as it is then.

    Windows hold every reading that is at most pane_seconds_kept older than its truck's newest; older ones would open
    windows whose other readings are gone. `latest_windows` gives the last state of each window.
    """
    if cfg.window_us % cfg.slide_us:
        raise ValueError("window_seconds must be a multiple of slide_seconds")
    columns = [*TRUCK, ORDER, "event_us", "temperature", "target_temperature", *_log(telemetry)]
    packed = (
        telemetry.select(*columns)
        .groupBy(*TRUCK)
        .transformWithState(SlidingPanes(cfg), outputStructType=_packing(SLIDING_COLUMNS), outputMode="append", timeMode="None")
    )
    return unpacked(packed, SLIDING_COLUMNS)


def latest_windows(states: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Sliding aggregates from all states that a stream has written: a window only gains readings, so the state with the
    most of them is its last."""
    value = [c for c in states.columns if c not in (*TRUCK, "window_us", "batch_id")]
    last = states.groupBy(*TRUCK, "window_us").agg(F.max_by(F.struct(*value), "sample_count").alias("last"))
    return windows.finish_aggregate(last.select(*TRUCK, "window_us", "last.*"), cfg)


def _stable_id(rows: DataFrame, kind: str) -> Column:
    """Same id on every replay of the same record, and another for any other: its place in the log, or in its truck."""
    truck_place = F.concat_ws(":", *TRUCK, ORDER)
    place = F.coalesce(F.col("record_id"), truck_place) if "record_id" in rows.columns else truck_place
    return F.sha2(F.concat_ws(":", F.lit(kind), place), 256)


def _record(rows: DataFrame) -> list[str]:
    return ["record_id"] if "record_id" in rows.columns else []


def published_aggregates(states: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    rows = windows.finish_aggregate(states, cfg, ORDER, "late", *_record(states))
    created = F.unix_micros(F.current_timestamp()) / F.lit(1e6)
    return rows.withColumns({"aggregate_id": _stable_id(rows, "aggregate"), "created_at": created}).drop("record_id")


def published_alerts(states: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    rows = anomalies.alerts_from_states(states, cfg, *_record(states))
    return rows.withColumn("alert_id", _stable_id(rows, "alert")).drop("record_id")


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch to its own folder. A retry of the batch replaces it, so nothing is written twice."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def start_states(
    states: DataFrame, out: str, checkpoint: str, cfg: Settings = Settings(), trigger: dict | None = None
) -> StreamingQuery:
    """Write the aggregate after every reading to `out/aggregates` and alerts to `out/alerts`.

    Both come from one pass over the micro-batch, which is kept while it is written twice. Read them with
    committed.read_table, which shows whole micro-batches only.
    """

    def fan_out(batch: DataFrame, batch_id: int) -> None:
        if committed.is_committed(batch.sparkSession, out, batch_id):
            return
        batch.persist()
        try:
            write_batch(published_aggregates(batch, cfg), f"{out}/aggregates", batch_id)
            write_batch(published_alerts(batch, cfg), f"{out}/alerts", batch_id)
            committed.commit_batch(batch.sparkSession, out, batch_id)
        finally:
            batch.unpersist()

    refuse_old_output(states.sparkSession, out, checkpoint)
    return (
        states.writeStream.foreachBatch(fan_out)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )


def start_set_states(
    telemetry: DataFrame, out: str, checkpoint: str, cfg: Settings = Settings(), trigger: dict | None = None
) -> StreamingQuery:
    """The same results as `start_states`, computed set by set without a stateful operator.

    Each micro-batch goes through the batch operator windows.arrival_states, which splits hot trucks over many
    tasks and runs no Python, and starts from the few rows per truck that windows.carry_over kept of the batch
    before. Choose this for heavy batches and very uneven trucks, and `start_states` for short delays.

    The carried rows live next to the output in two folders that take turns: batch n reads what n - 1 wrote and
    replaces what n - 2 wrote. A repeated batch therefore starts from the same rows and gives the same result.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        if not committed.is_committed(batch.sparkSession, out, batch_id):
            _advance(batch, batch_id, out, cfg)
            committed.commit_batch(batch.sparkSession, out, batch_id)

    refuse_old_output(telemetry.sparkSession, out, checkpoint)
    return (
        telemetry.select(*_set_columns(telemetry))
        .writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "30 seconds"}))
        .start()
    )


def _set_columns(telemetry: DataFrame) -> list[str]:
    columns = [*TRUCK, ORDER, "event_us", "temperature", "target_temperature", "compressor_status"]
    return [*columns, *(c for c in (*LOG, "record_id") if c in telemetry.columns)]


def _placed(batch: DataFrame, batch_id: int, out: str) -> DataFrame:
    """A micro-batch with a unique order of arrival over all of the stream: after all earlier ones, in the order of its
    log. How many places are taken is kept like the carried rows, in two folders that take turns, and so are the places of
    the log's partitions, a row for each, so that the micro-batch is read once for both."""
    log = _log(batch)
    if not log:
        return batch
    spark, taken, turn = batch.sparkSession, f"{out}/carried_places", f"turn={batch_id % 2}"
    base = spark.read.parquet(f"{taken}/turn={(batch_id - 1) % 2}").first().places if batch_id else 0
    places = log_order(batch, log, ORDER)
    places.coalesce(1).write.mode("overwrite").parquet(f"{out}/log_places/{turn}")
    places = spark.read.schema(places.schema).parquet(f"{out}/log_places/{turn}").dropna(subset=log)
    used = F.coalesce(F.max(F.col("before") + F.col("high")) + F.lit(base) + 1, F.lit(base)).cast("bigint")
    places.agg(used.alias("places")).write.mode("overwrite").parquet(f"{taken}/{turn}")
    placed = batch.join(F.broadcast(places.drop("high")), log)
    return placed.withColumn(ORDER, F.col(ORDER) + F.col("before") + F.lit(base)).drop("before", *LOG)


def _advance(batch: DataFrame, batch_id: int, out: str, cfg: Settings) -> None:
    """Aggregates and alerts of one micro-batch, from what was carried over, and what to carry on.

    The micro-batch is kept while it is read for its order, its hot trucks and its states. Without a hot truck, the
    common case, the steps that cut hot trucks into chunks are left out of the plan.
    """
    state = f"{out}/carried"
    carried = batch.sparkSession.read.parquet(f"{state}/turn={(batch_id - 1) % 2}") if batch_id else None
    kept = [batch.persist()]
    try:
        placed = _placed(batch, batch_id, out)
        hot_keys = find_hot_keys(placed, windows.TRUCK, cfg.chunk_rows).persist()
        kept.append(hot_keys)
        any_hot = hot_keys.count() > 0
        if any_hot:
            hot_keys = chunk_widths(placed, windows.TRUCK, ORDER, cfg.chunk_rows, hot_keys).persist()
            kept.append(hot_keys)
        states = windows.arrival_states(placed, cfg, carried, hot_keys, any_hot).persist()
        kept.append(states)
        write_batch(published_aggregates(states, cfg), f"{out}/aggregates", batch_id)
        write_batch(published_alerts(states, cfg), f"{out}/alerts", batch_id)
        onward = windows.carry_over(states, cfg, carried)
        onward.write.mode("overwrite").parquet(f"{state}/turn={batch_id % 2}")
    finally:
        for rows in kept:
            rows.unpersist()


def start_log(
    checked: DataFrame,
    out: str,
    checkpoint: str,
    cfg: Settings = Settings(),
    trigger: dict | None = None,
    order: str = "offset",
    publish: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """Aggregates, alerts and dead letters of a checked log, as `start_set_states` and `start_dead_letters` write them.

    A micro-batch is parsed once and kept while all three are written. `publish` also gets the messages of each micro-batch
    (topic_messages), read back from what was written, before the commit: each is sent at least once, with the same id if
    it is sent again. `wire.kafka_writer` sends them to Kafka.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        if committed.is_committed(batch.sparkSession, out, batch_id):
            return
        batch.persist()
        try:
            write_batch(contract.dead_letters(batch, cfg), f"{out}/dead_letters", batch_id)
            valid = contract.normalize(contract.valid_telemetry(batch))
            telemetry = contract.to_readings(valid, order)
            _advance(telemetry.select(*_set_columns(telemetry)), batch_id, out, cfg)
            if publish is not None:
                read = lambda t: batch.sparkSession.read.parquet(f"{out}/{t}/batch_id={batch_id}")
                publish(topic_messages(read("aggregates"), read("alerts"), read("dead_letters"), cfg))
            committed.commit_batch(batch.sparkSession, out, batch_id)
        finally:
            batch.unpersist()

    refuse_old_output(checked.sparkSession, out, checkpoint)
    return (
        checked.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "30 seconds"}))
        .start()
    )


def refuse_old_output(spark: SparkSession, out: str, checkpoint: str) -> None:
    """A new query numbers its micro-batches from 0, so it must not write next to the output of another."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def exists(path: str) -> bool:
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(conf).exists(place)

    def holds_batches(path: str) -> bool:
        place = jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id=*")
        found = place.getFileSystem(conf).globStatus(place)
        return found is not None and len(found) > 0

    old = any(exists(f"{out}/{t}") for t in ("aggregates", "dead_letters")) or holds_batches(out)
    if not exists(f"{checkpoint}/offsets") and old:
        raise ValueError(f"{out} holds the output of another query, and checkpoint {checkpoint} is new")


def start_table(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write a stream of rows (dead letters, sustained alerts) to a Parquet table, each exactly once."""
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )


def start_dead_letters(
    checked: DataFrame, path: str, checkpoint: str, cfg: Settings = Settings(), trigger: dict | None = None
) -> StreamingQuery:
    """Write rejected records to `path` and stop the stream at a micro-batch that is mostly bad.

    The dead letters of that micro-batch are written first, so that the cause can be looked at. The stream stays at
    it until it is started again with other limits or without the gate (`start_table`).
    """

    def write_and_judge(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()  # counted while the dead letters are written, at no pass of its own
        write_batch(contract.dead_letters(counted(batch, seen), cfg), path, batch_id)
        records, rejected = seen.get["records"], seen.get["rejected"]
        if records >= cfg.gate_min_records and rejected >= records * cfg.gate_error_rate:
            raise RuntimeError(f"quality gate tripped in micro-batch {batch_id}; see the dead letters in {path}")

    refuse_old_output(checked.sparkSession, path, checkpoint)
    return (
        checked.writeStream.foreachBatch(write_and_judge)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )


def counted(checked: DataFrame, name: str | Observation = "counts") -> DataFrame:
    """Checked records that are counted, all and the rejected ones, by whatever job runs over them.

    In a stream the counts of each micro-batch are in the query's progress under `name` (see progress_rows).
    """
    rejected = F.count_if(F.size("errors") > 0)
    return checked.observe(name, F.count(F.lit(1)).alias("records"), rejected.alias("rejected"))


def progress_rows(spark: SparkSession, query: StreamingQuery, name: str = "counts") -> DataFrame:
    """One row per recent micro-batch of a query: records read, records and rejected ones counted on the way (`counted`),
    and its duration. Spark keeps the last 100 or so; micro-batches without data have none."""
    rows = []
    for p in query.recentProgress:
        if p["numInputRows"]:
            seen = (p["observedMetrics"] or {}).get(name)
            counts = (seen["records"], seen["rejected"]) if seen is not None else (None, None)
            rows.append((p["batchId"], p["numInputRows"], *counts, p["durationMs"].get("triggerExecution")))
    return spark.createDataFrame(rows, "batch_id BIGINT, input_rows BIGINT, records BIGINT, rejected BIGINT, duration_ms BIGINT")


def to_messages(rows: DataFrame, key: Column | None = None) -> DataFrame:
    """Rows as keyed JSON messages for a topic; the key is `customer:truck` unless given."""
    body = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    chosen = key if key is not None else partition_key()
    return rows.select(chosen.cast("binary").alias("key"), body.cast("binary").alias("value"))


def topic_messages(aggregates: DataFrame, alerts: DataFrame, letters: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """topic, key, value: aggregates and alerts keyed by `customer:truck`, dead letters by the key they came with."""
    parts = [
        to_messages(aggregates).withColumn("topic", F.lit(cfg.processed_topic)),
        to_messages(alerts).withColumn("topic", F.lit(cfg.alerts_topic)),
        to_messages(letters, F.col("original_key")).withColumn("topic", F.lit(cfg.dead_letter_topic)),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("topic", "key", "value")


def native_windows(telemetry: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Cheaper windows on Spark's own watermark.

    The watermark is shared by all trucks and moves once per micro-batch, and a late reading is still counted while
    its window is open, so the counts can be higher than those of `truck_states`.
    """
    return (
        telemetry.withColumn("event_time", F.timestamp_micros("event_us"))
        .withWatermark("event_time", f"{cfg.grace_seconds} seconds")
        .groupBy(*TRUCK, F.window("event_time", f"{cfg.window_seconds} seconds").alias("span"))
        .agg(
            F.count(F.lit(1)).alias("sample_count"),
            F.sum(fixed_point(F.col("temperature"))).alias("sum_fixed"),
            F.min("temperature").alias("min_raw"),
            F.max("temperature").alias("max_raw"),
            F.max_by("target_temperature", ORDER).alias("target_raw"),
        )
        .withColumn("window_us", F.unix_micros("span.start"))
    )


def state_changes(spark: SparkSession, checkpoint: str, first: int, last: int) -> DataFrame:
    """What micro-batches first to last did to the state of trucks: batch_id, change_type (update or delete), the truck
    and its largest event time, null for one that was forgotten."""
    feed = spark.read.format("statestore").option("stateVarName", "truck").option("readChangeFeed", "true")
    feed = feed.option("changeStartBatchId", first).option("changeEndBatchId", last).load(checkpoint)
    return feed.select("batch_id", "change_type", "key.*", "value.max_event_us")


def current_state(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """State of every truck as of a micro-batch, the last committed one unless given, one row per open window."""
    store = spark.read.format("statestore").option("stateVarName", "truck")
    store = (store if batch_id is None else store.option("batchId", batch_id)).load(checkpoint)
    return store.select("key.*", "value.max_event_us", F.explode_outer("value.windows").alias("w")).select(
        *TRUCK,
        "max_event_us",
        micros_to_seconds(F.col("w.window_us")).alias("window_start"),
        F.col("w.n").alias("sample_count"),
        F.col("w.last").alias("last_temperature"),
    )


def progress_offsets(spark: SparkSession, query: StreamingQuery, topic: str) -> tuple[DataFrame, DataFrame]:
    """Committed and latest offsets of a running Kafka query, in the form operators.lag takes.

    One row per partition of the topic, read from the query's own progress report.
    """
    progress = query.lastProgress
    source = progress["sources"][0] if progress else {}

    def offsets(name: str) -> dict:
        value = source.get(name) or {}
        return (json.loads(value) if isinstance(value, str) else value).get(topic, {})

    latest, done = offsets("latestOffset"), offsets("endOffset")
    committed_rows = [(query.name or str(query.id), topic, int(p), int(o)) for p, o in done.items()]
    latest_rows = [(topic, int(p), int(o), None) for p, o in latest.items()]
    return (
        spark.createDataFrame(committed_rows, "consumer_group STRING, topic STRING, partition INT, committed BIGINT"),
        spark.createDataFrame(latest_rows, "topic STRING, partition INT, latest BIGINT, replicas ARRAY<INT>"),
    )
