"""Micro-batches of set-by-set streams: read once, no more shuffles than needed, few rows carried on."""

import dataclasses

from pyspark.sql import functions as F

from frostline.config import MICROS, Settings
from frostline.functions import whole
from frostline.operators import ordered, windows
from frostline.streaming import queries as streams

START = 1_704_067_200_000_000
SCHEMA = (
    "customer_id STRING, truck_id STRING, arrival_seq BIGINT, event_us BIGINT, temperature DOUBLE, target_temperature DOUBLE, "
    "compressor_status STRING"
)
STATE = ("late", "window_us", "sample_count", "sum_fixed", "min_raw", "max_raw", "target_raw", "previous_temperature", "head_temperature")


def reading(n, seconds, truck="t"):
    return ("c", truck, n, START + seconds * MICROS, -15.0 - n % 7, -18.0, "OFF")


def readings(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_a_micro_batch_is_read_once(spark, tmp_path):
    rows = [(*reading(n, 40 * n, f"t{n % 2}"), "raw", n % 3) for n in range(30)]
    schema = f"{SCHEMA}, topic STRING, partition INT"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    read = spark.sparkContext.accumulator(0)

    def count(value):
        read.add(1)
        return value

    seen = F.udf(count, "double").asNondeterministic()
    telemetry = streams.stream_session(spark).readStream.schema(schema).parquet(f"{tmp_path}/in")
    telemetry = telemetry.withColumn("temperature", seen("temperature"))
    streams.start_set_states(telemetry, f"{tmp_path}/out", f"{tmp_path}/cp", trigger={"availableNow": True}).awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out/aggregates").orderBy("arrival_seq").collect()
    # partitions 0, 1 and 2 one after another, each of offsets n = 0 to 29 in steps of 3
    assert [r.truck_id for r in found] == [f"t{n % 2}" for p in range(3) for n in range(p, 30, 3)]
    assert read.value == 30


def test_order_goes_on_over_micro_batches(spark, tmp_path):
    schema = f"{SCHEMA}, topic STRING, partition INT"
    parts = [[(*reading(n, n), "raw", n % 2) for n in r] for r in (range(4), range(4, 8))]
    parts[0].append((*reading(99, 1), None, 0))  # no place in the log
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    log = streams.stream_session(spark).readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streams.start_set_states(log, f"{tmp_path}/out", f"{tmp_path}/cp", trigger={"availableNow": True}).awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out/aggregates").orderBy("arrival_seq").collect()
    assert [r.sample_count for r in found] == list(range(1, 9))
    assert len({r.arrival_seq for r in found}) == 8


def test_without_hot_trucks_states_need_one_shuffle(spark):
    rows = readings(spark, [reading(n, 40 * n, f"t{n % 3}") for n in range(40)])
    carried = windows.carry_over(windows.arrival_states(rows.where("arrival_seq < 20")))
    later = rows.where("arrival_seq >= 20")
    plain = windows.arrival_states(later, Settings(), carried, any_hot=False)
    columns = ("truck_id", "arrival_seq", *STATE)
    whole_run = windows.arrival_states(rows).where("arrival_seq >= 20")
    assert sorted(map(str, plain.select(*columns).collect())) == sorted(map(str, whole_run.select(*columns).collect()))
    alone = windows.arrival_states(readings(spark, [reading(0, 0)]), any_hot=False)
    assert alone._jdf.queryExecution().sparkPlan().toString().count("Join") == 0


def test_hot_trucks_go_on_from_what_was_carried(spark):
    """Chunks of two readings, late ones among them, over three micro-batches."""
    cfg = dataclasses.replace(Settings(), chunk_rows=2)
    seconds = [0, 100, 290, 310, 20, 305, 299, 650, 610, 320, 700, 950, 640, 960, 955, 1300]
    rows = readings(spark, [reading(n, s, t) for n, s in enumerate(seconds) for t in ("t1", "t2")] + [reading(5, 7, "cold")])
    carried, found = None, []
    for first, after in ((0, 5), (5, 9), (9, 16)):
        batch = rows.where(F.col("arrival_seq").between(first, after - 1))
        states = windows.arrival_states(batch, cfg, carried).localCheckpoint()
        carried = windows.carry_over(states, cfg, carried).localCheckpoint()
        found += states.select("truck_id", "arrival_seq", *STATE).collect()
    expected = windows.arrival_states(rows).select("truck_id", "arrival_seq", *STATE).collect()
    assert sorted(map(str, found)) == sorted(map(str, expected))


def test_a_truck_carries_one_row_for_each_open_window(spark):
    states = windows.arrival_states(readings(spark, [reading(n, 40 * n, f"t{n % 2}") for n in range(4)]))
    rows = windows.carry_over(states).orderBy("truck_id").collect()
    assert [(r.truck_id, (r.event_us - START) // MICROS, r.carry.n, r.carry.head) for r in rows] == [
        ("t0", 80, 2, -17.0),
        ("t1", 120, 2, -18.0),
    ]


def test_nearest_whole_is_that_of_round(spark):
    values = [0.5, -0.5, 1.5, -2.5, 0.49999999999999994, -0.49999999999999994, 2**52 + 0.5, 2.0**53 + 2, 1e300, 0.1, -7.3, 0.0, None]
    values += [x / 8 for x in range(-40, 40)] + [float("inf"), float("-inf"), float("nan")]
    rows = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    assert rows.where(~whole(F.col("v")).eqNullSafe(F.round("v"))).count() == 0


def test_chunks_of_far_apart_rows_are_wide_and_never_too_full(spark):
    """Of three trucks with 12 readings one has them far apart, one side by side, one most of them at one end."""
    far = [(1000 * n, "far") for n in range(12)]
    near = [(n, "near") for n in range(12)]
    lopsided = [(n, "lopsided") for n in (*range(11), 100_000)]
    rows = readings(spark, [reading(n, n, t) for n, t in (*far, *near, *lopsided, (7, "cold"))])
    hot = ordered.find_hot_keys(rows, windows.TRUCK, 4)
    wide = ordered.chunk_widths(rows, windows.TRUCK, "arrival_seq", 4, hot)
    chunks = ordered.split_hot_keys(rows, windows.TRUCK, "arrival_seq", 4, wide).groupBy("truck_id", "chunk").count().collect()
    held = {t: sorted(r["count"] for r in chunks if r.truck_id == t) for t in ("far", "near", "lopsided", "cold")}
    assert max(max(v) for v in held.values()) <= 4
    assert (len(held["far"]), held["near"], held["lopsided"], held["cold"]) == (7, [4, 4, 4], [1, 3, 4, 4], [1])
    columns = ("truck_id", "arrival_seq", *STATE)
    cfg = dataclasses.replace(Settings(), chunk_rows=4)
    found = windows.arrival_states(rows, cfg, hot_keys=wide).select(*columns).collect()
    assert sorted(map(str, found)) == sorted(map(str, windows.arrival_states(rows).select(*columns).collect()))
