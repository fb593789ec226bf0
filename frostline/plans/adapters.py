"""Deterministic projections of the given tables onto the engine's inputs.

`events` becomes truck telemetry: thirty days are compressed a thousandfold so that five-minute windows fill,
every twentieth event is reported 15-120 s late, and temperatures have two decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.functions import whole

BASE_US = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z, the first day of `events`


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Its times have no zone and mean UTC, so the session is pinned to UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry_from_events(events: DataFrame, *extra: Column) -> DataFrame:
    event_id = F.col("event_id")
    ts_us = F.unix_micros(F.col("ts").cast("timestamp"))
    compressed = F.lit(BASE_US) + F.call_function("div", ts_us - F.lit(BASE_US), F.lit(1000))
    delay = F.when(event_id % 20 == 0, (F.lit(15) + (event_id * 37) % 106) * 1_000_000).otherwise(F.lit(0))
    cents = whole(F.col("value") * 100).cast("bigint") % 3001 - 3000
    return events.select(
        event_id.alias("arrival_seq"),
        F.concat(F.lit("cust_0"), (F.col("user_id") % 5 + 1).cast("string")).alias("customer_id"),
        F.concat(F.lit("trk_"), F.col("user_id").cast("string")).alias("truck_id"),
        (compressed - delay).alias("event_us"),
        (cents / F.lit(100.0)).alias("temperature"),
        (F.lit(-18.0) + (event_id % 4) * F.lit(0.5)).alias("target_temperature"),
        F.when((F.col("event_type") == "error") & (event_id % 3 == 0), "FAULT")
        .when(F.col("event_type") == "signup", "DEFROST")
        .when(F.col("event_type") == "view", "OFF")
        .otherwise("RUNNING")
        .alias("compressor_status"),
        *extra,
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_from_events(table(spark, sf_dir, "events"))


def received(events: DataFrame) -> Column:
    """When an event arrived: its time before the delay of its reading. It never goes back in order of event_id."""
    ts_us = F.unix_micros(F.col("ts").cast("timestamp"))
    return F.timestamp_micros(F.lit(BASE_US) + F.call_function("div", ts_us - F.lit(BASE_US), F.lit(1000))).alias("received")


def dealt_log(telemetry: DataFrame, partitions: int = 3) -> DataFrame:
    """Telemetry as a log whose partitions take turns, so that every truck is in all of them."""
    seq = F.col("arrival_seq")
    place = {"partition": (seq % partitions).cast("int"), "offset": F.call_function("div", seq, F.lit(partitions))}
    return telemetry.withColumns({"topic": F.lit("raw-telemetry"), **place}).drop("arrival_seq")


def wire_from_telemetry(telemetry: DataFrame) -> DataFrame:
    """Telemetry rendered as keyed JSON messages, with some records damaged in known ways."""
    seq = F.col("arrival_seq")
    kind = seq % 97
    fields = F.struct(
        F.concat(F.lit("evt-"), seq.cast("string")).alias("event_id"),
        (F.col("event_us").cast("decimal(20,0)") / 1_000_000).cast("decimal(20,6)").alias("timestamp"),
        F.when(kind == 2, "  ").otherwise(F.concat(F.lit(" "), F.col("customer_id"))).alias("customer_id"),
        F.when(kind != 1, F.col("truck_id")).alias("truck_id"),
        "temperature",
        F.col("target_temperature").alias("target_temp"),
        F.when(kind != 6, F.col("compressor_status")).alias("compressor_status"),
        F.when(kind == 3, 120.0).otherwise(F.lit(80.0)).alias("battery_level"),
    )
    body = F.to_json(fields)
    temperature = '"temperature":([-0-9.E]+)'
    quoted = F.regexp_replace(body, temperature, '"temperature":"$1"')
    micros = F.regexp_replace(body, '"timestamp":([0-9]+)[.]([0-9]+)', '"timestamp":$1$2')
    value = (
        F.when(kind == 0, "not-json")
        .when(kind == 4, quoted)
        .when(kind == 7, micros)
        .when(kind == 8, F.regexp_replace(body, temperature, '"temperature":100000000000000.0'))
        .when(kind == 9, F.regexp_replace(body, temperature, '"temperature":"true"'))
        .when(kind != 5, body)
    )
    return telemetry.select(
        "arrival_seq",
        F.concat_ws(":", "customer_id", "truck_id").cast("binary").alias("key"),
        value.cast("binary").alias("value"),
    )


def points_from_events(events: DataFrame) -> DataFrame:
    event_id = F.col("event_id")
    return events.select(
        F.col("user_id").alias("vehicle_id"),
        event_id.alias("seq"),
        (F.lit(40.70) + ((event_id * 7) % 70) / F.lit(1000.0)).alias("lat"),
        (F.lit(-74.03) + (event_id % 110) / F.lit(1000.0)).alias("lng"),
    )


def vehicles_from_events(events: DataFrame) -> DataFrame:
    """One vehicle per user with a route of three to six points."""
    user = F.col("user_id")
    point = lambda i: F.struct(
        (F.lit(40.70) + ((user + i * 7) % 70) / F.lit(1000.0)).alias("lat"),
        (F.lit(-74.03) + ((user * 3 + i * 11) % 110) / F.lit(1000.0)).alias("lng"),
    )
    rows = events.select("user_id").distinct()
    return rows.select(
        F.concat(F.lit("truck-"), user.cast("string")).alias("id"),
        F.when(user % 2 == 0, "2024-03-05").otherwise("2024-03-04").alias("telemetry_date"),
        F.when(user % 3 == 0, "Coastal Loop")
        .when(user % 3 == 1, "Ridge Shuttle")
        .otherwise("Valley Relay")
        .alias("route_name"),
        F.when(user % 3 == 0, "Chilled").when(user % 3 == 1, "Deep Frozen").otherwise("Fresh").alias("truck_type"),
        F.concat(F.lit("Truck "), user.cast("string")).alias("name"),
        (F.lit(40) + user % 30).cast("int").alias("speed"),
        F.when(user % 3 == 0, "delayed").otherwise("moving").alias("status"),
        (F.lit(40.70) + (user % 70) / F.lit(1000.0)).alias("lat"),
        (F.lit(-74.03) + (user % 110) / F.lit(1000.0)).alias("lng"),
        F.transform(F.sequence(F.lit(0), (user % 4 + 2).cast("int")), point).alias("route"),
    )


def _topic() -> Column:
    other = F.call_function("div", F.col("user_id"), F.lit(6)) % 2 == 1
    return F.when(other, "audit-telemetry").otherwise("raw-telemetry").alias("topic")


def latest_offsets(events: DataFrame) -> DataFrame:
    """Log end offsets: two topics with six partitions each, by user."""
    partition = (F.col("user_id") % 6).cast("int")
    replicas = F.when(F.col("partition") != 4, F.array(F.col("partition") % 3 + 1, (F.col("partition") + 1) % 3 + 1))
    return (
        events.groupBy(_topic(), partition.alias("partition"))
        .agg(F.count(F.lit(1)).alias("latest"))
        .withColumn("replicas", F.coalesce(replicas, F.array().cast("array<int>")))
    )


def committed_offsets(events: DataFrame) -> DataFrame:
    """Two groups that are behind; the first has never committed on partition 5."""
    partition = F.col("user_id") % 6
    worker = (F.col("event_id") % 10 < 9 - partition) & (partition < 5)
    audit = F.col("event_id") % 2 == 0
    groups = F.array_compact(F.array(F.when(worker, F.lit("telemetry-worker")), F.when(audit, F.lit("audit-reader"))))
    return (
        events.select(
            F.explode(groups).alias("consumer_group"),
            _topic(),
            partition.cast("int").alias("partition"),
        )
        .groupBy("consumer_group", "topic", "partition")
        .agg(F.count(F.lit(1)).alias("committed"))
    )


def group_members(supplier: DataFrame) -> DataFrame:
    key = F.col("s_suppkey")
    return supplier.select(
        F.concat(F.lit("group-"), (F.col("s_nationkey") % 4).cast("string")).alias("consumer_group"),
        key.alias("member_id"),
        F.when(key % 3 != 0, F.sequence(F.lit(0), (key % 5).cast("int"))).alias("assignment"),
    )


def latency_samples(events: DataFrame) -> DataFrame:
    """Latency samples of twenty runs and, per node and day, of one throughput test."""
    ts_us = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(
        (F.col("user_id") % 20).alias("run_id"),
        F.concat(F.lit("node-"), (F.col("user_id") % 8).cast("string")).alias("node_id"),
        F.call_function("div", ts_us - F.lit(BASE_US), F.lit(86_400_000_000)).alias("seq"),
        F.col("value").alias("latency_ms"),
        (F.col("event_type") == "error").alias("failed"),
        (F.lit(BASE_US) + F.call_function("div", ts_us - F.lit(BASE_US), F.lit(1000))).alias("event_us"),
    )


def timed_out_samples(events: DataFrame) -> DataFrame:
    """The samples of the twenty runs where a failure has no latency, and the last run has none at all."""
    lost = F.col("failed") | (F.col("run_id") == 19)
    return latency_samples(events).withColumn("latency_ms", F.when(~lost, F.col("latency_ms")))


def described_groups(spark: SparkSession) -> DataFrame:
    """What a cluster says of its groups: one that reads, one that is empty and reads nothing."""
    return spark.createDataFrame([("telemetry-worker", "STABLE"), ("idle-reader", "EMPTY")], "consumer_group STRING, state STRING")


def worker_members(events: DataFrame) -> DataFrame:
    """Members of the telemetry workers, a member per customer, with the partitions they hold."""
    customer = F.col("user_id") % 5
    return events.select(customer.alias("member")).distinct().select(
        F.when(F.col("member") >= 0, "telemetry-worker").alias("consumer_group"),
        F.col("member").cast("string").alias("member_id"),
        F.when(F.col("member") > 0, F.sequence(F.lit(1), F.col("member").cast("int"))).alias("assignment"),
    )


def with_targets(tests: DataFrame) -> DataFrame:
    """Give each test a target rate near what it reached, so that some fall short."""
    n = F.col("processed") + F.col("error_count")
    return tests.select(
        F.concat_ws("-", F.lit("test"), "node_id", "seq").alias("id"),
        "*",
        (n / F.lit(86.4) * (F.lit(0.9) + (F.col("seq") % 7) * F.lit(0.1))).alias("target_rate"),
    )


def alerts_from_orders(orders: DataFrame) -> DataFrame:
    """An alert per order, for the life-cycle and history reports."""
    key = F.col("o_orderkey")
    kind = (
        F.when(key % 3 == 0, "LATENCY_SPIKE").when(key % 3 == 1, "ERROR_RATE_SPIKE").otherwise("THROUGHPUT_DROP")
    )
    return orders.select(
        F.concat(F.lit("alert-"), key.cast("string")).alias("id"),
        kind.alias("alert_type"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "CRITICAL").otherwise("HIGH").alias("severity"),
        F.concat(F.lit("node-"), (F.col("o_custkey") % 10).cast("string")).alias("node_id"),
        F.lower(kind).alias("metric"),
        F.col("o_totalprice").alias("current_value"),
        F.lit(100000.0).alias("threshold"),
        (F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (key % 86400) * 1_000_000).alias("triggered_us"),
    )


def transitions_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Acknowledgements and resolutions of those alerts; the sequence number is unique per alert."""
    return lineitem.select(
        F.concat(F.lit("alert-"), F.col("l_orderkey").cast("string")).alias("id"),
        (
            F.col("l_linenumber") * F.lit(10**12) + F.col("l_partkey") * 10000 + F.col("l_suppkey")
        ).alias("seq"),
        F.when(F.col("l_returnflag") == "R", "RESOLVED").otherwise("ACKNOWLEDGED").alias("status"),
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("at_us"),
    ).where(F.col("seq") % 3 != 0)


def moves_from_events(events: DataFrame) -> DataFrame:
    """What operators did about the nodes of the throughput tests: an act for every twentieth event."""
    event_id, at_us = F.col("event_id"), F.unix_micros(F.col("ts").cast("timestamp"))
    kind = F.when(event_id % 3 == 0, "LATENCY_SPIKE").when(event_id % 3 == 1, "ERROR_RATE_SPIKE").otherwise("THROUGHPUT_DROP")
    return events.where(event_id % 20 == 7).select(
        F.concat(F.lit("node-"), (F.col("user_id") % 8).cast("string")).alias("node_id"),
        kind.alias("alert_type"),
        event_id.alias("seq"),
        F.when(event_id % 7 < 3, "RESOLVED").otherwise("ACKNOWLEDGED").alias("status"),
        (F.lit(BASE_US) + F.call_function("div", at_us - F.lit(BASE_US), F.lit(1000))).alias("at_us"),
    )


def delivery_reports(events: DataFrame) -> DataFrame:
    """One report per sent event; errors count as not delivered."""
    delivered = (F.col("event_type") != "error").alias("delivered")
    reports = telemetry_from_events(events, _topic(), delivered)
    return reports.select("topic", "arrival_seq", "event_us", "delivered")


def fleet_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Owners from nations, trucks from customers, drivers from suppliers, trips from orders."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    supplier, orders = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "orders")
    drivers_n = supplier.agg(F.count(F.lit(1))).scalar()
    owners = nation.select(
        F.col("n_nationkey").cast("bigint").alias("owner_id"), F.concat("n_name", F.lit(" Logistics")).alias("company_name")
    )
    trucks = customer.select(
        F.col("c_custkey").alias("truck_id"),
        F.col("c_nationkey").cast("bigint").alias("owner_id"),
        F.concat(F.lit("FL-"), F.col("c_custkey").cast("string")).alias("plate_number"),
        F.initcap("c_mktsegment").alias("make"),
        (F.lit(100) + F.col("c_custkey") % 9).cast("string").alias("model"),
    )
    drivers = supplier.select(
        F.col("s_suppkey").alias("driver_id"),
        F.col("s_nationkey").cast("bigint").alias("owner_id"),
        F.lit("Driver").alias("first_name"),
        F.col("s_suppkey").cast("string").alias("last_name"),
        F.when(F.col("s_suppkey") % 5 == 0, "Off duty").otherwise("On duty").alias("status"),
    )
    started = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    trips = orders.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("trip_id"),
        F.col("c_nationkey").cast("bigint").alias("owner_id"),
        F.col("o_custkey").alias("truck_id"),
        (F.col("o_orderkey") % drivers_n).alias("driver_id"),
        F.concat(F.lit("Depot "), (F.col("o_custkey") % 12).cast("string")).alias("origin"),
        F.concat(F.lit("Dock "), (F.col("o_orderkey") % 40).cast("string")).alias("destination"),
        (F.lit(20) + F.col("o_orderkey") % 600).cast("double").alias("distance_km"),
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "in_transit")
        .otherwise("scheduled")
        .alias("trip_status"),
        F.when(F.col("o_orderstatus") != "P", started).alias("actual_start_time"),
        F.col("o_totalprice").alias("revenue"),
    )
    return {"owners": owners, "trucks": trucks, "drivers": drivers, "trips": trips}
