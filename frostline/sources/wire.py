"""Message-log sources and sinks: Kafka when its connector is on the classpath, files otherwise.

All readers return `key BINARY, value BINARY, partition INT, offset BIGINT, timestamp TIMESTAMP`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.functions import partition_key
from frostline.schemas import WIRE, WIRE_COLUMNS


def read_kafka_stream(
    spark: SparkSession, servers: str, topic: str, max_offsets_per_trigger: int = 5_000_000, **options: str
) -> DataFrame:
    """Unbounded read from the earliest offset. The offset limit bounds what one micro-batch can hold."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", max_offsets_per_trigger)
        .options(**options)
        .load()
        .select(*WIRE_COLUMNS)
    )


def read_kafka(
    spark: SparkSession, servers: str, topic: str, starting: str = "earliest", ending: str = "latest"
) -> DataFrame:
    """Bounded read between two offsets."""
    return (
        spark.read.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .option("endingOffsets", ending)
        .load()
        .select(*WIRE_COLUMNS)
    )


def read_file_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1_000) -> DataFrame:
    """Parquet files in wire form as a stream, for replay of an archived topic."""
    return (
        spark.readStream.schema(WIRE).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)
    )


def encode(normalized: DataFrame, fields: list[str]) -> DataFrame:
    """Keyed messages: `customer:truck` as key, the fields as one JSON object. Nulls are written as nulls."""
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return normalized.select(partition_key().cast("binary").alias("key"), body.cast("binary").alias("value"))


def write_kafka_stream(messages: DataFrame, servers: str, topic: str, checkpoint: str):
    """Start a stream of `key, value` messages to a topic, committing once a second."""
    return (
        messages.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime="1 second")
        .start()
    )


def kafka_writer(servers: str):
    """A function that sends rows `topic, key, value` to the topics they name."""
    return lambda messages: messages.write.format("kafka").option("kafka.bootstrap.servers", servers).save()


def decode_payloads(wire: DataFrame) -> DataFrame:
    """Decode message bodies. Tombstones are skipped; text that is not JSON is kept under `raw_message`."""
    text = F.make_valid_utf8(F.col("value").cast("string"))
    kept = F.to_variant_object(F.struct(text.alias("raw_message")))
    payload = F.coalesce(F.try_parse_json(text), kept)
    return wire.where(F.col("value").isNotNull()).withColumn("payload", payload)


def bounded_read(wire: DataFrame, max_messages: int = 5, order: str = "offset") -> DataFrame:
    """The first `max_messages` decoded messages. The limit is the operation; it runs as a top-k."""
    return decode_payloads(wire.where(F.col("value").isNotNull()).orderBy(order).limit(max_messages))
