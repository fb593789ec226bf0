"""Tables: fleet data in, observability rows appended, exports out."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.schemas import FLEET_TABLES


def load_fleet(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The four fleet tables from Parquet folders `owners, trucks, drivers, trips` under one path."""
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in FLEET_TABLES.items()}


def load_fleet_jdbc(spark: SparkSession, url: str, bounds: tuple[int, int], partitions: int = 64) -> dict[str, DataFrame]:
    """The four fleet tables from a database; trips are read in parallel ranges of their key."""
    tables = {n: spark.read.jdbc(url, n) for n in FLEET_TABLES if n != "trips"}
    tables["trips"] = spark.read.jdbc(
        url, "trips", column="trip_id", lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions
    )
    return tables


def snake_case(rows: DataFrame) -> DataFrame:
    """`p95LatencyMs` -> `p95_latency_ms` for every column."""
    names = {c: re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", c).lower() for c in rows.columns}
    return rows.withColumnsRenamed(names)


def append_rows(rows: DataFrame, path: str, *partition_by: str) -> None:
    """Append results or alerts to a Parquet table."""
    rows.write.mode("append").partitionBy(*partition_by).parquet(path)


# The fields of the exports, in order.
ALERT_EXPORT = ("id", "alert_type", "severity", "node_id", "status", "triggered_at")
TEST_EXPORT = (
    "id",
    "target_rate",
    "actual_rate",
    "p95_latency_ms",
    "p99_latency_ms",
    "failure_rate",
    "status",
    "completed_at",
)


def csv_lines(rows: DataFrame, fields: tuple[str, ...] = ALERT_EXPORT) -> DataFrame:
    """Each row as one CSV line: every value quoted, quotes doubled, null as an empty value."""

    def cell(name: str):
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))

    return rows.select(F.concat_ws(",", *[cell(f) for f in fields]).alias("line"))


def export_rows(rows: DataFrame, path: str, fields: tuple[str, ...], kind: str = "csv") -> bool:
    """Export to CSV with a header or to JSON lines, as distributed part files; whether there was anything to export.

    Without rows nothing is written, and an older export at the place stays as it is.
    """
    chosen = rows.select(*fields)
    if chosen.isEmpty():
        return False
    if kind == "json":
        chosen.write.mode("overwrite").json(path)
        return True
    options = {"header": True, "quoteAll": True, "escape": '"', "emptyValue": '""', "nullValue": ""}
    chosen.write.mode("overwrite").options(**options).csv(path)
    return True
