"""Telemetry contract: parse, validate, default, reject and normalize raw payloads.

Payloads stay opaque bytes until here. Each is parsed once; every field is then typed with the lax rules of the
contract: numeric text is a number, but a word is not; 1 or "true" is a boolean, but "1.0" is not; a number is never
an identifier. Times and temperatures must fit the engine's integers (microseconds and millionths of a degree); a time
must be positive and before the year 2286, a temperature within MAX_DEGREES. All problems of a record are collected in `errors`; a record is valid when there are none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.config import Settings
from frostline.functions import epoch_micros, partition_key, trim_blank


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # "number", "text", "flag", "id" or "choice"
    default: object = None
    required: bool = False
    low: float | None = None
    high: float | None = None
    above: float | None = None  # exclusive lower bound
    choices: tuple[str, ...] = ()


# Field names, defaults and ranges of the raw telemetry contract.
MAX_SECONDS = 9_999_999_999.0
MAX_DEGREES = 1_000_000.0
COMPRESSOR_STATES = ("RUNNING", "DEFROST", "OFF", "FAULT")
RAW_FIELDS = (
    Field("event_id", "text"),
    Field("timestamp", "number", above=0.0, high=MAX_SECONDS),
    Field("customer_id", "id", required=True),
    Field("truck_id", "id", required=True),
    Field("route_id", "text", default="route_default"),
    Field("temperature", "number", required=True, low=-MAX_DEGREES, high=MAX_DEGREES),
    Field("target_temp", "number", default=-18.0, low=-MAX_DEGREES, high=MAX_DEGREES),
    Field("ambient_temp", "number", default=25.0, low=-MAX_DEGREES, high=MAX_DEGREES),
    Field("compressor_status", "choice", default="RUNNING", choices=COMPRESSOR_STATES),
    Field("door_open", "flag", default=False),
    Field("battery_level", "number", default=98.5, low=0.0, high=100.0),
    Field("latitude", "number", default=37.7749, low=-90.0, high=90.0),
    Field("longitude", "number", default=-122.4194, low=-180.0, high=180.0),
    Field("speed_kmh", "number", default=65.0, low=0.0),
)
TRUE_WORDS = ("true", "1", "t", "y", "yes", "on")
FALSE_WORDS = ("false", "0", "f", "n", "no", "off")
NUMBER_TEXT = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"

RAW_COLUMNS = [f.name for f in RAW_FIELDS]
NORMALIZED_NAMES = {"target_temp": "target_temperature", "ambient_temp": "ambient_temperature"}


# Where the JSON type decides, fields are read as VARIANT; only for a choice the text alone does.
_STRICT = ("text", "id", "number", "flag")
_CORRUPT = "_corrupt"
_RECORD = ", ".join(f"{f.name} {'VARIANT' if f.kind in _STRICT else 'STRING'}" for f in RAW_FIELDS)
_JSON_OPTIONS = {"columnNameOfCorruptRecord": _CORRUPT, "allowSingleQuotes": "false"}


def _text(value: Column) -> Column:
    """Text of a VARIANT that is a JSON string, null for any other type."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _typed(field: Field, value: Column) -> Column:
    """Value under the lax typing rules, null when it does not fit."""
    if field.kind == "choice":
        return F.when(value.isin(*field.choices), value)
    text = _text(value)
    if field.kind == "text":
        return text
    if field.kind == "id":
        trimmed = trim_blank(text)
        return F.when(F.length(trimmed) > 0, trimmed)
    given = F.schema_of_variant(value)
    is_flag, is_text = given == "BOOLEAN", given == "STRING"
    word = F.trim(text)
    truth = F.when(is_flag, F.try_variant_get(value, "$", "boolean"))
    number = F.when(~is_flag & ~is_text, F.try_variant_get(value, "$", "double"))
    if field.kind == "flag":
        low = F.lower(word)
        said = F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)
        return F.when(is_flag, truth).when(is_text, said).when(number == 1, True).when(number == 0, False)
    read = F.when(is_flag, truth.cast("double")).when(is_text, F.when(word.rlike(NUMBER_TEXT), word.try_cast("double")))
    read = F.coalesce(read, number)
    return F.when(F.abs(read) < float("inf"), read)


def _problem(field: Field, value: Column, absent: Column) -> Column:
    """Message when the field breaks the contract, else null."""

    def message(text: str) -> Column:
        return F.lit(f"ValidationError: {field.name}: {text}")

    missing = message("required field is missing") if field.required else F.lit(None)
    problem = F.when(absent, missing).when(value.isNull(), message(f"not a valid {field.kind}"))
    if field.low is not None:
        problem = problem.when(value < field.low, message(f"below {field.low}"))
    if field.above is not None:
        problem = problem.when(value <= field.above, message(f"not above {field.above}"))
    if field.high is not None:
        problem = problem.when(value > field.high, message(f"above {field.high}"))
    return problem


def _sealed(value: Column) -> Column:
    """The value, marked so that its projection is computed where it stands and only once per row.

    Without the mark the optimizer copies the parse into every filter above it. The partition id is not
    deterministic, which forbids that; the lambda takes the projection out of whole-stage code, where the
    expressions of all fields would share one method too large for the JIT compiler.
    """
    mark = F.element_at(F.transform(F.array(F.spark_partition_id()), lambda p: p), 1)
    return F.when(mark >= 0, value)


def parse_raw(wire: DataFrame, record_id: Column | None = None, received_at: Column | None = None) -> DataFrame:
    """Add the raw telemetry columns and `errors ARRAY<STRING>` to wire records (`key, value`, ...).

    `record_id` fills a missing event_id and `received_at` (DOUBLE epoch seconds) a missing timestamp. Both come
    from the record, never from the clock or a random source, so that a replay gives the same rows.
    """
    text = F.col("value").cast("string")
    readable = F.is_valid_utf8(text)
    body = F.trim(F.when(readable, text))
    rec = F.from_json(body, f"{_RECORD}, {_CORRUPT} STRING", _JSON_OPTIONS)
    # Keys are listed only for a payload that could hold an explicit null: that is a wrong value, not absence.
    null_keys = F.when(body.contains("null"), F.json_object_keys(body))
    shape = (
        F.when(F.col("value").isNull(), "TypeError: payload is null")
        .when(~readable, "ValidationError: payload is not UTF-8")
        .when(~(body.startswith("{") & body.endswith("}")), "ValidationError: payload is not a JSON object")
        .when(rec.isNull() | rec[_CORRUPT].isNotNull(), "ValidationError: payload is not JSON")
    )
    typed = {f"typed_{f.name}": _typed(f, rec[f.name]) for f in RAW_FIELDS}
    absent = {f"no_{f.name}": rec[f.name].isNull() for f in RAW_FIELDS}
    kept = [c for c in wire.columns if c not in RAW_COLUMNS]
    read = wire.select(
        *kept,
        *[c.alias(n) for n, c in {**typed, **absent}.items()],
        null_keys.alias("null_keys"),
        _sealed(shape).alias("shape"),
        (record_id if record_id is not None else F.lit(None)).cast("string").alias("given_event_id"),
        (received_at if received_at is not None else F.lit(None)).cast("double").alias("given_timestamp"),
    )

    def is_absent(f: Field) -> Column:
        listed = F.col("null_keys").isNotNull() & F.array_contains("null_keys", f.name)
        return F.col(f"no_{f.name}") & ~listed

    values, problems = [], []
    for f in RAW_FIELDS:
        value = F.col(f"typed_{f.name}")
        problems.append(_problem(f, value, is_absent(f)))
        given = f.name in ("event_id", "timestamp")
        default = F.col(f"given_{f.name}") if given else F.lit(f.default)
        values.append((value if f.required else F.when(is_absent(f), default).otherwise(value)).alias(f.name))
    nothing = F.array().cast("array<string>")
    errors = (
        F.when(F.col("shape").isNotNull(), F.array("shape"))
        .when(F.coalesce(*problems).isNull(), nothing)
        .otherwise(F.array_compact(F.array(*problems)))
    )
    return read.select(*kept, *values, _sealed(errors).alias("errors"))


def check_reading(parsed: DataFrame) -> DataFrame:
    """Add the zero-reading rule: a record that parses but reads exactly zero is rejected as well."""
    zero = (F.size("errors") == 0) & (F.col("temperature") == 0)
    error = F.array(F.lit("ValueError: temperature must be non-zero"))
    return parsed.withColumn("errors", F.when(zero, error).otherwise(F.col("errors")))


def valid_telemetry(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") == 0)


def dead_letters(checked: DataFrame, cfg: Settings = Settings(), failed_at: Column | None = None) -> DataFrame:
    """Rejected records with their payload, ready for replay or inspection."""
    payload = F.make_valid_utf8(F.col("value").cast("string"))
    rejected = checked.where(F.size("errors") > 0)
    passed = [c for c in ("arrival_seq", "partition", "offset") if c in checked.columns]
    return rejected.select(
        *passed,
        F.coalesce(F.make_valid_utf8(F.col("key").cast("string")), F.lit("None")).alias("original_key"),
        F.coalesce(payload, F.lit("null")).alias("payload"),
        F.concat_ws("; ", "errors").alias("error"),
        F.lit(cfg.raw_topic).alias("source_topic"),
        (failed_at if failed_at is not None else F.unix_micros(F.current_timestamp()) / F.lit(1e6)).alias("failed_at"),
    )


def normalize(valid: DataFrame) -> DataFrame:
    """The fourteen contract fields under their normalized names; other columns pass through."""
    passed = [c for c in valid.columns if c not in RAW_COLUMNS and c not in ("errors", "key", "value")]
    return valid.select(*passed, *[F.col(c).alias(NORMALIZED_NAMES.get(c, c)) for c in RAW_COLUMNS])


def to_readings(normalized: DataFrame, arrival_seq: str = "arrival_seq") -> DataFrame:
    """Normalized telemetry to the input of the window operators."""
    return normalized.withColumns(
        {"arrival_seq": F.col(arrival_seq).cast("bigint"), "event_us": epoch_micros(F.col("timestamp"))}
    )


def with_partition_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("partition_key", partition_key())


def quality_gate(checked: DataFrame, by: list[str], cfg: Settings = Settings()) -> DataFrame:
    """Share of rejected records per group, and whether the group must be stopped.

    The gate trips when a group has at least `gate_min_records` records and at least `gate_error_rate` of them
    are rejected.
    """
    counted = checked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.size("errors") > 0).alias("rejected")
    )
    rate = F.col("rejected") / F.col("records")
    return counted.select(
        *by,
        "records",
        "rejected",
        rate.alias("error_rate"),
        ((F.col("records") >= cfg.gate_min_records) & (rate >= cfg.gate_error_rate)).alias("tripped"),
    )
