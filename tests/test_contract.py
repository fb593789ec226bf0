import json

import pytest
from pyspark.sql import functions as F

from frostline.config import Settings
from frostline.operators import contract, reconcile
from frostline.sources import wire

GOOD = {"customer_id": "cust_01", "truck_id": "truck_01", "temperature": 2.5}
COLUMNS = "arrival_seq BIGINT, key BINARY, value BINARY"


def body(**changes):
    record = {**GOOD, **changes}
    return json.dumps({k: v for k, v in record.items() if v is not ...}).encode()


# payload -> (valid, part of the error)
VECTORS = {
    "good": (body(), None),
    "negative": (body(temperature=-5.0), None),
    "integer": (body(temperature=-18), None),
    "zero": (body(temperature=0.0), "ValueError: temperature must be non-zero"),
    "text": (b"not-json", "ValidationError"),
    "null payload": (None, "TypeError"),
    "json null": (b"null", "ValidationError"),
    "scalar": (b"12345", "ValidationError"),
    "array": (b"[" + body() + b"]", "ValidationError"),
    "broken": (b"{truck: 7", "ValidationError"),
    "cut off": (body()[:-1], "ValidationError"),
    "trailing": (body() + b" x", "ValidationError"),
    "single quotes": (b"{'customer_id':'c','truck_id':'t','temperature':1}", "ValidationError"),
    "missing fields": (b'{"speed_kmh":3}', "temperature: required field is missing"),
    "empty id": (body(customer_id=""), "customer_id"),
    "blank id": (body(truck_id=" \t"), "truck_id"),
    "numeric id": (body(customer_id=5), "customer_id"),
    "number as text": (body(temperature="2.5"), None),
    "suffix": (body(temperature="2.5d"), "temperature"),
    "nan text": (body(temperature="NaN"), "temperature"),
    "nan": (b'{"customer_id":"c","truck_id":"t","temperature":NaN}', "temperature"),
    "infinite": (body(temperature=1e999), "temperature"),
    "true as number": (body(temperature=True), None),
    "object": (body(temperature={"a": 1}), "temperature"),
    "word as number": (body(temperature="true"), "temperature"),
    "hexadecimal text": (body(temperature="0x1p3"), "temperature"),
    "exponent text": (body(temperature=" -1.5e1 "), None),
    "huge temperature": (body(temperature=1e14), "temperature: above"),
    "time in microseconds": (body(timestamp=1.7e15), "timestamp: above"),
    "time zero": (body(timestamp=0), "timestamp: not above 0.0"),
    "door text number": (body(door_open="1.0"), "door_open"),
    "door number": (body(door_open=0.0), None),
    "text timestamp": (body(timestamp="2026-09-01T00:00:00Z"), "timestamp"),
    "door text": (body(door_open="true"), None),
    "door one": (body(door_open=1), None),
    "door two": (body(door_open=2), "door_open"),
    "battery": (body(battery_level=120), "battery_level: above 100.0"),
    "battery edge": (body(battery_level=100), None),
    "latitude": (body(latitude=-90.5), "latitude: below -90.0"),
    "speed": (body(speed_kmh=-0.1), "speed_kmh"),
    "status": (body(compressor_status="BROKEN"), "compressor_status"),
    "status case": (body(compressor_status="running"), "compressor_status"),
    "explicit null": (body(route_id=None), "route_id"),
    "null word in text": (body(route_id="null island"), None),
    "extra": (body(extra=[1, 2]), None),
    "bad utf8": (b'{"customer_id":"\xff","truck_id":"t","temperature":1}', "UTF-8"),
}


@pytest.fixture(scope="module")
def checked(spark):
    rows = [(i, b"k", v) for i, (v, _) in enumerate(VECTORS.values())]
    df = spark.createDataFrame(rows, COLUMNS)
    parsed = contract.parse_raw(df, F.concat(F.lit("id-"), "arrival_seq"), F.lit(7.0))
    return contract.check_reading(parsed).cache()


def test_every_payload_is_judged_as_the_contract_says(checked):
    found = {r.arrival_seq: r.errors for r in checked.select("arrival_seq", "errors").collect()}
    for i, (name, (_, expected)) in enumerate(VECTORS.items()):
        if expected is None:
            assert found[i] == [], name
        else:
            assert expected in "; ".join(found[i]), name


def test_valid_records_are_those_without_errors(checked):
    expected = [i for i, (_, e) in enumerate(VECTORS.values()) if e is None]
    assert sorted(r.arrival_seq for r in contract.valid_telemetry(checked).collect()) == expected


def test_absent_fields_get_defaults_and_ids_from_the_record(checked):
    row = contract.normalize(contract.valid_telemetry(checked)).where("arrival_seq = 0").collect()[0].asDict()
    assert row == {
        "arrival_seq": 0,
        "event_id": "id-0",
        "timestamp": 7.0,
        "customer_id": "cust_01",
        "truck_id": "truck_01",
        "route_id": "route_default",
        "temperature": 2.5,
        "target_temperature": -18.0,
        "ambient_temperature": 25.0,
        "compressor_status": "RUNNING",
        "door_open": False,
        "battery_level": 98.5,
        "latitude": 37.7749,
        "longitude": -122.4194,
        "speed_kmh": 65.0,
    }


def test_values_are_converted(spark):
    rows = [
        (0, b"k", body(temperature="2.5", door_open="YES", customer_id="  cust_01 \n")),
        (1, b"k", body(temperature=True, door_open=0, target_temp="-1e1")),
    ]
    got = contract.parse_raw(spark.createDataFrame(rows, COLUMNS)).orderBy("arrival_seq").collect()
    assert (got[0].temperature, got[0].door_open, got[0].customer_id) == (2.5, True, "cust_01")
    assert (got[1].temperature, got[1].door_open, got[1].target_temp) == (1.0, False, -10.0)


def test_dead_letters_keep_key_payload_error_and_topic(spark):
    rows = [(0, b"cust_01:truck_01", b"not-json"), (1, None, None), (2, b"k", b"a\xffb")]
    checked = contract.check_reading(contract.parse_raw(spark.createDataFrame(rows, COLUMNS)))
    got = contract.dead_letters(checked, Settings(), F.lit(9.0)).orderBy("arrival_seq").collect()
    assert [(r.original_key, r.payload) for r in got] == [
        ("cust_01:truck_01", "not-json"),
        ("None", "null"),
        ("k", "a�b"),
    ]
    assert {r.source_topic for r in got} == {"raw-telemetry"} and got[0].failed_at == 9.0


def test_payload_is_parsed_once_under_a_filter(checked):
    plan = contract.valid_telemetry(checked.select("*"))._jdf.queryExecution().optimizedPlan().toString()
    df = contract.valid_telemetry(contract.check_reading(contract.parse_raw(checked.select("arrival_seq", "key", "value"))))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("from_json" in line for line in filters)


def test_quality_gate(spark):
    rows = [(i, b"k", body() if i % 2 else b"bad") for i in range(100)] + [(100 + i, b"k", b"bad") for i in range(49)]
    checked = contract.parse_raw(spark.createDataFrame(rows, COLUMNS)).withColumn("batch", F.col("arrival_seq") >= 100)
    got = {r.batch: (r.records, r.rejected, r.tripped) for r in contract.quality_gate(checked, ["batch"]).collect()}
    assert got == {False: (100, 50, True), True: (49, 49, False)}


def test_encoded_messages_parse_back(spark):
    rows = [(0, b"k", body(route_id="r1"))]
    normal = contract.normalize(contract.parse_raw(spark.createDataFrame(rows, COLUMNS), F.lit("e"), F.lit(1.0)))
    (message,) = wire.encode(normal, ["customer_id", "truck_id", "temperature", "route_id"]).collect()
    assert bytes(message.key) == b"cust_01:truck_01"
    assert json.loads(bytes(message.value)) == {**GOOD, "route_id": "r1"}


def test_bounded_read_skips_tombstones_and_keeps_plain_text(spark):
    rows = [(0, b"k", None), (1, b"k", b"plain"), (2, b"k", body()), (3, b"k", body())]
    read = wire.bounded_read(spark.createDataFrame(rows, COLUMNS), 2, "arrival_seq")
    got = [json.loads(r.p) for r in read.select(F.to_json("payload").alias("p")).collect()]
    assert got == [{"raw_message": "plain"}, GOOD]


def test_reconciliation(spark):
    sent = spark.createDataFrame([("a",), ("b",), ("c",)], "event_id STRING")
    received = spark.createDataFrame([("a",), ("c",)], "event_id STRING")
    assert [r.event_id for r in reconcile.missing_events(sent, received).collect()] == ["b"]
    (row,) = reconcile.roundtrip_counts(sent, received).collect()
    assert (row.produced, row.consumed, row.missing, row.duplicated, row.complete) == (3, 2, 1, 0, False)
    twice = spark.createDataFrame([("a",), ("c",), ("c",)], "event_id STRING")
    (row,) = reconcile.roundtrip_counts(sent, twice).collect()
    assert (row.produced, row.consumed, row.missing, row.duplicated, row.complete) == (3, 3, 1, 1, False)
