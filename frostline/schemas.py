"""Declared schemas of the streams and tables, as DDL text that readers and writers accept."""

from __future__ import annotations

WIRE_COLUMNS = ("key", "value", "partition", "offset", "timestamp")
WIRE = "key BINARY, value BINARY, partition INT, offset BIGINT, timestamp TIMESTAMP"

RAW_TELEMETRY = (
    "event_id STRING, timestamp DOUBLE, customer_id STRING, truck_id STRING, route_id STRING, temperature DOUBLE, "
    "target_temp DOUBLE, ambient_temp DOUBLE, compressor_status STRING, door_open BOOLEAN, battery_level DOUBLE, "
    "latitude DOUBLE, longitude DOUBLE, speed_kmh DOUBLE"
)

NORMALIZED_TELEMETRY = (
    "event_id STRING, timestamp DOUBLE, customer_id STRING, truck_id STRING, route_id STRING, temperature DOUBLE, "
    "target_temperature DOUBLE, ambient_temperature DOUBLE, compressor_status STRING, door_open BOOLEAN, "
    "battery_level DOUBLE, latitude DOUBLE, longitude DOUBLE, speed_kmh DOUBLE"
)

PROCESSED_AGGREGATE = (
    "aggregate_id STRING, customer_id STRING, truck_id STRING, window_start DOUBLE, window_end DOUBLE, "
    "sample_count BIGINT, avg_temperature DOUBLE, min_temperature DOUBLE, max_temperature DOUBLE, "
    "target_temperature DOUBLE, is_breached BOOLEAN, created_at DOUBLE"
)

ANOMALY_ALERT = (
    "alert_id STRING, customer_id STRING, truck_id STRING, severity STRING, alert_type STRING, "
    "trigger_temperature DOUBLE, target_temperature DOUBLE, threshold_limit DOUBLE, compressor_status STRING, "
    "timestamp DOUBLE, message STRING, acknowledged BOOLEAN"
)

DEAD_LETTER = "original_key STRING, payload STRING, error STRING, source_topic STRING, failed_at DOUBLE"

OWNERS = (
    "owner_id BIGINT, company_name STRING, contact_name STRING, email STRING, phone STRING, address STRING, "
    "status STRING, created_at STRING, updated_at STRING"
)
TRUCKS = (
    "truck_id BIGINT, owner_id BIGINT, plate_number STRING, vin STRING, make STRING, model STRING, year INT, "
    "capacity_tons DOUBLE, current_status STRING, mileage DOUBLE, last_service_date STRING, created_at STRING, "
    "updated_at STRING"
)
DRIVERS = (
    "driver_id BIGINT, owner_id BIGINT, first_name STRING, last_name STRING, license_number STRING, "
    "license_class STRING, phone STRING, email STRING, date_of_birth STRING, status STRING, hire_date STRING, "
    "created_at STRING, updated_at STRING"
)
TRIPS = (
    "trip_id BIGINT, owner_id BIGINT, truck_id BIGINT, driver_id BIGINT, origin STRING, destination STRING, "
    "cargo_type STRING, cargo_weight DOUBLE, distance_km DOUBLE, trip_status STRING, scheduled_start_time STRING, "
    "actual_start_time STRING, actual_end_time STRING, fuel_cost DOUBLE, revenue DOUBLE, notes STRING, "
    "created_at STRING, updated_at STRING"
)
FLEET_TABLES = {"owners": OWNERS, "trucks": TRUCKS, "drivers": DRIVERS, "trips": TRIPS}

THROUGHPUT_TESTS = (
    "id STRING, target_rate DOUBLE, duration_seconds DOUBLE, actual_rate DOUBLE, peak_rate DOUBLE, "
    "average_latency_ms DOUBLE, p95_latency_ms DOUBLE, p99_latency_ms DOUBLE, error_count BIGINT, "
    "failure_rate DOUBLE, started_at STRING, completed_at STRING, status STRING, bottleneck_node STRING"
)
ALERT_HISTORY = (
    "id STRING, alert_type STRING, severity STRING, node_id STRING, metric STRING, current_value DOUBLE, "
    "threshold DOUBLE, status STRING, description STRING, triggered_at STRING, acknowledged_at STRING, "
    "resolved_at STRING"
)

VEHICLES = (
    "id STRING, telemetry_date STRING, route_name STRING, truck_type STRING, name STRING, speed INT, status STRING, "
    "lat DOUBLE, lng DOUBLE, route ARRAY<STRUCT<lat: DOUBLE, lng: DOUBLE>>"
)

OFFSETS = "consumer_group STRING, topic STRING, partition INT, committed BIGINT"
LATEST_OFFSETS = "topic STRING, partition INT, latest BIGINT, replicas ARRAY<INT>"
