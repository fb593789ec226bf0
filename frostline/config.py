"""Parameters shared by the operators. Every operator takes a Settings and never reads global state."""

from __future__ import annotations

from dataclasses import dataclass

MICROS = 1_000_000


@dataclass(frozen=True)
class Settings:
    # Event-time windows
    window_seconds: int = 300
    slide_seconds: int = 10
    grace_seconds: int = 30

    # Cold-chain limits in degrees Celsius
    safe_temp_min: float = -25.0
    safe_temp_max: float = -10.0
    spike_tolerance: float = 3.0
    sustained_threshold: float = -10.0
    sustained_seconds: int = 30

    # Streams with a clock: silence after which a truck is forgotten, and how far a partition may lag behind the clock
    idle_seconds: int = 1200
    clock_delay_seconds: int = 600

    # How much older than its truck's newest reading a reading may be to still count in sliding windows of a stream
    pane_seconds_kept: int = 3600

    # Bottleneck rule
    p95_limit_ms: float = 500.0
    failure_rate_limit: float = 0.05
    throughput_ratio_limit: float = 0.7
    violations_to_raise: int = 2

    # Lag flags and data-quality gate
    lag_limit: int = 1000
    gate_min_records: int = 50
    gate_error_rate: float = 0.50

    # Topics
    raw_topic: str = "raw-telemetry"
    processed_topic: str = "processed-averages"
    alerts_topic: str = "alerts-topic"
    dead_letter_topic: str = "telemetry-dead-letter"
    partitions: int = 6
    lag_groups: str = "telemetry-worker"

    # Keys with more rows than this are cut into arrival-order chunks of at most this many rows, so
    # that no ordered computation ever sends a whole hot key to one task (operators/ordered.py).
    chunk_rows: int = 4_000_000

    @property
    def window_us(self) -> int:
        return self.window_seconds * MICROS

    @property
    def slide_us(self) -> int:
        return self.slide_seconds * MICROS

    @property
    def grace_us(self) -> int:
        return self.grace_seconds * MICROS
