from frostline.functions.numbers import (
    FIXED_UNITS,
    divide_rounded,
    fixed_point,
    is_finite,
    js_round,
    mean_from_fixed,
    ratio,
    round_half_away,
    whole,
)
from frostline.functions.text import alert_label, partition_key, trim_blank
from frostline.functions.times import (
    epoch_micros,
    iso_micros,
    iso_utc,
    micros_to_seconds,
    seconds_between,
    window_floor,
)

__all__ = [
    "FIXED_UNITS",
    "alert_label",
    "divide_rounded",
    "epoch_micros",
    "fixed_point",
    "is_finite",
    "iso_micros",
    "iso_utc",
    "js_round",
    "mean_from_fixed",
    "micros_to_seconds",
    "partition_key",
    "ratio",
    "round_half_away",
    "seconds_between",
    "trim_blank",
    "whole",
    "window_floor",
]
