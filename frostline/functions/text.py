"""String helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as blank around an identifier.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0            "
    "    　"
)


def trim_blank(value: Column) -> Column:
    """Text without blanks at either end. Trimming a set of characters is slow, so it is done only where needed."""
    needed = value.rlike(f"^[{BLANKS}]|[{BLANKS}]$")
    return F.when(needed, F.btrim(value, F.lit(BLANKS))).otherwise(value)


def partition_key(customer_id: Column | str = "customer_id", truck_id: Column | str = "truck_id") -> Column:
    """Routing key `customer:truck` that keeps all readings of one truck together."""
    return F.concat_ws(":", customer_id, truck_id)


def alert_label(alert_type: Column) -> Column:
    """`HIGH_TEMPERATURE` -> `High Temperature`."""
    return F.initcap(F.replace(F.lower(alert_type), F.lit("_"), F.lit(" ")))
