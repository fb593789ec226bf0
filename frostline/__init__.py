"""Cold-chain telemetry analytics as PySpark DataFrame operators and streaming queries."""

from frostline.config import Settings

__all__ = ["Settings"]
