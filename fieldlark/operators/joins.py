"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest table, in bytes, that is broadcast.
BROADCAST_BYTES = 32 << 20


def bounded(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """``df`` marked for broadcast if ``rows`` rows of ``row_bytes`` stay within the bound; else the planner chooses."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
