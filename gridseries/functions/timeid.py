"""Time ids: whole days since 1950-01-01 12:00 UTC, cut toward zero.

The epoch is at noon, so ``datediff`` (calendar days) is one day off for
times before noon; ``timestampdiff(DAY, ...)`` counts whole elapsed days.
Inputs are TIMESTAMP_NTZ (or TIMESTAMP in a UTC session) or DATE.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the epoch of time id 0.
EPOCH = "1950-01-01 12:00:00"
_EPOCH_SQL = f"TIMESTAMP_NTZ'{EPOCH}'"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def time_id(ts) -> Column:
    """DateTime -> INT time id (whole days since the epoch, toward zero)."""
    return F.timestamp_diff("DAY", F.expr(_EPOCH_SQL), _col(ts)).cast("int")


def time_date(tid) -> Column:
    """INT time id -> TIMESTAMP_NTZ at 12:00 of that day."""
    return F.timestamp_add("DAY", _col(tid), F.expr(_EPOCH_SQL))


def range_length(start, end) -> Column:
    """Length of a time range in days: end - start."""
    return (_col(end) - _col(start)).cast("int")
