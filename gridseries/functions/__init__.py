"""Column-level functions (JVM-side expressions, no Python per row)."""

from gridseries.functions.bandmeta import band_entries, band_time, band_value
from gridseries.functions.timeid import EPOCH, range_length, time_date, time_id

__all__ = ["EPOCH", "time_id", "time_date", "range_length", "band_entries", "band_value", "band_time"]
