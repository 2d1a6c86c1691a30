"""Band metadata: ``KEY=VALUE`` strings attached to each source band."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: metadata key that carries the time of a band.
TIME_KEY = "NETCDF_DIM_Time"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def band_entries(meta) -> Column:
    """ARRAY<STRING> of ``K=V`` -> ARRAY<STRUCT<k, v>>.

    The text is split at ``=`` and items 0 and 1 are kept (``K=a=b`` gives
    ``a``).  An entry without a value (``K`` or ``K=``) is an error.
    """
    def parse(m: Column) -> Column:
        parts = F.split(m, "=")
        bad = (F.size(parts) < 2) | (parts.getItem(1) == F.lit(""))
        return F.when(bad, F.raise_error(F.concat(F.lit("band metadata entry without a value: "), m))) \
            .otherwise(F.struct(parts.getItem(0).alias("k"), parts.getItem(1).alias("v")))

    return F.transform(_col(meta), parse)


def band_value(meta, key: str) -> Column:
    """Value of ``key`` in a band's metadata; the last duplicate wins; NULL if absent."""
    hits = F.filter(band_entries(meta), lambda e: e["k"] == F.lit(key))
    return F.try_element_at(hits, F.lit(-1))["v"]


def band_time(meta, key: str = TIME_KEY) -> Column:
    """Time id of a band: the key's value as a double, cut toward zero to INT.

    A missing key is an error (ANSI casts also fail on text that is no number).
    """
    v = F.coalesce(band_value(meta, key), F.raise_error(F.lit(f"band metadata has no {key}")).cast("string"))
    return v.cast("double").cast("int")
