"""Error-free sums of doubles: the same bits for every order, partitioning and physical form.

A finite value is cut into three whole numbers on a grid of powers of two: with
``b`` = its exponent divided by 32 (the bin), ``x = v * 2**(-32 b)`` lies
between 1 and 2**32; ``d0`` is its whole part, ``d1`` and ``d2`` the next 27 and
27 bits.  That loses nothing: a double has 53 bits.  Whole numbers add up
without rounding in any order, per cell and bin, as long sums (up to 2**31 values
a cell and bin; beyond that Spark reports an overflow).  At the end the bins of
a cell are added as integers of any length and rounded once, to the nearest
double, so the result is the correctly rounded exact sum.

NaN and infinities go beside the bins: they are added as doubles, which for
them does not depend on the order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BIN_BITS = 32
TAIL_BITS = 27
LEAST_BIN, MOST_BIN = -34, 32
DIGITS = ("d0", "d1", "d2")
_TAIL = float(1 << TAIL_BITS)


def binned(cells: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """``keys``, bin, d0, d1, d2, special of a DOUBLE column (never NULL); step by step, so nothing is worked out twice."""
    v, bin_, x = F.col(value), F.col("bin"), F.col("x")
    infinite = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    # the scale in two halves: one factor alone would leave the range of doubles at its ends
    halves = F.array(*[F.lit(2.0 ** (-BIN_BITS // 2 * b)) for b in range(LEAST_BIN, MOST_BIN + 1)])
    rows = cells.select(*keys, value, F.when(infinite | (v == F.lit(0.0)), None).otherwise(F.floor(F.log2(F.abs(v)) / BIN_BITS)).cast("int").alias("bin"))
    rows = rows.select(*keys, F.coalesce("bin", F.lit(0)).alias("bin"), F.when(infinite, v).alias("special"),
                       F.when(bin_.isNull(), 0.0).otherwise(v).alias("x"), F.get(halves, F.coalesce("bin", F.lit(0)) - LEAST_BIN).alias("half"))
    rows = rows.select(*keys, "bin", "special", (x * F.col("half") * F.col("half")).alias("x"))
    rows = rows.select(*keys, "bin", "special", "x", x.cast("long").alias("d0"))
    rows = rows.select(*keys, "bin", "special", "d0", ((x - F.col("d0").cast("double")) * F.lit(_TAIL)).alias("x"))
    rows = rows.select(*keys, "bin", "special", "d0", "x", x.cast("long").alias("d1"))
    return rows.select(*keys, bin_, "special", "d0", "d1", ((x - F.col("d1").cast("double")) * F.lit(_TAIL)).cast("long").alias("d2"))


def exact_sums(cells: DataFrame, keys: list[str], value: str = "v", out: str = "sum_v") -> DataFrame:
    """``keys, out``: the correctly rounded sum of ``value`` (DOUBLE, never NULL) per group.

    Two grouped sums: per (keys, bin), combined on the map side, then the bins
    of a group (at most 66) meet and are rounded.
    """
    digits = binned(cells, keys, value).groupBy(*keys, "bin")
    return rounded(digits.agg(*[F.sum(d).alias(d) for d in DIGITS], F.sum("special").alias("special")), keys, out)


def rounded(bins: DataFrame, keys: list[str], out: str = "sum_v") -> DataFrame:
    """Sums per (keys, bin) -> one rounded double per group."""
    gathered = bins.groupBy(*keys).agg(F.collect_list(F.struct("bin", *DIGITS)).alias("bins"), F.sum("special").alias("special"))
    schema = T.StructType([*[gathered.schema[k] for k in keys], T.StructField(out, T.DoubleType(), False)])
    n = len(keys)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            lists = b.column(n)
            ends = np.asarray(lists.offsets, dtype=np.int64)
            flat = lists.values
            parts = [np.asarray(flat.field(i), dtype=np.int64) for i in range(4)]
            special = b.column(n + 1).to_pylist()
            sums = round_groups(*parts, ends)
            for i, s in enumerate(special):
                if s is not None:
                    sums[i] = s
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(n)], pa.array(sums)], names=[*keys, out])

    return gathered.mapInArrow(run, schema)


def round_groups(bins, d0, d1, d2, ends) -> np.ndarray:
    """The double nearest to the sum of the digits of rows ``ends[i] : ends[i + 1]``."""
    lo = int(bins.min()) if len(bins) else 0
    low = TAIL_BITS * 2 - BIN_BITS * lo     # the last digit of the least bin counts 2**-low
    out = np.zeros(len(ends) - 1)
    shift = (bins - lo) * BIN_BITS
    rows = list(zip(shift.tolist(), d0.tolist(), d1.tolist(), d2.tolist()))
    for i, (a, z) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        total = sum(((x << TAIL_BITS * 2) + (y << TAIL_BITS) + w) << s for s, x, y, w in rows[a:z])
        out[i] = nearest(total, low)
    return out


def nearest(total: int, low: int) -> float:
    """``total * 2**-low`` as a double, rounded once (to even), infinite beyond the range."""
    try:
        return total / (1 << low) if low >= 0 else float(total << -low)
    except OverflowError:
        return float("inf") if total > 0 else float("-inf")


def split(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """numpy form of ``binned``: bins, digits (3, ...) as longs, and where the values are NaN or infinite."""
    special = ~np.isfinite(values)
    v = np.where(special, 0.0, values) if special.any() else values
    exponent = np.frexp(v)[1]
    bins = np.where(v == 0, 0, (exponent - 1) >> 5)
    x = np.ldexp(v, -BIN_BITS * bins)
    digits = np.empty((3, *v.shape), np.int64)
    whole = np.trunc(x)
    digits[0] = whole
    x = (x - whole) * _TAIL
    whole = np.trunc(x)
    digits[1] = whole
    digits[2] = (x - whole) * _TAIL
    return bins, digits, special


def grouped_bins(values: np.ndarray, starts: np.ndarray):
    """Per bin of ``values`` (rows x cells): (bin, digit sums (3, groups, cells)) over row groups that begin at ``starts``."""
    bins, digits, special = split(values)
    kinds = np.unique(bins)
    for b in kinds.tolist():
        part = digits if len(kinds) == 1 else np.where(bins == b, digits, 0)
        yield b, np.add.reduceat(part, starts, axis=1)
    if special.any():
        yield None, np.add.reduceat(np.where(special, values, 0.0), starts, axis=0)
