"""Time parts: consecutive time-id ranges that become ``part=`` directories.

Every k-th distinct time id (in ascending order) is a split point, the
inclusive upper bound of a part.  With splits ``s0 < s1 < ...`` the part of a
time id ``t`` is the number of splits below ``t``; part ``i`` covers
``(s[i-1] + 1, s[i])`` with open ends at the INT limits.

Ranks are computed without a window over all time ids: distinct ids are
grouped into fixed buckets of ``RANK_BUCKET`` consecutive ids (so a group never
exceeds that many rows), ranked inside the bucket, and offset by the running
count of the buckets before.  Only the bucket table, at most
``2**32 / RANK_BUCKET`` rows (INT range), passes through one window and is
broadcast.

The part of any time id, also of one that is new or has been moved, comes from
a binned range join (``locate_parts``): the days between the first and the last
split are cut into bins, a bin knows the number of splits before it and the few
splits inside it, and a row meets exactly one bin by an equi-join.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INT_MIN = -(2 ** 31)
INT_MAX = 2 ** 31 - 1
RANK_BUCKET = 4096
BIN_SPLITS = 64


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def time_ranks(series: DataFrame, time_col: str = "time_id", materialize: bool = True) -> DataFrame:
    """Distinct time ids with their 1-based ascending rank: ``(time_id, rn)``.

    With ``materialize`` the distinct ids (one row per time step: small) are
    checkpointed once in the shared folder, so the source is scanned once
    although both the bucket counts and the in-bucket ranks are derived from
    them.  Callers that write the result themselves and read only a small
    column of the source may skip it (the source is then scanned twice).
    """
    from gridseries.session import shared_dir

    d = series.select(_col(time_col).cast("int").alias("time_id")).distinct() \
        .withColumn("bucket", F.floor(F.col("time_id") / RANK_BUCKET))
    if materialize:
        shared_dir(series.sparkSession)   # a checkpoint dir exists (set only if unset)
        d = d.checkpoint(eager=True)
    counts = d.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inner = Window.partitionBy("bucket").orderBy("time_id")
    ranked = d.withColumn("rn_in", F.row_number().over(inner))
    return ranked.join(F.broadcast(offsets), "bucket") \
        .select("time_id", (F.col("offset") + F.col("rn_in")).cast("long").alias("rn"))


def time_parts(series: DataFrame, k: int, time_col: str = "time_id", materialize: bool = True) -> DataFrame:
    """``(time_id, part, is_split)`` for every distinct time id of the series."""
    r = time_ranks(series, time_col, materialize)
    if k <= 0:
        return r.select("time_id", F.lit(0).alias("part"), F.lit(False).alias("is_split"))
    return r.select("time_id",
                    F.floor((F.col("rn") - 1) / k).cast("int").alias("part"),
                    ((F.col("rn") % k) == 0).alias("is_split"))


def split_points(series: DataFrame, k: int, time_col: str = "time_id") -> DataFrame:
    """Split points as rows ``(part, split)``: the last time id of each full part.

    ``k = 0`` (or less) gives no splits.
    """
    if k <= 0:
        return series.sparkSession.createDataFrame([], "part INT, split INT")
    r = time_ranks(series, time_col)
    return r.filter(F.col("rn") % k == 0).select(
        (F.col("rn") / k - 1).cast("int").alias("part"), F.col("time_id").alias("split"))


def splits_array(splits: DataFrame) -> list[int]:
    """Collect the split points (metadata: one int per part) in order."""
    row = splits.agg(F.array_sort(F.collect_list("split")).alias("s")).first()
    return [int(x) for x in (row["s"] or [])]


def blocks_per_part(block_size: int, cols: int, rows: int, cell_bytes: int) -> int:
    """Time steps per part so that one part of one tile fills a block: long math (0: a step is larger than a block)."""
    per_step = int(cols) * int(rows) * int(cell_bytes)
    return int(block_size) // per_step if per_step > 0 else 0


def int_array(values) -> Column:
    """A list of ints as one literal (folded to an array constant when the query is planned)."""
    return F.from_json(F.lit(json.dumps([int(v) for v in values])), "array<int>")


def assign_part(time, splits) -> Column:
    """Part of a time id: number of splits strictly below it.

    ``splits`` is a Python list (sorted) or an ARRAY<INT> column; for whole
    series prefer ``attach_parts`` or ``locate_parts``, joins instead of a look-up per row.
    """
    t = _col(time)
    if isinstance(splits, Column):
        return F.size(F.filter(splits, lambda s: s < t)).cast("int")
    if len(splits) == 0:
        return F.lit(0)
    return F.size(F.filter(int_array(splits), lambda s: s < t)).cast("int")


def assign_part_value(time: int, splits: list[int]) -> int:
    """Driver-side form of ``assign_part`` for literal window bounds."""
    import bisect
    return bisect.bisect_left(list(splits), int(time))


def bin_bits(splits) -> int:
    """log2 of the days per bin: from 64 to 4,096, about ``BIN_SPLITS`` splits in a bin."""
    span = int(splits[-1]) - int(splits[0]) + 1
    per_split = max(1, span // len(splits))
    return min(12, max(6, (per_split * BIN_SPLITS).bit_length() - 1))


def part_bins(spark: SparkSession, splits) -> DataFrame:
    """``(bin, base, inside)`` for the bins from the first to the last split (sorted, at least one).

    ``base`` is the number of splits before the bin, ``inside`` its own splits.
    The table is built from the split list on the driver, which a metadata record
    holds anyway; it has at most ``2**32 / 64`` rows and one int per split.
    """
    bits = bin_bits(splits)
    s = np.asarray(splits, dtype=np.int64)
    bins = np.arange(s[0] >> bits, (s[-1] >> bits) + 1)
    base = np.searchsorted(s, bins << bits)
    inside = pa.ListArray.from_arrays(pa.array(np.append(base, len(s)), pa.int32()), pa.array(s, pa.int32()))
    table = pa.table({"__bin": pa.array(bins, pa.int32()), "__base": pa.array(base, pa.int32()), "__inside": inside})
    return spark.createDataFrame(table)


def locate_parts(series: DataFrame, splits, time_col: str = "time_id", part_col: str = "part") -> DataFrame:
    """``series`` with ``part_col``, the part of its time ids, whatever was stored there before.

    A binned range join: every row looks up its bin (broadcast: its size is
    that of the split list on the driver) and counts the splits below it there.
    Works on streams as well.  A null time id has no part.
    """
    columns = [*series.columns, *([] if part_col in series.columns else [part_col])]
    rest = [c for c in series.columns if c != part_col]
    if not len(splits):
        return series.select(*rest, F.when(F.col(time_col).isNotNull(), 0).alias(part_col)).select(*columns)
    t = F.col(time_col)
    bins = F.broadcast(part_bins(series.sparkSession, splits))
    below = F.col("__base") + F.size(F.filter("__inside", lambda s: s < t))
    part = F.when(t <= F.lit(int(splits[0])), 0).when(t > F.lit(int(splits[-1])), len(splits)).otherwise(below)
    rows = series.select(*rest).withColumn("__bin", F.shiftright(t, bin_bits(splits)).cast("int"))
    return rows.join(bins, "__bin", "left").select(*rest, part.cast("int").alias(part_col)).select(*columns)


def part_ranges(splits: DataFrame) -> DataFrame:
    """``(part, part_min, part_max)`` for parts 0..len(splits) from split rows.

    Part i runs from split i-1 + 1 to split i; ends are open (INT limits).
    One aggregation over the split rows, no window, no cross product.
    """
    spark = splits.sparkSession
    upper = splits.select("part", F.lit(None).cast("int").alias("lo"), F.col("split").alias("hi"))
    lower = splits.select((F.col("part") + 1).alias("part"), (F.col("split") + 1).alias("lo"),
                          F.lit(None).cast("int").alias("hi"))
    seed = spark.range(1).select(F.lit(0).alias("part"), F.lit(None).cast("int").alias("lo"),
                                 F.lit(None).cast("int").alias("hi"))
    return upper.unionByName(lower).unionByName(seed).groupBy("part").agg(
        F.coalesce(F.max("lo"), F.lit(INT_MIN)).alias("part_min"),
        F.coalesce(F.max("hi"), F.lit(INT_MAX)).alias("part_max"))


def attach_parts(series: DataFrame, parts: DataFrame) -> DataFrame:
    """Add ``part`` to a series by an equi-join on ``time_id`` with ``time_parts``.

    No hint: the part table has one row per distinct time id, and Spark broadcasts
    it when its measured size allows, else both sides shuffle on ``time_id`` (a
    time id holds as many rows as the raster has tiles; skew is split by AQE).
    """
    return series.join(parts.select("time_id", "part"), "time_id")


__all__ = ["INT_MIN", "INT_MAX", "time_ranks", "time_parts", "split_points", "splits_array",
           "blocks_per_part", "assign_part", "assign_part_value", "part_ranges", "attach_parts",
           "bin_bits", "part_bins", "locate_parts"]
