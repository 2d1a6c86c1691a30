"""Filters and per-record maps over a series.

A series is a DataFrame with ``tile_id``, ``time_id`` and either ``cells``
(array form: one row per tile and time step) or ``pos``/``v`` (long form:
one row per cell and time step); catalogs add the ``part`` column.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseries.operators.parts import INT_MAX, INT_MIN, assign_part_value, locate_parts
from gridseries.session import estimated_bytes


def filter_time(series: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Keep ``start <= time_id <= end`` (both inclusive; None = open)."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col("time_id") >= F.lit(int(start)))
    if end is not None:
        cond = cond & (F.col("time_id") <= F.lit(int(end)))
    return series.filter(cond) if (start is not None or end is not None) else series


def filter_time_ts(df: DataFrame, ts_col: str, start: int | None = None, end: int | None = None,
                   time_col: str = "time_id") -> DataFrame:
    """Time window on a table that carries a timestamp, with Parquet pushdown.

    ``time_id`` is derived from ``ts_col``, so a predicate on it cannot reach
    the scan.  A conservative range on the timestamp itself can:
    ``T0 + (start - 1) days < ts < T0 + (end + 1) days`` holds for every row
    of the window (time ids cut toward zero), and the exact ``time_id``
    predicate on top removes the few extra rows at the edges.
    """
    import datetime as dt

    from gridseries.functions.timeid import EPOCH, time_id

    epoch = dt.datetime.fromisoformat(EPOCH)
    kind = "TIMESTAMP_NTZ" if df.schema[ts_col].dataType.typeName() == "timestamp_ntz" else "TIMESTAMP"
    ts = F.col(ts_col)
    cond = F.lit(True)
    def bound(days: int):
        try:
            return (epoch + dt.timedelta(days=days)).isoformat(sep=" ")
        except OverflowError:   # beyond the calendar: no bound on this side
            return None

    lo = bound(int(start) - 1) if start is not None else None
    hi = bound(int(end) + 1) if end is not None else None
    if lo is not None:
        cond = cond & (ts > F.expr(f"{kind}'{lo}'"))
    if hi is not None:
        cond = cond & (ts < F.expr(f"{kind}'{hi}'"))
    out = df.filter(cond) if (lo is not None or hi is not None) else df
    if time_col not in out.columns:
        out = out.withColumn(time_col, time_id(ts_col))
    return filter_time(out, start, end)


def part_bounds(splits: list[int], start: int | None, end: int | None, n_parts: int | None = None) -> tuple[int, int]:
    """First and last time part a window can touch."""
    n_parts = len(splits) + 1 if n_parts is None else n_parts
    lo = 0 if start is None else assign_part_value(start, splits)
    hi = n_parts - 1 if end is None else assign_part_value(end, splits)
    return lo, hi


def prune_parts(series: DataFrame, splits: list[int], start: int | None = None, end: int | None = None) -> DataFrame:
    """Time filter plus the ``part`` range it implies.

    The ``part`` predicate is a literal range on the directory column, so the
    scan lists and reads only those directories (PartitionFilters); the
    ``time_id`` predicate reaches the Parquet reader (PushedFilters).
    """
    lo, hi = part_bounds(splits, start, end)
    if start is not None and end is not None and start > end:
        return series.filter(F.lit(False))
    pruned = series.filter((F.col("part") >= F.lit(lo)) & (F.col("part") <= F.lit(hi)))
    return filter_time(pruned, start, end)


WINDOW_BYTES = 64 << 20


def window_parts(windows: DataFrame, splits: list[int], start_col: str = "start", end_col: str = "end") -> DataFrame:
    """One row per window and time part that it touches: the windows' columns and ``part``.

    The first and the last part come from the binned range join of
    ``locate_parts``; a null bound is open, a window that ends before it starts
    touches nothing.
    """
    lo, hi = F.coalesce(F.col(start_col).cast("int"), F.lit(INT_MIN)), F.coalesce(F.col(end_col).cast("int"), F.lit(INT_MAX))
    w = windows.withColumns({"__lo": lo, "__hi": hi}).filter(F.col("__lo") <= F.col("__hi"))
    w = locate_parts(locate_parts(w, splits, "__lo", "__first"), splits, "__hi", "__last")
    return w.withColumn("part", F.explode(F.sequence("__first", "__last")))


def filter_windows(series: DataFrame, windows: DataFrame, splits: list[int], start_col: str = "start",
                   end_col: str = "end", directory: dict[str, Column] | None = None) -> DataFrame:
    """The records of many time windows at once: every record with the columns of each window that holds it.

    ``windows``: one row per window, bounds inclusive.  A record meets the
    windows of its part by an equi-join on ``part`` and is then compared with
    their bounds.  While the windows, spread over their parts, stay below
    ``WINDOW_BYTES`` by the planner's estimate they are broadcast, and the scan
    reads only the parts that some window touches (dynamic partition pruning);
    larger tables are joined by a shuffle.  ``directory``: further columns of the
    series that follow from ``part``, by the expressions given (pruned alike).
    """
    clash = set(series.columns) & set(windows.columns)
    if clash:
        raise ValueError(f"windows and series share columns: {', '.join(sorted(clash))}")
    w = window_parts(windows, splits, start_col, end_col).withColumns(directory or {})
    if estimated_bytes(windows) * (len(splits) + 1) <= WINDOW_BYTES:
        w = F.broadcast(w)
    names = [*windows.columns, *series.columns]
    hits = series.join(w, ["part", *(directory or {})]).filter((F.col("time_id") >= F.col("__lo")) & (F.col("time_id") <= F.col("__hi")))
    return hits.select(*names)


def filter_series(series: DataFrame, predicate) -> DataFrame:
    """Any predicate on a record.

    ``predicate`` is a Column (stays in the JVM and can be pushed down), or a
    Python function ``f(time_id: pd.Series, cells: pd.Series) -> pd.Series[bool]``
    evaluated batch-wise through Arrow.
    """
    if isinstance(predicate, Column):
        return series.filter(predicate)
    fn = _vectorized(predicate, "boolean")
    return series.filter(fn(F.col("time_id"), F.col("cells")))


def map_cells(series: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    """Per-cell function given as a Column expression builder, e.g. ``lambda c: c / 12``."""
    if "cells" in series.columns:
        return series.withColumn("cells", F.transform("cells", fn))
    return series.withColumn("v", fn(F.col("v")))


def map_tiles(series: DataFrame, f) -> DataFrame:
    """Record-wise map that may change time id and cells, keeping other columns.

    ``f`` is either a dict ``{column: Column}`` of replacement expressions (JVM
    side), or a Python function over a pandas batch of records that returns a
    batch with the same columns.  The Python form runs on Arrow batches
    (``mapInArrow``; narrow, so the input partitioning is kept) and converts
    back without pandas' null masking, so NaN cells stay NaN.
    """
    if isinstance(f, dict):
        return series.withColumns(f)
    schema = series.schema
    names = schema.names

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            # nullable integers keep their type: pandas would make them doubles
            out = f(b.to_pandas(types_mapper=_nullable))
            arrays = []
            for i, name in enumerate(names):
                typ, col = b.schema.field(i).type, out[name]
                if pa.types.is_list(typ):
                    rows = [np.zeros(0) if v is None else np.asarray(v) for v in col.tolist()]
                    none = np.array([v is None for v in col.tolist()], bool)
                    offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32())
                    flat = pa.array(np.concatenate(rows) if rows else np.zeros(0), from_pandas=False).cast(typ.value_type)
                    arrays.append(pa.ListArray.from_arrays(offsets, flat, mask=pa.array(none)) if none.any()
                                  else pa.ListArray.from_arrays(offsets, flat))
                else:
                    arrays.append(pa.Array.from_pandas(col, type=typ) if pa.types.is_integer(typ)
                                  else pa.array(col.to_numpy(), type=typ, from_pandas=False))
            yield pa.RecordBatch.from_arrays([a.cast(b.schema.field(i).type) for i, a in enumerate(arrays)], names=names)

    return series.mapInArrow(run, schema)


def _nullable(arrow_type):
    """The pandas type for an Arrow integer that can hold missing values."""
    import pyarrow as pa

    return {pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(),
            pa.int64(): pd.Int64Dtype()}.get(arrow_type)


def _vectorized(fn, return_type: str):
    def wrapped(time_id: pd.Series, cells: pd.Series) -> pd.Series:
        return fn(time_id, cells)

    return F.pandas_udf(wrapped, return_type)
