"""Source bands: one row per time step of a raster, already decoded.

Band table columns (one Parquet table per source file, or one table with
``path_idx``):

    path_idx INT, band INT (from 1), metadata ARRAY<STRING> ("K=V"),
    xmin, ymin, xmax, ymax DOUBLE, cols INT, rows INT, cell_type STRING,
    cells ARRAY<numeric> (row-major, cols x rows)

Rasters too big for one row may come as row strips instead: add
``row0 INT`` (first raster row of the strip) and put ``k x cols`` cells in
each row; ingest then assembles tiles per time step and tile.

Decoding raster files (NetCDF/GeoTIFF) is not part of the library; any
reader that produces this table feeds the ingest.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRID_FIELDS = ("xmin", "ymin", "xmax", "ymax", "cols", "rows", "cell_type")


def read_bands(spark: SparkSession, paths: list[str], schema=None) -> DataFrame:
    """All bands of all inputs in order; ``path_idx`` is always the position in ``paths``.

    One scan over all inputs, however deep their paths are.  The position comes
    from each row's file path: per depth that occurs among the inputs, the path
    cut to that depth is looked up in the table of inputs (broadcast: one row per
    entry of ``paths``), and the deepest input that holds the file wins, so an
    input inside another one is counted for itself.  An input named twice counts
    twice; a stored ``path_idx`` column is ignored.
    The schema is taken from the first input (or given) and imposed on the
    others, so opening many inputs does not read every footer on the driver;
    an input with incompatible column types fails when it is read.
    """
    if not paths:
        raise ValueError("no input paths")
    if schema is None:
        schema = spark.read.parquet(paths[0]).schema
    places: dict[str, list[int]] = {}
    for i, p in enumerate(paths):
        places.setdefault(_qualified(spark, p), []).append(i)
    rows = spark.read.schema(schema).parquet(*dict.fromkeys(paths))
    names = [c for c in rows.columns if c != "path_idx"]
    rows = rows.select(*names, F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/").alias("__file"))
    depths = sorted({p.count("/") for p in places}, reverse=True)
    for depth in depths:
        inputs = spark.createDataFrame([(p, at) for p, at in places.items() if p.count("/") == depth], f"__root{depth} string, __at{depth} array<int>")
        rows = rows.join(F.broadcast(inputs), F.substring_index("__file", "/", depth + 1) == F.col(f"__root{depth}"), "left")
    found = F.coalesce(*[F.col(f"__at{depth}") for depth in depths])
    return rows.select(*names, F.explode(found).alias("path_idx"))


def _qualified(spark: SparkSession, path: str) -> str:
    """The path as the scan reports it: an encoded URI with scheme and authority, without a slash at its end."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return re.sub("^file:/+", "file:/", fs.makeQualified(hpath).toUri().toString().rstrip("/"))


def _grid_struct() -> Column:
    return F.struct(*[F.col(c) for c in GRID_FIELDS])


def infer_grid(bands: DataFrame) -> DataFrame:
    """Raster extent, size and cell type of the first band of the first input.

    A ``min_by`` aggregate (partial per task, one row out), not a sort.
    """
    first = F.min_by(_grid_struct(), F.struct("path_idx", "band")).alias("g")
    return bands.agg(first).select("g.*")


def check_extents(bands: DataFrame) -> DataFrame:
    """Per input: ``path_idx, n_bands, extent_ok``.

    ``extent_ok`` is false when any band of the input has another extent, size
    or cell type than the first band of the first input (a scalar subquery).
    """
    first = infer_grid(bands).select(_grid_struct().alias("g")).scalar()
    g = _grid_struct()
    return bands.groupBy("path_idx").agg(
        F.count(F.lit(1)).alias("n_bands"),
        F.min(g).alias("lo"), F.max(g).alias("hi"),
    ).select("path_idx", "n_bands", ((F.col("lo") == first) & (F.col("hi") == first)).alias("extent_ok"))


def band_steps(timed: DataFrame) -> DataFrame:
    """Per time id: number of bands, smallest and largest grid, and the first band's place and grid.

    One pass over the bands' small columns (partial per task); what is left has
    one row per time step.
    """
    g = _grid_struct()
    # with strips (``row0``) a band is counted once, by its strip at row 0
    n = F.count_if(F.col("row0") == 0) if "row0" in timed.columns else F.count(F.lit(1))
    return timed.groupBy("time_id").agg(n.alias("n_bands"), F.min(g).alias("lo"), F.max(g).alias("hi"),
                                        F.min(F.struct("path_idx", "band")).alias("place"),
                                        F.min_by(g, F.struct("path_idx", "band")).alias("grid"))


def steps_summary(steps: DataFrame) -> DataFrame:
    """One row: the first band's grid, smallest and largest grid, band count.

    All inputs agree with the first band exactly when ``lo == first == hi``.
    """
    return steps.agg(F.min_by("grid", "place").alias("first"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                     F.sum("n_bands").alias("n_bands"))


def time_bounds(series: DataFrame) -> DataFrame:
    """Min and max time id over all bands."""
    return series.agg(F.min("time_id").alias("min_time"), F.max("time_id").alias("max_time"))
