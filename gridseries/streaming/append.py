"""Append newly arriving bands to an existing catalog with Structured Streaming.

New band files (the band-table layout of ``gridseries.sources.bands``) land in
a folder; a stateless streaming query tiles them and assigns each time step
to a part with the catalog's fixed split points (steps after the last split
go to the open last part, so every part range stays valid and ``prune_parts``
keeps working; the part comes from a stream-static join with the binned splits,
see ``locate_parts``).  The output goes through Spark's file sink into
``<catalog>/stream``: its commit log makes each micro-batch exactly-once, so
a failed and replayed batch never duplicates records.  ``open_catalog`` reads
``cells`` and ``stream`` together; ``refresh_time_count`` brings the stored
count up to date once an append is done.  Bands come whole: row strips of one
band may arrive in different batches, so they are refused here and belong to
``ingest``.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gridseries.functions.bandmeta import TIME_KEY, band_time
from gridseries.operators.aggregate import time_count
from gridseries.operators.parts import locate_parts
from gridseries.operators.tiling import tile_bands
from gridseries.sources.catalog import open_catalog, version_of
from gridseries.sources.metadata import load_metadata, store_metadata


def band_schema(cell_type: T.DataType = T.FloatType()) -> T.StructType:
    return T.StructType([
        T.StructField("path_idx", T.IntegerType()),
        T.StructField("band", T.IntegerType()),
        T.StructField("metadata", T.ArrayType(T.StringType())),
        T.StructField("xmin", T.DoubleType()), T.StructField("ymin", T.DoubleType()),
        T.StructField("xmax", T.DoubleType()), T.StructField("ymax", T.DoubleType()),
        T.StructField("cols", T.IntegerType()), T.StructField("rows", T.IntegerType()),
        T.StructField("cell_type", T.StringType()),
        T.StructField("cells", T.ArrayType(cell_type)),
    ])


def tiled_stream(bands: DataFrame, catalog_path: str, time_key: str = TIME_KEY) -> DataFrame:
    """Streaming (or batch) bands -> catalog records, checked against the catalog's grid."""
    if "row0" in bands.columns:
        raise ValueError("appended bands must be whole rasters; row strips go through ingest")
    spark = bands.sparkSession
    meta = load_metadata(spark, catalog_path)
    e, lay = meta.extent, meta.layout
    same = ((F.col("xmin") == e.xmin) & (F.col("ymin") == e.ymin) & (F.col("xmax") == e.xmax)
            & (F.col("ymax") == e.ymax) & (F.col("cols") == lay.cols) & (F.col("rows") == lay.rows)
            & (F.col("cell_type") == meta.cell_type.name))
    checked = bands.withColumn("ok", F.assert_true(same, F.lit("band grid differs from the catalog")))
    timed = checked.select(band_time("metadata", time_key).alias("time_id"),
                           F.when(F.col("ok").isNull(), F.col("cells"))
                           .cast(T.ArrayType(meta.cell_type.spark_type)).alias("cells"))
    placed = locate_parts(timed, list(meta.splits))  # once per band, before it is cut into tiles
    return tile_bands(placed, lay, lay.cols, keep=("time_id", "part")).select("tile_id", "part", "time_id", "cells")


def append_bands_stream(spark: SparkSession, band_dir: str, catalog_path: str, checkpoint: str | None = None,
                        available_now: bool = True, time_key: str = TIME_KEY) -> StreamingQuery:
    """Start the append query; with ``available_now`` it processes what is there and stops."""
    meta = load_metadata(spark, catalog_path)
    src = spark.readStream.schema(band_schema(meta.cell_type.spark_type)).parquet(band_dir)
    out = f"{catalog_path.rstrip('/')}/stream{version_of(meta)}"
    ckpt = checkpoint or f"{catalog_path.rstrip('/')}/_stream_checkpoint{version_of(meta)}"
    w = (tiled_stream(src, catalog_path, time_key).writeStream.format("parquet")
         .option("path", out).option("checkpointLocation", ckpt)
         .partitionBy("tile_id", "part").outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def refresh_time_count(spark: SparkSession, catalog_path: str) -> int:
    """Count the first tile's records, appended ones included, and store that as the catalog's time count.

    To be called between appends (the metadata record is replaced).
    """
    catalog = open_catalog(spark, catalog_path)
    n = int(time_count(catalog.tile(0)).first()[0])
    if n != catalog.meta.time_count:
        store_metadata(spark, replace(catalog.meta, time_count=n), catalog_path)
    return n
