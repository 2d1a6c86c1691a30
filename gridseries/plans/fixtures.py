"""Grids derived from the driver tables (see FIXTURES.md).

* F-EMB: ``embeddings`` as a dense 8x8 float raster per time step
  (``time_id = vec_id``, row-major cells = ``embedding``), layout 4x2 tiles of
  2 cols x 4 rows.  Bands are grouped into inputs of ``EMB_BANDS_PER_INPUT``.
* F-SHIP: ``lineitem`` as a sparse 16x8 grid per ship day
  (``col = l_partkey % 16``, ``row = l_suppkey % 8``, value = summed quantity),
  layout 4x2 tiles of 4x4.
* F-EVT: ``events`` with the time id of each event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseries.functions.bandmeta import TIME_KEY, band_time
from gridseries.functions.timeid import time_id
from gridseries.model import Extent, TileLayout
from gridseries.operators.filters import filter_time, filter_time_ts
from gridseries.operators.tiling import cell_to_tile, tile_bands
from gridseries.session import session_cached

# Fixed values of the fixtures.
EMB_EXTENT = Extent(-180.0, -90.0, 180.0, 90.0)
EMB_COLS = 8
EMB_CELL_HEIGHT = 22.5  # degrees: the extent's height follows the number of rows in the data
EMB_LAYOUT = TileLayout(tile_cols=4, tile_rows=2, pixel_cols=2, pixel_rows=4)
EMB_BANDS_PER_INPUT = 250
EMB_WINDOW = (100, 200)
EMB_K = 64
EMB_SHIFT = 10
EMB_LARGE_K = 128
WIDE_LAYOUT = TileLayout(tile_cols=1, tile_rows=1, pixel_cols=64, pixel_rows=64)

SHIP_LAYOUT = TileLayout(tile_cols=4, tile_rows=2, pixel_cols=4, pixel_rows=4)
SHIP_COLS = 16
SHIP_ROWS = 8
SHIP_K = 64
SHIP_WINDOW = (17000, 17999)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its relation (file listing, schema) is built once per session."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return session_cached(spark, ("table", path), lambda: spark.read.parquet(path))


def emb_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-EMB as a decoded band table (see ``gridseries.sources.bands``)."""
    return session_cached(spark, ("emb_bands", sf_dir), lambda: _emb_bands(spark, sf_dir))


def _emb_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    rows = F.floor(F.size("embedding") / EMB_COLS)
    return e.select(
        F.floor(F.col("vec_id") / EMB_BANDS_PER_INPUT).cast("int").alias("path_idx"),
        ((F.col("vec_id") % EMB_BANDS_PER_INPUT) + 1).cast("int").alias("band"),
        F.array(F.concat(F.lit(f"{TIME_KEY}="), F.col("vec_id").cast("string")),
                F.concat(F.lit("label="), F.col("label").cast("string"))).alias("metadata"),
        F.lit(EMB_EXTENT.xmin).alias("xmin"), F.lit(EMB_EXTENT.ymin).alias("ymin"),
        F.lit(EMB_EXTENT.xmax).alias("xmax"), (F.lit(EMB_EXTENT.ymin) + rows * EMB_CELL_HEIGHT).alias("ymax"),
        F.lit(EMB_COLS).alias("cols"),
        rows.cast("int").alias("rows"),
        F.lit("float32").alias("cell_type"),
        F.col("embedding").alias("cells"),
        F.col("label"),
    )


def emb_input_paths(spark: SparkSession, sf_dir: str) -> list[str]:
    """F-EMB written once per session as one band folder per input (``path_idx``).

    The folders sit in the shared scratch folder; reading them back with
    ``read_bands`` restores ``path_idx`` from the order of the paths.
    """
    def build():
        from gridseries.session import new_output_path

        root = new_output_path(spark, "emb-inputs")
        emb_bands(spark, sf_dir).drop("label").write.partitionBy("path_idx").parquet(root)
        n = table(spark, sf_dir, "embeddings").agg(F.max("vec_id").alias("m")).first()["m"]
        n_inputs = int(n) // EMB_BANDS_PER_INPUT + 1 if n is not None else 0
        return [f"{root}/path_idx={i}" for i in range(n_inputs)]

    return session_cached(spark, ("emb_inputs", sf_dir), build)


def emb_mixed_paths(spark: SparkSession, sf_dir: str) -> list[str]:
    """F-EMB's inputs at different depths, some inside the folder of another one: input i lies i % 3 folders below input i - i % 3."""
    def build():
        from gridseries.session import new_output_path

        root = new_output_path(spark, "emb-mixed")
        plain = emb_input_paths(spark, sf_dir)
        paths = [root + f"/in{i - i % 3}" + "/deeper" * (i % 3) for i in range(len(plain))]
        for path, source in zip(paths, plain):
            spark.read.parquet(source).coalesce(1).write.parquet(path)
        return paths

    return session_cached(spark, ("emb_mixed", sf_dir), build)


def emb_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-EMB as a band table with a stored, sorted ``time_id`` (``index_bands``), written once per session."""
    def build():
        from gridseries.session import new_output_path
        from gridseries.sources.ingest import index_bands

        return spark.read.parquet(index_bands(emb_bands(spark, sf_dir), new_output_path(spark, "emb-indexed"), 8))

    return session_cached(spark, ("emb_indexed", sf_dir), build)


def emb_window_series(spark: SparkSession, sf_dir: str, start: int, end: int) -> DataFrame:
    """F-EMB's series in a time window, from the indexed band table: the window reaches the scan."""
    bands = filter_time(emb_indexed(spark, sf_dir), start, end)
    return tile_bands(bands, EMB_LAYOUT, EMB_COLS, keep=("time_id", "label"))


def region_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping time windows, one per region: ``window_id, start, end`` (the last one is open at its end)."""
    r = table(spark, sf_dir, "region")
    key = F.col("r_regionkey").cast("int")
    return r.select(key.alias("window_id"), (key * 45 + 30).alias("start"), F.when(key < 4, key * 45 + 110).alias("end"))


def ship_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-SHIP's grid in long form with one record per line item: ``time_id, tile_id, pos, v`` (discounted price)."""
    li = table(spark, sf_dir, "lineitem")
    tile, pos = cell_to_tile(F.col("l_suppkey") % SHIP_ROWS, F.col("l_partkey") % SHIP_COLS, SHIP_LAYOUT)
    return li.select(time_id("l_shipdate").alias("time_id"), tile.alias("tile_id"), pos.alias("pos"),
                     (F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).alias("v"))


def emb_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-EMB in array form: ``time_id, label, tile_id, cells`` (one row per tile and step)."""
    def build():
        b = emb_bands(spark, sf_dir).withColumn("time_id", band_time("metadata"))
        return tile_bands(b, EMB_LAYOUT, EMB_COLS, keep=("time_id", "label"))

    return session_cached(spark, ("emb_series", sf_dir), build)


def ship_series(spark: SparkSession, sf_dir: str, window: tuple | None = None) -> DataFrame:
    """F-SHIP in long form: ``time_id, tile_id, pos, v`` (summed quantity per cell and day).

    A ``window`` (start, end) is applied on ``l_shipdate`` before the
    aggregation, so it reaches the Parquet scan.
    """
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    if window is not None:
        li = filter_time_ts(li, "l_shipdate", *window)
    r = F.col("l_suppkey") % SHIP_ROWS
    c = F.col("l_partkey") % SHIP_COLS
    tile, pos = cell_to_tile(r, c, SHIP_LAYOUT)
    cells = li.select(time_id("l_shipdate").alias("time_id"), tile.alias("tile_id"), pos.alias("pos"),
                      F.col("l_quantity").alias("q"))
    return cells.groupBy("time_id", "tile_id", "pos").agg(F.sum("q").alias("v"))


def ship_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct time ids of F-SHIP, straight from the ship dates (no cell aggregation)."""
    return table(spark, sf_dir, "lineitem").select(time_id("l_shipdate").alias("time_id")).distinct()


def emb_strips(spark: SparkSession, sf_dir: str, height: int = 3) -> DataFrame:
    """F-EMB delivered as row strips of ``height`` rows (the last one lower)."""
    b = emb_bands(spark, sf_dir)
    rows = b.withColumn("row0", F.explode(F.sequence(F.lit(0), F.col("rows") - 1, F.lit(height))))
    return rows.withColumn("cells", F.slice("cells", F.col("row0") * EMB_COLS + 1,
                                            F.least(F.lit(height), F.col("rows") - F.col("row0")) * EMB_COLS))


def events_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-EVT: events with their time id."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", "ts", time_id("ts").alias("time_id"), "event_type", "value")
