"""Every operator as a query over the driver's tables, with an equivalent SQL oracle.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
input tables; where a time window is the feature, the name says so (``filter_time``,
``prune_parts``, ``series_by_part`` and the ``_window`` forms).  Catalog queries ingest F-EMB into a fresh catalog below the
session's shared folder (``spark.checkpoint.dir``) once per session and input.
Float sums are rounded to 6 places on both sides (summation order differs), but for
the ``exact`` forms, which are compared as they are.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseries.functions.bandmeta import band_entries, band_time
from gridseries.functions.timeid import range_length, time_date, time_id
from gridseries.operators import aggregate as agg
from gridseries.operators import filters as flt
from gridseries.operators.parts import attach_parts, locate_parts, part_ranges, split_points, splits_array, time_parts
from gridseries.operators.tiling import check_layout, tile_extents_of, tile_strips
from gridseries.plans import fixtures as fx
from gridseries.sources import catalog as cat
from gridseries.sources import metadata as md
from gridseries.sources.bands import check_extents, infer_grid, read_bands, time_bounds
from gridseries.sources.ingest import ingest, timed_bands
from gridseries.session import new_output_path, path_exists, shared_dir

R6 = 6
_lock = threading.Lock()
_catalogs: dict = {}


def emb_catalog(spark: SparkSession, sf_dir: str) -> cat.Catalog:
    """F-EMB ingested once per session and input (k = 64 steps per part), opened once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    with _lock:
        handle = _catalogs.get(key)
        if handle is None or not path_exists(spark, f"{handle.path}/metadata.json"):
            path = new_output_path(spark, "emb-catalog")
            handle = ingest(fx.emb_bands(spark, sf_dir), path, fx.EMB_LAYOUT.tile_cols, fx.EMB_LAYOUT.tile_rows,
                            k=fx.EMB_K)
            _catalogs[key] = handle
    return handle


def _long(series: DataFrame, *keys) -> DataFrame:
    return agg.to_long(series, keys)


def _r(c) -> F.Column:
    return F.round(c, R6)


# --- sources and ingest checks -------------------------------------------------

def q_read_bands(spark, d):
    b = read_bands(spark, fx.emb_input_paths(spark, d))
    return b.select("path_idx", "band", F.size("metadata").alias("n_meta"), F.size("cells").alias("n_cells"),
                    "cell_type", _r(F.aggregate("cells", F.lit(0.0), lambda a, c: a + c.cast("double"))).alias("cells_sum"))


def q_read_bands_mixed(spark, d):
    """The same inputs at different depths, some nested: one scan, the deepest input wins."""
    b = read_bands(spark, fx.emb_mixed_paths(spark, d))
    return b.select("path_idx", "band", F.size("cells").alias("n_cells"),
                    _r(F.aggregate("cells", F.lit(0.0), lambda a, c: a + c.cast("double"))).alias("cells_sum"))


def q_band_metadata(spark, d):
    b = fx.emb_bands(spark, d)
    return b.select("path_idx", "band", F.inline(band_entries("metadata"))) \
        .select("path_idx", "band", F.col("k").alias("meta_key"), F.col("v").alias("meta_value"))


def q_band_time(spark, d):
    return fx.emb_bands(spark, d).select("path_idx", "band", band_time("metadata").alias("time_id"))


def q_infer_grid(spark, d):
    g = infer_grid(fx.emb_bands(spark, d))
    return g.select("xmin", "ymin", "xmax", "ymax", F.col("cols").alias("raster_cols"),
                    F.col("rows").alias("raster_rows"), "cell_type")


def q_check_extents(spark, d):
    return check_extents(fx.emb_bands(spark, d))


def q_check_extents_deviating(spark, d):
    """Inputs with a band of another width are reported."""
    b = fx.emb_bands(spark, d)
    other = F.col("xmax") + F.when((F.col("path_idx") * fx.EMB_BANDS_PER_INPUT + F.col("band")) % 400 == 0, 1.0).otherwise(0.0)
    return check_extents(b.withColumn("xmax", other))


def q_check_layout(spark, d):
    return check_layout(infer_grid(fx.emb_bands(spark, d)), fx.EMB_LAYOUT.tile_cols, fx.EMB_LAYOUT.tile_rows)


def q_tile_bands(spark, d):
    return _long(fx.emb_series(spark, d)).select("tile_id", "time_id", "pos", "v")


def q_tile_strips(spark, d):
    strips = timed_bands(fx.emb_strips(spark, d))
    tiles = tile_strips(strips, fx.EMB_LAYOUT, fx.EMB_COLS, keep=("path_idx", "band", "time_id"))
    return _long(tiles).select("tile_id", "time_id", "pos", "v")


def q_tile_extents(spark, d):
    return tile_extents_of(infer_grid(fx.emb_bands(spark, d)), fx.EMB_LAYOUT)


def q_time_bounds(spark, d):
    return time_bounds(timed_bands(fx.emb_bands(spark, d)))


# --- catalog -------------------------------------------------------------------

def _catalog_summary(series: DataFrame) -> DataFrame:
    """Per (tile, part): records, time range and cell total, aggregated per record (no explode)."""
    rec_sum = F.aggregate("cells", F.lit(0.0), lambda a, c: a + c.cast("double"))
    return series.groupBy("tile_id", "part").agg(
        F.count(F.lit(1)).alias("n_records"), F.min("time_id").alias("min_time"),
        F.max("time_id").alias("max_time"), _r(F.sum(rec_sum)).alias("sum_v"))


def q_write_catalog(spark, d):
    path = new_output_path(spark, "emb-write")
    bands = read_bands(spark, fx.emb_input_paths(spark, d))
    c = ingest(bands, path, fx.EMB_LAYOUT.tile_cols, fx.EMB_LAYOUT.tile_rows, k=fx.EMB_K)
    return _catalog_summary(c.series)


def q_tile_strips_catalog(spark, d):
    """Row strips through a whole ingest: sorted assembly in the writer tasks."""
    path = new_output_path(spark, "emb-strips")
    c = ingest(fx.emb_strips(spark, d).drop("label"), path, fx.EMB_LAYOUT.tile_cols, fx.EMB_LAYOUT.tile_rows, k=fx.EMB_K)
    return _catalog_summary(c.series)


def q_write_catalog_replaced(spark, d):
    """A catalog replaced by a series derived from itself: every other step, later by 1,000, in other parts."""
    path = new_output_path(spark, "emb-replace")
    c = ingest(fx.emb_bands(spark, d), path, fx.EMB_LAYOUT.tile_cols, fx.EMB_LAYOUT.tile_rows, k=fx.EMB_LARGE_K * 2)
    half = c.filter(F.col("time_id") % 2 == 0).map_tiles({"time_id": F.col("time_id") + 1000})
    return _catalog_summary(half.write(path, "overwrite", k=fx.EMB_LARGE_K).series)


def _meta_columns(m: str = "metadata"):
    return [F.col(f"{m}.timeCount").alias("time_count"),
            F.array_join(F.col(f"{m}.splits"), ",").alias("splits"),
            *[F.col(f"{m}.extent.{k}").alias(k) for k in md.EXTENT_KEYS],
            F.col(f"{m}.tileLayout.tileCols").alias("tile_cols"), F.col(f"{m}.tileLayout.tileRows").alias("tile_rows"),
            F.col(f"{m}.tileLayout.pixelCols").alias("pixel_cols"), F.col(f"{m}.tileLayout.pixelRows").alias("pixel_rows"),
            F.col(f"{m}.cellType").alias("cell_type")]


def q_write_metadata(spark, d):
    c = emb_catalog(spark, d)
    return spark.read.text(f"{c.path}/metadata.json")


def q_read_metadata(spark, d):
    c = emb_catalog(spark, d)
    return md.read_metadata(spark, c.path).select(*_meta_columns())


def q_extent_json(spark, d):
    e = fx.table(spark, d, "embeddings")
    per = fx.EMB_BANDS_PER_INPUT
    j = e.select(F.floor(F.col("vec_id") / per).cast("int").alias("path_idx"), (F.col("vec_id") % per + 1).cast("int").alias("band"),
                 md.extent_to_json(md.extent_struct(F.col("vec_id") * 0.5 - 180, F.col("label") * 0.25 - 90,
                                                    F.col("vec_id") * 0.5, F.col("label") + 0.75)).alias("extent_json"))
    return j.select("path_idx", "band", "extent_json", md.extent_from_json("extent_json").alias("e")) \
        .select("path_idx", "band", "extent_json", *[F.col(f"e.{k}").alias(k) for k in md.EXTENT_KEYS])


def q_layout_json(spark, d):
    lay = q_check_layout(spark, d)
    j = lay.select(md.layout_to_json(md.layout_struct("tile_cols", "tile_rows", "pixel_cols", "pixel_rows"))
                   .alias("layout_json"))
    return j.select("layout_json", md.layout_from_json("layout_json").alias("t")).select(
        "layout_json", F.col("t.tileCols").alias("tile_cols"), F.col("t.tileRows").alias("tile_rows"),
        F.col("t.pixelCols").alias("pixel_cols"), F.col("t.pixelRows").alias("pixel_rows"))


def _emb_metadata_frame(spark, d, k: int) -> DataFrame:
    """The metadata record with k steps per part, computed from F-EMB in Spark (no catalog involved)."""
    timed = timed_bands(fx.emb_bands(spark, d))
    splits = split_points(timed, k).agg(F.array_sort(F.collect_list("split")).alias("splits"))
    g = infer_grid(fx.emb_bands(spark, d))
    n = timed.agg(F.count(F.lit(1)).alias("n"))
    lay = q_check_layout(spark, d)
    return g.select(F.lit(k).alias("k"), md.metadata_struct(
        n.scalar(), splits.scalar(), md.extent_struct("xmin", "ymin", "xmax", "ymax"),
        lay.select(md.layout_struct("tile_cols", "tile_rows", "pixel_cols", "pixel_rows")).scalar(),
        F.lit(4)).alias("metadata"))


def q_metadata_equal(spark, d):
    """The stored record against records computed with three part sizes: one is equal, two differ in the splits alone."""
    c = emb_catalog(spark, d)
    stored = md.read_metadata(spark, c.path).select(F.col("metadata").alias("stored"))
    computed = [_emb_metadata_frame(spark, d, k) for k in (fx.EMB_K // 2, fx.EMB_K, fx.EMB_K * 2)]
    rows = computed[0].unionByName(computed[1]).unionByName(computed[2])
    return rows.select("k", md.metadata_equal("metadata", stored.scalar()).alias("equal"))


def q_open_catalog(spark, d):
    c = emb_catalog(spark, d)
    return _long(c.series, "part").select("tile_id", "part", "time_id", "pos", "v")


def q_scan_tile(spark, d):
    c = emb_catalog(spark, d)
    return _long(cat.scan_tile(c, 0), "part").select("part", "time_id", "pos", "v")


def q_to_records(spark, d):
    c = emb_catalog(spark, d)
    derived = flt.map_cells(c.series, lambda v: v.cast("double") * F.lit(0.5))
    back = cat.Catalog(c.path, c.meta, cat.to_records(derived)).write(new_output_path(spark, "emb-derived"))
    return _catalog_summary(back.series)


# --- filters and maps -------------------------------------------------------------

def q_filter_time(spark, d):
    c = emb_catalog(spark, d)
    return _long(flt.filter_time(c.series, *fx.EMB_WINDOW)).select("tile_id", "time_id", "pos", "v")


def q_prune_parts(spark, d):
    c = emb_catalog(spark, d)
    return _long(c.window(*fx.EMB_WINDOW)).select("tile_id", "time_id", "pos", "v")


def q_filter_time_bands(spark, d):
    """A window on the indexed band table itself."""
    b = flt.filter_time(fx.emb_indexed(spark, d), *fx.EMB_WINDOW)
    return b.select(F.col("source_idx").alias("path_idx"), "band", "time_id",
                    _r(F.aggregate("cells", F.lit(0.0), lambda a, c: a + c.cast("double"))).alias("cells_sum"))


def q_prune_parts_windows(spark, d):
    """Cell sums of many windows of one table in one plan; only the parts that a window touches are read."""
    hits = emb_catalog(spark, d).windows(fx.region_windows(spark, d))
    return agg.local_add(hits, fx.EMB_LAYOUT, ["window_id"]).select("window_id", "cell_row", "cell_col", _r("sum_v").alias("sum_v"))


def q_filter_series(spark, d):
    s = fx.emb_series(spark, d)
    return flt.filter_series(s, F.exists("cells", lambda x: x > F.lit(0.25))).select("tile_id", "time_id")


def q_filter_series_python(spark, d):
    """The same predicate as an opaque Python function over batches."""
    s = fx.emb_series(spark, d)
    return flt.filter_series(s, lambda time_id, cells: cells.apply(lambda c: bool((c > 0.25).any()))).select("tile_id", "time_id")


def q_map_tiles_python(spark, d):
    """The same map as an opaque Python function over batches of records."""
    s = fx.emb_series(spark, d).withColumn("cells", F.col("cells").cast("array<double>"))

    def twice(pdf):
        return pdf.assign(time_id=pdf["time_id"] + 1, cells=pdf["cells"].apply(lambda c: c * 2))

    return _long(flt.map_tiles(s, twice)).select("tile_id", "time_id", "pos", "v")


def q_map_tiles(spark, d):
    s = fx.emb_series(spark, d)
    m = flt.map_tiles(s, {"time_id": F.col("time_id") + 1,
                          "cells": F.transform("cells", lambda x: x.cast("double") * 2)})
    return _long(m).select("tile_id", "time_id", "pos", "v")


def q_map_tiles_shifted(spark, d):
    """A catalog's time ids moved by ten days, then a window: parts are looked up anew."""
    moved = emb_catalog(spark, d).map_tiles({"time_id": F.col("time_id") + fx.EMB_SHIFT})
    return _long(moved.between(*fx.EMB_WINDOW).series, "part").select("tile_id", "part", "time_id", "pos", "v")


def q_map_tiles_shifted_written(spark, d):
    """The moved series written as a catalog with larger parts, opened again, then a window."""
    moved = emb_catalog(spark, d).map_tiles({"time_id": F.col("time_id") + fx.EMB_SHIFT})
    path = new_output_path(spark, "emb-moved")
    moved.write(path, k=fx.EMB_LARGE_K)
    return _catalog_summary(cat.open_catalog(spark, path).window(*fx.EMB_WINDOW))


def q_map_cells(spark, d):
    s = flt.map_cells(fx.emb_series(spark, d), lambda x: x.cast("double") * x.cast("double"))
    return _long(s).select("tile_id", "time_id", "pos", "v")


# --- aggregates ---------------------------------------------------------------------

def _emb_window(spark, d):
    return fx.emb_window_series(spark, d, *fx.EMB_WINDOW)


def _tile(df: DataFrame) -> DataFrame:
    return df.select("tile_id", "pos", _r("sum_v").alias("sum_v"))


def _raster(df: DataFrame, value: str = "sum_v") -> DataFrame:
    return df.select("cell_row", "cell_col", _r(value).alias(value))


def q_tile_sum(spark, d):
    return _tile(agg.tile_sum(fx.emb_series(spark, d), fx.EMB_LAYOUT))


def q_tile_sum_arrow(spark, d):
    return _tile(agg.tile_sum(fx.emb_series(spark, d), fx.EMB_LAYOUT, method="arrow"))


def q_tile_sum_window(spark, d):
    return _tile(agg.tile_sum(_emb_window(spark, d), fx.EMB_LAYOUT))


def q_tile_sum_catalog(spark, d):
    return _tile(agg.tile_sum(emb_catalog(spark, d).series, fx.EMB_LAYOUT))


def _thirds(spark, d):
    """F-EMB's cells divided by 3: doubles that use all their bits, so plain sums depend on the order."""
    return flt.map_cells(fx.emb_series(spark, d), lambda x: x.cast("double") / F.lit(3.0))


def q_tile_sum_exact(spark, d):
    """Exact sums, not rounded for the comparison."""
    return agg.tile_sum(_thirds(spark, d), fx.EMB_LAYOUT, method="explode", exact=True)


def q_tile_sum_exact_arrow(spark, d):
    return agg.tile_sum(_thirds(spark, d), fx.EMB_LAYOUT, method="arrow", exact=True)


def q_mosaic_sum_ship_exact(spark, d):
    """Exact sums of discounted prices per cell, line item by line item, not rounded for the comparison."""
    return agg.mosaic_sum(fx.ship_prices(spark, d), fx.SHIP_LAYOUT, exact=True)


def q_mosaic_sum(spark, d):
    return _raster(agg.mosaic_sum(fx.emb_series(spark, d), fx.EMB_LAYOUT))


def q_mosaic_sum_arrow(spark, d):
    return _raster(agg.mosaic_sum(fx.emb_series(spark, d), fx.EMB_LAYOUT, method="arrow"))


def q_mosaic_sum_window(spark, d):
    return _raster(agg.mosaic_sum(_emb_window(spark, d), fx.EMB_LAYOUT))


def q_mosaic_sum_wide(spark, d):
    """One tile of 4,096 cells per step (an embedding row repeated 64-fold): its sum spreads over blocks of positions."""
    b = fx.emb_bands(spark, d)
    wide = b.select(band_time("metadata").alias("time_id"), F.lit(0).alias("tile_id"),
                    F.flatten(F.array_repeat("cells", 64)).alias("cells"))
    return _raster(agg.mosaic_sum(wide, fx.WIDE_LAYOUT))


def q_mosaic_sum_catalog(spark, d):
    return _raster(emb_catalog(spark, d).sum())


def q_mosaic_sum_catalog_window(spark, d):
    return _raster(emb_catalog(spark, d).between(*fx.EMB_WINDOW).sum())


def q_mosaic_sum_ship(spark, d):
    return _raster(agg.mosaic_sum(fx.ship_series(spark, d), fx.SHIP_LAYOUT))


def q_mosaic_sum_ship_window(spark, d):
    s = fx.ship_series(spark, d, window=fx.SHIP_WINDOW)
    return _raster(agg.mosaic_sum(s, fx.SHIP_LAYOUT))


def q_time_count(spark, d):
    """Counted on the bands: every band has one record of the first tile."""
    bands = fx.emb_bands(spark, d).select(F.lit(0).alias("tile_id"), band_time("metadata").alias("time_id"))
    return agg.time_count(bands, distinct=False)


def q_time_count_window(spark, d):
    bands = fx.emb_indexed(spark, d).select(F.lit(0).alias("tile_id"), "time_id")
    return agg.time_count(flt.filter_time(bands, *fx.EMB_WINDOW), distinct=False)


def q_mosaic_mean(spark, d):
    return _raster(agg.mosaic_mean(fx.emb_series(spark, d), fx.EMB_LAYOUT), "mean_v")


def q_mosaic_mean_arrow(spark, d):
    return _raster(agg.mosaic_mean(fx.emb_series(spark, d), fx.EMB_LAYOUT, method="arrow"), "mean_v")


def q_mosaic_mean_window(spark, d):
    return _raster(agg.mosaic_mean(_emb_window(spark, d), fx.EMB_LAYOUT), "mean_v")


def q_mosaic_mean_catalog(spark, d):
    return _raster(emb_catalog(spark, d).mean(), "mean_v")


def q_mosaic_mean_catalog_window(spark, d):
    return _raster(emb_catalog(spark, d).between(*fx.EMB_WINDOW).mean(), "mean_v")


def q_mosaic_mean_ship(spark, d):
    days = fx.ship_days(spark, d).agg(F.count(F.lit(1)).alias("time_count"))
    return _raster(agg.mosaic_mean(fx.ship_series(spark, d), fx.SHIP_LAYOUT, count=days), "mean_v")


def q_min_max(spark, d):
    m = agg.mosaic_mean(fx.emb_series(spark, d), fx.EMB_LAYOUT)
    return agg.min_max(m, "mean_v").select(_r("min_v").alias("min_v"), _r("max_v").alias("max_v"))


def q_min_max_sum(spark, d):
    m = emb_catalog(spark, d).min_max(of="sum")
    return m.select(_r("min_v").alias("min_v"), _r("max_v").alias("max_v"))


def q_local_add(spark, d):
    return agg.local_add(fx.emb_series(spark, d), fx.EMB_LAYOUT, ["label"]) \
        .select("label", "cell_row", "cell_col", _r("sum_v").alias("sum_v"))


def q_local_add_arrow(spark, d):
    return agg.local_add(fx.emb_series(spark, d), fx.EMB_LAYOUT, ["label"], method="arrow") \
        .select("label", "cell_row", "cell_col", _r("sum_v").alias("sum_v"))


# --- time parts -------------------------------------------------------------------------

def q_split_points(spark, d):
    return split_points(timed_bands(fx.emb_bands(spark, d)), fx.EMB_K)


def q_split_points_ship(spark, d):
    return split_points(fx.ship_days(spark, d), fx.SHIP_K)


def q_assign_part(spark, d):
    """Every record's part by a join with the parts of the distinct days."""
    parts = time_parts(fx.ship_days(spark, d), fx.SHIP_K)
    p = attach_parts(fx.ship_series(spark, d), parts)
    return p.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.min("time_id").alias("min_time"),
                                 F.max("time_id").alias("max_time"))


def q_assign_part_orders(spark, d):
    """Parts of time ids that the splits were not made from: order days among the parts of the ship days."""
    splits = splits_array(split_points(fx.ship_days(spark, d), fx.SHIP_K))
    days = fx.table(spark, d, "orders").select(time_id("o_orderdate").alias("time_id"))
    return locate_parts(days, splits).groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.min("time_id").alias("min_time"),
                                                          F.max("time_id").alias("max_time"))


def q_part_ranges(spark, d):
    return part_ranges(split_points(timed_bands(fx.emb_bands(spark, d)), fx.EMB_K))


def q_series_by_part(spark, d):
    c = emb_catalog(spark, d)
    return cat.part_summary(cat.series_by_part(c, 0, *fx.EMB_WINDOW))


def q_cache_series(spark, d):
    """Two queries over the kept series; the result is checkpointed and the memory given back."""
    shared_dir(spark)
    cached = emb_catalog(spark, d).cache()
    cached.series.agg(F.count(F.lit(1))).first()
    out = cached.series.groupBy("tile_id", "part").agg(F.count(F.lit(1)).alias("n_records")).checkpoint()
    cached.uncache()
    return out


# --- time functions -------------------------------------------------------------------------

def q_time_id(spark, d):
    return fx.events_timed(spark, d).select("event_id", "time_id")


def q_time_id_ship(spark, d):
    li = fx.table(spark, d, "lineitem").select("l_shipdate").distinct()
    return li.select("l_shipdate", time_id("l_shipdate").alias("time_id"))


def q_time_date(spark, d):
    t = timed_bands(fx.emb_bands(spark, d))
    return t.select("time_id", time_date("time_id").alias("time_date"))


def q_range_length(spark, d):
    c = emb_catalog(spark, d)
    s = cat.part_summary(c.series)
    return s.select("part", F.col("min_time").alias("start_time"), F.col("max_time").alias("end_time"),
                    range_length("min_time", "max_time").alias("range_length"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "read_bands": q_read_bands,
    "read_bands_mixed": q_read_bands_mixed,
    "band_metadata": q_band_metadata,
    "band_time": q_band_time,
    "infer_grid": q_infer_grid,
    "check_extents": q_check_extents,
    "check_extents_deviating": q_check_extents_deviating,
    "check_layout": q_check_layout,
    "tile_bands": q_tile_bands,
    "tile_strips": q_tile_strips,
    "tile_strips_catalog": q_tile_strips_catalog,
    "tile_extents": q_tile_extents,
    "time_bounds": q_time_bounds,
    "write_catalog": q_write_catalog,
    "write_catalog_replaced": q_write_catalog_replaced,
    "write_metadata": q_write_metadata,
    "read_metadata": q_read_metadata,
    "extent_json": q_extent_json,
    "layout_json": q_layout_json,
    "metadata_equal": q_metadata_equal,
    "open_catalog": q_open_catalog,
    "scan_tile": q_scan_tile,
    "to_records": q_to_records,
    "filter_time": q_filter_time,
    "prune_parts": q_prune_parts,
    "prune_parts_windows": q_prune_parts_windows,
    "filter_time_bands": q_filter_time_bands,
    "filter_series": q_filter_series,
    "filter_series_python": q_filter_series_python,
    "map_tiles_python": q_map_tiles_python,
    "map_tiles": q_map_tiles,
    "map_tiles_shifted": q_map_tiles_shifted,
    "map_tiles_shifted_written": q_map_tiles_shifted_written,
    "map_cells": q_map_cells,
    "tile_sum": q_tile_sum,
    "tile_sum_arrow": q_tile_sum_arrow,
    "tile_sum_window": q_tile_sum_window,
    "tile_sum_catalog": q_tile_sum_catalog,
    "tile_sum_exact": q_tile_sum_exact,
    "tile_sum_exact_arrow": q_tile_sum_exact_arrow,
    "mosaic_sum": q_mosaic_sum,
    "mosaic_sum_arrow": q_mosaic_sum_arrow,
    "mosaic_sum_window": q_mosaic_sum_window,
    "mosaic_sum_wide": q_mosaic_sum_wide,
    "mosaic_sum_catalog": q_mosaic_sum_catalog,
    "mosaic_sum_catalog_window": q_mosaic_sum_catalog_window,
    "mosaic_sum_ship": q_mosaic_sum_ship,
    "mosaic_sum_ship_window": q_mosaic_sum_ship_window,
    "mosaic_sum_ship_exact": q_mosaic_sum_ship_exact,
    "time_count": q_time_count,
    "time_count_window": q_time_count_window,
    "mosaic_mean": q_mosaic_mean,
    "mosaic_mean_arrow": q_mosaic_mean_arrow,
    "mosaic_mean_window": q_mosaic_mean_window,
    "mosaic_mean_catalog": q_mosaic_mean_catalog,
    "mosaic_mean_catalog_window": q_mosaic_mean_catalog_window,
    "mosaic_mean_ship": q_mosaic_mean_ship,
    "min_max": q_min_max,
    "min_max_sum": q_min_max_sum,
    "local_add": q_local_add,
    "local_add_arrow": q_local_add_arrow,
    "split_points": q_split_points,
    "split_points_ship": q_split_points_ship,
    "assign_part": q_assign_part,
    "assign_part_orders": q_assign_part_orders,
    "part_ranges": q_part_ranges,
    "series_by_part": q_series_by_part,
    "cache_series": q_cache_series,
    "time_id": q_time_id,
    "time_id_ship": q_time_id_ship,
    "time_date": q_time_date,
    "range_length": q_range_length,
}
