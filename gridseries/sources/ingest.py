"""Ingest: decoded bands -> checked, tiled, time-partitioned catalog.

The bands' small columns are scanned once, into one row per time id (written to
the shared folder); grid checks, band count, split points and time parts come
from that table.  Only small results reach the driver: the first band's grid
(one row), the first inconsistent input if any (at most one row), the band count
and the split points (one int per time part).  The cells go from the band table
to the catalog files inside one Spark job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.functions.bandmeta import TIME_KEY, band_time
from gridseries.model import CellType, Extent, GridMetadata, TileLayout
from gridseries.operators.parts import assign_part_value, blocks_per_part, locate_parts, time_parts
from gridseries.operators.tiling import assemble_sorted, strip_pieces, tile_bands
from gridseries.sources.bands import band_steps, check_extents, steps_summary
from gridseries.sources.catalog import (Catalog, cluster_for_write, parts_per_folder, prepare_output, publish, write_catalog, write_occupied,
                                        writer_tasks)
from gridseries.session import guarded_reader, new_output_path, remove_path

DEFAULT_BLOCK_SIZE = 128 * 1024 * 1024


def timed_bands(bands: DataFrame, time_key: str = TIME_KEY) -> DataFrame:
    """Bands with their ``time_id``: as stored (see ``index_bands``), else taken from the band metadata."""
    if "time_id" in bands.columns:
        return bands
    return bands.withColumn("time_id", band_time("metadata", time_key))


def index_bands(bands: DataFrame, out: str, n_files: int | None = None, time_key: str = TIME_KEY) -> str:
    """Write a band table with ``time_id`` as a column, in ascending order over all files.

    A window on such a table reaches the scan (``PushedFilters``): files and row
    groups of other times are left out by their statistics, and no metadata
    string is parsed.  ``read_bands`` and ``ingest`` take it like any band table
    (``path_idx`` is kept as ``source_idx``).
    """
    timed = timed_bands(bands, time_key)
    if "path_idx" in timed.columns:
        timed = timed.withColumnRenamed("path_idx", "source_idx")
    order = [c for c in ("time_id", "source_idx", "band", "row0") if c in timed.columns]
    spread = timed.repartitionByRange(n_files, *order) if n_files else timed.repartitionByRange(*order)
    spread.sortWithinPartitions(*order).write.parquet(out)
    return out


def plan_ingest(bands: DataFrame, steps: DataFrame, tile_cols: int, tile_rows: int):
    """Grid checks from one aggregate row: (extent, cols, rows, cell_type, layout, n_bands)."""
    s = steps_summary(steps).first()
    g = s["first"]
    if g is None:
        raise ValueError("no bands to ingest")
    if s["lo"] != g or s["hi"] != g:
        bad = check_extents(bands).filter(~F.col("extent_ok")).select("path_idx").limit(1).collect()
        where = bad[0]["path_idx"] if bad else "?"
        raise ValueError(f"input {where} has another extent, size or cell type than the first input")
    layout = TileLayout.for_raster(int(g["cols"]), int(g["rows"]), tile_cols, tile_rows)
    extent = Extent(g["xmin"], g["ymin"], g["xmax"], g["ymax"])
    return extent, int(g["cols"]), int(g["rows"]), CellType(g["cell_type"]), layout, int(s["n_bands"])


def ingest(bands: DataFrame, out: str, tile_cols: int, tile_rows: int, k: int | None = None,
           block_size: int = DEFAULT_BLOCK_SIZE, mode: str = "errorifexists",
           time_key: str = TIME_KEY) -> Catalog:
    """Cut every band into ``tile_cols x tile_rows`` tiles and write the catalog.

    ``k`` time steps go into one part; by default as many as fill
    ``block_size`` bytes of one tile, one at least.  ``mode="overwrite"``
    replaces the catalog at ``out``, appended steps included, once the new one
    is complete.
    """
    spark = bands.sparkSession
    timed = timed_bands(bands, time_key)
    # One row per time id, written once to the shared folder (cuts the lineage,
    # survives executor loss) and reused for checks and split points.
    scratch = new_output_path(spark, "time-steps")
    band_steps(timed).write.parquet(f"{scratch}/steps")
    steps = spark.read.parquet(f"{scratch}/steps")
    extent, cols, rows, cell_type, layout, time_count = plan_ingest(bands, steps, tile_cols, tile_rows)
    version = prepare_output(spark, out, mode)
    strips = "row0" in bands.columns
    cell_cast = F.col("cells").cast(f"array<{cell_type.spark_type.simpleString()}>").alias("cells")
    keep = ("path_idx", "band", "time_id")
    timed = timed.select(*keep, *(["row0"] if strips else []), cell_cast)
    if k is None:
        # at least one step per part: a step larger than a block must not put the whole series into one part
        k = max(1, blocks_per_part(block_size, layout.pixel_cols, layout.pixel_rows, cell_type.bytes))
    # band rows hold whole rasters (strips: assume about a tile row high)
    with guarded_reader(spark, cols * (layout.pixel_rows if strips else rows) * cell_type.bytes):
        parts = time_parts(steps, k, materialize=False)
        splits = [int(r["time_id"]) for r in parts.filter("is_split").orderBy("time_id").collect()]
        last_part = assign_part_value(steps.agg(F.max("time_id")).first()[0], splits)
        meta = GridMetadata(time_count, tuple(splits), extent, layout, cell_type, {"version": version} if version else {})
        total_bytes = time_count * cols * rows * cell_type.bytes
        per_folder = parts_per_folder(layout.n_tiles, meta.n_parts, total_bytes)
        n_tasks = writer_tasks(spark, layout.n_tiles * -(-meta.n_parts // per_folder), total_bytes)
        record_bytes = layout.cells_per_tile * cell_type.bytes
        # once per band, before it is cut into tiles, from the split list (no shuffle of the cells);
        # a band without a time has no place in a part
        placed = locate_parts(timed.filter(F.col("time_id").isNotNull()), splits)
        if strips:
            # pieces go straight to the writer task of their (tile, part), are sorted there and
            # assembled as they come; a band is one record, also where another has its time id
            pieces = strip_pieces(placed, layout, cols, (*keep, "part"))
            dealt = cluster_for_write(pieces, n_tasks, meta.n_parts, per_folder)
            records = assemble_sorted(dealt, layout, ("tile_id", "part", "time_id", "path_idx", "band"))
            path = write_catalog(records, out, clustered=True, record_bytes=record_bytes, version=version, per_folder=per_folder)
        else:
            path = write_catalog(tile_bands(placed, layout, cols, ("time_id", "part")), out, n_tasks=n_tasks,
                                 record_bytes=record_bytes, n_parts=meta.n_parts, version=version, per_folder=per_folder)
    # every tile has every part that has a time id (the last part may have none)
    write_occupied(spark, path, [[0, layout.n_tiles - 1, 0, last_part // per_folder]], per_folder)
    catalog = publish(spark, out, meta)
    remove_path(spark, scratch)
    return catalog
