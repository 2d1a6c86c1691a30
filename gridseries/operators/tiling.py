"""Cutting rasters into a fixed tile grid and mapping cells between the two.

A raster of ``cols x rows`` cells is stored row-major.  A layout of
``tile_cols x tile_rows`` tiles, each ``pixel_cols x pixel_rows`` cells, numbers
tiles row-major (``tile_id = tile_row * tile_cols + tile_col``, row 0 at the
top) and cells inside a tile row-major (``pos``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseries.model import Extent, TileLayout


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def check_layout(grid: DataFrame, tile_cols: int, tile_rows: int) -> DataFrame:
    """One row per grid row (``cols``, ``rows``) -> the tile layout, or an error.

    Fails when the tile counts do not divide the raster size evenly.
    """
    tc, tr = F.lit(tile_cols), F.lit(tile_rows)
    ok_c = F.assert_true(F.col("cols") % tc == 0,
                         F.format_string(f"%d raster columns cannot be cut into {tile_cols} equal tiles", F.col("cols")))
    ok_r = F.assert_true(F.col("rows") % tr == 0,
                         F.format_string(f"%d raster rows cannot be cut into {tile_rows} equal tiles", F.col("rows")))
    return grid.select(
        tc.cast("int").alias("tile_cols"),
        tr.cast("int").alias("tile_rows"),
        F.when(ok_c.isNull(), F.col("cols") / tc).cast("int").alias("pixel_cols"),
        F.when(ok_r.isNull(), F.col("rows") / tr).cast("int").alias("pixel_rows"),
    )


def cell_to_tile(row, col, layout: TileLayout) -> tuple[Column, Column]:
    """Raster (row, col) -> (tile_id, pos)."""
    r, c = _col(row), _col(col)
    pr, pc = layout.pixel_rows, layout.pixel_cols
    tile = (F.floor(r / pr) * layout.tile_cols + F.floor(c / pc)).cast("int")
    pos = ((r % pr) * pc + (c % pc)).cast("int")
    return tile, pos


def tile_to_cell(tile_id, pos, layout: TileLayout) -> tuple[Column, Column]:
    """(tile_id, pos) -> raster (row, col)."""
    t, p = _col(tile_id), _col(pos)
    pr, pc = layout.pixel_rows, layout.pixel_cols
    row = (F.floor(t / layout.tile_cols) * pr + F.floor(p / pc)).cast("int")
    col = ((t % layout.tile_cols) * pc + (p % pc)).cast("int")
    return row, col


def tile_cells_expr(cells, layout: TileLayout, cols: int | None = None) -> Column:
    """ARRAY of a whole raster -> ARRAY<STRUCT<tile_id, cells>> with one entry per tile.

    One constant-size expression (higher-order functions), whatever the tile count.
    """
    cols = cols or layout.cols
    pr, pc, tcols = layout.pixel_rows, layout.pixel_cols, layout.tile_cols
    src = _col(cells)

    def one_tile(t: Column) -> Column:
        top = F.floor(t / tcols) * pr
        left = (t % tcols) * pc

        def strip(rr: Column) -> Column:
            return F.slice(src, ((top + rr) * cols + left + 1).cast("int"), F.lit(pc))

        return F.struct(t.cast("int").alias("tile_id"),
                        F.flatten(F.transform(F.sequence(F.lit(0), F.lit(pr - 1)), strip)).alias("cells"))

    return F.transform(F.sequence(F.lit(0), F.lit(layout.n_tiles - 1)), one_tile)


MOST_SLICES = 16  # more slices in one expression make code too large for the JIT


def tile_bands(bands: DataFrame, layout: TileLayout, cols: int | None = None, keep=("time_id",)) -> DataFrame:
    """Array form: one row per (band, tile) with the tile's cells row-major.

    ``bands`` holds the whole raster of a time step in ``cells``.  Output columns:
    ``keep`` + ``tile_id`` + ``cells``.  Tiles of up to ``MOST_SLICES`` rows are cut
    by plain slices, which Spark compiles; a slice inside a lambda boxes every cell
    of the band for each row of each tile.  Higher tiles keep the expression of
    constant size (``tile_cells_expr``).
    """
    size_ok = F.assert_true(F.size("cells") == F.lit(layout.cols * layout.rows),
                            F.lit(f"band does not hold {layout.cols}x{layout.rows} cells"))
    whole = F.when(size_ok.isNull(), F.col("cells"))
    if layout.pixel_rows > MOST_SLICES:
        return bands.select(*keep, F.inline(tile_cells_expr(whole, layout, cols)))
    cols, pr, pc = cols or layout.cols, layout.pixel_rows, layout.pixel_cols
    numbers = F.sequence(F.lit(0), F.lit(layout.n_tiles - 1))
    tiles = bands.select(*keep, whole.alias("cells"), F.explode(numbers).alias("tile_id"))
    col = F.col("tile_id") % layout.tile_cols
    start = F.floor(F.col("tile_id") / layout.tile_cols) * (pr * cols) + col * pc + 1
    rows = [F.slice("cells", (start + r * cols).cast("int"), F.lit(pc)) for r in range(pr)]
    return tiles.select(*keep, "tile_id", F.concat(*rows).alias("cells"))


def strip_pieces(strips: DataFrame, layout: TileLayout, cols: int | None = None, keep=("time_id",)) -> DataFrame:
    """Row strips -> one row per (strip, tile crossed): ``keep, tile_id, r, piece``.

    ``strips`` rows hold ``row0`` (first raster row of the strip, INT) and
    ``cells`` (``k x cols`` values, row-major) for any strip height ``k``;
    ``r`` is the first row of the piece inside its tile.
    """
    cols = cols or layout.cols
    pr, pc, tcols = layout.pixel_rows, layout.pixel_cols, layout.tile_cols
    src = F.col("cells")
    height = (F.size(src) / cols).cast("int")
    first_tr = F.floor(F.col("row0") / pr).cast("int")
    last_tr = F.floor((F.col("row0") + height - 1) / pr).cast("int")

    def pieces_for_tile_row(tr: Column) -> Column:
        lo = F.greatest(F.col("row0"), tr * pr)                   # first raster row inside both
        hi = F.least(F.col("row0") + height, (tr + 1) * pr)       # one past the last

        def piece(tc: Column) -> Column:
            def strip_row(r: Column) -> Column:
                return F.slice(src, ((r - F.col("row0")) * cols + tc * pc + 1).cast("int"), F.lit(pc))

            return F.struct((tr * tcols + tc).cast("int").alias("tile_id"), (lo - tr * pr).cast("int").alias("r"),
                            F.flatten(F.transform(F.sequence(lo, hi - 1), strip_row)).alias("piece"))

        return F.transform(F.sequence(F.lit(0), F.lit(tcols - 1)), piece)

    return strips.select(*keep, F.inline(F.flatten(F.transform(F.sequence(first_tr, last_tr), pieces_for_tile_row))))


def assemble_sorted(pieces: DataFrame, layout: TileLayout, by) -> DataFrame:
    """Stack the pieces of each tile into its cells, in a stream: ``by`` (which includes ``tile_id``) + ``cells``.

    All pieces of a record (equal values of ``by``) must be in one partition.
    Every partition is sorted by (``by``, first row) and read once; a record is
    complete when its rows are, so a task holds the pieces of one record besides
    its Arrow batch.  Pieces that leave a gap, overlap or do not fill the tile
    are an error.  Records come out in the order of ``by``.
    """
    by = list(by)
    cell = pieces.schema["piece"].dataType
    schema = T.StructType([*[pieces.schema[c] for c in by], T.StructField("cells", cell)])
    width, height = layout.pixel_cols, layout.pixel_rows

    def run(batches):
        import pyarrow as pa

        key, held, filled = None, [], 0

        def done():
            if filled != height:
                raise ValueError("strips do not cover the tile exactly")
            return key, pa.concat_arrays(held)

        for b in batches:
            out = []
            keys = list(zip(*[b.column(c).to_pylist() for c in by]))
            first, pieces_ = b.column("r").to_pylist(), b.column("piece")
            for i, k in enumerate(keys):
                if k != key:
                    if key is not None:
                        out.append(done())
                    key, held, filled = k, [], 0
                cells = pieces_[i].values
                rows, rest = divmod(len(cells) if cells is not None else 0, width)
                if first[i] != filled or rest or not rows:
                    raise ValueError("strips do not cover the tile exactly")
                held.append(cells)
                filled += rows
            if out:
                yield _records(out, b.schema, by)
        if key is not None:
            yield _records([done()], b.schema, by)

    rows = pieces.select(*by, "r", "piece").sortWithinPartitions(*by, "r")
    return rows.mapInArrow(run, schema)


def _records(done: list, schema, by: list[str]):
    """One Arrow batch of finished records (key, cells)."""
    import pyarrow as pa

    ends = [0]
    for _, cells in done:
        ends.append(ends[-1] + len(cells))
    columns = [pa.array([k[i] for k, _ in done], schema.field(c).type) for i, c in enumerate(by)]
    flat = pa.concat_arrays([cells for _, cells in done])
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=[*by, "cells"])


def tile_strips(strips: DataFrame, layout: TileLayout, cols: int | None = None, keep=("time_id",)) -> DataFrame:
    """Array form from rasters delivered as row strips (for rasters too big for one row).

    One shuffle, on the record (``keep``, tile), then the sorted assembly of
    ``assemble_sorted`` inside the tasks.
    """
    by = [*keep, "tile_id"]
    pieces = strip_pieces(strips, layout, cols, keep)
    return assemble_sorted(pieces.repartition(*by), layout, by)


def tile_bands_long(bands: DataFrame, layout: TileLayout, keep=("time_id",)) -> DataFrame:
    """Long form: one row per (band, cell) with ``tile_id``, ``pos`` and ``v``."""
    exploded = bands.select(*keep, F.posexplode("cells").alias("idx", "v"))
    r = F.floor(F.col("idx") / layout.cols)
    c = F.col("idx") % layout.cols
    tile, pos = cell_to_tile(r, c, layout)
    return exploded.select(*keep, tile.alias("tile_id"), pos.alias("pos"), F.col("v"))


def tile_extents(spark: SparkSession, extent: Extent, layout: TileLayout) -> DataFrame:
    """Bounds of every tile; tile row 0 is at the top (largest y)."""
    w = (extent.xmax - extent.xmin) / layout.tile_cols
    h = (extent.ymax - extent.ymin) / layout.tile_rows
    t = F.col("id")
    tc = (t % layout.tile_cols).cast("double")
    tr = F.floor(t / layout.tile_cols).cast("double")
    return spark.range(layout.n_tiles, numPartitions=1).select(
        t.cast("int").alias("tile_id"),
        (F.lit(extent.xmin) + tc * w).alias("xmin"),
        (F.lit(extent.ymax) - (tr + 1) * h).alias("ymin"),
        (F.lit(extent.xmin) + (tc + 1) * w).alias("xmax"),
        (F.lit(extent.ymax) - tr * h).alias("ymax"),
    )


def tile_extents_of(grid: DataFrame, layout: TileLayout) -> DataFrame:
    """Tile bounds computed from a grid DataFrame (``xmin..ymax`` columns).

    Tiles are generated per grid row by ``explode(sequence)``, so the work
    stays in Spark and follows the grid table.
    """
    t = F.col("tile_id")
    tc = (t % layout.tile_cols).cast("double")
    tr = F.floor(t / layout.tile_cols).cast("double")
    w = (F.col("xmax") - F.col("xmin")) / layout.tile_cols
    h = (F.col("ymax") - F.col("ymin")) / layout.tile_rows
    g = grid.select("xmin", "ymin", "xmax", "ymax",
                    F.explode(F.sequence(F.lit(0), F.lit(layout.n_tiles - 1))).alias("tile_id"))
    return g.select(
        t.cast("int").alias("tile_id"),
        (F.col("xmin") + tc * w).alias("xmin"),
        (F.col("ymax") - (tr + 1) * h).alias("ymin"),
        (F.col("xmin") + (tc + 1) * w).alias("xmax"),
        (F.col("ymax") - tr * h).alias("ymax"),
    )
