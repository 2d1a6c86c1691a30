import pytest
from pyspark.sql import functions as F

from gridseries.model import Extent, TileLayout
from gridseries.operators.aggregate import to_long
from gridseries.operators.tiling import (cell_to_tile, check_layout, tile_bands, tile_bands_long,
                                         tile_extents, tile_to_cell)

LAYOUT = TileLayout(4, 2, 2, 4)  # 8 x 8 raster, tiles 2 cols x 4 rows


def _raster(spark, n_steps=3):
    # cell value encodes (step, idx) so every cell is traceable
    return spark.range(n_steps).select(
        F.col("id").cast("int").alias("time_id"),
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (F.col("id") * 1000 + i).cast("double")).alias("cells"))


def test_array_and_long_forms_agree(spark):
    bands = _raster(spark)
    a = to_long(tile_bands(bands, LAYOUT, 8)).select("time_id", "tile_id", "pos", "v")
    b = tile_bands_long(bands, LAYOUT).select("time_id", "tile_id", "pos", "v")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert a.count() == 3 * 64


def test_tiles_are_two_cols_by_four_rows(spark):
    bands = _raster(spark, 1)
    tiles = {r["tile_id"]: r["cells"] for r in tile_bands(bands, LAYOUT, 8).collect()}
    assert len(tiles) == 8
    # tile 0: rows 0..3, cols 0..1 of the 8-col raster
    assert tiles[0] == [0.0, 1.0, 8.0, 9.0, 16.0, 17.0, 24.0, 25.0]
    # tile 5: tile row 1, tile col 1 -> rows 4..7, cols 2..3
    assert tiles[5] == [34.0, 35.0, 42.0, 43.0, 50.0, 51.0, 58.0, 59.0]


def test_every_cell_in_exactly_one_tile(spark):
    cells = spark.range(64).select((F.col("id") / 8).cast("int").alias("r"), (F.col("id") % 8).cast("int").alias("c"))
    t, p = cell_to_tile("r", "c", LAYOUT)
    mapped = cells.select("r", "c", t.alias("t"), p.alias("p"))
    assert mapped.select("t", "p").distinct().count() == 64
    r2, c2 = tile_to_cell("t", "p", LAYOUT)
    assert mapped.filter((r2 != F.col("r")) | (c2 != F.col("c"))).count() == 0


def test_bad_layout_errors(spark):
    grid = spark.createDataFrame([(720, 360)], "cols int, rows int")
    with pytest.raises(Exception, match="equal tiles"):
        check_layout(grid, 7, 2).collect()
    ok = check_layout(grid, 4, 2).first()
    assert tuple(ok) == (4, 2, 180, 180)
    with pytest.raises(ValueError):
        TileLayout.for_raster(720, 360, 7, 2)


def test_wrong_band_size_errors(spark):
    bands = spark.range(1).select(F.lit(0).alias("time_id"), F.array(F.lit(1.0)).alias("cells"))
    with pytest.raises(Exception):
        tile_bands(bands, LAYOUT, 8).collect()


def test_tile_extents_row_zero_on_top(spark):
    ext = {r["tile_id"]: r for r in tile_extents(spark, Extent(-180.0, -90.0, 180.0, 90.0), LAYOUT).collect()}
    assert (ext[0]["xmin"], ext[0]["ymin"], ext[0]["xmax"], ext[0]["ymax"]) == (-180.0, 0.0, -90.0, 90.0)
    assert (ext[7]["xmin"], ext[7]["ymin"], ext[7]["xmax"], ext[7]["ymax"]) == (90.0, -90.0, 180.0, 0.0)


@pytest.mark.parametrize("height", [1, 3, 4, 8])
def test_strips_give_the_same_tiles(spark, height):
    from gridseries.operators.tiling import tile_strips

    bands = _raster(spark, 4)
    starts = list(range(0, 8, height))
    strips = bands.select("time_id", F.explode(F.array(*[F.lit(s) for s in starts])).alias("row0"), "cells") \
        .select("time_id", "row0", F.slice("cells", F.col("row0") * 8 + 1,
                                            F.least(F.lit(height), 8 - F.col("row0")) * 8).alias("cells"))
    a = tile_strips(strips, LAYOUT, 8).select("time_id", "tile_id", "cells")
    b = tile_bands(bands, LAYOUT, 8).select("time_id", "tile_id", "cells")
    assert a.count() == b.count() == 32
    assert a.exceptAll(b).count() == 0


def test_strips_missing_rows_error(spark):
    from gridseries.operators.tiling import tile_strips

    strips = _raster(spark, 1).select("time_id", F.lit(0).alias("row0"), F.slice("cells", 1, 24).alias("cells"))
    with pytest.raises(Exception, match="cover"):
        tile_strips(strips, LAYOUT, 8).collect()


def test_strips_with_a_gap_or_overlap_error(spark):
    from gridseries.operators.tiling import tile_strips

    one = _raster(spark, 1).select("time_id", "cells")
    for rows in ([0, 1, 1, 3, 4, 5, 6, 7], [0, 1, 2, 2, 4, 5, 6, 7]):
        strips = one.select("time_id", F.explode(F.array(*[F.lit(r) for r in rows])).alias("row0"), "cells") \
            .withColumn("cells", F.slice("cells", F.col("row0") * 8 + 1, 8))
        with pytest.raises(Exception, match="strips do not cover the tile exactly"):
            tile_strips(strips, LAYOUT, 8).collect()
