"""Catalogs of many small parts: parts share folders, files follow the bytes, and every read finds the same records."""

import pytest
from pyspark.sql import functions as F

from gridseries.operators.filters import filter_time
from gridseries.plans import fixtures as fx
from gridseries.sources import catalog as cat
from gridseries.sources.ingest import ingest
from tests.conftest import SF001


@pytest.fixture(scope="module")
def bands(spark):
    return fx.emb_bands(spark, SF001).drop("label")


@pytest.fixture(scope="module")
def small_parts(spark, bands):
    from gridseries.session import new_output_path

    return ingest(bands, new_output_path(spark, "test-folders"), 4, 2, k=1)  # 500 parts of 8 tiles


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b).count() == 0


def test_parts_per_folder():
    mb = 1 << 20
    assert cat.parts_per_folder(8, 64, 1000) == 1  # as many folders as may be small
    assert cat.parts_per_folder(8, 65, 1000) == 2
    assert cat.parts_per_folder(8, 234375, 3840 * mb) == 3663  # 8 x 64 folders
    assert cat.parts_per_folder(8, 1000, 8000 * 40 * mb) == 3  # parts of 40 MB: a block
    assert cat.parts_per_folder(8, 1000, 8000 * 500 * mb) == 1
    assert cat.parts_per_folder(5000, 4, 1000) == 4 and cat.parts_per_folder(8, 1, 0) == 1


def test_moved_series_written_with_small_parts(spark, small_parts, out_dir):
    moved = small_parts.map_tiles({"time_id": F.col("time_id") + 10})
    moved.write(out_dir, k=2)  # 250 parts of 8 tiles
    back = cat.open_catalog(spark, out_dir)
    assert back.meta.splits == tuple(range(11, 510, 2)) and len(back.series.inputFiles()) <= cat.MOST_FOLDERS
    want = moved.series.withColumn("part", F.floor((F.col("time_id") - 10) / 2).cast("int"))
    assert same(back.series, want) and same(back.window(100, 200), filter_time(want, 100, 200))
    assert "Join" not in _write_plan(spark, moved, out_dir)


def _write_plan(spark, moved, out_dir):
    """Join names of the write's plan that need a shuffle."""
    plans, real = [], cat.write_catalog

    def seen(series, *a, **b):
        plans.append(series._jdf.queryExecution().executedPlan().toString())
        return real(series, *a, **b)

    cat.write_catalog = seen
    try:
        moved.write(f"{out_dir}-again", k=2)
    finally:
        cat.write_catalog = real
    return plans[0].replace("BroadcastHashJoin", "").replace("SortMergeJoin", "Join")


def test_records_without_a_time_have_no_part(spark, small_parts, out_dir):
    holes = small_parts.map_tiles({"time_id": F.when(F.col("time_id") % 2 == 0, F.col("time_id"))})
    back = holes.write(out_dir, k=1)
    assert back.series.count() == 250 * 8 and back.meta.n_parts == 251 and back.window(10, 19).count() == 5 * 8


def test_small_parts_share_folders(spark, bands, small_parts, out_dir):
    wide = ingest(bands, out_dir, 4, 2, k=64)
    again = cat.open_catalog(spark, small_parts.path)
    assert again.per_folder() == 8 and len(again.series.inputFiles()) == 63 * 8 <= cat.MOST_FOLDERS
    assert again.occupied() == [[0, 7, 0, 62]] and again.meta.n_parts == 501
    assert again.series.columns == wide.series.columns and same(again.series, wide.series.withColumn("part", F.col("time_id")))
    fresh = cat.open_catalog(spark, small_parts.path)
    window = fresh.window(100, 200)
    assert fresh._series is None and len(window.inputFiles()) == 14 * 8  # folders 12 to 25
    assert same(window, filter_time(again.series, 100, 200)) and window.select("part").distinct().count() == 101
    assert len(fresh.tile(3).inputFiles()) == 63 and fresh.tile(3).count() == 500 and fresh.window(600, 700).count() == 0
    assert same(fx.emb_strips(spark, SF001).drop("label").transform(lambda s: ingest(s, f"{out_dir}-s", 4, 2, k=1).series), again.series)



def test_appended_steps_beside_shared_folders(spark, bands, out_dir):
    from gridseries.streaming.append import append_bands_stream

    ingest(bands.filter("path_idx = 0"), out_dir, 4, 2, k=1)
    bands.filter("path_idx = 1 and band <= 20").write.parquet(f"{out_dir}-more")
    append_bands_stream(spark, f"{out_dir}-more", out_dir).awaitTermination(240)
    c = cat.open_catalog(spark, out_dir)
    assert c.per_folder() > 1 and c.series.count() == 270 * 8 and c.tile(2).count() == 270
    assert c.window(240, 259).count() == 20 * 8
    windows = spark.createDataFrame([(1, 245, 254)], "w int, start int, end int")
    assert c.windows(windows).count() == 80


def test_windows_prune_shared_folders(spark, small_parts, out_dir):
    spark.createDataFrame([(1, 70, 80), (2, 75, 210), (3, 495, None)], "w int, start int, end int").write.parquet(out_dir)
    windows = spark.read.parquet(out_dir)
    hits = small_parts.windows(windows)
    assert "dynamicpruning" in hits._jdf.queryExecution().executedPlan().toString()
    assert hits.columns == [*windows.columns, *small_parts.series.columns]
    want = small_parts.series.join(windows, F.expr("time_id >= start and time_id <= coalesce(end, 2147483647)"))
    assert same(hits, want.select(hits.columns))


def test_derived_records_written_with_small_parts(spark, small_parts, out_dir):
    half = small_parts.series.withColumn("cells", F.transform("cells", lambda v: v.cast("double") * 0.5))
    kept = half.filter((F.col("tile_id") != 3) | (F.col("time_id") < 20))
    cat.Catalog(small_parts.path, small_parts.meta, cat.to_records(kept)).write(out_dir)
    back = cat.open_catalog(spark, out_dir)
    assert back.meta.cell_type.name == "float64" and same(back.series, kept)
    assert len(back.series.inputFiles()) <= cat.MOST_FOLDERS and back.occupied() == [[0, 2, 0, 62], [3, 3, 0, 2], [4, 7, 0, 62]]
    assert same(back.window(10, 30), filter_time(kept, 10, 30))
    back.filter(F.col("time_id") < 100).write(out_dir, "overwrite")
    assert same(cat.open_catalog(spark, out_dir).series, kept.filter("time_id < 100"))
