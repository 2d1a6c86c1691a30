"""Replacing catalogs, folders from the occupancy list, strips in sorted order, inputs by longest prefix, one-pass means."""

import pytest
from pyspark.sql import functions as F

from gridseries.operators import aggregate as A
from gridseries.operators.filters import filter_time
from gridseries.operators.tiling import assemble_sorted, strip_pieces, tile_strips
from gridseries.plans import fixtures as fx
from gridseries.plans import registry as R
from gridseries.session import list_names
from gridseries.sources import catalog as cat
from gridseries.sources.bands import read_bands
from gridseries.sources.ingest import index_bands, ingest, timed_bands
from tests.conftest import SF001


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def folders(spark, out):
    return sorted(n for n in list_names(spark, out) if not n.startswith("."))


def test_catalog_replaced_by_a_series_derived_from_itself(spark, out_dir):
    c = ingest(fx.emb_bands(spark, SF001), out_dir, 4, 2, k=64)
    before = {tuple(r) for r in c.tile(0).select("time_id", F.hash("cells")).collect()}
    c = c.filter(F.col("time_id") >= 250).write(out_dir, "overwrite")
    assert c.meta.time_count == 250 and c.series.count() == 250 * 8
    again = cat.open_catalog(spark, out_dir)
    assert {tuple(r) for r in again.tile(0).select("time_id", F.hash("cells")).collect()} == {x for x in before if x[0] >= 250}
    c = again.map_tiles({"time_id": F.col("time_id") - 250}).write(out_dir, "overwrite", k=10)
    assert cat.open_catalog(spark, out_dir).window(0, 9).count() == 80 and len(c.meta.splits) == 25
    assert len(folders(spark, out_dir)) == 2  # the record and one folder of cells
    with pytest.raises(FileExistsError):
        c.write(out_dir)


@pytest.mark.parametrize("step", ["write_catalog", "write_occupied", "store_metadata"])
def test_replacement_that_breaks_off_leaves_the_old_catalog(spark, out_dir, monkeypatch, step):
    c = ingest(fx.emb_bands(spark, SF001), out_dir, 4, 2, k=64)
    real = getattr(cat, step)

    def broken(*a, **b):
        if step == "write_catalog":
            real(*a, **b)
        raise RuntimeError("stopped")

    monkeypatch.setattr(cat, step, broken)
    with pytest.raises(RuntimeError):
        c.filter(F.col("time_id") < 5).write(out_dir, "overwrite")
    monkeypatch.undo()
    old = cat.open_catalog(spark, out_dir)
    assert old.meta.time_count == 500 and old.series.count() == 4000 and old.window(10, 20).count() == 88
    # the next replacement takes the remains away
    old.filter(F.col("time_id") < 5).write(out_dir, "overwrite")
    assert cat.open_catalog(spark, out_dir).series.count() == 40 and len(folders(spark, out_dir)) == 2


def test_streams_belong_to_their_version(spark, out_dir):
    from gridseries.streaming.append import append_bands_stream, refresh_time_count

    bands = fx.emb_bands(spark, SF001).drop("label")
    ingest(bands.filter("path_idx = 0"), out_dir, 4, 2, k=64)
    bands.filter("path_idx = 1").write.parquet(f"{out_dir}-more")
    for i in (1, 2):
        append_bands_stream(spark, f"{out_dir}-more", out_dir).awaitTermination(240)
        assert refresh_time_count(spark, out_dir) == 500
        c = cat.open_catalog(spark, out_dir)
        assert c.series.count() == 4000
        # replaced by its own stored and streamed rows, then by the first input again: streamed rows go with their version
        c.filter(F.col("time_id") < 250).write(out_dir, "overwrite")
        assert cat.open_catalog(spark, out_dir).series.count() == 2000


def test_window_builds_its_paths_without_searching(spark, out_dir, monkeypatch):
    c = ingest(fx.emb_bands(spark, SF001), out_dir, 4, 2, k=100)  # 500 = 5 x 100: the last part is empty
    assert c.occupied() == [[0, 7, 0, 4]]

    def no_glob(*a):
        raise AssertionError("searched")

    monkeypatch.setattr(cat, "_any_path", no_glob)
    assert c.window(100, 200).count() == 101 * 8 and len(c.window(150, 250).inputFiles()) == 16
    assert c.window(600, 700).count() == 0
    holes = c.filter((F.col("tile_id") != 3) & ~F.col("time_id").between(100, 199) | (F.col("time_id") < 10)).write(f"{out_dir}-holes")
    again = cat.open_catalog(spark, f"{out_dir}-holes")
    assert again.occupied() == [[0, 2, 0, 0], [0, 2, 2, 4], [3, 3, 0, 0], [4, 7, 0, 0], [4, 7, 2, 4]]
    for a, b in ((0, 150), (100, 199), (150, 420), (None, 9), (450, None)):
        assert again.window(a, b).exceptAll(filter_time(holes.series, a, b)).count() == 0
        assert again.window(a, b).count() == filter_time(holes.series, a, b).count()


def test_occupied_folders_are_runs():
    assert cat._runs([]) == [] and cat._runs([1]) == [(1, 1)]
    assert cat._runs([1, 2, 3, 7, 9, 10]) == [(1, 3), (7, 7), (9, 10)]
    assert cat.window_paths("c", [[0, 1, 2, 5], [4, 4, 0, 0]], 5, 9) == ["c/tile_id=0/part=5", "c/tile_id=1/part=5"]


def test_strips_assembled_in_sorted_order(spark, out_dir):
    strips = fx.emb_strips(spark, SF001).drop("label")
    c = ingest(strips, out_dir, 4, 2, k=64)
    want = ingest(fx.emb_bands(spark, SF001), f"{out_dir}-w", 4, 2, k=64)
    assert c.series.exceptAll(want.series).count() == 0 and c.series.count() == want.series.count()
    pieces = strip_pieces(timed_bands(strips), fx.EMB_LAYOUT, 8)
    text = plan(assemble_sorted(pieces.repartition("time_id", "tile_id"), fx.EMB_LAYOUT, ("time_id", "tile_id")))
    assert text.count("Exchange") == 1 and "collect_list" not in text


def test_strips_with_gaps_and_overlaps_are_errors(spark):
    strips = timed_bands(fx.emb_strips(spark, SF001).drop("label")).filter("time_id < 5")
    for bad in (strips.filter("row0 <> 3"), strips.union(strips.filter("row0 = 3")), strips.filter("row0 <> 6")):
        with pytest.raises(Exception, match="cover the tile exactly"):
            tile_strips(bad, fx.EMB_LAYOUT, 8).collect()
    assert tile_strips(strips.filter("false"), fx.EMB_LAYOUT, 8).count() == 0


def test_strips_keep_nan_null_and_type(spark):
    rows = [(1, 0, [1.5, None]), (1, 1, [float("nan"), 2.0])]
    s = spark.createDataFrame(rows, "time_id int, row0 int, cells array<float>")
    from gridseries.model import TileLayout
    got = tile_strips(s, TileLayout(1, 1, 2, 2), 2).first()["cells"]
    assert got[:2] == [1.5, None] and got[2] != got[2] and got[3] == 2.0


def test_read_bands_is_one_scan_at_any_depth(spark, out_dir):
    bands = fx.emb_bands(spark, SF001).drop("label", "path_idx")
    paths = [f"{out_dir}/a", f"{out_dir}/a/b", f"{out_dir}/c/d/e", f"{out_dir}/a/b/x/y"]
    for i, p in enumerate(paths):
        bands.filter(F.col("band") == i + 1).limit(1).coalesce(1).write.parquet(p)
    df = read_bands(spark, [paths[2], paths[1], paths[0], paths[3], paths[1]])
    assert plan(df).count("FileScan parquet") == 1
    assert {(r.path_idx, r.band) for r in df.collect()} == {(0, 3), (1, 2), (2, 1), (3, 4), (4, 2)}


def test_indexed_bands_push_a_window_to_the_scan(spark, out_dir):
    index_bands(fx.emb_bands(spark, SF001), out_dir, 4)
    df = filter_time(read_bands(spark, [out_dir]), 100, 200)
    text = plan(df)
    assert "GreaterThanOrEqual(time_id,100)" in text and "LessThanOrEqual(time_id,200)" in text
    assert df.count() == 101 and timed_bands(df).columns == df.columns
    c = ingest(read_bands(spark, [out_dir]), f"{out_dir}-cat", 4, 2, k=64)
    assert c.meta.time_count == 500 and c.window(100, 200).count() == 808


@pytest.mark.parametrize("name", ["mosaic_mean", "mosaic_mean_arrow", "mosaic_mean_window", "mosaic_mean_catalog"])
def test_mean_is_one_scan(spark, name):
    text = plan(R.QUERIES[name](spark, SF001))
    assert text.count("FileScan parquet") == 1 and "Subquery" not in text


@pytest.mark.parametrize("method", ["explode", "arrow"])
def test_one_pass_mean_follows_the_first_tile(spark, method):
    from gridseries.model import TileLayout

    layout = TileLayout(2, 1, 2, 1)
    rows = [(0, 1, [2.0, 4.0]), (0, 2, None), (1, 1, [3.0, float("nan")]), (1, 1, [3.0, 1.0]), (0, 1, [2.0, None])]
    s = spark.createDataFrame(rows, "tile_id int, time_id int, cells array<double>")
    got = {r.cell_col: r.mean_v for r in A.mosaic_mean(s, layout, method).collect()}
    assert [got[i] for i in range(3)] == [4 / 3, 4 / 3, 2.0] and got[3] != got[3]
    none = [r.mean_v for r in A.mosaic_mean(s.filter("time_id > 5"), layout, method).collect()]
    assert len(none) == 4 and all(v != v for v in none)
    only = [r.mean_v for r in A.mosaic_mean(s.filter("tile_id = 1"), layout, method).collect()]
    assert all(v != v for v in only)  # no record of the first tile
    bad = spark.createDataFrame([(0, 1, [1.0])], s.schema)
    with pytest.raises(Exception, match="must hold 2 cells"):
        A.mosaic_mean(bad, layout, method).collect()
