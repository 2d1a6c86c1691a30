import pytest
from pyspark.sql import functions as F

from gridseries.operators import aggregate as A
from gridseries.operators.filters import filter_time, filter_series, map_tiles
from gridseries.plans import fixtures as fx
from gridseries.sources import catalog as cat
from gridseries.sources.bands import check_extents, infer_grid, read_bands
from gridseries.sources.ingest import ingest
from tests.conftest import SF001


@pytest.fixture(scope="module")
def emb_cat(spark):
    from gridseries.session import new_output_path

    path = new_output_path(spark, "test-catalog")
    return ingest(fx.emb_bands(spark, SF001), path, 4, 2, k=64)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_round_trip_equals_input(spark, emb_cat):
    back = A.to_long(emb_cat.series).select("tile_id", "time_id", "pos", "v")
    direct = A.to_long(fx.emb_series(spark, SF001)).select("tile_id", "time_id", "pos", "v")
    assert back.count() == direct.count() == 500 * 64
    assert back.exceptAll(direct).count() == 0


def test_metadata_of_ingest(emb_cat):
    m = emb_cat.meta
    assert m.time_count == 500 and m.splits == (63, 127, 191, 255, 319, 383, 447)
    assert (m.layout.pixel_cols, m.layout.pixel_rows) == (2, 4)
    assert m.cell_type.name == "float32"


def test_one_directory_per_tile_and_part(emb_cat):
    per = emb_cat.series.groupBy("tile_id", "part").agg(F.count(F.lit(1)).alias("n"),
                                                        F.min("time_id").alias("lo"), F.max("time_id").alias("hi"))
    rows = per.collect()
    assert len(rows) == 8 * 8
    files = emb_cat.series.inputFiles()
    assert len(files) == 64


def test_prune_parts_plan_and_result(spark, emb_cat):
    pruned = emb_cat.window(100, 200)
    plan = _plan(pruned)
    assert "PartitionFilters" in plan and "part#" in plan
    assert "PushedFilters" in plan and "time_id" in plan
    unpruned = filter_time(emb_cat.series, 100, 200)
    assert pruned.count() == unpruned.count() == 101 * 8
    assert pruned.exceptAll(unpruned).count() == 0
    # only parts 1..3 are read
    assert {r["part"] for r in pruned.select("part").distinct().collect()} == {1, 2, 3}


def test_scan_tile_and_window_list_only_their_folders(spark, emb_cat):
    fresh = cat.open_catalog(spark, emb_cat.path)
    t = fresh.tile(3)
    assert len(t.inputFiles()) == 8 and all("/tile_id=3/" in f for f in t.inputFiles())
    assert t.select("tile_id").distinct().collect()[0][0] == 3 and t.count() == 500
    w = fresh.window(100, 200)
    assert len(w.inputFiles()) == 8 * 3 and {f.split("/part=")[1][0] for f in w.inputFiles()} == {"1", "2", "3"}
    assert fresh._series is None  # the whole tree has not been listed
    assert fresh.tile(99).count() == 0
    assert cat.scan_tile(fresh.filter(F.col("time_id") < 10), 3).count() == 10


def test_series_by_part(emb_cat):
    s = cat.part_summary(cat.series_by_part(emb_cat, 0, 100, 200)).orderBy("part").collect()
    assert [(r["part"], r["n_records"], r["min_time"], r["max_time"]) for r in s] == \
        [(1, 28, 100, 127), (2, 64, 128, 191), (3, 9, 192, 200)]


def test_column_pruning_on_count(emb_cat):
    plan = _plan(emb_cat.series.filter("part = 2").groupBy("tile_id").count())
    assert "ReadSchema: struct<>" in plan or "ReadSchema: struct<time_id" not in plan


def test_cache_series(emb_cat):
    c = cat.cache_series(emb_cat.series)
    assert c.count() == 4000
    assert c.storageLevel.useMemory
    cat.uncache_series(c)
    assert "InMemoryTableScan" not in _plan(emb_cat.series.filter("tile_id = 1"))


def test_filter_series_python_predicate(spark, emb_cat):
    def positive_mean(time_id, cells):
        return cells.apply(lambda a: float(a.mean()) > 0)

    got = filter_series(emb_cat.series, positive_mean).count()
    want = emb_cat.series.filter(F.aggregate("cells", F.lit(0.0), lambda a, c: a + c.cast("double")) > 0).count()
    assert got == want


def test_map_tiles_python_keeps_partitioning(spark, emb_cat):
    def shift(pdf):
        pdf["time_id"] = pdf["time_id"] + 1
        return pdf

    m = map_tiles(emb_cat.series, shift)
    assert m.agg(F.min("time_id")).first()[0] == 1
    assert "Exchange" not in _plan(m)
    assert m.count() == emb_cat.series.count()


def test_derived_series_written_back(spark, emb_cat, out_dir):
    sums = A.tile_sum(emb_cat.series, fx.EMB_LAYOUT)
    assert sums.count() == 64
    cat.write_catalog(cat.to_records(emb_cat.series), out_dir)
    with pytest.raises(Exception):
        cat.write_catalog(cat.to_records(emb_cat.series), out_dir)


def test_ingest_refuses_mismatched_inputs(spark, out_dir):
    bands = fx.emb_bands(spark, SF001)
    bad = bands.withColumn("xmax", F.when(F.col("path_idx") == 1, F.lit(181.0)).otherwise(F.col("xmax")))
    assert [r["extent_ok"] for r in check_extents(bad).orderBy("path_idx").collect()] == [True, False]
    with pytest.raises(ValueError, match="another extent"):
        ingest(bad, out_dir, 4, 2, k=64)
    with pytest.raises(ValueError, match="equal tiles"):
        ingest(bands, out_dir, 3, 2, k=64)


def test_open_without_metadata_errors(spark, out_dir):
    with pytest.raises(FileNotFoundError):
        cat.open_catalog(spark, out_dir)


def test_read_bands_from_files(spark, out_dir):
    bands = fx.emb_bands(spark, SF001).drop("path_idx")
    a, b = f"{out_dir}/a", f"{out_dir}/b"
    bands.filter("band <= 100").write.parquet(a)
    bands.filter("band > 100").write.parquet(b)
    both = read_bands(spark, [a, b])
    assert both.count() == 500
    assert {(r["path_idx"], r["n"]) for r in both.groupBy("path_idx").agg(F.count(F.lit(1)).alias("n")).collect()} == \
        {(0, bands.filter("band <= 100").count()), (1, bands.filter("band > 100").count())}
    first = infer_grid(both).first()
    assert (first["cols"], first["rows"]) == (8, 8)


def test_map_tiles_python_keeps_nan(spark):
    import numpy as np

    s = spark.createDataFrame([(0, 1, [1.0, float("nan")])], "tile_id int, time_id int, cells array<double>")

    def double(pdf):
        pdf["cells"] = pdf["cells"].apply(lambda a: np.asarray(a) * 2)
        return pdf

    got = map_tiles(s, double).first()["cells"]
    assert got[0] == 2.0 and got[1] != got[1]


def test_ingest_from_row_strips(spark, emb_cat, out_dir):
    bands = fx.emb_bands(spark, SF001)
    strips = bands.select(*[c for c in bands.columns if c != "cells"],
                          F.explode(F.array(F.lit(0), F.lit(3), F.lit(6))).alias("row0"), "cells") \
        .withColumn("cells", F.slice("cells", F.col("row0") * 8 + 1, F.least(F.lit(3), 8 - F.col("row0")) * 8))
    c = ingest(strips, out_dir, 4, 2, k=64)
    assert c.meta.time_count == 500 and c.meta.splits == emb_cat.meta.splits
    assert c.series.exceptAll(emb_cat.series).count() == 0
    assert c.series.count() == emb_cat.series.count()


def test_catalog_api_mirrors_raster_series(spark, emb_cat):
    win = emb_cat.between(100, 200)
    assert win.time_count().first()[0] == 101
    s = {(r["cell_row"], r["cell_col"]): r["sum_v"] for r in win.sum().collect()}
    m = {(r["cell_row"], r["cell_col"]): r["mean_v"] for r in win.mean().collect()}
    assert len(s) == 64 and all(abs(m[k] - s[k] / 101) < 1e-12 for k in s)
    lo, hi = win.min_max().first()
    assert lo == min(m.values()) and hi == max(m.values())
    kept = win.filter(F.col("time_id") > 150)
    assert kept.time_count().first()[0] == 50
    shifted = win.map_tiles({"time_id": F.col("time_id") + 1000})
    assert shifted.series.agg(F.min("time_id")).first()[0] == 1100
    cached = win.cache()
    assert cached.series.count() == 101 * 8
    cached.series.unpersist()


def test_big_parts_roll_over_into_several_files(spark, out_dir, monkeypatch):
    monkeypatch.setattr(cat, "MAX_FILE_BYTES", 8 * 4 * 100)   # 100 records of 8 float cells per file
    c = ingest(fx.emb_bands(spark, SF001), out_dir, 4, 2, k=0)
    assert c.meta.splits == () and c.series.count() == 500 * 8
    files = [f for f in c.series.inputFiles() if "tile_id=0/" in f]
    assert len(files) == 5


def test_sql_view_keeps_pruning(spark, emb_cat):
    emb_cat.create_view("emb_series_view")
    q = spark.sql("""
        SELECT tile_id, count(*) AS n, sum(aggregate(cells, 0D, (a, c) -> a + c)) AS s
        FROM emb_series_view
        WHERE part BETWEEN 1 AND 3 AND time_id BETWEEN 100 AND 200
        GROUP BY tile_id""")
    rows = q.collect()
    assert len(rows) == 8 and all(r["n"] == 101 for r in rows)
    plan = _plan(q)
    assert "PartitionFilters" in plan and "GreaterThanOrEqual(time_id,100)" in plan


def test_read_bands_numbers_inputs_by_position(spark, out_dir):
    bands = fx.emb_bands(spark, SF001).drop("label").withColumn("path_idx", F.lit(0))
    a, b, c = f"{out_dir}/a", f"{out_dir}/deep er/b", f"{out_dir}/c%20d/part=1"
    for i, p in enumerate((a, b, c)):
        bands.filter(F.col("band") == i + 1).limit(1).coalesce(1).write.parquet(p)
    got = {(r["path_idx"], r["band"]) for r in read_bands(spark, [c, a, b, a]).collect()}
    assert got == {(0, 3), (1, 1), (2, 2), (3, 1)}
    one = [f for f in spark.read.parquet(a).inputFiles()][0]
    assert {r["path_idx"] for r in read_bands(spark, [b, one]).collect()} == {0, 1}


def test_read_bands_plans_many_inputs_at_once(spark, out_dir):
    import time

    fx.emb_bands(spark, SF001).drop("path_idx").limit(2).coalesce(1).write.parquet(out_dir)
    t = time.time()
    df = read_bands(spark, [out_dir] * 400)
    assert "Union" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert time.time() - t < 30
    assert df.select("path_idx").distinct().count() == 400


def test_overwrite_replaces_appended_steps(spark, out_dir):
    from gridseries.streaming.append import append_bands_stream

    bands = fx.emb_bands(spark, SF001).drop("label")
    first = ingest(bands.filter("path_idx = 0"), out_dir, 4, 2, k=64)
    more = f"{out_dir}-more"
    bands.filter("path_idx = 1").write.parquet(more)
    append_bands_stream(spark, more, out_dir).awaitTermination(120)
    assert cat.open_catalog(spark, out_dir).series.count() == 500 * 8
    assert cat.open_catalog(spark, out_dir).tile(2).count() == 500
    again = ingest(bands.filter("path_idx = 0"), out_dir, 4, 2, k=64, mode="overwrite")
    assert again.series.count() == cat.open_catalog(spark, out_dir).series.count() == first.meta.time_count * 8


def test_broken_overwrite_leaves_the_old_catalog(spark, out_dir, monkeypatch):
    from gridseries.sources import ingest as module

    bands = fx.emb_bands(spark, SF001)
    ingest(bands, out_dir, 4, 2, k=64)

    def broken(series, *a, **b):
        cat.write_catalog(series.limit(3), *a, **b)  # some cells are there already
        raise RuntimeError("stopped")

    monkeypatch.setattr(module, "write_catalog", broken)
    with pytest.raises(RuntimeError):
        ingest(bands, out_dir, 4, 2, k=32, mode="overwrite")
    old = cat.open_catalog(spark, out_dir)
    assert old.series.count() == 500 * 8 and old.window(100, 200).count() == 101 * 8 and len(old.meta.splits) == 7


def test_broken_first_write_is_not_readable(spark, out_dir, monkeypatch):
    from gridseries.sources import ingest as module

    def broken(series, *a, **b):
        cat.write_catalog(series.limit(3), *a, **b)
        raise RuntimeError("stopped")

    monkeypatch.setattr(module, "write_catalog", broken)
    with pytest.raises(RuntimeError):
        ingest(fx.emb_bands(spark, SF001), out_dir, 4, 2, k=64)
    with pytest.raises(FileNotFoundError):
        cat.open_catalog(spark, out_dir)


@pytest.mark.parametrize("mode", ["append", "ignore"])
def test_other_write_modes_are_refused(spark, out_dir, mode):
    bands = fx.emb_bands(spark, SF001)
    with pytest.raises(ValueError, match=mode):
        ingest(bands, out_dir, 4, 2, k=64, mode=mode)
    with pytest.raises(ValueError, match=mode):
        cat.write_catalog(fx.emb_series(spark, SF001).withColumn("part", F.lit(0)), out_dir, mode)
    ingest(bands, out_dir, 4, 2, k=64)
    with pytest.raises(FileExistsError):
        ingest(bands, out_dir, 4, 2, k=64)


def test_a_step_larger_than_a_block_still_makes_parts(spark, out_dir):
    c = ingest(fx.emb_bands(spark, SF001).filter("path_idx = 0 and band <= 5"), out_dir, 4, 2, block_size=1)
    assert len(c.meta.splits) == 5 and c.series.select("part").distinct().count() == 5


def test_strips_keep_bands_of_one_time(spark, out_dir):
    twice = fx.emb_strips(spark, SF001).filter("path_idx = 0 and band <= 3") \
        .withColumn("metadata", F.array(F.lit("NETCDF_DIM_Time=9")))
    c = ingest(twice, out_dir, 4, 2, k=64)
    assert c.meta.time_count == 3 and c.series.count() == 3 * 8
    whole = fx.emb_series(spark, SF001).filter("time_id < 3").select("tile_id", "cells")
    assert c.series.select("tile_id", "cells").exceptAll(whole).count() == 0


def test_derived_catalog_and_sum_bounds(spark, emb_cat, out_dir):
    half = emb_cat.filter(F.col("time_id") % 2 == 0).map_tiles({"cells": F.transform("cells", lambda c: c.cast("double"))})
    c = half.write(out_dir)
    assert c.meta.time_count == 250 and c.meta.cell_type.name == "float64"
    lo, hi = c.min_max(of="sum").first()
    sums = [r["sum_v"] for r in half.sum().collect()]
    assert abs(lo - min(sums)) < 1e-9 and abs(hi - max(sums)) < 1e-9
    assert c.extents().count() == 8
