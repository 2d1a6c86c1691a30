"""The ingest's heavy step: bands get their part without a shuffle of the cells, and tiles are cut by compiled slices."""

from pyspark.sql import functions as F

from gridseries.model import TileLayout
from gridseries.operators.filters import filter_time, map_cells
from gridseries.operators.tiling import MOST_SLICES, tile_bands, tile_cells_expr
from gridseries.sources import catalog as cat
from gridseries.sources import ingest as ing

BANDS = "path_idx INT, band INT, time_id INT, xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE, cols INT, rows INT, " \
        "cell_type STRING, cells ARRAY<FLOAT>"


def some_bands(spark, times):
    return spark.createDataFrame([(0, i + 1, t, 0.0, 0.0, 4.0, 2.0, 4, 2, "float32", [float(i * 8 + j) for j in range(8)])
                                  for i, t in enumerate(times)], BANDS)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def written_plan(spark, out, monkeypatch, times=range(20)):
    seen = []
    real = ing.write_catalog
    monkeypatch.setattr(ing, "write_catalog", lambda series, *a, **k: (seen.append(series), real(series, *a, **k))[1])
    catalog = ing.ingest(some_bands(spark, times), out, 2, 1, k=3)
    return catalog, plan_of(seen[0])


def test_bands_get_their_part_without_a_shuffle(spark, out_dir, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a series of many steps
    try:
        catalog, plan = written_plan(spark, out_dir, monkeypatch)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    rows = filter_time(catalog.series, 5, 9).select("tile_id", "time_id", "part").collect()
    assert sorted(map(tuple, rows)) == [(t, i, i // 3) for t in (0, 1) for i in range(5, 10)]


def test_band_without_a_time_keeps_parts_and_splits_in_step(spark, out_dir):
    catalog = ing.ingest(some_bands(spark, [None, 0, 1, 2, 3]), out_dir, 2, 1, k=1)
    for t in range(4):
        assert sorted(r["time_id"] for r in catalog.window(t, t).collect()) == [t, t]
    assert catalog.series.count() == 8


def test_tiles_are_cut_by_compiled_slices(spark, out_dir, monkeypatch):
    catalog, plan = written_plan(spark, out_dir, monkeypatch)
    assert "flatten(" not in plan and "concat(slice(" in plan
    derived = cat.to_records(map_cells(catalog.series, lambda v: v * 2))
    back = cat.Catalog(catalog.path, catalog.meta, derived).write(out_dir + "-derived")
    got = {(r["tile_id"], r["time_id"]): r["cells"] for r in back.series.collect()}
    assert got == {(t, i): [2.0 * (i * 8 + r * 4 + t * 2 + c) for r in range(2) for c in range(2)] for t in (0, 1) for i in range(20)}


def test_slices_and_expression_cut_the_same_tiles(spark):
    for lay in (TileLayout(3, 2, 5, 1), TileLayout(1, 3, 2, MOST_SLICES), TileLayout(2, 2, 1, MOST_SLICES + 1)):
        n = lay.cols * lay.rows
        b = spark.range(4).select(F.col("id").cast("int").alias("time_id"),
                                  F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(i % 7 != F.col("id"), i.cast("float"))).alias("cells"))
        a = tile_bands(b, lay).select("time_id", "tile_id", "cells").collect()
        e = b.select("time_id", F.inline(tile_cells_expr("cells", lay))).collect()
        assert sorted(map(str, a)) == sorted(map(str, e)) and len(a) == 4 * lay.n_tiles
