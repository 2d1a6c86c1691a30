import math

import pytest
from pyspark.sql import functions as F

from gridseries.model import TileLayout
from gridseries.operators import aggregate as A
from gridseries.operators.filters import filter_time, map_cells
from gridseries.plans import fixtures as fx
from tests.conftest import SF001

ONE = TileLayout(1, 1, 2, 1)   # one tile of two cells


def _series(spark, rows, schema="tile_id int, time_id int, cells array<double>"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("method", ["explode", "arrow"])
def test_nan_carries(spark, method):
    s = _series(spark, [(0, 1, [1.0, 2.0]), (0, 2, [3.0, float("nan")])])
    got = {r["pos"]: r["sum_v"] for r in A.tile_sum(s, ONE, method=method).collect()}
    assert got[0] == 4.0 and math.isnan(got[1])


@pytest.mark.parametrize("method", ["explode", "arrow"])
def test_empty_window_is_zero_and_mean_nan(spark, method):
    s = filter_time(_series(spark, [(0, 1, [1.0, 2.0])]), 50, 60)
    sums = A.tile_sum(s, ONE, method=method).collect()
    assert sorted((r["pos"], r["sum_v"]) for r in sums) == [(0, 0.0), (1, 0.0)]
    means = A.mosaic_mean(s, ONE, method=method).collect()
    assert len(means) == 2 and all(math.isnan(r["mean_v"]) for r in means)


def test_absent_cells_filled_only(spark):
    layout = TileLayout(2, 1, 2, 1)
    s = spark.createDataFrame([(1, 5, 0, 2.5), (1, 6, 0, 1.0)], "tile_id int, time_id int, pos int, v double")
    got = sorted((r["cell_row"], r["cell_col"], r["sum_v"]) for r in A.mosaic_sum(s, layout).collect())
    assert got == [(0, 0, 0.0), (0, 1, 0.0), (0, 2, 3.5), (0, 3, 0.0)]


def test_float_cells_sum_as_double(spark):
    s = _series(spark, [(0, t, [0.1, 0.2]) for t in range(10)], "tile_id int, time_id int, cells array<float>")
    sums = A.tile_sum(s, ONE)
    assert dict(sums.dtypes)["sum_v"] == "double"
    got = {r["pos"]: r["sum_v"] for r in sums.collect()}
    assert abs(got[0] - 10 * float(__import__("numpy").float32(0.1))) < 1e-12


def test_mean_divides_by_first_tile_count(spark):
    layout = TileLayout(2, 1, 1, 1)
    # tile 0 has 4 records, tile 1 only 2: the divisor is 4 for both
    rows = [(0, t, [1.0]) for t in range(4)] + [(1, t, [2.0]) for t in range(2)]
    s = _series(spark, rows)
    got = sorted((r["cell_col"], r["mean_v"]) for r in A.mosaic_mean(s, layout).collect())
    assert got == [(0, 1.0), (1, 1.0)]


def test_sparse_mean_divides_by_distinct_steps(spark):
    layout = TileLayout(1, 1, 2, 1)
    s = spark.createDataFrame([(0, 1, 0, 4.0), (0, 2, 1, 2.0), (0, 3, 1, 2.0), (0, 4, 0, 0.0)],
                              "tile_id int, time_id int, pos int, v double")
    got = sorted((r["cell_col"], r["mean_v"]) for r in A.mosaic_mean(s, layout).collect())
    assert got == [(0, 1.0), (1, 1.0)]


def test_min_max_leaves_nan_out(spark):
    r = spark.createDataFrame([(1.0,), (float("nan"),), (-2.0,)], "v double")
    assert tuple(A.min_max(r, "v").first()) == (-2.0, 1.0)


def test_arrow_equals_explode_on_fixture(spark):
    s = filter_time(fx.emb_series(spark, SF001), 10, 400)
    a = A.tile_sum(s, fx.EMB_LAYOUT, method="arrow").select("tile_id", "pos", F.round("sum_v", 9).alias("x"))
    b = A.tile_sum(s, fx.EMB_LAYOUT).select("tile_id", "pos", F.round("sum_v", 9).alias("x"))
    assert a.exceptAll(b).count() == 0 and a.count() == 64


def test_sum_of_tile_sums_is_raster_sum(spark):
    s = fx.emb_series(spark, SF001)
    tiles = A.tile_sum(s, fx.EMB_LAYOUT).agg(F.sum("sum_v")).first()[0]
    raw = spark.read.parquet(f"{SF001}/embeddings.parquet").select(F.explode("embedding").alias("v")) \
        .agg(F.sum(F.col("v").cast("double"))).first()[0]
    assert abs(tiles - raw) < 1e-9


def test_local_add_by_group(spark):
    s = fx.emb_series(spark, SF001)
    per_label = A.local_add(s, fx.EMB_LAYOUT, ["label"])
    total = per_label.groupBy("cell_row", "cell_col").agg(F.sum("sum_v").alias("a"))
    whole = A.mosaic_sum(s, fx.EMB_LAYOUT)
    diff = total.join(whole, ["cell_row", "cell_col"]).filter(F.abs(F.col("a") - F.col("sum_v")) > 1e-9)
    assert diff.count() == 0 and total.count() == 64


def test_map_cells(spark):
    s = _series(spark, [(0, 1, [1.0, 2.0])])
    got = map_cells(s, lambda c: c * 10).first()["cells"]
    assert got == [10.0, 20.0]


def test_sum_plan_aggregates_partially(spark):
    s = fx.emb_series(spark, SF001)
    plan = A.tile_sum(s, fx.EMB_LAYOUT)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Exchange" in plan
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_auto_method_picks_by_tile_size(spark):
    big = TileLayout(1, 1, 64, 32)
    s = _series(spark, [(0, 1, [1.0] * 2048), (0, 2, [2.0] * 2048)])
    assert A.choose_method(s, big, "auto") == "arrow"
    assert A.choose_method(s, ONE, "auto") == "explode"
    long = spark.createDataFrame([(0, 1, 0, 1.0)], "tile_id int, time_id int, pos int, v double")
    assert A.choose_method(long, big, "auto") == "explode"
    got = A.tile_sum(s, big).agg(F.min("sum_v"), F.max("sum_v"), F.count(F.lit(1))).first()
    assert tuple(got) == (3.0, 3.0, 2048)


def test_reader_batch_is_scoped(spark):
    from gridseries.session import guarded_reader, reader_batch

    key = "spark.sql.parquet.columnarReaderBatchSize"
    old = spark.conf.get(key, "4096")
    assert reader_batch(1 << 20) == 32 and reader_batch(16) == 4096 and reader_batch(1 << 40) == 1
    with guarded_reader(spark, 1 << 20):
        assert spark.conf.get(key) == "32"
        with guarded_reader(spark, 16):
            assert spark.conf.get(key) == "32"  # never raised
    assert spark.conf.get(key, "4096") == old


@pytest.mark.parametrize("method", ["explode", "arrow"])
def test_same_rules_for_null_keys_big_keys_and_null_cells(spark, method):
    big = 2**53 + 1
    s = spark.createDataFrame([(0, 1, None, [1.0, None]), (0, 2, None, [2.0, None]), (0, 3, big, [None, None]), (0, 4, big + 1, [5.0, float("nan")]),
                               (0, 5, big, None), (0, 6, 7, None)], "tile_id int, time_id int, g bigint, cells array<double>")
    got = {(r["g"], r["pos"]): str(r["sum_v"]) for r in A.tile_sum(s, ONE, keys=["g"], method=method).collect()}
    assert got == {(None, 0): "3.0", (None, 1): "0.0", (big, 0): "0.0", (big, 1): "0.0", (big + 1, 0): "5.0", (big + 1, 1): "nan"}
    whole = {r["pos"]: str(r["sum_v"]) for r in A.tile_sum(s, ONE, method=method).collect()}
    assert whole == {0: "8.0", 1: "nan"}


@pytest.mark.parametrize("method", ["explode", "arrow"])
@pytest.mark.parametrize("cells", [[1.0], [1.0, 2.0, 3.0]])
def test_wrong_tile_length_is_an_error_in_both_forms(spark, method, cells):
    s = _series(spark, [(0, 1, [1.0, 2.0]), (0, 2, cells)])
    with pytest.raises(Exception, match="tile arrays must hold 2 cells"):
        A.tile_sum(s, ONE, method=method).collect()


def test_last_stage_spreads_over_blocks_of_one_tile(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    layout = TileLayout(1, 1, 180, 180)
    s = _series(spark, [(0, t, [float(t)] * 32400) for t in range(1, 4)])
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        df = A.tile_sum(s, layout, method="arrow")
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    width = -(-32400 // A.POS_BLOCK)
    assert width == 32 and f", {width})" in plan and "REPARTITION" in plan
    assert tuple(df.agg(F.min("sum_v"), F.max("sum_v"), F.count_distinct("pos")).first()) == (6.0, 6.0, 32400)


def test_arrow_flushes_partials_for_many_groups(spark, monkeypatch):
    monkeypatch.setattr(A, "ARROW_ACC_BYTES", 8 * 2 * 3)   # room for 3 groups of a 2-cell tile
    s = spark.createDataFrame([(0, t, t % 7, [1.0, float(t)]) for t in range(50)],
                              "tile_id int, time_id int, g int, cells array<double>").repartition(2)
    a = A.tile_sum(s, ONE, keys=["g"], method="arrow").orderBy("g", "pos").collect()
    b = A.tile_sum(s, ONE, keys=["g"], method="explode").orderBy("g", "pos").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b] and len(a) == 14


def test_tile_arrays_round_trip(spark):
    s = fx.emb_series(spark, SF001)
    sums = A.tile_sum(s, fx.EMB_LAYOUT)
    arrays = {r["tile_id"]: r["cells"] for r in A.tile_arrays(sums).collect()}
    assert len(arrays) == 8 and all(len(v) == 8 for v in arrays.values())
    longs = {(r["tile_id"], r["pos"]): r["sum_v"] for r in sums.collect()}
    assert all(arrays[t][p] == v for (t, p), v in longs.items())


def test_arrow_single_tile_and_empty_tile(spark):
    s = fx.emb_series(spark, SF001)
    a = A.tile_sum(s, fx.EMB_LAYOUT, tile_id=3, method="arrow").select("tile_id", "pos", F.round("sum_v", 9).alias("x"))
    b = A.tile_sum(s, fx.EMB_LAYOUT, tile_id=3, method="explode").select("tile_id", "pos", F.round("sum_v", 9).alias("x"))
    assert a.count() == 8 and a.exceptAll(b).count() == 0
    empty = A.tile_sum(filter_time(s, 10**6, None), fx.EMB_LAYOUT, tile_id=5, method="arrow").collect()
    assert sorted((r["tile_id"], r["pos"], r["sum_v"]) for r in empty) == [(5, p, 0.0) for p in range(8)]
