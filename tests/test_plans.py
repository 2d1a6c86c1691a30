"""Physical plan shapes the design relies on."""

import re

from pyspark.sql import functions as F

from gridseries.operators import aggregate as A
from gridseries.operators.parts import attach_parts, time_parts
from gridseries.operators.tiling import tile_bands
from gridseries.plans import fixtures as fx
from gridseries.sources.catalog import cluster_for_write, to_records, writer_tasks
from gridseries.sources.ingest import timed_bands
from tests.conftest import SF001


def _plan(df):
    df.collect()  # AQE: final plan
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def _shuffles(plan):
    return [l for l in plan.splitlines() if re.search(r"Exchange (hashpartitioning|SinglePartition|rangepartitioning)", l)]


def test_cell_sum_has_one_shuffle_and_no_join(spark):
    plan = _plan(A.mosaic_sum(fx.emb_series(spark, SF001), fx.EMB_LAYOUT, method="explode"))
    assert len(_shuffles(plan)) == 1
    assert "Join" not in plan and "CartesianProduct" not in plan
    assert "partial_sum" in plan


def test_mean_divisor_is_not_a_join(spark):
    """Dense: counted in the pass that sums the cells.  Given or sparse counts: a scalar subquery."""
    series = fx.emb_series(spark, SF001)
    plan = _plan(A.mosaic_mean(series, fx.EMB_LAYOUT, method="explode"))
    assert "Subquery" not in plan and "Join" not in plan and plan.count("FileScan parquet") == 1
    plan = _plan(A.mosaic_mean(series, fx.EMB_LAYOUT, method="explode", count=A.time_count(series)))
    assert "Subquery" in plan and "Join" not in plan


def test_whole_band_write_shuffles_once(spark, out_dir):
    timed = timed_bands(fx.emb_bands(spark, SF001)).select("time_id", "cells")
    time_parts(timed, 64).write.parquet(out_dir)
    parts = spark.read.parquet(out_dir)
    rec = to_records(attach_parts(tile_bands(timed, fx.EMB_LAYOUT, 8), parts))
    plan = _plan(cluster_for_write(rec, 8).sortWithinPartitions("tile_id", "part", "time_id"))
    assert plan.count("REPARTITION_BY_NUM") == 1
    dense = cluster_for_write(rec, 8, n_parts=8)._jdf.queryExecution().executedPlan().toString()
    assert "shufflepartitionidpassthrough" in dense.lower() or "REPARTITION" in dense


def test_ship_window_reaches_the_scan(spark):
    s = fx.ship_series(spark, SF001, window=fx.SHIP_WINDOW)
    plan = _plan(A.mosaic_sum(s, fx.SHIP_LAYOUT))
    scan = [l for l in plan.splitlines() if "FileScan" in l][0]
    assert "l_shipdate" in scan and "PushedFilters: [IsNotNull(l_shipdate), GreaterThan(l_shipdate" in scan
    assert "l_orderkey" not in scan and "l_extendedprice" not in scan


def test_writer_tasks_rule(spark):
    cores = spark.sparkContext.defaultParallelism
    assert writer_tasks(spark, 256, 512 * 1024) == min(256, cores)
    assert writer_tasks(spark, 10**6, 10**15) == 10**6   # 10**15 bytes need 7.45 M tasks: capped by groups
    assert writer_tasks(spark, 100_000, 100 * (128 << 20)) == max(100, cores)
    assert writer_tasks(spark, 3, 10**12) == 3
