"""Parts of time ids that moved or are new: the binned range join, catalogs after a time change, the stream."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from gridseries.operators import aggregate as A
from gridseries.operators.filters import filter_time, filter_windows, window_parts
from gridseries.operators.parts import INT_MAX, INT_MIN, bin_bits, locate_parts, part_bins
from gridseries.plans import fixtures as fx
from gridseries.sources import catalog as cat
from gridseries.sources.ingest import ingest
from tests.conftest import SF001


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def emb_cat(spark):
    from gridseries.session import new_output_path

    return ingest(fx.emb_bands(spark, SF001), new_output_path(spark, "test-locate"), 4, 2, k=64)


@pytest.mark.parametrize("splits", [[], [0], [-1], [INT_MIN, INT_MAX], list(range(-300, 300)), [5, 6, 7, 100000, 100001],
                                    sorted(random.Random(1).sample(range(-10**6, 10**6), 500))])
def test_every_time_id_finds_its_part(spark, splits):
    near = [s + d for s in splits[:200] for d in (-1, 0, 1)] + [0, 1, -1, 4095, 4096, -4096, 10**6, INT_MIN, INT_MAX]
    times = [t for t in near if INT_MIN <= t <= INT_MAX]
    df = spark.createDataFrame([(t, 99) for t in times] + [(None, 99)], "time_id int, part int")
    got = locate_parts(df, splits).collect()
    assert len(got) == len(times) + 1
    assert all(r.part == (None if r.time_id is None else bisect.bisect_left(splits, r.time_id)) for r in got)


def test_bins_stay_small(spark):
    for splits in (list(range(0, 640000, 64)), list(range(5000)), [0, 10**9]):
        bins = part_bins(spark, splits)
        inside = [r[0] for r in bins.select(F.size("__inside")).collect()]
        assert sum(inside) == len(splits) and max(inside) <= 4096
        assert 6 <= bin_bits(splits) <= 12
    assert max(r[0] for r in part_bins(spark, list(range(0, 640000, 64))).select(F.size("__inside")).collect()) <= 128


@pytest.mark.parametrize("days", [10, -70, 1000, -1000])
def test_windows_after_a_time_change(spark, emb_cat, days):
    moved = emb_cat.map_tiles({"time_id": F.col("time_id") + days})
    for start, end in ((64, 73), (100, 200), (None, 0), (490, None), (1490, 1600)):
        want = filter_time(moved.series, start, end)
        got = moved.between(start, end).series
        assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert moved.between(64, 73).series.count() == (80 if days in (10, -70) else 0)


def test_moved_series_written_and_opened_again(spark, emb_cat, out_dir):
    def later(pdf):
        return pdf.assign(time_id=pdf["time_id"] + 10)

    for i, moved in enumerate((emb_cat.map_tiles({"time_id": F.col("time_id") + 10}), emb_cat.map_tiles(later))):
        for k in (None, 32):
            moved.write(f"{out_dir}/{i}-{k}", k=k)
            back = cat.open_catalog(spark, f"{out_dir}/{i}-{k}")
            assert len(back.meta.splits) == (7 if k is None else 15)
            assert back.window(64, 73).count() == 80
            assert back.window(64, 73).exceptAll(filter_time(back.series, 64, 73)).count() == 0
            assert back.series.drop("part").exceptAll(moved.series.drop("part")).count() == 0
    assert emb_cat.map_tiles({"cells": F.col("cells")}).series.schema == emb_cat.series.schema  # parts kept: no look-up
    assert "__inside" not in plan(emb_cat.map_tiles({"cells": F.col("cells")}).series)


def test_to_records_with_splits(emb_cat):
    stale = emb_cat.series.withColumn("time_id", F.col("time_id") + 10)
    fresh = cat.to_records(stale, emb_cat.meta.splits)
    bad = fresh.filter(F.col("part") != F.size(F.filter(F.array(*map(F.lit, emb_cat.meta.splits)), lambda s: s < F.col("time_id"))))
    assert bad.count() == 0 and fresh.columns == ["tile_id", "part", "time_id", "cells"]


def test_many_windows_in_one_plan(spark, emb_cat):
    rows = [(1, 10, 20), (2, 100, 200), (3, 150, 160), (4, None, 5), (5, 495, None), (6, 40, 30), (7, 5000, 6000)]
    windows = spark.createDataFrame(rows, "w int, start int, end int")
    hits = filter_windows(emb_cat.series, windows, list(emb_cat.meta.splits))
    got = {(r.w, r.n) for r in hits.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(1, 88), (2, 101 * 8), (3, 88), (4, 48), (5, 40)}
    want = emb_cat.series.join(windows, F.expr("time_id >= coalesce(start, -2147483648) and time_id <= coalesce(end, 2147483647)"))
    assert hits.exceptAll(want.select(hits.columns)).count() == 0
    assert window_parts(windows, []).select("part").distinct().count() == 1
    with pytest.raises(ValueError, match="time_id"):
        filter_windows(emb_cat.series, windows.withColumnRenamed("w", "time_id"), [])


def test_windows_prune_parts_at_run_time(spark, emb_cat, out_dir):
    spark.createDataFrame([(1, 70, 80), (2, 200, 210)], "w int, start int, end int").write.parquet(out_dir)
    hits = emb_cat.windows(spark.read.parquet(out_dir))
    assert "dynamicpruning" in plan(hits)
    counted = hits.groupBy("w").count()
    assert sorted(map(tuple, counted.collect())) == [(1, 88), (2, 88)]
    text = counted._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruningexpression(true)" not in text
    # large windows tables are joined by a shuffle, without a broadcast of unknown size
    from gridseries.operators import filters
    old, filters.WINDOW_BYTES = filters.WINDOW_BYTES, 0
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        far = emb_cat.windows(spark.read.parquet(out_dir))
        assert far.exceptAll(hits).count() == 0 and far.count() == hits.count()
    finally:
        filters.WINDOW_BYTES = old
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stream_looks_parts_up_among_many_splits(spark, out_dir):
    from dataclasses import replace

    from gridseries.sources.metadata import store_metadata
    from gridseries.streaming.append import append_bands_stream, tiled_stream

    bands = fx.emb_bands(spark, SF001).drop("label")
    c = ingest(bands.filter("path_idx = 0"), out_dir, 4, 2, k=64)
    splits = tuple(range(-40000, 160000, 2))  # 100,000
    store_metadata(spark, replace(c.meta, splits=splits), out_dir)
    more = bands.filter("path_idx = 1")
    text = tiled_stream(more, out_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "BroadcastHashJoin" in plan(tiled_stream(more, out_dir)) and len(text) < 20000  # no list of splits in the plan
    more.write.parquet(f"{out_dir}-more")
    append_bands_stream(spark, f"{out_dir}-more", out_dir).awaitTermination(240)
    rows = spark.read.parquet(f"{out_dir}/stream").select("part", "time_id").distinct().collect()
    assert len(rows) == 250 and all(r.part == bisect.bisect_left(splits, r.time_id) for r in rows)


def test_streamed_rows_are_pruned_by_part(spark, out_dir):
    from gridseries.streaming.append import append_bands_stream

    bands = fx.emb_bands(spark, SF001).drop("label")
    ingest(bands.filter("path_idx = 0"), out_dir, 4, 2, k=64)
    bands.filter("path_idx = 1").write.parquet(f"{out_dir}-more")
    append_bands_stream(spark, f"{out_dir}-more", out_dir).awaitTermination(240)
    c = cat.open_catalog(spark, out_dir)
    w = c.window(64, 100)
    assert w.count() == 37 * 8
    scans = [line for line in plan(w).splitlines() if "Scan parquet" in line]
    assert len(scans) == 2 and all("part" in line.split("PartitionFilters: [")[1].split("]")[0] for line in scans)
    assert c.window(240, 300).count() == 61 * 8
    assert A.time_count(c.series).first()[0] == 500
