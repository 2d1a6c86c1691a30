"""Property checks against plain-Python statements of the rules (few examples, each a Spark job)."""

import bisect
import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridseries.functions.timeid import time_id
from gridseries.model import CellType, Extent, GridMetadata, TileLayout
from gridseries.operators.aggregate import to_long
from gridseries.operators.parts import assign_part, splits_array, split_points
from gridseries.operators.tiling import tile_bands, tile_bands_long
from gridseries.sources import metadata as md

EPOCH = dt.datetime(1950, 1, 1, 12)
SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def _whole_days_toward_zero(ts: dt.datetime) -> int:
    delta = ts - EPOCH
    micros = (delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds
    q = abs(micros) // (86400 * 1_000_000)
    return q if micros >= 0 else -q


@SETTINGS
@given(st.lists(st.datetimes(min_value=dt.datetime(1800, 1, 1), max_value=dt.datetime(2200, 1, 1)),
                min_size=1, max_size=300))
def test_time_id_rule(spark, stamps):
    df = spark.createDataFrame([(s,) for s in stamps], "ts timestamp_ntz")
    got = [r[0] for r in df.select(time_id("ts")).collect()]
    assert got == [_whole_days_toward_zero(s) for s in stamps]


@SETTINGS
@given(st.lists(st.integers(-10**6, 10**6), min_size=0, max_size=40, unique=True),
       st.lists(st.integers(-2 * 10**6, 2 * 10**6), min_size=1, max_size=200))
def test_assign_part_is_binary_search(spark, splits, keys):
    splits = sorted(splits)
    df = spark.createDataFrame([(k,) for k in keys], "t int")
    got = [r[0] for r in df.select(assign_part("t", splits)).collect()]
    assert got == [bisect.bisect_left(splits, k) for k in keys]


@SETTINGS
@given(st.lists(st.integers(-50000, 50000), min_size=1, max_size=400), st.integers(0, 30))
def test_split_rule(spark, ids, k):
    series = spark.createDataFrame([(i,) for i in ids], "time_id int")
    distinct = sorted(set(ids))
    want = [t for i, t in enumerate(distinct, start=1) if k > 0 and i % k == 0]
    assert splits_array(split_points(series, k)) == want


@SETTINGS
@given(st.integers(1, 4), st.integers(1, 4), st.integers(1, 5), st.integers(1, 5))
def test_tiling_forms_agree(spark, tc, tr, pc, pr):
    lay = TileLayout(tc, tr, pc, pr)
    n = lay.cols * lay.rows
    bands = spark.range(2).select(F.col("id").cast("int").alias("time_id"),
                                  F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                                              lambda i: (i + F.col("id") * 1000).cast("double")).alias("cells"))
    a = to_long(tile_bands(bands, lay, lay.cols)).select("time_id", "tile_id", "pos", "v")
    b = tile_bands_long(bands, lay).select("time_id", "tile_id", "pos", "v")
    assert a.exceptAll(b).count() == 0 and a.count() == 2 * n
    # cell value idx lands at tile (r // pr) * tc + c // pc, position (r % pr) * pc + c % pc
    for row in a.filter("time_id = 0").collect():
        idx = int(row["v"])
        r, c = divmod(idx, lay.cols)
        assert row["tile_id"] == (r // pr) * tc + c // pc and row["pos"] == (r % pr) * pc + c % pc


@SETTINGS
@given(st.integers(0, 10**6), st.lists(st.integers(-10**6, 10**6), max_size=20),
       st.tuples(*[st.floats(-1e6, 1e6, allow_nan=False)] * 4), st.tuples(*[st.integers(1, 500)] * 4),
       st.sampled_from(["int8", "int16", "int32", "float32", "float64"]))
def test_metadata_json_round_trip(spark, n, splits, ext, lay, ct):
    meta = GridMetadata(n, tuple(sorted(splits)), Extent(*ext), TileLayout(*lay), CellType(ct))
    text = md.metadata_frame(spark, meta).select(md.metadata_to_json("metadata").alias("j"))
    back = text.select(md.metadata_from_json("j").alias("metadata")).first()["metadata"]
    assert md.to_record(back) == meta


@SETTINGS
@given(st.integers(1, 3), st.integers(1, 3), st.integers(1, 4), st.integers(1, 4),
       st.lists(st.integers(1, 5), min_size=1, max_size=12))
def test_strips_of_any_height_rebuild_tiles(spark, tc, tr, pc, pr, heights):
    from gridseries.operators.tiling import tile_strips

    lay = TileLayout(tc, tr, pc, pr)
    # cut the raster rows into consecutive strips of the drawn heights (cycled until covered)
    starts, r, i = [], 0, 0
    while r < lay.rows:
        h = min(heights[i % len(heights)], lay.rows - r)
        starts.append((r, h))
        r, i = r + h, i + 1
    n = lay.cols * lay.rows
    bands = spark.range(2).select(F.col("id").cast("int").alias("time_id"),
                                  F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                                              lambda j: (j + F.col("id") * 1000).cast("double")).alias("cells"))
    parts = F.array(*[F.struct(F.lit(s).alias("row0"), F.lit(h).alias("h")) for s, h in starts])
    strips = bands.select("time_id", F.inline(parts), "cells") \
        .select("time_id", "row0", F.slice("cells", F.col("row0") * lay.cols + 1, F.col("h") * lay.cols).alias("cells"))
    a = tile_strips(strips, lay, lay.cols).select("time_id", "tile_id", "cells")
    b = tile_bands(bands, lay, lay.cols).select("time_id", "tile_id", "cells")
    assert a.count() == b.count() == 2 * lay.n_tiles
    assert a.exceptAll(b).count() == 0
