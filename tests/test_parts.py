import random

import pytest
from pyspark.sql import functions as F

from gridseries.operators import parts as P

SPLITS = [100, 200, 400, 600]


def test_part_ranges_fixture(spark):
    s = spark.createDataFrame([(i, v) for i, v in enumerate(SPLITS)], "part int, split int")
    got = sorted(tuple(r) for r in P.part_ranges(s).collect())
    assert got == [(0, -2147483648, 100), (1, 101, 200), (2, 201, 400), (3, 401, 600), (4, 601, 2147483647)]


def test_part_ranges_without_splits(spark):
    s = spark.createDataFrame([], "part int, split int")
    assert [tuple(r) for r in P.part_ranges(s).collect()] == [(0, -2147483648, 2147483647)]


def test_assign_part_fixture(spark):
    keys = [-5, 99, 100, 101, 600, 601]
    df = spark.createDataFrame([(k,) for k in keys], "t int")
    got = [r[0] for r in df.select(P.assign_part("t", SPLITS)).collect()]
    assert got == [0, 0, 0, 1, 3, 4]
    assert [P.assign_part_value(k, SPLITS) for k in keys] == got
    arr = df.select(P.assign_part("t", F.array(*[F.lit(s) for s in SPLITS]))).collect()
    assert [r[0] for r in arr] == got


def test_assign_part_random(spark):
    rnd = random.Random(7)
    splits = sorted(rnd.sample(range(-5000, 5000), 40))
    keys = [rnd.randint(-6000, 6000) for _ in range(2000)] + splits
    df = spark.createDataFrame([(k,) for k in keys], "t int")
    got = [r[0] for r in df.select(P.assign_part("t", splits)).collect()]
    assert got == [P.assign_part_value(k, splits) for k in keys]
    # every time id falls in exactly one part range
    rows = spark.createDataFrame(list(enumerate(splits)), "part int, split int")
    ranges = {r["part"]: (r["part_min"], r["part_max"]) for r in P.part_ranges(rows).collect()}
    assert all(ranges[p][0] <= k <= ranges[p][1] for k, p in zip(keys, got))


@pytest.mark.parametrize("k,expected", [(0, []), (1, list(range(10))), (10, [9]), (11, [])])
def test_split_rule(spark, k, expected):
    series = spark.range(10).select(F.col("id").cast("int").alias("time_id"))
    got = P.splits_array(P.split_points(series, k))
    assert got == expected


def test_split_points_every_kth(spark):
    series = spark.range(500).select(F.col("id").cast("int").alias("time_id"))
    assert P.splits_array(P.split_points(series, 64)) == [63, 127, 191, 255, 319, 383, 447]


def test_ranks_across_buckets_and_duplicates(spark):
    rnd = random.Random(3)
    ids = [rnd.randint(-20000, 20000) for _ in range(3000)]
    series = spark.createDataFrame([(i,) for i in ids + ids[:500]], "time_id int")
    got = {r["time_id"]: r["rn"] for r in P.time_ranks(series).collect()}
    want = {t: i + 1 for i, t in enumerate(sorted(set(ids)))}
    assert got == want


def test_time_parts_consistent_with_assign(spark):
    rnd = random.Random(5)
    ids = sorted(set(rnd.randint(0, 30000) for _ in range(1500)))
    series = spark.createDataFrame([(i,) for i in ids], "time_id int")
    k = 37
    splits = P.splits_array(P.split_points(series, k))
    tp = {r["time_id"]: r["part"] for r in P.time_parts(series, k).collect()}
    assert all(tp[t] == P.assign_part_value(t, splits) for t in ids)


def test_blocks_per_part_uses_long_math():
    assert P.blocks_per_part(64 * 1024 * 1024, 720, 360, 4) == 64
    assert P.blocks_per_part(2 ** 40, 100000, 100000, 8) == 13
    assert P.blocks_per_part(10, 100, 100, 8) == 0


def test_attach_parts_leaves_the_join_to_the_planner(spark):
    series = spark.range(300).select((F.col("id") % 100).cast("int").alias("time_id"), F.col("id").alias("x"))
    parts = P.time_parts(series, 7)
    out = P.attach_parts(series, parts)
    assert out.count() == 300 and {r["part"] for r in out.filter("time_id = 99").collect()} == {99 // 7}
    hints = spark.createDataFrame([(1, 0, False)], "time_id int, part int, is_split boolean")
    assert "ResolvedHint" not in P.attach_parts(series, hints)._jdf.queryExecution().analyzed().toString()
