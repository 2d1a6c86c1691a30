"""Error-free sums: equal bits in both forms and for any partitioning, and equal to exact arithmetic."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridseries.model import TileLayout
from gridseries.operators import aggregate as A
from gridseries.operators import exact as X

LAYOUT = TileLayout(1, 1, 3, 1)


def bits(df, *keys):
    return {tuple(r[k] for k in keys): r["sum_v"] for r in df.collect()}


def same(a, b):
    return (a != a and b != b) or (a == b and math.copysign(1, a) == math.copysign(1, b))


def values(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        kind = rng.randrange(6)
        out.append([1e16, 1.0, -1e16, rng.uniform(-1, 1) * 10.0 ** rng.randrange(-300, 300), rng.gauss(0, 1),
                    5e-324 * rng.randrange(1, 9)][kind])
    return out


@pytest.mark.parametrize("method", ["explode", "arrow"])
@pytest.mark.parametrize("parts", [1, 3, 7])
def test_cancelling_sums_for_any_partitioning(spark, method, parts):
    rows = [(0, i, [v, w, 0.1]) for i, (v, w) in enumerate(zip([1e16, 1.0, -1e16] * 400, values(1200)))]
    s = spark.createDataFrame(rows, "tile_id int, time_id int, cells array<double>").repartition(parts, F.hash("time_id"))
    got = bits(A.tile_sum(s, LAYOUT, method=method, exact=True), "pos")
    for pos in range(3):
        want = sum((Fraction(r[2][pos]) for r in rows), Fraction(0))
        assert same(got[(pos,)], float(want)), pos
    assert got[(0,)] == 400.0


def test_both_forms_with_keys_and_means(spark):
    rng = random.Random(2)
    layout = TileLayout(2, 1, 2, 1)
    rows = [(i % 2, i, rng.choice(["a", None]), [rng.gauss(0, 1) * 10 ** rng.randrange(-20, 20), float(i)]) for i in range(300)]
    s = spark.createDataFrame(rows, "tile_id int, time_id int, label string, cells array<double>")
    one, two = (bits(A.tile_sum(s.repartition(n), layout, keys=["label"], method=m, exact=True), "label", "tile_id", "pos")
                for m, n in (("explode", 3), ("arrow", 5)))
    assert one == two
    for (label, tile, pos), v in one.items():
        assert v == float(sum((Fraction(r[3][pos]) for r in rows if r[0] == tile and r[2] == label), Fraction(0)))
    means = [{(r.cell_row, r.cell_col): r.mean_v for r in A.mosaic_mean(s.repartition(n), layout, method=m, exact=True).collect()}
             for m, n in (("explode", 2), ("arrow", 6))]
    assert means[0] == means[1] and len(means[0]) == 4


@pytest.mark.parametrize("method", ["explode", "arrow"])
def test_nan_infinities_nulls_and_empty(spark, method):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [nan, inf, -0.0]), (0, 2, [1.0, 1.0, None]), (0, 3, None), (0, 4, [1.0, inf, 0.0])]
    s = spark.createDataFrame(rows, "tile_id int, time_id int, cells array<double>")
    got = bits(A.tile_sum(s, LAYOUT, method=method, exact=True), "pos")
    assert math.isnan(got[(0,)]) and got[(1,)] == inf and got[(2,)] == 0.0
    both = s.union(spark.createDataFrame([(0, 5, [0.0, -inf, 1e308]), (0, 6, [0.0, 0.0, 1e308])], s.schema))
    got = bits(A.tile_sum(both, LAYOUT, method=method, exact=True), "pos")
    assert math.isnan(got[(1,)]) and got[(2,)] == inf  # beyond the range of doubles
    assert set(bits(A.tile_sum(s.filter("false"), LAYOUT, method=method, exact=True), "pos").values()) == {0.0}


def test_digits_lose_nothing():
    rng = np.random.default_rng(4)
    v = rng.standard_normal(5000) * 2.0 ** rng.integers(-1074, 1020, 5000)
    v = np.concatenate([v, [5e-324, -5e-324, 1.7976931348623157e308, 2.0 ** 32, 2.0 ** -32, np.nextafter(2.0 ** 32, 0), 1.0, 0.0]])
    bins, digits, special = X.split(v)
    assert not special.any() and (np.abs(digits[0]) <= 2 ** 32).all() and (np.abs(digits[1:]) <= 2 ** 27).all()
    ends = np.arange(len(v) + 1)
    assert (X.round_groups(bins, *digits, ends) == v).all()


def test_jvm_digits_lose_nothing(spark):
    v = values(600, 9) + [5e-324, 1.7976931348623157e308, -2.0 ** 32, 2.0 ** -32, float(np.nextafter(2.0 ** 32, 0)), 0.0, -1e-310]
    df = spark.createDataFrame(list(enumerate(v)), "k int, v double")
    got = {r.k: r.sum_v for r in X.exact_sums(df, ["k"]).collect()}
    assert [got[i] for i in range(len(v))] == v
