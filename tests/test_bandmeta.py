import pytest
from pyspark.sql import functions as F

from gridseries.functions.bandmeta import band_time, band_value


def _meta(spark, entries):
    return spark.createDataFrame([(entries,)], "m array<string>")


def test_last_duplicate_wins_and_truncates(spark):
    df = _meta(spark, ["A=1", "NETCDF_DIM_Time=15.5", "NETCDF_DIM_Time=16.9"])
    assert df.select(band_time("m")).first()[0] == 16
    assert df.select(band_value("m", "A")).first()[0] == "1"
    assert df.select(band_value("m", "B")).first()[0] is None


def test_second_item_only(spark):
    df = _meta(spark, ["K=a=b", "NETCDF_DIM_Time=-2.7"])
    assert df.select(band_value("m", "K")).first()[0] == "a"
    assert df.select(band_time("m")).first()[0] == -2


@pytest.mark.parametrize("entries", [["K"], ["K="], ["A=1"], ["NETCDF_DIM_Time=abc"], ["NETCDF_DIM_Time=NaN"],
                                     ["NETCDF_DIM_Time=1e12"]])
def test_errors(spark, entries):
    df = _meta(spark, entries + (["NETCDF_DIM_Time=3"] if entries[0].startswith("K") else []))
    with pytest.raises(Exception):
        df.select(band_time("m")).collect()


def test_applies_per_row(spark):
    df = spark.range(5).select(F.array(F.concat(F.lit("NETCDF_DIM_Time="), F.col("id").cast("string"))).alias("m"))
    assert [r[0] for r in df.select(band_time("m")).collect()] == [0, 1, 2, 3, 4]
