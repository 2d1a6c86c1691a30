import datetime as dt

import duckdb
from pyspark.sql import functions as F

from gridseries.functions.timeid import range_length, time_date, time_id
from tests.conftest import SF01


def _ids(spark, stamps):
    df = spark.createDataFrame([(s,) for s in stamps], "ts timestamp_ntz")
    return [r[0] for r in df.select(time_id("ts")).collect()]


def test_noon_epoch(spark):
    stamps = [dt.datetime(2049, 1, 1, 12), dt.datetime(2049, 1, 1, 0), dt.datetime(2050, 1, 1, 12)]
    assert _ids(spark, stamps) == [36160, 36159, 36525]


def test_before_epoch_cuts_toward_zero(spark):
    stamps = [dt.datetime(1950, 1, 1, 0), dt.datetime(1949, 12, 31, 0), dt.datetime(1949, 12, 30, 13)]
    assert _ids(spark, stamps) == [0, -1, -1]


def test_time_id_is_int(spark):
    df = spark.createDataFrame([(dt.datetime(2000, 1, 1),)], "ts timestamp_ntz").select(time_id("ts").alias("t"))
    assert dict(df.dtypes)["t"] == "int"


def test_time_date_inverts(spark):
    df = spark.range(-3, 40000, 997).select(F.col("id").cast("int").alias("t"))
    back = df.select("t", time_id(time_date("t")).alias("u")).filter("t <> u")
    assert back.count() == 0
    row = spark.range(1).select(time_date(F.lit(0)).alias("d")).first()
    assert row["d"] == dt.datetime(1950, 1, 1, 12)


def test_range_length(spark):
    assert spark.range(1).select(range_length(F.lit(10), F.lit(25))).first()[0] == 15


def test_events_days_turn_at_noon(spark):
    ev = spark.read.parquet(f"{SF01}/events.parquet").select(time_id("ts").alias("t"))
    got = ev.agg(F.min("t"), F.max("t"), F.count_distinct("t")).first()
    assert tuple(got) == (27027, 27057, 31)


def test_matches_duckdb_on_shipdates(spark):
    li = spark.read.parquet(f"{SF01}/lineitem.parquet").select("l_shipdate").distinct()
    mine = {(r[0], r[1]) for r in li.select("l_shipdate", time_id("l_shipdate")).collect()}
    theirs = set(duckdb.sql(
        f"SELECT DISTINCT l_shipdate, CAST(date_sub('day', TIMESTAMP '1950-01-01 12:00:00', l_shipdate) AS INTEGER)"
        f" FROM '{SF01}/lineitem.parquet'").fetchall())
    assert mine == theirs
    assert min(t for _, t in mine) == 16436


def test_timestamp_window_pushdown_is_exact(spark):
    from gridseries.operators.filters import filter_time, filter_time_ts

    stamps = [dt.datetime(1949, 12, 30, 13), dt.datetime(1949, 12, 31, 0), dt.datetime(1950, 1, 1, 0),
              dt.datetime(1950, 1, 1, 11, 59), dt.datetime(1950, 1, 1, 12), dt.datetime(1950, 1, 2, 11, 59),
              dt.datetime(1950, 1, 2, 12), dt.datetime(2049, 1, 1, 0), dt.datetime(2049, 1, 1, 12)]
    df = spark.createDataFrame([(s,) for s in stamps], "ts timestamp_ntz")
    full = df.withColumn("time_id", time_id("ts"))
    for a, b in [(-1, 0), (0, 0), (0, 1), (1, 1), (-5, 36160), (36159, 36160), (-10**7, 10**7), (None, 0), (1, None)]:
        got = sorted(r["ts"] for r in filter_time_ts(df, "ts", a, b).collect())
        want = sorted(r["ts"] for r in filter_time(full, a, b).collect())
        assert got == want, (a, b)
    plan = filter_time_ts(df, "ts", 10, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "ts#" in plan
