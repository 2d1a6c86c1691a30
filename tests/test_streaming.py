import pytest
from pyspark.sql import functions as F

from gridseries.operators import aggregate as A
from gridseries.plans import fixtures as fx
from gridseries.sources.catalog import open_catalog
from gridseries.sources.ingest import ingest
from gridseries.streaming import append_bands_stream
from tests.conftest import SF001


def test_stream_appends_later_bands(spark, out_dir):
    bands = fx.emb_bands(spark, SF001)
    base = f"{out_dir}/catalog"
    ingest(bands.filter("band <= 150 AND path_idx = 0"), base, 4, 2, k=64)
    arriving = f"{out_dir}/arriving"
    later = bands.filter("NOT (band <= 150 AND path_idx = 0)").drop("label")
    later.filter("path_idx = 0").write.parquet(f"{arriving}/a")
    later.filter("path_idx = 1").write.parquet(f"{arriving}/b")
    q = append_bands_stream(spark, f"{arriving}/*", base)
    q.awaitTermination(300)
    assert q.exception() is None
    cat = open_catalog(spark, base)
    assert cat.series.count() == 500 * 8
    # parts stay consistent with the fixed splits, so pruned reads still equal full reads
    pruned = cat.window(300, 420)
    full = cat.series.filter(F.col("time_id").between(300, 420))
    assert pruned.count() == full.count() == 121 * 8
    whole = A.mosaic_sum(cat.series, fx.EMB_LAYOUT)
    direct = A.mosaic_sum(fx.emb_series(spark, SF001), fx.EMB_LAYOUT)
    diff = whole.join(direct.withColumnRenamed("sum_v", "d"), ["cell_row", "cell_col"]) \
        .filter(F.abs(F.col("sum_v") - F.col("d")) > 1e-9)
    assert diff.count() == 0
    # a replay of the same input adds nothing (exactly-once sink)
    q2 = append_bands_stream(spark, f"{arriving}/*", base)
    q2.awaitTermination(300)
    assert open_catalog(spark, base).series.count() == 500 * 8


def test_stream_rejects_other_grids(spark, out_dir):
    bands = fx.emb_bands(spark, SF001)
    base = f"{out_dir}/catalog"
    ingest(bands.filter("path_idx = 0"), base, 4, 2, k=64)
    bands.filter("path_idx = 1").drop("label").withColumn("xmax", F.lit(181.0)).write.parquet(f"{out_dir}/bad")
    q = append_bands_stream(spark, f"{out_dir}/bad", base)
    try:
        q.awaitTermination(300)
    except Exception:
        pass
    assert q.exception() is not None and "differs from the catalog" in str(q.exception())
    assert open_catalog(spark, base).series.count() == 250 * 8


def test_time_count_after_an_append_and_strips_refused(spark, out_dir):
    from gridseries.plans import fixtures as fx
    from gridseries.sources.catalog import open_catalog
    from gridseries.sources.ingest import ingest
    from gridseries.streaming.append import append_bands_stream, refresh_time_count, tiled_stream

    bands = fx.emb_bands(spark, SF001).drop("label")
    ingest(bands.filter("path_idx = 0"), out_dir, 4, 2, k=64)
    bands.filter("path_idx = 1").write.parquet(f"{out_dir}-more")
    append_bands_stream(spark, f"{out_dir}-more", out_dir).awaitTermination(120)
    assert open_catalog(spark, out_dir).meta.time_count == 250
    assert refresh_time_count(spark, out_dir) == open_catalog(spark, out_dir).meta.time_count == 500
    with pytest.raises(ValueError, match="whole rasters"):
        tiled_stream(fx.emb_strips(spark, SF001), out_dir)
