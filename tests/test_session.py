from gridseries.session import _looks_generated, new_output_path, path_exists, shared_dir


def test_shared_dir_follows_checkpoint_dir(spark):
    d = shared_dir(spark)
    ck = spark.sparkContext.getCheckpointDir()
    assert ck.startswith(d)
    assert not _looks_generated(d)
    p1, p2 = new_output_path(spark, "x"), new_output_path(spark, "x")
    assert p1 != p2 and p1.startswith(d.rstrip("/") + "/gridseries/x-")
    assert not path_exists(spark, p1)


def test_generated_suffix_detection():
    assert _looks_generated("file:/tmp/checkpoints/1b4e28ba-2fa1-11d2-883f-0016d3cca427")
    assert not _looks_generated("hdfs://nn/shared/checkpoints")


def test_no_local_fallback_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    import pytest

    conf = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=context, conf=conf))


def test_remove_path(spark, out_dir):
    from gridseries.session import remove_path

    spark.range(3).write.parquet(out_dir)
    remove_path(spark, out_dir)
    assert not path_exists(spark, out_dir)
    remove_path(spark, out_dir)
