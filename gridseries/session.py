"""Session helpers: builder defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
import warnings
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "gridseries",
                  extra: dict | None = None) -> SparkSession:
    """A session with the settings the library expects (AQE on, UTC)."""
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide scratch folder: ``spark.checkpoint.dir`` of the session.

    On a cluster this must name shared storage (HDFS, object store), and it is
    an error if it is unset.  Only a session that runs on one machine (a local
    master, as in tests) gets a fresh local folder.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        # getCheckpointDir() returns a per-application sub folder; keep its parent.
        return d.rsplit("/", 1)[0] if _looks_generated(d) else d
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf = tempfile.mkdtemp(prefix="gridseries-ckpt-")
    sc.setCheckpointDir(conf)
    return conf


def _looks_generated(path: str) -> bool:
    tail = path.rstrip("/").rsplit("/", 1)[-1]
    try:
        uuid.UUID(tail)
        return True
    except ValueError:
        return False


def new_output_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder (never reused, so retries are safe)."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/gridseries/{name}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system of the path (works on any FS)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder (none if it is not there)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(hpath)] if fs.exists(hpath) else []


def read_file(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    stream = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(hpath)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """A small text file put in place whole: written beside ``path``, then renamed over it.

    Where the file system renames atomically (HDFS, local), readers see the old
    file or the new one and nothing else.  An object store copies: the file is
    small and whole beside its place until then.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{target.getName()}.{uuid.uuid4().hex[:12]}")
    fs = target.getFileSystem(conf)
    if fs.exists(target) and fs.getFileStatus(target).isDirectory():
        fs.delete(target, True)  # a record of an older layout
    out = fs.create(beside, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = getattr(jvm.org.apache.hadoop.fs.Options, "Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(
        fs.makeQualified(beside), fs.makeQualified(target), rename)


_memo: dict = {}
_memo_lock = threading.RLock()


def session_cached(spark: SparkSession, key, factory):
    """Build a DataFrame / handle once per session (plans and file listings, not data).

    Inputs and catalogs are immutable once written, so their relations and
    metadata can be reused by every query of the session.
    """
    k = (spark.sparkContext.applicationId, key)
    with _memo_lock:
        if k not in _memo:
            _memo[k] = factory()
        return _memo[k]


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder through its Hadoop file system, if it is there."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hpath, True)


def estimated_bytes(df: DataFrame) -> int:
    """The planner's estimate of a table's size (of a file scan: its files); no job is run."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


READER_BATCH_BYTES = 32 << 20
_BATCH_KEY = "spark.sql.parquet.columnarReaderBatchSize"


def reader_batch(row_bytes: int, current: int = 4096, target_bytes: int = READER_BATCH_BYTES) -> int:
    """Rows per vectorized Parquet batch that keep it near ``target_bytes`` for rows of ``row_bytes``; never above ``current``."""
    return max(1, min(int(current), int(target_bytes) // max(1, int(row_bytes))))


@contextmanager
def guarded_reader(spark: SparkSession, row_bytes: int):
    """Jobs started inside read rows of ``row_bytes`` in bounded batches; the session's setting comes back afterwards.

    Catalog rows hold whole tiles (e.g. 512 x 512 floats = 1 MB); at the
    default 4,096 rows per batch one task would need gigabytes.
    """
    before = spark.conf.get(_BATCH_KEY, "4096")
    spark.conf.set(_BATCH_KEY, str(reader_batch(row_bytes, int(before))))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_KEY, before)


def check_reader(spark: SparkSession, row_bytes: int) -> None:
    """Warn when a session's batch size would make batches of tiles far larger than intended."""
    batch = int(spark.conf.get(_BATCH_KEY, "4096"))
    if batch > reader_batch(row_bytes, batch):
        warnings.warn(f"{_BATCH_KEY}={batch} makes batches of {batch * row_bytes >> 20} MB for this catalog; "
                      f"set it to {reader_batch(row_bytes, batch)} or read inside guarded_reader()", stacklevel=3)


__all__ = ["estimated_bytes", "read_file", "replace_file", "list_names", "check_reader", "guarded_reader", "reader_batch", "remove_path", "session_cached", "build_session", "shared_dir",
           "new_output_path", "path_exists"]
