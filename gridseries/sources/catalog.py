"""On-disk catalog: ``<out>/metadata.json`` + ``<out>/cells/tile_id=T/part=P/*.parquet``.

Each file holds one tile's records of one time part in ascending time order,
so a window reads only its parts (directory pruning) and, inside a file, only
row groups whose ``time_id`` range meets the window (Parquet statistics).

Where that would be more than ``MOST_FOLDERS`` folders of small parts,
consecutive parts share a folder (``tile_id=T/folder=F``, F = part // parts per
folder, see ``parts_per_folder``) and ``part`` is a column of the files, so the
number of files follows the bytes and not the number of parts.

A catalog is replaced without a gap: the new cells go to a folder of their own
(``cells-<version>``), the metadata record that names the version is put in
place last, by one rename, and only then the old folders go.  A replacement
that breaks off leaves the old catalog as it was, and a catalog may be replaced
by a series derived from itself.  ``<cells>/_occupied.json`` lists which folders
each tile has, as rectangles (tiles, folders), and the parts per folder, so a
window builds its folders' paths instead of searching for them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseries.model import CellType, GridMetadata
from gridseries.operators.filters import filter_windows, part_bounds, prune_parts
from gridseries.operators.parts import locate_parts, time_parts
from gridseries.session import check_reader, list_names, path_exists, read_file, remove_path, replace_file
from gridseries.sources.metadata import load_metadata, store_metadata

RECORD_COLUMNS = ("tile_id", "part", "time_id", "cells")


class Catalog:
    """An opened catalog: metadata on the driver, every tile's series as one DataFrame.

    The methods mirror a raster series: ``filter``/``map_tiles``/``cache``
    return a new Catalog over the derived series; ``sum``/``mean``/
    ``time_count``/``min_max`` return DataFrames (long form, nothing collected).

    ``series`` is built on first use; ``tile`` and ``window`` of an opened
    catalog list only the folders they read.
    """

    def __init__(self, path: str, meta: GridMetadata, series: DataFrame | None = None, spark: SparkSession | None = None):
        self.path, self.meta, self._series, self.spark = path, meta, series, spark or series.sparkSession
        self.stored = series is None
        self._listing = None

    @property
    def series(self) -> DataFrame:
        if self._series is None:
            self._series = _stored(self.spark, self.path, self.meta, per_folder=self.per_folder()).select(*RECORD_COLUMNS)
        return self._series

    def tile(self, tile_id: int) -> DataFrame:
        return scan_tile(self, tile_id)

    def window(self, start: int | None = None, end: int | None = None) -> DataFrame:
        splits = list(self.meta.splits)
        if not self.stored or start is not None and end is not None and start > end:
            return prune_parts(self.series, splits, start, end)
        lo, hi = part_bounds(splits, start, end)
        series = _stored(self.spark, self.path, self.meta, parts=(lo, hi), occupied=self.occupied(), per_folder=self.per_folder())
        return prune_parts(series.select(*RECORD_COLUMNS), splits, start, end)

    def windows(self, windows: DataFrame, start_col: str = "start", end_col: str = "end") -> DataFrame:
        """The records of many time windows in one plan (see ``filter_windows``); only touched parts are read."""
        splits, n = list(self.meta.splits), self.per_folder()
        if n == 1:
            return filter_windows(self.series, windows, splits, start_col, end_col)
        series = _stored(self.spark, self.path, self.meta, per_folder=n)
        return filter_windows(series, windows, splits, start_col, end_col, {FOLDER: folder_of("part", n)}).drop(FOLDER)

    def occupied(self) -> list[list[int]] | None:
        """Which folders an opened catalog has: [first tile, last tile, first folder, last folder], or None if not listed.

        A folder holds one part, or ``per_folder()`` of them.
        """
        return self._list()[0]

    def per_folder(self) -> int:
        """Parts per folder of an opened catalog."""
        return self._list()[1]

    def _list(self) -> tuple[list[list[int]] | None, int]:
        if not self.stored:
            return None, 1
        if self._listing is None:
            self._listing = _read_occupied(self.spark, _cells_path(self.path, self.meta))
        return self._listing

    def extents(self) -> DataFrame:
        """Bounds of every tile, from the metadata."""
        from gridseries.operators.tiling import tile_extents

        return tile_extents(self.spark, self.meta.extent, self.meta.layout)

    def write(self, out: str, mode: str = "errorifexists", k: int | None = None) -> "Catalog":
        """Write this (derived) series as a catalog: cells, then the metadata record; time steps are counted anew.

        The series keeps its time parts, or gets new ones of ``k`` steps each.
        ``out`` may be the catalog's own path (``mode="overwrite"``); handles
        opened before a replacement cannot be read after it.
        """
        version = prepare_output(self.spark, out, mode)
        series, splits = self.series, self.meta.splits
        cell_type = CellType.from_spark(series.schema["cells"].dataType.elementType)
        if k is not None:
            parts = time_parts(series.select("time_id"), k)
            splits = tuple(int(r["time_id"]) for r in parts.filter("is_split").orderBy("time_id").collect())
            # looked up in the split list (no shuffle); a record without a time has no place in a part
            series = locate_parts(series.drop("part").filter(F.col("time_id").isNotNull()), splits)
        meta = replace(self.meta, splits=splits, cell_type=cell_type, extra={"version": version} if version else {})
        n_tiles, record_bytes = meta.layout.n_tiles, meta.layout.cells_per_tile * cell_type.bytes
        total_bytes = meta.time_count * n_tiles * record_bytes
        per_folder = parts_per_folder(n_tiles, meta.n_parts, total_bytes)
        n_tasks = writer_tasks(self.spark, n_tiles * -(-meta.n_parts // per_folder), total_bytes)
        path = write_catalog(series, out, n_tasks=n_tasks, n_parts=meta.n_parts, record_bytes=record_bytes, version=version,
                             per_folder=per_folder)
        cells = self.spark.read.schema(record_schema(cell_type.spark_type, per_folder)).parquet(path)
        folder = F.col("part" if per_folder == 1 else FOLDER).alias("part")
        counts = cells.groupBy("tile_id", folder).agg(F.count(F.lit(1)).alias("n")).checkpoint()
        n = counts.filter("tile_id = 0").agg(F.sum("n")).first()[0] or 0
        write_occupied(self.spark, path, occupied_folders(counts), per_folder)
        return publish(self.spark, out, replace(meta, time_count=int(n)))

    def create_view(self, name: str) -> str:
        """Register the series as a temporary view for ``spark.sql`` (same plan, same pruning)."""
        self.series.createOrReplaceTempView(name)
        return name

    def _derive(self, series: DataFrame) -> "Catalog":
        return Catalog(self.path, self.meta, series)

    def between(self, start: int | None = None, end: int | None = None) -> "Catalog":
        """The catalog restricted to a time window (parts pruned)."""
        return self._derive(self.window(start, end))

    def filter(self, predicate) -> "Catalog":
        from gridseries.operators.filters import filter_series

        return self._derive(filter_series(self.series, predicate))

    def map_tiles(self, f) -> "Catalog":
        """A map over the records.  Where it may change the time id (a Python function, or a ``time_id`` expression)
        the records' time parts are looked up anew, so windows and writes of the result hold."""
        from gridseries.operators.filters import map_tiles

        mapped = map_tiles(self.series, f)
        if isinstance(f, dict) and "time_id" not in f:
            return self._derive(mapped)
        return self._derive(locate_parts(mapped.withColumn("time_id", F.col("time_id").cast("int")), list(self.meta.splits)))

    def cache(self) -> "Catalog":
        return self._derive(cache_series(self.series))

    def uncache(self) -> "Catalog":
        return self._derive(uncache_series(self.series))

    def time_count(self) -> DataFrame:
        from gridseries.operators.aggregate import time_count

        return time_count(self.series)

    def sum(self, method: str = "auto", exact: bool = False) -> DataFrame:
        """Cell sums; ``exact``: rounded once, the same bits for any order of the records."""
        from gridseries.operators.aggregate import mosaic_sum

        return mosaic_sum(self.series, self.meta.layout, method=method, exact=exact)

    def mean(self, method: str = "auto", exact: bool = False) -> DataFrame:
        from gridseries.operators.aggregate import mosaic_mean

        return mosaic_mean(self.series, self.meta.layout, method=method, exact=exact)

    def min_max(self, method: str = "auto", of: str = "mean") -> DataFrame:
        """Min and max over the cells of the mean raster, or of the sum raster (``of="sum"``)."""
        from gridseries.operators.aggregate import min_max

        if of == "sum":
            return min_max(self.sum(method), "sum_v")
        return min_max(self.mean(method), "mean_v")


def record_schema(cell_type: T.DataType, per_folder: int = 1) -> T.StructType:
    return T.StructType([
        T.StructField("tile_id", T.IntegerType(), False),
        *([T.StructField(FOLDER, T.IntegerType(), False)] if per_folder > 1 else []),
        T.StructField("part", T.IntegerType(), False),
        T.StructField("time_id", T.IntegerType(), False),
        T.StructField("cells", T.ArrayType(cell_type, True), True),
    ])


#: Directory column of catalogs whose parts share folders.
FOLDER = "folder"
MOST_FOLDERS = 512  # up to here every part has a folder of its own, whatever its size


def parts_per_folder(n_tiles: int, n_parts: int, total_bytes: int, target_bytes: int = 128 << 20) -> int:
    """How many consecutive parts of a tile share a folder.

    One, unless that makes more than ``MOST_FOLDERS`` folders; then as many as
    bring the folders down to that number or fill ``target_bytes``, whichever
    is fewer.  Folders and files thus grow with the bytes only.
    """
    part_bytes = max(1, int(total_bytes) // max(1, n_tiles * n_parts))
    return max(1, min(-(-n_tiles * n_parts // MOST_FOLDERS), int(target_bytes) // part_bytes, n_parts))


def folder_of(part, per_folder: int) -> F.Column:
    """Number of the folder that holds a part."""
    part = F.col(part) if isinstance(part, str) else part
    return part if per_folder == 1 else F.floor(part / per_folder).cast("int")


def to_records(series: DataFrame, splits=None) -> DataFrame:
    """A series in storable form: ``tile_id, part, time_id, cells``.

    With ``splits`` the parts are looked up from the time ids, whatever the
    series holds; else its ``part`` column is taken as it is.
    """
    if splits is not None:
        series = locate_parts(series.withColumn("time_id", F.col("time_id").cast("int")), list(splits))
    return series.select(F.col("tile_id").cast("int"), F.col("part").cast("int"),
                         F.col("time_id").cast("int"), "cells")


def writer_tasks(spark: SparkSession, n_groups: int, total_bytes: int, target_bytes: int = 128 << 20) -> int:
    """Writer task count: about ``target_bytes`` of cells per task, never more
    tasks than (tile, part) groups, never fewer than the cluster's cores.

    At scale this is one block-sized group per task; on small inputs it avoids
    paying task start-up for a few kilobytes each.
    """
    by_size = -(-int(total_bytes) // int(target_bytes))
    cores = spark.sparkContext.defaultParallelism
    return max(1, min(int(n_groups), max(by_size, cores)))


def cluster_for_write(series: DataFrame, n_tasks: int | None = None, n_parts: int | None = None, per_folder: int = 1) -> DataFrame:
    """The catalog's write layout: every folder, ``(tile_id, part)`` or the parts that share one, in one task.

    With ``n_parts`` the dense number ``tile_id * n_folders + folder`` decides the
    task, so groups spread evenly; else they are hashed.
    """
    if n_tasks and n_parts:
        folder = folder_of(F.least(F.col("part"), F.lit(n_parts - 1)), per_folder)
        number = F.col("tile_id").cast("long") * -(-n_parts // per_folder) + folder
        return series.repartitionById(int(n_tasks), F.pmod(number, F.lit(int(n_tasks))).cast("int"))
    by = ["tile_id", "part" if per_folder == 1 else folder_of("part", per_folder)]
    return series.repartition(int(n_tasks), *by) if n_tasks else series.repartition(*by)


MAX_FILE_BYTES = 256 << 20
MODES = ("errorifexists", "error", "overwrite")


def prepare_output(spark: SparkSession, out: str, mode: str) -> str:
    """The version under which a whole new catalog may be written at ``out``: "" where there is none yet.

    ``overwrite`` leaves the old catalog in place and readable until
    ``publish``.  Appending is the business of ``gridseries.streaming``, which
    keeps to the stored splits; other modes are refused.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r}: a catalog is written whole ({', '.join(MODES)}); append steps with gridseries.streaming")
    there = [n for n in list_names(spark, out) if n == "metadata.json" or n.startswith(VERSIONED)]
    if not there:
        return ""
    if mode != "overwrite":
        raise FileExistsError(f"a catalog exists at {out}")
    return f"-{uuid.uuid4().hex[:12]}"


#: Beginnings of the names of a catalog's folders; the version follows.
VERSIONED = ("cells", "stream", "_stream_checkpoint")


def version_of(meta: GridMetadata) -> str:
    return meta.extra.get("version", "")


def _cells_path(out: str, meta: GridMetadata) -> str:
    return f"{out.rstrip('/')}/cells{version_of(meta)}"


def publish(spark: SparkSession, out: str, meta: GridMetadata) -> Catalog:
    """Put the metadata record in place, which makes its version the catalog, then remove the folders of other versions."""
    store_metadata(spark, meta, out)
    mine = {f"{name}{version_of(meta)}" for name in VERSIONED}
    for name in list_names(spark, out):
        if name.startswith(VERSIONED) and name not in mine:
            remove_path(spark, f"{out.rstrip('/')}/{name}")
    return open_catalog(spark, out, meta)


def occupied_folders(counts: DataFrame) -> list[list[int]]:
    """Rectangles [first tile, last tile, first part, last part] from a table by (tile_id, part); a full grid gives one.
    (``part``: the folder's number, where parts share folders.)

    Tiles with the same parts meet in one row; the driver sees the runs of what
    is a list of the catalog's folders.
    """
    per_tile = counts.groupBy("tile_id").agg(F.array_sort(F.collect_set("part")).alias("parts"))
    shapes = per_tile.groupBy("parts").agg(F.array_sort(F.collect_list("tile_id")).alias("tiles")).collect()
    return sorted([*t, *p] for r in shapes for t in _runs(r["tiles"]) for p in _runs(r["parts"]))


def _runs(numbers: list[int]) -> list[tuple[int, int]]:
    """Ascending numbers as runs (first, last)."""
    if not numbers:
        return []
    cuts = [i for i in range(1, len(numbers)) if numbers[i] != numbers[i - 1] + 1]
    return [(numbers[a], numbers[b - 1]) for a, b in zip([0, *cuts], [*cuts, len(numbers)])]


def write_occupied(spark: SparkSession, cells: str, rectangles: list[list[int]], per_folder: int = 1) -> None:
    shared = {"partsPerFolder": per_folder} if per_folder > 1 else {}
    replace_file(spark, f"{cells}/{OCCUPIED}", json.dumps({"occupied": rectangles} | shared))


def _read_occupied(spark: SparkSession, cells: str) -> tuple[list[list[int]] | None, int]:
    path = f"{cells}/{OCCUPIED}"
    if not path_exists(spark, path):
        return None, 1
    listing = json.loads(read_file(spark, path))
    return listing["occupied"], int(listing.get("partsPerFolder", 1))


OCCUPIED = "_occupied.json"
MOST_PATHS = 4096  # a window over more folders lists the catalog as a whole


def write_catalog(series: DataFrame, out: str, mode: str = "errorifexists", n_tasks: int | None = None,
                  clustered: bool = False, record_bytes: int | None = None, n_parts: int | None = None, version: str = "",
                  per_folder: int = 1) -> str:
    """Write a series with ``part`` as one directory per tile and time part.

    Each (tile, part) is shuffled to one task, which writes it as one file
    sorted by time; parts are sized by the split rule to about a block each.
    Small parts may share a folder and its file (``per_folder`` of them, see
    ``parts_per_folder``; to be passed to ``write_occupied`` too).
    ``n_tasks`` (see ``writer_tasks``) fixes the shuffle width, so adaptive
    execution cannot merge all groups into a few long-running writer tasks.
    ``clustered=True``: the input is already partitioned by ``cluster_for_write``.
    ``record_bytes`` (cells x cell bytes) caps files at ``MAX_FILE_BYTES``, so a
    part that holds many steps (k = 0, or a huge k) rolls over into several files.
    ``version`` (see ``prepare_output``) names the folder.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is not one of {', '.join(MODES)}")
    path = f"{out.rstrip('/')}/cells{version}"
    rec = to_records(series)
    if not clustered:
        rec = cluster_for_write(rec, n_tasks, n_parts, per_folder)
    folder = ["part"]
    if per_folder > 1:
        rec, folder = rec.withColumn(FOLDER, folder_of("part", per_folder)), [FOLDER, "part"]
    w = rec.sortWithinPartitions("tile_id", *folder, "time_id").write.mode(mode)
    if record_bytes:
        w = w.option("maxRecordsPerFile", max(1, MAX_FILE_BYTES // int(record_bytes)))
    w.partitionBy("tile_id", folder[0]).parquet(path)
    return path


def _stored(spark: SparkSession, out: str, meta: GridMetadata, tile_id: int | None = None,
            parts: tuple[int, int] | None = None, occupied: list[list[int]] | None = None, per_folder: int = 1) -> DataFrame:
    """The stored series, or only the folders of one tile or of a range of parts (built from ``occupied`` where it is known).

    Where parts share folders, with the folder's number as a column more.
    """
    schema = record_schema(meta.cell_type.spark_type, per_folder)
    columns = [*RECORD_COLUMNS, *([FOLDER] if per_folder > 1 else [])]
    root, cells = out.rstrip("/"), _cells_path(out, meta)
    reader = spark.read.schema(schema).option("basePath", cells)
    none = spark.createDataFrame([], schema)
    whole = tile_id is None and (parts is None or parts[1] - parts[0] + 1 >= meta.n_parts)
    if whole:
        series = reader.parquet(cells)
    elif tile_id is not None:
        series = reader.parquet(f"{cells}/tile_id={int(tile_id)}") if path_exists(spark, f"{cells}/tile_id={int(tile_id)}") else none
    elif occupied is not None:
        folders = [p // per_folder for p in parts]
        series = _read_paths(reader, cells, window_paths(cells, occupied, *folders, "part" if per_folder == 1 else FOLDER), none)
    else:
        names = ",".join(f"part={i}" for i in range(parts[0], parts[1] + 1))
        pattern = f"{cells}/tile_id=*/{{{names}}}"
        series = reader.parquet(pattern) if _any_path(spark, pattern) else none
    series = series.select(*columns)
    stream = f"{root}/stream{version_of(meta)}"
    if path_exists(spark, f"{stream}/_spark_metadata"):
        # steps appended by ``gridseries.streaming``; the sink's log lists committed files only
        more = spark.read.schema(record_schema(meta.cell_type.spark_type)).parquet(stream).select(*RECORD_COLUMNS)
        if per_folder > 1:
            more = more.withColumn(FOLDER, folder_of("part", per_folder))
        if tile_id is not None:
            more = more.filter(F.col("tile_id") == F.lit(int(tile_id)))
        if parts is not None and not whole:
            more = more.filter(F.col("part").between(*parts))
        series = series.unionByName(more)
    return series


def window_paths(cells: str, occupied: list[list[int]], lo: int, hi: int, name: str = "part") -> list[str]:
    """The folders of the parts lo..hi, from the rectangles of what is there."""
    return [f"{cells}/tile_id={t}/{name}={p}" for t0, t1, p0, p1 in occupied
            for t in range(t0, t1 + 1) for p in range(max(lo, p0), min(hi, p1) + 1)]


def _read_paths(reader, cells: str, paths: list[str], none: DataFrame) -> DataFrame:
    if not paths:
        return none
    return reader.parquet(cells) if len(paths) > MOST_PATHS else reader.parquet(*paths)


def _any_path(spark: SparkSession, pattern: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(pattern)
    found = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hpath)
    return found is not None and len(found) > 0


def open_catalog(spark: SparkSession, out: str, meta: GridMetadata | None = None) -> Catalog:
    """Open a catalog; an error when its metadata is absent.  Cell folders are listed when a series is asked for.

    ``meta``: the record just written by the caller (ingest), which saves
    reading it back.
    """
    if meta is None:
        meta = load_metadata(spark, out)
    check_reader(spark, meta.layout.cells_per_tile * meta.cell_type.bytes)
    return Catalog(out, meta, spark=spark)


def scan_tile(catalog: Catalog, tile_id: int) -> DataFrame:
    """The series of one tile: of an opened catalog only the tile's folder is listed and read."""
    if catalog.stored:
        return _stored(catalog.spark, catalog.path, catalog.meta, tile_id=tile_id, per_folder=catalog.per_folder()).select(*RECORD_COLUMNS)
    return catalog.series.filter(F.col("tile_id") == F.lit(int(tile_id)))


def series_by_part(catalog: Catalog, tile_id: int = 0, start: int | None = None, end: int | None = None) -> DataFrame:
    """One tile's series in the window, ordered by part and time inside each task."""
    s = prune_parts(scan_tile(catalog, tile_id), list(catalog.meta.splits), start, end)
    return s.sortWithinPartitions("part", "time_id")


def part_summary(series: DataFrame) -> DataFrame:
    """``part, n_records, min_time, max_time`` of a series (no driver collect)."""
    return series.groupBy("part").agg(F.count(F.lit(1)).alias("n_records"),
                                      F.min("time_id").alias("min_time"),
                                      F.max("time_id").alias("max_time"))


def cache_series(series: DataFrame) -> DataFrame:
    """Keep a series in executor memory (spilling to disk) for repeated queries, until ``uncache_series``.

    The kept rows belong to this plan: every later query of the session that
    contains it reads them.
    """
    return series.persist(StorageLevel.MEMORY_AND_DISK)


def uncache_series(series: DataFrame) -> DataFrame:
    """Release what ``cache_series`` keeps."""
    return series.unpersist()
