"""Cell-by-cell aggregates over time.

Sums are DOUBLE whatever the cell type, NaN carries through (missing = NaN,
never NULL), NULL cells add 0.0, NULL arrays add nothing, an array of another
length than the tile's is an error, and a cell with no record in the window
sums to 0.0.

A sum of doubles depends on their order in its last bits.  With ``exact=True``
the sum is free of that: partial sums are whole numbers per exponent bin
(``gridseries.operators.exact``), and both forms, any order and any partitioning
give the same bits, those of the exact sum rounded once.

The mean of a dense series is one pass: the count of the first tile's records
travels with the cells' partial sums.

Physical forms of the cell sum (the same rules and errors in both; without
``exact`` they differ in float summation order):

* ``explode``: ``posexplode(cells)`` feeding a partial hash aggregate on
  ``(tile_id, pos)``; only one row per cell and task crosses the shuffle.
  Whole-stage codegen, spills like any aggregate.  Works for both forms.
* ``arrow``: array form only; each task stacks the tile arrays of an Arrow
  batch into a numpy matrix and adds them up per tile, emitting one partial
  array per (group, tile) and task, cut into blocks of ``POS_BLOCK`` cells.
  Without group keys the blocks are shuffled by (tile, block) and added up by
  numpy: the width of that shuffle follows the raster's cells, not the number
  of tiles.  With keys they are exploded into the same final aggregate as
  ``explode``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseries.model import TileLayout
from gridseries.operators.exact import DIGITS, exact_sums, grouped_bins, round_groups, rounded
from gridseries.operators.tiling import tile_to_cell

NAN = float("nan")
ARROW_ACC_BYTES = 256 << 20   # per-task budget of partial sums in the Arrow form
POS_BLOCK = 1024              # cells of a tile that are added up together in the last stage


def to_long(series: DataFrame, keys=(), cells_per_tile: int | None = None) -> DataFrame:
    """Array or long series -> ``keys, tile_id, time_id, pos, v`` with DOUBLE ``v``.

    With ``cells_per_tile`` an array of another length is an error.
    """
    keys = list(keys)
    if "cells" in series.columns:
        cells = F.col("cells")
        if cells_per_tile is not None:
            ok = F.assert_true(cells.isNull() | (F.size(cells) == F.lit(cells_per_tile)),
                               F.lit(f"tile arrays must hold {cells_per_tile} cells"))
            cells = F.when(ok.isNull(), cells)
        ex = series.select(*keys, "tile_id", "time_id", F.posexplode(cells).alias("pos", "v"))
        return ex.select(*keys, "tile_id", "time_id", F.col("pos").cast("int").alias("pos"),
                         F.col("v").cast("double").alias("v"))
    return series.select(*keys, "tile_id", "time_id", F.col("pos").cast("int").alias("pos"),
                         F.col("v").cast("double").alias("v"))


def cell_grid(spark: SparkSession, layout: TileLayout, tile_id: int | None = None) -> DataFrame:
    """Every ``(tile_id, pos)`` of the layout (or of one tile), generated in parallel."""
    n = layout.cells_per_tile
    if tile_id is not None:
        return spark.range(n).select(F.lit(int(tile_id)).alias("tile_id"), F.col("id").cast("int").alias("pos"))
    ids = spark.range(layout.n_tiles * n)
    return ids.select(F.floor(F.col("id") / n).cast("int").alias("tile_id"), (F.col("id") % n).cast("int").alias("pos"))


def _group_codes(columns):
    """Group number of every row, from Arrow key columns (dictionary codes; NULL is a value of its own)."""
    import numpy as np
    import pyarrow.compute as pc

    codes = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        d = c.dictionary_encode()
        own = np.asarray(pc.fill_null(d.indices, -1), dtype=np.int64) + 1
        codes = np.unique(codes * (len(d.dictionary) + 1) + own, return_inverse=True)[1]
    return codes


MARKER = -1   # tile number of the rows that carry the first tile's record count


def _arrow_partials(series: DataFrame, keys: list[str], cells_per_tile: int, exact: bool = False, markers: int = 0) -> DataFrame:
    """Per task: ``(keys, tile_id, block, bin, sums, d1, d2)``, one row per block of cells of every (keys, tile) it saw.

    Runs on Arrow record batches (``mapInArrow``; batches are capped by
    ``spark.sql.execution.arrow.maxBytesPerBatch``): the flat cell buffer of a
    batch is viewed as a (records x cells) matrix and summed per group with
    ``np.add.reduceat``.  Keys stay in Arrow, so NULL keys and large integers
    keep their values.  NaN stays NaN; NULL cells add 0.0, as in ``explode``.

    ``bin`` is null and ``sums`` holds doubles, or with ``exact`` one row per
    exponent bin holds the digits of the sums: ``whole`` (longs), ``d1``, ``d2``
    (``sums`` then carries NaN and infinities only, in rows without a bin).
    ``markers``: the task adds that many rows of tile ``MARKER``, block 0, 1, ...,
    each with the number of records of tile 0 it saw.
    """
    cols = keys + ["tile_id"]
    slim = series.select(*keys, F.col("tile_id").cast("int").alias("tile_id"), "cells")
    longs = T.ArrayType(T.LongType(), False)
    out_schema = T.StructType([slim.schema[c] for c in cols]
                              + [T.StructField("block", T.IntegerType(), False), T.StructField("bin", T.IntegerType(), True),
                                 T.StructField("sums", T.ArrayType(T.DoubleType(), False), True)]
                              + [T.StructField(d, longs, True) for d in DIGITS])

    max_groups = max(1, ARROW_ACC_BYTES // (8 * cells_per_tile * (3 if exact else 1)))
    cuts = list(range(0, cells_per_tile, POS_BLOCK))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        acc: dict = {}   # (bin, group) -> doubles (cells) or digits (3, cells); bin None: doubles
        key_types, first_tile = [pa.int32()], 0

        def lists(rows, of):
            flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=of))

        def batch(rows, block):
            """rows: (bin, group, doubles or digits of this block)."""
            arrays = [pa.array([k[j] for _, k, _ in rows], type=key_types[j]) for j in range(len(key_types))]
            arrays += [pa.array(np.full(len(rows), block, np.int32)), pa.array([b for b, _, _ in rows], pa.int32())]
            if rows[0][0] is None:
                arrays.append(lists([v for _, _, v in rows], pa.float64()))
                arrays += [pa.nulls(len(rows), pa.list_(pa.int64()))] * 3
            else:
                arrays.append(pa.nulls(len(rows), pa.list_(pa.float64())))
                arrays += [lists([v[d] for _, _, v in rows], pa.int64()) for d in range(3)]
            return pa.RecordBatch.from_arrays(arrays, names=cols + ["block", "bin", "sums", *DIGITS])

        def flush():
            for i, lo in enumerate(cuts):
                size = min(POS_BLOCK, cells_per_tile - lo)
                for plain in (True, False):
                    rows = [(b, k, v[..., lo : lo + size]) for (b, k), v in acc.items() if (b is None) == plain]
                    if rows:
                        yield batch(rows, i)
            acc.clear()

        def add(b, key, part):
            if (b, key) in acc:
                acc[b, key] += part
            else:
                acc[b, key] = part.copy()

        for b in batches:
            if b.num_rows == 0:
                continue
            key_types = [b.schema.field(i).type for i in range(len(cols))]
            if markers:
                first_tile += pc.sum(pc.equal(b.column(len(cols) - 1), 0)).as_py() or 0
            cells = b.column(len(cols))
            if cells.null_count:
                b = b.filter(pc.is_valid(cells))
                cells = b.column(len(cols))
                if b.num_rows == 0:
                    continue
            lens = pc.list_value_length(cells).to_numpy(zero_copy_only=False)
            if not (lens == cells_per_tile).all():
                raise ValueError(f"tile arrays must hold {cells_per_tile} cells")
            vals = cells.flatten()
            if vals.null_count:
                vals = pc.fill_null(vals, 0)
            mat = vals.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(b.num_rows, cells_per_tile)
            codes = _group_codes([b.column(i) for i in range(len(cols))])
            order = np.argsort(codes, kind="stable")
            sc = codes[order]
            starts = np.flatnonzero(np.r_[True, sc[1:] != sc[:-1]])
            firsts = b.select(list(range(len(cols)))).take(pa.array(order[starts]))
            groups = list(zip(*[c.to_pylist() for c in firsts.columns]))
            if exact:
                for kind, sums in grouped_bins(mat[order], starts):
                    for i, key in enumerate(groups):
                        add(kind, key, sums[i] if kind is None else sums[:, i])
            else:
                for key, part in zip(groups, np.add.reduceat(mat[order], starts, axis=0)):
                    add(None, key, part)
            if len(acc) >= max_groups:
                # high-cardinality keys: emit partials early, memory stays bounded
                yield from flush()
        if acc:
            yield from flush()
        if markers:
            for i in range(markers):
                yield batch([(None, (MARKER,), np.array([float(first_tile)]))], i)

    return slim.mapInArrow(run, out_schema)


def _final_tasks(spark: SparkSession, layout: TileLayout, tile_id: int | None) -> tuple[int, int]:
    """Blocks per tile, and tasks among which the blocks are dealt."""
    per_tile = -(-layout.cells_per_tile // POS_BLOCK)
    n_blocks = per_tile * (1 if tile_id is not None else layout.n_tiles)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return per_tile, max(1, min(n_blocks, max(width, -(-n_blocks * POS_BLOCK * 8 // ARROW_ACC_BYTES))))


def _arrow_final(partials: DataFrame, layout: TileLayout, tile_id: int | None, fill: bool, mean: bool = False) -> DataFrame:
    """Sum the per-task partial blocks: arrays cross the shuffle, not cells.

    A block's dense number decides its task, so the shuffle is as wide as the
    raster has blocks (up to ``spark.sql.shuffle.partitions``, more where the
    sums of a task would pass ``ARROW_ACC_BYTES``), whatever the tile count.
    A NULL array is a zero marker: with ``fill`` every block of the layout gets
    one, so tiles without records come out as 0.0.  With ``mean`` every task
    adds up the record counts sent to it (rows of tile ``MARKER``) and divides.
    """
    spark = partials.sparkSession
    cpt = layout.cells_per_tile
    per_tile, n = _final_tasks(spark, layout, tile_id)
    if fill:
        first, n_tiles = (int(tile_id), 1) if tile_id is not None else (0, layout.n_tiles)
        ids = spark.range(first * per_tile, (first + n_tiles) * per_tile)
        partials = partials.unionByName(ids.select(
            F.floor(F.col("id") / per_tile).cast("int").alias("tile_id"), (F.col("id") % per_tile).cast("int").alias("block")),
            allowMissingColumns=True)
    schema = T.StructType([T.StructField("tile_id", T.IntegerType(), False), T.StructField("block", T.IntegerType(), False),
                           T.StructField("sums", T.ArrayType(T.DoubleType(), False), False)])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        acc: dict = {}      # (tile, block) -> doubles
        bins: dict = {}     # (tile, block) -> bin -> digits (3, cells)
        count = 0.0
        for b in batches:
            names = b.schema.names
            tiles, blocks, kinds = (b.column(names.index(c)).to_pylist() for c in ("tile_id", "block", "bin"))
            sums, digits = b.column(names.index("sums")), [b.column(names.index(d)) for d in DIGITS]
            for i, (t, k, kind) in enumerate(zip(tiles, blocks, kinds)):
                if t == MARKER:
                    count += sums[i].values[0].as_py()
                elif kind is not None:
                    part = np.stack([d[i].values.to_numpy(zero_copy_only=False) for d in digits])
                    held = bins.setdefault((t, k), {})
                    held[kind] = held[kind] + part if kind in held else part
                    acc.setdefault((t, k), _zeros(cpt, k))
                else:
                    part = sums[i].values.to_numpy(zero_copy_only=False) if sums[i].is_valid else 0.0
                    acc[t, k] = (acc[t, k] if (t, k) in acc else _zeros(cpt, k)) + part
        for (t, k), v in acc.items():
            if (t, k) in bins:
                v = _rounded_block(bins[t, k], v)
            if mean:
                v = v / count if count else np.full(len(v), np.nan)
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([k], pa.int32()),
                                              pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v))],
                                             names=["tile_id", "block", "sums"])

    dense = F.when(F.col("tile_id") == MARKER, F.col("block")).otherwise(F.col("tile_id") * per_tile + F.col("block"))
    rows = partials.select("tile_id", "block", "bin", "sums", *DIGITS).repartitionById(n, F.pmod(dense, F.lit(n)).cast("int"))
    return _cells(rows.mapInArrow(run, schema), []).withColumnRenamed("v", "sum_v")


def _rounded_block(bins: dict, special):
    """The exact sums of a block's cells from its bins, rounded; ``special`` adds NaN and infinities (else 0.0)."""
    import numpy as np

    kinds = sorted(bins)
    size = len(special)
    digits = np.stack([bins[b] for b in kinds], axis=2)   # digit, cell, bin
    flat = digits.reshape(3, -1)
    out = round_groups(np.tile(np.array(kinds, np.int64), size), *flat, np.arange(size + 1) * len(kinds))
    return np.where(np.isfinite(special), out, special)


def _zeros(cells_per_tile: int, block: int):
    import numpy as np

    return np.zeros(min(POS_BLOCK, cells_per_tile - block * POS_BLOCK))


def _cells(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of sums -> one row per cell."""
    return partials.select(*keys, "tile_id", "block", F.posexplode("sums").alias("i", "v")) \
        .select(*keys, "tile_id", (F.col("block") * POS_BLOCK + F.col("i")).cast("int").alias("pos"), "v")


def _cell_bins(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of digits -> one row per cell and bin: ``keys, tile_id, pos, bin, d0, d1, d2, special``."""
    both = F.arrays_zip(*[F.coalesce(c, F.array().cast(t)) for c, t in [("sums", "array<double>"), *[(d, "array<bigint>") for d in DIGITS]]])
    rows = partials.select(*keys, "tile_id", "block", "bin", F.posexplode(both).alias("i", "z"))
    fields = ["sums", *DIGITS]
    return rows.select(*keys, "tile_id", (F.col("block") * POS_BLOCK + F.col("i")).cast("int").alias("pos"),
                       F.coalesce("bin", F.lit(0)).alias("bin"),
                       *[F.coalesce(F.col("z")[str(fields.index(d))], F.lit(0)).alias(d) for d in DIGITS],
                       F.when(F.isnan(F.col("z")["0"]) | (F.abs(F.col("z")["0"]) == F.lit(float("inf"))), F.col("z")["0"]).alias("special"))


ARROW_MIN_CELLS = 1024


def choose_method(series: DataFrame, layout: TileLayout, method: str) -> str:
    """``auto``: the Arrow form for array series with big tiles, where it ran
    about twice as fast as ``explode`` (180 x 180 tiles); ``explode`` otherwise.
    Only the plan depends on it: both follow the same rules."""
    if method != "auto":
        return method
    if "cells" in series.columns and layout.cells_per_tile >= ARROW_MIN_CELLS:
        return "arrow"
    return "explode"


def tile_sum(series: DataFrame, layout: TileLayout, tile_id: int | None = None, keys=(),
             method: str = "auto", fill: bool = True, exact: bool = False) -> DataFrame:
    """Cell-by-cell DOUBLE sum over all records: ``keys, tile_id, pos, sum_v``.

    ``tile_id`` restricts to one tile (a partition filter on a catalog).
    Without ``keys``, cells with no record are filled with 0.0 by adding one
    zero row per grid cell to the aggregate input (no join); with keys only the
    key values present in the data appear.  ``exact``: the exact sum, rounded
    once, whatever the order of the records.
    """
    keys = list(keys)
    method = choose_method(series, layout, method)
    if tile_id is not None:
        series = series.filter(F.col("tile_id") == F.lit(int(tile_id)))
    if method == "arrow":
        if "cells" not in series.columns:
            raise ValueError("the arrow form needs array series (a 'cells' column)")
        partials = _arrow_partials(series, keys, layout.cells_per_tile, exact)
        if not keys:
            return _arrow_final(partials, layout, tile_id, fill)
        if exact:
            bins = _cell_bins(partials, keys).groupBy(*keys, "tile_id", "pos", "bin") \
                .agg(*[F.sum(d).alias(d) for d in DIGITS], F.sum("special").alias("special"))
            return rounded(bins, [*keys, "tile_id", "pos"])
        cells = _cells(partials, keys)
    elif method == "explode":
        cells = to_long(series, keys, layout.cells_per_tile) \
            .select(*keys, "tile_id", "pos", F.coalesce("v", F.lit(0.0)).alias("v"))
    else:
        raise ValueError(f"unknown method {method!r}")
    if fill and not keys:
        zeros = cell_grid(series.sparkSession, layout, tile_id).withColumn("v", F.lit(0.0))
        cells = cells.unionByName(zeros)
    if exact:
        return exact_sums(cells, [*keys, "tile_id", "pos"])
    return cells.groupBy(*keys, "tile_id", "pos").agg(F.sum("v").alias("sum_v"))


def tile_mean(series: DataFrame, layout: TileLayout, method: str = "auto", exact: bool = False) -> DataFrame:
    """Cell sums of a dense array series divided by the record count of tile 0, in one pass: ``tile_id, pos, mean_v``.

    The count is a value among the cells' partial sums.  ``explode``: a record
    of tile 0 also gives a 1.0 for position -1 of every tile; the tile's cells
    then find their tile's count (a group is one tile).  ``arrow``: every task
    sends its count once to every task of the last stage.
    """
    method = choose_method(series, layout, method)
    spark, cpt = series.sparkSession, layout.cells_per_tile
    if method == "arrow":
        partials = _arrow_partials(series, [], cpt, exact, markers=_final_tasks(spark, layout, None)[1])
        return _arrow_final(partials, layout, None, True, mean=True).withColumnRenamed("sum_v", "mean_v")
    if method != "explode":
        raise ValueError(f"unknown method {method!r}")
    cells = F.col("cells")
    ok = F.assert_true(cells.isNull() | (F.size(cells) == F.lit(cpt)), F.lit(f"tile arrays must hold {cpt} cells"))
    none = F.array().cast("array<double>")
    # a record without cells adds nothing to the sums, but counts
    values = F.coalesce(F.when(ok.isNull(), cells.cast("array<double>")), F.array_repeat(F.lit(0.0), cpt))
    marks = F.when(F.col("tile_id") == 0, F.array_repeat(F.lit(1.0), layout.n_tiles)).otherwise(none)
    rows = series.select("tile_id", F.posexplode(F.concat(values, marks)).alias("at", "v"))
    cell = F.col("at") < cpt
    cells = rows.select(F.when(cell, F.col("tile_id")).otherwise(F.col("at") - cpt).cast("int").alias("tile_id"),
                        F.when(cell, F.col("at")).otherwise(-1).cast("int").alias("pos"), F.coalesce("v", F.lit(0.0)).alias("v"))
    grid = cell_grid(spark, layout)
    tiles = spark.range(layout.n_tiles).select(F.col("id").cast("int").alias("tile_id"), F.lit(-1).alias("pos"))
    cells = cells.unionByName(grid.unionByName(tiles).withColumn("v", F.lit(0.0)))
    by = ["tile_id", "pos"]
    sums = exact_sums(cells, by) if exact else cells.groupBy(*by).agg(F.sum("v").alias("sum_v"))
    count = F.max(F.when(F.col("pos") == -1, F.col("sum_v"))).over(W.partitionBy("tile_id"))
    return sums.withColumn("n", count).filter("pos >= 0").select(*by, divide_by_count(F.col("sum_v"), F.col("n")).alias("mean_v"))


def mosaic(tile_values: DataFrame, layout: TileLayout, value_cols=("sum_v",), keys=()) -> DataFrame:
    """Place per-tile cell values into raster coordinates ``cell_row, cell_col``."""
    row, col = tile_to_cell("tile_id", "pos", layout)
    return tile_values.select(*keys, row.alias("cell_row"), col.alias("cell_col"), *value_cols)


def tile_arrays(tile_values: DataFrame, value_col: str = "sum_v", keys=()) -> DataFrame:
    """Long per-cell values -> one row per tile with its cells row-major in an array.

    A group is one tile (``pixel_cols x pixel_rows`` values), so it is bounded;
    the whole raster is never gathered into one row.
    """
    keys = list(keys)
    packed = tile_values.groupBy(*keys, "tile_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.col(value_col).alias("x")))).alias("cells"))
    return packed.select(*keys, "tile_id", F.transform("cells", lambda e: e["x"]).alias("cells"))


def mosaic_sum(series: DataFrame, layout: TileLayout, method: str = "auto", keys=(), exact: bool = False) -> DataFrame:
    """Whole-raster cell sums in long form: ``keys, cell_row, cell_col, sum_v``."""
    return mosaic(tile_sum(series, layout, keys=keys, method=method, exact=exact), layout, keys=keys)


def time_count(series: DataFrame, distinct: bool | None = None) -> DataFrame:
    """Number of time steps as a one-row ``time_count`` DataFrame.

    Array (dense) series count the records of the first tile (tile 0),
    duplicates included.  Long (sparse) series, or ``distinct=True``, count the
    distinct time ids of the whole series, as if absent cells were 0.0.
    """
    if distinct is None:
        distinct = "cells" not in series.columns
    if distinct:
        return series.agg(F.count_distinct("time_id").alias("time_count"))
    return series.filter(F.col("tile_id") == 0).agg(F.count(F.lit(1)).alias("time_count"))


def divide_by_count(values: Column, n: Column) -> Column:
    """``values / n``, NaN when ``n`` is 0 (ANSI division by zero would raise).

    ``n`` appears once, so a scalar subquery behind it runs once.
    """
    return F.coalesce(F.try_divide(values, n), F.lit(NAN))


def mosaic_mean(series: DataFrame, layout: TileLayout, method: str = "auto",
                distinct: bool | None = None, count: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """Per-cell mean: the cell sum divided by the series' time count.

    Dense series divide by tile 0's record count, counted in the pass that sums
    the cells (``tile_mean``).  Sparse long series (or ``distinct=True``) divide
    by the number of distinct time ids (see ``time_count``), a scalar subquery,
    so no join or cross product is planned.  ``count``: a one-row ``time_count``
    that the caller has from a cheaper source.
    """
    if count is None and not distinct and "cells" in series.columns:
        return mosaic(tile_mean(series, layout, method, exact), layout, ("mean_v",))
    n = (time_count(series, distinct) if count is None else count).scalar()
    sums = mosaic_sum(series, layout, method=method, exact=exact)
    return sums.select("cell_row", "cell_col", divide_by_count(F.col("sum_v"), n).alias("mean_v"))


def min_max(raster: DataFrame, value_col: str) -> DataFrame:
    """Min and max over the cells of a result raster, leaving NaN (no data) out."""
    v = F.col(value_col)
    return raster.filter(~F.isnan(v)).agg(F.min(v).alias("min_v"), F.max(v).alias("max_v"))


def local_add(series: DataFrame, layout: TileLayout, keys, method: str = "auto", exact: bool = False) -> DataFrame:
    """Cell-by-cell sum of the records of each group: ``keys, cell_row, cell_col, sum_v``.

    Map-side partial aggregation bounds what a hot group sends through the
    shuffle to one row per cell and task.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    sums = tile_sum(series, layout, keys=keys, method=method, fill=False, exact=exact)
    return mosaic(sums, layout, keys=keys)
