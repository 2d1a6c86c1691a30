"""Catalog metadata record and its JSON form.

JSON keys (fixed values):
    {"timeCount": INT, "splits": [INT...],
     "extent": {"xmin","ymin","xmax","ymax"},
     "tileLayout": {"tileCols","tileRows","pixelCols","pixelRows"},
     "cellType": INT (type code)}

Numbers are parsed as DOUBLE and cut to INT (``1000.7`` -> 1000); a missing
key is an error, extra keys are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseries.model import CellType, Extent, GridMetadata, TileLayout
from gridseries.operators.parts import int_array
from gridseries.session import path_exists, replace_file

# Key names of the metadata JSON.
METADATA_KEYS = ("timeCount", "splits", "extent", "tileLayout", "cellType")
EXTENT_KEYS = ("xmin", "ymin", "xmax", "ymax")
LAYOUT_KEYS = ("tileCols", "tileRows", "pixelCols", "pixelRows")

#: Further key of a catalog that replaced another one at its path (readers ignore keys they do not know).
VERSION_KEY = "version"

_EXTENT_SCHEMA = T.StructType([T.StructField(k, T.DoubleType()) for k in EXTENT_KEYS])
_LAYOUT_SCHEMA = T.StructType([T.StructField(k, T.DoubleType()) for k in LAYOUT_KEYS])
_K_COUNT, _K_SPLITS, _K_EXTENT, _K_LAYOUT, _K_CELL = METADATA_KEYS
_METADATA_SCHEMA = T.StructType([
    T.StructField(_K_COUNT, T.DoubleType()),
    T.StructField(_K_SPLITS, T.ArrayType(T.DoubleType())),
    T.StructField(_K_EXTENT, _EXTENT_SCHEMA),
    T.StructField(_K_LAYOUT, _LAYOUT_SCHEMA),
    T.StructField(_K_CELL, T.DoubleType()),
])


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _require(value: Column, what: str) -> Column:
    return F.when(value.isNull(), F.raise_error(F.lit(f"metadata JSON: missing or invalid {what}"))).otherwise(value)


# --- Extent -----------------------------------------------------------------

def extent_struct(xmin, ymin, xmax, ymax) -> Column:
    return F.struct(*[_col(c).cast("double").alias(k) for c, k in zip((xmin, ymin, xmax, ymax), EXTENT_KEYS)])


def extent_to_json(extent) -> Column:
    return F.to_json(_col(extent))


def extent_from_json(text) -> Column:
    """JSON -> STRUCT<xmin, ymin, xmax, ymax DOUBLE>; any missing key is an error."""
    e = F.from_json(_col(text), _EXTENT_SCHEMA)
    return F.struct(*[_require(e[k], f"extent.{k}").alias(k) for k in EXTENT_KEYS])


# --- Tile layout --------------------------------------------------------------

def layout_struct(tile_cols, tile_rows, pixel_cols, pixel_rows) -> Column:
    return F.struct(*[_col(c).cast("int").alias(k)
                      for c, k in zip((tile_cols, tile_rows, pixel_cols, pixel_rows), LAYOUT_KEYS)])


def layout_to_json(layout) -> Column:
    return F.to_json(_col(layout))


def layout_from_json(text) -> Column:
    """JSON -> STRUCT<tileCols, tileRows, pixelCols, pixelRows INT>."""
    t = F.from_json(_col(text), _LAYOUT_SCHEMA)
    return F.struct(*[_require(t[k], f"tileLayout.{k}").cast("int").alias(k) for k in LAYOUT_KEYS])


# --- Metadata ----------------------------------------------------------------

def metadata_struct(time_count, splits, extent, layout, cell_type) -> Column:
    """Typed metadata struct with the JSON key names."""
    return F.struct(
        _col(time_count).cast("int").alias(_K_COUNT),
        _col(splits).cast("array<int>").alias(_K_SPLITS),
        _col(extent).alias(_K_EXTENT),
        _col(layout).alias(_K_LAYOUT),
        _col(cell_type).cast("int").alias(_K_CELL),
    )


def metadata_to_json(meta) -> Column:
    return F.to_json(_col(meta))


def metadata_from_json(text) -> Column:
    """JSON text -> typed metadata struct, failing on any missing key."""
    m = F.from_json(_col(text), _METADATA_SCHEMA)
    splits = _require(m[_K_SPLITS], _K_SPLITS)
    splits = F.transform(splits, lambda s: _require(s, f"{_K_SPLITS} element").cast("int"))
    ext = _require(m[_K_EXTENT], _K_EXTENT)
    lay = _require(m[_K_LAYOUT], _K_LAYOUT)
    return F.struct(
        _require(m[_K_COUNT], _K_COUNT).cast("int").alias(_K_COUNT),
        splits.alias(_K_SPLITS),
        F.struct(*[_require(ext[k], f"{_K_EXTENT}.{k}").alias(k) for k in EXTENT_KEYS]).alias(_K_EXTENT),
        F.struct(*[_require(lay[k], f"{_K_LAYOUT}.{k}").cast("int").alias(k) for k in LAYOUT_KEYS]).alias(_K_LAYOUT),
        _require(m[_K_CELL], _K_CELL).cast("int").alias(_K_CELL),
    )


def metadata_equal(a, b) -> Column:
    """Field-by-field equality (splits compared element by element)."""
    return _col(a).eqNullSafe(_col(b))


def metadata_frame(spark: SparkSession, meta: GridMetadata) -> DataFrame:
    """One-row DataFrame with the typed ``metadata`` struct of a driver-side record."""
    e, l = meta.extent, meta.layout
    row = spark.range(1).select(metadata_struct(
        F.lit(meta.time_count),
        int_array(meta.splits),
        extent_struct(F.lit(e.xmin), F.lit(e.ymin), F.lit(e.xmax), F.lit(e.ymax)),
        layout_struct(F.lit(l.tile_cols), F.lit(l.tile_rows), F.lit(l.pixel_cols), F.lit(l.pixel_rows)),
        F.lit(meta.cell_type.code),
    ).alias("metadata"))
    return row


def write_metadata(meta_df: DataFrame, out: str, mode: str = "errorifexists", version: str = "") -> str:
    """Put the one-row ``metadata`` struct in place as one line of JSON, ``out/metadata.json`` (a catalog has one record: no append).

    The file is renamed into place, so a reader finds the old record or the new
    one.  ``version`` (of a catalog that replaced another) is one key more.
    """
    if mode not in ("errorifexists", "error", "overwrite"):
        raise ValueError(f"mode {mode!r}: a catalog has one metadata record")
    spark, path = meta_df.sparkSession, f"{out.rstrip('/')}/metadata.json"
    if mode != "overwrite" and path_exists(spark, path):
        raise FileExistsError(f"metadata exists at {path}")
    record = F.struct("metadata.*", F.lit(version).alias(VERSION_KEY)) if version else F.col("metadata")
    rows = meta_df.select(metadata_to_json(record).alias("value")).collect()
    if len(rows) != 1:
        raise ValueError(f"expected one metadata record, found {len(rows)}")
    replace_file(spark, path, rows[0]["value"] + "\n")
    return path


def store_metadata(spark: SparkSession, meta: GridMetadata, out: str) -> str:
    """Put a driver-side record in place, in one step, over an older one if there is one."""
    return write_metadata(metadata_frame(spark, meta), out, "overwrite", meta.extra.get("version", ""))


def read_metadata(spark: SparkSession, out: str) -> DataFrame:
    """``out/metadata.json`` -> one-row DataFrame with the parsed ``metadata`` struct, and the catalog's ``version`` (null: the first)."""
    path = f"{out.rstrip('/')}/metadata.json"
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no catalog metadata at {path}")
    return spark.read.text(path).select(metadata_from_json("value").alias("metadata"),
                                        F.get_json_object("value", f"$.{VERSION_KEY}").alias("version"))


def to_record(row, version: str | None = None) -> GridMetadata:
    """Parsed metadata struct (a Row) -> driver-side record."""
    e, l = row[_K_EXTENT], row[_K_LAYOUT]
    return GridMetadata(
        time_count=int(row[_K_COUNT]),
        splits=tuple(int(s) for s in row[_K_SPLITS]),
        extent=Extent(*[e[k] for k in EXTENT_KEYS]),
        layout=TileLayout(*[l[k] for k in LAYOUT_KEYS]),
        cell_type=CellType.from_code(row[_K_CELL]),
        extra={"version": version} if version else {},
    )


def load_metadata(spark: SparkSession, out: str) -> GridMetadata:
    """Read the (single) metadata record of a catalog to the driver."""
    rows = read_metadata(spark, out).collect()
    if len(rows) != 1:
        raise ValueError(f"expected one metadata record, found {len(rows)}")
    return to_record(rows[0]["metadata"], rows[0]["version"])
