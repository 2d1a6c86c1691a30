"""Plain value types of the data model (extent, layout, cell type, metadata).

They live on the driver only as small descriptors; every per-cell or
per-time-step value lives in DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# AWT DataBuffer type codes stored as ``cellType`` in the
# metadata JSON, with the byte width of one cell and the Spark element type.
#   int8 -> 0 (1 byte), int16 -> 2 (2 bytes), int32 -> 3 (4 bytes),
#   float32 -> 4 (4 bytes), float64 -> 5 (8 bytes)
_CELL_TYPES = {
    "int8": (0, 1, T.ByteType()),
    "int16": (2, 2, T.ShortType()),
    "int32": (3, 4, T.IntegerType()),
    "float32": (4, 4, T.FloatType()),
    "float64": (5, 8, T.DoubleType()),
}


@dataclass(frozen=True)
class CellType:
    name: str

    def __post_init__(self):
        if self.name not in _CELL_TYPES:
            raise ValueError(f"unknown cell type {self.name!r}")

    @property
    def code(self) -> int:
        return _CELL_TYPES[self.name][0]

    @property
    def bytes(self) -> int:
        return _CELL_TYPES[self.name][1]

    @property
    def spark_type(self) -> T.DataType:
        return _CELL_TYPES[self.name][2]

    @classmethod
    def from_code(cls, code: int) -> "CellType":
        for name, (c, _, _) in _CELL_TYPES.items():
            if c == int(code):
                return cls(name)
        raise ValueError(f"unknown cell type code {code}")

    @classmethod
    def from_spark(cls, dtype: T.DataType) -> "CellType":
        for name, (_, _, st) in _CELL_TYPES.items():
            if st == dtype:
                return cls(name)
        raise ValueError(f"unsupported cell element type {dtype}")


@dataclass(frozen=True)
class Extent:
    xmin: float
    ymin: float
    xmax: float
    ymax: float


@dataclass(frozen=True)
class RasterExtent:
    extent: Extent
    cols: int
    rows: int

    @property
    def cell_width(self) -> float:
        return (self.extent.xmax - self.extent.xmin) / self.cols

    @property
    def cell_height(self) -> float:
        return (self.extent.ymax - self.extent.ymin) / self.rows


@dataclass(frozen=True)
class TileLayout:
    tile_cols: int
    tile_rows: int
    pixel_cols: int
    pixel_rows: int

    @property
    def n_tiles(self) -> int:
        return self.tile_cols * self.tile_rows

    @property
    def cells_per_tile(self) -> int:
        return self.pixel_cols * self.pixel_rows

    @property
    def cols(self) -> int:
        return self.tile_cols * self.pixel_cols

    @property
    def rows(self) -> int:
        return self.tile_rows * self.pixel_rows

    @classmethod
    def for_raster(cls, cols: int, rows: int, tile_cols: int, tile_rows: int) -> "TileLayout":
        """Layout that cuts a cols x rows raster into tile_cols x tile_rows tiles.

        Raises when the tile counts do not divide the raster evenly.
        """
        if tile_cols <= 0 or tile_rows <= 0:
            raise ValueError("tile counts must be positive")
        if cols % tile_cols:
            raise ValueError(f"{cols} raster columns cannot be cut into {tile_cols} equal tiles")
        if rows % tile_rows:
            raise ValueError(f"{rows} raster rows cannot be cut into {tile_rows} equal tiles")
        return cls(tile_cols, tile_rows, cols // tile_cols, rows // tile_rows)


@dataclass(frozen=True)
class GridMetadata:
    time_count: int
    splits: tuple[int, ...]
    extent: Extent
    layout: TileLayout
    cell_type: CellType
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    @property
    def n_parts(self) -> int:
        return len(self.splits) + 1
