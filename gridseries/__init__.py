"""gridseries: gridded time series (one raster per time step, cut into tiles)
stored as partitioned Parquet and queried cell by cell with Spark DataFrames.

Layout of the package:

* ``functions``  – column expressions (time ids, band metadata).
* ``operators``  – DataFrame -> DataFrame operators (tiling, time parts,
  filters, cell-wise aggregates).
* ``sources``    – band tables, metadata JSON and the on-disk catalog.
* ``plans``      – the registered queries over the driver's tables and their
  SQL oracles.
* ``streaming``  – incremental ingest of arriving bands into a catalog.
"""

from gridseries.model import CellType, Extent, GridMetadata, RasterExtent, TileLayout
from gridseries.session import build_session
from gridseries.sources.bands import read_bands
from gridseries.sources.catalog import Catalog, open_catalog
from gridseries.sources.ingest import index_bands, ingest

__all__ = ["CellType", "Extent", "GridMetadata", "RasterExtent", "TileLayout", "Catalog", "build_session", "index_bands",
           "ingest", "open_catalog", "read_bands"]
