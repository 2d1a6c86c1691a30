"""Incremental ingest: bands that arrive later are appended to a catalog."""

from gridseries.streaming.append import append_bands_stream, band_schema

__all__ = ["append_bands_stream", "band_schema"]
