"""Band tables, catalog metadata and the partitioned catalog."""
