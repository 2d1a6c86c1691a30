"""SQL (DuckDB dialect) that computes what each registered query returns.

Tables are the driver's views (``embeddings``, ``lineitem``, ``events``).
The fixture rules of ``gridseries.plans.fixtures`` are restated in SQL:
F-EMB cells at ``idx`` sit at row ``idx // 8``, col ``idx % 8``; tiles are
2 cols x 4 rows in a 4 x 2 layout; parts hold 64 distinct time ids.
"""

from __future__ import annotations

_EMB = """
emb_cells AS (
  SELECT CAST(vec_id AS INTEGER) AS time_id, label, CAST(vec_id // 250 AS INTEGER) AS path_idx,
         CAST(vec_id % 250 + 1 AS INTEGER) AS band,
         CAST(embedding[idx + 1] AS DOUBLE) AS v,
         CAST(idx // 8 AS INTEGER) AS cell_row, CAST(idx % 8 AS INTEGER) AS cell_col
  FROM (SELECT vec_id, label, embedding, UNNEST(range(len(embedding))) AS idx FROM embeddings)
),
emb_long AS (
  SELECT time_id, label, path_idx, band, cell_row, cell_col, v,
         CAST((cell_row // 4) * 4 + cell_col // 2 AS INTEGER) AS tile_id,
         CAST((cell_row % 4) * 2 + cell_col % 2 AS INTEGER) AS pos
  FROM emb_cells
),
emb_parts AS (
  SELECT time_id, CAST((rn - 1) // 64 AS INTEGER) AS part, rn % 64 = 0 AS is_split
  FROM (SELECT time_id, ROW_NUMBER() OVER (ORDER BY time_id) AS rn
        FROM (SELECT DISTINCT CAST(vec_id AS INTEGER) AS time_id FROM embeddings))
),
emb_cat AS (
  SELECT l.*, p.part FROM emb_long l JOIN emb_parts p USING (time_id)
),
emb_win AS (
  SELECT * FROM emb_long WHERE time_id BETWEEN 100 AND 200
)"""

_SHIP = """
ship_cells AS (
  SELECT CAST(date_sub('day', TIMESTAMP '1950-01-01 12:00:00', l_shipdate) AS INTEGER) AS time_id,
         CAST(l_suppkey % 8 AS INTEGER) AS cell_row, CAST(l_partkey % 16 AS INTEGER) AS cell_col, l_quantity AS q
  FROM lineitem
),
ship AS (
  SELECT time_id, cell_row, cell_col, SUM(q) AS v FROM ship_cells GROUP BY time_id, cell_row, cell_col
),
ship_grid AS (
  SELECT CAST(r.range AS INTEGER) AS cell_row, CAST(c.range AS INTEGER) AS cell_col FROM range(8) r, range(16) c
),
ship_parts AS (
  SELECT time_id, CAST((rn - 1) // 64 AS INTEGER) AS part, rn % 64 = 0 AS is_split
  FROM (SELECT time_id, ROW_NUMBER() OVER (ORDER BY time_id) AS rn FROM (SELECT DISTINCT time_id FROM ship))
)"""

_FIRST = "(SELECT * FROM embeddings ORDER BY vec_id LIMIT 1)"


def _emb(body: str) -> str:
    return f"WITH {_EMB}\n{body}"


def _ship(body: str) -> str:
    return f"WITH {_SHIP}\n{body}"


def _summary(value: str) -> str:
    return _emb(f"""SELECT tile_id, part, COUNT(DISTINCT time_id) AS n_records, MIN(time_id) AS min_time,
       MAX(time_id) AS max_time, ROUND(SUM({value}), 6) AS sum_v
FROM emb_cat GROUP BY tile_id, part""")


_EXTENT_JSON = '{"xmin":-180.0,"ymin":-90.0,"xmax":180.0,"ymax":90.0}'
_LAYOUT_JSON = '{"tileCols":4,"tileRows":2,"pixelCols":2,"pixelRows":4}'

_SPLITS = "COALESCE((SELECT string_agg(CAST(time_id AS VARCHAR), ',' ORDER BY time_id) FROM emb_parts WHERE is_split), '')"

_MEAN = """SELECT cell_row, cell_col, SUM(v) / (SELECT COUNT(*) FROM embeddings) AS mean_v
FROM emb_long GROUP BY cell_row, cell_col"""
_MEAN_WINDOW = """SELECT cell_row, cell_col, SUM(v) / (SELECT COUNT(*) FROM embeddings WHERE vec_id BETWEEN 100 AND 200) AS mean_v
FROM emb_win GROUP BY cell_row, cell_col"""


def _tile_sum(rows: str) -> str:
    return _emb(f"SELECT tile_id, pos, ROUND(SUM(v), 6) AS sum_v FROM {rows} GROUP BY tile_id, pos")


def _raster_sum(rows: str) -> str:
    return _emb(f"SELECT cell_row, cell_col, ROUND(SUM(v), 6) AS sum_v FROM {rows} GROUP BY cell_row, cell_col")


def _raster_mean(mean: str) -> str:
    return _emb(f"SELECT cell_row, cell_col, ROUND(mean_v, 6) AS mean_v FROM ({mean})")


_LOCAL_ADD = _emb("""
SELECT label, cell_row, cell_col, ROUND(SUM(v), 6) AS sum_v FROM emb_long GROUP BY label, cell_row, cell_col""")

#: Exact sum of doubles v: whole multiples of 2**-100 (2**-50) as 128-bit integers, rounded by the one addition at the end.
_THIRDS = _emb("""
, w AS (SELECT tile_id, pos, SUM(CAST(v / 3.0 * pow(2.0, 100) AS HUGEINT)) AS s FROM emb_long GROUP BY tile_id, pos)
SELECT tile_id, pos, CAST(s // CAST(9007199254740992 AS HUGEINT) AS DOUBLE) * pow(2.0, -47)
       + CAST(s % CAST(9007199254740992 AS HUGEINT) AS DOUBLE) * pow(2.0, -100) AS sum_v FROM w""")

ORACLE: dict[str, str] = {
    "read_bands_mixed": """
SELECT CAST(vec_id // 250 AS INTEGER) AS path_idx, CAST(vec_id % 250 + 1 AS INTEGER) AS band, CAST(len(embedding) AS INTEGER) AS n_cells,
       ROUND(list_sum(CAST(embedding AS DOUBLE[])), 6) AS cells_sum FROM embeddings""",
    "tile_strips_catalog": _summary("v"),
    "write_catalog_replaced": _emb("""
, h AS (SELECT *, time_id + 1000 AS t FROM emb_long WHERE time_id % 2 = 0),
r AS (SELECT t, CAST((row_number() OVER (ORDER BY t) - 1) // 128 AS INTEGER) AS part FROM (SELECT DISTINCT t FROM h))
SELECT tile_id, part, COUNT(DISTINCT t) AS n_records, MIN(t) AS min_time, MAX(t) AS max_time, ROUND(SUM(v), 6) AS sum_v
FROM h JOIN r USING (t) GROUP BY tile_id, part"""),
    "filter_time_bands": """
SELECT CAST(vec_id // 250 AS INTEGER) AS path_idx, CAST(vec_id % 250 + 1 AS INTEGER) AS band, CAST(vec_id AS INTEGER) AS time_id,
       ROUND(list_sum(CAST(embedding AS DOUBLE[])), 6) AS cells_sum FROM embeddings WHERE vec_id BETWEEN 100 AND 200""",
    "prune_parts_windows": _emb("""
, w AS (SELECT CAST(r_regionkey AS INTEGER) AS window_id, r_regionkey * 45 + 30 AS lo,
        CASE WHEN r_regionkey < 4 THEN r_regionkey * 45 + 110 ELSE 2147483647 END AS hi FROM region)
SELECT window_id, cell_row, cell_col, ROUND(SUM(v), 6) AS sum_v FROM emb_long JOIN w ON time_id BETWEEN lo AND hi
GROUP BY window_id, cell_row, cell_col"""),
    "map_tiles_shifted": _emb("""
, m AS (SELECT tile_id, time_id + 10 AS t, pos, v FROM emb_long WHERE time_id + 10 BETWEEN 100 AND 200),
p AS (SELECT t, CAST((SELECT COUNT(*) FROM emb_parts WHERE is_split AND time_id < t) AS INTEGER) AS part FROM (SELECT DISTINCT t FROM m))
SELECT tile_id, part, t AS time_id, pos, v FROM m JOIN p USING (t)"""),
    "map_tiles_shifted_written": _emb("""
, m AS (SELECT tile_id, time_id + 10 AS t, v FROM emb_long),
p AS (SELECT t, CAST((row_number() OVER (ORDER BY t) - 1) // 128 AS INTEGER) AS part FROM (SELECT DISTINCT t FROM m))
SELECT tile_id, part, COUNT(DISTINCT t) AS n_records, MIN(t) AS min_time, MAX(t) AS max_time, ROUND(SUM(v), 6) AS sum_v
FROM m JOIN p USING (t) WHERE t BETWEEN 100 AND 200 GROUP BY tile_id, part"""),
    "tile_sum_exact": _THIRDS,
    "tile_sum_exact_arrow": _THIRDS,
    "mosaic_sum_ship_exact": _ship("""
, w AS (SELECT CAST(l_suppkey % 8 AS INTEGER) AS cell_row, CAST(l_partkey % 16 AS INTEGER) AS cell_col,
        SUM(CAST(l_extendedprice * (1 - l_discount) * pow(2.0, 50) AS HUGEINT)) AS s FROM lineitem GROUP BY 1, 2)
SELECT g.cell_row, g.cell_col, COALESCE(CAST(s // CAST(1125899906842624 AS HUGEINT) AS DOUBLE)
       + CAST(s % CAST(1125899906842624 AS HUGEINT) AS DOUBLE) * pow(2.0, -50), 0.0) AS sum_v
FROM ship_grid g LEFT JOIN w USING (cell_row, cell_col)"""),
    "assign_part_orders": _ship("""
, d AS (SELECT CAST(date_sub('day', TIMESTAMP '1950-01-01 12:00:00', o_orderdate) AS INTEGER) AS t FROM orders),
p AS (SELECT t, CAST((SELECT COUNT(*) FROM ship_parts WHERE is_split AND time_id < t) AS INTEGER) AS part FROM (SELECT DISTINCT t FROM d))
SELECT part, COUNT(*) AS n_rows, MIN(t) AS min_time, MAX(t) AS max_time FROM d JOIN p USING (t) GROUP BY part"""),
    "read_bands": """
SELECT CAST(vec_id // 250 AS INTEGER) AS path_idx, CAST(vec_id % 250 + 1 AS INTEGER) AS band,
       2 AS n_meta, CAST(len(embedding) AS INTEGER) AS n_cells, 'float32' AS cell_type,
       ROUND(list_sum(CAST(embedding AS DOUBLE[])), 6) AS cells_sum
FROM embeddings""",
    "band_metadata": """
SELECT CAST(vec_id // 250 AS INTEGER) AS path_idx, CAST(vec_id % 250 + 1 AS INTEGER) AS band,
       'NETCDF_DIM_Time' AS meta_key, CAST(vec_id AS VARCHAR) AS meta_value FROM embeddings
UNION ALL
SELECT CAST(vec_id // 250 AS INTEGER), CAST(vec_id % 250 + 1 AS INTEGER), 'label', CAST(label AS VARCHAR)
FROM embeddings""",
    "band_time": """
SELECT CAST(vec_id // 250 AS INTEGER) AS path_idx, CAST(vec_id % 250 + 1 AS INTEGER) AS band,
       CAST(vec_id AS INTEGER) AS time_id FROM embeddings""",
    "infer_grid": f"""
SELECT CAST(-180.0 AS DOUBLE) AS xmin, CAST(-90.0 AS DOUBLE) AS ymin, CAST(180.0 AS DOUBLE) AS xmax,
       CAST(len(embedding) // 8 * 22.5 - 90.0 AS DOUBLE) AS ymax, 8 AS raster_cols,
       CAST(len(embedding) // 8 AS INTEGER) AS raster_rows, 'float32' AS cell_type
FROM {_FIRST}""",
    "check_extents": f"""
SELECT CAST(vec_id // 250 AS INTEGER) AS path_idx, COUNT(*) AS n_bands,
       bool_and(len(embedding) = (SELECT len(embedding) FROM {_FIRST})) AS extent_ok
FROM embeddings GROUP BY 1""",
    "check_extents_deviating": """
SELECT CAST(vec_id // 250 AS INTEGER) AS path_idx, COUNT(*) AS n_bands, bool_and((vec_id + 1) % 400 <> 0) AS extent_ok
FROM embeddings GROUP BY 1""",
    "check_layout": f"""
SELECT 4 AS tile_cols, 2 AS tile_rows, 2 AS pixel_cols, CAST(len(embedding) // 8 // 2 AS INTEGER) AS pixel_rows
FROM {_FIRST}""",
    "tile_bands": _emb("SELECT tile_id, time_id, pos, v FROM emb_long"),
    "tile_strips": _emb("SELECT tile_id, time_id, pos, v FROM emb_long"),
    "tile_extents": f"""
SELECT CAST(t.range AS INTEGER) AS tile_id,
       CAST(-180.0 + (t.range % 4) * 90.0 AS DOUBLE) AS xmin,
       CAST(g.h - 90.0 - (t.range // 4 + 1) * g.h / 2 AS DOUBLE) AS ymin,
       CAST(-180.0 + (t.range % 4 + 1) * 90.0 AS DOUBLE) AS xmax,
       CAST(g.h - 90.0 - (t.range // 4) * g.h / 2 AS DOUBLE) AS ymax
FROM (SELECT CAST(len(embedding) // 8 * 22.5 AS DOUBLE) AS h FROM {_FIRST}) g, range(8) t""",
    "time_bounds": """
SELECT CAST(MIN(vec_id) AS INTEGER) AS min_time, CAST(MAX(vec_id) AS INTEGER) AS max_time FROM embeddings""",
    "write_catalog": _summary("v"),
    "write_metadata": _emb(f"""
SELECT '{{"timeCount":' || (SELECT COUNT(*) FROM embeddings) || ',"splits":[' || {_SPLITS} ||
       '],"extent":{_EXTENT_JSON},"tileLayout":{_LAYOUT_JSON},"cellType":4}}' AS value"""),
    "read_metadata": _emb(f"""
SELECT CAST((SELECT COUNT(*) FROM embeddings) AS INTEGER) AS time_count, {_SPLITS} AS splits,
       CAST(-180.0 AS DOUBLE) AS xmin, CAST(-90.0 AS DOUBLE) AS ymin, CAST(180.0 AS DOUBLE) AS xmax,
       CAST(90.0 AS DOUBLE) AS ymax, 4 AS tile_cols, 2 AS tile_rows, 2 AS pixel_cols, 4 AS pixel_rows,
       4 AS cell_type"""),
    "extent_json": f"""
SELECT CAST(vec_id // 250 AS INTEGER) AS path_idx, CAST(vec_id % 250 + 1 AS INTEGER) AS band,
       '{{"xmin":' || xmin || ',"ymin":' || ymin || ',"xmax":' || xmax || ',"ymax":' || ymax || '}}' AS extent_json,
       xmin, ymin, xmax, ymax
FROM (SELECT vec_id, CAST(vec_id AS DOUBLE) * 0.5 - 180 AS xmin, CAST(label AS DOUBLE) * 0.25 - 90 AS ymin,
             CAST(vec_id AS DOUBLE) * 0.5 AS xmax, CAST(label AS DOUBLE) + 0.75 AS ymax FROM embeddings)""",
    "layout_json": f"""
SELECT '{{"tileCols":4,"tileRows":2,"pixelCols":2,"pixelRows":' || CAST(len(embedding) // 8 // 2 AS VARCHAR) || '}}'
       AS layout_json, 4 AS tile_cols, 2 AS tile_rows, 2 AS pixel_cols,
       CAST(len(embedding) // 8 // 2 AS INTEGER) AS pixel_rows
FROM {_FIRST}""",
    "metadata_equal": """
WITH r AS (SELECT t, row_number() OVER (ORDER BY t) AS rn FROM (SELECT DISTINCT vec_id AS t FROM embeddings)),
s AS (SELECT CAST(k AS INTEGER) AS k, coalesce(list(t ORDER BY t) FILTER (rn % k = 0), []) AS splits
      FROM r, (VALUES (32), (64), (128)) v(k) GROUP BY k)
SELECT k, splits = (SELECT splits FROM s WHERE k = 64) AS equal FROM s""",
    "open_catalog": _emb("SELECT tile_id, part, time_id, pos, v FROM emb_cat"),
    "scan_tile": _emb("SELECT part, time_id, pos, v FROM emb_cat WHERE tile_id = 0"),
    "to_records": _summary("v * 0.5"),
    "filter_time": _emb("SELECT tile_id, time_id, pos, v FROM emb_win"),
    "prune_parts": _emb("SELECT tile_id, time_id, pos, v FROM emb_win"),
    "filter_series_python": _emb("SELECT tile_id, time_id FROM emb_long GROUP BY tile_id, time_id HAVING bool_or(v > 0.25)"),
    "map_tiles_python": _emb("SELECT tile_id, time_id + 1 AS time_id, pos, v * 2 AS v FROM emb_long"),
    "filter_series": _emb("SELECT tile_id, time_id FROM emb_long GROUP BY tile_id, time_id HAVING bool_or(v > 0.25)"),
    "map_tiles": _emb("SELECT tile_id, time_id + 1 AS time_id, pos, v * 2 AS v FROM emb_long"),
    "map_cells": _emb("SELECT tile_id, time_id, pos, v * v AS v FROM emb_long"),
    "tile_sum": _tile_sum("emb_long"),
    "tile_sum_arrow": _tile_sum("emb_long"),
    "tile_sum_catalog": _tile_sum("emb_long"),
    "tile_sum_window": _tile_sum("emb_win"),
    "mosaic_sum": _raster_sum("emb_long"),
    "mosaic_sum_arrow": _raster_sum("emb_long"),
    "mosaic_sum_catalog": _raster_sum("emb_long"),
    "mosaic_sum_window": _raster_sum("emb_win"),
    "mosaic_sum_catalog_window": _raster_sum("emb_win"),
    "mosaic_sum_wide": """
SELECT CAST(r.range AS INTEGER) AS cell_row, CAST(idx AS INTEGER) AS cell_col, ROUND(s, 6) AS sum_v
FROM (SELECT idx, SUM(CAST(embedding[idx + 1] AS DOUBLE)) AS s
      FROM (SELECT embedding, UNNEST(range(len(embedding))) AS idx FROM embeddings) GROUP BY idx), range(64) r""",
    "mosaic_sum_ship": _ship("""
SELECT g.cell_row, g.cell_col, ROUND(COALESCE(SUM(s.v), 0.0), 6) AS sum_v
FROM ship_grid g LEFT JOIN ship s USING (cell_row, cell_col) GROUP BY g.cell_row, g.cell_col"""),
    "mosaic_sum_ship_window": _ship("""
SELECT g.cell_row, g.cell_col, ROUND(COALESCE(SUM(s.v), 0.0), 6) AS sum_v
FROM ship_grid g LEFT JOIN (SELECT * FROM ship WHERE time_id BETWEEN 17000 AND 17999) s USING (cell_row, cell_col)
GROUP BY g.cell_row, g.cell_col"""),
    "time_count": "SELECT COUNT(*) AS time_count FROM embeddings",
    "time_count_window": "SELECT COUNT(*) AS time_count FROM embeddings WHERE vec_id BETWEEN 100 AND 200",
    "mosaic_mean": _raster_mean(_MEAN),
    "mosaic_mean_arrow": _raster_mean(_MEAN),
    "mosaic_mean_catalog": _raster_mean(_MEAN),
    "mosaic_mean_window": _raster_mean(_MEAN_WINDOW),
    "mosaic_mean_catalog_window": _raster_mean(_MEAN_WINDOW),
    "mosaic_mean_ship": _ship("""
SELECT g.cell_row, g.cell_col,
       ROUND(COALESCE(SUM(s.v), 0.0) / (SELECT COUNT(DISTINCT time_id) FROM ship), 6) AS mean_v
FROM ship_grid g LEFT JOIN ship s USING (cell_row, cell_col) GROUP BY g.cell_row, g.cell_col"""),
    "min_max": _emb(f"""
SELECT ROUND(MIN(mean_v), 6) AS min_v, ROUND(MAX(mean_v), 6) AS max_v FROM ({_MEAN}) WHERE NOT isnan(mean_v)"""),
    "min_max_sum": _emb("""
SELECT ROUND(MIN(s), 6) AS min_v, ROUND(MAX(s), 6) AS max_v
FROM (SELECT SUM(v) AS s FROM emb_long GROUP BY cell_row, cell_col) WHERE NOT isnan(s)"""),
    "local_add": _LOCAL_ADD,
    "local_add_arrow": _LOCAL_ADD,
    "split_points": _emb("SELECT part, time_id AS split FROM emb_parts WHERE is_split"),
    "split_points_ship": _ship("SELECT part, time_id AS split FROM ship_parts WHERE is_split"),
    "assign_part": _ship("""
SELECT p.part, COUNT(*) AS n_rows, MIN(s.time_id) AS min_time, MAX(s.time_id) AS max_time
FROM ship s JOIN ship_parts p USING (time_id) GROUP BY p.part"""),
    "part_ranges": _emb("""
, s AS (SELECT part, time_id AS split FROM emb_parts WHERE is_split),
p AS (SELECT CAST(range AS INTEGER) AS part FROM range(0, (SELECT COUNT(*) FROM s) + 1))
SELECT p.part, CAST(COALESCE(lo.split + 1, -2147483648) AS INTEGER) AS part_min,
       CAST(COALESCE(hi.split, 2147483647) AS INTEGER) AS part_max
FROM p LEFT JOIN s hi ON hi.part = p.part LEFT JOIN s lo ON lo.part = p.part - 1"""),
    "series_by_part": _emb("""
SELECT part, COUNT(*) AS n_records, MIN(time_id) AS min_time, MAX(time_id) AS max_time
FROM emb_parts WHERE time_id BETWEEN 100 AND 200 GROUP BY part"""),
    "cache_series": _emb("""
SELECT tile_id, part, COUNT(DISTINCT time_id) AS n_records FROM emb_cat GROUP BY tile_id, part"""),
    "time_id": """
SELECT event_id, CAST(date_sub('day', TIMESTAMP '1950-01-01 12:00:00', ts) AS INTEGER) AS time_id FROM events""",
    "time_id_ship": """
SELECT l_shipdate, CAST(date_sub('day', TIMESTAMP '1950-01-01 12:00:00', l_shipdate) AS INTEGER) AS time_id
FROM (SELECT DISTINCT l_shipdate FROM lineitem)""",
    "time_date": """
SELECT CAST(vec_id AS INTEGER) AS time_id,
       TIMESTAMP '1950-01-01 12:00:00' + to_days(CAST(vec_id AS INTEGER)) AS time_date FROM embeddings""",
    "range_length": _emb("""
SELECT part, MIN(time_id) AS start_time, MAX(time_id) AS end_time, MAX(time_id) - MIN(time_id) AS range_length
FROM emb_parts GROUP BY part"""),
}
