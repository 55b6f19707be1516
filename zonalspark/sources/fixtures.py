"""Boundary, raster, event, task and catalogue relations as views over the star-schema tables.

Each text runs in Spark and in DuckDB; {table} stands for a table of the input folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_features": """SELECT CAST(n_nationkey AS BIGINT) AS geom_id, CAST(n_regionkey AS BIGINT) AS fc_id, n_name AS name,
  CAST(n_nationkey % 5 AS DOUBLE) * 20 - 50 AS minx, CAST(floor(n_nationkey / 5.0) AS DOUBLE) * 20 - 50 AS miny,
  CAST(n_nationkey % 5 AS DOUBLE) * 20 - 30 AS maxx, CAST(floor(n_nationkey / 5.0) AS DOUBLE) * 20 - 30 AS maxy FROM {nation}""",
    "fx_strips": """SELECT CAST(r_regionkey AS BIGINT) AS geom_id, r_name AS name, CAST(r_regionkey AS DOUBLE) * 20 - 50 AS minx,
  CAST(-50 AS DOUBLE) AS miny, CAST(r_regionkey AS DOUBLE) * 20 - 30 AS maxx, CAST(50 AS DOUBLE) AS maxy FROM {region}""",
    "fx_datasets": """SELECT CAST(r_regionkey AS BIGINT) AS dataset_id, CAST(-50 AS DOUBLE) AS minx, CAST(-50 AS DOUBLE) AS miny,
  CAST(r_regionkey AS DOUBLE) * 20 - 30 AS maxx, CAST(50 AS DOUBLE) AS maxy FROM {region}""",
    "fx_points": """SELECT event_id, user_id, event_type, value, ts,
  CAST((event_id * 7919) % 10000 AS DOUBLE) / 100 - 50 AS lon, CAST((event_id * 104729) % 9973 AS DOUBLE) / 100 - 50 AS lat FROM {events}""",
    "fx_pixels": """SELECT o_orderkey AS pixel_id, CAST(year(o_orderdate) AS BIGINT) AS label,
  CAST(o_orderkey % 200 AS DOUBLE) * 0.5 - 49.75 AS x,
  CAST((CAST(floor(o_orderkey / 7.0) AS BIGINT) * 31) % 200 AS DOUBLE) * 0.5 - 49.75 AS y,
  o_totalprice AS val, o_orderpriority AS class, o_orderstatus = 'P' AS is_nodata FROM {orders}""",
    "fx_polys": """SELECT s_suppkey AS poly_id, s_acctbal AS amount,
  CAST((s_suppkey * 13) % 90 AS DOUBLE) - 45 - (3 + s_suppkey % 4) AS minx, CAST((s_suppkey * 29) % 90 AS DOUBLE) - 45 - (3 + s_suppkey % 4) AS miny,
  CAST((s_suppkey * 13) % 90 AS DOUBLE) - 45 + (3 + s_suppkey % 4) AS maxx, CAST((s_suppkey * 29) % 90 AS DOUBLE) - 45 + (3 + s_suppkey % 4) AS maxy FROM {supplier}""",
    "fx_tasks": """SELECT l_orderkey AS req_id, l_orderkey * 10 + l_linenumber AS task_id, CAST(s_nationkey AS BIGINT) AS geom_id, CAST(year(l_shipdate) AS BIGINT) AS label,
  CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN -1 ELSE 0 END AS status, l_shipdate AS update_time, l_linestatus AS po_name, l_extendedprice AS float_value
  FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey""",
    "fx_requests": """SELECT o_orderkey AS req_id, o_custkey AS contact, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END AS status, o_orderdate AS submit_time FROM {orders}""",
    "fx_catalog": "SELECT p_partkey AS id, p_name AS title, p_type AS type, p_brand AS source_name, p_size AS group_level, p_retailprice AS val FROM {part}",
    "fx_collections": "SELECT CAST(r_regionkey AS BIGINT) AS fc_id, r_name AS name, r_regionkey <> 3 AS active, r_regionkey = 4 AS is_user_upload FROM {region}",
    "fx_sets": """SELECT CAST(r_regionkey AS BIGINT) AS dataset_id, lower(r_name) AS name, CASE WHEN r_regionkey IN (0, 2, 4) THEN concat('Set of ', r_name) END AS title,
  CASE WHEN r_regionkey < 3 THEN 'raster' ELSE 'vector' END AS type, r_regionkey <> 1 AS active,
  CASE WHEN r_regionkey = 0 THEN '{{"filters":{{"k":1}},"outcomes":["a","b"]}}' WHEN r_regionkey = 1 THEN '{{"filters":null}}' WHEN r_regionkey = 2 THEN '[]' END AS other FROM {region}""",
    "fx_resources": """SELECT CAST(r_regionkey AS BIGINT) * 10000 + y AS resource_id, CAST(r_regionkey AS BIGINT) AS dataset_id, CAST(y AS STRING) AS label
  FROM {region} CROSS JOIN (SELECT DISTINCT year(o_orderdate) AS y FROM {orders}) AS years""",
    "fx_options": """SELECT CAST(r_regionkey * 10 + k AS BIGINT) AS po_id, CAST(r_regionkey AS BIGINT) AS dataset_id, short_name, active, public FROM {region}
  CROSS JOIN (VALUES (0, 'mean', true, true), (1, 'sum', true, false), (2, 'count', false, true), (3, 'area', true, true)) AS o(k, short_name, active, public)""",
    "fx_dated": """SELECT day, kind, CASE kind WHEN 0 THEN concat('grid_', y, '.tif') WHEN 1 THEN concat('grid_', y, '_', m, '.tif') WHEN 2 THEN concat('g', y, m, d, 'x2.tif') WHEN 3 THEN concat(y, '.', j, '.tif') WHEN 4 THEN 'grid.tif' ELSE concat('grid_', substr(y, 1, 3), 'x.tif') END AS fname,
  CASE kind WHEN 0 THEN 'grid_YYYY.tif' WHEN 1 THEN 'grid_YYYY_MM.tif' WHEN 2 THEN 'gYYYYMMDD' WHEN 3 THEN 'YYYY.DDD.tif' WHEN 4 THEN 'grid.tif' ELSE 'grid_YYYY.tif' END AS mask
  FROM (SELECT day, k AS kind, CAST(year(day) AS STRING) AS y, lpad(CAST(month(day) AS STRING), 2, '0') AS m, lpad(CAST(dayofmonth(day) AS STRING), 2, '0') AS d, lpad(CAST(dayofyear(day) AS STRING), 3, '0') AS j
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM {orders}) AS days CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS kinds(k)) AS parts""",
    "fx_files": """SELECT DISTINCT concat('grid_', CAST(year(o_orderdate) AS STRING), '_', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '.tif') AS fname, 'grid_YYYY_MM.tif' AS mask FROM {orders}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in re.findall(r"(?<!\{)\{(\w+)\}", text)}
    return spark.sql(text, **tables)


def with_views(*names: str) -> str:
    """The views as the beginning of a SQL query over the registered tables; doubled braces stand for one."""
    return "WITH " + ",\n".join(f"{n} AS ({re.sub(r'([{}])[{}]?', lambda m: m[1] if len(m[0]) > 1 else '', VIEWS[n])})" for n in names)
