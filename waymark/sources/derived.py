"""Courses, tracks, map areas and candidates, derived from the driver's tables by expressions that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CONTROLS = """SELECT l_orderkey AS course_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS INT) AS ord,
  CAST(5.48 + (l_partkey % 200) * 0.0001 AS DOUBLE) AS lng, CAST(49.18 + (l_suppkey % 100) * 0.0001 AS DOUBLE) AS lat,
  CAST(200 + l_quantity * 2 AS DOUBLE) AS ele FROM {lineitem}"""
TRACK_POINTS = """SELECT user_id AS track_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq,
  CAST(5.48 + ((dayofmonth(ts) - 1) * 24 + hour(ts)) * (0.0002 + (user_id % 5) * 0.00003) + (event_id % 11 - 5) * 0.00001 + CASE WHEN event_id % 50 = 0 THEN 0.02 ELSE 0.00 END AS DOUBLE) AS lng,
  CAST(49.18 + (event_id % 13 - 6) * 0.00001 AS DOUBLE) AS lat,
  CAST(((dayofmonth(ts) - 1) * 24 + hour(ts)) * 6 + minute(ts) / 10.0 AS DOUBLE) AS t_s FROM {events}"""
RACE_CONTROLS = "SELECT CAST(r_regionkey AS INT) AS ord, CAST(5.48 + r_regionkey * 0.03 AS DOUBLE) AS lng, CAST(49.18 AS DOUBLE) AS lat FROM {region}"
AREAS = """SELECT p_partkey AS area_id, CAST(101 + (p_partkey * 7) % 429 AS INT) AS isom,
  CAST(5.48 + (p_partkey % 200) * 0.0001 AS DOUBLE) AS min_lng, CAST(5.48 + (p_partkey % 200) * 0.0001 + p_size * 0.00002 AS DOUBLE) AS max_lng,
  CAST(49.18 + ((p_partkey * 31) % 100) * 0.0001 AS DOUBLE) AS min_lat, CAST(49.18 + ((p_partkey * 31) % 100) * 0.0001 + p_size * 0.00002 AS DOUBLE) AS max_lat FROM {part}"""
CANDIDATES = """SELECT s_suppkey AS cand_id, CAST(5.48 + ((s_suppkey * 17) % 200) * 0.0001 AS DOUBLE) AS lng, CAST(49.18 + ((s_suppkey * 29) % 100) * 0.0001 AS DOUBLE) AS lat,
  CASE s_suppkey % 4 WHEN 0 THEN 'intersection' WHEN 1 THEN 'building_corner' WHEN 2 THEN 'steps' ELSE 'path' END AS ftype FROM {supplier}"""
TABLES = {"controls": (CONTROLS, "lineitem"), "track_points": (TRACK_POINTS, "events"), "race_controls": (RACE_CONTROLS, "region"), "areas": (AREAS, "part"), "candidates": (CANDIDATES, "supplier")}


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, table = TABLES[name]
    return spark.sql(text.format_map({table: "{t}"}), t=raw(spark, sf_dir, table))


def filed(spark: SparkSession, sf_dir: str, courses: int) -> DataFrame:
    """Controls with file_id, the file of so many courses that theirs is in. Lines are dealt by file before they are numbered, so that whoever gathers courses and files moves nothing again."""
    lines = raw(spark, sf_dir, "lineitem").selectExpr(f"l_orderkey div {courses} AS file_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    text = CONTROLS.replace("SELECT l_orderkey", "SELECT file_id, l_orderkey").replace("PARTITION BY l_orderkey", "PARTITION BY file_id, l_orderkey")
    return spark.sql(text.format(lineitem="{t}"), t=lines.repartition("file_id"))


def ctes(*names: str) -> str:
    """The same tables as the head of a DuckDB query."""
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n][0].format_map({TABLES[n][1]: TABLES[n][1]})})" for n in names)
