"""Exchange formats written from the tables and read back: what comes back is what went in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources import exchange as E
from ..sources.derived import ctes, derived


@query("S01_K06_gpx_tracks", ctes("track_points") + " SELECT track_id, seq, lng, lat FROM track_points")
def s01(s, d):
    return E.read_gpx(E.to_gpx(derived(s, d, "track_points"), "track_id", "seq"), "track_id").select("track_id", "seq", "lng", "lat")


@query("S02_K06_gpx_waypoints", ctes("controls") + " SELECT course_id, ord AS seq, lng, lat, CAST(30 + ord AS VARCHAR) AS name FROM controls")
def s02(s, d):
    files = E.to_gpx(derived(s, d, "controls"), "course_id", "ord", "wpt", F.col("ord") + 30)
    return E.read_gpx(files, "course_id", waypoints=True).select("course_id", "seq", "lng", "lat", "name")


@query("S08_K07_kml", ctes("controls") + " SELECT course_id, ord AS seq, lng, lat, CAST(30 + ord AS VARCHAR) AS name FROM controls")
def s08(s, d):
    return E.read_kml(E.to_kml(derived(s, d, "controls"), "course_id", "ord", F.col("ord") + 30), "course_id")


@query("K02_geojson", ctes("candidates") + " SELECT cand_id, ftype, lng, lat FROM candidates")
def k02(s, d):
    return E.read_geojson(E.to_geojson(derived(s, d, "candidates"), "cand_id", "ftype"), "cand_id long, ftype string").select("cand_id", "ftype", "lng", "lat")


@query("S16_course_json", ctes("controls") + " SELECT course_id, ord, lng AS x, lat AS y, CAST(ord AS VARCHAR) AS code FROM controls WHERE course_id % 7 <> 0 AND course_id IN (SELECT course_id FROM controls GROUP BY 1 HAVING count(*) >= 3)")
def s16(s, d):
    """Every seventh file lacks a code, and is refused."""
    c = derived(s, d, "controls").groupBy("course_id").agg(F.array_sort(F.collect_list(F.struct("ord", "lng", "lat"))).alias("p"))
    codes = F.slice("p", 1, F.size("p") - F.when(F.col("course_id") % 7 == 0, 1).otherwise(0))
    body = F.struct(F.col("p.lng").alias("xpos"), F.col("p.lat").alias("ypos"), F.transform(codes, lambda z: z["ord"].cast("string")).alias("codes"))
    return E.read_course_json(c.select("course_id", F.to_json(body).alias("body")), "course_id", "body")


@query("S03_point_list", ctes("track_points") + " SELECT track_id, CAST(seq - 1 AS INT) AS at, lng, lat, CAST(floor(t_s) AS BIGINT) AS t FROM track_points WHERE seq % 10 <> 0")
def s03(s, d):
    """Every tenth point has no latitude, and is skipped."""
    p = F.struct("seq", F.when(F.col("seq") % 10 != 0, F.col("lat")).alias("lat"), F.col("lng").alias("lon"), F.col("t_s").alias("time"))
    files = derived(s, d, "track_points").groupBy("track_id").agg(F.to_json(F.array_sort(F.collect_list(p))).alias("body"))
    return E.read_point_list(files, "track_id", "body").withColumn("t", F.unix_seconds("t"))
