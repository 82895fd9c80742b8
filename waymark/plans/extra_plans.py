"""Further forms of queries: projections, bounds, covers, keys with parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import courses as C
from ..registry import query
from ..sources.derived import ctes, derived, raw
from .course_plans import LEGS


def _c(s, d):
    return derived(s, d, "controls")


@query("F28_projections", ctes("controls") + ", p AS (SELECT DISTINCT lng, lat FROM controls) SELECT round(lng, 7) AS lng, round(lat, 7) AS lat, unnest([2154, 3857, 32631, 32632, 4326]) AS epsg FROM p")
def f28(s, d):
    """Places are projected and brought back, by five systems: Lambert-93, Web-Mercator, two UTM zones, degrees."""
    p = _c(s, d).select("lng", "lat").distinct()
    x, y = F.col("lng"), F.col("lat")
    out = {2154: geo.lambert93(x, y), 3857: geo.mercator(x, y), 32631: geo.utm(x, y, 31), 32632: geo.utm(x, y, 32), 4326: (x, y)}
    there = p.select(F.explode(F.array(*[F.struct(F.lit(e).alias("epsg"), a.alias("x"), b.alias("y")) for e, (a, b) in out.items()])).alias("q")).select("q.*")
    back = {e: geo.to_degrees(F.col("x"), F.col("y"), e) for e in out}
    pick = lambda i: F.coalesce(*[F.when(F.col("epsg") == e, v[i]) for e, v in back.items()])
    return there.select(F.round(pick(0), 7).alias("lng"), F.round(pick(1), 7).alias("lat"), "epsg")


@query("P26_low_scores", LEGS + " SELECT course_id FROM s WHERE n >= 3 AND greatest(0, least(100, (greatest(0, 1 - std_leg / greatest(mean_leg, 1)) * 0.4 + good_turns / greatest(1, n - 2) * 0.6) * 100 - straight15 * 8 - under15 * 10)) / 100 < 0.1")
def p26(s, d):
    """Courses whose quality is under a tenth."""
    return C.summary(_c(s, d)).where(C.quality_gpx() < 0.1).select("course_id")


@query("A20_merged_bounds", ctes("controls") + " SELECT course_id // 8 AS file_id, min(lng) AS min_x, min(lat) AS min_y, max(lng) AS max_x, max(lat) AS max_y, count(DISTINCT course_id) AS courses FROM controls GROUP BY 1")
def a20(s, d):
    """Bounds of each file's courses together: those of the courses are merged."""
    one = _c(s, d).groupBy("course_id").agg(F.min("lng").alias("a"), F.min("lat").alias("b"), F.max("lng").alias("c"), F.max("lat").alias("e"))
    return one.groupBy(F.expr("course_id div 8").alias("file_id")).agg(F.min("a").alias("min_x"), F.min("b").alias("min_y"), F.max("c").alias("max_x"), F.max("e").alias("max_y"), F.count("*").alias("courses"))


@query("J12_new_by_prefix", "WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents), k AS (SELECT h || CASE WHEN doc_id % 2 = 0 THEN ':' || doc_id ELSE '' END AS key FROM d WHERE doc_id % 3 = 0) SELECT doc_id FROM d WHERE doc_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM k WHERE key = h OR starts_with(key, h || ':'))")
def j12(s, d):
    """Rows whose hash is not among the stored keys, which are a hash, or a hash and the number of a part."""
    rows = raw(s, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    stored = rows.where("doc_id % 3 = 0").select(F.concat("h", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(":"), "doc_id")).otherwise("")).alias("key"))
    return rows.where("doc_id % 3 <> 0").join(stored.select(F.split("key", ":")[0].alias("h")).distinct(), "h", "left_anti").select("doc_id")


@query("J20_nodes_5dp", ctes("controls") + ", n AS (SELECT course_id, round_even(lng + course_id % 3 * 0.000001, 5) AS lng, round_even(lat, 5) AS lat FROM controls) SELECT lng, lat, count(DISTINCT course_id) AS courses FROM n GROUP BY ALL HAVING count(DISTINCT course_id) >= 2")
def j20(s, d):
    """Nodes that two courses share once coordinates are cut to five decimals."""
    n = _c(s, d).select("course_id", F.bround(F.col("lng") + F.col("course_id") % 3 * 0.000001, 5).alias("lng"), F.bround("lat", 5).alias("lat"))
    return n.groupBy("lng", "lat").agg(F.count_distinct("course_id").alias("courses")).where("courses >= 2")


_TX, _TY = "CAST(floor(({x} + 180) / 360 * 262144) AS BIGINT)", "CAST(floor((1 - ln(tan(radians({y})) + 1 / cos(radians({y}))) / pi()) / 2 * 262144) AS BIGINT)"


@query("J32_xyz_cover", ctes("areas") + f", t AS (SELECT area_id, {_TX.format(x='min_lng')} AS x0, {_TX.format(x='max_lng')} AS x1, {_TY.format(y='max_lat')} AS y0, {_TY.format(y='min_lat')} AS y1 FROM areas), u AS (SELECT area_id, unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM t) SELECT area_id, x, unnest(range(y0, y1 + 1)) AS y FROM u")
def j32(s, d):
    """Tiles of zoom 18 that an area's box touches."""
    x0, y1 = geo.tile(F.col("min_lng"), F.col("min_lat"), 18)
    x1, y0 = geo.tile(F.col("max_lng"), F.col("max_lat"), 18)
    return derived(s, d, "areas").select("area_id", F.sequence(x0, x1).alias("xs"), F.sequence(y0, y1).alias("ys")).withColumn("x", F.explode("xs")).select("area_id", "x", F.explode("ys").alias("y"))


@query("P01_clip", ctes("controls") + ", r AS (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY ord) AS rn, count(*) OVER (PARTITION BY course_id) AS n FROM controls) SELECT course_id, CAST(ord AS INT) AS ord FROM r WHERE rn = 1 OR rn = n OR (lng BETWEEN 5.484 AND 5.496 AND lat BETWEEN 49.181 AND 49.189)")
def p01(s, d):
    """Controls in a box and 0.001 degrees about it; starts and finishes stay wherever they are."""
    r = _c(s, d).withColumns({"rn": F.row_number().over(C.by_order()), "n": F.count("*").over(C.whole())})
    near = F.col("lng").between(5.484, 5.496) & F.col("lat").between(49.181, 49.189)
    return r.where((F.col("rn") == 1) | (F.col("rn") == F.col("n")) | near).select("course_id", "ord")


@query("F30_buffered_boxes", ctes("areas") + " SELECT area_id, round(min_lng - 50 / (111320 * cos(radians((min_lat + max_lat) / 2))), 8) AS x0, round(min_lat - 50 / 111320.0::DOUBLE, 8) AS y0, round(max_lng + 50 / (111320 * cos(radians((min_lat + max_lat) / 2))), 8) AS x1, round(max_lat + 50 / 111320.0::DOUBLE, 8) AS y1 FROM areas WHERE min_lng < max_lng AND min_lat < max_lat")
def f30(s, d):
    """Boxes with 50 m more on each side; boxes without extent are refused."""
    wide, high = 50 / (geo.METRES_PER_DEGREE * F.cos(F.radians((F.col("min_lat") + F.col("max_lat")) / 2))), 50 / geo.METRES_PER_DEGREE
    a = derived(s, d, "areas").where("min_lng < max_lng AND min_lat < max_lat")
    return a.select("area_id", F.round(F.col("min_lng") - wide, 8).alias("x0"), F.round(F.col("min_lat") - high, 8).alias("y0"), F.round(F.col("max_lng") + wide, 8).alias("x1"), F.round(F.col("max_lat") + high, 8).alias("y1"))


@query("F08_vertex_angles", ctes("controls") + """, w AS (SELECT *, lag(lng) OVER o - lng AS ax, lag(lat) OVER o - lat AS ay, lead(lng) OVER o - lng AS bx, lead(lat) OVER o - lat AS by_ FROM controls WINDOW o AS (PARTITION BY course_id ORDER BY ord)), n AS (SELECT *, sqrt(ax * ax + ay * ay) * sqrt(bx * bx + by_ * by_) AS m FROM w)
  SELECT course_id, CAST(ord AS INT) AS ord, round(degrees(acos(greatest(-1, least(1, (ax * bx + ay * by_) / m)))), 2) AS angle FROM n WHERE m > 1e-14""")  # fmt: skip
def f08(s, d):
    """The angle between the ways back and on, in plain coordinates; none where a way has no length."""
    w = C.by_order()
    c = _c(s, d).select("course_id", "ord", (F.lag("lng").over(w) - F.col("lng")).alias("ax"), (F.lag("lat").over(w) - F.col("lat")).alias("ay"), (F.lead("lng").over(w) - F.col("lng")).alias("bx"), (F.lead("lat").over(w) - F.col("lat")).alias("by"))
    c = c.withColumn("m", F.hypot("ax", "ay") * F.hypot("bx", "by")).where("m > 1e-14")
    cos = (F.col("ax") * F.col("bx") + F.col("ay") * F.col("by")) / F.col("m")
    return c.select("course_id", "ord", F.round(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))), 2).alias("angle"))


@query("A14_codes_by_course", LEGS + """ SELECT course_id, count(*) FILTER (back < 20) AS c01, count(*) FILTER (leg_in < 30) AS c02, count(*) FILTER (leg_in > 400) AS c03, count(*) FILTER (turn < 20) AS c12 FROM legs GROUP BY course_id""")
def a14(s, d):
    """Findings of the leg rules, counted by code for each course in one pass; clean courses too."""
    n = lambda e: F.count_if(F.coalesce(F.expr(e), F.lit(False)))
    return C.legs(_c(s, d)).groupBy("course_id").agg(n("back < 20").alias("c01"), n("leg_in < 30").alias("c02"), n("leg_in > 400").alias("c03"), n("turn < 20").alias("c12"))
