"""Queries that join points with map areas and candidates, and grids and graphs over them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import courses as C
from ..operators import spatial as S
from ..registry import query
from ..sources.derived import ctes, derived
from .course_plans import LEGS

_SHIFT = 0.000005
_CC = ctes("controls", "candidates")


def _points(s, d):
    return derived(s, d, "controls").select("course_id", "ord", "lng", "lat")


@query("J05_nearest_candidate", _CC + f""", m AS (SELECT course_id, ord, cand_id, round({geo.hav_sql('c.lng', 'c.lat', 'k.lng', 'k.lat')}, 3) AS metres FROM controls c JOIN candidates k ON abs(c.lng - k.lng) < 0.003 AND abs(c.lat - k.lat) < 0.002),
  b AS (SELECT course_id, ord, min((metres, cand_id)) AS z FROM m WHERE metres <= 100 GROUP BY ALL) SELECT c.course_id, c.ord, z[2] AS cand_id, z[1] AS metres FROM controls c LEFT JOIN b USING (course_id, ord)""")  # fmt: skip
def j05(s, d):
    return S.nearest(_points(s, d), derived(s, d, "candidates"), 100, ["course_id", "ord"], "cand_id")


@query("J06_radius_count", _CC + f""" SELECT course_id, ord, count(*) AS n, count(*) FILTER (ftype = 'path') AS paths FROM controls c JOIN candidates k ON abs(c.lng - k.lng) < 0.003 AND abs(c.lat - k.lat) < 0.002
  WHERE {geo.hav_sql('c.lng', 'c.lat', 'k.lng', 'k.lat')} <= 75 GROUP BY ALL""")  # fmt: skip
def j06(s, d):
    """Candidates about each control, and the paths of them; places are compared once each."""
    spots = derived(s, d, "candidates").groupBy("lng", "lat").agg(F.count("*").alias("k"), F.count_if(F.col("ftype") == "path").alias("p"))
    found = S.radius_pairs(_points(s, d).select("lng", "lat").distinct(), spots, 75).groupBy("lng", "lat").agg(F.sum("k").alias("n"), F.sum("p").alias("paths"))
    return _points(s, d).join(found, ["lng", "lat"]).select("course_id", "ord", "n", "paths")


#: Areas as rings of five corners, one of them bent inwards; in both dialects.
_RING = (("min_lng", "min_lat"), ("max_lng", "min_lat"), ("max_lng", "max_lat"), ("(min_lng + max_lng) / 2", "(min_lat + 2 * max_lat) / 3"), ("min_lng", "max_lat"))


def _rings(s, d):
    """area_id, isom, ring."""
    return derived(s, d, "areas").select("area_id", "isom", F.array(*[F.struct(F.expr(x).alias("x"), F.expr(y).alias("y")) for x, y in _RING]).alias("ring"))


def _edges_sql() -> str:
    """How many edges of an area's ring a ray to the east of (x, y) crosses."""
    ends = [*_RING[1:], _RING[0]]
    return " + ".join(f"CASE WHEN (({ay}) > y) <> (({by}) > y) AND x < (({bx}) - ({ax})) * (y - ({ay})) / nullif(({by}) - ({ay}), 0) + ({ax}) THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in zip(_RING, ends, strict=True))


_HELD = f""", pl AS (SELECT DISTINCT lng, lat, lng + {_SHIFT} AS x, lat + {_SHIFT} AS y FROM controls),
  held AS (SELECT lng, lat, area_id, isom FROM pl JOIN areas ON x BETWEEN min_lng AND max_lng AND y BETWEEN min_lat AND max_lat WHERE ({_edges_sql()}) % 2 = 1)"""


def _shifted(s, d):
    return _points(s, d).withColumns({"lng": F.col("lng") + _SHIFT, "lat": F.col("lat") + _SHIFT})


@query("J09_point_in_polygon", ctes("controls", "areas") + _HELD + ", g AS (SELECT lng, lat, min(area_id) AS area_id, count(*) AS n FROM held GROUP BY ALL) SELECT course_id, ord, area_id, n FROM controls JOIN g USING (lng, lat)")
def j09(s, d):
    points = _shifted(s, d)
    return points.join(S.places_inside(points, _rings(s, d)), ["lng", "lat"]).select("course_id", "ord", "area_id", "n")


@query("C08_out_of_bounds", ctes("controls", "areas") + _HELD + " SELECT DISTINCT course_id, ord FROM controls JOIN (SELECT DISTINCT lng, lat FROM held WHERE isom % 10 = 9) USING (lng, lat)")
def c08(s, d):
    points = _shifted(s, d)
    return points.join(S.places_inside(points, _rings(s, d).where("isom % 10 = 9")), ["lng", "lat"]).select("course_id", "ord")


_METRES = "CAST(20 + area_id % 60 AS DOUBLE)"


@query("J10_outside_zones", ctes("controls", "areas") + _HELD + f""", z AS (SELECT lng, lat FROM held WHERE isom % 10 = 9
    UNION SELECT lng, lat FROM pl JOIN (SELECT min_lng, min_lat, {_METRES} AS metres FROM areas WHERE isom % 10 = 8) k ON abs(x - min_lng) < 0.002 AND abs(y - min_lat) < 0.001 WHERE {geo.hav_sql('x', 'y', 'min_lng', 'min_lat')} <= metres)
  SELECT course_id, ord FROM controls WHERE (lng, lat) NOT IN (SELECT (lng, lat) FROM z)""")  # fmt: skip
def j10(s, d):
    """Zones are rings, or circles about the first corner of other areas."""
    none = lambda t: F.lit(None).cast(t)
    rings = _rings(s, d).where("isom % 10 = 9").select(F.col("area_id").alias("zone_id"), "ring", none("double").alias("lng"), none("double").alias("lat"), none("double").alias("metres"))
    circles = derived(s, d, "areas").where("isom % 10 = 8").select(F.col("area_id").alias("zone_id"), none("array<struct<x:double,y:double>>").alias("ring"), F.col("min_lng").alias("lng"), F.col("min_lat").alias("lat"), F.expr(_METRES).alias("metres"))
    points = _shifted(s, d)
    return points.join(S.in_zones(points, rings.unionByName(circles)), ["lng", "lat"], "left_anti").select("course_id", "ord")


_CORNERS = "SELECT lng, lat, x, y FROM pl JOIN (" + " UNION ".join(f"SELECT {x} AS vx, {y} AS vy FROM areas" for x, y in _RING) + f") v ON abs(x - vx) < 0.003 AND abs(y - vy) < 0.002 WHERE {geo.hav_sql('x', 'y', 'vx', 'vy')} <= 45"


@query("J23_coverage", ctes("controls", "areas") + f", pl AS (SELECT DISTINCT lng, lat, lng AS x, lat AS y FROM controls), k AS (SELECT DISTINCT lng, lat FROM ({_CORNERS})) SELECT course_id, ord FROM controls JOIN k USING (lng, lat)")
def j23(s, d):
    """Near any corner of any area. Places are looked up once each, however many controls stand there."""
    places = _points(s, d).select("lng", "lat").distinct()
    corners = _rings(s, d).select(F.explode("ring").alias("v")).select(F.col("v.x").alias("lng"), F.col("v.y").alias("lat")).distinct()
    return _points(s, d).join(S.radius_pairs(places, corners, 45).select("lng", "lat").distinct(), ["lng", "lat"]).select("course_id", "ord")


@query("P11_A22_categories", ctes("areas") + f" SELECT {S.category_sql('isom')} AS category, count(*) AS n, count(DISTINCT isom) AS codes FROM areas GROUP BY 1")
def a22(s, d):
    return derived(s, d, "areas").groupBy(S.category(F.col("isom")).alias("category")).agg(F.count("*").alias("n"), F.count_distinct("isom").alias("codes"))


@query("P01_bbox", ctes("controls") + " SELECT course_id, ord FROM controls WHERE lng BETWEEN 5.485 AND 5.495 AND lat BETWEEN 49.182 AND 49.188")
def p01(s, d):
    return _points(s, d).where(F.col("lng").between(5.485, 5.495) & F.col("lat").between(49.182, 49.188)).select("course_id", "ord")


@query("P02_sane_wgs84", ctes("candidates") + " SELECT cand_id FROM candidates WHERE abs(lat) <= 85 AND abs(lng) <= 180 AND NOT (abs(lat) < 0.01 AND abs(lng) < 0.01)")
def p02(s, d):
    return derived(s, d, "candidates").where("abs(lat) <= 85 AND abs(lng) <= 180 AND NOT (abs(lat) < 0.01 AND abs(lng) < 0.01)").select("cand_id")


_RANKS = "(SELECT {c} FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS i, count(*) OVER () AS n FROM areas) WHERE i = least(n - 1, CAST(floor(n * {p}) AS BIGINT)))"


@query("A21_robust_bbox", ctes("areas") + " SELECT " + ", ".join(f"{_RANKS.format(c=c, p=p)} AS {a}" for c, p, a in (("min_lng", 0.01, "x0"), ("min_lat", 0.01, "y0"), ("min_lng", 0.99, "x1"), ("min_lat", 0.99, "y1"))))
def a21(s, d):
    """The value at place floor(n * share) of each coordinate in order. Values are counted first: what is ordered and summed up
    is a row for each distinct value."""
    areas = derived(s, d, "areas")

    def ranks(c: str, names: dict[str, float]):
        counts = areas.where(F.col(c).isNotNull()).groupBy(c).count()
        upto = counts.withColumn("upto", F.sum("count").over(Window.orderBy(c))).withColumn("n", F.sum("count").over(Window.partitionBy()))
        at = lambda p: F.least(F.col("n") - 1, F.floor(F.col("n") * p))
        return upto.agg(*[F.min(F.when(F.col("upto") > at(p), F.col(c))).alias(a) for a, p in names.items()])

    return ranks("min_lng", {"x0": 0.01, "x1": 0.99}).crossJoin(ranks("min_lat", {"y0": 0.01, "y1": 0.99})).select("x0", "y0", "x1", "y1")


@query("F16_tiles", ctes("controls") + """ SELECT x, y, count(*) AS n FROM (SELECT CAST(floor((lng + 180) / 360 * 65536) AS BIGINT) AS x,
  CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 65536) AS BIGINT) AS y FROM controls) GROUP BY ALL""")  # fmt: skip
def f16(s, d):
    x, y = geo.tile(F.col("lng"), F.col("lat"), 16)
    return _points(s, d).groupBy(x.alias("x"), y.alias("y")).agg(F.count("*").alias("n"))


@query("J32_tile_cover", ctes("areas") + """ SELECT area_id, x, y FROM (SELECT area_id, unnest(range(CAST(floor(min_lng / 0.0005) AS BIGINT), CAST(floor(max_lng / 0.0005) AS BIGINT) + 1)) AS x, min_lat, max_lat FROM areas),
  LATERAL (SELECT unnest(range(CAST(floor(min_lat / 0.0005) AS BIGINT), CAST(floor(max_lat / 0.0005) AS BIGINT) + 1)) AS y)""")  # fmt: skip
def j32(s, d):
    span = lambda lo, hi: F.explode(F.sequence(geo.cell(F.col(lo), 0.0005), geo.cell(F.col(hi), 0.0005)))
    return derived(s, d, "areas").withColumn("x", span("min_lng", "max_lng")).withColumn("y", span("min_lat", "max_lat")).select("area_id", "x", "y")


@query("F11_F12_leg_times", LEGS + """, z AS (SELECT *, ele - lag(ele) OVER (PARTITION BY course_id ORDER BY ord) AS up FROM legs)
  SELECT course_id, ord, round(leg_in / (170 * 0.7 * exp(-3.5 * abs(up / leg_in + 0.05)) / exp(-0.175)), 3) AS minutes FROM z WHERE leg_in > 1 AND abs(up) < leg_in""")  # fmt: skip
def f12(s, d):
    z = C.legs(derived(s, d, "controls")).withColumn("up", F.col("ele") - F.lag("ele").over(C.by_order())).where("leg_in > 1 AND abs(up) < leg_in")
    return z.select("course_id", "ord", F.round(F.col("leg_in") / (170 * 0.7 * geo.tobler(F.col("up") / F.col("leg_in"))), 3).alias("minutes"))


_GRAPH = LEGS + """, ed AS (SELECT course_id, round_even(lng, 6) || ',' || round_even(lat, 6) AS a, round_even(nx, 6) || ',' || round_even(ny, 6) AS b, leg_out AS w FROM legs WHERE leg_out IS NOT NULL),
  g AS (SELECT course_id % 16 AS area_id, least(a, b) AS src, greatest(a, b) AS dst, min(w) AS weight FROM ed WHERE a <> b GROUP BY ALL)"""  # fmt: skip


def _graph(s, d):
    at = lambda x, y: F.concat(F.bround(F.col(x), 6).cast("string"), F.lit(","), F.bround(F.col(y), 6).cast("string"))
    full = C.legs(derived(s, d, "controls").select("course_id", "ord", "lng", "lat")).withColumns({"nx": F.lead("lng").over(C.by_order()), "ny": F.lead("lat").over(C.by_order())}).where("leg_out IS NOT NULL")
    x = full.select((F.col("course_id") % 16).alias("area_id"), at("lng", "lat").alias("a"), at("nx", "ny").alias("b"), F.col("leg_out").alias("w")).where("a <> b")
    return x.groupBy("area_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.min("w").alias("weight"))


@query("G01_street_graph", _GRAPH + " SELECT area_id, src, dst, round(weight, 2) AS weight FROM g")
def g01(s, d):
    return _graph(s, d).withColumn("weight", F.round("weight", 2))


@query("G04_graph_size", _GRAPH + """, n AS (SELECT area_id, count(*) AS edges, round(sum(weight), 1) AS metres FROM g GROUP BY area_id),
  m AS (SELECT area_id, count(DISTINCT v) AS nodes FROM (SELECT area_id, src AS v FROM g UNION ALL SELECT area_id, dst FROM g) GROUP BY area_id) SELECT * FROM n JOIN m USING (area_id)""")  # fmt: skip
def g04(s, d):
    g = _graph(s, d)
    n = g.groupBy("area_id").agg(F.count("*").alias("edges"), F.round(F.sum("weight"), 1).alias("metres"))
    return n.join(g.select("area_id", F.explode(F.array("src", "dst")).alias("v")).groupBy("area_id").agg(F.count_distinct("v").alias("nodes")), "area_id")


@query("J20_shared_nodes", ctes("controls") + " SELECT lng, lat, count(DISTINCT course_id) AS courses FROM controls GROUP BY ALL HAVING count(DISTINCT course_id) >= 2")
def j20(s, d):
    return _points(s, d).groupBy("lng", "lat").agg(F.count_distinct("course_id").alias("courses")).where("courses >= 2")


@query("J19_coarse_dedup", ctes("candidates") + " SELECT min(cand_id) AS cand_id FROM candidates GROUP BY round_even(lng, 3), round_even(lat, 3)")
def j19(s, d):
    return derived(s, d, "candidates").groupBy(F.bround("lng", 3), F.bround("lat", 3)).agg(F.min("cand_id").alias("cand_id")).select("cand_id")


@query("T02_top_candidates", ctes("candidates") + """ SELECT cand_id, score FROM (SELECT cand_id, round(CASE ftype WHEN 'intersection' THEN 0.85 WHEN 'steps' THEN 0.45 WHEN 'path' THEN 0.15 ELSE 0.75 END, 2) AS score FROM candidates)
  ORDER BY score DESC, cand_id LIMIT 20""")  # fmt: skip
def t02(s, d):
    score = F.when(F.col("ftype") == "intersection", 0.85).when(F.col("ftype") == "steps", 0.45).when(F.col("ftype") == "path", 0.15).otherwise(0.75)
    return derived(s, d, "candidates").select("cand_id", score.alias("score")).orderBy(F.desc("score"), "cand_id").limit(20)


@query("J16_snap_to_existing", _CC + f""", e AS (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY ord) AS rn, count(*) OVER (PARTITION BY course_id) AS n FROM controls),
  m AS (SELECT course_id, ord, min(cand_id) AS cand_id FROM e c JOIN candidates k ON abs(c.lng - k.lng) < 0.001 AND abs(c.lat - k.lat) < 0.001
  WHERE rn > 1 AND rn < n AND {geo.hav_sql('c.lng', 'c.lat', 'k.lng', 'k.lat')} <= 15 GROUP BY ALL)
  SELECT c.course_id, c.ord, coalesce(k.lng, c.lng) AS lng, coalesce(k.lat, c.lat) AS lat FROM controls c LEFT JOIN m USING (course_id, ord) LEFT JOIN candidates k USING (cand_id)""")  # fmt: skip
def j16(s, d):
    """Starts and finishes stay where they are."""
    c, k = _points(s, d), derived(s, d, "candidates")
    placed = c.withColumns({"rn": F.row_number().over(C.by_order()), "n": F.count("*").over(C.whole())})
    places = placed.where("rn > 1 AND rn < n").select("lng", "lat").distinct()
    near = S.radius_pairs(places, k, 15).groupBy("lng", "lat").agg(F.min(F.struct("cand_id", F.col("__x").alias("x"), F.col("__y").alias("y"))).alias("z"))
    moved = placed.join(near, ["lng", "lat"], "left").withColumn("free", (F.col("rn") > 1) & (F.col("rn") < F.col("n")))
    to = lambda z, c: F.when(F.col("free"), F.coalesce(z, c)).otherwise(F.col(c))
    return moved.select("course_id", "ord", to("z.x", "lng").alias("lng"), to("z.y", "lat").alias("lat"))
