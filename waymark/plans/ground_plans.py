"""Queries of places, grids, positions and texts about them, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import classes as K
from ..functions import geo
from ..functions.classes import first
from ..operators import courses as C
from ..operators import spatial as S
from ..operators.tables import cut
from ..registry import query
from ..sources.derived import ctes, derived, raw
from .class_plans import _TERRAIN
from .geometry_plans import walk_sql
from .map_plans import _edges_sql, _rings

_CC, _AC = ctes("controls", "candidates"), ctes("areas", "candidates")


def _c(s, d):
    return derived(s, d, "controls")


def _k(s, d):
    return derived(s, d, "candidates")


_NEAR_DEG = 0.00009


_FREE = f""", r AS (SELECT min_lng AS x, min_lat AS y, min(area_id) AS id, CAST(floor(min_lng / {_NEAR_DEG}) AS BIGINT) AS cx, CAST(floor(min_lat / {_NEAR_DEG}) AS BIGINT) AS cy FROM areas GROUP BY ALL),
  kc AS (SELECT lng, lat, CAST(floor(lng / {_NEAR_DEG}) AS BIGINT) + dx AS cx, CAST(floor(lat / {_NEAR_DEG}) AS BIGINT) + dy AS cy FROM candidates, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)),
  pl AS MATERIALIZED (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM kc WHERE kc.cx = r.cx AND kc.cy = r.cy AND abs(kc.lng - r.x) < {_NEAR_DEG} AND abs(kc.lat - r.y) < {_NEAR_DEG}))"""


@query("J17_merged_candidates", _AC + walk_sql(_FREE, f"abs(a.x - b.x) < {_NEAR_DEG} AND abs(a.y - b.y) < {_NEAR_DEG}") + """, u AS (SELECT 0 AS side, cand_id AS id, lng, lat FROM candidates UNION ALL SELECT 1, id, x, y FROM pl JOIN kept USING (id))
  SELECT side, id, lng, lat FROM u ORDER BY side, id LIMIT 800""")  # fmt: skip
def j17(s, d):
    """Candidates of both kinds: of the second, those close to one of the first go, then those close to one kept before; 800 at most: the
    limit is the feature's."""
    step = F.lit(_NEAR_DEG)
    cell = lambda c: F.floor(F.col(c) / step).cast("long")
    right = derived(s, d, "areas").groupBy(F.col("min_lng").alias("lng"), F.col("min_lat").alias("lat")).agg(F.min("area_id").alias("id")).withColumns({"cx": cell("lng"), "cy": cell("lat")})
    left = _k(s, d).select(F.col("lng").alias("x"), F.col("lat").alias("y")).distinct().withColumns({"cx": cell("x"), "cy": cell("y")})
    around = F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)])
    left = left.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around)).select("x", "y", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    free = right.join(left, (right.cx == left.cx) & (right.cy == left.cy) & (F.abs(F.col("x") - F.col("lng")) < _NEAR_DEG) & (F.abs(F.col("y") - F.col("lat")) < _NEAR_DEG), "left_anti")
    one = S.spaced(free, ["id"], box=(_NEAR_DEG, _NEAR_DEG)).select(F.lit(1).alias("side"), "id", "lng", "lat")
    return _k(s, d).select(F.lit(0).alias("side"), F.col("cand_id").alias("id"), "lng", "lat").unionByName(one).orderBy("side", "id").limit(800)


_PATHS = """, w AS (SELECT cand_id, cand_id // 5 AS path, lng AS x1, lat AS y1, lead(lng) OVER o AS x2, lead(lat) OVER o AS y2 FROM candidates WINDOW o AS (PARTITION BY cand_id // 5 ORDER BY cand_id)), sg AS (SELECT * FROM w WHERE x2 IS NOT NULL)"""


@query("J22_path_crossings", _CC + _PATHS + """, p AS (SELECT a.cand_id AS a, b.cand_id AS b, (a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1) AS den, (b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1) AS tn,
    (b.x1 - a.x1) * (a.y2 - a.y1) - (b.y1 - a.y1) * (a.x2 - a.x1) AS un, a.x1, a.y1, a.x2, a.y2 FROM sg a JOIN sg b ON a.path < b.path)
  SELECT a, b, round(x1 + tn / den * (x2 - x1), 7) AS lng, round(y1 + tn / den * (y2 - y1), 7) AS lat FROM p WHERE abs(den) > 1e-15 AND tn / den > 1e-9 AND tn / den < 1 - 1e-9 AND un / den > 1e-9 AND un / den < 1 - 1e-9""")  # fmt: skip
def j22(s, d):
    """Where segments of two paths cross. Segments meet in the cells of their boxes, and each pair counts in one of them."""
    w = Window.partitionBy(F.expr("cand_id div 5")).orderBy("cand_id")
    sg = _k(s, d).select("cand_id", F.col("lng").alias("x1"), F.col("lat").alias("y1"), F.lead("lng").over(w).alias("x2"), F.lead("lat").over(w).alias("y2")).where("x2 IS NOT NULL")
    # segments of the same ends are compared once, and listed in the last step
    ends = ["x1", "y1", "x2", "y2"]
    shape = sg.select(*ends).distinct()
    cell = lambda v: F.floor(v / 0.002).cast("long")
    lo, hi = (lambda a, b: cell(F.least(a, b))), (lambda a, b: cell(F.greatest(a, b)))
    shape = shape.withColumns({"lx": lo("x1", "x2"), "ly": lo("y1", "y2")})
    cells = cut(shape.withColumn("cx", F.explode(F.sequence("lx", hi("x1", "x2")))).withColumn("cy", F.explode(F.sequence("ly", hi("y1", "y2")))))
    a, b = cells.alias("a"), cells.alias("b")
    c = lambda n: F.col(n)
    first_cell = (c("a.cx") == F.greatest("a.lx", "b.lx")) & (c("a.cy") == F.greatest("a.ly", "b.ly"))
    p = a.join(b, (c("a.cx") == c("b.cx")) & (c("a.cy") == c("b.cy"))).where(first_cell)
    ax, ay, bx, by = c("a.x2") - c("a.x1"), c("a.y2") - c("a.y1"), c("b.x2") - c("b.x1"), c("b.y2") - c("b.y1")
    dx, dy = c("b.x1") - c("a.x1"), c("b.y1") - c("a.y1")
    den = ax * by - ay * bx
    p = p.where(F.abs(den) > 1e-15).select(*[c(f"a.{e}").alias(e) for e in ends], *[c(f"b.{e}").alias(f"b{e}") for e in ends], ((dx * by - dy * bx) / den).alias("t"), ((dx * ay - dy * ax) / den).alias("u"), ax.alias("ax"), ay.alias("ay"))
    inner = lambda n: (c(n) > 1e-9) & (c(n) < 1 - 1e-9)
    p = p.where(inner("t") & inner("u")).select(*ends, *[f"b{e}" for e in ends], F.round(c("x1") + c("t") * c("ax"), 7).alias("lng"), F.round(c("y1") + c("t") * c("ay"), 7).alias("lat"))
    right = sg.select(F.col("cand_id").alias("b"), *[F.col(e).alias(f"b{e}") for e in ends])
    out = S.expanded(p, sg.select(F.col("cand_id").alias("a"), *ends), ends, "a", right, [f"b{e}" for e in ends], "b")
    return out.where("a div 5 < b div 5").select("a", "b", "lng", "lat")


_BLOCKS = "isom % 7 = 0"
_MID = ctes("controls", "areas") + f""", l AS (SELECT *, lead(lng) OVER o AS nx, lead(lat) OVER o AS ny FROM controls WINDOW o AS (PARTITION BY course_id ORDER BY ord)),
  md AS (SELECT course_id, ord, round((lng + nx) / 2, 6) AS x, round((lat + ny) / 2, 6) AS y, round({geo.hav_sql('lng', 'lat', 'nx', 'ny')} / 2, 3) AS half FROM l WHERE nx IS NOT NULL)"""


@query("J25_blocking_terrain", _MID + f", dm AS (SELECT DISTINCT x, y, least(half, 200) AS half FROM md), bl AS (SELECT dm.x, dm.y, dm.half, {_TERRAIN} AS kind FROM dm JOIN areas a ON abs(x - min_lng) < 0.004 AND abs(y - min_lat) < 0.003 WHERE {_BLOCKS} AND {_TERRAIN} IS NOT NULL AND {geo.hav_sql('x', 'y', 'min_lng', 'min_lat')} <= half) SELECT course_id, ord, count(DISTINCT kind) AS kinds, string_agg(DISTINCT kind, ',' ORDER BY kind) AS blocking FROM md JOIN bl ON bl.x = md.x AND bl.y = md.y AND bl.half = least(md.half, 200) GROUP BY ALL")
def j25(s, d):
    """Kinds of impassable areas within half a leg of its middle (200 m at most)."""
    w = C.by_order()
    nx, ny = F.lead("lng").over(w), F.lead("lat").over(w)
    m = _c(s, d).select("course_id", "ord", F.round((F.col("lng") + nx) / 2, 6).alias("lng"), F.round((F.col("lat") + ny) / 2, 6).alias("lat"), F.round(geo.haversine(F.col("lng"), F.col("lat"), nx, ny) / 2, 3).alias("half")).where("lng IS NOT NULL").withColumn("half", F.least("half", F.lit(200.0)))
    blocks = derived(s, d, "areas").where(_BLOCKS).select(K.terrain(F.col("isom")).alias("kind"), F.col("min_lng").alias("lng"), F.col("min_lat").alias("lat")).where("kind IS NOT NULL").distinct()
    # a middle's place meets each kind once, however many legs cross there and however long they are
    nearest = S.radius_pairs(m.select("lng", "lat").distinct(), blocks, 200).groupBy("lng", "lat", "kind").agg(F.min("metres").alias("metres"))
    near = nearest.groupBy("lng", "lat").agg(F.array_sort(F.collect_list(F.struct("kind", "metres"))).alias("near"))
    kinds = F.transform(F.filter("near", lambda k: k["metres"] <= F.col("half")), lambda k: k["kind"])
    return m.join(near, ["lng", "lat"]).withColumn("kinds", kinds).where("size(kinds) > 0").select("course_id", "ord", F.size("kinds").cast("long").alias("kinds"), F.array_join("kinds", ",").alias("blocking"))


_RUN = "0.3 + (cand_id % 7) / 10.0::DOUBLE"


@query("J26_navigation_edges", _CC + f""", n AS (SELECT cand_id, lng, lat, {_RUN} AS r, ftype = 'path' AS path FROM candidates), p AS (SELECT a.cand_id AS a, b.cand_id AS b, {geo.hav_sql('a.lng', 'a.lat', 'b.lng', 'b.lat')} AS m, (a.r + b.r) / 2 AS r, a.path OR b.path AS path FROM n a JOIN n b ON a.cand_id < b.cand_id)
  SELECT unnest([a, b]) AS src, unnest([b, a]) AS dst, round(m, 2) AS metres, round(m / r, 2) AS cost, CASE WHEN path THEN 'path' ELSE 'direct' END AS kind FROM p WHERE m <= 150""")  # fmt: skip
def j26(s, d):
    """Edges in both directions between places up to 150 m apart; their cost is the distance over the mean runnability."""
    n = _k(s, d).select("cand_id", "lng", "lat", (0.3 + (F.col("cand_id") % 7) / F.lit(10.0)).alias("r"), (F.col("ftype") == "path").alias("path"))
    # what an edge says is told once for each two kinds of places (where they are, their runnability, whether they are on a path), and their candidates are listed last
    kinds = cut(n.select("lng", "lat", "r", "path").distinct())
    p = S.radius_pairs(kinds.select("lng", "lat").distinct(), kinds.select("lng", "lat").distinct(), 150)
    p = p.join(kinds, ["lng", "lat"]).join(kinds.select(F.col("lng").alias("__x"), F.col("lat").alias("__y"), F.col("r").alias("q"), F.col("path").alias("also")), ["__x", "__y"])
    cost = F.col("metres") / ((F.col("r") + F.col("q")) / 2)
    p = p.select("lng", "lat", "r", "path", "__x", "__y", "q", "also", F.round("metres", 2).alias("metres"), F.round(cost, 2).alias("cost"), F.when(F.col("path") | F.col("also"), "path").otherwise("direct").alias("kind"))
    right = n.select(F.col("cand_id").alias("dst"), F.col("lng").alias("__x"), F.col("lat").alias("__y"), F.col("r").alias("q"), F.col("path").alias("also"))
    out = S.expanded(p, n.withColumnRenamed("cand_id", "src"), ["lng", "lat", "r", "path"], "src", right, ["__x", "__y", "q", "also"], "dst")
    return out.where("src <> dst").select("src", "dst", "metres", "cost", "kind")


_SPACING = 44
_AROUND = f""", ce AS (SELECT cand_id AS centre, lng AS cl, lat AS ca FROM candidates WHERE cand_id % 10 = 0), p AS (SELECT centre, cand_id, lng AS x, lat AS y, round({geo.hav_sql('cl', 'ca', 'lng', 'lat')}, 3) AS m FROM ce JOIN candidates ON abs(lng - cl) < 0.005 AND abs(lat - ca) < 0.003),
  pl AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY centre, cand_id) AS id, CAST(floor(x / 0.0008) AS BIGINT) AS cx, CAST(floor(y / 0.0005) AS BIGINT) AS cy FROM p WHERE m <= 200 QUALIFY row_number() OVER (PARTITION BY centre, x, y ORDER BY cand_id) = 1)"""


@query("J27_candidate_positions", _CC + walk_sql(_AROUND, f"{geo.hav_sql('a.x', 'a.y', 'b.x', 'b.y')} < {_SPACING}", "centre") + ", q AS (SELECT * FROM pl JOIN kept USING (id) QUALIFY row_number() OVER (PARTITION BY centre ORDER BY cand_id) <= 20) SELECT centre, cand_id, m AS metres FROM q")
def j27(s, d):
    """About every tenth place the first 20 others within 200 m that a walk in order keeps, each 44 m or more from those kept before: the limit is the feature's."""
    k = _k(s, d)
    centres = k.where("cand_id % 10 = 0").select(F.col("cand_id").alias("centre"), "lng", "lat")
    # of a place's candidates the first counts, and centres of one place keep the same
    spots = centres.groupBy("lng", "lat").agg(F.min("centre").alias("spot"))
    p = S.radius_pairs(spots, k.groupBy("lng", "lat").agg(F.min("cand_id").alias("cand_id")), 200).select("spot", "cand_id", F.round("metres", 3).alias("m"), F.col("__x").alias("lng"), F.col("__y").alias("lat"))
    p = cut(p.where("m <= 200"))
    kept = S.spaced(p, ["cand_id", "m"], metres=_SPACING, by=("spot",))
    w = Window.partitionBy("spot").orderBy("cand_id")
    kept = kept.withColumn("place", F.row_number().over(w)).where("place <= 20").select("spot", "cand_id", F.col("m").alias("metres"))
    return centres.join(spots, ["lng", "lat"]).join(kept, "spot").select("centre", "cand_id", "metres")


#: Controls of a course whose tries are tested in one row.
_SHORT = 64
_U = "(CAST('0x' || substr(md5(course_id || ':' || i || ':{a}'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


@query("J31_negative_samples", ctes("controls") + f""", b AS (SELECT course_id, count(*) AS n, min(lng) AS x0, min(lat) AS y0, max(lng) AS x1, max(lat) AS y1 FROM controls GROUP BY course_id HAVING count(*) >= 2),
  t AS (SELECT *, unnest(range(1, 8 * n + 1)) AS i FROM b), r AS (SELECT course_id, n, i, round(x0 - (x1 - x0) * 0.2 + (x1 - x0) * 1.4 * {_U.format(a='x')}, 6) AS lng, round(y0 - (y1 - y0) * 0.2 + (y1 - y0) * 1.4 * {_U.format(a='y')}, 6) AS lat FROM t),
  f AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM controls c WHERE c.course_id = r.course_id AND {geo.hav_sql('c.lng', 'c.lat', 'r.lng', 'r.lat')} < 50)) SELECT course_id, i, lng, lat FROM f QUALIFY row_number() OVER (PARTITION BY course_id ORDER BY i) <= 2 * n""")  # fmt: skip
def j31(s, d):
    """Two negatives for each control, where so many of eight tries are found: places of a padded box, drawn by hash, that are 50 m
    or more from all controls of the course."""
    c = _c(s, d)
    b = c.groupBy("course_id").agg(F.count("*").alias("n"), F.min("lng").alias("x0"), F.min("lat").alias("y0"), F.max("lng").alias("x1"), F.max("lat").alias("y1")).where("n >= 2")
    u = lambda i, a: F.conv(F.substring(F.md5(F.concat_ws(":", "course_id", i, F.lit(a))), 1, 8), 16, 10).cast("long") / 4294967296.0
    drawn = lambda lo, hi, i, a: F.round(F.col(lo) - (F.col(hi) - F.col(lo)) * 0.2 + (F.col(hi) - F.col(lo)) * 1.4 * u(i, a), 6)
    one = lambda i: F.struct(i.alias("i"), drawn("x0", "x1", i, "x").alias("lng"), drawn("y0", "y1", i, "y").alias("lat"))
    numbers = F.sequence(F.lit(1).cast("long"), 8 * F.col("n"))
    # a short course's tries are drawn and tested within its row: they are in no shuffle
    short = c.join(b.where(F.col("n") <= _SHORT), "course_id").groupBy("course_id", "n", "x0", "y0", "x1", "y1").agg(F.collect_set(F.struct("lng", "lat")).alias("at"))
    # 0.0005 degrees of latitude are more than 50 m, which spares most of the distances
    close = lambda t: F.exists("at", lambda p: F.coalesce((F.abs(p["lat"] - t["lat"]) < 0.0005) & (geo.haversine(p["lng"], p["lat"], t["lng"], t["lat"]) < 50), F.lit(False)))
    free = lambda to: F.filter(F.transform(F.sequence(F.lit(1).cast("long"), to), one), lambda t: ~close(t))
    # three tries a place are nearly always enough; where not, all eight are drawn
    short = short.withColumn("free", free(3 * F.col("n")))
    short = short.withColumn("free", F.slice(F.when(F.size("free") >= 2 * F.col("n"), F.col("free")).otherwise(free(8 * F.col("n"))), 1, 2 * F.col("n").cast("int")))
    few = short.select("course_id", F.explode("free").alias("t")).select("course_id", "t.*")
    long_ = cut(b.where(F.col("n") > _SHORT))
    r = cut(long_.select("course_id", "n", "x0", "y0", "x1", "y1", F.explode(numbers).alias("i")).select("course_id", "n", one(F.col("i")).alias("t")).select("course_id", "n", "t.*"))
    # the few controls look into their cells, not the many tries
    at = c.join(long_.select("course_id"), "course_id", "left_semi").select("course_id", "lng", "lat").distinct()
    near = S.radius_pairs(at, r.select(F.col("course_id").alias("other"), "i", "lng", "lat"), 50, key=("course_id", "other")).where("metres < 50").select("course_id", "i").distinct()
    w = Window.partitionBy("course_id").orderBy("i")
    many = r.join(near, ["course_id", "i"], "left_anti").withColumn("k", F.row_number().over(w)).where("k <= 2 * n").select("course_id", "i", "lng", "lat")
    return few.unionByName(many)


# Heights of vegetation in metres.
HEIGHTS = {"forest": 12.0, "wood": 12.0, "scrub": 3.0, "heath": 1.0, "grassland": 0.1, "meadow": 0.3, "farmland": 0.5, "wetland": 1.5, "orchard": 4.0, "vineyard": 1.5, "park": 3.0, "garden": 1.0, "grass": 0.1}
_USES = [*HEIGHTS, "none"]
_USE = f"[{', '.join(repr(u) for u in _USES)}][isom % {len(_USES)} + 1]"
_HEIGHT = "CASE use " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in HEIGHTS.items()) + " ELSE 0.0::DOUBLE END"
_GRID = f"""{ctes('areas')}, ix AS (SELECT unnest(range(0, 80)) AS gx), iy AS (SELECT unnest(range(0, 40)) AS gy), v AS (SELECT gx, gy, 5.48::DOUBLE + (gx + 0.5::DOUBLE) * 0.00025::DOUBLE + 0.000005::DOUBLE AS x, 49.18::DOUBLE + (gy + 0.5::DOUBLE) * 0.00025::DOUBLE + 0.000005::DOUBLE AS y, CAST((gx * gx * 3 + gy * 17) % 40 / 4.0 AS DOUBLE) AS z FROM ix, iy),
  ac AS (SELECT * FROM (SELECT *, unnest(range(CAST(floor((min_lng - 5.48) / 0.00025) AS BIGINT) - 1, CAST(floor((max_lng - 5.48) / 0.00025) AS BIGINT) + 2)) AS gx FROM areas), LATERAL (SELECT unnest(range(CAST(floor((min_lat - 49.18) / 0.00025) AS BIGINT) - 1, CAST(floor((max_lat - 49.18) / 0.00025) AS BIGINT) + 2)) AS gy)),
  lu AS (SELECT gx, gy, arg_min(isom, area_id) AS isom FROM v JOIN ac USING (gx, gy) WHERE x BETWEEN min_lng AND max_lng AND y BETWEEN min_lat AND max_lat AND ({_edges_sql()}) % 2 = 1 GROUP BY ALL),
  cl AS (SELECT v.gx, v.gy, coalesce({_USE}, 'none') AS use, sqrt(power(coalesce(n.z - v.z, 0), 2) + power(coalesce(e.z - v.z, 0), 2)) / 25 * 100 AS slope FROM v LEFT JOIN lu USING (gx, gy) LEFT JOIN v n ON n.gx = v.gx AND n.gy = v.gy + 1 LEFT JOIN v e ON e.gx = v.gx + 1 AND e.gy = v.gy),
  ch AS (SELECT *, {_HEIGHT} AS height FROM cl)"""
_SF = "CASE WHEN slope < 5 THEN 1.0 WHEN slope < 10 THEN 0.9 WHEN slope < 15 THEN 0.8 WHEN slope < 20 THEN 0.7 WHEN slope < 25 THEN 0.6 WHEN slope < 30 THEN 0.5 ELSE 0.4 END::DOUBLE"
_HF = "CASE WHEN height < 0.5 THEN 1.0 WHEN height < 1 THEN 0.95 WHEN height < 2 THEN 0.85 WHEN height < 5 THEN 0.7 WHEN height < 10 THEN 0.5 ELSE 0.4 END::DOUBLE"


def _grid(s, d):
    """A 25 m grid over the map: slope from the neighbours' heights, vegetation from the first area that holds a cell's middle."""
    cells = s.range(80 * 40).select((F.col("id") % 80).alias("gx"), F.expr("id div 80").alias("gy"))
    v = cells.select("gx", "gy", (5.48 + (F.col("gx") + 0.5) * 0.00025 + 0.000005).alias("lng"), (49.18 + (F.col("gy") + 0.5) * 0.00025 + 0.000005).alias("lat"), ((F.col("gx") * F.col("gx") * 3 + F.col("gy") * 17) % 40 / F.lit(4.0)).alias("z"))
    rise = lambda along, across: F.coalesce(F.lead("z").over(Window.partitionBy(across).orderBy(along)) - F.col("z"), F.lit(0.0))
    sloped = v.withColumn("slope", F.hypot(rise("gy", "gx"), rise("gx", "gy")) / 25 * 100)
    # areas of the same ring are looked up once, by their first
    rings = _rings(s, d)
    first_ = S.places_inside(v, rings).join(rings.select("area_id", "isom"), "area_id").select("lng", "lat", "isom")
    held = v.select("gx", "gy", "lng", "lat").join(first_, ["lng", "lat"]).select("gx", "gy", "isom")
    use = F.coalesce(F.element_at(F.array(*[F.lit(u) for u in _USES]), (F.col("isom") % len(_USES) + 1).cast("int")), F.lit("none"))
    g = sloped.join(held, ["gx", "gy"], "left").withColumn("use", use)
    return g.withColumn("height", first([(F.col("use") == k, h) for k, h in HEIGHTS.items()], 0.0))


@query("G09_J33_F15_ground_grid", _GRID + f" SELECT gx, gy, use, height, round(slope, 3) AS slope, round(least(1, {_SF} * {_HF}), 4) AS score, round({_SF} * {_HF} * 0.8 * 200, 2) AS speed FROM ch")
def g09(s, d):
    """Slope, vegetation, score and speed of each cell."""
    no, closed = F.lit(False), F.lit(False)
    return _grid(s, d).select("gx", "gy", "use", "height", F.round("slope", 3).alias("slope"), F.round(F.least(F.lit(1.0), K._banded(F.col("slope"), K.SLOPES) * K._banded(F.col("height"), K.HEIGHTS)), 4).alias("score"), F.round(K.speed_factor(F.col("slope"), F.col("height"), no, closed) * 200, 2).alias("speed"))


_PLAN = """, rd AS (SELECT CAST(floor((lng - 5.48) / 0.0005) AS BIGINT) AS gx, CAST(floor((lat - 49.18) / 0.0005) AS BIGINT) AS gy, ftype, cand_id FROM candidates),
  c0 AS (SELECT unnest(range(0, 40)) AS gx), c1 AS (SELECT unnest(range(0, 20)) AS gy), gr AS (SELECT gx, gy FROM c0, c1),
  ro AS (SELECT gx, gy, max(CASE ftype WHEN 'path' THEN 0.6::DOUBLE ELSE 0.8::DOUBLE END) AS v FROM rd WHERE ftype IN ('path', 'intersection') GROUP BY ALL),
  bu AS (SELECT DISTINCT gx + dx AS gx, gy + dy AS gy FROM rd, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy) WHERE ftype = 'building_corner' AND cand_id % 3 = 0),
  ba AS (SELECT DISTINCT gx + dx AS gx, gy + dy AS gy FROM rd, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy) WHERE ftype = 'steps' AND cand_id % 3 = 0),
  gn AS (SELECT gx, gy, min_by(CASE cand_id % 3 WHEN 0 THEN 0.7 WHEN 1 THEN 0.5 ELSE 0.4 END::DOUBLE, -cand_id) AS v FROM rd WHERE cand_id % 11 = 5 GROUP BY ALL),
  ur AS (SELECT gx, gy, coalesce(gn.v, least(CASE WHEN bu.gx IS NOT NULL THEN 0.0::DOUBLE ELSE greatest(0.5::DOUBLE, coalesce(ro.v, 0)) END, CASE WHEN ba.gx IS NOT NULL THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END)) AS v
    FROM gr LEFT JOIN ro USING (gx, gy) LEFT JOIN bu USING (gx, gy) LEFT JOIN ba USING (gx, gy) LEFT JOIN gn USING (gx, gy))"""


def _urban(s, d):
    """A grid of runnability: roads raise a cell, buildings close it and its neighbours, barriers lower those, greens decide last."""
    g = lambda c, o: F.floor((F.col(c) - o) / 0.0005).cast("long")
    r = _k(s, d).select(g("lng", 5.48).alias("gx"), g("lat", 49.18).alias("gy"), "ftype", "cand_id")
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    spread = lambda df: df.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around)).select((F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy"))
    third = F.col("cand_id") % 3
    kind = F.col("ftype")
    marks = r.where(kind.isin("path", "intersection")).select("gx", "gy", F.struct(F.when(kind == "path", 0.6).otherwise(0.8).alias("road"), F.lit(None).cast("boolean").alias("built"), F.lit(None).cast("boolean").alias("bar"), F.lit(None).cast("struct<o:bigint,v:double>").alias("green")).alias("m"))
    flag = lambda df, b, w: spread(df).select("gx", "gy", F.struct(F.lit(None).cast("double").alias("road"), F.lit(b).cast("boolean").alias("built"), F.lit(w).cast("boolean").alias("bar"), F.lit(None).cast("struct<o:bigint,v:double>").alias("green")).alias("m"))
    green = F.struct((-F.col("cand_id")).cast("long").alias("o"), first([(third == 0, 0.7), (third == 1, 0.5)], 0.4).alias("v"))
    greens = r.where("cand_id % 11 = 5").select("gx", "gy", F.struct(F.lit(None).cast("double").alias("road"), F.lit(None).cast("boolean").alias("built"), F.lit(None).cast("boolean").alias("bar"), green.alias("green")).alias("m"))
    marks = marks.unionByName(flag(r.where((kind == "building_corner") & (third == 0)), True, None)).unionByName(flag(r.where((kind == "steps") & (third == 0)), None, True)).unionByName(greens)
    per = marks.groupBy("gx", "gy").agg(F.max("m.road").alias("road"), F.max("m.built").alias("built"), F.max("m.bar").alias("bar"), F.min("m.green").alias("green"))
    cells = s.range(40 * 20).select((F.col("id") % 40).alias("gx"), F.expr("id div 40").alias("gy"))
    open_ = F.when(F.col("built"), 0.0).otherwise(F.greatest(F.lit(0.5), F.coalesce("road", F.lit(0.0))))
    value = F.coalesce("green.v", F.least(open_, F.when(F.col("bar"), 0.1).otherwise(1.0)))
    return cells.join(per, ["gx", "gy"], "left").select("gx", "gy", value.alias("v"))


@query("G08_urban_grid", _CC + _PLAN + " SELECT gx, gy, v FROM ur")
def g08(s, d):
    return _urban(s, d)


@query("P22_valid_cells", _CC + _PLAN + " SELECT gx, gy FROM ur WHERE v BETWEEN 0.3 AND 0.9 AND gx BETWEEN 4 AND 35 ORDER BY gx, gy LIMIT 200")
def p22(s, d):
    """Cells that are neither closed nor too easy, in a box, the first 200: the limit is the feature's."""
    return _urban(s, d).where("v BETWEEN 0.3 AND 0.9 AND gx BETWEEN 4 AND 35").select("gx", "gy").orderBy("gx", "gy").limit(200)


@query("G07_navigation_nodes", _AC + """, z AS (SELECT min(min_lng) AS x0, min(min_lat) AS y0, max(max_lng) AS x1, max(max_lat) AS y1 FROM areas), a AS (SELECT *, unnest(range(0, CAST(floor((x1 - x0) / 0.0007 + 1e-9) AS BIGINT) + 1)) AS i FROM z), b AS (SELECT *, unnest(range(0, CAST(floor((y1 - y0) / 0.0005 + 1e-9) AS BIGINT) + 1)) AS j FROM a)
  SELECT 'grid' AS kind, round(x0 + i * 0.0007, 7) AS lng, round(y0 + j * 0.0005, 7) AS lat, 0.7::DOUBLE AS runnability FROM b UNION ALL SELECT CASE ftype WHEN 'intersection' THEN 'road' ELSE 'path' END, round(lng, 7), round(lat, 7), 0.7::DOUBLE FROM candidates WHERE ftype IN ('path', 'intersection')""")  # fmt: skip
def g07(s, d):
    """A grid over the map's box and the nodes of paths and roads."""
    z = derived(s, d, "areas").agg(F.min("min_lng").alias("x0"), F.min("min_lat").alias("y0"), F.max("max_lng").alias("x1"), F.max("max_lat").alias("y1"))
    upto = lambda a, b, step: F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(b) - F.col(a)) / step + 1e-9).cast("long")))
    g = z.withColumn("i", upto("x0", "x1", 0.0007)).withColumn("j", upto("y0", "y1", 0.0005))
    grid = g.select(F.lit("grid").alias("kind"), F.round(F.col("x0") + F.col("i") * 0.0007, 7).alias("lng"), F.round(F.col("y0") + F.col("j") * 0.0005, 7).alias("lat"), F.lit(0.7).alias("runnability"))
    k = _k(s, d).where("ftype IN ('path', 'intersection')").select(F.when(F.col("ftype") == "intersection", "road").otherwise("path").alias("kind"), F.round("lng", 7).alias("lng"), F.round("lat", 7).alias("lat"), F.lit(0.7).alias("runnability"))
    return grid.unionByName(k)


@query("P19_forbidden_rings", ctes("areas") + " SELECT area_id, CAST(5 AS INT) AS corners, round(min_lng, 7) AS lng, round(min_lat, 7) AS lat FROM areas WHERE isom IN (301, 307, 414, 415, 501, 520, 521, 526, 528, 529)")
def p19(s, d):
    """Areas that nobody may enter, by symbol, as rings."""
    r = _rings(s, d).where(F.col("isom").isin(301, 307, 414, 415, 501, 520, 521, 526, 528, 529))
    return r.select("area_id", F.size("ring").alias("corners"), F.round(F.element_at("ring", 1)["x"], 7).alias("lng"), F.round(F.element_at("ring", 1)["y"], 7).alias("lat"))


_M = ctes("controls") + """, q AS (SELECT course_id, ord, lng * 100000 AS x, lat * 100000 AS y FROM controls), w AS (SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py, lead(x) OVER o AS nx, lead(y) OVER o AS ny FROM q WINDOW o AS (PARTITION BY course_id ORDER BY ord)),
  o AS (SELECT unnest(range(0, 41)) AS k), t AS (SELECT w.*, k, CASE WHEN k = 0 THEN x ELSE x + (10 + (k - 1) % 5 * 10) * cos(radians((k - 1) // 5 * 45)) END AS tx, CASE WHEN k = 0 THEN y ELSE y + (10 + (k - 1) % 5 * 10) * sin(radians((k - 1) // 5 * 45)) END AS ty FROM w, o WHERE px IS NOT NULL AND nx IS NOT NULL),
  g AS (SELECT *, sqrt((tx - px) * (tx - px) + (ty - py) * (ty - py)) AS dp, sqrt((tx - nx) * (tx - nx) + (ty - ny) * (ty - ny)) AS dn, abs(atan2(ty - py, tx - px) - atan2(ny - ty, nx - tx)) AS da FROM t),
  sc AS (SELECT *, 100 - CASE WHEN dp < 60 THEN (60 - dp) * 2 ELSE 0 END - CASE WHEN dn < 60 THEN (60 - dn) * 2 ELSE 0 END - CASE WHEN da < 0.2 OR abs(da - pi()) < 0.2 THEN 20 ELSE 0 END AS score FROM g)"""


@query("T10_F22_best_positions", _M + " SELECT course_id, ord, round(max(score), 3) AS score, round(arg_max(score, -k), 3) AS before FROM sc GROUP BY course_id, ord")
def t10(s, d):
    """The best score among a control's place and 40 about it (8 directions, 10 to 50 m), and that of the place itself."""
    w = C.by_order()
    q = _c(s, d).select("course_id", "ord", (F.col("lng") * 100000).alias("x"), (F.col("lat") * 100000).alias("y"))
    q = q.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w), "nx": F.lead("x").over(w), "ny": F.lead("y").over(w)}).where("px IS NOT NULL AND nx IS NOT NULL")
    import math

    c = F.col
    moves = [(0.0, 0.0)] + [(r * math.cos(math.radians(a)), r * math.sin(math.radians(a))) for a in range(0, 360, 45) for r in (10, 20, 30, 40, 50)]

    def score(mx: float, my: float):
        tx, ty = c("x") + mx, c("y") + my
        dp, dn = F.hypot(tx - c("px"), ty - c("py")), F.hypot(tx - c("nx"), ty - c("ny"))
        da = F.abs(F.atan2(ty - c("py"), tx - c("px")) - F.atan2(c("ny") - ty, c("nx") - tx))
        short = lambda v: F.when(v < 60, (60 - v) * 2).otherwise(0.0)
        return 100 - short(dp) - short(dn) - F.when((da < 0.2) | (F.abs(da - math.pi) < 0.2), 20.0).otherwise(0.0)

    all_ = q.select("course_id", "ord", F.array(*[score(*m) for m in moves]).alias("s"))
    return all_.select("course_id", "ord", F.round(F.array_max("s"), 3).alias("score"), F.round(F.element_at("s", 1), 3).alias("before"))


_MULT = {"path": 1.0, "forest": 0.7, "marsh": 0.0}


@query("A39_course_times", ctes("controls") + f""", p AS (SELECT *, lag(lng) OVER o AS px, lag(lat) OVER o AS py, lag(ele) OVER o AS pe FROM controls WINDOW o AS (PARTITION BY course_id ORDER BY ord)),
  l AS (SELECT course_id, ord, {geo.hav_sql('px', 'py', 'lng', 'lat')} AS m, ele - pe AS up, CASE course_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE CASE WHEN ord % 4 = 0 THEN 0.0 ELSE 0.7 END END AS f FROM p WHERE px IS NOT NULL),
  t AS (SELECT *, CASE WHEN f > 0 THEN m / (170 * f * CASE WHEN m > 0 THEN exp(-3.5 * abs(up / m + 0.05)) / exp(-0.175) ELSE 1 END) END AS minutes FROM l)
  SELECT course_id, round(sum(m), 1) AS metres, round(coalesce(sum(minutes), 0), 2) AS minutes, round(coalesce(sum(minutes), 0) * 0.8, 2) AS winning, count(*) FILTER (minutes IS NULL) AS closed FROM t GROUP BY course_id""")  # fmt: skip
def a39(s, d):
    """Time of each course by ground and slope; legs over impassable ground have none and count nothing."""
    w = C.by_order()
    m = geo.haversine(F.lag("lng").over(w), F.lag("lat").over(w), F.col("lng"), F.col("lat"))
    kind = F.col("course_id") % 3
    f = first([(kind == 0, 1.0), (kind == 1, 0.7), (F.col("ord") % 4 == 0, 0.0)], 0.7)
    legs = _c(s, d).select("course_id", m.alias("m"), (F.col("ele") - F.lag("ele").over(w)).alias("up"), f.alias("f")).where("m IS NOT NULL")
    pace = F.when(F.col("m") > 0, geo.tobler(F.col("up") / F.col("m"))).otherwise(1.0)
    t = legs.withColumn("t", F.when(F.col("f") > 0, F.col("m") / (170 * F.col("f") * pace)))
    total = F.coalesce(F.sum("t"), F.lit(0.0))
    return t.groupBy("course_id").agg(F.round(F.sum("m"), 1).alias("metres"), F.round(total, 2).alias("minutes"), F.round(total * 0.8, 2).alias("winning"), F.count_if(F.col("t").isNull()).alias("closed"))


@query("A42_flat_list_courses", "WITH c AS (SELECT l_orderkey // 64 AS map_id, l_orderkey AS number, l_linenumber % 5 AS kind, l_linenumber AS line FROM lineitem), s AS (SELECT map_id, min(number) FILTER (kind = 1) AS a, min(number) FILTER (kind = 2) AS b FROM c GROUP BY map_id) SELECT map_id, count(*) AS controls, CAST(min(number) AS BIGINT) AS first, CAST(max(number) AS BIGINT) AS last FROM c JOIN s USING (map_id) WHERE number BETWEEN a AND b GROUP BY map_id")
def a42(s, d):
    """Courses out of a flat list of a map's controls: what is numbered between its first start and its first finish."""
    c = raw(s, d, "lineitem").select(F.expr("l_orderkey div 64").alias("map_id"), F.col("l_orderkey").alias("number"), (F.col("l_linenumber") % 5).alias("kind"))
    ends = c.groupBy("map_id").agg(F.min(F.when(F.col("kind") == 1, F.col("number"))).alias("a"), F.min(F.when(F.col("kind") == 2, F.col("number"))).alias("b"))
    return c.join(ends, "map_id").where("number BETWEEN a AND b").groupBy("map_id").agg(F.count("*").alias("controls"), F.min("number").cast("long").alias("first"), F.max("number").cast("long").alias("last"))


@query("F29_overlay_corners", ctes("areas") + """, b AS (SELECT area_id, (min_lng + max_lng) / 2 AS cx, (min_lat + max_lat) / 2 AS cy, CASE WHEN area_id % 4 = 0 THEN 0 ELSE radians(area_id % 360) END AS r, unnest([min_lng, max_lng, max_lng, min_lng]) AS x, unnest([max_lat, max_lat, min_lat, min_lat]) AS y, unnest([1, 2, 3, 4]) AS k FROM areas)
  SELECT area_id, k, round(cx + (x - cx) * cos(r) - (y - cy) * sin(r), 7) AS lng, round(cy + (x - cx) * sin(r) + (y - cy) * cos(r), 7) AS lat FROM b""")  # fmt: skip
def f29(s, d):
    """Corners of an overlay, turned counter-clockwise about its middle."""
    a = derived(s, d, "areas")
    names = (("min_lng", "max_lat"), ("max_lng", "max_lat"), ("max_lng", "min_lat"), ("min_lng", "min_lat"))
    v = a.select("area_id", ((F.col("min_lng") + F.col("max_lng")) / 2).alias("cx"), ((F.col("min_lat") + F.col("max_lat")) / 2).alias("cy"), F.when(F.col("area_id") % 4 == 0, 0.0).otherwise(F.radians(F.col("area_id") % 360)).alias("r"), F.explode(F.array(*[F.struct(F.lit(k + 1).alias("k"), F.col(x).alias("x"), F.col(y).alias("y")) for k, (x, y) in enumerate(names)])).alias("p"))
    dx, dy, r = F.col("p.x") - F.col("cx"), F.col("p.y") - F.col("cy"), F.col("r")
    return v.select("area_id", F.col("p.k").alias("k"), F.round(F.col("cx") + dx * F.cos(r) - dy * F.sin(r), 7).alias("lng"), F.round(F.col("cy") + dx * F.sin(r) + dy * F.cos(r), 7).alias("lat"))


_CRS = ["Lambert 93", "RGF93 / Lambert-92", "NTF Lambert II etendu", "Belge Lambert 72", "lambert zone 84", "WGS84", "Web Mercator", "UTM Zone 31N", "utm 33 south", "EPSG:25832", "unknown", ""]
_NAME = f"[{', '.join(repr(c) for c in _CRS)}][p_partkey % {len(_CRS)} + 1]"


@query("F27_epsg", f"""WITH n AS (SELECT p_partkey, lower({_NAME}) AS c FROM part), z AS (SELECT *, TRY_CAST(coalesce(nullif(regexp_extract(c, 'zone\\s*(\\d+)', 1), ''), regexp_extract(c, 'utm\\s*(\\d+)', 1)) AS INT) AS zone FROM n)
  SELECT p_partkey, CAST(CASE WHEN contains(c, 'lambert 93') OR contains(c, 'lambert-93') THEN 2154 WHEN contains(c, 'lambert 92') OR contains(c, 'lambert-92') THEN 2152 WHEN contains(c, 'lambert ii') THEN 27572 WHEN contains(c, 'lambert') AND contains(c, '72') THEN 27572
  WHEN contains(c, 'lambert') AND contains(c, '84') THEN 27584 WHEN contains(c, 'wgs84') OR contains(c, '4326') THEN 4326 WHEN contains(c, 'mercator') OR contains(c, '3857') THEN 3857 WHEN contains(c, 'utm') AND zone IS NOT NULL THEN zone + CASE WHEN contains(c, 'south') THEN 32700 ELSE 32600 END
  ELSE TRY_CAST(regexp_extract(c, 'epsg[:\\s]*(\\d+)', 1) AS INT) END AS INT) AS epsg FROM z""")  # fmt: skip
def f27(s, d):
    name = F.element_at(F.array(*[F.lit(c) for c in _CRS]), (F.col("p_partkey") % len(_CRS) + 1).cast("int"))
    return raw(s, d, "part").select("p_partkey", K.epsg(name).alias("epsg"))


# Targets of course kinds, and factors by age class and sex.
BASE_TARGETS = {"sprint": (3000, 15, 18), "md": (5000, 35, 16), "ld": (9000, 75, 22)}
AGE_FACTORS = {"10": 0.38, "12": 0.48, "14": 0.62, "16": 0.78, "18": 0.88, "20": 0.93, "21": 0.97, "21E": 1.0, "35": 0.88, "40": 0.82, "45": 0.76, "50": 0.70, "55": 0.65, "60": 0.60, "65": 0.54, "70": 0.48, "75": 0.44, "80": 0.40}
_KINDS, _AGES = list(BASE_TARGETS), [*AGE_FACTORS, "99"]


def _pick(values: list, of: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{of} % {len(values)} + 1]"


@query("P17_course_targets", f"""WITH t AS (SELECT c_custkey, {_pick(_KINDS, 'c_custkey')} AS kind, {_pick(_AGES, 'c_custkey')} AS age, CASE WHEN c_custkey % 2 = 0 THEN 'D' ELSE 'H' END AS sex FROM customer),
  f AS (SELECT *, CASE age {' '.join(f"WHEN '{k}' THEN {v}" for k, v in AGE_FACTORS.items())} ELSE 1.0 END::DOUBLE * CASE WHEN sex = 'D' THEN 0.78 ELSE 1.0 END::DOUBLE AS f FROM t)
  SELECT c_custkey, sex || age AS category, CAST(floor(CASE kind {' '.join(f"WHEN '{k}' THEN {v[0]}" for k, v in BASE_TARGETS.items())} END * f / 100 + 0.5) * 100 AS BIGINT) AS metres, CAST(floor(CASE kind {' '.join(f"WHEN '{k}' THEN {v[1]}" for k, v in BASE_TARGETS.items())} END * f + 0.5) AS BIGINT) AS minutes,
  CAST(greatest(5, floor(CASE kind {' '.join(f"WHEN '{k}' THEN {v[2]}" for k, v in BASE_TARGETS.items())} END * f + 0.5)) AS BIGINT) AS controls FROM f""")  # fmt: skip
def p17(s, d):
    """Length, time and controls for each category, of the kind's values by age and sex."""
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("c_custkey") % len(values) + 1).cast("int"))
    t = raw(s, d, "customer").select("c_custkey", at(_KINDS).alias("kind"), at(_AGES).alias("age"), F.when(F.col("c_custkey") % 2 == 0, "D").otherwise("H").alias("sex"))
    f = first([(F.col("age") == k, v) for k, v in AGE_FACTORS.items()], 1.0) * F.when(F.col("sex") == "D", 0.78).otherwise(1.0)
    base = lambda i: first([(F.col("kind") == k, v[i]) for k, v in BASE_TARGETS.items()], 0)
    up = lambda x: F.floor(x + 0.5)
    return t.select("c_custkey", F.concat("sex", "age").alias("category"), (up(base(0) * f / 100) * 100).alias("metres"), up(base(1) * f).alias("minutes"), F.greatest(F.lit(5).cast("long"), up(base(2) * f)).alias("controls"))


# Least and greatest leg, dog-leg angle, climb and separation by kind and grade; what counts where none fits.
RULES = (
    ("sprint", 1, 20, 100, 30, 0.01, 25), ("sprint", 2, 30, 150, 25, 0.02, 30), ("sprint", 3, 50, 250, 25, 0.03, 35), ("sprint", 4, 60, 350, 22, 0.04, 40), ("sprint", 5, 80, 400, 20, 0.04, 40),
    ("forest", 1, 50, 300, 35, 0.02, 50), ("forest", 2, 100, 700, 30, 0.03, 60), ("forest", 3, 200, 1500, 25, 0.04, 60), ("forest", 4, 300, 2500, 22, 0.05, 60), ("forest", 5, 400, 3000, 20, 0.06, 60),
    ("md", 3, 150, 1000, 25, 0.04, 60), ("md", 5, 300, 2000, 20, 0.05, 60),
)
DEFAULT_RULE = (60, 400, 25, 0.04, 60)
_RK = ["sprint", "forest", "md", "trail"]


@query("P18_placement_rules", f"""WITH r(kind, td, least, most, angle, climb, apart) AS (VALUES {', '.join(map(str, RULES))}), q AS (SELECT c_custkey, {_pick(_RK, 'c_custkey')} AS kind, c_custkey % 7 AS td FROM customer),
  k AS (SELECT q.*, CASE WHEN kind IN (SELECT kind FROM r) THEN kind ELSE 'forest' END AS known FROM q),
  m AS (SELECT k.c_custkey, unnest([td, td + 1, td - 1, 3]) AS t, unnest([1, 2, 3, 4]) AS o, known FROM k), f AS (SELECT c_custkey, arg_min(r, o) AS z FROM m JOIN r ON r.kind = known AND r.td = t GROUP BY 1)
  SELECT c_custkey, CAST(coalesce(z.least, {DEFAULT_RULE[0]}) AS INT) AS least, CAST(coalesce(z.most, {DEFAULT_RULE[1]}) AS INT) AS most, CAST(coalesce(z.angle, {DEFAULT_RULE[2]}) AS INT) AS angle, CAST(coalesce(z.climb, {DEFAULT_RULE[3]}) AS DOUBLE) AS climb, CAST(coalesce(z.apart, {DEFAULT_RULE[4]}) AS INT) AS apart FROM q LEFT JOIN f USING (c_custkey)""")  # fmt: skip
def p18(s, d):
    """The rules of a kind and grade: else of the grade above, the one below, the third, else what always counts."""
    r = s.createDataFrame(list(RULES), "kind string, td int, least int, most int, angle int, climb double, apart int")
    kind = F.element_at(F.array(*[F.lit(k) for k in _RK]), (F.col("c_custkey") % len(_RK) + 1).cast("int"))
    q = raw(s, d, "customer").select("c_custkey", F.when(kind.isin(*{k for k, *_ in RULES}), kind).otherwise("forest").alias("kind"), (F.col("c_custkey") % 7).cast("int").alias("t"))
    tries = q.select("c_custkey", "kind", F.posexplode(F.array(F.col("t"), F.col("t") + 1, F.col("t") - 1, F.lit(3))).alias("o", "td"))
    best = tries.join(r, ["kind", "td"]).groupBy("c_custkey").agg(F.min_by(F.struct("least", "most", "angle", "climb", "apart"), "o").alias("z"))
    names = ("least", "most", "angle", "climb", "apart")
    return q.join(best, "c_custkey", "left").select("c_custkey", *[F.coalesce(f"z.{n}", F.lit(v)).alias(n) for n, v in zip(names, DEFAULT_RULE, strict=True)])
