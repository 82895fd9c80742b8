"""Results, calibration and set operations over courses, tracks and candidates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import spatial as S
from ..operators import text as X
from ..registry import query
from ..sources.derived import ctes, derived, raw
from .text_plans import _TOP
from .track_plans import _CELLS, _RUNS, _T, _cells, a01

#: Finish times as text: hours, or only minutes, or a runner who didn't finish.
_RESULTS = """SELECT event_id, event_type AS course, user_id AS runner, CASE WHEN event_id % 17 = 0 THEN 'DNF' WHEN event_id % 2 = 0 THEN concat(lpad(CAST(event_id % 3 AS STRING), 2, '0'), ':', lpad(CAST(event_id % 59 AS STRING), 2, '0'), ':', lpad(CAST(event_id % 53 AS STRING), 2, '0'))
  ELSE concat(lpad(CAST(event_id % 57 AS STRING), 2, '0'), ':', lpad(CAST(event_id % 51 AS STRING), 2, '0')) END AS finish FROM {events}"""
_TIMES = f"""WITH r AS ({_RESULTS.format(events='events')}), p AS (SELECT *, string_split(finish, ':') AS p FROM r),
  t AS (SELECT *, CASE len(p) WHEN 3 THEN TRY_CAST(p[1] AS BIGINT) * 3600 + TRY_CAST(p[2] AS BIGINT) * 60 + TRY_CAST(p[3] AS BIGINT) WHEN 2 THEN TRY_CAST(p[1] AS BIGINT) * 60 + TRY_CAST(p[2] AS BIGINT) END AS secs FROM p)"""


def _times(s, d):
    r = s.sql(_RESULTS.format(events="{t}"), t=raw(s, d, "events"))
    p = F.split("finish", ":")
    n = [F.get(p, F.lit(k)).try_cast("long") for k in range(3)]
    return r.withColumn("secs", F.when(F.size(p) == 3, n[0] * 3600 + n[1] * 60 + n[2]).when(F.size(p) == 2, n[0] * 60 + n[1]))


@query("A27_finish_times", _TIMES + " SELECT course, count(*) AS n, round(min(secs) / 60, 2) AS fastest, round(max(secs) / 60, 2) AS slowest, round(avg(secs) / 60, 2) AS mean, min((secs, runner))[2] AS best FROM t WHERE secs IS NOT NULL GROUP BY course")
def a27(s, d):
    m = lambda c: F.round(c / 60, 2)
    return _times(s, d).where("secs IS NOT NULL").groupBy("course").agg(F.count("*").alias("n"), m(F.min("secs")).alias("fastest"), m(F.max("secs")).alias("slowest"), m(F.avg("secs")).alias("mean"), F.min(F.struct("secs", "runner"))["runner"].alias("best"))


@query("A40_top_results", _TIMES + " SELECT course, runner, secs, row_number() OVER (PARTITION BY course ORDER BY secs, runner, event_id) AS place FROM t WHERE secs IS NOT NULL QUALIFY place <= 10")
def a40(s, d):
    """The ten best of each course: the limit is the report's, and Spark applies it before it shuffles."""
    w = Window.partitionBy("course").orderBy("secs", "runner", "event_id")
    return _times(s, d).where("secs IS NOT NULL").withColumn("place", F.row_number().over(w)).where("place <= 10").select("course", "runner", "secs", "place")


@query("T05_most_controls", ctes("controls") + " SELECT course_id, count(*) AS n FROM controls GROUP BY 1 ORDER BY n DESC, course_id LIMIT 1")
def t05(s, d):
    return derived(s, d, "controls").groupBy("course_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "course_id").limit(1)


@query("T06_extreme_legs", _RUNS + """, v AS (SELECT leg, metres / seconds * 60 AS v FROM runs WHERE seconds > 0 AND metres >= 10), g AS (SELECT leg, round(median(v), 1) AS median, round(stddev_pop(v) / avg(v), 3) AS cv FROM v WHERE v BETWEEN 50 AND 4000 GROUP BY leg)
  (SELECT 'hardest' AS kind, CAST(leg AS INT) AS leg FROM g WHERE cv > 0.15 ORDER BY cv DESC, leg LIMIT 1) UNION ALL (SELECT 'fastest', CAST(leg AS INT) FROM g WHERE median > 100 ORDER BY median DESC, leg LIMIT 1)""")  # fmt: skip
def t06(s, d):
    """The leg whose speeds vary most, and the one run fastest."""
    g = a01(s, d)
    best = lambda where, by, kind: g.where(where).orderBy(F.desc(by), "leg").limit(1).select(F.lit(kind).alias("kind"), "leg")
    return best("difficulty > 0.15", "difficulty", "hardest").unionByName(best("median > 100", "median", "fastest"))


@query("T07_hot_cells", _CELLS + " SELECT CAST(round(gx * 0.0002, 6) AS DOUBLE) AS lng, CAST(round(gy * 0.0002, 6) AS DOUBLE) AS lat, n FROM c WHERE n >= (SELECT quantile_cont(n, 0.8) FROM c)")
def t07(s, d):
    c, _ = _cells(s, d)
    return c.join(c.agg(F.percentile("n", 0.8).alias("least")), F.col("n") >= F.col("least")).select(F.round(F.col("gx") * 0.0002, 6).alias("lng"), F.round(F.col("gy") * 0.0002, 6).alias("lat"), "n")


@query("T08_shuffle_cap", ctes("candidates") + " SELECT cand_id FROM candidates ORDER BY ftype = 'intersection' DESC, md5(CAST(cand_id AS VARCHAR)), cand_id LIMIT 600")
def t08(s, d):
    """Intersections first, otherwise by a hash, 600 at most: the cap is the operator's."""
    return derived(s, d, "candidates").orderBy(F.desc(F.col("ftype") == "intersection"), F.md5(F.col("cand_id").cast("string")), "cand_id").limit(600).select("cand_id")


@query("P03_valid_steps", _T + f""", l AS (SELECT *, lag(lng) OVER o AS px, lag(lat) OVER o AS py, lag(t_s) OVER o AS pt FROM track_points WINDOW o AS (PARTITION BY track_id ORDER BY seq)), m AS (SELECT track_id, {geo.hav_sql('px', 'py', 'lng', 'lat')} AS m, t_s - pt AS s FROM l)
  SELECT track_id, count(*) FILTER (s > 0 AND m >= 5 AND m / s * 60 BETWEEN 50 AND 400) AS steps, count(*) FILTER (s > 0 AND m >= 10 AND m / s * 60 BETWEEN 50 AND 400) AS legs FROM m GROUP BY track_id""")  # fmt: skip
def p03(s, d):
    from ..operators import tracks as T

    t = T.steps(derived(s, d, "track_points"))
    return t.groupBy("track_id").agg(F.count(T.valid_speed()).alias("steps"), F.count(T.valid_speed(least=10.0)).alias("legs"))


@query("J21_sampled_vertices", _T + ", n AS (SELECT track_id, seq, count(*) OVER (PARTITION BY track_id) AS n FROM track_points) SELECT track_id, seq FROM n WHERE (seq - 1) % greatest(1, n // 4) = 0")
def j21(s, d):
    n = derived(s, d, "track_points").withColumn("n", F.count("*").over(Window.partitionBy("track_id")))
    return n.where((F.col("seq") - 1) % F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") / 4)) == 0).select("track_id", "seq")


@query("A32_class_balance", "SELECT count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 0) AS negatives, round(count(*) FILTER (quality = 0) / count(*) FILTER (quality = 1), 4) AS weight FROM labels")
def a32(s, d):
    c = raw(s, d, "labels").agg(F.count_if(F.col("quality") == 1).alias("positives"), F.count_if(F.col("quality") == 0).alias("negatives"))
    return c.withColumn("weight", F.round(F.col("negatives") / F.when(F.col("positives") > 0, F.col("positives")), 4))


@query("A33_imputed", ctes("controls") + ", k AS (SELECT course_id, ord, CASE WHEN ord % 4 <> 0 THEN ele END AS ele FROM controls) SELECT course_id, ord, coalesce(ele, (SELECT median(ele) FROM k)) AS ele FROM k")
def a33(s, d):
    """Missing heights (every fourth control's) take the median of the others."""
    k = derived(s, d, "controls").select("course_id", "ord", F.when(F.col("ord") % 4 != 0, F.col("ele")).alias("ele"))
    return k.join(k.agg(F.percentile("ele", 0.5).alias("mid")), F.lit(True)).select("course_id", "ord", F.coalesce("ele", "mid").alias("ele"))


@query("A23_map_summary", ctes("areas") + f""" SELECT count(*) AS n, count(*) FILTER (c = 'water') AS water, count(*) FILTER (c = 'vegetation') AS vegetation, count(*) FILTER (c = 'man_made') AS man_made,
  round({geo.hav_sql('x0', 'y0', 'x1', 'y0')} / 1000, 3) AS width_km FROM (SELECT {S.category_sql('isom')} AS c, min(min_lng) OVER () AS x0, max(max_lng) OVER () AS x1, min(min_lat) OVER () AS y0 FROM areas) GROUP BY x0, x1, y0""")  # fmt: skip
def a23(s, d):
    a = derived(s, d, "areas").withColumn("c", S.category(F.col("isom")))
    n = a.agg(F.count("*").alias("n"), *[F.count_if(F.col("c") == c).alias(c) for c in ("water", "vegetation", "man_made")], F.min("min_lng").alias("x0"), F.max("max_lng").alias("x1"), F.min("min_lat").alias("y0"))
    return n.select("n", "water", "vegetation", "man_made", F.round(geo.haversine(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y0")) / 1000, 3).alias("width_km"))


@query("U06_distinct_controls", ctes("controls") + " SELECT lng, lat, min((course_id, ord))[1] AS course_id FROM controls GROUP BY lng, lat")
def u06(s, d):
    return derived(s, d, "controls").groupBy("lng", "lat").agg(F.min(F.struct("course_id", "ord"))["course_id"].alias("course_id"))


@query("U01_U04_new_places", ctes("controls", "candidates") + " SELECT lng, lat, 'candidate' AS kind FROM (SELECT lng, lat FROM candidates EXCEPT SELECT lng, lat FROM controls) UNION ALL SELECT DISTINCT lng, lat, 'control' FROM controls")
def u01(s, d):
    """All places of controls, and those of candidates where none stands."""
    c = derived(s, d, "controls").select("lng", "lat").distinct()
    new = derived(s, d, "candidates").select("lng", "lat").distinct().join(c, ["lng", "lat"], "left_anti")
    return new.withColumn("kind", F.lit("candidate")).unionByName(c.withColumn("kind", F.lit("control")))


@query("U05_K08_upsert", ctes("areas") + ", o AS (SELECT isom, min(area_id) AS v FROM areas WHERE area_id % 2 = 0 GROUP BY 1), n AS (SELECT isom, max(area_id) AS v FROM areas WHERE area_id % 3 = 0 GROUP BY 1) SELECT isom, coalesce(n.v, o.v) AS v FROM o FULL JOIN n USING (isom)")
def u05(s, d):
    """New values win, old ones stay where there is no new one."""
    a = derived(s, d, "areas")
    old, new = a.where("area_id % 2 = 0").groupBy("isom").agg(F.min("area_id").alias("old")), a.where("area_id % 3 = 0").groupBy("isom").agg(F.max("area_id").alias("new"))
    return old.join(new, "isom", "full").select("isom", F.coalesce("new", "old").alias("v"))


@query("U03_A38_route_diversity", ctes("controls") + """, p AS (SELECT course_id, ord, CAST(round_even(lng * 200, 0) AS BIGINT) AS x FROM controls), e AS (SELECT course_id, lag(x) OVER (PARTITION BY course_id ORDER BY ord) * 10000 + x AS e FROM p),
  r AS (SELECT course_id, course_id // 32 AS fam, list_distinct(list(e)) AS es FROM e WHERE e IS NOT NULL GROUP BY course_id)
  SELECT a.fam, count(*) AS pairs, round(avg(1 - len(list_intersect(a.es, b.es)) / len(list_distinct(list_concat(a.es, b.es)))), 4) AS diversity FROM r a JOIN r b ON a.fam = b.fam AND a.course_id < b.course_id GROUP BY a.fam""")  # fmt: skip
def a38(s, d):
    """How much the routes of a family (32 neighbouring keys at most) differ in their edges."""
    w = Window.partitionBy("course_id").orderBy("ord")
    p = derived(s, d, "controls").withColumn("x", F.bround(F.col("lng") * 200, 0).cast("long"))
    e = p.select("course_id", (F.lag("x").over(w) * 10000 + F.col("x")).alias("e")).where("e IS NOT NULL")
    r = e.groupBy(F.floor(F.col("course_id") / 32).alias("fam"), "course_id").agg(F.collect_set("e").alias("es"))
    pairs = r.alias("a").join(r.alias("b"), F.expr("a.fam = b.fam AND a.course_id < b.course_id"))
    gap = 1 - F.size(F.array_intersect("a.es", "b.es")) / F.size(F.array_union("a.es", "b.es"))
    return pairs.groupBy(F.col("a.fam").alias("fam")).agg(F.count("*").alias("pairs"), F.round(F.avg(gap), 4).alias("diversity"))


@query("J01_resolved_refs", "WITH k AS (SELECT p_partkey FROM part WHERE p_size > 10), j AS (SELECT l_orderkey AS course_id, l_linenumber AS ord, l_partkey AS control_id, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem JOIN k ON p_partkey = l_partkey) SELECT course_id, ord, control_id FROM j WHERE n >= 2")
def j01(s, d):
    """References that name a known control; courses left with fewer than two go."""
    k = raw(s, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("control_id"))
    refs = raw(s, d, "lineitem").select(F.col("l_orderkey").alias("course_id"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").alias("control_id"))
    return refs.join(k, "control_id").withColumn("n", F.count("*").over(Window.partitionBy("course_id"))).where("n >= 2").select("course_id", "ord", "control_id")


#: Course types by words of the name, the first that fits: fixed values.
COURSE_TYPES = {"sprint": ("sprint", "city", "urban", "street", "ville"), "middle": ("middle", "moyen", "md", "short"), "long": ("long", "ld", "classic", "chase"), "score": ("score", "rogaine")}


@query("P06_course_type", "SELECT doc_id, CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(n, '{w}')''' for w in ws)} THEN '{t}'" for t, ws in COURSE_TYPES.items()) + " ELSE 'unknown' END AS kind FROM (SELECT doc_id, lower(coalesce(text, '')) AS n FROM documents)")
def p06(s, d):
    """The type that a document's text names."""
    n, kind = F.lower(F.coalesce("text", F.lit(""))), F.lit("unknown")
    for t, ws in reversed(COURSE_TYPES.items()):
        kind = F.when(n.rlike("|".join(ws)), t).otherwise(kind)
    return raw(s, d, "documents").select("doc_id", kind.alias("kind"))


@query("R07_filtered_nearest", _TOP.replace("WHERE a.vec_id % 50 = 0", "WHERE a.vec_id % 50 = 0 AND b.label IN (0, 3, 7)") + " SELECT query_id, id, round(score, 4) AS score FROM t WHERE place <= 5")
def r07(s, d):
    """The five nearest among vectors of given types: the filter comes before the search."""
    v = raw(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")
    asked = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return X.top_matches(asked, v.where("label IN (0, 3, 7)"), 5).select("query_id", "id", F.round("score", 4).alias("score"))


@query("J03_K01_consented", "SELECT l_orderkey AS course_id, l_linenumber AS ord, l_partkey AS control_id, coalesce(nullif(l_suppkey % 6, 0), o_custkey % 6) AS td FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F'")
def j03(s, d):
    """Control rows of contributions that may be exported; a control's own grade goes before its contribution's."""
    o = raw(s, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("course_id"), (F.col("o_custkey") % 6).alias("td"))
    rows = raw(s, d, "lineitem").select(F.col("l_orderkey").alias("course_id"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").alias("control_id"), F.nullif(F.col("l_suppkey") % 6, F.lit(0)).alias("own"))
    return rows.join(o, "course_id").select("course_id", "ord", "control_id", F.coalesce("own", "td").alias("td"))


@query("K10_delete_dependants", "SELECT l_orderkey AS course_id, l_linenumber AS ord FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def k10(s, d):
    """What remains of the control rows when some contributions are deleted."""
    gone = raw(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("course_id"))
    return raw(s, d, "lineitem").select(F.col("l_orderkey").alias("course_id"), F.col("l_linenumber").alias("ord")).join(gone, "course_id", "left_anti")


@query("S25_elevation", ctes("controls", "candidates") + """, dem AS (SELECT floor(lng / 0.00051) AS cx, floor(lat / 0.00051) AS cy, round(avg(ele), 2) AS z FROM controls GROUP BY ALL)
  SELECT cand_id, coalesce(z, 0) AS z FROM candidates LEFT JOIN dem ON cx = floor((lng + 0.00003) / 0.00051) AND cy = floor((lat + 0.00003) / 0.00051)""")  # fmt: skip
def s25(s, d):
    """Heights of points from a table of cells; 0 where there is none."""
    cx, cy = geo.cell(F.col("lng"), 0.00051).alias("cx"), geo.cell(F.col("lat"), 0.00051).alias("cy")
    dem = derived(s, d, "controls").groupBy(cx, cy).agg(F.round(F.avg("ele"), 2).alias("z"))
    points = derived(s, d, "candidates").select("cand_id", (F.col("lng") + 0.00003).alias("lng"), (F.col("lat") + 0.00003).alias("lat")).select("cand_id", cx, cy)
    return points.join(dem, ["cx", "cy"], "left").select("cand_id", F.coalesce("z", F.lit(0.0)).alias("z"))


@query("W21_bends", _T + f""", l AS (SELECT track_id, seq, lng, lat, lag(lng) OVER o AS px, lag(lat) OVER o AS py, lead(lng) OVER o AS nx, lead(lat) OVER o AS ny FROM track_points WINDOW o AS (PARTITION BY track_id ORDER BY seq))
  SELECT track_id, seq FROM l WHERE px IS NULL OR nx IS NULL OR {geo.between_sql(geo.bearing_sql('lng', 'lat', 'px', 'py'), geo.bearing_sql('lng', 'lat', 'nx', 'ny'))} < 150""")  # fmt: skip
def w21(s, d):
    """Ends of a line, and vertices where it bends to less than 150 degrees."""
    w = Window.partitionBy("track_id").orderBy("seq")
    x, y = F.col("lng"), F.col("lat")
    back, on = geo.bearing(x, y, F.lag("lng").over(w), F.lag("lat").over(w)), geo.bearing(x, y, F.lead("lng").over(w), F.lead("lat").over(w))
    bent = derived(s, d, "track_points").select("track_id", "seq", geo.between(back, on).alias("angle"))
    return bent.where("angle IS NULL OR angle < 150").select("track_id", "seq")


@query("F24_minutes", _TIMES + " SELECT event_id, round(secs / 60, 4) AS minutes FROM t")
def f24(s, d):
    """Minutes of a time as text; none where it is no time."""
    return _times(s, d).select("event_id", F.round(F.col("secs") / 60, 4).alias("minutes"))


@query("A15_control_count", ctes("controls") + " SELECT course_id, greatest(count(*) - 2, 0) AS n FROM controls GROUP BY course_id HAVING greatest(count(*) - 2, 0) NOT BETWEEN 12 AND 28")
def a15(s, d):
    """Courses with fewer than 12 or more than 28 controls between start and finish."""
    return derived(s, d, "controls").groupBy("course_id").agg(F.greatest(F.count("*") - 2, F.lit(0)).alias("n")).where("n NOT BETWEEN 12 AND 28")


@query("A13_problem_score", "WITH p AS (SELECT l_orderkey AS course_id, count(*) FILTER (l_quantity > 40) AS high, count(*) FILTER (l_quantity > 25 AND l_quantity <= 40) AS medium, count(*) FILTER (l_quantity <= 25) AS low FROM lineitem GROUP BY 1), q AS (SELECT *, greatest(0, 100 - 15 * high - 5 * medium - 2 * low) AS score FROM p) SELECT *, if(score >= 70, 'OK', if(score >= 50, 'ATTENTION', 'CRITIQUE')) AS status FROM q")
def a13(s, d):
    """Problems by severity (the lines' quantities stand for it), the score they leave, and its status."""
    q = F.col("l_quantity")
    p = raw(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("course_id")).agg(F.count_if(q > 40).alias("high"), F.count_if((q > 25) & (q <= 40)).alias("medium"), F.count_if(q <= 25).alias("low"))
    score = F.greatest(F.lit(0), 100 - 15 * F.col("high") - 5 * F.col("medium") - 2 * F.col("low"))
    return p.withColumn("score", score).withColumn("status", F.when(F.col("score") >= 70, "OK").when(F.col("score") >= 50, "ATTENTION").otherwise("CRITIQUE"))


@query("J02_courses_on_maps", "SELECT o_orderkey AS event, c_custkey AS mapid, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 4 <> 0")
def j02(s, d):
    """Events with the map they name; those whose map has no place go."""
    maps = raw(s, d, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("mapid"), F.col("c_name").alias("name"))
    return raw(s, d, "orders").select(F.col("o_orderkey").alias("event"), F.col("o_custkey").alias("mapid")).join(maps, "mapid").select("event", "mapid", "name")


@query("J04_symbol_names", ctes("areas") + ", k AS (SELECT DISTINCT isom, 'symbol ' || isom AS name FROM areas WHERE isom % 3 <> 0) SELECT area_id, name FROM areas LEFT JOIN k USING (isom)")
def j04(s, d):
    """Names of symbols by their first three digits; every second area has the long form."""
    a = derived(s, d, "areas")
    names = a.where("isom % 3 <> 0").select("isom", F.concat(F.lit("symbol "), "isom").alias("name")).distinct()
    symbol = F.when(F.col("area_id") % 2 == 0, F.col("isom") * 1000).otherwise(F.col("isom"))
    code = F.when(symbol >= 1000, F.floor(symbol / 1000)).otherwise(symbol).cast("int")
    return a.select("area_id", code.alias("isom")).join(names, "isom", "left").select("area_id", "name")


@query("F18_affine", "SELECT p_partkey AS px, CAST(round(5.48 + p_partkey % 700 * 0.00001 + p_size * 0.000002, 9) AS DOUBLE) AS lng, CAST(round(49.2 + p_partkey % 700 * 0.000001 - p_size * 0.00001, 9) AS DOUBLE) AS lat FROM part")
def f18(s, d):
    """Places of pixels by the six numbers of a map's world file."""
    x, y = (F.col("p_partkey") % 700).cast("double"), F.col("p_size").cast("double")
    lng, lat = geo.affine(x, y, (0.00001, 0.000002, 5.48), (0.000001, -0.00001, 49.2))
    return raw(s, d, "part").select(F.col("p_partkey").alias("px"), F.round(lng, 9).alias("lng"), F.round(lat, 9).alias("lat"))
