"""Queries over courses, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import courses as C
from ..operators import spatial as S
from ..registry import query
from ..sources.derived import ctes, derived

#: Legs as DuckDB sees them.
_P, _N = ("px", "py", "lng", "lat"), ("lng", "lat", "nx", "ny")
LEGS = (
    ctes("controls")
    + f""", w AS (SELECT *, lag(lng) OVER o AS px, lag(lat) OVER o AS py, lead(lng) OVER o AS nx, lead(lat) OVER o AS ny, count(*) OVER (PARTITION BY course_id) AS n, row_number() OVER o AS rn
  FROM controls WINDOW o AS (PARTITION BY course_id ORDER BY ord)),
a AS (SELECT *, {geo.hav_sql(*_P)} AS leg_in, {geo.hav_sql(*_N)} AS leg_out, {geo.bearing_sql(*_P)} AS b_in, {geo.bearing_sql(*_N)} AS b_out FROM w),
legs AS (SELECT *, {geo.between_sql('b_in', 'b_out')} AS turn, {geo.between_sql('b_in', '(b_out + 180) % 360')} AS back FROM a),
e AS (SELECT *, ele - lag(ele) OVER (PARTITION BY course_id ORDER BY ord) AS step FROM controls),
climb AS (SELECT course_id, coalesce(sum(greatest(step, 0)), 0) AS climb, coalesce(sum(greatest(-step, 0)), 0) AS descent FROM e GROUP BY course_id),
s AS (SELECT course_id, count(*) AS n, coalesce(sum(leg_in), 0) AS length, max(leg_in) AS longest, avg(leg_in) AS mean_leg, coalesce(stddev_pop(leg_in), 0) AS std_leg,
  count(*) FILTER (turn BETWEEN 30 AND 150) AS good_turns, count(*) FILTER (turn < 25) AS straight25, count(*) FILTER (turn < 15) AS straight15, count(*) FILTER (back < 25) AS doglegs25,
  count(*) FILTER (leg_in < 15) AS under15, count(*) FILTER (leg_in < 60) AS under60 FROM legs GROUP BY course_id),
sc AS (SELECT * FROM s JOIN climb USING (course_id))"""
)
_TD = "CAST(CASE WHEN longest IS NULL OR longest <= 200 THEN 1 WHEN longest <= 350 THEN 2 WHEN longest <= 700 THEN 3 WHEN longest <= 1500 THEN 4 ELSE 5 END AS INT)"
_PD = "CAST(CASE WHEN length <= 0 OR climb / length < 0.01 THEN 1 WHEN climb / length < 0.02 THEN 2 WHEN climb / length < 0.04 THEN 3 WHEN climb / length < 0.06 THEN 4 ELSE 5 END AS INT)"


def _c(s: SparkSession, d: str) -> DataFrame:
    return derived(s, d, "controls")


def _round(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("course_length_grade", LEGS + f" SELECT course_id, n, round(length, 2) AS length_m, round(longest, 2) AS max_leg_m, {_TD} AS td_grade FROM s")
def course_length_grade(s, d):
    return C.summary(_c(s, d)).select("course_id", "n", F.round("length", 2).alias("length_m"), F.round("longest", 2).alias("max_leg_m"), C.grade_td(F.col("longest")).alias("td_grade"))


@query("W01_leg_distance", LEGS + " SELECT course_id, ord, round(leg_in, 2) AS leg_in, round(coalesce(leg_out, 0), 2) AS leg_out FROM legs")
def w01(s, d):
    return C.legs(_c(s, d)).select("course_id", "ord", F.round("leg_in", 2).alias("leg_in"), F.round(F.coalesce("leg_out", F.lit(0.0)), 2).alias("leg_out"))


@query("W02_leg_bearing", LEGS + " SELECT course_id, ord, round(b_out, 2) AS bearing FROM legs WHERE leg_out > 0")
def w02(s, d):
    return C.legs(_c(s, d)).where("leg_out > 0").select("course_id", "ord", F.round("bearing_out", 2).alias("bearing"))


@query("W03_turn_angle", LEGS + " SELECT course_id, ord, round(turn, 2) AS turn FROM legs WHERE turn IS NOT NULL")
def w03(s, d):
    return C.legs(_c(s, d)).where("turn IS NOT NULL").select("course_id", "ord", F.round("turn", 2).alias("turn"))


@query("W04_position_ratio", LEGS + " SELECT course_id, ord, round((rn - 1) / greatest(1, n - 1), 6) AS position_ratio FROM legs")
def w04(s, d):
    return C.legs(_c(s, d)).select("course_id", "ord", F.round("position_ratio", 6).alias("position_ratio"))


@query("W05_cumulative_distance", LEGS + " SELECT course_id, ord, round(coalesce(sum(leg_in) OVER (PARTITION BY course_id ORDER BY ord), 0), 2) AS metres, round(coalesce(sum(leg_in) OVER (PARTITION BY course_id ORDER BY ord), 0) / 170.0::DOUBLE, 3) AS minutes FROM legs")
def w05(s, d):
    run = F.coalesce(F.sum("leg_in").over(C.by_order()), F.lit(0.0))
    return C.legs(_c(s, d)).select("course_id", "ord", F.round(run, 2).alias("metres"), F.round(run / 170.0, 3).alias("minutes"))


@query("A08_W06_climb", LEGS + " SELECT course_id, climb, descent FROM climb")
def a08(s, d):
    return C.climb(_c(s, d)).select("course_id", "climb", "descent")


@query("W07_doglegs", LEGS + " SELECT course_id, ord, round(back, 2) AS angle FROM legs WHERE back < 20")
def w07(s, d):
    return C.legs(_c(s, d)).where(F.col("back") < C.DOGLEG).select("course_id", "ord", F.round("back", 2).alias("angle"))


@query("W08_leg_distance_rules", LEGS + """ SELECT course_id, ord, code FROM (SELECT course_id, ord, 'C02' AS code FROM legs WHERE leg_in < 30
  UNION ALL SELECT course_id, ord, 'C03' FROM legs WHERE leg_in > 400 UNION ALL SELECT course_id, ord, 'C04' FROM legs WHERE leg_in < 30)""")  # fmt: skip
def w08(s, d):
    return C.issues(_c(s, d)).where(F.col("code").isin("C02", "C03", "C04")).select("course_id", "ord", "code")


@query("W09_point_type", LEGS + " SELECT course_id, ord, CASE WHEN rn = 1 THEN 'start' WHEN rn = n THEN 'finish' ELSE 'control' END AS point_type FROM legs")
def w09(s, d):
    return C.legs(_c(s, d)).select("course_id", "ord", C.point_type().alias("point_type"))


@query("W10_parallel_legs", LEGS + " SELECT course_id, ord, round(turn, 2) AS angle FROM legs WHERE turn < 20")
def w10(s, d):
    return C.legs(_c(s, d)).where(F.col("turn") < C.PARALLEL).select("course_id", "ord", F.round("turn", 2).alias("angle"))


@query("W11_monotony", LEGS + """, r AS (SELECT course_id, n, sum(CASE WHEN turn < 60 THEN 0 ELSE 1 END) OVER (PARTITION BY course_id ORDER BY ord) AS run FROM legs WHERE leg_out IS NOT NULL),
  g AS (SELECT course_id, n, max(k) AS longest_run FROM (SELECT course_id, n, run, count(*) AS k FROM r GROUP BY ALL) GROUP BY ALL)
  SELECT course_id, longest_run, CAST(CASE WHEN n < 4 THEN 75 WHEN longest_run <= 2 THEN 100 WHEN longest_run = 3 THEN 70 WHEN longest_run = 4 THEN 40 ELSE greatest(0, 40 - (longest_run - 4) * 15) END AS DOUBLE) AS score FROM g""")  # fmt: skip
def w11(s, d):
    return C.longest_run(_c(s, d))


@query("W12_alternation", LEGS + """, m AS (SELECT *, avg(leg_in) OVER (PARTITION BY course_id) AS mean FROM legs WHERE leg_in IS NOT NULL),
  k AS (SELECT course_id, ord, CASE WHEN leg_in < mean * 0.8 THEN 'C' ELSE 'L' END AS kind FROM m WHERE n >= 4 AND (leg_in < mean * 0.8 OR leg_in > mean * 1.2)),
  l AS (SELECT *, lag(kind) OVER (PARTITION BY course_id ORDER BY ord) AS last FROM k),
  g AS (SELECT course_id, CASE WHEN count(*) > 1 THEN count(*) FILTER (last <> kind) / (count(*) - 1) * 100 END AS v FROM l GROUP BY course_id)
  SELECT course_id, round(coalesce(v, 75), 4) AS score FROM (SELECT DISTINCT course_id FROM controls) LEFT JOIN g USING (course_id)""")  # fmt: skip
def w12(s, d):
    return _round(C.alternation(_c(s, d)), 4, "score")


@query("W16_axis_linear_legs", LEGS + " SELECT course_id, ord FROM legs WHERE leg_out > 0 AND (b_out % 90 < 9.95 OR b_out % 90 > 80.05)")
def w16(s, d):
    off = F.pmod(F.col("bearing_out"), F.lit(90.0))
    return C.legs(_c(s, d)).where((F.col("leg_out") > 0) & ((off < 9.95) | (off > 80.05))).select("course_id", "ord")


@query("W17_close_controls", LEGS + " SELECT course_id, ord, round(leg_out, 2) AS metres FROM legs WHERE leg_out < 60")
def w17(s, d):
    return C.legs(_c(s, d)).where("leg_out < 60").select("course_id", "ord", F.round("leg_out", 2).alias("metres"))


@query("A10_pd_grade", LEGS + f" SELECT course_id, {_PD} AS pd_grade FROM sc")
def a10(s, d):
    return C.summary(_c(s, d)).select("course_id", C.grade_pd(F.col("climb"), F.col("length")).alias("pd_grade"))


@query("A11_quality_xml", LEGS + """ SELECT course_id, round(CASE WHEN n < 3 OR mean_leg = 0 THEN 50 ELSE greatest(0, least(100, greatest(0, 100 - std_leg / mean_leg * 200) * 0.4
  + good_turns / greatest(1, n - 2) * 60 - least(40, straight25 * 10) - least(30, under60 * 15))) END, 3) AS score FROM s""")  # fmt: skip
def a11(s, d):
    x = C.summary(_c(s, d))
    return x.select("course_id", F.round(C.quality_xml(x), 3).alias("score"))


@query("A12_quality_gpx", LEGS + """ SELECT course_id, round(CASE WHEN n < 3 THEN 0.5 ELSE greatest(0, least(100, (greatest(0, 1 - std_leg / greatest(mean_leg, 1)) * 0.4
  + good_turns / greatest(1, n - 2) * 0.6) * 100 - straight15 * 8 - under15 * 10)) / 100 END, 5) AS score FROM s""")  # fmt: skip
def a12(s, d):
    return C.summary(_c(s, d)).select("course_id", F.round(C.quality_gpx(), 5).alias("score"))


_ISSUES = (
    LEGS
    + """, issues AS (SELECT course_id, 'C01' AS code, 'ERROR' AS severity, ord FROM legs WHERE n >= 2 AND back < 20
  UNION ALL SELECT course_id, 'C02', 'ERROR', ord FROM legs WHERE leg_in < 30 UNION ALL SELECT course_id, 'C03', 'WARNING', ord FROM legs WHERE leg_in > 400
  UNION ALL SELECT course_id, 'C04', 'WARNING', ord FROM legs WHERE leg_in < 30 UNION ALL SELECT course_id, 'C12', 'WARNING', ord FROM legs WHERE turn < 20
  UNION ALL SELECT course_id, 'C00', 'ERROR', -1 FROM sc WHERE n < 2 UNION ALL SELECT course_id, 'C05', 'WARNING', -1 FROM sc WHERE n >= 2 AND (n - 2 < 12 OR n - 2 > 28)
  UNION ALL SELECT course_id, 'C06', 'WARNING', -1 FROM sc WHERE n >= 2 AND (length / 3.5 / 60 < 9.6 OR length / 3.5 / 60 > 18)
  UNION ALL SELECT course_id, 'C07', 'WARNING', -1 FROM sc WHERE n >= 2 AND length > 0 AND climb / length * 100 > 3)"""
)


@query("A14_issues", _ISSUES + " SELECT * FROM issues")
def issues(s, d):
    return C.issues(_c(s, d))


@query("A14_report", _ISSUES + """, g AS (SELECT course_id, count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARNING') AS warnings FROM issues GROUP BY course_id)
  SELECT course_id, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, greatest(0, 100 - 15 * coalesce(errors, 0) - 5 * coalesce(warnings, 0)) AS score, coalesce(errors, 0) = 0 AS compliant
  FROM (SELECT DISTINCT course_id FROM controls) LEFT JOIN g USING (course_id)""")  # fmt: skip
def report(s, d):
    return C.report(_c(s, d))


@query("A19_compliance", LEGS + """, p AS (SELECT *, CASE WHEN length > 0 THEN climb / length ELSE 0 END AS r FROM sc),
  q AS (SELECT *, CASE WHEN r > 0.06 THEN 30 WHEN r > 0.04 THEN 20 ELSE 0 END + least(40, doglegs25 * 10) + least(30, under60 * 15) AS f FROM p)
  SELECT course_id, round(r, 6) AS climb_ratio, doglegs25 AS dog_legs, under60 AS too_close, CAST(greatest(0, 100 - f) AS BIGINT) AS score, f = 0 AS valid FROM q""")  # fmt: skip
def a19(s, d):
    r = F.coalesce(F.col("climb") / F.when(F.col("length") > 0, F.col("length")), F.lit(0.0))
    x = C.summary(_c(s, d)).withColumn("f", C.compliance(r))
    return x.select("course_id", F.round(r, 6).alias("climb_ratio"), F.col("doglegs25").alias("dog_legs"), F.col("under60").alias("too_close"), F.greatest(F.lit(0), 100 - F.col("f")).cast("long").alias("score"), (F.col("f") == 0).alias("valid"))


@query("A20_bounds", ctes("controls") + " SELECT course_id, min(lng) AS min_x, min(lat) AS min_y, max(lng) AS max_x, max(lat) AS max_y FROM controls GROUP BY course_id")
def a20(s, d):
    return _c(s, d).groupBy("course_id").agg(F.min("lng").alias("min_x"), F.min("lat").alias("min_y"), F.max("lng").alias("max_x"), F.max("lat").alias("max_y"))


@query("A28_leg_summary", LEGS + """ SELECT course_id, count(leg_in) AS legs, round(avg(leg_in), 3) AS mean_leg, round(max(leg_in), 3) AS max_leg, round(avg(turn), 3) AS mean_turn FROM legs
  GROUP BY GROUPING SETS ((course_id), ())""")  # fmt: skip
def a28(s, d):
    r = lambda f, c: F.round(f(c), 3)
    return C.legs(_c(s, d)).groupingSets([[F.col("course_id")], []], "course_id").agg(F.count("leg_in").alias("legs"), r(F.avg, "leg_in").alias("mean_leg"), r(F.max, "leg_in").alias("max_leg"), r(F.avg, "turn").alias("mean_turn"))


@query("P24_min_size", ctes("controls") + " SELECT course_id, count(*) AS n FROM controls GROUP BY course_id HAVING count(*) >= 3")
def p24(s, d):
    return _c(s, d).groupBy("course_id").agg(F.count("*").alias("n")).where("n >= 3")


@query("P26_alerts", LEGS + """, x AS (SELECT course_id, unnest(list_filter([CASE WHEN longest > 3000 THEN 'long_leg' END, CASE WHEN shortest < 20 THEN 'short_leg' END,
  CASE WHEN b > 0.35 THEN 'dog_legs' END, CASE WHEN td = 5 AND length < 5000 THEN 'td5_short' END], lambda v: v IS NOT NULL)) AS alert FROM (SELECT s.*, (SELECT min(leg_in) FROM legs WHERE legs.course_id = s.course_id) AS shortest,
  doglegs25 / greatest(1, n - 2) AS b, CASE WHEN longest > 1500 THEN 5 ELSE 1 END AS td FROM s)) SELECT course_id, alert FROM x""")  # fmt: skip
def p26(s, d):
    c = F.col
    found = F.array_compact(F.array(
        F.when(c("longest") > 3000, "long_leg"), F.when(c("shortest") < 20, "short_leg"), F.when(c("doglegs25") / F.greatest(F.lit(1), c("n") - 2) > 0.35, "dog_legs"),
        F.when((C.grade_td(c("longest")) == 5) & (c("length") < 5000), "td5_short"),
    ))
    return C.summary(_c(s, d)).select("course_id", F.explode(found).alias("alert"))


def _pairs(s, d, most: float) -> DataFrame:
    """Pairs of a course's controls nearer than so many metres."""
    return S.course_pairs(_c(s, d), most).withColumnRenamed("metres", "m")


_PAIRS = ctes("controls") + f", p AS (SELECT a.course_id, a.ord AS i, b.ord AS j, {geo.hav_sql('a.lng', 'a.lat', 'b.lng', 'b.lat')} AS m FROM controls a JOIN controls b ON a.course_id = b.course_id AND a.ord < b.ord)"


@query("J13_visibility", _PAIRS + " SELECT course_id, i, j, round(m, 2) AS metres FROM p WHERE m < 150")
def j13(s, d):
    return _pairs(s, d, 150).select("course_id", "i", "j", F.round("m", 2).alias("metres"))


@query("J14_sprint_spacing", _PAIRS + " SELECT course_id, i, j FROM p WHERE m < 25")
def j14(s, d):
    return _pairs(s, d, 25).select("course_id", "i", "j")


@query("J15_min_distance", _PAIRS + " SELECT course_id, round(min(m), 2) AS nearest, count(*) FILTER (m < 60) AS too_close FROM p GROUP BY course_id")
def j15(s, d):
    return S.nearest_of_course(_c(s, d), 60).withColumn("nearest", F.round("nearest", 2))


@query("T03_issue_order", _ISSUES + """ SELECT course_id, code, ord, CAST(row_number() OVER (PARTITION BY course_id ORDER BY CASE severity WHEN 'ERROR' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END, ord, code) AS INT) AS place FROM issues""")
def t03(s, d):
    from pyspark.sql import Window

    rank = F.when(F.col("severity") == "ERROR", 0).when(F.col("severity") == "WARNING", 1).otherwise(2)
    return C.issues(_c(s, d)).select("course_id", "code", "ord", F.row_number().over(Window.partitionBy("course_id").orderBy(rank, "ord", "code")).alias("place"))


@query("A34_compare", LEGS + """, q AS (SELECT course_id, round(CASE WHEN n < 3 OR mean_leg = 0 THEN 50 ELSE greatest(0, least(100, greatest(0, 100 - std_leg / mean_leg * 200) * 0.4
  + good_turns / greatest(1, n - 2) * 60 - least(40, straight25 * 10) - least(30, under60 * 15))) END, 3) AS score FROM s) SELECT course_id, score FROM q ORDER BY score DESC, course_id LIMIT 10""")  # fmt: skip
def a34(s, d):
    """The ten best courses: the limit is the report's."""
    return a11(s, d).orderBy(F.desc("score"), "course_id").limit(10)
