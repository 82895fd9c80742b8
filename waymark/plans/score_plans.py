"""Queries of features, scores, rules and corrections of courses, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.classes import first
from ..operators import courses as C
from ..operators import scores as R
from ..operators import spatial as S
from ..operators.tables import cut
from ..registry import query
from ..sources.derived import ctes, derived
from .course_plans import LEGS

_CC = ctes("controls", "candidates")
_PLACES = ", pl AS (SELECT DISTINCT lng, lat FROM controls)"
BOX, WIDTH, HEIGHT = (5.48, 49.18, 5.5, 49.19), 20, 10
TARGET, CLIMB, COUNT = 4000.0, 120.0, 12


def _c(s, d):
    return derived(s, d, "controls")


def _k(s, d):
    return derived(s, d, "candidates")


def _case(table: dict, key: str, otherwise) -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE"
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in table.items()) + f" ELSE {q(otherwise)} END"


_NEAR = f"""{_PLACES}, mm AS (SELECT pl.lng, pl.lat, cand_id, ftype, round({geo.hav_sql('pl.lng', 'pl.lat', 'k.lng', 'k.lat')}, 3) AS metres FROM pl JOIN candidates k ON abs(pl.lng - k.lng) < 0.003 AND abs(pl.lat - k.lat) < 0.002),
  ng AS (SELECT lng, lat, count(*) AS density, min((metres, cand_id, ftype))[3] AS kind, min(metres) FILTER (ftype = 'path') AS path_metres FROM mm WHERE metres <= 75 GROUP BY ALL),
  near AS (SELECT lng, lat, coalesce(density, 0) AS density, CASE WHEN kind IS NULL THEN 'unknown' ELSE {_case(R.FEATURE_TYPES, 'kind', 'unknown')} END AS feature_type,
    CASE WHEN kind IS NULL THEN {R.NOTHING}::DOUBLE ELSE {_case(R.ATTRACTIVENESS, 'kind', R.OTHER)} END AS attractiveness, path_metres FROM pl LEFT JOIN ng USING (lng, lat))"""  # fmt: skip


@query("J06_surroundings", _CC + _NEAR + " SELECT course_id, ord, density, feature_type, attractiveness, path_metres FROM controls JOIN near USING (lng, lat)")
def j06(s, d):
    """Density, nearest type, its attractiveness and the nearest path of each control."""
    return _c(s, d).join(R.surroundings(_c(s, d), _k(s, d)), ["lng", "lat"]).select("course_id", "ord", "density", "feature_type", "attractiveness", "path_metres")


_NEAREST = f"{_PLACES}, nn AS (SELECT pl.lng, pl.lat, min((round({geo.hav_sql('pl.lng', 'pl.lat', 'k.lng', 'k.lat')}, 3), cand_id)) AS z FROM pl, candidates k WHERE ftype = 'path' GROUP BY ALL)"


@query("J07_J28_nearest_path", _CC + _NEAREST + " SELECT course_id, ord, z[2] AS cand_id, z[1] AS metres FROM controls JOIN nn USING (lng, lat)")
def j07(s, d):
    """The nearest path at any distance."""
    found = R.nearest_any(_c(s, d), _k(s, d).where("ftype = 'path'"), "cand_id")
    return _c(s, d).join(found, ["lng", "lat"]).select("course_id", "ord", "cand_id", "metres")


_HEAT = f""", heat AS (SELECT CAST(floor((lng - {BOX[0]}::DOUBLE) / 0.001) AS BIGINT) AS gx, CAST(floor(({BOX[3]}::DOUBLE - lat) / 0.001) AS BIGINT) AS gy, least(1.0::DOUBLE, count(*) / 8.0::DOUBLE) AS score FROM candidates GROUP BY ALL),
  gg AS (SELECT lng, lat, (lng - {BOX[0]}::DOUBLE) / ({BOX[2]}::DOUBLE - {BOX[0]}::DOUBLE) * {WIDTH} AS gx, (1 - (lat - {BOX[1]}::DOUBLE) / ({BOX[3]}::DOUBLE - {BOX[1]}::DOUBLE)) * {HEIGHT} AS gy FROM pl),
  cc AS (SELECT *, CAST(greatest(0, least(trunc(gx), {WIDTH - 1})) AS BIGINT) AS x, CAST(greatest(0, least(trunc(gy), {HEIGHT - 1})) AS BIGINT) AS y, gx - trunc(gx) AS fx, gy - trunc(gy) AS fy FROM gg),
  hh AS (SELECT cc.lng, cc.lat, coalesce(a.score, 0) * (1 - fx) * (1 - fy) + coalesce(b.score, 0) * fx * (1 - fy) + coalesce(c.score, 0) * (1 - fx) * fy + coalesce(e.score, 0) * fx * fy AS score FROM cc
    LEFT JOIN heat a ON a.gx = x AND a.gy = y LEFT JOIN heat b ON b.gx = least(x + 1, {WIDTH - 1}) AND b.gy = y LEFT JOIN heat c ON c.gx = x AND c.gy = least(y + 1, {HEIGHT - 1})
    LEFT JOIN heat e ON e.gx = least(x + 1, {WIDTH - 1}) AND e.gy = least(y + 1, {HEIGHT - 1}))"""  # fmt: skip


def _heat(s, d):
    cell = lambda v: F.floor(v / 0.001).cast("long")
    heat = _k(s, d).groupBy(cell(F.col("lng") - BOX[0]).alias("gx"), cell(F.lit(BOX[3]) - F.col("lat")).alias("gy")).agg(F.least(F.lit(1.0), F.count("*") / 8.0).alias("score"))
    return R.heat_lookup(_c(s, d), heat, BOX, WIDTH, HEIGHT)


@query("J29_heat_lookup", _CC + _PLACES + _HEAT + " SELECT course_id, ord, round(score, 6) AS score FROM controls JOIN hh USING (lng, lat)")
def j29(s, d):
    return _c(s, d).join(_heat(s, d), ["lng", "lat"]).select("course_id", "ord", F.round("score", 6).alias("score"))


_QUALITY = """, aa AS (SELECT lng, lat, CASE WHEN min((metres, cand_id, ftype))[3] = 'intersection' THEN 1.0::DOUBLE ELSE 0.45::DOUBLE END AS att FROM mm WHERE metres < 60 GROUP BY ALL),
  rr AS (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY ord) AS rn, count(*) OVER (PARTITION BY course_id) AS n FROM controls),
  tq AS (SELECT course_id, coalesce(avg(coalesce(att, 0.15) * 0.4::DOUBLE + score * 0.6::DOUBLE) FILTER (rn > 1 AND rn < n), 0.5) * 100 AS terrain FROM rr LEFT JOIN aa USING (lng, lat) JOIN hh USING (lng, lat) GROUP BY course_id)"""


@query("A37_terrain_quality", _CC + _NEAR + _HEAT + _QUALITY + " SELECT course_id, round(terrain, 4) AS terrain FROM tq")
def a37(s, d):
    return R.terrain_quality(_c(s, d), _k(s, d), _heat(s, d)).select("course_id", F.round("terrain", 4).alias("terrain"))


_LC = LEGS.replace(ctes("controls"), _CC, 1)
_SHAPE = """, q0 AS (SELECT *, lag(lng) OVER o AS ax, lag(lat) OVER o AS ay, lead(lng) OVER o AS bx, lead(lat) OVER o AS by_ FROM controls WINDOW o AS (PARTITION BY course_id ORDER BY ord)),
  q1 AS (SELECT *, ax - lng AS dx1, ay - lat AS dy1, bx - lng AS dx2, by_ - lat AS dy2 FROM q0),
  q2 AS (SELECT *, sqrt(dx1 * dx1 + dy1 * dy1) AS d1, sqrt(dx2 * dx2 + dy2 * dy2) AS d2, abs(atan2(dy2, dx2) - atan2(lat - ay, lng - ax)) AS turned FROM q1),
  sh AS (SELECT course_id, var_pop(turned) AS variety, stddev_pop(d1) / nullif(avg(d1), 0) AS cv,
    count(*) FILTER (d1 >= 1e-10 AND d2 >= 1e-10 AND degrees(acos(greatest(-1, least(1, (dx1 * dx2 + dy1 * dy2) / (d1 * d2))))) < 60) AS sharp FROM q2 GROUP BY course_id)"""


def _band(r: str, bands: tuple, otherwise: int) -> str:
    return "CASE " + " ".join(f"WHEN {r} BETWEEN {1 - b} AND {1 + b} THEN {p}" for b, p in bands) + f" ELSE {otherwise} END"


_SCORED = f"""{_SHAPE}, pen AS (SELECT course_id, sum(CASE WHEN leg_in < 60 THEN 20 WHEN leg_in < 80 THEN 10 ELSE 0 END) AS pen FROM legs GROUP BY course_id),
  sb AS (SELECT course_id, {_band('length / 4000', ((0.05, 100), (0.1, 90), (0.15, 80), (0.2, 70), (0.3, 60)), 50)} AS length_score, {_band('climb / 120', ((0.1, 100), (0.2, 85), (0.3, 70)), 55)} AS climb_score,
    CASE WHEN n < 2 THEN 50 ELSE greatest(0, 100 - pen) END AS control_distance_score, CASE WHEN n < 3 THEN 50 ELSE least(1, variety / 2) * 100 END AS variety_score,
    CASE WHEN cv IS NULL THEN 50 WHEN cv < 0.2 THEN 100 WHEN cv < 0.3 THEN 85 WHEN cv < 0.4 THEN 70 WHEN cv < 0.5 THEN 55 ELSE 40 END AS balance_score, 70 AS safety_score FROM sc JOIN sh USING (course_id) JOIN pen USING (course_id)),
  st AS (SELECT *, length_score * 0.20 + climb_score * 0.15 + control_distance_score * 0.15 + variety_score * 0.20 + balance_score * 0.15 + safety_score * 0.15 AS total FROM sb)"""
_LETTER = "CASE WHEN {t} >= 90 THEN 'A' WHEN {t} >= 80 THEN 'B' WHEN {t} >= 70 THEN 'C' WHEN {t} >= 60 THEN 'D' ELSE 'F' END"


def _scored(s, d):
    """Per course the six parts and their weighted total."""
    from ..functions import classes as K

    legs = C.legs(_c(s, d))
    fine = legs.groupBy("course_id").agg(F.sum(F.when(F.col("leg_in") < 60, 20).when(F.col("leg_in") < 80, 10).otherwise(0)).alias("fine"))
    x = C.summary(_c(s, d)).join(R.shape(_c(s, d)), "course_id").join(fine, "course_id")
    cv = F.col("cv")
    parts = x.select(
        "course_id", K.target_score(F.col("length"), F.lit(TARGET), K.LENGTH_BANDS, 50).alias("length"), K.target_score(F.col("climb"), F.lit(CLIMB), K.CLIMB_BANDS, 55).alias("climb"),
        F.when(F.col("n") < 2, 50).otherwise(F.greatest(F.lit(0), 100 - F.col("fine"))).alias("control_distance"), F.when(F.col("n") < 3, 50.0).otherwise(F.least(F.lit(1.0), F.col("variety") / 2) * 100).alias("variety"),
        F.when(cv.isNull(), 50).otherwise(first([(cv < 0.2, 100), (cv < 0.3, 85), (cv < 0.4, 70), (cv < 0.5, 55)], 40)).alias("balance"), F.lit(70).alias("safety"),
    )
    return parts.withColumn("total", R.weighted(R.WEIGHTS, R.WHOLE))


@query("A18_course_scores", _LC + _NEAR + _HEAT + _QUALITY + _SCORED + f""", m AS (SELECT *, total * 0.8 + terrain * 0.2 AS with_model FROM st JOIN tq USING (course_id))
  SELECT course_id, CAST(length_score AS DOUBLE) AS length_score, CAST(climb_score AS DOUBLE) AS climb_score, CAST(control_distance_score AS DOUBLE) AS control_distance_score, round(variety_score, 3) AS variety_score, CAST(balance_score AS DOUBLE) AS balance_score,
  CAST(safety_score AS DOUBLE) AS safety_score, round(total, 3) AS total, {_LETTER.format(t='round(total, 3)')} AS grade, round(with_model, 3) AS with_model FROM m""")  # fmt: skip
def a18(s, d):
    """The parts of a course's score, their total and grade; and the total where a model of the terrain counts a fifth."""
    from ..functions import classes as K

    x = _scored(s, d).join(R.terrain_quality(_c(s, d), _k(s, d), _heat(s, d)), "course_id")
    parts = [F.col(p).cast("double").alias(f"{p}_score") if p != "variety" else R.half_away(F.col(p), 3).alias("variety_score") for p in R.WEIGHTS]
    return x.select("course_id", *parts, R.half_away(F.col("total"), 3).alias("total"), K.letter(R.half_away(F.col("total"), 3)).alias("grade"), R.half_away(F.col("total") * 0.8 + F.col("terrain") * 0.2, 3).alias("with_model"))


@query("A34_best_scores", _LC + _SCORED + " SELECT course_id, round(total, 3) AS total FROM st ORDER BY round(total, 3) DESC, course_id LIMIT 10")
def a34(s, d):
    """The ten best courses by all parts: the limit is the report's."""
    return _scored(s, d).select("course_id", F.round("total", 3).alias("total")).orderBy(F.desc("total"), "course_id").limit(10)


@query("A35_fitness", _LC + _PLACES + _HEAT + _SHAPE + """, ai AS (SELECT course_id, avg(score) AS ai FROM controls JOIN hh USING (lng, lat) GROUP BY course_id)
  SELECT course_id, round(CASE WHEN n < 2 THEN -100 ELSE 30 * ai - 40 * abs(length - 4000) / 4000 - 20 * sharp + CASE WHEN n >= 3 THEN 15 * std_leg / (mean_leg + 1e-6) ELSE 0 END END, 4) AS fitness FROM s JOIN ai USING (course_id) JOIN sh USING (course_id)""")  # fmt: skip
def a35(s, d):
    """30 times the mean heat, less 40 a unit of relative length error, less 20 a sharp angle, and 15 times the legs' spread."""
    heat = _c(s, d).join(_heat(s, d), ["lng", "lat"]).groupBy("course_id").agg(F.avg("score").alias("ai"))
    x = C.summary(_c(s, d)).join(heat, "course_id").join(R.shape(_c(s, d)), "course_id")
    rhythm = F.when(F.col("n") >= 3, 15 * F.col("std_leg") / (F.col("mean_leg") + 1e-6)).otherwise(0.0)
    value = 30 * F.col("ai") - 40 * F.abs(F.col("length") - TARGET) / TARGET - 20 * F.col("sharp") + rhythm
    return x.select("course_id", F.round(F.when(F.col("n") < 2, -100.0).otherwise(value), 4).alias("fitness"))


_TURNED = "least(abs(degrees(atan2(dy2, dx2) - atan2(lat - ay, lng - ax))) % 360, 360 - abs(degrees(atan2(dy2, dx2) - atan2(lat - ay, lng - ax))) % 360)"


def _parts_sql(dogleg: float, separation: float, longest: float) -> str:
    return f""", t0 AS (SELECT course_id, ord, {_TURNED} AS t FROM q1), t1 AS (SELECT course_id, count(*) FILTER (t BETWEEN 30 AND 150) AS good, count(*) FILTER (t < {dogleg}) AS straight FROM t0 GROUP BY course_id),
  cl AS (SELECT a.course_id, count(*) FILTER ({geo.hav_sql('a.lng', 'a.lat', 'b.lng', 'b.lat')} < {separation}) AS close FROM controls a JOIN controls b ON a.course_id = b.course_id AND a.ord < b.ord GROUP BY 1),
  ov AS (SELECT course_id, count(*) FILTER (leg_in > {longest}) AS over_ FROM legs GROUP BY course_id),
  b0 AS (SELECT course_id, ord, (degrees(atan2(dx2, dy2)) + 360) % 360 AS b FROM q1 WHERE dx2 IS NOT NULL), b1 AS (SELECT *, CASE WHEN {geo.between_sql('b', 'lag(b) OVER (PARTITION BY course_id ORDER BY ord)')} < 60 THEN 0 ELSE 1 END AS brk FROM b0),
  b2 AS (SELECT course_id, sum(brk) OVER (PARTITION BY course_id ORDER BY ord) AS run FROM b1), b3 AS (SELECT course_id, max(k) AS r FROM (SELECT course_id, run, count(*) AS k FROM b2 GROUP BY ALL) GROUP BY course_id),
  k0 AS (SELECT course_id, ord, leg_in, avg(leg_in) OVER (PARTITION BY course_id) AS m FROM legs WHERE leg_in IS NOT NULL), k1 AS (SELECT course_id, ord, CASE WHEN leg_in < m * 0.8 THEN 'C' ELSE 'L' END AS k FROM k0 WHERE leg_in < m * 0.8 OR leg_in > m * 1.2),
  k2 AS (SELECT *, lag(k) OVER (PARTITION BY course_id ORDER BY ord) AS p FROM k1), k3 AS (SELECT course_id, count(*) FILTER (p <> k) / nullif(count(*) - 1, 0) * 100 AS al FROM k2 GROUP BY course_id),
  fp AS (SELECT s.course_id, CASE WHEN length > 0 THEN CASE WHEN length / 4000 BETWEEN 0.85 AND 1.15 THEN 100 ELSE 100 - (abs(length / 4000 - 1) - 0.15) * 200 END ELSE 75 END AS f_length,
    CASE WHEN length > 0 THEN CASE WHEN 120 / length <= 0.04 THEN 100 WHEN 120 / length <= 0.06 THEN 60 - (120 / length - 0.04) * 1500 ELSE greatest(0, 30 - (120 / length - 0.06) * 1000) END ELSE 75 END AS f_climb,
    coalesce(CASE WHEN mean_leg > 0 THEN CASE WHEN std_leg / mean_leg BETWEEN 0.2 AND 0.5 THEN 100 WHEN std_leg / mean_leg < 0.2 THEN 40 + std_leg / mean_leg * 300 ELSE greatest(0, 100 - (std_leg / mean_leg - 0.5) * 150) END END, 50) AS f_td,
    CASE WHEN s.n >= 3 THEN 100 * good / (s.n - 2) ELSE 50 END AS f_angle, greatest(0, 100 - straight * 15 - coalesce(close, 0) * 20) AS f_equity, greatest(0, 100 - abs(s.n - 12) * 10) AS f_safety, terrain AS f_terrain,
    CASE WHEN s.n < 4 OR r IS NULL THEN 75 WHEN r <= 2 THEN 100 WHEN r = 3 THEN 70 WHEN r = 4 THEN 40 ELSE greatest(0, 40 - (r - 4) * 15) END AS f_monotony, CASE WHEN s.n >= 4 THEN coalesce(al, 75) ELSE 75 END AS f_alternation, greatest(0, 100 - over_ * 25) AS f_sprint_leg
    FROM s JOIN t1 USING (course_id) LEFT JOIN cl USING (course_id) JOIN ov USING (course_id) LEFT JOIN b3 USING (course_id) LEFT JOIN k3 USING (course_id) JOIN tq USING (course_id) WHERE s.n >= 2)"""  # fmt: skip


def _total_sql(weights: dict[str, float]) -> str:
    return " + ".join(f"f_{k} * {w}" for k, w in weights.items())


_FIT = _LC + _NEAR + _HEAT + _QUALITY + _SHAPE


@query("A36_default_fitness", _FIT + _parts_sql(25, 60, 1500) + f" SELECT course_id, round({_total_sql(R.FOREST)}, 3) AS fitness FROM fp")
def a36(s, d):
    """Nine criteria with the weights of forest courses."""
    p = R.fitness_parts(_c(s, d), _k(s, d), TARGET, CLIMB, COUNT, 25.0, 60.0, 1500.0, _heat(s, d))
    return p.select("course_id", R.half_away(R.weighted(R.FOREST, R.WHOLE_FITNESS), 3).alias("fitness"))


@query("A36_sprint_fitness", _FIT + _parts_sql(25, 30, 150) + f" SELECT course_id, round({_total_sql(R.SPRINT)}, 3) AS fitness FROM fp")
def a36_sprint(s, d):
    """With the weights of sprints: long legs in place of the climb."""
    p = R.fitness_parts(_c(s, d), _k(s, d), TARGET, CLIMB, COUNT, 25.0, 30.0, 150.0, _heat(s, d))
    return p.select("course_id", R.half_away(R.weighted(R.SPRINT, R.WHOLE_FITNESS), 3).alias("fitness"))


@query("T09_fittest", _FIT + _parts_sql(25, 60, 1500) + f", z AS (SELECT course_id % 10 AS event, course_id, round({_total_sql(R.FOREST)}, 2) AS fitness FROM fp) SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY event ORDER BY fitness DESC, course_id) <= 10")
def t09(s, d):
    """The ten fittest courses of each event: the limit is the report's."""
    p = R.fitness_parts(_c(s, d), _k(s, d), TARGET, CLIMB, COUNT, 25.0, 60.0, 1500.0, _heat(s, d)).select((F.col("course_id") % 10).alias("event"), "course_id", R.half_away(R.weighted(R.FOREST, R.WHOLE_FITNESS), 2).alias("fitness"))
    w = Window.partitionBy("event").orderBy(F.desc("fitness"), "course_id")
    return p.withColumn("place", F.row_number().over(w)).where("place <= 10").select("event", "course_id", "fitness")


_FEATURES = _LC + _NEAR + """, td AS (SELECT course_id, CAST(CASE WHEN longest IS NULL OR longest <= 200 THEN 1 WHEN longest <= 350 THEN 2 WHEN longest <= 700 THEN 3 WHEN longest <= 1500 THEN 4 ELSE 5 END AS INT) AS td_grade,
    CAST(CASE WHEN length <= 0 OR climb / length < 0.01 THEN 1 WHEN climb / length < 0.02 THEN 2 WHEN climb / length < 0.04 THEN 3 WHEN climb / length < 0.06 THEN 4 ELSE 5 END AS INT) AS pd_grade,
    round(greatest(0, least(100, (greatest(0, 1 - std_leg / greatest(mean_leg, 1)) * 0.4 + good_turns / greatest(1, n - 2) * 0.6) * 100 - straight15 * 8 - under15 * 10)) / 100, 5) AS quality FROM sc WHERE n >= 3),
  ft AS (SELECT course_id, ord, rn, legs.n, td_grade, pd_grade, round((rn - 1) / greatest(1, legs.n - 1), 6) AS position_ratio, round(leg_in, 1) AS leg_metres, round(turn, 1) AS bearing_change, density, feature_type, attractiveness, path_metres, quality
    FROM legs JOIN td USING (course_id) JOIN near USING (lng, lat))"""  # fmt: skip


def _features(s, d):
    """The whole feature row of each control of courses with three or more."""
    of_course = C.summary(_c(s, d)).where("n >= 3").select("course_id", C.grade_td(F.col("longest")).alias("td_grade"), C.grade_pd(F.col("climb"), F.col("length")).alias("pd_grade"), F.round(C.quality_gpx(), 5).alias("quality"))
    legs = C.legs(_c(s, d)).join(of_course, "course_id").join(R.surroundings(_c(s, d), _k(s, d)), ["lng", "lat"])
    return legs.select(
        "course_id", "ord", "rn", "n", "td_grade", "pd_grade", F.round("position_ratio", 6).alias("position_ratio"), F.round("leg_in", 1).alias("leg_metres"), F.round("turn", 1).alias("bearing_change"),
        "density", "feature_type", "attractiveness", "path_metres", "quality",
    )


@query("M08_control_features", _FEATURES + " SELECT * EXCLUDE (rn, n) FROM ft")
def m08(s, d):
    return _features(s, d).drop("rn", "n")


_KINDS = "CASE course_id % 3 WHEN 0 THEN 'sprint' WHEN 1 THEN 'middle' ELSE 'long' END"
_AGES = "CASE course_id % 4 WHEN 0 THEN 'H21E' WHEN 1 THEN 'D35' WHEN 2 THEN 'Vert' ELSE NULL END"


@query("M01_feature_table", _FEATURES + f""" SELECT course_id, ord, leg_metres, bearing_change, position_ratio, td_grade, pd_grade, density, path_metres, attractiveness, CAST(CASE {_KINDS} WHEN 'sprint' THEN 0 WHEN 'middle' THEN 1 ELSE 2 END AS INT) AS circuit_code,
  CAST(course_id % 2 AS INT) AS map_code, CAST(CASE course_id % 4 WHEN 1 THEN 35 ELSE 21 END AS INT) AS age, CAST(CASE course_id % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS INT) AS sex_code, quality AS label FROM ft WHERE course_id % 5 <> 0""")  # fmt: skip
def m01(s, d):
    """Twelve features and the label, of the courses whose givers consent."""
    from ..functions import classes as K

    age, sex = K.age_and_sex(F.expr(_AGES))
    kind = F.expr(_KINDS)
    return _features(s, d).where("course_id % 5 <> 0").select(
        "course_id", "ord", "leg_metres", "bearing_change", "position_ratio", "td_grade", "pd_grade", "density", "path_metres", "attractiveness",
        first([(kind == "sprint", 0), (kind == "middle", 1)], 2).alias("circuit_code"), (F.col("course_id") % 2).cast("int").alias("map_code"), age.cast("int").alias("age"), sex.alias("sex_code"), F.col("quality").alias("label"),
    )


# Types to avoid and texts that describe no feature.
AVOID, VAGUE = ("mid_street", "open_area", "ambiguous"), ("Position libre", "terrain ouvert (4.1)", "terrain semi-ouvert (4.2)", "Terrain ouvert (4.1)", "Terrain semi-ouvert (4.2)")
NAMES = {"intersection": "jonction de chemins (10.2)", "building_corner": "coin de bâtiment (5.11)", "steps": "escalier (5.20)"}
_DESCRIBED = f"""{_PLACES}, m3 AS (SELECT pl.lng, pl.lat, min((round({geo.hav_sql('pl.lng', 'pl.lat', 'k.lng', 'k.lat')}, 3), cand_id, ftype))[3] AS kind FROM pl JOIN candidates k ON abs(pl.lng - k.lng) < 0.001 AND abs(pl.lat - k.lat) < 0.001
    WHERE {geo.hav_sql('pl.lng', 'pl.lat', 'k.lng', 'k.lat')} <= 25 GROUP BY ALL),
  ds AS (SELECT lng, lat, coalesce(kind, 'open_area') AS ftype, CASE WHEN kind IS NULL THEN 'Position libre' ELSE CASE kind {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items())} ELSE 'ISOM ' || kind END END AS description FROM pl LEFT JOIN m3 USING (lng, lat))"""  # fmt: skip


def _described(s, d):
    """Per place the type of the nearest candidate within 25 m and the text that describes it."""
    here = _c(s, d).select("lng", "lat").distinct()
    near = S.radius_pairs(here, R.spots(_k(s, d)), 25).groupBy("lng", "lat").agg(F.min(F.struct(F.round("metres", 3), "one.cand_id", "one.ftype")).alias("z")).select("lng", "lat", F.col("z.ftype").alias("kind"))
    text = F.when(F.col("kind").isNull(), "Position libre").otherwise(R.looked_up(NAMES, F.col("kind"), F.concat(F.lit("ISOM "), F.col("kind"))))
    return here.join(near, ["lng", "lat"], "left").select("lng", "lat", F.coalesce("kind", F.lit("open_area")).alias("ftype"), text.alias("description"))


@query("F31_descriptions", _CC + _DESCRIBED + " SELECT course_id, ord, description FROM controls JOIN ds USING (lng, lat)")
def f31(s, d):
    return _c(s, d).join(_described(s, d), ["lng", "lat"]).select("course_id", "ord", "description")


_MORE_RULES = f"""{_DESCRIBED}, ty AS (SELECT controls.*, ftype, description, row_number() OVER o AS rn, count(*) OVER (PARTITION BY course_id) AS n FROM controls JOIN ds USING (lng, lat) WINDOW o AS (PARTITION BY course_id ORDER BY ord)),
  mr AS (SELECT course_id, 'C10' AS code, 'WARNING' AS severity, ord FROM ty WHERE ftype IN {AVOID} UNION ALL SELECT course_id, 'C13', 'WARNING', ord FROM ty WHERE rn > 1 AND rn < n AND (description IN {VAGUE} OR starts_with(description, 'ISOM ')))"""  # fmt: skip


def _more_rules(s, d):
    """C10 (a type to avoid) and C13 (nothing that can be described; starts and finishes are exempt)."""
    t = _c(s, d).join(_described(s, d), ["lng", "lat"]).withColumns({"rn": F.row_number().over(C.by_order()), "n": F.count("*").over(C.whole())})
    vague = (F.col("rn") > 1) & (F.col("rn") < F.col("n")) & (F.col("description").isin(*VAGUE) | F.col("description").startswith("ISOM "))
    rule = lambda when, code: F.when(when, F.struct(F.lit(code).alias("code"), F.lit("WARNING").alias("severity"), F.col("ord")))
    return t.select("course_id", F.explode(F.array_compact(F.array(rule(F.col("ftype").isin(*AVOID), "C10"), rule(vague, "C13")))).alias("i")).select("course_id", "i.*")


@query("P27_feature_rules", _CC + _MORE_RULES + " SELECT * FROM mr")
def p27(s, d):
    return _more_rules(s, d)


#: Types that a better place has. The box that suggestions stay in, and how far they are looked for.
GOOD, INSIDE, REACH = ("building_corner", "path_junction", "fence_corner", "opening_in_fence", "statue", "pillar", "road_junction"), (5.48, 49.18, 5.5, 49.19), 300
_AT45 = 45.0 / 6371000.0


@query("Y01_J30_corrections", _LC + _MORE_RULES + f""", fx AS (SELECT course_id, 'C01' AS code, 0 AS sev, ord FROM legs WHERE back < 20 UNION ALL SELECT course_id, 'C02', 0, ord FROM legs WHERE leg_in < 30 UNION ALL SELECT course_id, code, 1, ord FROM mr WHERE code = 'C10'),
  pick AS (SELECT course_id, ord, arg_min(code, (sev, code)) AS code FROM fx GROUP BY ALL), fixes AS (SELECT pick.*, lng, lat, b, nx, ny, px, py FROM pick JOIN (SELECT *, {geo.bearing_sql('px', 'py', 'nx', 'ny')} AS b FROM legs) USING (course_id, ord)),
  sides AS (SELECT *, lng + degrees({_AT45}::DOUBLE / cos(radians(lat))) * sin(radians((b + 90) % 360)) AS x1, lat + degrees({_AT45}::DOUBLE) * cos(radians((b + 90) % 360)) AS y1,
    lng + degrees({_AT45}::DOUBLE / cos(radians(lat))) * sin(radians((b + 270) % 360)) AS x2, lat + degrees({_AT45}::DOUBLE) * cos(radians((b + 270) % 360)) AS y2 FROM fixes WHERE code = 'C01' AND nx IS NOT NULL AND px IS NOT NULL),
  moved AS (SELECT course_id, ord, code, CASE WHEN ok1 THEN x1 ELSE x2 END AS lng, CASE WHEN ok1 THEN y1 ELSE y2 END AS lat FROM (SELECT *, x1 BETWEEN {INSIDE[0]} AND {INSIDE[2]} AND y1 BETWEEN {INSIDE[1]} AND {INSIDE[3]} AS ok1, x2 BETWEEN {INSIDE[0]} AND {INSIDE[2]} AND y2 BETWEEN {INSIDE[1]} AND {INSIDE[3]} AS ok2 FROM sides) WHERE ok1 OR ok2),
  good AS (SELECT *, ftype IN {GOOD} AS good FROM candidates WHERE lng BETWEEN {INSIDE[0]} AND {INSIDE[2]} AND lat BETWEEN {INSIDE[1]} AND {INSIDE[3]}),
  opt AS (SELECT a.course_id, a.ord, a.code, k.cand_id, k.lng, k.lat, round({geo.hav_sql('a.lng', 'a.lat', 'k.lng', 'k.lat')}, 3) AS m FROM fixes a JOIN good k ON abs(a.lng - k.lng) < 0.006 AND abs(a.lat - k.lat) < 0.004 WHERE a.code IN ('C02', 'C10') AND (a.code = 'C02' OR k.good) AND {geo.hav_sql('a.lng', 'a.lat', 'k.lng', 'k.lat')} <= {REACH}),
  best AS (SELECT course_id, ord, code, min((m, cand_id, lng, lat)) AS z FROM opt o WHERE NOT EXISTS (SELECT 1 FROM controls c WHERE c.course_id = o.course_id AND c.ord <> o.ord AND {geo.hav_sql('o.lng', 'o.lat', 'c.lng', 'c.lat')} < CASE WHEN o.code = 'C02' THEN 35 ELSE 20 END) GROUP BY ALL)
  SELECT course_id, ord, code, round(lng, 7) AS lng, round(lat, 7) AS lat FROM moved UNION ALL SELECT course_id, ord, code, round(z[3], 7), round(z[4], 7) FROM best""")  # fmt: skip
def y01(s, d):
    """One suggestion a control, errors first: a dog-leg moves 45 m across the way from the control before to the one after (to the
    right, or to the left if that leaves the box); others go to the nearest candidate in the box and reach that keeps its
    distance from the course's other controls, C10 to one of a good type."""
    rank = F.when(F.col("severity") == "ERROR", 0).otherwise(1)
    found = C.issues(_c(s, d)).where("code IN ('C01', 'C02')").unionByName(_more_rules(s, d).where("code = 'C10'"))
    pick = found.groupBy("course_id", "ord").agg(F.min(F.struct(rank.alias("r"), "code")).alias("z")).select("course_id", "ord", F.col("z.code").alias("code"))
    w = C.by_order()
    ends = _c(s, d).withColumns({"px": F.lag("lng").over(w), "py": F.lag("lat").over(w), "nx": F.lead("lng").over(w), "ny": F.lead("lat").over(w)})
    at = cut(ends.drop("ele").join(pick, ["course_id", "ord"]))
    across = geo.bearing(*map(F.col, ("px", "py", "nx", "ny")))

    def side(turn: int):
        h = F.radians(F.pmod(across + turn, F.lit(360.0)))
        x, y = F.col("lng") + F.degrees(_AT45 / F.cos(F.radians("lat"))) * F.sin(h), F.col("lat") + F.degrees(F.lit(_AT45)) * F.cos(h)
        return F.when(x.between(INSIDE[0], INSIDE[2]) & y.between(INSIDE[1], INSIDE[3]), F.struct(x.alias("x"), y.alias("y")))

    moved = at.where("code = 'C01' AND px IS NOT NULL AND nx IS NOT NULL").select("course_id", "ord", "code", F.coalesce(side(90), side(270)).alias("p")).where("p IS NOT NULL")
    inside = _k(s, d).where(F.col("lng").between(INSIDE[0], INSIDE[2]) & F.col("lat").between(INSIDE[1], INSIDE[3])).withColumn("good", F.col("ftype").isin(*GOOD)).drop("ftype")
    fixes = at.where("code IN ('C02', 'C10')").select("course_id", "ord", "code", "lng", "lat")
    # places meet once each: the options of a place, ranked, and how many of a course's controls are near a candidate's place
    spots = cut(inside.groupBy("lng", "lat").agg(F.min("cand_id").alias("any"), F.min(F.when(F.col("good"), F.col("cand_id"))).alias("fit")))
    kinds = F.array(F.struct(F.lit("C02").alias("code"), F.col("any").alias("cand_id"), F.lit(35).alias("least")), F.struct(F.lit("C10").alias("code"), F.col("fit").alias("cand_id"), F.lit(20).alias("least")))
    reach = S.radius_pairs(fixes.select("lng", "lat").distinct(), spots, REACH).withColumn("k", F.explode(kinds)).select("lng", "lat", "k.*", "metres", F.col("__x").alias("x"), F.col("__y").alias("y")).where("cand_id IS NOT NULL")
    reach = reach.withColumns({"own": (F.col("metres") < F.col("least")).cast("int"), "metres": F.round("metres", 3)})
    opts = cut(reach.withColumn("rank", F.row_number().over(Window.partitionBy("lng", "lat", "code").orderBy("metres", "cand_id", "x", "y"))))
    near = S.radius_pairs(_c(s, d).select("lng", "lat").distinct(), spots.select("lng", "lat"), 35).select("lng", "lat", F.col("__x").alias("x"), F.col("__y").alias("y"), "metres")
    taken = _c(s, d).select("course_id", "lng", "lat").join(near, ["lng", "lat"]).groupBy("course_id", "x", "y").agg(F.count_if(F.col("metres") < 35).alias("n35"), F.count_if(F.col("metres") < 20).alias("n20"))
    taken = cut(taken)
    count = F.coalesce(F.when(F.col("code") == "C02", F.col("n35")).otherwise(F.col("n20")), F.lit(0))
    rest, found = fixes, []
    for lo, hi in ((1, 1), (2, 4), (5, None)):  # most fixes end with their nearest option; the last step takes all that are left
        some = opts.where(F.col("rank") >= lo if hi is None else F.col("rank").between(lo, hi)).drop("least")
        free = rest.join(some, ["lng", "lat", "code"]).join(taken, ["course_id", "x", "y"], "left").where(count <= F.col("own"))
        found.append(cut(free.groupBy("course_id", "ord", "code").agg(F.min(F.struct("metres", "cand_id", "x", "y")).alias("p"))))
        if hi is not None:
            rest = cut(rest.join(found[-1], ["course_id", "ord"], "left_anti"))
    best = found[0].unionByName(found[1]).unionByName(found[2])
    r = [F.round("p.x", 7).alias("lng"), F.round("p.y", 7).alias("lat")]
    return moved.select("course_id", "ord", "code", *r).unionByName(best.select("course_id", "ord", "code", *r))
