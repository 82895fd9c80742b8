"""Classes of map features, names and layers; bands and scores of courses, legs and ground."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import classes as K
from ..functions import geo
from ..registry import query
from ..sources.derived import ctes, derived, raw

#: Map features with one or two tags, from parts.
_FEATURES = """SELECT p_partkey AS fid, CASE p_partkey % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS kind, CASE WHEN p_size % 2 = 0 THEN 'yes' ELSE 'no' END AS area,
  CASE p_partkey % 11 WHEN 0 THEN 'highway' WHEN 1 THEN 'building' WHEN 2 THEN 'landuse' WHEN 3 THEN 'natural' WHEN 4 THEN 'leisure' WHEN 5 THEN 'amenity' WHEN 6 THEN 'barrier' WHEN 7 THEN 'access' WHEN 8 THEN 'historic' WHEN 9 THEN 'man_made' ELSE 'tourism' END AS k,
  CASE p_size % 13 WHEN 0 THEN 'forest' WHEN 1 THEN 'park' WHEN 2 THEN 'water' WHEN 3 THEN 'private' WHEN 4 THEN 'fountain' WHEN 5 THEN 'steps' WHEN 6 THEN 'primary' WHEN 7 THEN 'ruins' WHEN 8 THEN 'tower' WHEN 9 THEN 'artwork' WHEN 10 THEN 'bench' WHEN 11 THEN 'memorial' ELSE 'flagpole' END AS v FROM {part}"""
_F = f"WITH f AS ({_FEATURES.format(part='part')})"
_CATEGORY = """CASE k WHEN 'highway' THEN 'roads' WHEN 'building' THEN 'buildings' WHEN 'landuse' THEN if(v IN ('forest', 'grass', 'meadow', 'farmland', 'orchard'), 'green_areas', 'landuse')
  WHEN 'natural' THEN CASE WHEN v IN ('water', 'river', 'lake', 'pond') THEN 'water' WHEN v IN ('forest', 'grass', 'wood') THEN 'green_areas' END WHEN 'leisure' THEN if(v IN ('park', 'garden'), 'green_areas', NULL)
  WHEN 'amenity' THEN 'amenities' WHEN 'barrier' THEN 'barriers' WHEN 'access' THEN if(v IN ('private', 'military', 'no'), 'restricted', NULL) END"""


def _features(s, d):
    f = s.sql(_FEATURES.format(part="{t}"), t=raw(s, d, "part"))
    return f.select("fid", "kind", F.create_map("k", "v", F.lit("area"), "area").alias("tags"))


@query("P08_P09_osm_features", _F + f" SELECT fid, {_CATEGORY} AS category, CASE kind WHEN 'node' THEN 'Point' WHEN 'way' THEN if(area = 'yes', 'Polygon', 'LineString') END AS geometry FROM f")
def p08(s, d):
    t = F.col("tags")
    return _features(s, d).select("fid", K.osm_category(t).alias("category"), K.osm_geometry(F.col("kind"), t).alias("geometry"))


@query("P10_point_symbols", _F + """ SELECT fid, CAST(CASE k || '=' || v WHEN 'historic=memorial' THEN 526 WHEN 'historic=ruins' THEN 523 WHEN 'man_made=tower' THEN 522 WHEN 'man_made=flagpole' THEN 526 WHEN 'tourism=artwork' THEN 526
  WHEN 'amenity=bench' THEN 531 WHEN 'highway=steps' THEN 524 ELSE 530 END AS INT) AS symbol FROM f WHERE kind = 'node'""")  # fmt: skip
def p10(s, d):
    return _features(s, d).where("kind = 'node'").select("fid", K.osm_symbol(F.col("tags")).alias("symbol"))


@query("P23_safety_zones", _F + " SELECT fid, CAST(if(k = 'highway', 50, 5) AS INT) AS metres FROM f WHERE (k = 'highway' AND v = 'primary') OR (k = 'access' AND v = 'private')")
def p23(s, d):
    return _features(s, d).select("fid", K.safety_metres(F.col("tags")).alias("metres")).where("metres IS NOT NULL")


@query("A24_layer_counts", _F + f", c AS (SELECT {_CATEGORY} AS c FROM f) SELECT c AS category, count(*) AS n FROM c WHERE c IS NOT NULL GROUP BY c")
def a24(s, d):
    return _features(s, d).select(K.osm_category(F.col("tags")).alias("category")).where("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"))


_TERRAIN = "CASE " + " ".join(f"WHEN isom BETWEEN {a} AND {b} THEN '{c}'" for a, b, c in K.TERRAIN) + " END"


@query("P12_terrain_classes", ctes("areas") + f" SELECT area_id, {_TERRAIN} AS terrain FROM areas")
def p12(s, d):
    """Every second area has its symbol in the long form."""
    a = derived(s, d, "areas").withColumn("symbol", F.when(F.col("area_id") % 2 == 0, F.col("isom") * 1000).otherwise(F.col("isom")))
    return a.select("area_id", K.terrain(F.col("symbol")).alias("terrain"))


@query("A31_terrain_mix", ctes("areas") + f""", c AS (SELECT area_id % 20 AS map_id, {_TERRAIN} AS c FROM areas), n AS (SELECT map_id, c, count(*) AS n FROM c WHERE c IS NOT NULL GROUP BY ALL),
  p AS (SELECT map_id, c, n, n / sum(n) OVER (PARTITION BY map_id) AS p FROM n)
  SELECT map_id, round(-sum(p * log2(p)) / log2({len(K.TERRAIN)}), 6) + 0.0 AS entropy, max(({{'n': n, 'c': c}})).c AS dominant FROM p GROUP BY map_id""")  # fmt: skip
def a31(s, d):
    """Normalised entropy of the terrain classes of each map, and the most frequent; of equals the last by name."""
    n = p12(s, d).where("terrain IS NOT NULL").groupBy((F.col("area_id") % 20).alias("map_id"), "terrain").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("map_id")))
    entropy = -F.sum(F.col("p") * F.log2("p")) / F.log2(F.lit(float(len(K.TERRAIN))))
    return p.groupBy("map_id").agg((F.round(entropy, 6) + 0.0).alias("entropy"), F.max(F.struct("n", "terrain"))["terrain"].alias("dominant"))


_PLACES = "SELECT c_custkey AS place_id, CAST(-20 + (c_custkey % 520) * 0.1 AS DOUBLE) AS lng, CAST(27 + (c_custkey * 7 % 445) * 0.1 AS DOUBLE) AS lat FROM {customer}"


@query("P15_countries", f"WITH p AS ({_PLACES.format(customer='customer')}) SELECT place_id, CASE " + " ".join(f"WHEN lat >= {a} AND lat <= {b} AND lng >= {x} AND lng <= {y} THEN '{c}'" for c, a, b, x, y in K.COUNTRIES) + " END AS country FROM p")
def p15(s, d):
    return s.sql(_PLACES.format(customer="{t}"), t=raw(s, d, "customer")).select("place_id", K.country(F.col("lng"), F.col("lat")).alias("country"))


#: Names of courses with an age class, a colour, both or neither.
_NAMES = """SELECT c_custkey AS course_id, concat('Course ', CASE c_custkey % 6 WHEN 0 THEN 'H' WHEN 1 THEN 'd' WHEN 2 THEN 'W' WHEN 3 THEN 'M' WHEN 4 THEN 'X' ELSE '' END, CAST(10 + c_custkey % 12 * 5 AS VARCHAR(9)), CASE c_custkey % 4 WHEN 0 THEN 'E' WHEN 1 THEN 'b' ELSE '' END,
  CASE c_custkey % 5 WHEN 0 THEN ' Bleu' WHEN 1 THEN ' orange 4.5km' WHEN 2 THEN ' sprint' WHEN 3 THEN ' City' ELSE '' END) AS name, CAST(c_custkey * 37 % 9000 AS DOUBLE) AS metres FROM {customer}"""
_N = f"WITH n AS ({_NAMES.format(customer='customer')})"


def _names(s, d):
    return s.sql(_NAMES.format(customer="{t}"), t=raw(s, d, "customer"))


_CLASS = "nullif(upper(regexp_extract(name, '(?i)\\b[HDWM](10|12|14|16|18|20|21|35|40|45|50|55|60|65|70|75|80)[EAB]?\\b')), '')"
_COLOUR = f"nullif(lower(regexp_extract(name, '(?i)\\b({'|'.join(K.COLOURS)})\\b')), '')"


@query("P07_name_classes", _N + f" SELECT course_id, {_COLOUR} AS colour, coalesce({_CLASS}, upper(left({_COLOUR}, 1)) || substr({_COLOUR}, 2)) AS category FROM n")
def p07(s, d):
    return _names(s, d).select("course_id", K.colour_of(F.col("name")).alias("colour"), K.category_of(F.col("name")).alias("category"))


@query("P16_age_codes", _N + f""", c AS (SELECT course_id, coalesce({_CLASS}, upper({_COLOUR}), '') AS c FROM n)
  SELECT course_id, CAST(if(regexp_matches(c, '[0-9]'), regexp_extract(c, '[0-9]+'), '21') AS INT) AS age, CAST(CASE WHEN c IN ({', '.join(f"'{x.upper()}'" for x in K.COLOURS)}) THEN 2 WHEN c[1] IN ('D', 'W') THEN 1 ELSE 0 END AS INT) AS sex FROM c""")  # fmt: skip
def p16(s, d):
    age, sex = K.age_and_sex(K.category_of(F.col("name")))
    return _names(s, d).select("course_id", age.alias("age"), sex.alias("sex"))


@query("P04_P05_sprints", _N + " SELECT course_id, regexp_matches(lower(name), 'sprint|city|urban|natt') AS event, regexp_matches(lower(name), 'sp|city|urban|natt|night') OR (metres > 0 AND metres <= 5000) AS course FROM n")
def p04(s, d):
    return _names(s, d).select("course_id", K.is_sprint_event(F.col("name")).alias("event"), K.is_sprint_course(F.col("name"), F.col("metres")).alias("course"))


@query("P14_layer_flags", "WITH b AS (SELECT page_id, lower(list_last(string_split(coalesce(url, ''), '/'))) AS b FROM pages) SELECT page_id, " + ", ".join(f"regexp_matches(b, '{p}') AS {k}" for k, p in K.LAYERS.items()) + " FROM b")
def p14(s, d):
    """The last part of each page's address stands for a layer's file name."""
    return raw(s, d, "pages").select("page_id", *[c.alias(k) for k, c in K.layer_flags(F.col("url")).items()])


#: Cells of ground, from parts.
_GROUND = """SELECT p_partkey AS cell_id, p_partkey % 20 AS map_id, CAST((p_partkey * 13 % 420) / 10.0 AS DOUBLE) AS slope, CAST(p_size / 4.0 AS DOUBLE) AS height, p_partkey % 3 = 0 AS on_path, p_size % 4 <> 0 AS is_open FROM {part}"""
_SLOPE = "CASE WHEN slope < 5 THEN 1.0 WHEN slope < 10 THEN 0.9 WHEN slope < 15 THEN 0.8 WHEN slope < 20 THEN 0.7 WHEN slope < 25 THEN 0.6 WHEN slope < 30 THEN 0.5 ELSE 0.4 END::DOUBLE"
_HEIGHT = "CASE WHEN height < 0.5 THEN 1.0 WHEN height < 1 THEN 0.95 WHEN height < 2 THEN 0.85 WHEN height < 5 THEN 0.7 WHEN height < 10 THEN 0.5 ELSE 0.4 END::DOUBLE"
_G = f"""WITH g AS (SELECT *, {_SLOPE} * {_HEIGHT} AS base FROM ({_GROUND.format(part='part')})),
  r AS (SELECT *, base * if(on_path, 1.3, 1)::DOUBLE * if(is_open, 1, 0.8)::DOUBLE AS speed, least(1, base * if(on_path, 1.2, 1)::DOUBLE * if(is_open, 1.1, 1)::DOUBLE) AS score FROM g)"""


def _ground(s, d):
    g = [F.col(c) for c in ("slope", "height", "on_path", "is_open")]
    return s.sql(_GROUND.format(part="{t}"), t=raw(s, d, "part")).withColumns({"speed": K.speed_factor(*g), "score": K.runnability(*g)})


@query("F13_F14_ground_speed", _G + " SELECT cell_id, round(speed, 4) AS speed, round(score, 4) AS score FROM r")
def f13(s, d):
    return _ground(s, d).select("cell_id", F.round("speed", 4).alias("speed"), F.round("score", 4).alias("score"))


@query("A25_A43_ground_stats", _G + """ SELECT map_id, round(avg(score), 4) AS score, round(avg(score) * 300, 2) AS metres_per_min, round(100 * count(*) FILTER (score > 0.7) / count(*), 2) AS fast_percent, count(*) FILTER (score < 0.1) AS obstacles,
  count(*) FILTER (height > 2) AS grown, count(*) FILTER (slope > 15) AS steep FROM r GROUP BY map_id""")  # fmt: skip
def a25(s, d):
    """Per map: mean score and speed, share of fast cells, and cells that are obstacles, overgrown or steep."""
    n = F.count_if
    return _ground(s, d).groupBy("map_id").agg(F.round(F.avg("score"), 4).alias("score"), F.round(F.avg("score") * 300, 2).alias("metres_per_min"), F.round(100 * n(F.col("score") > 0.7) / F.count("*"), 2).alias("fast_percent"), n(F.col("score") < 0.1).alias("obstacles"), n(F.col("height") > 2).alias("grown"), n(F.col("slope") > 15).alias("steep"))


@query("A44_score_bands", _G + """, b AS (SELECT *, CASE WHEN cell_id % 7 = 0 THEN 'off-map' WHEN score >= 0.65 THEN 'high' WHEN score >= 0.45 THEN 'middle' ELSE 'low' END AS band, if(cell_id % 7 = 0, NULL, score) AS seen FROM r)
  SELECT band, count(*) AS n, count(seen) AS scored, round(avg(seen), 4) AS mean, round(min(seen), 4) AS least, round(max(seen), 4) AS most FROM b GROUP BY band""")  # fmt: skip
def a44(s, d):
    """Cells by band of score; those off the map have none."""
    g = _ground(s, d).withColumn("seen", F.when(F.col("cell_id") % 7 != 0, F.col("score")))
    band = K.first([(F.col("seen").isNull(), "off-map"), (F.col("seen") >= 0.65, "high"), (F.col("seen") >= 0.45, "middle")], "low")
    return g.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.count("seen").alias("scored"), *[F.round(f("seen"), 4).alias(k) for k, f in (("mean", F.avg), ("least", F.min), ("most", F.max))])


_LEGS = ctes("controls") + f""", p AS (SELECT *, lag(lng) OVER o AS px, lag(lat) OVER o AS py, lag(ele) OVER o AS pe FROM controls WINDOW o AS (PARTITION BY course_id ORDER BY ord)),
  l AS (SELECT course_id, ord, {geo.hav_sql('px', 'py', 'lng', 'lat')} AS metres, ele - pe AS rise FROM p WHERE px IS NOT NULL)"""


def _legs(s, d):
    w = Window.partitionBy("course_id").orderBy("ord")
    m = geo.haversine(F.lag("lng").over(w), F.lag("lat").over(w), F.col("lng"), F.col("lat"))
    return derived(s, d, "controls").select("course_id", "ord", m.alias("metres"), (F.col("ele") - F.lag("ele").over(w)).alias("rise")).where("metres IS NOT NULL")


def _points(r: str, bands: tuple, otherwise: int) -> str:
    return "CAST(CASE " + " ".join(f"WHEN {r} BETWEEN {1 - b} AND {1 + b} THEN {p}" for b, p in bands) + f" ELSE {otherwise} END AS INT)"


@query("F21_F34_target_scores", _LEGS + f""", c AS (SELECT course_id, sum(metres) / 4000 AS r, sum(greatest(rise, 0)) / 120 AS q FROM l GROUP BY course_id), t AS (SELECT course_id, {_points('r', K.LENGTH_BANDS, 50)} AS length_score, {_points('q', K.CLIMB_BANDS, 55)} AS climb_score FROM c)
  SELECT *, CASE WHEN length_score + climb_score >= 180 THEN 'A' WHEN length_score + climb_score >= 160 THEN 'B' WHEN length_score + climb_score >= 140 THEN 'C' WHEN length_score + climb_score >= 120 THEN 'D' ELSE 'F' END AS grade, if(length_score >= 90, 'length', '') AS strengths FROM t""")  # fmt: skip
def f21(s, d):
    """Points for a length near 4 km and a climb near 120 m, the grade of their mean, and strengths by name."""
    c = _legs(s, d).groupBy("course_id").agg(F.sum("metres").alias("m"), F.sum(F.greatest("rise", F.lit(0.0))).alias("up"))
    t = c.select("course_id", K.target_score(F.col("m"), F.lit(4000.0), K.LENGTH_BANDS, 50).alias("length_score"), K.target_score(F.col("up"), F.lit(120.0), K.CLIMB_BANDS, 55).alias("climb_score"))
    strong = F.array_join(F.array_compact(F.array(F.when(F.col("length_score") >= 90, "length"))), ",")
    return t.select("*", K.letter((F.col("length_score") + F.col("climb_score")) / 2).alias("grade"), strong.alias("strengths"))


@query("F36_W22_leg_choices", _LEGS + """, q AS (SELECT course_id, ord, metres, ord % 3 = 0 AS p, 1 + (ord % 5) / 10.0::DOUBLE AS f, course_id % 2 = 0 AS easy FROM l),
  v AS (SELECT course_id, ord, CASE WHEN metres = 0 THEN 'poor' WHEN f < 1.1 AND p THEN 'excellent' WHEN f < 1.3 THEN 'good' ELSE 'fair' END AS quality, CAST(1 + if(metres > 200, 1, 0) + if(p, 1, 0) + if(easy, 1, 0) AS INT) AS choices FROM q)
  SELECT *, CASE WHEN quality = 'excellent' AND choices <= 2 THEN 'easy' WHEN quality = 'good' AND choices <= 3 THEN 'medium' ELSE 'hard' END AS navigation FROM v""")  # fmt: skip
def f36(s, d):
    """Quality, choices and difficulty of each leg; detours, paths and ground are derived from the order and the course."""
    path = F.col("ord") % 3 == 0
    ground = F.when(F.col("course_id") % 2 == 0, "light_forest").otherwise("marsh")
    factor = F.when(F.col("metres") > 0, 1 + (F.col("ord") % 5) / F.lit(10.0))
    v = _legs(s, d).select("course_id", "ord", K.route_quality(F.when(F.col("metres") > 0, F.lit(1.0)), factor, path).alias("quality"), K.route_choices(F.col("metres"), path, ground).alias("choices"))
    return v.withColumn("navigation", K.navigation(F.col("quality"), F.col("choices")))


@query("T09_fittest_courses", _LEGS + ", c AS (SELECT course_id % 10 AS event, course_id, round(-abs(sum(metres) - 4000), 2) AS fitness FROM l GROUP BY course_id) SELECT event, course_id, fitness FROM c QUALIFY row_number() OVER (PARTITION BY event ORDER BY fitness DESC, course_id) <= 10")
def t09(s, d):
    """The ten courses of each event nearest to 4 km: the limit is the report's."""
    c = _legs(s, d).groupBy("course_id").agg(F.round(-F.abs(F.sum("metres") - 4000), 2).alias("fitness")).withColumn("event", F.col("course_id") % 10)
    w = Window.partitionBy("event").orderBy(F.desc("fitness"), "course_id")
    return c.withColumn("place", F.row_number().over(w)).where("place <= 10").select("event", "course_id", "fitness")


@query("F23_iso_times", "SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS epoch FROM events WHERE event_id % 13 <> 0")
def f23(s, d):
    """Seconds of ISO texts: the first 19 characters, in UTC; what is no time has none and goes."""
    text = F.when(F.col("event_id") % 13 == 0, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    parsed = F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return raw(s, d, "events").select("event_id", F.unix_timestamp(parsed).alias("epoch")).where("epoch IS NOT NULL")


@query("P28_recentred", ctes("areas") + """, v AS (SELECT area_id, area_id % 20 AS map_id, isom, unnest([min_lng, max_lng, max_lng, min_lng]) AS x, unnest([min_lat, min_lat, max_lat, max_lat]) AS y, unnest([1, 2, 3, 4]) AS k FROM areas),
  m AS (SELECT map_id, avg(x) AS cx, avg(y) AS cy FROM v GROUP BY map_id) SELECT map_id, area_id, k, isom AS sym, round((x - cx) * 111320 * cos(radians(cy)), 1) + 0.0 AS east, round((y - cy) * 111320, 1) + 0.0 AS north FROM v JOIN m USING (map_id)""")  # fmt: skip
def p28(s, d):
    """Corners of areas in metres about the centroid of their map, with the symbol alone. A map's centroid is aggregated
    before it meets the rows, so that no task holds a map."""
    names = (("min_lng", "min_lat"), ("max_lng", "min_lat"), ("max_lng", "max_lat"), ("min_lng", "max_lat"))
    corners = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("k"), F.col(x).alias("x"), F.col(y).alias("y")) for k, (x, y) in enumerate(names)]))
    v = derived(s, d, "areas").select((F.col("area_id") % 20).alias("map_id"), "area_id", "isom", corners.alias("p")).select("map_id", "area_id", F.col("isom").alias("sym"), "p.*")
    m = v.groupBy("map_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    east, north = (F.col("x") - F.col("cx")) * geo.METRES_PER_DEGREE * F.cos(F.radians("cy")), (F.col("y") - F.col("cy")) * geo.METRES_PER_DEGREE
    return v.join(m, "map_id").select("map_id", "area_id", "k", "sym", (F.round(east, 1) + 0.0).alias("east"), (F.round(north, 1) + 0.0).alias("north"))
