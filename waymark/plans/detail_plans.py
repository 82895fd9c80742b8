"""Queries of tracks on ground, texts for readers and models, and the texture of images, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import classes as K
from ..functions import geo
from ..functions.classes import first
from ..operators import spatial as S
from ..operators import tracks as T
from ..registry import query
from ..sources.derived import ctes, derived, raw
from .class_plans import _G, _TERRAIN, _ground
from .map_plans import _edges_sql, _rings
from .pixel_plans import _P as _PIX
from .pixel_plans import _pixels
from .track_plans import _RUNS, _p, _snap, a01

_ENDS = ", lc AS (SELECT e.ord AS leg, CAST(round_even(p.lng / 0.0002, 0) AS BIGINT) AS gx, CAST(round_even(p.lat / 0.0002, 0) AS BIGINT) AS gy, e.track_id FROM ends e JOIN track_points p ON p.track_id = e.track_id AND p.seq >= i AND p.seq <= j)"


@query("A04_leg_cells", _RUNS + _ENDS + """, n AS (SELECT leg, gx, gy, count(*) AS n FROM lc GROUP BY ALL), t AS (SELECT leg, count(DISTINCT track_id) AS k FROM lc GROUP BY leg), h AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY leg ORDER BY n DESC, gx, gy) <= 50)
  SELECT CAST(leg AS INT) AS leg, gx, gy, n, round(n / k, 3) AS freq FROM h JOIN t USING (leg) WHERE n / k >= 0.1""")  # fmt: skip
def a04(s, d):
    """The 50 busiest cells of each leg, of which those stay that a tenth of its runners pass: the limit is the report's."""
    w = Window.partitionBy("track_id").orderBy("ord")
    ends = _snap(s, d).select("track_id", F.col("ord").alias("leg"), F.lag("seq").over(w).alias("i"), F.col("seq").alias("j")).where("i IS NOT NULL")
    on = T.cells(_p(s, d), 0.0002).join(ends, "track_id").where("seq >= i AND seq <= j")
    k = on.select("leg", "track_id").distinct().groupBy("leg").agg(F.count("*").alias("k"))
    busy = on.groupBy("leg", "gx", "gy").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(Window.partitionBy("leg").orderBy(F.desc("n"), "gx", "gy"))).where("place <= 50")
    return busy.join(k, "leg").where(F.col("n") / F.col("k") >= 0.1).select("leg", "gx", "gy", "n", F.round(F.col("n") / F.col("k"), 3).alias("freq"))


_SPEEDS = ctes("track_points", "areas") + f""", l AS (SELECT *, lead(lng) OVER o AS nx, lead(lat) OVER o AS ny, lead(t_s) OVER o AS nt FROM track_points WINDOW o AS (PARTITION BY track_id ORDER BY seq)),
  v0 AS (SELECT lng AS x, lat AS y, {geo.hav_sql('lng', 'lat', 'nx', 'ny')} AS m, {geo.hav_sql('lng', 'lat', 'nx', 'ny')} / (nt - t_s) * 60 AS speed FROM l WHERE nt > t_s), v AS (SELECT * FROM v0 WHERE m >= 5 AND speed BETWEEN 50 AND 400),
  pl AS (SELECT DISTINCT x, y FROM v), ar AS (SELECT x, y, min((area_id, {_TERRAIN}))[2] AS kind FROM pl JOIN areas ON x BETWEEN min_lng AND max_lng AND y BETWEEN min_lat AND max_lat WHERE ({_edges_sql()}) % 2 = 1 GROUP BY ALL)"""


@query("A06_terrain_calibration", _SPEEDS + """, r AS (SELECT kind, speed, row_number() OVER (PARTITION BY kind ORDER BY speed) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n FROM v JOIN ar USING (x, y) WHERE kind IS NOT NULL) SELECT kind, n, round(speed / 170, 3) AS multiplier FROM r WHERE n >= 5 AND i = n // 2""")
def a06(s, d):
    """Per kind of ground with five samples or more, the upper median of speeds there over 170 metres a minute. Speeds are counted
    in steps of a tenth first; only those of the step with the median are put in order."""
    w = Window.partitionBy("track_id").orderBy("seq")
    nx, ny, nt = (F.lead(c).over(w) for c in ("lng", "lat", "t_s"))
    steps = _p(s, d).withColumns({"metres": geo.haversine(F.col("lng"), F.col("lat"), nx, ny), "seconds": nt - F.col("t_s")}).withColumn("speed", T.valid_speed()).where("speed IS NOT NULL")
    kinds = S.inside(steps.select("lng", "lat").distinct(), _rings(s, d)).groupBy("lng", "lat").agg(F.min(F.struct("area_id", "isom")).alias("z")).select("lng", "lat", K.terrain(F.col("z.isom")).alias("kind"))
    v = steps.join(kinds, ["lng", "lat"]).where("kind IS NOT NULL").select("kind", "speed", F.floor(F.col("speed") * 10).alias("step"))
    counts = v.groupBy("kind", "step").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("kind").orderBy("step")
    placed = counts.withColumns({"upto": F.sum("c").over(upto), "n": F.sum("c").over(Window.partitionBy("kind"))}).where("n >= 5").withColumn("at", F.expr("n div 2"))
    hit = placed.where("upto > at AND upto - c <= at").select("kind", "step", "n", (F.col("at") - F.col("upto") + F.col("c")).alias("skip"))
    rank = F.row_number().over(Window.partitionBy("kind", "step").orderBy("speed")) - 1
    return v.join(hit, ["kind", "step"]).withColumn("i", rank).where("i = skip").select("kind", "n", F.round(F.col("speed") / 170, 3).alias("multiplier"))


_FAR, _TURN = geo.hav_sql("a.x", "a.y", "e.x", "e.y"), geo.between_sql(geo.bearing_sql("a.x", "a.y", "e.x", "e.y"), geo.bearing_sql("e.x", "e.y", "e.nx", "e.ny"))


@query("W15_key_points", ctes("track_points") + f""", l AS (SELECT *, lead(lng) OVER o AS nx, lead(lat) OVER o AS ny, count(*) OVER (PARTITION BY track_id) AS n FROM track_points WINDOW o AS (PARTITION BY track_id ORDER BY seq)),
  g AS (SELECT track_id, max(n) AS n, list({{'x': lng, 'y': lat, 'nx': nx, 'ny': ny, 'seq': seq, 'out': [seq]}} ORDER BY seq) AS p FROM l GROUP BY track_id),
  f AS (SELECT track_id, n, list_reduce(p[2:n - 1], lambda a, e: CASE WHEN len(a.out) >= 15 OR {_FAR} < 80 OR {_TURN} <= 25 THEN a ELSE {{'x': e.x, 'y': e.y, 'nx': e.nx, 'ny': e.ny, 'seq': e.seq, 'out': list_append(a.out, e.seq)}} END, p[1]).out AS out FROM g WHERE n > 15)
  SELECT track_id, CAST(unnest(list_append(out, n)) AS INT) AS seq FROM f UNION ALL SELECT track_id, CAST(seq AS INT) FROM l WHERE n <= 15""")  # fmt: skip
def w15(s, d):
    """Up to 15 points where a track turns, 80 m apart at least, and its last one; short tracks stay whole."""
    return T.key_points(_p(s, d)).select("track_id", "seq")


@query("F33_training_examples", _RUNS + """, v AS (SELECT leg, metres / seconds * 60 AS v FROM runs WHERE seconds > 0 AND metres >= 10), g AS (SELECT leg, round(avg(v), 1) AS mean, round(median(v), 1) AS median, round(stddev_pop(v) / avg(v), 3) AS cv FROM v WHERE v BETWEEN 50 AND 4000 GROUP BY leg), t AS (SELECT count(DISTINCT track_id) AS k FROM runs)
  (SELECT 'hardest' AS kind, printf('Leg %d of a course run by %d: what does a spread of %.2f mean?', leg, k, cv) AS question, printf('%s: mean %.0f m/min, median %.0f m/min.', CASE WHEN cv > 0.3 THEN 'difficult' ELSE 'middling' END, mean, median) AS answer FROM g, t WHERE cv > 0.15 ORDER BY cv DESC, leg LIMIT 1)
  UNION ALL (SELECT 'fastest', 'On which leg did runners go fastest?', printf('Leg %d: median %.0f m/min of %d runners.', leg, median, k) FROM g, t WHERE median > 100 ORDER BY median DESC, leg LIMIT 1)""")  # fmt: skip
def f33(s, d):
    """Questions and answers about the hardest and the fastest leg."""
    g = a01(s, d)
    k = T.leg_runs(_p(s, d), _snap(s, d)).agg(F.count_distinct("track_id").alias("k"))
    n = lambda f, *c: F.format_string(f, *c)
    hard = g.where("difficulty > 0.15").orderBy(F.desc("difficulty"), "leg").limit(1).crossJoin(k)
    fast = g.where("median > 100").orderBy(F.desc("median"), "leg").limit(1).crossJoin(k)
    level = F.when(F.col("difficulty") > 0.3, "difficult").otherwise("middling")
    one = hard.select(F.lit("hardest").alias("kind"), n("Leg %d of a course run by %d: what does a spread of %.2f mean?", "leg", "k", "difficulty").alias("question"), n("%s: mean %.0f m/min, median %.0f m/min.", level, F.col("mean"), F.col("median")).alias("answer"))
    return one.unionByName(fast.select(F.lit("fastest").alias("kind"), F.lit("On which leg did runners go fastest?").alias("question"), n("Leg %d: median %.0f m/min of %d runners.", "leg", "median", "k").alias("answer")))


@query("A44_top_positions", _G + " SELECT map_id, cell_id, round(score, 4) AS score FROM r WHERE cell_id % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY map_id ORDER BY round(score, 4) DESC, cell_id) <= 3")
def a44(s, d):
    """The three best positions of each map: the limit is the report's."""
    w = Window.partitionBy("map_id").orderBy(F.desc("score"), "cell_id")
    return _ground(s, d).where("cell_id % 7 <> 0").select("map_id", "cell_id", F.round("score", 4).alias("score")).withColumn("k", F.row_number().over(w)).where("k <= 3").drop("k")


# Words of file names, in order, and what they say of a document.
FILES = (
    ("Sprint_Course_Planning", "sprint", "IOF", 3), ("Forest_Course_Planning", "forest", "IOF", 2), ("complex_urban", "sprint", "IOF", 4), ("Course-planning-guidelines-Sprint", "sprint", "IOF", 3),
    ("Guidelines-for-Course-Planning_Sprint", "sprint", "IOF", 3), ("Appendix-A-Course-Planning", "all", "IOF", 1), ("TRACAGE PRINCIPES", "all", "FFCO", 1), ("TRACAGE ASPECTS PRATIQUES", "all", "FFCO", 1),
    ("Méthode Fédérale", "all", "FFCO", 1), ("circuits de couleur", "couleur", "FFCO", 1), ("RTS_CO", "all", "FFCO", 1), ("officials_handbook", "all", "IOF", 1), ("woc_manual", "all", "IOF", 4),
    ("PISTE_Swiss", "sprint", "IOF", 3), ("Mémento_du_Corps_Arbitral", "all", "FFCO", 1), ("règles_techniques", "all", "FFCO", 1),
)
_FILE = "concat(CASE doc_id % 5 WHEN 0 THEN '2024_' ELSE '' END, [" + ", ".join(f"'{f}'" for f, *_ in FILES) + f", 'notes'][doc_id % {len(FILES) + 1} + 1], '.pdf')"


@query("P25_file_metadata", f"WITH n AS (SELECT doc_id, lower({_FILE}) AS f FROM documents) SELECT doc_id, CASE {' '.join(f'''WHEN contains(f, '{w.lower()}') THEN '{t}' ''' for w, t, _, _ in FILES)} ELSE 'all' END AS circuit_type, CASE {' '.join(f'''WHEN contains(f, '{w.lower()}') THEN '{c}' ''' for w, _, c, _ in FILES)} ELSE 'IOF' END AS category, CAST(CASE {' '.join(f'''WHEN contains(f, '{w.lower()}') THEN {n}''' for w, _, _, n in FILES)} ELSE 1 END AS INT) AS td_min FROM n")
def p25(s, d):
    """What a document is about, by the first word that its file's name holds."""
    word = F.element_at(F.array(*[F.lit(f) for f, *_ in FILES], F.lit("notes")), (F.col("doc_id") % (len(FILES) + 1) + 1).cast("int"))
    name = F.lower(F.concat(F.when(F.col("doc_id") % 5 == 0, "2024_").otherwise(""), word, F.lit(".pdf")))
    says = lambda i, other: first([(F.contains(name, F.lit(f[0].lower())), f[i]) for f in FILES], other)
    return raw(s, d, "documents").select("doc_id", says(1, "all").alias("circuit_type"), says(2, "IOF").alias("category"), says(3, 1).alias("td_min"))


_VEC = "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.vec_id AS q, a.label AS want, b.vec_id AS id, b.label AS has, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a, v b WHERE a.vec_id % 50 = 0), t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, id) <= 15)"


@query("R08_rule_context", _VEC + """, o AS (SELECT *, has = want OR has = 0 AS fits FROM t WHERE score >= 0.18), k AS (SELECT *, row_number() OVER (PARTITION BY q, fits ORDER BY score DESC, id) AS a, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS b, bool_or(fits) OVER (PARTITION BY q) AS any_ FROM o),
  c AS (SELECT q, id, CASE WHEN any_ THEN a ELSE b END AS place FROM k WHERE CASE WHEN any_ THEN fits AND a <= 4 ELSE b <= 4 END), x AS (SELECT q, place, '- [' || coalesce(source, 'none') || '] ' || trim(replace(substr(text, 1, 350), chr(10), ' '), ' ') AS line FROM c JOIN documents ON doc_id = id + 1)
  SELECT q AS query_id, md5(string_agg(line, chr(10) ORDER BY place)) AS context, count(*) AS lines FROM x GROUP BY q""")  # fmt: skip
def r08(s, d):
    """Four passages for a question: of those fetched, the ones of its type or of all types, else any; each cut to 350 characters."""
    from ..operators import text as X

    v = raw(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")
    top = X.top_matches(v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")), v, 15).where("score >= 0.18")
    top = top.join(v.select("id", F.col("label").alias("has")), "id").join(v.select(F.col("id").alias("query_id"), F.col("label").alias("want")), "query_id")
    o = top.withColumn("fits", (F.col("has") == F.col("want")) | (F.col("has") == 0)).withColumn("some", F.max("fits").over(Window.partitionBy("query_id")))
    kept = o.where("fits OR NOT some").withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where("k <= 4")
    docs = raw(s, d, "documents").where("text IS NOT NULL").select((F.col("doc_id") - 1).alias("id"), F.concat(F.lit("- ["), F.coalesce("source", F.lit("none")), F.lit("] "), F.trim(F.replace(F.substring("text", 1, 350), F.lit("\n"), F.lit(" ")))).alias("line"))
    lines = kept.join(docs, "id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("z"))
    return lines.select("query_id", F.md5(F.array_join(F.transform("z", lambda x: x["line"]), "\n")).alias("context"), F.size("z").cast("long").alias("lines"))


@query("J34_conversation_context", """WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE text IS NOT NULL), m AS (SELECT conv_id, string_agg('[Source: ' || turn || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS said FROM c WHERE k <= 3 GROUP BY conv_id),
  p AS (SELECT l_orderkey AS course_id, l_linenumber AS n, l_quantity AS q FROM lineitem), x AS (SELECT course_id, 'leg ' || n || ' (' || CAST(q AS INT) || ')' AS t, n, row_number() OVER (PARTITION BY course_id ORDER BY q DESC, n, t) AS k FROM p WHERE q > 40), y AS (SELECT course_id, string_agg('- ' || t, chr(10) ORDER BY k) AS problems FROM x WHERE k <= 5 GROUP BY course_id)
  SELECT conv_id, md5(said || chr(10) || coalesce(problems, '')) AS context, length(said) AS characters FROM m LEFT JOIN y ON course_id = conv_id + 1""")  # fmt: skip
def j34(s, d):
    """The last three sources of a conversation and the five worst problems of its course in one text."""
    c = raw(s, d, "conversations").where("text IS NOT NULL")
    last = c.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("k <= 3")
    said = last.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("z")).select("conv_id", F.array_join(F.transform("z", lambda x: F.concat(F.lit("[Source: "), x["turn"].cast("string"), F.lit("]\n"), x["text"])), "\n\n---\n\n").alias("said"))
    p = raw(s, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("course_id"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), F.concat(F.lit("leg "), "l_linenumber", F.lit(" ("), F.col("l_quantity").cast("int"), F.lit(")")).alias("t"))
    worst = p.withColumn("k", F.row_number().over(Window.partitionBy("course_id").orderBy(F.desc("q"), "n", "t"))).where("k <= 5")
    y = worst.groupBy("course_id").agg(F.array_sort(F.collect_list(F.struct("k", "t"))).alias("z")).select("course_id", F.array_join(F.transform("z", lambda x: F.concat(F.lit("- "), x["t"])), "\n").alias("problems"))
    out = said.join(y, F.col("course_id") == F.col("conv_id") + 1, "left")
    return out.select("conv_id", F.md5(F.concat("said", F.lit("\n"), F.coalesce("problems", F.lit("")))).alias("context"), F.length("said").cast("long").alias("characters"))


_AROUND = ctes("controls", "areas") + f""", pl AS (SELECT DISTINCT lng, lat FROM controls), m AS (SELECT pl.lng, pl.lat, area_id, isom, {_TERRAIN} AS kind, round({geo.hav_sql('pl.lng', 'pl.lat', 'min_lng', 'min_lat')}, 3) AS m, min_lng - pl.lng AS dx, min_lat - pl.lat AS dy FROM pl JOIN areas ON abs(min_lng - pl.lng) < 0.003 AND abs(min_lat - pl.lat) < 0.002),
  n AS (SELECT lng, lat, min((m, area_id, kind, isom)) AS z, count(*) AS k, min((m, area_id, kind)) FILTER (isom % 7 = 0) AS b FROM m WHERE m <= 60 AND kind IS NOT NULL GROUP BY ALL)"""


@query("F32_terrain_texts", _AROUND + """, t AS (SELECT lng, lat, 'Nearest: ' || z[3] || ' at ' || CAST(z[1] AS INT) || ' m of ' || k || CASE WHEN b IS NULL THEN '' ELSE '. Blocked by ' || b[3] || ' at ' || CAST(b[1] AS INT) || ' m' END AS t FROM n),
  c AS (SELECT course_id, ord, coalesce(t, 'Nothing known nearby') AS t FROM controls LEFT JOIN t USING (lng, lat)) SELECT course_id, count(*) AS controls, md5(string_agg('Control ' || ord || ': ' || t, chr(10) ORDER BY ord)) AS text FROM c GROUP BY course_id""")  # fmt: skip
def f32(s, d):
    """What stands about each control within 60 m, in one text a course: places are described once each."""
    here = derived(s, d, "controls").select("lng", "lat").distinct()
    a = derived(s, d, "areas").select("area_id", "isom", F.col("min_lng").alias("lng"), F.col("min_lat").alias("lat")).withColumn("kind", K.terrain(F.col("isom"))).where("kind IS NOT NULL")
    m = S.radius_pairs(here, a, 60).withColumn("m", F.round("metres", 3))
    n = m.groupBy("lng", "lat").agg(F.min(F.struct("m", "area_id", "kind")).alias("z"), F.count("*").alias("k"), F.min(F.when(F.col("isom") % 7 == 0, F.struct("m", "area_id", "kind"))).alias("b"))
    whole = lambda c: F.bround(c, 0).cast("int").cast("string")
    blocked = F.when(F.col("b").isNull(), "").otherwise(F.concat(F.lit(". Blocked by "), "b.kind", F.lit(" at "), whole(F.col("b.m")), F.lit(" m")))
    t = n.select("lng", "lat", F.concat(F.lit("Nearest: "), "z.kind", F.lit(" at "), whole(F.col("z.m")), F.lit(" m of "), F.col("k").cast("string"), blocked).alias("t"))
    c = derived(s, d, "controls").join(t, ["lng", "lat"], "left").select("course_id", "ord", F.concat(F.lit("Control "), F.col("ord").cast("string"), F.lit(": "), F.coalesce("t", F.lit("Nothing known nearby"))).alias("line"))
    lines = c.groupBy("course_id").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("z"))
    return lines.select("course_id", F.size("z").cast("long").alias("controls"), F.md5(F.array_join(F.transform("z", lambda x: x["line"]), "\n")).alias("text"))


_GREY = _PIX + """, g AS (SELECT patch_id, x, y, avg((r + g + b) / 3) AS v FROM p GROUP BY ALL), ax AS (SELECT unnest(range(0, 32)) AS x), ay AS (SELECT unnest(range(0, 32)) AS y), pt AS (SELECT DISTINCT patch_id FROM p),
  f AS (SELECT patch_id, x, y, coalesce(v, 255) AS v FROM (SELECT * FROM pt, ax, ay) LEFT JOIN g USING (patch_id, x, y))"""


@query("A30_texture", _GREY + """, d AS (SELECT a.patch_id, a.x, a.y, a.v, CASE a.x WHEN 0 THEN r.v - a.v WHEN 31 THEN a.v - l.v ELSE (r.v - l.v) / 2 END AS gx, CASE a.y WHEN 0 THEN b.v - a.v WHEN 31 THEN a.v - t.v ELSE (b.v - t.v) / 2 END AS gy FROM f a LEFT JOIN f l ON l.patch_id = a.patch_id AND l.x = a.x - 1 AND l.y = a.y LEFT JOIN f r ON r.patch_id = a.patch_id AND r.x = a.x + 1 AND r.y = a.y
    LEFT JOIN f t ON t.patch_id = a.patch_id AND t.x = a.x AND t.y = a.y - 1 LEFT JOIN f b ON b.patch_id = a.patch_id AND b.x = a.x AND b.y = a.y + 1),
  o AS (SELECT unnest(range(-2, 3)) AS i), k AS (SELECT d.patch_id, d.x, d.y, oi.i AS i, oj.i AS j FROM d, o oi, o oj),
  q AS (SELECT k.patch_id, k.x, k.y, sum(n.gx * n.gx) / 25 AS xx, sum(n.gy * n.gy) / 25 AS yy, sum(n.gx * n.gy) / 25 AS xy FROM k JOIN d n ON n.patch_id = k.patch_id AND n.x = CASE WHEN k.x + i < 0 THEN -1 - k.x - i WHEN k.x + i > 31 THEN 63 - k.x - i ELSE k.x + i END AND n.y = CASE WHEN k.y + j < 0 THEN -1 - k.y - j WHEN k.y + j > 31 THEN 63 - k.y - j ELSE k.y + j END GROUP BY ALL),
  h AS (SELECT patch_id, xx * yy - xy * xy - 0.05 * (xx + yy) * (xx + yy) AS r FROM q), hm AS (SELECT patch_id, max(r) AS m FROM h GROUP BY 1), hc AS (SELECT patch_id, CASE WHEN max(m) > 0 THEN avg(CASE WHEN r > m * 0.01 THEN 1.0 ELSE 0.0 END) ELSE 0 END AS corners FROM h JOIN hm USING (patch_id) GROUP BY 1),
  e AS (SELECT patch_id, avg(CASE WHEN sqrt(gx * gx + gy * gy) > 20 THEN 1.0 ELSE 0.0 END) AS edges FROM d GROUP BY 1), n AS (SELECT patch_id, CAST(floor(v + 0.000001) AS INT) AS b, count(*) / 1024 AS s FROM f GROUP BY ALL), t AS (SELECT patch_id, -sum(s * ln(s)) / ln(256) AS entropy FROM n GROUP BY 1)
  SELECT patch_id, round(edges, 4) AS edges, round(corners, 4) AS corners, round(entropy, 4) AS entropy FROM e JOIN hc USING (patch_id) JOIN t USING (patch_id)""")  # fmt: skip
def a30(s, d):
    """Shares of edge and corner pixels and the normalised entropy of grey levels of each patch."""
    from ..operators import pixels as P

    grey = _pixels(s, d).groupBy("patch_id", "x", "y").agg(F.avg((F.col("r") + F.col("g") + F.col("b")) / 3).alias("v"))
    return P.texture(grey, 32).select("patch_id", *[F.round(c, 4).alias(c) for c in ("edges", "corners", "entropy")])
