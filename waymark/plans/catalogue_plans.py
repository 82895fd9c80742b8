"""Catalogues and results, written from the tables as servers give them, then read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classes as K
from ..operators import text as X
from ..registry import query
from ..sources import catalogues as R
from ..sources.derived import ctes, derived, raw
from .class_plans import _CATEGORY, _F, _features


def _files(s, d):
    """Course files of about eight courses each; every fifth course has a control without a place."""
    c = derived(s, d, "controls").select((F.col("course_id") / 8).cast("long").alias("file_id"), F.col("course_id").cast("string").alias("course"), "ord", F.concat_ws("-", "course_id", "ord").alias("code"), "lng", "lat")
    rows = R.to_course_xml(c, "file_id")
    return rows.withColumn("xml", F.regexp_replace("xml", r'(<Id>\d*[05]-1</Id>)<Position lat="[^"]*"', '$1<Position lat="?"'))


_KEPT = ctes("controls") + ", n AS (SELECT *, count(*) OVER (PARTITION BY course_id) AS n FROM controls)"


@query("S05_K05_course_xml", _KEPT + """ SELECT course_id // 8 AS file_id, CAST(course_id AS VARCHAR) AS course, CAST(ord AS INT) AS ord, course_id || '-' || ord AS code, CASE WHEN ord = 1 THEN 'Start' WHEN ord = n THEN 'Finish' ELSE 'Control' END AS kind, lng, lat
  FROM n WHERE n >= 3 AND course_id % 5 <> 0""")  # fmt: skip
def s05(s, d):
    """Courses of which every control has a place."""
    return R.read_course_xml(_files(s, d), "file_id").select("file_id", "course", "ord", "code", "kind", "lng", "lat")


@query("S04_course_xml_resolved", _KEPT + " SELECT course_id // 8 AS file_id, CAST(course_id AS VARCHAR) AS course, CAST(ord AS INT) AS ord, lng, lat FROM n WHERE (course_id % 5 <> 0 AND n >= 2) OR (ord > 1 AND n >= 3)")
def s04(s, d):
    """Controls without a place go, and courses left with fewer than two."""
    return R.read_course_xml(_files(s, d), "file_id", whole=False).select("file_id", "course", "ord", "lng", "lat")


@query("S06_event_xml", "SELECT o_custkey AS file_id, CAST(o_orderkey AS VARCHAR) AS event, 'Race ' || o_orderpriority AS name, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderkey % 9 <> 0")
def s06(s, d):
    """Every ninth event has no id."""
    o = raw(s, d, "orders")
    ident = F.when(F.col("o_orderkey") % 9 != 0, F.concat(F.lit("<Id>"), "o_orderkey", F.lit("</Id>"))).otherwise("")
    piece = F.concat(F.lit("<Event>"), ident, F.lit("<Name>Race "), "o_orderpriority", F.lit("</Name><StartTime><Date>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</Date></StartTime></Event>"))
    files = o.groupBy(F.col("o_custkey").alias("file_id")).agg(F.concat(F.lit("<EventList>"), F.array_join(F.collect_list(piece), ""), F.lit("</EventList>")).alias("xml"))
    return R.read_event_xml(files, "file_id", "xml")


@query("S12_osm_json", _F + f" SELECT fid // 500 AS file_id, fid AS id, kind, {_CATEGORY} AS category FROM f WHERE {_CATEGORY} IS NOT NULL")
def s12(s, d):
    """Classified elements of a map server's answers."""
    f = _features(s, d).groupBy(F.expr("fid div 500").alias("file_id")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("fid").alias("id"), F.col("kind").alias("type"), "tags")).alias("elements"))).alias("body"))
    return R.read_osm_json(f, "file_id", "body").select("file_id", "id", "kind", K.osm_category(F.col("tags")).alias("category")).where("category IS NOT NULL")


_GXY = "CAST(round((lng - 5.48) * 10000) AS BIGINT) AS gx, CAST(round((lat - 49.18) * 10000) AS BIGINT) AS gy"


@query("S12_way_geometry", ctes("controls") + f""", g AS (SELECT course_id, ord, {_GXY} FROM controls), p AS (SELECT course_id, ord, gx / 4.0::DOUBLE || ' ' || gy / 4.0::DOUBLE AS t FROM g WHERE course_id % 3 = 0 OR gy % 10 <> 9),
  w AS (SELECT course_id, count(*) AS n, string_agg(t, ',' ORDER BY ord) AS path, arg_min(t, ord) AS a, arg_max(t, ord) AS z FROM p GROUP BY course_id)
  SELECT course_id // 100 AS file_id, course_id AS id, CASE WHEN course_id % 5 = 0 THEN 'Polygon' ELSE 'LineString' END AS gtype, n + CASE WHEN course_id % 5 = 0 AND a <> z THEN 1 ELSE 0 END AS points, path || CASE WHEN course_id % 5 = 0 AND a <> z THEN ',' || a ELSE '' END AS path FROM w""")  # fmt: skip
def s12_ways(s, d):
    """Courses as ways of a map server: every third brings its places along, others name nodes, of which a tenth is missing; every fifth is an area."""
    g = derived(s, d, "controls").selectExpr("course_id", "ord", *_GXY.split(", CAST")[:1], "CAST" + _GXY.split(", CAST")[1])
    node = F.col("gx") * 1000 + F.col("gy")
    places = F.struct((F.col("gy") / 4.0).alias("lat"), (F.col("gx") / 4.0).alias("lon"))
    per = g.groupBy("course_id").agg(F.array_sort(F.collect_list(F.struct("ord", node.alias("node"), places.alias("p")))).alias("z"))
    tags = F.when(F.col("course_id") % 5 == 0, F.create_map(F.lit("area"), F.lit("yes")))
    way = F.struct(F.lit("way").alias("type"), F.col("course_id").alias("id"), tags.alias("tags"), F.when(F.col("course_id") % 3 != 0, F.col("z.node")).alias("nodes"), F.when(F.col("course_id") % 3 == 0, F.col("z.p")).alias("geometry"))
    ways = per.groupBy(F.expr("course_id div 100").alias("file_id")).agg(F.to_json(F.struct(F.collect_list(way).alias("elements"))).alias("body"))
    point = F.struct(F.lit("node").alias("type"), node.alias("id"), (F.col("gy") / 4.0).alias("lat"), (F.col("gx") / 4.0).alias("lon"))
    nodes = g.where("gy % 10 <> 9").select("gx", "gy").distinct().groupBy((-1 - F.col("gx")).alias("file_id")).agg(F.to_json(F.struct(F.collect_list(point).alias("elements"))).alias("body"))
    text = F.array_join(F.transform("points", lambda p: F.concat(p["lng"].cast("string"), F.lit(" "), p["lat"].cast("string"))), ",")
    return R.read_osm_ways(ways.unionByName(nodes), "file_id", "body").select("file_id", "id", "gtype", F.size("points").cast("long").alias("points"), text.alias("path"))


@query("S14_map_catalogue", "SELECT CAST(s_suppkey AS INT) AS mapid, s_name AS name, CAST(if(s_suppkey % 3 = 0, 4000, 7500) AS INT) AS scale, CAST(s_suppkey % 7 AS DOUBLE) AS E FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey % 7 <> 0")
def s14(s, d):
    """Every fourth map has no place on earth, every seventh an E of 0, every third no scale that can be read."""
    k = F.col("s_suppkey")
    m = F.struct(k.alias("mapid"), F.col("s_name").alias("name"), (k % 4 != 0).alias("georeferenced"), F.when(k % 3 == 0, "large").otherwise("7500").alias("scale"), *[F.lit(x).alias(n) for n, x in zip("ABCD", (1.0, 0.0, 0.0, -1.0), strict=True)], (k % 7).alias("E"), F.lit("49.5").alias("F"))
    files = raw(s, d, "supplier").groupBy(F.floor(k / 500).alias("file_id")).agg(F.to_json(F.struct(F.collect_list(m).alias("maps"))).alias("body"))
    return R.read_map_catalogue(files, "body").select("mapid", "name", "scale", "E")


@query("S17_S18_results", """SELECT l_orderkey AS file_id, 'Runner ' || l_orderkey AS runner, '' AS club, CAST(count(DISTINCT l_linenumber) AS INT) AS splits, max({'n': l_linenumber, 't': CAST(l_suppkey AS VARCHAR)}).t AS last
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey DESC) AS k FROM lineitem) WHERE k = 1 GROUP BY l_orderkey""")  # fmt: skip
def s17(s, d):
    """One runner a file, with times at controls; the club isn't given."""
    split = F.struct(F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("at"), F.col("l_linenumber").cast("string").alias("control"), F.col("l_suppkey").cast("string").alias("time"))
    runner = F.struct(F.concat(F.lit("Runner "), "l_orderkey").alias("name"), F.array_sort(F.collect_list(split)).alias("splits"))
    files = raw(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("file_id")).agg(F.to_json(F.struct(F.array(runner).alias("results"))).alias("body"))
    got = R.read_results(files, "file_id", "body")
    last = F.array_max(F.transform(F.map_keys("splits"), lambda k: k.cast("int"))).cast("string")
    return got.select("file_id", "runner", "club", F.size("splits").alias("splits"), F.element_at("splits", last).alias("last"))


@query("S23_course_pages", "SELECT p_partkey AS page, if(p_partkey % 5 = 0, NULL, CAST(p_size * 100 AS DOUBLE)) AS length, if(p_partkey % 5 = 0 OR p_partkey % 3 = 0, NULL, CAST(p_size AS DOUBLE)) AS climb, if(p_partkey % 4 = 0, NULL, CAST(p_size % 20 + 1 AS INT)) AS controls FROM part")
def s23(s, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    words = [F.when(k % 5 != 0, F.concat(n * 100, F.lit(" m"))), F.when((k % 5 != 0) & (k % 3 != 0), F.concat(n, F.lit(" m D+"))), F.when(k % 4 != 0, F.concat(n % 20 + 1, F.lit(" postes")))]
    return raw(s, d, "part").select(k.alias("page"), *[c.alias(x) for x, c in R.course_page(F.concat_ws(", ", *words)).items()])


_BLANK = "regexp_replace({}, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')"
_TEXT = r"trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ')"


@query("R01_R09_paragraphs", f"""WITH RECURSIVE s AS (SELECT doc_id, unnest(string_split({_TEXT}, chr(10) || chr(10))) AS p, generate_subscripts(string_split({_TEXT}, chr(10) || chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
  p AS (SELECT doc_id, {_BLANK.format('p')} AS p, length({_BLANK.format('p')}) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM s WHERE {_BLANK.format('p')} <> ''),
  r AS (SELECT doc_id, k, 1 AS c, n, n > 1000 AS long FROM p WHERE k = 1 UNION ALL SELECT p.doc_id, p.k, if(p.n > 1000 OR r.long OR r.n + p.n > 1000, r.c + 1, r.c), if(p.n > 1000 OR r.long OR r.n + p.n > 1000, p.n, r.n + 2 + p.n), p.n > 1000 FROM r JOIN p ON p.doc_id = r.doc_id AND p.k = r.k + 1),
  c AS (SELECT doc_id, c, bool_or(long) AS long, string_agg(p, chr(10) || chr(10) ORDER BY k) AS t FROM r JOIN p USING (doc_id, k) GROUP BY ALL),
  u AS (SELECT doc_id, c, 0 AS a, t FROM c WHERE NOT long UNION ALL SELECT doc_id, c, a, substr(t, CAST(a + 1 AS BIGINT), 1000) FROM (SELECT doc_id, c, t, unnest(range(0, length(t), 800)) AS a FROM c WHERE long))
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY c, a) - 1 AS INT) AS ord, length(t) AS n, md5(t) AS digest FROM u""")  # fmt: skip
def r01(s, d):
    """Every text of the documents in chunks with numbers."""
    return X.paragraphs(raw(s, d, "documents")).select("doc_id", "ord", F.length("chunk").cast("long").alias("n"), F.md5("chunk").alias("digest"))
