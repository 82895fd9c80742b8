"""Queries that write files from the tables and read them again, each beside SQL over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.classes import first
from ..operators import text as X
from ..operators.tables import fresh
from ..registry import query
from ..sources import files as S
from ..sources.derived import ctes, derived, filed, raw
from ..streaming import ingest


def _named(s, d):
    """Controls of files of about eight courses."""
    return filed(s, d, 8).select("file_id", "course_id", "ord", "lng", "lat", F.concat_ws("-", "course_id", "ord").alias("code"))


def _joined(df, keys: list[str], order: str, piece, name: str):
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("p")))), lambda z: z["p"]), "").alias(name))


def _folders(s, d):
    """Every fourth course's controls are lines, of which the first point counts; every seventh control lies nowhere."""
    xy = F.when(F.col("ord") % 7 == 0, F.lit("?")).otherwise(F.concat_ws(",", F.col("lng").cast("string"), F.col("lat").cast("string"), F.lit("0")))
    shape = F.when(F.col("course_id") % 4 == 0, F.concat(F.lit("<LineString><coordinates>"), xy, F.lit(" 1,2,0</coordinates></LineString>"))).otherwise(F.concat(F.lit("<Point><coordinates>"), xy, F.lit("</coordinates></Point>")))
    mark = F.concat(F.lit("<Placemark><name>"), "code", F.lit("</name>"), shape, F.lit("</Placemark>"))
    one = _joined(_named(s, d), ["file_id", "course_id"], "ord", mark, "marks").withColumn("folder", F.concat(F.lit("<Folder><name>C"), "course_id", F.lit("</name>"), "marks", F.lit("</Folder>")))
    return _joined(one, ["file_id"], "course_id", F.col("folder"), "body").select("file_id", F.concat(F.lit('<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>x</name>'), "body", F.lit("</Document></kml>")).alias("kml"))


_PLACED = ctes("controls") + " SELECT course_id // 8 AS file_id, 'C' || course_id AS course, CAST(ord AS INT) AS ord, course_id || '-' || ord AS name, lng, lat FROM controls WHERE ord % 7 <> 0"


@query("S09_kml_folders", _PLACED)
def s09(s, d):
    return S.read_folders(_folders(s, d), "file_id").withColumn("ord", F.col("ord") + 1)


@query("S10_kmz", _PLACED)
def s10(s, d):
    """The same out of archives, each with another .kml below its root; every archive is opened once, in a task."""
    archives = S.zipped(_folders(s, d))
    path = fresh(s, "kmz")
    archives.write.mode("append").parquet(path)
    return S.read_folders(S.unzipped(s.read.parquet(path)), "file_id").withColumn("ord", F.col("ord") + 1)


@query("S07_older_events", ctes("controls") + " SELECT course_id // 8 AS file_id, 'Event ' || course_id // 8 AS event, CAST(course_id AS VARCHAR) AS course_id, 'Course ' || course_id AS course, CAST(ord AS INT) AS ord, course_id || '-' || ord AS code, lng, lat, CAST(course_id % 9 * 1000 AS DOUBLE) AS length FROM controls WHERE ord % 7 <> 0")
def s07(s, d):
    """Every seventh control has no latitude."""
    lat = F.when(F.col("ord") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("<Lat>"), F.col("lat").cast("string"), F.lit("</Lat>")))
    control = F.concat(F.lit("<Control><Id>9</Id><ControlCode>"), "code", F.lit("</ControlCode><Position>"), lat, F.lit("<Lng>"), F.col("lng").cast("string"), F.lit("</Lng></Position></Control>"))
    one = _joined(_named(s, d), ["file_id", "course_id"], "ord", control, "controls")
    course = F.concat(F.lit("<Course><Id>"), "course_id", F.lit("</Id><Name>Course "), "course_id", F.lit("</Name><Length>"), F.col("course_id") % 9 * 1000, F.lit("</Length><Controls>"), "controls", F.lit("</Controls></Course>"))
    files = _joined(one.withColumn("course", course), ["file_id"], "course_id", F.col("course"), "body")
    xml = F.concat(F.lit("<Event><Name>Event "), "file_id", F.lit("</Name><CourseData>"), "body", F.lit("</CourseData></Event>"))
    return S.read_older_events(files.select("file_id", xml.alias("xml")), "file_id").drop("climb")


_GEO = """SELECT area_id, CASE area_id % 3 WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' ELSE 'Polygon' END AS gtype, isom, min_lng, max_lng, min_lat, max_lat FROM areas"""


def _shapes(s, d):
    """Areas as points, lines and polygons of JSON text, in files of some fifty rows."""
    a = derived(s, d, "areas")
    p = lambda x, y: F.concat(F.lit("["), F.col(x).cast("string"), F.lit(","), F.col(y).cast("string"), F.lit("]"))
    ring = F.concat(p("min_lng", "min_lat"), F.lit(","), p("max_lng", "min_lat"), F.lit(","), p("max_lng", "max_lat"), F.lit(","), p("min_lng", "min_lat"))
    kind = F.col("area_id") % 3
    geometry = first([(kind == 0, F.concat(F.lit('{"type":"Point","coordinates":'), p("min_lng", "min_lat"), F.lit("}"))), (kind == 1, F.concat(F.lit('{"type":"LineString","coordinates":['), p("min_lng", "min_lat"), F.lit(","), p("max_lng", "max_lat"), F.lit("]}")))], F.concat(F.lit('{"type":"Polygon","coordinates":[['), ring, F.lit("]]}")))
    return a.select(F.expr("area_id div 50").alias("file_id"), "area_id", "isom", geometry.alias("geometry"))


@query("S11_K03_feature_collections", ctes("areas") + """ SELECT area_id // 50 AS file_id, CASE area_id % 3 WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' ELSE 'Polygon' END AS gtype, CASE WHEN isom < 300 THEN 'land' ELSE 'cover' END AS layer,
  CAST(CASE area_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS INT) AS vertices, min_lng AS x, CASE area_id % 3 WHEN 0 THEN min_lat WHEN 1 THEN max_lat ELSE min_lat END AS y FROM areas""")  # fmt: skip
def s11(s, d):
    """One collection a file, features tagged with their layer; read back: number of vertices, first longitude, last latitude."""
    layer = F.when(F.col("isom") < 300, "land").otherwise("cover")
    got = S.read_features(S.to_collection(_shapes(s, d), "file_id", "area_id", layer), "file_id")
    v = F.flatten("rings")
    return got.select("file_id", "gtype", F.col("props")["layer"].alias("layer"), F.size(v).alias("vertices"), F.element_at(v, 1)["x"].alias("x"), F.element_at(v, -1)["y"].alias("y"))


@query("K13_runner_kml", ctes("track_points") + """, t AS (SELECT track_id // 10 AS file_id, track_id, count(*) AS n, min(lng) AS w, min(lat) AS s, max(lng) AS e, max(lat) AS n_ FROM track_points GROUP BY ALL)
  SELECT file_id, count(*) AS tracks, CAST(sum(n) AS BIGINT) AS points, round(min(w) - (max(e) - min(w)) * 0.25, 8) AS west, round(min(s) - (max(n_) - min(s)) * 0.25, 8) AS south, round(max(e) + (max(e) - min(w)) * 0.25, 8) AS east, round(max(n_) + (max(n_) - min(s)) * 0.25, 8) AS north FROM t GROUP BY file_id""")  # fmt: skip
def k13(s, d):
    """One line a runner, ten runners a file; read back: lines, points and the padded bounds."""
    p = derived(s, d, "track_points").withColumn("file_id", F.expr("track_id div 10"))
    kml = S.to_runner_kml(p, "file_id", "track_id", "seq", F.concat(F.lit("runner & "), F.col("track_id")))
    lines = F.regexp_extract_all("kml", F.lit("<coordinates>([^<]*)</coordinates>"), F.lit(1))
    r = [F.round(c, 8).alias(c) for c in ("west", "south", "east", "north")]
    return kml.select("file_id", F.size(lines).cast("long").alias("tracks"), F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.size(F.split(x, " "))).alias("points"), *r)


@query("S20_patch_list", "SELECT 'patches/' || doc_id || '.png' AS img_path, CAST(quality AS INT) AS label, CAST(5.48 + doc_id % 200 * 0.0001 AS DOUBLE) AS lng, CAST(49.18 + doc_id % 100 * 0.0001 AS DOUBLE) AS lat FROM labels WHERE quality IS NOT NULL")
def s20(s, d):
    path = fresh(s, "csv")
    rows = raw(s, d, "labels").where("quality IS NOT NULL").select(F.concat(F.lit("patches/"), "doc_id", F.lit(".png")).alias("img_path"), F.col("quality").cast("int").alias("label"), F.expr("CAST(5.48 + doc_id % 200 * 0.0001 AS DOUBLE)").alias("lng"), F.expr("CAST(49.18 + doc_id % 100 * 0.0001 AS DOUBLE)").alias("lat"))
    rows.write.mode("append").option("header", "true").csv(path)
    return S.read_patches(s, path)


@query("S19_questions", "SELECT 'Q ' || conv_id || '.' || turn AS instruction, md5(text) AS output, role AS source, NULL::VARCHAR AS circuit_type FROM conversations WHERE text IS NOT NULL UNION ALL SELECT 'B ' || item_id, md5(text), 'bench', 'all' FROM benchmark WHERE text IS NOT NULL")
def s19(s, d):
    """Two sets of JSON lines, of which one has a field more."""
    one, two = fresh(s, "jsonl"), fresh(s, "jsonl")
    c, b = raw(s, d, "conversations").where("text IS NOT NULL"), raw(s, d, "benchmark").where("text IS NOT NULL")
    c.select(F.concat(F.lit("Q "), "conv_id", F.lit("."), "turn").alias("instruction"), F.col("text").alias("output"), F.col("role").alias("source")).write.mode("append").json(one)
    b.select(F.concat(F.lit("B "), "item_id").alias("instruction"), F.col("text").alias("output"), F.lit("bench").alias("source"), F.lit("all").alias("circuit_type")).write.mode("append").json(two)
    return S.read_questions(s, one, two).withColumn("output", F.md5("output"))


@query("S21_text_folder", "SELECT source, count(*) AS n, CAST(sum(CAST('0x' || substr(md5(text), 1, 6) AS BIGINT)) AS BIGINT) AS digest FROM documents WHERE text <> '' GROUP BY source")
def s21(s, d):
    """Documents as text files in a folder for each source, parted by a record separator; read back with their folder."""
    path = fresh(s, "texts")
    rows = raw(s, d, "documents").where("text <> ''").select(F.coalesce("source", F.lit("none")).alias("of"), "text")
    rows.write.mode("append").partitionBy("of").option("lineSep", "\x1e").text(path)
    back = s.read.option("lineSep", "\x1e").text(path).select("of", F.col("value").alias("text"))
    number = F.conv(F.substring(F.md5("text"), 1, 6), 16, 10).cast("long")
    return back.groupBy(F.when(F.col("of") != "none", F.col("of")).alias("source")).agg(F.count("*").alias("n"), F.sum(number).alias("digest"))


@query("S15_event_json", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS name FROM orders WHERE o_orderkey % 6 <> 0")
def s15(s, d):
    """Event lists as JSON; every sixth has no id and goes."""
    o = raw(s, d, "orders")
    event = F.to_json(F.struct(F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("name")))
    lists = o.groupBy("o_custkey").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(event)), ","), F.lit("]")).alias("json"))
    return lists.select(F.explode(F.from_json("json", "array<struct<id:string,name:string>>")).alias("e")).select("e.*").where("id IS NOT NULL")


@query("S13_sprint_split", """WITH f AS (SELECT p_partkey AS fid, CASE p_partkey % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS kind, CASE p_partkey % 4 WHEN 0 THEN 'highway' WHEN 1 THEN 'building' ELSE 'barrier' END AS k, 4 + p_size % 3 AS n, p_size % 2 = 0 AS closed FROM part)
  SELECT fid, CASE WHEN kind = 'way' AND k = 'highway' THEN 'highway_way' WHEN kind = 'way' AND k = 'building' AND closed THEN 'building_ring' WHEN kind = 'node' THEN 'node' END AS part FROM f WHERE kind = 'node' OR (kind = 'way' AND (k = 'highway' OR (k = 'building' AND closed)))""")  # fmt: skip
def s13(s, d):
    """Answers of a map server, split into street ways, building rings and single nodes; the rest goes."""
    p = raw(s, d, "part")
    kind = first([(F.col("p_partkey") % 3 == 0, "node"), (F.col("p_partkey") % 3 == 1, "way")], "relation")
    tag = first([(F.col("p_partkey") % 4 == 0, "highway"), (F.col("p_partkey") % 4 == 1, "building")], "barrier")
    f = p.select(F.col("p_partkey").alias("fid"), kind.alias("kind"), F.create_map(tag, F.lit("yes")).alias("tags"), F.concat(F.sequence(F.lit(1), F.lit(4)), F.array(F.when(F.col("p_size") % 2 == 0, 1).otherwise(5))).alias("nodes"))
    has = lambda k: F.map_contains_key("tags", k)
    ring = F.element_at("nodes", 1) == F.element_at("nodes", -1)
    part = first([((F.col("kind") == "way") & has("highway"), "highway_way"), ((F.col("kind") == "way") & has("building") & ring, "building_ring"), (F.col("kind") == "node", "node")])
    return f.select("fid", part.alias("part")).where("part IS NOT NULL")


@query("S24_course_lookup", ctes("controls") + " SELECT course_id, CAST(ord AS INT) AS ord, lng, lat FROM controls WHERE course_id % 97 = 3 ORDER BY course_id, ord")
def s24(s, d):
    """Controls of chosen courses in order, from a stored table; the filter reaches the scan."""
    path = fresh(s, "orm")
    derived(s, d, "controls").write.mode("append").parquet(path)
    return s.read.parquet(path).where("course_id % 97 = 3").select("course_id", "ord", "lng", "lat").orderBy("course_id", "ord")


def _contributed(s, d):
    """Course, hash of its file (course_id div 2 makes pairs of equal files), consent."""
    c = derived(s, d, "controls").groupBy("course_id").agg(F.count("*").alias("n"), F.min("lng").alias("min_x"), F.min("lat").alias("min_y"), F.max("lng").alias("max_x"), F.max("lat").alias("max_y"))
    return c.withColumns({"file_hash": F.md5(F.expr("course_id div 2").cast("string")), "part": F.col("course_id") % 2})


@query("K09_K12_contributions", ctes("controls") + """, c AS (SELECT course_id, count(*) AS n, min(lng) AS min_x, min(lat) AS min_y, max(lng) AS max_x, max(lat) AS max_y FROM controls GROUP BY course_id)
  SELECT c.course_id, md5(CAST(course_id // 2 AS VARCHAR)) AS file_hash, CAST(k.ord AS INT) AS ord, min_x, min_y, max_x, max_y, k.lng, k.lat FROM c JOIN controls k USING (course_id) WHERE n >= 2""")  # fmt: skip
def k09(s, d):
    """Courses of two controls or more are imported with their bounds and numbered controls: two tables are appended, then joined."""
    heads, rows = fresh(s, "contributions"), fresh(s, "features")
    good = _contributed(s, d).where("n >= 2")
    good.select("course_id", "file_hash", "min_x", "min_y", "max_x", "max_y").write.mode("append").parquet(heads)
    derived(s, d, "controls").join(good.select("course_id"), "course_id", "left_semi").select("course_id", "ord", "lng", "lat").write.mode("append").parquet(rows)
    return s.read.parquet(heads).join(s.read.parquet(rows), "course_id")


_WINDOWS = """WITH w AS (SELECT doc_id, source, text, unnest(range(0, greatest(length(text), 1), 600)) AS pos FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, coalesce(source, 'none') AS source, trim(substr(text, CAST(pos + 1 AS INT), 800), ' ') AS chunk FROM w)"""


def _chunks(s, d):
    docs = raw(s, d, "documents")
    return X.windows(docs).join(docs.select("doc_id", F.coalesce("source", F.lit("none")).alias("source")), "doc_id").select("source", "doc_id", "ord", F.col("chunk").alias("output"))


@query("K04_K11_chunk_store", _WINDOWS + " SELECT source, count(*) AS chunks FROM c WHERE length(chunk) >= 100 AND source NOT IN ('src1', 'src2') GROUP BY source")
def k04(s, d):
    """Chunks are appended once for each source: the second run adds what the first lacked; then two sources are deleted."""
    path = fresh(s, "chunks")
    chunks = _chunks(s, d)
    chunks.where("source < 'src3'").write.mode("append").json(path)
    S.append_chunks(chunks, path)
    S.append_chunks(chunks, path)
    stored = s.read.schema("source string, doc_id long, ord int, output string").json(path)
    gone = s.createDataFrame([("src1",), ("src2",)], "source string")
    return S.without_sources(stored, gone).groupBy("source").agg(F.count("*").alias("chunks"))


@query("X01_J12_ingest", """WITH f AS (SELECT text, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0 GROUP BY text), g AS (SELECT text, min(doc_id) AS doc_id FROM documents d WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f WHERE f.text = d.text) GROUP BY text),
  a AS (SELECT 0 AS batch, * FROM f UNION ALL SELECT 1, * FROM g), w AS (SELECT batch, doc_id, text, unnest(range(0, greatest(length(text), 1), 600)) AS pos FROM a)
  SELECT batch, doc_id, count(*) AS chunks FROM w WHERE length(trim(substr(text, CAST(pos + 1 AS INT), 800), ' ')) >= 100 GROUP BY ALL""")  # fmt: skip
def x01(s, d):
    """A stream over a folder: half of the documents arrive, then all of them; what was there by content is skipped."""
    inbox, store, at = fresh(s, "inbox"), fresh(s, "store"), fresh(s, "checkpoint")
    docs = raw(s, d, "documents").select("doc_id", "source", "text")
    ingest.empty_store(s, store)
    for part in (docs.where("doc_id % 2 = 0"), docs):
        part.write.mode("append").parquet(inbox)
        ingest.ingest_new(s, inbox, store, at)
    one = ingest.stored(s, store)
    return one.groupBy(F.col("batch").cast("int").alias("batch"), "doc_id").agg(F.count("*").alias("chunks"))


_INGEST = ctes("controls") + """, c AS (SELECT course_id, count(*) AS n, CASE course_id % 4 WHEN 0 THEN 'City Sprint ' WHEN 1 THEN 'Long ' ELSE 'Urban ' END || course_id AS name FROM controls GROUP BY course_id),
  e AS (SELECT *, regexp_matches(lower(name), 'sprint|city|urban|natt') AS sprint, row_number() OVER (PARTITION BY course_id // 3, regexp_matches(lower(name), 'sprint|city|urban|natt') ORDER BY course_id) AS k FROM c)"""


@query("M09_ingest_counters", _INGEST + " SELECT count(*) AS fetched, count(*) FILTER (sprint) AS sprints, count(*) FILTER (sprint AND k = 1 AND n >= 3) AS stored, count(*) FILTER (sprint AND k > 1) AS skipped, count(*) FILTER (sprint AND k = 1 AND n < 3) AS errors FROM e")
def m09(s, d):
    """Events are filtered by name, skipped by content, checked and stored; the counters of all steps in one pass."""
    from pyspark.sql import Window

    from ..functions import classes as K

    kind = first([(F.col("course_id") % 4 == 0, "City Sprint "), (F.col("course_id") % 4 == 1, "Long ")], "Urban ")
    c = derived(s, d, "controls").groupBy("course_id").agg(F.count("*").alias("n")).withColumn("sprint", K.is_sprint_event(F.concat(kind, F.col("course_id").cast("string"))))
    c = c.withColumn("k", F.row_number().over(Window.partitionBy(F.expr("course_id div 3"), "sprint").orderBy("course_id")))
    n = lambda w: F.count_if(F.expr(w))
    return c.agg(F.count("*").alias("fetched"), n("sprint").alias("sprints"), n("sprint AND k = 1 AND n >= 3").alias("stored"), n("sprint AND k > 1").alias("skipped"), n("sprint AND k = 1 AND n < 3").alias("errors"))
