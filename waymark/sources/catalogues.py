"""Catalogues and results of servers, as JSON, XML or page text, one file a row. Broken files give no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.tables import cut

from .exchange import OPTIONS, escaped, once

_CONTROL = "struct<Id:string,_type:string,Position:struct<_lat:string,_lng:string>>"
_COURSE = "struct<Name:string,Length:string,Climb:string,CourseControl:array<struct<_type:string,Control:string>>>"
COURSES = f"struct<RaceCourseData:struct<Control:array<{_CONTROL}>,Course:array<{_COURSE}>>>"
EVENTS = "struct<Event:array<struct<Id:string,Name:string,StartTime:struct<Date:string>>>>"


def _element(tag: str, *inner: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), *inner, F.lit(f"</{tag.split(' ')[0]}>"))


def to_course_xml(rows: DataFrame, key: str) -> DataFrame:
    """(key, xml): one file per key from rows (key, course, ord, code, lng, lat): each control once, then the courses in
    order of their names, whose first control is the start and whose last is the finish."""
    place = F.concat(F.lit('<Position lat="'), F.col("lat").cast("string"), F.lit('" lng="'), F.col("lng").cast("string"), F.lit('"/>'))
    once = rows.groupBy(key, "code").agg(F.min_by(F.struct("lng", "lat"), F.struct("course", "ord")).alias("p")).select(key, "code", "p.*")
    joined = lambda order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "piece"))), lambda z: z["piece"]), "")
    controls = once.withColumn("piece", _element("Control", _element("Id", escaped(F.col("code"))), place)).groupBy(key).agg(joined("code").alias("controls"))
    w = Window.partitionBy(key, "course")
    ends = F.when(F.col("ord") == F.min("ord").over(w), "Start").when(F.col("ord") == F.max("ord").over(w), "Finish").otherwise("Control")
    refs = rows.withColumn("kind", ends).withColumn("piece", F.concat(F.lit('<CourseControl type="'), "kind", F.lit('">'), _element("Control", escaped(F.col("code"))), F.lit("</CourseControl>")))
    each = refs.groupBy(key, "course").agg(joined("ord").alias("refs")).withColumn("piece", _element("Course", _element("Name", escaped(F.col("course"))), F.col("refs")))
    courses = each.groupBy(key).agg(joined("course").alias("courses"))
    head, foot = '<CourseData xmlns="http://www.orienteering.org/datastandard/3.0" iofVersion="3.0"><RaceCourseData>', "</RaceCourseData></CourseData>"
    return controls.join(courses, key).select(key, F.concat(F.lit(head), "controls", "courses", F.lit(foot)).alias("xml"))


def read_course_xml(files: DataFrame, key: str, content: str = "xml", whole: bool = True) -> DataFrame:
    """(key, course, ord, code, kind, length, climb, lng, lat) of course files with any namespace or none, and attributes
    lat or Lat, lng, Lng, lon or Lon. whole: courses of three controls at least that all have a place; else controls
    without a place go, and courses left with fewer than two. Of controls with one id the last counts."""
    plain = F.regexp_replace(F.regexp_replace(content, r"(?i)\slat=", " lat="), r"(?i)\s(lng|lon)=", " lng=")
    # controls and courses both read the files: they are made and parsed once
    got = cut(files.select(key, F.from_xml(plain, COURSES, OPTIONS)["RaceCourseData"].alias("d")))
    c = got.select(key, F.posexplode("d.Control").alias("at", "c"))
    places = c.select(key, "at", F.trim("c.Id").alias("code"), F.col("c.Position._lng").try_cast("double").alias("lng"), F.col("c.Position._lat").try_cast("double").alias("lat"))
    places = places.where("lng IS NOT NULL AND lat IS NOT NULL").groupBy(key, "code").agg(F.max_by(F.struct("lng", "lat"), "at").alias("p"))
    courses = got.select(key, F.posexplode("d.Course").alias("k", "c"))
    refs = courses.select(key, "k", F.col("c.Name").alias("course"), F.col("c.Length").try_cast("double").alias("length"), F.col("c.Climb").try_cast("double").alias("climb"), F.posexplode("c.CourseControl").alias("at", "r"))
    refs = refs.select(key, "k", "course", "length", "climb", (F.col("at") + 1).alias("ord"), F.trim("r.Control").alias("code"), F.col("r._type").alias("kind"))
    w = Window.partitionBy(key, "k")
    out = refs.join(places, [key, "code"], "left").withColumns({"n": F.count("*").over(w), "found": F.count("p").over(w)})
    kept = out.where("n >= 3 AND found = n" if whole else "found >= 2 AND p IS NOT NULL")
    return kept.select(key, "course", "ord", "code", "kind", "length", "climb", "p.lng", "p.lat")


def read_event_xml(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, event, name, date) of event lists; those without an id go."""
    e = files.select(key, once(F.from_xml(content, EVENTS, OPTIONS)).alias("d")).select(key, F.explode("d.Event").alias("e"))
    return e.select(key, F.col("e.Id").alias("event"), F.col("e.Name").alias("name"), F.col("e.StartTime.Date").try_cast("date").alias("date")).where("event IS NOT NULL")


def read_osm_json(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, id, kind, lng, lat, tags) of the elements of a map server's answer."""
    schema = "elements array<struct<type:string,id:long,lat:double,lon:double,tags:map<string,string>>>"
    e = files.select(key, once(F.from_json(content, schema)).alias("d")).select(key, F.explode("d.elements").alias("e"))
    return e.select(key, "e.id", F.col("e.type").alias("kind"), F.col("e.lon").alias("lng"), F.col("e.lat").alias("lat"), F.coalesce("e.tags", F.create_map().cast("map<string,string>")).alias("tags"))


def read_osm_ways(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, id, gtype, points, tags) of the ways of a map server's answers, points being (lng, lat) in order: those that the way brings along, or else those of
    the nodes that it names, from whichever file holds them; of nodes with one id the least place counts. Nodes that no file holds are left out, a way of which no
    point is known goes. A way tagged area=yes is a Polygon and is closed where its ends differ, others are LineStrings.

    References meet nodes by a join of written tables, so that a node which many ways share is no task's burden; a group is one way."""
    place = "struct<lat:double,lon:double>"
    schema = f"elements array<struct<type:string,id:long,lat:double,lon:double,tags:map<string,string>,nodes:array<long>,geometry:array<{place}>>>"
    e = cut(files.select(key, once(F.from_json(content, schema)).alias("d")).select(key, F.explode("d.elements").alias("e")).select(key, "e.*"))
    ways = e.where("type = 'way'").select(key, "id", F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"), "nodes", "geometry")
    own = F.size("geometry") > 0
    point = lambda x, y: F.struct(x.alias("lng"), y.alias("lat"))
    brought = ways.where(own).select(key, "id", "tags", F.transform(F.filter("geometry", lambda g: g["lon"].isNotNull() & g["lat"].isNotNull()), lambda g: point(g["lon"], g["lat"])).alias("points"))
    nodes = e.where("type = 'node' AND lon IS NOT NULL AND lat IS NOT NULL").groupBy(F.col("id").alias("node")).agg(F.min(F.struct(F.col("lon").alias("lng"), "lat")).alias("p"))
    refs = ways.where(~F.coalesce(own, F.lit(False))).select(key, "id", F.posexplode("nodes").alias("at", "node"))
    found = cut(refs).join(cut(nodes), "node").groupBy(key, "id").agg(F.array_sort(F.collect_list(F.struct("at", "p"))).alias("ps"))
    named = ways.where(~F.coalesce(own, F.lit(False))).join(found, [key, "id"]).select(key, "id", "tags", F.transform("ps", lambda x: x["p"]).alias("points"))
    area = F.coalesce(F.try_element_at("tags", F.lit("area")) == "yes", F.lit(False))
    ends = F.element_at("points", 1) != F.element_at("points", -1)
    rows = brought.unionByName(named).where(F.size("points") > 0)
    return rows.select(key, "id", F.when(area, "Polygon").otherwise("LineString").alias("gtype"), F.when(area & ends, F.concat("points", F.slice("points", 1, 1))).otherwise(F.col("points")).alias("points"), "tags")


def read_map_catalogue(files: DataFrame, content: str) -> DataFrame:
    """(mapid, name, scale, A..F) of maps with a place on earth: E and F not 0. The scale is 4000 where none can be read; of
    maps with one id the largest row counts."""
    letters = "ABCDEF"
    schema = "maps array<struct<mapid:string,name:string,georeferenced:boolean,scale:string,mapscale:string," + ",".join(f"{x}:string" for x in letters) + ">>"
    m = files.select(once(F.from_json(content, schema)).alias("d")).select(F.explode("d.maps").alias("m")).where("m.georeferenced")
    n = {x: F.col(f"m.{x}").try_cast("double").alias(x) for x in letters}
    scale = F.coalesce(F.coalesce("m.scale", "m.mapscale").try_cast("double").try_cast("int"), F.lit(4000)).alias("scale")
    rows = m.select(F.col("m.mapid").try_cast("int").alias("mapid"), F.coalesce("m.name", F.lit("")).alias("name"), scale, *n.values()).dropna(subset=["mapid", *letters])
    return rows.where("E <> 0 AND F <> 0").groupBy("mapid").agg(F.max(F.struct("name", "scale", *letters)).alias("z")).select("mapid", "z.*")


def read_results(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, runner, club, course, time, position, splits) of a server's results; splits is a map from control to time, of
    which the last counts."""
    schema = "results array<struct<name:string,club:string,course:string,time:string,position:int,splits:array<struct<control:string,time:string>>>>"
    r = files.select(key, once(F.from_json(content, schema)).alias("d")).select(key, F.explode("d.results").alias("r"))
    s = F.filter(F.coalesce("r.splits", F.array().cast("array<struct<control:string,time:string>>")), lambda x: x["control"].isNotNull())
    last = F.filter(s, lambda x, i: ~F.exists(F.slice(s, i + 2, F.size(s)), lambda y: y["control"] == x["control"]))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return r.select(key, empty("r.name").alias("runner"), empty("r.club").alias("club"), empty("r.course").alias("course"), empty("r.time").alias("time"), "r.position", F.map_from_entries(last).alias("splits"))


def course_page(text: Column) -> dict[str, Column]:
    """Length, climb and number of controls that a page's text names; null where it names none."""
    tag = lambda p, kind: F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast(kind)
    return {"length": tag(r"([0-9]+)\s*m", "double"), "climb": tag(r"([0-9]+)\s*m\s*D\+", "double"), "controls": tag(r"([0-9]+)\s*postes?", "int")}
