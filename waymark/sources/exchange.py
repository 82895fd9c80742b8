"""Exchange formats, read and written one file a row: GPX, KML, GeoJSON and the JSON of result servers. Broken files give
no rows, and broken points of a good file are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_POINT = "struct<_lat:string,_lon:string,name:string>"
GPX = f"struct<trk:array<struct<trkseg:array<struct<trkpt:array<{_POINT}>>>>>,wpt:array<{_POINT}>>"
KML = "struct<Document:struct<Placemark:array<struct<name:string,Point:struct<coordinates:string>>>>>"
OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}


def once(c: Column) -> Column:
    """c, computed once a row: what explode makes isn't copied into each of its uses, as a plain column would be."""
    return F.explode(F.array(c))


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _joined(df: DataFrame, key: str, order: str, piece: Column, name: str) -> DataFrame:
    """One row per key: its pieces of text in order."""
    return df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, piece.alias("piece")))), lambda z: z["piece"]), "").alias(name))


def to_gpx(points: DataFrame, key: str, order: str, tag: str = "trkpt", name: Column | None = None) -> DataFrame:
    """(key, gpx): a track (tag trkpt) or waypoints (tag wpt) of each key's rows with lng and lat."""
    inner = F.lit("") if name is None else F.concat(F.lit("<name>"), escaped(name), F.lit("</name>"))
    piece = F.concat(F.lit(f'<{tag} lat="'), F.col("lat").cast("string"), F.lit('" lon="'), F.col("lng").cast("string"), F.lit('">'), inner, F.lit(f"</{tag}>"))
    head, foot = ("<trk><trkseg>", "</trkseg></trk>") if tag == "trkpt" else ("", "")
    body = _joined(points, key, order, piece, "body")
    return body.select(key, F.concat(F.lit(f'<gpx xmlns="http://www.topografix.com/GPX/1/1" version="1.1">{head}'), "body", F.lit(f"{foot}</gpx>")).alias("gpx"))


def _numbered(df: DataFrame, key: str, points: Column) -> DataFrame:
    """(key, seq, lng, lat, name) of an array of points that have x and y; those without a place are dropped first."""
    good = F.filter(points, lambda p: p["x"].between(-180, 180) & p["y"].between(-90, 90))
    return df.select(key, F.posexplode(good).alias("at", "p")).select(key, (F.col("at") + 1).alias("seq"), F.col("p.x").alias("lng"), F.col("p.y").alias("lat"), F.col("p.name").alias("name"))


def _placed(points: Column) -> Column:
    return F.transform(points, lambda p: F.struct(p["_lon"].try_cast("double").alias("x"), p["_lat"].try_cast("double").alias("y"), p["name"].alias("name")))


def read_gpx(files: DataFrame, key: str, content: str = "gpx", waypoints: bool = False) -> DataFrame:
    """(key, seq, lng, lat, name): track points in document order, waypoints where a file has no track point or when asked
    for. Any namespace or none."""
    g = F.from_xml(content, GPX, OPTIONS)
    got = files.select(key, once(g).alias("g"))
    track = F.flatten(F.flatten(F.transform("g.trk", lambda t: F.transform(t["trkseg"], lambda s: F.coalesce(s["trkpt"], F.array().cast(f"array<{_POINT}>"))))))
    points = F.col("g.wpt") if waypoints else F.when(F.size(F.coalesce(track, F.array().cast(f"array<{_POINT}>"))) > 0, track).otherwise(F.col("g.wpt"))
    return _numbered(got, key, _placed(points))


def to_kml(points: DataFrame, key: str, order: str, name: Column) -> DataFrame:
    coordinates = F.concat_ws(",", F.col("lng").cast("string"), F.col("lat").cast("string"), F.lit("0"))
    piece = F.concat(F.lit("<Placemark><name>"), escaped(name), F.lit("</name><Point><coordinates>"), coordinates, F.lit("</coordinates></Point></Placemark>"))
    return _joined(points, key, order, piece, "body").select(key, F.concat(F.lit('<kml xmlns="http://www.opengis.net/kml/2.2"><Document>'), "body", F.lit("</Document></kml>")).alias("kml"))


def read_kml(files: DataFrame, key: str, content: str = "kml") -> DataFrame:
    """(key, seq, lng, lat, name) of point placemarks in order; lines and areas are left out."""
    marks = F.col("k.Document.Placemark")

    def point(m: Column) -> Column:
        c = F.split(F.trim(m["Point"]["coordinates"]), ",")
        return F.struct(F.get(c, F.lit(0)).try_cast("double").alias("x"), F.get(c, F.lit(1)).try_cast("double").alias("y"), m["name"].alias("name"))

    return _numbered(files.select(key, once(F.from_xml(content, KML, OPTIONS)).alias("k")), key, F.transform(marks, point))


def to_geojson(points: DataFrame, *properties: str) -> DataFrame:
    """(feature): one GeoJSON feature a row; write.text makes a file of lines of them."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates"))
    return points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def read_geojson(lines: DataFrame, properties: str, content: str = "feature") -> DataFrame:
    f = F.from_json(content, f"geometry struct<coordinates:array<double>>, properties struct<{properties}>")
    return lines.select(once(f).alias("f")).select("f.properties.*", F.get("f.geometry.coordinates", F.lit(0)).alias("lng"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"))


def read_course_json(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, ord, x, y, code) of JSON with parallel arrays xpos, ypos and codes: three controls at least, equal lengths."""
    c = files.select(key, once(F.from_json(content, "xpos array<double>, ypos array<double>, codes array<string>")).alias("c")).select(key, "c.*")
    held = c.where((F.size("xpos") >= 3) & (F.size("xpos") == F.size("ypos")) & (F.size("xpos") == F.size("codes")))
    rows = held.select(key, F.posexplode(F.arrays_zip("xpos", "ypos", "codes")).alias("at", "z"))
    return rows.select(key, (F.col("at") + 1).alias("ord"), F.col("z.xpos").alias("x"), F.col("z.ypos").alias("y"), F.col("z.codes").alias("code"))


def read_point_list(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, at, lng, lat, t) of a JSON list of points with lat, lon and epoch seconds; points without a place are skipped."""
    rows = files.select(key, F.posexplode(F.from_json(content, "array<struct<lat:double,lon:double,time:double>>")).alias("at", "p"))
    return rows.where("p.lat IS NOT NULL AND p.lon IS NOT NULL").select(key, "at", F.col("p.lon").alias("lng"), F.col("p.lat").alias("lat"), F.timestamp_seconds("p.time").alias("t"))
