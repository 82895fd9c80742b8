"""Folders of files read and written as tables: archives of overlays, feature collections, questions, patch lists, documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exchange import OPTIONS, escaped, once

_PLACEMARK = "struct<name:string,description:string,Point:struct<coordinates:string>,LineString:struct<coordinates:string>>"
FOLDERS = f"struct<Document:struct<name:string,Folder:array<struct<name:string,Placemark:array<{_PLACEMARK}>>>>>"
OLDER = "struct<Name:string,Controls:struct<Control:array<struct<Id:string,ControlCode:string,Position:struct<Lat:string,Lng:string>>>>,CourseData:array<struct<Course:array<struct<Id:string,Name:string,Length:string,Climb:string,Controls:struct<Control:array<struct<Id:string,ControlCode:string,Name:string,Position:struct<Lat:string,Lng:string>>>>>>>>>"
FEATURES = "struct<type:string,features:array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>>"


def read_kmz(spark: SparkSession, path: str) -> DataFrame:
    """(path, kml) of a folder of .kmz archives: the first .kml at an archive's root, else its first .kml; broken ones give none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.kmz").option("recursiveFileLookup", "true").load(path)
    return unzipped(files.select("path", "content"))


def zipped(files: DataFrame, kml: str = "kml") -> DataFrame:
    """files with `content`, an archive of the KML as doc.kml, in place of the KML."""
    import io
    import zipfile

    rest = [f for f in files.schema.fields if f.name != kml]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch[kml]:
                b = io.BytesIO()
                with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("files/other.kml", "<kml/>")
                    z.writestr("doc.kml", text or "")
                out.append(b.getvalue())
            yield batch.drop(columns=[kml]).assign(content=out)

    return files.mapInPandas(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], "content binary"]))


def unzipped(archives: DataFrame, content: str = "content") -> DataFrame:
    """archives with `kml` in place of the archive's bytes, as read_kmz finds it; rows of broken archives go."""
    import io
    import zipfile

    rest = [f for f in archives.schema.fields if f.name != content]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], "kml string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for b in batch[content]:
                try:
                    with zipfile.ZipFile(io.BytesIO(b or b"")) as z:
                        names = sorted((n for n in z.namelist() if n.lower().endswith(".kml")), key=lambda n: "/" in n)
                        texts.append(z.read(names[0]).decode("utf-8", "replace") if names else None)
                except zipfile.BadZipFile:
                    texts.append(None)
            out = batch.drop(columns=[content]).assign(kml=texts)
            yield out[out["kml"].notna()]

    return archives.mapInPandas(run, schema)


def read_folders(files: DataFrame, key: str, content: str = "kml") -> DataFrame:
    """(key, course, ord, name, lng, lat) of KML: each folder is a course, each placemark a control at its first coordinate (of a
    point or a line); folders left without a control give no rows."""
    got = files.select(key, once(F.from_xml(F.col(content), FOLDERS, OPTIONS)["Document"]).alias("d")).select(key, F.posexplode("d.Folder").alias("k", "f"))
    marks = got.select(key, "k", F.col("f.name").alias("course"), F.posexplode("f.Placemark").alias("at", "p"))
    xy = F.split(F.element_at(F.split(F.trim(F.coalesce("p.Point.coordinates", "p.LineString.coordinates")), r"\s+"), 1), ",")
    out = marks.select(key, "course", F.col("at").alias("ord"), F.col("p.name").alias("name"), F.get(xy, F.lit(0)).try_cast("double").alias("lng"), F.get(xy, F.lit(1)).try_cast("double").alias("lat"))
    return out.where("lng BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90")


def read_older_events(files: DataFrame, key: str, content: str = "xml") -> DataFrame:
    """(key, event, course_id, course, ord, code, lng, lat, length, climb) of older event files, whose courses hold their controls with
    child elements for positions."""
    got = files.select(key, once(F.from_xml(F.col(content), OLDER, OPTIONS)).alias("e"))
    courses = got.select(key, F.col("e.Name").alias("event"), F.explode("e.CourseData").alias("d")).select(key, "event", F.explode("d.Course").alias("c"))
    refs = courses.select(key, "event", F.col("c.Id").alias("course_id"), F.col("c.Name").alias("course"), F.col("c.Length").try_cast("double").alias("length"), F.col("c.Climb").try_cast("double").alias("climb"), F.posexplode("c.Controls.Control").alias("at", "r"))
    out = refs.select(key, "event", "course_id", "course", (F.col("at") + 1).alias("ord"), F.coalesce(F.trim("r.ControlCode"), F.trim("r.Id")).alias("code"), F.col("r.Position.Lng").try_cast("double").alias("lng"), F.col("r.Position.Lat").try_cast("double").alias("lat"), "length", "climb")
    return out.where("lng IS NOT NULL AND lat IS NOT NULL")


def read_features(files: DataFrame, key: str, content: str = "geojson") -> DataFrame:
    """(key, ord, gtype, rings, props) of feature collections: rings holds arrays of (x, y), one for points and lines, one for each
    ring of polygons; features of other types or with broken coordinates have null rings."""
    one = files.select(key, once(F.from_json(F.col(content), FEATURES)).alias("f")).where("f.type = 'FeatureCollection'").select(key, F.posexplode("f.features").alias("ord", "f"))
    text, kind = F.col("f.geometry.coordinates"), F.col("f.geometry.type")
    xy = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    line = lambda ps: F.transform(ps, xy)
    rings = F.when(kind == "Point", F.array(F.array(xy(F.from_json(text, "array<double>"))))).when(kind.isin("LineString", "MultiPoint"), F.array(line(F.from_json(text, "array<array<double>>"))))
    rings = rings.when(kind == "Polygon", F.transform(F.from_json(text, "array<array<array<double>>>"), line))
    return one.select(key, "ord", kind.alias("gtype"), rings.alias("rings"), F.col("f.properties").alias("props"))


def to_collection(features: DataFrame, key: str, order: str, layer: Column) -> DataFrame:
    """(key, geojson): one collection per key from rows with geometry (JSON text) and the name of their layer."""
    piece = F.concat(F.lit('{"type":"Feature","geometry":'), "geometry", F.lit(',"properties":{"layer":"'), layer, F.lit('"}}'))
    body = features.withColumn("piece", piece).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "piece"))), lambda z: z["piece"]), ",").alias("body"))
    return body.select(key, F.concat(F.lit('{"type":"FeatureCollection","features":['), "body", F.lit("]}")).alias("geojson"))


def to_runner_kml(points: DataFrame, file: str, track: str, order: str, label: Column) -> DataFrame:
    """(file, kml, west, south, east, north): one line a track, labelled, and the bounds of all points with a quarter more on each
    side."""
    xy = F.concat_ws(",", F.col("lng").cast("string"), F.col("lat").cast("string"))
    lines = points.withColumn("label", label).groupBy(file, track, "label").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, xy.alias("xy")))), lambda z: z["xy"]), " ").alias("line"),
        F.min("lng").alias("w"), F.min("lat").alias("s"), F.max("lng").alias("e"), F.max("lat").alias("n"),
    )
    mark = F.concat(F.lit("<Placemark><name>"), escaped(F.col("label")), F.lit("</name><LineString><coordinates>"), "line", F.lit("</coordinates></LineString></Placemark>"))
    all_ = lines.withColumn("mark", mark).groupBy(file).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(track, "mark"))), lambda z: z["mark"]), "").alias("body"), F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("n").alias("n"))
    dx, dy = (F.col("e") - F.col("w")) * 0.25, (F.col("n") - F.col("s")) * 0.25
    return all_.select(file, F.concat(F.lit("<kml><Document>"), "body", F.lit("</Document></kml>")).alias("kml"), (F.col("w") - dx).alias("west"), (F.col("s") - dy).alias("south"), (F.col("e") + dx).alias("east"), (F.col("n") + dy).alias("north"))


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """Patch lists with a header: img_path, label, lng, lat; rows that don't fit are left out."""
    return spark.read.option("header", "true").option("mode", "DROPMALFORMED").schema("img_path string, label int, lng double, lat double").csv(path)


def read_questions(spark: SparkSession, first: str, second: str) -> DataFrame:
    """(instruction, output, source, circuit_type) of two folders of JSON lines, one after the other; fields that one lacks are null,
    lines that are no JSON are left out."""
    schema = "instruction string, output string, source string, circuit_type string"
    read = lambda p: spark.read.option("mode", "DROPMALFORMED").schema(schema).json(p)
    return read(first).unionByName(read(second), allowMissingColumns=True)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of all text files below a folder, one whole file a row."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(path).select(name.alias("name"), F.col("value").alias("text"))


def known_sources(spark: SparkSession, path: str) -> DataFrame:
    """(source) of the chunks appended so far."""
    return spark.read.schema("source string").json(path).distinct()


def append_chunks(chunks: DataFrame, path: str) -> None:
    """Append chunks (source, ...) of sources that path doesn't hold yet, as JSON lines."""
    chunks.join(known_sources(chunks.sparkSession, path), "source", "left_anti").write.mode("append").json(path)


def without_sources(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """chunks of all sources but those in gone (source); write them elsewhere, then swap the folders."""
    return chunks.join(gone.select("source").distinct(), "source", "left_anti")
