"""Exchange formats on broken and unusual files."""

from waymark.sources import exchange as E


def _gpx(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, gpx string")


def test_bad_gpx_gives_no_rows(spark):
    assert E.read_gpx(_gpx(spark, "", "not xml", "<gpx></gpx>", None), "id").count() == 0


def test_gpx_without_namespace_and_bad_points(spark):
    one = '<gpx><trk><trkseg><trkpt lat="49" lon="5"/><trkpt lat="x" lon="5"/></trkseg><trkseg><trkpt lat="49.5" lon="5.5"/></trkseg></trk></gpx>'
    assert [(r.seq, r.lng, r.lat) for r in E.read_gpx(_gpx(spark, one), "id").orderBy("seq").collect()] == [(1, 5.0, 49.0), (2, 5.5, 49.5)]


def test_gpx_falls_back_to_waypoints(spark):
    one = '<gpx xmlns="http://www.topografix.com/GPX/1/0"><wpt lat="49" lon="5"><name>A &amp; B</name></wpt></gpx>'
    assert [(r.seq, r.name) for r in E.read_gpx(_gpx(spark, one), "id").collect()] == [(1, "A & B")]


def test_kml_leaves_out_lines_and_far_points(spark):
    mark = "<Placemark><name>{}</name><Point><coordinates>{}</coordinates></Point></Placemark>"
    text = "<kml><Document>" + mark.format("a", " 5,49,0 ") + "<Placemark><name>l</name><LineString><coordinates>5,49 6,50</coordinates></LineString></Placemark>" + mark.format("far", "500,49") + "</Document></kml>"
    assert [(r.seq, r.name) for r in E.read_kml(_gpx(spark, text).withColumnRenamed("gpx", "kml"), "id").collect()] == [(1, "a")]


def test_course_json_refuses_short_and_uneven(spark):
    df = _gpx(spark, '{"xpos":[1,2,3],"ypos":[1,2,3],"codes":["a","b","c"]}', '{"xpos":[1,2],"ypos":[1,2],"codes":["a","b"]}', '{"xpos":[1,2,3],"ypos":[1,2],"codes":["a","b","c"]}', "{", None)
    assert [(r.id, r.ord, r.code) for r in E.read_course_json(df, "id", "gpx").orderBy("ord").collect()] == [(0, 1, "a"), (0, 2, "b"), (0, 3, "c")]
