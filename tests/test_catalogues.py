"""Catalogues, classes, pixels and packing on broken and unusual input."""

from pyspark.sql import functions as F

from waymark.functions import classes as K
from waymark.operators import pixels as P
from waymark.operators import text as X
from waymark.sources import catalogues as R

CONTROL = '<Control><Id>{}</Id><Position {}="49" {}="5"/></Control>'
COURSE = "<Course><Name>{}</Name><Length>x</Length>{}</Course>"
REF = "<CourseControl><Control>{}</Control></CourseControl>"


def _files(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, body string")


def _course(*codes):
    return COURSE.format("+".join(codes), "".join(map(REF.format, codes)))


def test_course_files_old_and_broken(spark):
    controls = CONTROL.format("a", "lat", "lng") + CONTROL.format("b", "Lat", "Lon") + CONTROL.format("c", "lat", "lon") + '<Control><Id>d</Id><Position lat="?" lng="5"/></Control>'
    body = controls + _course("a", "b", "c") + _course("a", "b", "d") + _course("a", "d") + _course("a", "b")
    good = f"<CourseData><RaceCourseData>{body}</RaceCourseData></CourseData>"
    files = _files(spark, good, "no xml", "", None, "<CourseData/>")
    rows = R.read_course_xml(files, "id", "body").orderBy("ord").collect()
    assert [(r.course, r.ord, r.code, r.lng, r.lat, r.length) for r in rows] == [("a+b+c", k + 1, c, 5.0, 49.0, None) for k, c in enumerate("abc")]
    loose = R.read_course_xml(files, "id", "body", whole=False).groupBy("course").count().collect()
    assert {(r.course, r["count"]) for r in loose} == {("a+b+c", 3), ("a+b+d", 2), ("a+b", 2)}


def test_results_keep_the_last_split(spark):
    body = '{"results":[{"name":"A","splits":[{"control":"1","time":"5"},{"control":"1","time":"7"},{"control":null,"time":"9"}]},{"position":2}]}'
    rows = R.read_results(_files(spark, body, "{", None), "id", "body").collect()
    assert [(r.runner, r.club, r.position, r.splits) for r in rows] == [("A", "", None, {"1": "7"}), ("", "", 2, {})]


def test_catalogue_refuses_maps_without_a_place(spark):
    one = '{{"mapid":{},"georeferenced":true,"A":1,"B":0,"C":0,"D":1,"E":{},"F":"6","scale":{}}}'
    body = '{"maps":[' + ",".join((one.format(1, 5, '"?"'), one.format(2, 0, 4000), one.format('"x"', 5, 1), one.format(4, '"y"', 1))) + "]}"
    assert [(r.mapid, r.scale) for r in R.read_map_catalogue(_files(spark, body, "[", None), "body").collect()] == [(1, 4000)]


def test_tags_without_a_rule(spark):
    df = spark.sql("SELECT map() :: map<string, string> AS t UNION ALL SELECT NULL UNION ALL SELECT map('access', 'yes')")
    assert {(r.c, r.s, r.m) for r in df.select(K.osm_category(F.col("t")).alias("c"), K.osm_symbol(F.col("t")).alias("s"), K.safety_metres(F.col("t")).alias("m")).collect()} == {(None, 530, None)}


def test_age_classes(spark):
    age, sex = K.age_and_sex(F.col("c"))
    rows = spark.createDataFrame([("h21e",), ("W16",), ("Open",), (" bleu ",), ("H21X",), (None,)], "c string").select("c", age.alias("a"), sex.alias("s")).collect()
    assert [(r.a, r.s) for r in rows] == [(21, 0), (16, 1), (21, 2), (21, 2), (21, 0), (21, 0)]


def test_band_edges(spark):
    f = K.speed_factor(F.col("s"), F.col("h"), F.lit(False), F.lit(True))
    rows = spark.createDataFrame([(0.0, 0.0), (5.0, 0.0), (30.0, 0.0), (100.0, 0.0), (0.0, 0.5), (-1.0, 0.0), (None, None)], "s double, h double").select(f.alias("f")).collect()
    assert [r.f for r in rows] == [1.0, 0.9, 0.4, 1.0, 0.95, 1.0, 1.0]


def test_pixels_of_equal_distance_take_the_first(spark):
    p = spark.createDataFrame([(1, 0, 0, 228, 228, 228), (1, 9, 9, 0, 0, 0)], "patch_id int, x int, y int, r int, g int, b int")
    names = [r.z.name for r in p.orderBy("x").select(P.nearest_colour(P.SPRINT).alias("z")).collect()]
    assert names == ["open", "fence"]
    shares = P.class_shares(p, 5, 6, 5, 6).first()
    assert (shares.white_forest, shares.mid_white_forest) == (0.5, 0.0)
    assert P.class_shares(p.limit(0), 0, 1, 0, 1).count() == 0


def test_paragraphs_match_plain_packing(spark):
    texts = ["a" * 9 + "\n\n" + "b" * 9, "", " \n\n ", None, "x" * 45 + "\n\nshort", "one\n\ntwo\n\n\n\nthree four five", "z" * 20, "z" * 21]

    def packed(t, size=20, overlap=5):
        done, now = [], ""
        for p in [q.strip() for q in (t or "").split("\n\n") if q.strip()]:
            if len(p) > size:
                done += [now] * bool(now) + [p[i : i + size] for i in range(0, len(p), size - overlap)]
                now = ""
            elif len(now) + len(p) > size:
                done, now = [*done, now], p
            else:
                now = f"{now}\n\n{p}" if now else p
        return done + [now] * bool(now)

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.doc_id, r.ord, r.chunk) for r in X.paragraphs(df, 20, 5).orderBy("doc_id", "ord").collect()]
    assert got == [(k, o, c) for k, t in enumerate(texts) for o, c in enumerate(packed(t))]
