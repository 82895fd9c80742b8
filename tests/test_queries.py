"""Every query of the library against its SQL twin."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from waymark.functions import geo
from waymark.operators import courses, text, tracks
from waymark.registry import ORACLE, QUERIES


#: What a model, an index or a search by spurs gives has no SQL twin: test_operators and test_scale_operators hold them against what training left out, the exact scan or all ways.
LEARNED = {"G03_all_routes", "M02_M04_forest_scores", "M05_M06_heat", "R04_R07_index_search"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, agree, name):
    df = QUERIES[name](spark, DATA)
    if name in LEARNED:
        assert df.count() > 0
    else:
        agree(df, ORACLE[name])


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def _course(spark, points):
    return spark.createDataFrame([(1, i + 1, float(x), float(y), None if z is None else float(z)) for i, (x, y, z) in enumerate(points)], "course_id long, ord int, lng double, lat double, ele double")


def test_doglegs_and_straight_on_differ(spark):
    rows = courses.legs(_course(spark, [(5, 49, 0), (5, 49.01, 0), (5, 49, 0)])).collect()
    middle = [r for r in rows if r.ord == 2][0]
    assert middle.back < 0.01 and abs(middle.turn - 180) < 0.01


def test_climb_skips_nulls(spark):
    r = courses.climb(_course(spark, [(5, 49, 10), (5, 49, None), (5, 49, 30), (5, 49, 25)])).first()
    assert (r.climb, r.descent) == (20.0, 5.0)


def test_one_control_is_c00(spark):
    assert [r.code for r in courses.issues(_course(spark, [(5, 49, 0)])).collect()] == ["C00"]


def test_empty_course_table(spark):
    assert courses.report(_course(spark, [(5, 49, 0)]).limit(0)).count() == 0


def test_grade_edges(spark):
    rows = spark.createDataFrame([(200.0,), (350.0,), (700.0,), (1500.0,), (1500.1,)], "m double").select(courses.grade_td(F.col("m")).alias("g")).collect()
    assert [r.g for r in rows] == [1, 2, 3, 4, 5]


def test_length_of_two_points(spark):
    m = spark.range(1).select(geo.haversine(F.lit(5.5), F.lit(49.19), F.lit(5.508), F.lit(49.192)).alias("m")).first().m
    assert 500 < m < 800


def test_missed_control_drops_the_track(spark):
    pts = spark.createDataFrame([(1, 1, 5.0, 49.0, 0.0), (1, 2, 5.01, 49.0, 9.0), (2, 1, 5.0, 49.0, 0.0)], "track_id long, seq int, lng double, lat double, t_s double")
    race = spark.createDataFrame([(0, 5.0, 49.0), (1, 5.01, 49.0)], "ord int, lng double, lat double")
    assert {(r.track_id, r.ord, r.seq) for r in tracks.snap(pts, race, 50).collect()} == {(1, 0, 1), (1, 1, 2)}


def test_clean(spark):
    assert spark.range(1).select(text.clean(F.lit("  a \t b\n\n\n\nc ")).alias("t")).first().t == "a b\n\nc"


def test_imports_without_a_session():
    import subprocess
    import sys

    root = __import__("pathlib").Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries()"], cwd=root, check=True, timeout=120)
