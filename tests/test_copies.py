"""Copies of places, rings and segments are compared once: what meets grows with the places, not with the rows that stand there."""

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import DATA
from waymark.operators import models, scores, spatial
from waymark.plans import ground_plans
from waymark.registry import ORACLE, QUERIES

KEYS = {"supplier": {"s_suppkey": 1000}, "part": {"p_partkey": 8580000}, "lineitem": {"l_orderkey": 150000, "l_partkey": 8580000, "l_suppkey": 1000}}


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """The smallest tables, and the same with suppliers, parts and lines three times under shifted keys, which leave places as they are."""
    con, out = duckdb.connect(), {}
    for k in (1, 3):
        out[k] = str(tmp_path_factory.mktemp("copies"))
        for t, keys in KEYS.items():
            moved = ", ".join(f"{c} + k * {by} AS {c}" for c, by in keys.items())
            con.execute(f"COPY (SELECT t.* REPLACE ({moved}) FROM (SELECT unnest(range({k})) AS k), '{DATA}/{t}.parquet' t) TO '{out[k]}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", ["J05_nearest_candidate", "J06_radius_count", "J24_nearest_vertex", "P13_J08_colours", "J26_navigation_edges", "J22_path_crossings", "J09_point_in_polygon", "J27_candidate_positions", "Y01_J30_corrections"])
def test_copies_meet_once(spark, agree, copies, monkeypatch, name):
    met = []

    def spy(holder, attribute, sides):
        real = getattr(holder, attribute)

        def wrapped(*a, **kw):
            met[-1] += [d.count() for d in a[:sides]]
            return real(*a, **kw)

        monkeypatch.setattr(holder, attribute, wrapped)

    spy(spatial, "radius_pairs", 2)
    spy(spatial, "inside", 2)
    if name.startswith("J22"):
        spy(ground_plans, "cut", 1)
    for k in (1, 3):
        met.append([])
        df = QUERIES[name](spark, copies[k])
        agree(df, ORACLE[name], {t: f"{copies[k]}/{t}.parquet" for t in KEYS})
    assert met[0] == met[1] and met[0]


def test_negatives_of_short_and_long_courses(spark, agree, copies, tmp_path, monkeypatch):
    """A short course's tries are in no join; a long course's are."""
    met = []
    real = spatial.radius_pairs
    monkeypatch.setattr(spatial, "radius_pairs", lambda a, b, *r, **kw: (met.append(b.count()), real(a, b, *r, **kw))[1])
    agree(QUERIES["J31_negative_samples"](spark, copies[3]), ORACLE["J31_negative_samples"], {t: f"{copies[3]}/{t}.parquet" for t in KEYS})
    assert met == [0]
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet")
    first = F.row_number().over(Window.orderBy("l_orderkey", "l_linenumber")) <= 150
    long_ = lines.withColumn("first", first).withColumn("l_orderkey", F.when(F.col("first"), F.lit(-1)).otherwise(F.col("l_orderkey")).cast("long")).drop("first")
    long_.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    agree(QUERIES["J31_negative_samples"](spark, str(tmp_path)), ORACLE["J31_negative_samples"], {"lineitem": f"{tmp_path}/lineitem.parquet/*.parquet"})
    assert met[-1] == 8 * 150


def test_popular_cells_on_edges(spark, agree, tmp_path):
    """Places on a cell's edge go where a product by 20 puts them."""
    events = spark.sql("SELECT 150 + 550 * id AS event_id, 5 * id + 2 AS user_id, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 673) AS ts FROM range(0, 40)")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    agree(QUERIES["A26_popular_cells"](spark, str(tmp_path)), ORACLE["A26_popular_cells"], {"events": f"{tmp_path}/events.parquet/*.parquet"})


def test_rounds_like_the_sql(spark):
    """Values next to the middle of two results are rounded as in DuckDB."""
    values = [k / 10000 for k in range(-20005, 20005, 10)] + [k * 0.0075 + 61.3 for k in range(200)]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "x double").select(scores.half_away(F.col("x"), 3).alias("v")).collect()]
    con = duckdb.connect()
    assert got == [con.execute("SELECT round(?::DOUBLE, 3)", [v]).fetchone()[0] for v in values]


@pytest.mark.parametrize("name", ["J15_min_distance", "J13_visibility", "J14_sprint_spacing"])
def test_pairs_of_short_and_long_courses(spark, agree, tmp_path, monkeypatch, name):
    """A short course's controls meet in no grid cells; a long one's do, and give what the SQL gives."""
    met = []
    real = spatial.gridded
    monkeypatch.setattr(spatial, "gridded", lambda *a, **kw: (met.append(1), real(*a, **kw))[1])
    agree(QUERIES[name](spark, DATA), ORACLE[name])
    assert met == []
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet")
    first = F.row_number().over(Window.orderBy("l_orderkey", "l_linenumber")) <= 150
    long_ = lines.withColumn("first", first).withColumn("l_orderkey", F.when(F.col("first"), F.lit(-1)).otherwise(F.col("l_orderkey")).cast("long")).drop("first")
    long_.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    agree(QUERIES[name](spark, str(tmp_path)), ORACLE[name], {"lineitem": f"{tmp_path}/lineitem.parquet/*.parquet"})
    assert met


def test_forest_learns_copies_once(spark, monkeypatch):
    """Rows of the same features and label are one row with a weight, so that copies of courses don't lengthen the training."""
    held = []
    real = models.RandomForestRegressor.fit
    monkeypatch.setattr(models.RandomForestRegressor, "fit", lambda self, df, *a: (held.append((df.count(), df.agg(F.sum("weight")).first()[0], df.rdd.getNumPartitions())), real(self, df, *a))[1])
    one = spark.range(400).withColumn("course_id", F.col("id"))
    one = one.withColumns({c: (F.xxhash64(F.lit(c), "id") % 50).cast("double") for c in models.FEATURES}).withColumn("label", F.col("leg_metres") / 100)
    parts = spark.range(5).select(F.col("id").alias("k"))
    for rows in (one, one.crossJoin(parts).withColumn("course_id", F.col("course_id") + F.lit(0))):
        assert models.predict(rows, models.train_forest(rows, trees=3)).count() == rows.count()
    learned = one.where(models.part("course_id") < 0.8).count()
    assert [h[:2] for h in held] == [(learned, learned), (learned, 5 * learned)]
    assert held[0][2] >= 4


@pytest.mark.parametrize("name", ["S05_K05_course_xml", "S04_course_xml_resolved"])
def test_course_files_are_parsed_once(spark, name):
    """Controls and courses of a file are read from what one parse wrote."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "xml" not in plan.lower()


def test_heat_without_windows(spark):
    """Where no image has a covered window there is no heat, and nothing fails."""
    assert QUERIES["M05_M06_heat"](spark, DATA).count() == 0


def test_short_tracks_are_folded_once(spark):
    """Only tracks of more than a slice are cut into slices, whose folds may be repeated; each row of the others is looked at once."""
    from waymark.operators import folds

    looked = spark.sparkContext.accumulator(0)

    def start(row):
        looked.add(1)
        return (row[1][0],), [(row, 1)]

    def step(state, row):
        looked.add(1)
        return (state[0] + row[1][0],), [((row[0], (state[0] + row[1][0],)), 1)]

    rows = spark.range(3000).select(F.expr("id div 60").alias("k"), F.expr("id % 60").alias("at"), F.lit(1.0).alias("v"))
    got = folds.fold(rows, "k", "at", ["v"], start, step, size=100)
    assert got.where("v = at + 1").count() == got.count() == 3000 and looked.value == 3000
    both = rows.unionByName(spark.range(500).select(F.lit(99).cast("long").alias("k"), F.col("id").alias("at"), F.lit(1.0).alias("v")))
    got = folds.fold(both, "k", "at", ["v"], start, step, size=100)
    assert got.where("v = at + 1").count() == got.count() == 3500


def test_ground_grid_meets_rings_once(spark, agree, copies, monkeypatch):
    """Areas of the same ring are looked up once, as the first of them."""
    test_copies_meet_once(spark, agree, copies, monkeypatch, "G09_J33_F15_ground_grid")


def test_blocking_terrain_meets_places(spark, agree, copies, monkeypatch):
    """Middles of legs meet the areas once a place, whatever the lengths of the legs that cross there."""
    met = []
    real = spatial.radius_pairs
    monkeypatch.setattr(spatial, "radius_pairs", lambda a, b, *r, **kw: (met.append((a.count(), a.select("lng", "lat").distinct().count())), real(a, b, *r, **kw))[1])
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    agree(QUERIES["J25_blocking_terrain"](spark, copies[3]), ORACLE["J25_blocking_terrain"], {t: f"{copies[3]}/{t}.parquet" for t in KEYS})
    assert met and met[0][0] == met[0][1] < 3 * lines


@pytest.mark.parametrize("name", ["S07_older_events", "S09_kml_folders"])
def test_files_are_dealt_once(spark, name):
    """One shuffle numbers controls and gathers courses and files: no text is moved."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange ") == 1
