"""What round 4's findings led to: sums in a fixed order, whole searches, joins that stay small."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from waymark.operators import scores, spatial
from waymark.registry import ORACLE, QUERIES
from waymark.plans import network_plans, score_plans  # noqa: I001  after the registry


@pytest.fixture
def shuffled(spark):
    """Joins that broadcast nothing, so that rows arrive in the order of their keys' hashes."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n in names:
        spark.conf.unset(n)


def test_terrain_is_added_in_order(spark, shuffled):
    """A course's terrain is its controls' in their order, to the last digit, as in the SQL."""
    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rows = "SELECT course_id, coalesce(att, 0.15) * 0.4::DOUBLE + score * 0.6::DOUBLE AS v FROM rr LEFT JOIN aa USING (lng, lat) JOIN hh USING (lng, lat) WHERE rn > 1 AND rn < n ORDER BY course_id, rn"
    want = {}
    for course, v in con.execute(score_plans._FIT + rows).fetchall():
        total, n = want.get(course, (0.0, 0))
        want[course] = (total + v, n + 1)
    found = scores.terrain_quality(score_plans._c(spark, DATA), score_plans._k(spark, DATA), score_plans._heat(spark, DATA))
    got = {r.course_id: r.terrain for r in found.collect()}
    assert {c: got[c] for c in want} == {c: total / n * 100 for c, (total, n) in want.items()}
    assert {v for c, v in got.items() if c not in want} == {50.0}


def test_whole_parts_are_weighed_exactly(spark):
    """Whole numbers times a weight are what the SQL's decimals give, to the last digit."""
    con, df = duckdb.connect(), spark.range(-40, 101)
    for table, whole in ((scores.FOREST, scores.WHOLE_FITNESS), (scores.SPRINT, scores.WHOLE_FITNESS), (scores.WEIGHTS, scores.WHOLE)):
        for name, w in table.items():
            if name in whole:
                got = [r.v for r in df.withColumn(name, df.id.cast("double")).select("id", scores.weighted({name: w}, whole).alias("v")).orderBy("id").collect()]
                assert got == [r[0] for r in con.execute(f"SELECT (k * {w})::DOUBLE FROM range(-40, 101) t(k) ORDER BY k").fetchall()]
    both = spark.createDataFrame([(85.0, 70.0, 1.25)], "climb double, balance double, variety double")
    weights = {"climb": 0.15, "balance": 0.07, "variety": 0.2}
    assert both.select(scores.weighted(weights, scores.WHOLE)).first()[0] == con.execute("SELECT 85 * 0.15 + 70 * 0.07 + 1.25::DOUBLE * 0.2").fetchone()[0]


def test_report_looks_at_all_routes(spark, agree, tmp_path):
    """Legs of more than five streets, and routes that go far round, count in the report's route choice (C11): held against a listing of all ways in areas of one row
    of crossings and of two."""
    lines, course = [], [0] * 16

    def add(area, *places):
        lines.extend((area + 16 * course[area], n, 20 * x, 20 * y) for n, (x, y) in enumerate(places))
        course[area] += 1

    for area in range(16):
        for x in range(10):
            for y in range(1 + area % 2):
                add(area, (x, y))  # a course of one control: a crossing, no leg
        for x in range(4):
            add(area, (x, 0), (x + 6, 0))
            add(area, (x, 0), (x + 1, 0))
    con = duckdb.connect()
    con.execute("CREATE TABLE l (l_orderkey BIGINT, l_linenumber INT, l_partkey BIGINT, l_suppkey BIGINT)")
    con.executemany("INSERT INTO l VALUES (?, ?, ?, ?)", lines)
    con.execute(f"COPY (SELECT *, 1.0::DOUBLE AS l_quantity, 1.0::DOUBLE AS l_extendedprice, TIMESTAMP '1996-01-01' AS l_shipdate FROM l) TO '{tmp_path}/lineitem.parquet'")
    for t in ("part", "supplier"):
        con.execute(f"COPY (SELECT * FROM '{DATA}/{t}.parquet' LIMIT 1) TO '{tmp_path}/{t}.parquet'")
    tables = {t: f"{tmp_path}/{t}.parquet" for t in ("lineitem", "part", "supplier")}
    ways = {}
    for e in network_plans._streets(spark, str(tmp_path)).collect():
        for a, b in ((e.src, e.dst), (e.dst, e.src)):
            ways.setdefault((e.area_id, a), []).append((b, max(round(e.weight * 1e6), 1)))

    def all_ways(area, path, end, units):
        if path[-1] == end:
            yield units, path
        for node, more in ways.get((area, path[-1]), []) if path[-1] != end else []:
            if node not in path:
                yield from all_ways(area, [*path, node], end, units + more)

    want, far = {}, 0
    for leg in network_plans._legs(spark, str(tmp_path)).where("next IS NOT NULL").collect():
        best = sorted(all_ways(leg.area_id, [leg.node], leg.next, 0))[:3]
        streets = [{frozenset(s) for s in zip(p, p[1:])} for _, p in best]
        gaps = [1 - len(a & b) / len(a | b) for i, a in enumerate(streets) for b in streets[i + 1 :]]
        want[leg.course_id] = int(bool(best) and (sum(gaps) / len(gaps) if gaps else 0.0) < 0.25)
        far += want[leg.course_id] and len(best[0][1]) > 6
    assert far and not all(want.values())
    report = QUERIES["A14_full_report"](spark, str(tmp_path)).persist()
    agree(report, ORACLE["A14_full_report"], tables)
    others = [r.course_id for n in ("A14_issues", "P27_feature_rules") for r in QUERIES[n](spark, str(tmp_path)).where("severity = 'WARNING'").collect()]
    assert {r.course_id: r.warnings - others.count(r.course_id) for r in report.collect() if r.course_id in want} == want


def test_expanded_is_the_join(spark, monkeypatch):
    """Arrays of a key's rows give what a join of the rows gives, however many arrays a key has, and no array is long."""
    monkeypatch.setattr(spatial, "CHUNK", 4)
    monkeypatch.setattr(spatial, "TASK_ROWS", 100)
    left = spark.range(60).select((F.col("id") % 3).alias("k"), F.col("id").alias("a"))
    right = spark.range(90).select(F.when(F.col("id") < 70, 0).otherwise(F.col("id") % 4).alias("to"), F.when(F.col("id") != 80, F.col("id")).alias("b"))
    pairs = spark.createDataFrame([(0, 0, "x"), (0, 1, "y"), (1, 0, "z"), (2, 9, "none")], "k long, to long, more string")
    got = spatial.expanded(pairs, left, ["k"], "a", right, ["to"], "b")
    want = pairs.join(left, "k").join(right, "to").select(*got.columns)
    assert got.count() == want.count() > 1000 and got.exceptAll(want).isEmpty()
    assert got.rdd.getNumPartitions() == -(-want.count() // 100)
    assert spatial.gathered(right, ["to"], "b").agg(F.max(F.size("b"))).first()[0] < 20


@pytest.mark.parametrize("name", ["J22_path_crossings", "J24_nearest_vertex", "J26_navigation_edges"])
def test_pairs_are_listed_by_many_tasks(spark, agree, name):
    """Rows that grow with the square of a table are made by as many tasks as there are cores, though the table is one small file. The smallest data has no such rows."""
    data = DATA.replace("sf0.001", "sf0.01")
    df = QUERIES[name](spark, data)
    agree(df, ORACLE[name], {t: f"{data}/{t}.parquet" for t in ("supplier", "part", "lineitem")})
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() >= 3
