"""Operators on made-up rows: brute force, odd input, and what SQL twins can't reach."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import graphs, models, scores, spatial, tracks
from waymark.operators.text import top_matches
from waymark.sources import files
from waymark.streaming import ingest


def _hav(a, b):
    (x1, y1), (x2, y2) = ((math.radians(v) for v in p) for p in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def _points(rng, n, spread=0.004):
    return [(float(5.48 + x * spread), float(49.18 + y * spread)) for x, y in rng.random((n, 2))]


def test_clusters_are_greedy(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for course in range(12):
        pts = _points(rng, 10)
        rows += [(course, i + 1, x, y, 0.0) for i, (x, y) in enumerate(pts)]
        used, found = set(), 0
        for i in range(10):
            if i in used:
                continue
            near = [i, *[j for j in range(10) if j != i and j not in used and _hav(pts[i], pts[j]) <= 120]]
            if len(near) >= 3:
                found += 1
                used.update(near[:3])
        want[course] = found
    df = spark.createDataFrame(rows, "course_id long, ord int, lng double, lat double, ele double")
    got = {r.course_id: r.clusters for r in scores.clusters(df, 120.0, 3).collect()}
    assert got == want and sum(want.values()) > 0


def test_close_counts(spark):
    """Pairs of a long course with many controls at one place, counted without listing them."""
    rng = np.random.default_rng(2)
    pts = _points(rng, 40) + [(5.481, 49.181)] * 30
    df = spark.createDataFrame([(1, i, x, y, 0.0) for i, (x, y) in enumerate(pts)] + [(2, 1, 5.48, 49.18, 0.0)], "course_id long, ord int, lng double, lat double, ele double")
    want = sum(_hav(pts[i], pts[j]) < 60 for i in range(len(pts)) for j in range(i))
    assert {r.course_id: r.close for r in spatial.close_counts(df, 60.0).collect()} == {1: want, 2: 0}
    assert [(r.course_id, r.nearest, r.too_close) for r in spatial.nearest_of_course(df, 60.0).collect()] == [(1, 0.0, want)]
    some = df.where("ord < 40")
    assert abs(spatial.nearest_of_course(some, 60.0).first().nearest - min(_hav(pts[i], pts[j]) for i in range(40) for j in range(i))) < 1e-6


def test_nearest_at_any_distance(spark):
    rng = np.random.default_rng(3)
    places, targets = _points(rng, 60, 0.5), [*_points(rng, 25, 0.01), (6.9, 50.1)]
    p = spark.createDataFrame(places + places[:3] + [(None, 49.0)], "lng double, lat double")
    t = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(targets)] + [(99, None, None)], "cand_id long, lng double, lat double")
    got = {(r.lng, r.lat): r.cand_id for r in scores.nearest_any(p, t, "cand_id").collect()}
    assert got == {q: min(range(len(targets)), key=lambda i: _hav(q, targets[i])) for q in places}


def test_rings_and_circles(spark):
    """Concave rings, circles of unlike sizes, places that many points share, null and degenerate input."""
    ring = [(0.0, 0.0), (0.01, 0.0), (0.01, 0.01), (0.005, 0.002), (0.0, 0.01)]
    areas = spark.createDataFrame([(1, ring), (2, None), (3, [(0.0, 0.0)])], "area_id long, ring array<struct<x:double,y:double>>")
    pts = [(1, 0.005, 0.001), (2, 0.005, 0.008), (3, 0.001, 0.005), (4, 0.005, 0.001), (5, None, 0.0)]
    df = spark.createDataFrame(pts, "id long, lng double, lat double")
    assert sorted(r.id for r in spatial.inside(df, areas).collect()) == [1, 3, 4]
    zones = spark.createDataFrame([(1, ring, None, None, None), (2, None, 0.005, 0.008, 5.0), (3, None, 0.2, 0.2, 900.0), (4, None, 0.1, 0.1, 9e4)], "zone_id long, ring array<struct<x:double,y:double>>, lng double, lat double, metres double")
    more = df.where("lng IS NOT NULL").unionByName(spark.createDataFrame([(6, 0.205, 0.2), (7, 0.3, 0.3)], "id long, lng double, lat double"))
    held = {(r.lng, r.lat) for r in spatial.in_zones(more, zones, margin=1.0).collect()}
    want = {(x, y) for _, x, y in [*pts[:4], (6, 0.205, 0.2), (7, 0.3, 0.3)]}
    assert held == {p for p in want if p[0] < 0.3 or _hav(p, (0.1, 0.1)) <= 9e4}
    few = {(r.lng, r.lat) for r in spatial.in_zones(more, zones.where("zone_id < 3"), margin=1.0).collect()}
    assert few == {(0.005, 0.001), (0.001, 0.005), (0.005, 0.008)}


def test_routes(spark):
    """A square with a diagonal way round, an island, and legs that can't be run."""
    e = [(1, "a", "b", 1.0), (1, "b", "c", 1.0), (1, "a", "d", 1.5), (1, "d", "c", 1.5), (1, "a", "a", 0.1), (1, "b", "a", 5.0), (1, "x", "y", 1.0), (2, "a", "c", 9.0)]
    edges = spark.createDataFrame(e, "area_id long, src string, dst string, weight double")
    legs = spark.createDataFrame([(1, "a", "c"), (1, "a", "x"), (1, "a", "a"), (2, "a", "c")], "area_id long, src string, dst string")
    got = {(r.area_id, r.src, r.dst): r.metres for r in graphs.routes(edges, legs).collect()}
    assert got == {(1, "a", "c"): 2.0, (1, "a", "x"): None, (1, "a", "a"): None, (2, "a", "c"): 9.0}
    assert {r.node for r in graphs.on_route(edges, legs).where("area_id = 1").collect()} == {"a", "b", "c"}
    best = {r.place: r.path for r in graphs.k_routes(edges, legs, 3, 2.0, 4).where("area_id = 1").collect()}
    assert best == {1: ["a", "b", "c"], 2: ["a", "d", "c"]}
    assert {(r.area_id, r.diversity) for r in graphs.diversity(graphs.k_routes(edges, legs, 3, 2.0, 4)).collect()} == {(1, 1.0), (2, 0.0)}


def test_key_points(spark):
    pts = [(5.48 + 0.002 * (i % 2), 49.18 + 0.001 * i) for i in range(40)]
    df = spark.createDataFrame([(1, i + 1, x, y, 0.0) for i, (x, y) in enumerate(pts)] + [(2, 1, 5.0, 49.0, 0.0)], "track_id long, seq int, lng double, lat double, t_s double")
    got = [r.seq for r in tracks.key_points(df).where("track_id = 1").orderBy("seq").collect()]
    assert got == [*range(1, 16), 40] and tracks.key_points(df).where("track_id = 2").count() == 1


def test_top_matches_odd(spark):
    """Null and zero vectors, unlike lengths and ties; blocks don't show."""
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    q = v.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    got = sorted((r.query_id, r.id, r.score, r.place) for r in top_matches(q, v, 2).collect())
    assert got == [(1, 1, 1.0, 1), (1, 2, 1.0, 2), (2, 1, 1.0, 1), (2, 2, 1.0, 2), (3, 1, 0.0, 2), (3, 3, 1.0, 1), (6, 6, 1.0, 1)]
    assert top_matches(q.limit(0), v, 2).count() == 0 and top_matches(q, v.limit(0), 2).count() == 0


def test_archives(spark):
    """Broken archives give nothing; the .kml at the root wins."""
    df = spark.createDataFrame([(1, "<kml>é</kml>"), (2, None)], "id long, kml string")
    packed = files.zipped(df).unionByName(spark.createDataFrame([(3, bytearray(b"no zip")), (4, None)], "id long, content binary"))
    assert {(r.id, r.kml) for r in files.unzipped(packed).collect()} == {(1, "<kml>é</kml>"), (2, "")}


def test_feature_collections_odd(spark):
    text = '{"type":"FeatureCollection","features":[{"geometry":{"type":"Point","coordinates":[1,2]},"properties":{"a":"b"}},{"geometry":{"type":"MultiPolygon","coordinates":[]},"properties":null},{"geometry":{"type":"LineString","coordinates":"x"}}]}'
    df = spark.createDataFrame([(1, text), (2, "no json"), (3, None), (4, '{"type":"Feature"}')], "id long, geojson string")
    got = files.read_features(df, "id").collect()
    assert [(r.id, r.gtype, None if r.rings is None else [[tuple(p) for p in x or []] for x in r.rings]) for r in got][:2] == [(1, "Point", [[(1.0, 2.0)]]), (1, "MultiPolygon", None)]
    assert {r.id for r in got} == {1}


def test_ingest_again(spark, tmp_path):
    """Files are read once; copies by content are skipped within a batch and between runs; a run without news adds nothing."""
    inbox, store, at = (f"file://{tmp_path}/{n}" for n in ("in", "store", "at"))
    text = "word " * 60
    ingest.empty_store(spark, store)
    put = lambda rows: spark.createDataFrame(rows, "doc_id long, source string, text string").write.mode("append").parquet(inbox)
    seen = lambda: sorted({(r.doc_id, r.source) for r in spark.read.parquet(store).collect()})
    put([(2, "b", text), (1, "a", text), (3, "c", None), (4, "d", text + "more")])
    ingest.ingest_new(spark, inbox, store, at)
    assert seen() == [(1, "a"), (4, "d")]
    rows = spark.read.parquet(store).count()
    ingest.ingest_new(spark, inbox, store, at)
    put([(9, "z", text), (8, "y", "new " * 60)])
    ingest.ingest_new(spark, inbox, store, at)
    assert seen() == [(1, "a"), (4, "d"), (8, "y")] and spark.read.parquet(store).count() == rows + 1


def test_forest_learns(spark):
    """Better than the mean on rows that training left out; clipped; too few rows give no model; nulls are filled."""
    rng = np.random.default_rng(5)
    x = rng.random((400, len(models.FEATURES)))
    rows = [(i, *[None if rng.random() < 0.05 else float(v) for v in r], float(0.2 + 0.6 * r[0] + 0.2 * r[2])) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "course_id long, " + ", ".join(f"{c} double" for c in models.FEATURES) + ", label double")
    model = models.train_forest(df, trees=20)
    assert models.held_out_error(df, model)["r2"] > 0.5
    got = models.predict(df, model).agg(F.min("score"), F.max("score"), F.count("score")).first()
    assert got[0] >= 0 and got[1] <= 1 and got[2] == 400
    assert models.train_forest(df.limit(5)) is None
    assert (models.may_retrain(49), models.may_retrain(50), models.may_retrain(2, True), models.may_retrain(3, True)) == (False, True, False, True)


def test_patch_classifier(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(i % 4 == 0), float(rng.normal(i % 4 == 0, 0.5)), float(rng.random())) for i in range(300)]
    df = spark.createDataFrame(rows, "patch_id long, label int, a double, b double")
    model, found = models.train_patches(df, ("a", "b"), rounds=5)
    assert found["auc"] > 0.8 and set(found) == {"auc", "f1", "precision", "recall"}
    assert models.score_patches(df, model).agg(F.min("score")).first()[0] >= 0


@pytest.mark.parametrize("least", [0.0, 0.75, 1.0])
def test_patch_windows(spark, least):
    pixels = [(1, x, y) for x in range(16) for y in range(16) if (x + y) % 8]
    df = spark.createDataFrame(pixels + pixels[:9], "image long, x int, y int")
    c = spark.createDataFrame([(1, 10 * i + j, 2 * i, 2 * j) for i in range(9) for j in range(9)], "image long, centre long, cx int, cy int")
    got = {r.centre: r["count"] for r in models.patches_in(df, c, 2, 16, least).groupBy("centre").count().collect()}
    want = {10 * i + j: sum((x, y) in {(a, b) for _, a, b in pixels} for x in range(2 * i - 2, 2 * i + 2) for y in range(2 * j - 2, 2 * j + 2)) for i in range(9) for j in range(9)}
    assert got == {k: n for k, n in want.items() if n and n >= least * 16}


def test_projections_of_known_places(spark):
    """Published coordinates of two places, to some tens of metres; unknown systems are null, degrees stay."""
    from waymark.functions import geo

    x, y = F.lit(2.2945), F.lit(48.8582)
    r = spark.range(1).select(*geo.utm(x, y, 31), *geo.lambert93(x, y), *geo.to_degrees(F.lit(2.0), F.lit(48.0), 2154), *geo.to_degrees(F.lit(5e5), F.lit(5e6), 31370), *geo.to_degrees(*geo.utm(F.lit(151.2), F.lit(-33.9), 56, True), 32756)).first()
    assert abs(r[0] - 448252) < 60 and abs(r[1] - 5411932) < 60
    assert abs(r[2] - 648237) < 60 and abs(r[3] - 6862275) < 120
    assert r[4:8] == (2.0, 48.0, None, None) and abs(r[8] - 151.2) < 1e-7 and abs(r[9] + 33.9) < 1e-7
