"""Queries over GPS tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import tracks as T
from ..registry import query
from ..sources.derived import ctes, derived

_T = ctes("track_points")
_STEPS = _T + f""", l AS (SELECT *, lag(lng) OVER o AS px, lag(lat) OVER o AS py, lag(t_s) OVER o AS pt FROM track_points WINDOW o AS (PARTITION BY track_id ORDER BY seq)),
  steps AS (SELECT track_id, seq, {geo.hav_sql('px', 'py', 'lng', 'lat')} AS metres, t_s - pt AS seconds FROM l),
  v AS (SELECT *, metres / seconds * 60 AS speed FROM steps WHERE seconds > 0)"""  # fmt: skip


def _p(s, d):
    return derived(s, d, "track_points")


@query("W13_step_speed", _STEPS + " SELECT track_id, seq, round(speed, 2) AS speed FROM v WHERE metres >= 5 AND speed BETWEEN 50 AND 400")
def w13(s, d):
    return T.steps(_p(s, d)).withColumn("v", T.valid_speed()).where("v IS NOT NULL").select("track_id", "seq", F.round("v", 2).alias("speed"))


@query("A03_track_speeds", _STEPS + """, w AS (SELECT track_id, sum(metres) AS m, sum(seconds) AS s FROM steps GROUP BY track_id), x AS (SELECT m / s * 60 AS v FROM w WHERE s > 0 AND m >= 100)
  SELECT count(*) AS n, round(avg(v), 1) AS mean, round(median(v), 1) AS median, round(stddev_pop(v), 1) AS std FROM x""")  # fmt: skip
def a03(s, d):
    t = T.steps(_p(s, d)).groupBy("track_id").agg(F.sum("metres").alias("m"), F.sum("seconds").alias("s")).where("s > 0 AND m >= 100").withColumn("v", F.col("m") / F.col("s") * 60)
    return t.agg(F.count("*").alias("n"), F.round(F.avg("v"), 1).alias("mean"), F.round(F.median("v"), 1).alias("median"), F.round(F.stddev_pop("v"), 1).alias("std"))


_CELLS = _T + """, c AS (SELECT CAST(round_even(lng / 0.0002, 0) AS BIGINT) AS gx, CAST(round_even(lat / 0.0002, 0) AS BIGINT) AS gy, count(*) AS n, count(DISTINCT track_id) AS runners FROM track_points GROUP BY ALL),
  t AS (SELECT count(DISTINCT track_id) AS k FROM track_points)"""  # fmt: skip


def _cells(s, d):
    return T.cells(_p(s, d), 0.0002).groupBy("gx", "gy").agg(F.count("*").alias("n"), F.count_distinct("track_id").alias("runners")), _p(s, d).agg(F.count_distinct("track_id").alias("k"))


@query("A04_T01_consensus_cells", _CELLS + ", h AS (SELECT * FROM c ORDER BY n DESC, gx, gy LIMIT 100) SELECT gx, gy, n, runners, round(n / k, 3) AS freq FROM h, t WHERE n / k >= 0.1")
def a04(s, d):
    """The hundred busiest cells: the limit is the report's; the frequency filter comes after it."""
    c, k = _cells(s, d)
    return c.orderBy(F.desc("n"), "gx", "gy").limit(100).join(k, F.lit(True)).withColumn("freq", F.col("n") / F.col("k")).where("freq >= 0.1").select("gx", "gy", "n", "runners", F.round("freq", 3).alias("freq"))


@query("A05_avoided_cells", _CELLS + " SELECT gx, gy, n FROM c, t WHERE n / k < 0.1 ORDER BY gx, gy LIMIT 20")
def a05(s, d):
    c, k = _cells(s, d)
    return c.join(k, F.lit(True)).where(F.col("n") / F.col("k") < 0.1).orderBy("gx", "gy").limit(20).select("gx", "gy", "n")


@query("A26_popular_cells", _T + """, c AS (SELECT CAST(round_even(lng * 20, 0) AS BIGINT) AS gx, CAST(round_even(lat * 20, 0) AS BIGINT) AS gy, count(*) AS n, count(DISTINCT track_id) AS tracks FROM track_points GROUP BY ALL)
  SELECT gx, gy, n, round(tracks * 100 / (SELECT count(DISTINCT track_id) FROM track_points), 1) AS percent FROM c ORDER BY n DESC, gx, gy LIMIT 10""")  # fmt: skip
def a26(s, d):
    # times 20, as the report has it: a division by 0.05 puts places on a cell's edge into another cell
    at = _p(s, d).select("track_id", *[F.bround(F.col(v) * 20, 0).cast("long").alias(g) for g, v in (("gx", "lng"), ("gy", "lat"))])
    c = at.groupBy("gx", "gy").agg(F.count("*").alias("n"), F.count_distinct("track_id").alias("tracks")).orderBy(F.desc("n"), "gx", "gy").limit(10)
    return c.join(_p(s, d).agg(F.count_distinct("track_id").alias("k")), F.lit(True)).select("gx", "gy", "n", F.round(F.col("tracks") * 100 / F.col("k"), 1).alias("percent"))


_RADIUS = 150.0


def _snaps() -> str:
    out = ctes("track_points", "race_controls") + ", c0 AS (SELECT track_id, 1 AS seq, CAST(0 AS DOUBLE) AS metres FROM track_points GROUP BY track_id)"
    for k in range(1, 6):
        m = geo.hav_sql("r.lng", "r.lat", "p.lng", "p.lat")
        out += f""", c{k} AS (SELECT track_id, CAST(z[2] AS INT) AS seq, z[1] AS metres FROM (SELECT p.track_id, min(({m}, p.seq)) AS z
          FROM track_points p JOIN c{k - 1} b ON b.track_id = p.track_id AND p.seq >= b.seq AND b.metres <= {_RADIUS} JOIN race_controls r ON r.ord = {k - 1} GROUP BY p.track_id))"""
    rows = " UNION ALL ".join(f"SELECT c{k}.track_id, {k - 1} AS ord, c{k}.seq, c{k}.metres FROM c{k} JOIN c5 AS z ON z.track_id = c{k}.track_id WHERE z.metres <= {_RADIUS}" for k in range(1, 6))
    return out + f", snaps AS ({rows})"


_SNAPS = _snaps()
_RUNS = _SNAPS + f""", l AS (SELECT *, lag(lng) OVER o AS px, lag(lat) OVER o AS py, lag(t_s) OVER o AS pt FROM track_points WINDOW o AS (PARTITION BY track_id ORDER BY seq)),
  steps AS (SELECT track_id, seq, {geo.hav_sql('px', 'py', 'lng', 'lat')} AS metres, t_s - pt AS seconds FROM l),
  ends AS (SELECT track_id, ord, lag(seq) OVER (PARTITION BY track_id ORDER BY ord) AS i, seq AS j FROM snaps),
  runs AS (SELECT e.track_id, e.ord AS leg, sum(s.metres) AS metres, sum(s.seconds) AS seconds FROM ends e JOIN steps s ON s.track_id = e.track_id AND s.seq > i AND s.seq <= j GROUP BY ALL)"""  # fmt: skip


def _snap(s, d):
    return T.snap(_p(s, d), derived(s, d, "race_controls"), _RADIUS)


@query("J11_snap", _SNAPS + " SELECT track_id, CAST(ord AS INT) AS ord, seq, round(metres, 2) AS metres FROM snaps")
def j11(s, d):
    return _snap(s, d).withColumn("metres", F.round("metres", 2))


@query("W14_leg_runs", _RUNS + " SELECT track_id, CAST(leg AS INT) AS leg, round(metres, 2) AS metres, round(seconds, 2) AS seconds FROM runs")
def w14(s, d):
    return T.leg_runs(_p(s, d), _snap(s, d)).select("track_id", "leg", F.round("metres", 2).alias("metres"), F.round("seconds", 2).alias("seconds"))


@query("A01_A02_leg_speeds", _RUNS + """, v AS (SELECT leg, metres / seconds * 60 AS v FROM runs WHERE seconds > 0 AND metres >= 10)
  SELECT CAST(leg AS INT) AS leg, count(*) AS n, round(avg(v), 1) AS mean, round(median(v), 1) AS median, round(stddev_pop(v), 1) AS std, round(stddev_pop(v) / avg(v), 3) AS difficulty FROM v WHERE v BETWEEN 50 AND 4000 GROUP BY leg""")  # fmt: skip
def a01(s, d):
    v = T.leg_runs(_p(s, d), _snap(s, d)).where("seconds > 0 AND metres >= 10").withColumn("v", F.col("metres") / F.col("seconds") * 60).where("v BETWEEN 50 AND 4000")
    return v.groupBy("leg").agg(F.count("*").alias("n"), F.round(F.avg("v"), 1).alias("mean"), F.round(F.median("v"), 1).alias("median"), F.round(F.stddev_pop("v"), 1).alias("std"), F.round(F.stddev_pop("v") / F.avg("v"), 3).alias("difficulty"))


@query("W23_thin", ctes("track_points").replace("WITH", "WITH RECURSIVE", 1) + f""", n AS (SELECT track_id, max(seq) AS n FROM track_points GROUP BY track_id),
  r AS (SELECT track_id, seq, lng AS kx, lat AS ky, true AS keep FROM track_points WHERE seq = 1 UNION ALL
    SELECT p.track_id, p.seq, CASE WHEN {geo.hav_sql('kx', 'ky', 'lng', 'lat')} >= 50 THEN lng ELSE kx END, CASE WHEN {geo.hav_sql('kx', 'ky', 'lng', 'lat')} >= 50 THEN lat ELSE ky END, {geo.hav_sql('kx', 'ky', 'lng', 'lat')} >= 50
    FROM r JOIN track_points p ON p.track_id = r.track_id AND p.seq = r.seq + 1)
  SELECT track_id, seq FROM r JOIN n USING (track_id) WHERE keep OR seq = n OR n <= 15""")  # fmt: skip
def w23(s, d):
    return T.thin(_p(s, d)).select("track_id", "seq")
