"""Queries over map images: pixels derived from the line items, patches of 32 x 32."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pixels as P
from ..registry import query
from ..sources.derived import raw

_PIXELS = """SELECT l_orderkey % 100 AS patch_id, CAST(l_partkey % 32 AS INT) AS x, CAST(l_suppkey % 32 AS INT) AS y, CAST(least(255, greatest(0, CASE WHEN l_orderkey % 100 < 9 THEN 255 WHEN l_partkey % 8 = 0 THEN 180 WHEN l_partkey % 8 = 1 THEN 80 WHEN l_partkey % 8 = 2 THEN 160 WHEN l_partkey % 8 IN (3, 6) THEN 250 WHEN l_partkey % 8 = 4 THEN 80 WHEN l_partkey % 8 = 5 THEN 10 ELSE 130 END + l_suppkey % 31 - 15)) AS INT) AS r,
  CAST(least(255, greatest(0, CASE WHEN l_orderkey % 100 < 9 THEN 255 WHEN l_partkey % 8 = 0 THEN 120 WHEN l_partkey % 8 = 1 THEN 140 WHEN l_partkey % 8 = 2 THEN 210 WHEN l_partkey % 8 IN (3, 6) THEN 245 WHEN l_partkey % 8 = 4 THEN 150 WHEN l_partkey % 8 = 5 THEN 10 ELSE 130 END + l_suppkey % 23 - 11)) AS INT) AS g,
  CAST(least(255, greatest(0, CASE WHEN l_orderkey % 100 < 9 THEN 255 WHEN l_partkey % 8 = 0 THEN 60 WHEN l_partkey % 8 = 1 THEN 80 WHEN l_partkey % 8 = 2 THEN 160 WHEN l_partkey % 8 = 3 THEN 130 WHEN l_partkey % 8 = 6 THEN 250 WHEN l_partkey % 8 = 4 THEN 220 WHEN l_partkey % 8 = 5 THEN 10 ELSE 130 END + l_suppkey % 19 - 9)) AS INT) AS b FROM {lineitem}"""
_P = f"WITH p AS ({_PIXELS.format(lineitem='lineitem')})"


def _pixels(s, d):
    return s.sql(_PIXELS.format(lineitem="{t}"), t=raw(s, d, "lineitem"))


_CLASS = "CASE " + " ".join(f"WHEN greatest(abs(r - {a}), abs(g - {b}), abs(b - {c})) < {t} THEN '{k}'" for k, ((a, b, c), t) in P.CLASSES.items()) + " ELSE 'none' END"


@query("A29_class_shares", _P + f", c AS (SELECT patch_id, {_CLASS} AS c, x BETWEEN 12 AND 19 AND y BETWEEN 12 AND 19 AS mid FROM p) SELECT patch_id, " + ", ".join(f"count(*) FILTER (c = '{k}') / count(*) AS {k}, coalesce(count(*) FILTER (mid AND c = '{k}') / nullif(count(*) FILTER (mid), 0), 0) AS mid_{k}" for k in P.CLASSES) + " FROM c GROUP BY patch_id")
def a29(s, d):
    return P.class_shares(_pixels(s, d), 12, 20, 12, 20)


def _nearest(palette: tuple) -> str:
    return "list_min([" + ", ".join(f"{{'m': (r - {a}) * (r - {a}) + (g - {b}) * (g - {b}) + (b - {c}) * (b - {c}), 'k': {k}, 'name': '{name}', 'cost': {cost}::DOUBLE}}" for k, ((a, b, c), name, cost) in enumerate(palette)) + "])"


@query("F20_nearest_colours", _P + f", n AS (SELECT patch_id, {_nearest(P.FOREST)} AS f, {_nearest(P.SPRINT)} AS s FROM p) SELECT patch_id, f.name AS forest, s.name AS sprint, count(*) AS n, round(avg(f.cost), 4) AS cost FROM n GROUP BY ALL")
def f20(s, d):
    p = _pixels(s, d).select("patch_id", P.nearest_colour(P.FOREST).alias("f"), P.nearest_colour(P.SPRINT).alias("s"))
    return p.groupBy("patch_id", F.col("f.name").alias("forest"), F.col("s.name").alias("sprint")).agg(F.count("*").alias("n"), F.round(F.avg("f.cost"), 4).alias("cost"))


@query("P20_usable_pixels", _P + """ SELECT patch_id, count(*) AS n FROM p WHERE NOT (r >= 248 AND g >= 248 AND b >= 248) AND NOT (r <= 25 AND g <= 25 AND b <= 25) AND NOT (b >= 150 AND b > r * 1.5 AND b > g * 1.2)
  AND NOT (g > r AND g > b AND g >= 80 AND g <= 160 AND r < 130 AND b < 100) GROUP BY patch_id""")  # fmt: skip
def p20(s, d):
    return _pixels(s, d).where(P.usable(248, 25, 150)).groupBy("patch_id").agg(F.count("*").alias("n"))


@query("P21_empty_patches", _P + " SELECT patch_id FROM p GROUP BY patch_id HAVING count(*) FILTER (r > 230 AND g > 230 AND b > 230) / count(*) > 0.92")
def p21(s, d):
    return P.empty_patches(_pixels(s, d)).select("patch_id")
