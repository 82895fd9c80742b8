"""Queries of routes over street graphs, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import courses as C
from ..operators import graphs as G
from ..registry import ORACLE, query
from ..sources.derived import TABLES, ctes, derived
from . import course_plans  # noqa: F401
from .map_plans import c08
from .score_plans import p27

_CONTROLS = TABLES["controls"][0].format(lineitem="lineitem")

_STEP = 0.002
#: Streets between neighbouring crossings of a grid, per area those that some control stands by; ground makes them longer.
_NODE = f"CAST(floor(lng / {_STEP} + 0.000001) AS BIGINT) * 100000 + CAST(floor(lat / {_STEP} + 0.000001) AS BIGINT)"
_STREETS = f""", at AS (SELECT course_id % 16 AS area_id, course_id, ord, lng, lat, {_NODE} AS node FROM controls), nodes AS (SELECT DISTINCT area_id, node FROM at),
  st AS (SELECT a.area_id, a.node AS src, b.node AS dst, {geo.hav_sql(f'a.node // 100000 * {_STEP}', f'a.node % 100000 * {_STEP}', f'b.node // 100000 * {_STEP}', f'b.node % 100000 * {_STEP}')} * (1 + (a.node * 7 + b.node * 13 + a.area_id) % 11 / 10.0::DOUBLE) AS weight
    FROM nodes a JOIN nodes b ON a.area_id = b.area_id AND b.node - a.node IN (1, 100000) WHERE (a.node + b.node + a.area_id) % 7 <> 0),
  two AS (SELECT area_id, src, dst, weight FROM st UNION ALL SELECT area_id, dst, src, weight FROM st)"""
_SQL = ctes("controls").replace("WITH", "WITH RECURSIVE", 1) + _STREETS.replace(", at AS", ", spot AS").replace("FROM at)", "FROM spot)")
_WAYS = """, far(area_id, source, node, metres) USING KEY (area_id, source, node) AS (SELECT area_id, node, node, 0.0::DOUBLE FROM nodes UNION
    SELECT f.area_id, f.source, t.dst, min(f.metres + t.weight) FROM far f JOIN two t ON t.area_id = f.area_id AND t.src = f.node LEFT JOIN recurring.far r ON r.area_id = f.area_id AND r.source = f.source AND r.node = t.dst
    WHERE f.metres + t.weight < coalesce(r.metres, 1e18) - 1e-9 GROUP BY ALL),
  lg AS (SELECT *, lead(node) OVER o AS next, lead(node, 2) OVER o AS after, lead(lng) OVER o AS mlng, lead(lat) OVER o AS mlat, lead(ord) OVER o AS mord FROM spot WINDOW o AS (PARTITION BY course_id ORDER BY ord))"""


def _spots(s, d):
    node = F.floor(F.col("lng") / _STEP + 0.000001).cast("long") * 100000 + F.floor(F.col("lat") / _STEP + 0.000001).cast("long")
    return derived(s, d, "controls").select((F.col("course_id") % 16).alias("area_id"), "course_id", "ord", "lng", "lat", node.alias("node"))


def _place(node):
    return F.floor(node / 100000).cast("long") * _STEP, F.pmod(node, F.lit(100000)) * _STEP


def _streets(s, d):
    nodes = _spots(s, d).select("area_id", "node").distinct()
    b = nodes.withColumnRenamed("node", "dst")
    a = nodes.select("area_id", F.col("node").alias("src"), F.explode(F.array(F.col("node") + 1, F.col("node") + 100000)).alias("dst"))
    e = a.join(b, ["area_id", "dst"]).where((F.col("src") + F.col("dst") + F.col("area_id")) % 7 != 0)
    weight = geo.haversine(*_place(F.col("src")), *_place(F.col("dst"))) * (1 + (F.col("src") * 7 + F.col("dst") * 13 + F.col("area_id")) % 11 / F.lit(10.0))
    return e.select("area_id", "src", "dst", weight.alias("weight"))


def _legs(s, d):
    w = C.by_order()
    l = _spots(s, d).withColumns({"next": F.lead("node").over(w), "after": F.lead("node", 2).over(w), "mlng": F.lead("lng").over(w), "mlat": F.lead("lat").over(w), "mord": F.lead("ord").over(w)})  # noqa: E741
    return l


@query("G02_G04_routes", _SQL + _WAYS + " SELECT course_id, ord, round(metres, 2) AS metres FROM lg l LEFT JOIN far f ON f.area_id = l.area_id AND f.source = l.node AND f.node = l.next AND l.node <> l.next WHERE next IS NOT NULL")
def g02(s, d):
    """Length of the shortest route of every leg; null where there is none or both ends are at one crossing."""
    legs = _legs(s, d).where("next IS NOT NULL").select("area_id", "course_id", "ord", F.col("node").alias("src"), F.col("next").alias("dst"))
    return G.routes(_streets(s, d), legs).select("course_id", "ord", F.round("metres", 2).alias("metres"))


_NEAR = 60
_XY = geo.hav_sql("mlng", "mlat", f"v.node // 100000 * {_STEP}", f"v.node % 100000 * {_STEP}")


@query("G05_real_doglegs", _SQL + _WAYS + f""", rt AS (SELECT DISTINCT area_id, node AS src, after AS dst FROM lg WHERE after IS NOT NULL AND node <> after),
  v AS (SELECT rt.*, a.node FROM rt JOIN far w ON w.area_id = rt.area_id AND w.source = src AND w.node = dst JOIN far a ON a.area_id = rt.area_id AND a.source = src JOIN far b ON b.area_id = rt.area_id AND b.source = dst AND b.node = a.node WHERE a.metres + b.metres <= w.metres + 1e-6)
  SELECT course_id, mord AS ord, round(min({_XY}), 2) AS metres FROM lg JOIN v ON v.area_id = lg.area_id AND v.src = lg.node AND v.dst = lg.after GROUP BY ALL HAVING min({_XY}) < {_NEAR}""")  # fmt: skip
def g05(s, d):
    """Controls that the shortest route from the one before to the one after passes nearby."""
    legs = _legs(s, d).where("after IS NOT NULL").select("area_id", "course_id", "mord", "mlng", "mlat", F.col("node").alias("src"), F.col("after").alias("dst"))
    near = legs.join(G.on_route(_streets(s, d), legs), ["area_id", "src", "dst"]).withColumn("m", geo.haversine(F.col("mlng"), F.col("mlat"), *_place(F.col("node"))))
    out = near.groupBy("course_id", F.col("mord").alias("ord")).agg(F.min("m").alias("m"))
    return out.where(F.col("m") < _NEAR).select("course_id", "ord", F.round("m", 2).alias("metres"))


_STRETCH, _HOPS = 1.25, 5
_PATHS = f""", rt AS (SELECT DISTINCT area_id, node AS src, next AS dst FROM lg WHERE next IS NOT NULL AND node <> next),
  lim AS (SELECT rt.*, metres * {_STRETCH}::DOUBLE + 1e-6 AS most FROM rt JOIN far f ON f.area_id = rt.area_id AND f.source = dst AND f.node = src),
  grown(area_id, src, dst, most, path, metres) AS (SELECT area_id, src, dst, most, [src], 0.0::DOUBLE FROM lim UNION ALL
    SELECT g.area_id, g.src, g.dst, most, list_append(path, t.dst), g.metres + t.weight FROM grown g JOIN two t ON t.area_id = g.area_id AND t.src = path[-1] JOIN far f ON f.area_id = g.area_id AND f.source = g.dst AND f.node = t.dst
    WHERE len(path) <= {_HOPS} AND path[-1] <> g.dst AND NOT list_contains(path, t.dst) AND g.metres + t.weight + f.metres <= most),
  kr AS (SELECT *, row_number() OVER (PARTITION BY area_id, src, dst ORDER BY round(metres, 6), path) AS place FROM grown WHERE path[-1] = dst QUALIFY place <= 3)"""


def _found(s, d):
    legs = _legs(s, d).where("next IS NOT NULL").select("area_id", F.col("node").alias("src"), F.col("next").alias("dst"))
    return G.k_routes(_streets(s, d), legs, 3, _STRETCH, _HOPS)


@query("G03_three_routes", _SQL + _WAYS + _PATHS + " SELECT area_id, src, dst, CAST(place AS INT) AS place, round(metres, 2) AS metres, list_aggregate(path, 'string_agg', '-') AS path FROM kr")
def g03(s, d):
    """The three shortest routes of each leg, within a stretch and a number of edges."""
    return _found(s, d).select("area_id", "src", "dst", "place", F.round("metres", 2).alias("metres"), F.array_join("path", "-").alias("path"))


def _all_found(s, d):
    legs = _legs(s, d).where("next IS NOT NULL").select("area_id", F.col("node").alias("src"), F.col("next").alias("dst"))
    return G.k_shortest(_streets(s, d), legs, 3)


@query("G03_all_routes")
def g03_all(s, d):
    """The three shortest routes of each leg, however far they go round. SQL would have to list all ways; tests hold the operator against that on small graphs."""
    return _all_found(s, d).select("area_id", "src", "dst", "place", F.round("metres", 2).alias("metres"), F.array_join("path", "-").alias("path"))


_CHOICE = f"""SELECT course_id, mord AS ord, round(coalesce(dv, 0), 4) AS diversity FROM lg JOIN al ON al.area_id = lg.area_id AND al.src = lg.node AND al.dst = lg.next LEFT JOIN dv ON dv.area_id = lg.area_id AND dv.src = lg.node AND dv.dst = lg.next
  WHERE {geo.hav_sql('lng', 'lat', 'mlng', 'mlat')} >= 80 AND coalesce(dv, 0) < 0.25"""


def _choice(s, d, found):
    """Legs of 80 m or more of whose best routes, as found, hardly any two differ."""
    dv = G.diversity(found)
    legs = _legs(s, d).where("next IS NOT NULL").where(geo.haversine(*map(F.col, ("lng", "lat", "mlng", "mlat"))) >= 80).select("area_id", "course_id", F.col("mord").alias("ord"), F.col("node").alias("src"), F.col("next").alias("dst"))
    return legs.join(dv, ["area_id", "src", "dst"]).where("diversity < 0.25").select("course_id", "ord", F.round("diversity", 4).alias("diversity"))


@query("G06_A38_route_choice", _SQL + _WAYS + _PATHS + f""", es AS (SELECT area_id, src, dst, place, list_transform(range(1, len(path)), lambda i: least(path[i], path[i + 1]) * 10000000000 + greatest(path[i], path[i + 1])) AS es FROM kr),
  dv AS (SELECT a.area_id, a.src, a.dst, avg(1 - len(list_intersect(a.es, b.es)) / len(list_distinct(list_concat(a.es, b.es)))) AS dv FROM es a JOIN es b ON a.area_id = b.area_id AND a.src = b.src AND a.dst = b.dst AND a.place < b.place GROUP BY ALL),
  al AS (SELECT DISTINCT area_id, src, dst FROM kr)
  {_CHOICE}""")  # fmt: skip
def g06(s, d):
    """C11: legs of 80 m or more whose best routes hardly differ."""
    return _choice(s, d, _found(s, d))


#: The three shortest routes of each leg without a limit, by spurs. pt: shortest ways of all sources; k1: each leg's first, with what the third takes at most (of ways over one street, where three
#: have no crossing twice); e1 and e2: searches from the crossings of the first and of the second route on, without the streets by which routes of the same start go on. Units are micrometres.
_ON = "{'u': f.z.u + t.units, 'p': list_append(f.z.p, t.dst), 'a': list_append(f.z.a, f.z.u + t.units)}"


def _spurs(name: str, of: str) -> str:
    return f"""{name}(area_id, src, dst, i, node, z, shut, most) USING KEY (area_id, src, dst, i, node) AS (SELECT area_id, src, dst, i, z.p[i], z, shut, most FROM {of} UNION
    SELECT f.area_id, f.src, f.dst, f.i, t.dst, min({_ON}), any_value(f.shut), any_value(f.most) FROM {name} f JOIN tu t ON t.area_id = f.area_id AND t.src = f.node JOIN pt g ON g.area_id = f.area_id AND g.source = f.dst AND g.node = t.dst
      LEFT JOIN recurring.{name} r ON r.area_id = f.area_id AND r.src = f.src AND r.dst = f.dst AND r.i = f.i AND r.node = t.dst
    WHERE f.node <> f.dst AND NOT list_contains(f.z.p, t.dst) AND NOT (len(f.z.p) = f.i AND list_contains(f.shut, t.dst)) AND f.z.u + t.units + g.z.u <= f.most AND (r.z IS NULL OR {_ON} < r.z) GROUP BY ALL)"""


_START = "{'u': q.a[i], 'p': q.p[1:i], 'a': q.a[1:i]} AS z"
_ALL_WAYS = f""", tu AS MATERIALIZED (SELECT area_id, src, dst, greatest(CAST(round(weight * 1e6) AS BIGINT), 1) AS units FROM two),
  pt(area_id, source, node, z) USING KEY (area_id, source, node) AS (SELECT area_id, node, node, {{'u': 0::BIGINT, 'p': [node], 'a': [0::BIGINT]}} FROM nodes UNION
    SELECT f.area_id, f.source, t.dst, min({_ON}) FROM pt f JOIN tu t ON t.area_id = f.area_id AND t.src = f.node LEFT JOIN recurring.pt r ON r.area_id = f.area_id AND r.source = f.source AND r.node = t.dst WHERE r.z IS NULL OR {_ON} < r.z GROUP BY ALL),
  rt AS MATERIALIZED (SELECT DISTINCT area_id, node AS src, next AS dst FROM lg WHERE next IS NOT NULL AND node <> next),
  cw AS (SELECT DISTINCT rt.*, a.z.u + t.units + b.z.u AS units, list_concat(a.z.p, list_reverse(b.z.p)) AS path FROM rt JOIN pt a ON a.area_id = rt.area_id AND a.source = rt.src JOIN tu t ON t.area_id = a.area_id AND t.src = a.node
    JOIN pt b ON b.area_id = rt.area_id AND b.source = rt.dst AND b.node = t.dst WHERE len(list_distinct(path)) = len(path)),
  k1 AS MATERIALIZED (SELECT rt.*, pt.z, coalesce(third, 9000000000000000000) AS most FROM rt JOIN pt ON pt.area_id = rt.area_id AND pt.source = rt.src AND pt.node = rt.dst
    LEFT JOIN (SELECT area_id, src, dst, min(units, 3)[3] AS third FROM cw GROUP BY ALL) c ON c.area_id = rt.area_id AND c.src = rt.src AND c.dst = rt.dst),
  s1 AS (SELECT area_id, src, dst, i, {_START}, [q.p[i + 1]] AS shut, most FROM (SELECT area_id, src, dst, most, z AS q, unnest(range(1, len(z.p))) AS i FROM k1)), {_spurs('e1', 's1')},
  c1 AS MATERIALIZED (SELECT area_id, src, dst, i, z, most FROM e1 WHERE node = dst), k2 AS MATERIALIZED (SELECT area_id, src, dst, min((z, i)) AS b, any_value(most) AS most FROM c1 GROUP BY ALL),
  s2 AS (SELECT area_id, src, dst, i, {_START}, CASE WHEN i = turn THEN [q.p[i + 1], k1.z.p[i + 1]] ELSE [q.p[i + 1]] END AS shut, s.most FROM (SELECT area_id, src, dst, most, b[1] AS q, b[2] AS turn, unnest(range(b[2], len(b[1].p))) AS i FROM k2) s JOIN k1 USING (area_id, src, dst)), {_spurs('e2', 's2')},
  k3 AS (SELECT area_id, src, dst, min(z) AS z FROM (SELECT area_id, src, dst, z FROM e2 WHERE node = dst UNION ALL SELECT area_id, src, dst, z FROM c1 JOIN k2 USING (area_id, src, dst) WHERE i <> b[2]) GROUP BY ALL),
  kw AS (SELECT area_id, src, dst, 1 AS place, z.u AS units, z.p AS path FROM k1 UNION ALL SELECT area_id, src, dst, 2, b[1].u, b[1].p FROM k2 UNION ALL SELECT area_id, src, dst, 3, z.u, z.p FROM k3),
  es AS (SELECT area_id, src, dst, place, list_transform(range(1, len(path)), lambda i: least(path[i], path[i + 1]) * 10000000000 + greatest(path[i], path[i + 1])) AS es FROM kw),
  dv AS (SELECT a.area_id, a.src, a.dst, avg(1 - len(list_intersect(a.es, b.es)) / len(list_distinct(list_concat(a.es, b.es))) ORDER BY a.place, b.place) AS dv FROM es a JOIN es b ON a.area_id = b.area_id AND a.src = b.src AND a.dst = b.dst AND a.place < b.place GROUP BY ALL),
  al AS (SELECT area_id, src, dst FROM k1)"""
_ALL = f"""i AS (SELECT course_id, severity, code FROM ({ORACLE['A14_issues']}) UNION ALL SELECT course_id, 'ERROR', 'C08' FROM ({ORACLE['C08_out_of_bounds']})
  UNION ALL SELECT course_id, severity, code FROM ({ORACLE['P27_feature_rules']}) UNION ALL SELECT course_id, 'WARNING', 'C11' FROM ({_SQL}{_WAYS}{_ALL_WAYS} {_CHOICE}))"""


@query("A14_full_report", f"""WITH {_ALL}, g AS (SELECT course_id, count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARNING') AS warnings FROM i GROUP BY course_id)
  SELECT course_id, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, greatest(0, 100 - 15 * coalesce(errors, 0) - 5 * coalesce(warnings, 0)) AS score, coalesce(errors, 0) = 0 AS compliant, coalesce(errors, 0) = 0 AND coalesce(warnings, 0) <= 2 AS strict
  FROM (SELECT DISTINCT course_id FROM ({_CONTROLS})) LEFT JOIN g USING (course_id)""")  # fmt: skip
def full_report(s, d):
    """One report for each course from all fourteen rules: legs and the whole course (C00 to C07, C12), forbidden ground (C08), features (C10, C13), route choice (C11: of each leg's three shortest
    routes, however far they go round)."""
    ground = c08(s, d).select("course_id", F.lit("ERROR").alias("severity"))
    choice = _choice(s, d, _all_found(s, d)).select("course_id", F.lit("WARNING").alias("severity"))
    out = C.report(derived(s, d, "controls"), ground, p27(s, d), choice)
    return out.withColumn("strict", F.col("compliant") & (F.col("warnings") <= 2))
