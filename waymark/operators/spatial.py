"""Spatial joins as equi-joins on grid cells with an exact test after them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .tables import cut


def gridded(df: DataFrame, lng: str, lat: str, metres: Column | float, around: bool = False) -> DataFrame:
    """df with the grid cell (__cy, __cx) of a place; with `around`, a row for each of the nine cells about it (fewer where a row has fewer)."""
    row = geo.grid_row(F.col(lat), metres)
    df = df.withColumn("__cy", F.explode(F.transform(F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)]), lambda k: row + k)) if around else row)
    df = df.withColumn("__nx", geo.grid_columns(F.col("__cy"), metres))
    column = geo.grid_column(F.col(lng), F.col("__nx"))
    if around:
        near = F.array_distinct(F.transform(F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)]), lambda k: F.pmod(column + k, F.col("__nx"))))
        column = F.explode(near)
    return df.withColumn("__cx", column).drop("__nx")


def radius_pairs(left: DataFrame, right: DataFrame, radius: float, key: tuple[str, str] | None = None) -> DataFrame:
    """left ⋈ right within `radius` metres, with `metres`, and where given equal in key (left's column, right's column). Both have
    lng and lat; right's other columns must not clash with left's; rows with a null place are in no pair. Cells are as high as the radius, and as
    wide as it is at their latitude, across 180 degrees too; each left row looks into its 3 x 3 cells. No side is broadcast by force; a dense
    cell's rows can be split, for both sides shuffle."""
    a = gridded(left.where("lng IS NOT NULL AND lat IS NOT NULL"), "lng", "lat", radius, around=True)
    b = gridded(right.where("lng IS NOT NULL AND lat IS NOT NULL").withColumnsRenamed({"lng": "__x", "lat": "__y"}), "__x", "__y", radius)
    on = ["__cx", "__cy"]
    if key:
        b, on = b.withColumnRenamed(key[1], key[0]), [*on, key[0]]
    metres = geo.haversine(F.col("lng"), F.col("lat"), F.col("__x"), F.col("__y"))
    return a.join(b, on).withColumn("metres", metres).where(F.col("metres") <= radius).drop("__cx", "__cy")


#: Controls of a course whose pairs are listed from the rows before each; longer courses' controls meet in grid cells.
SHORT = 64


def by_length(controls: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The controls of courses of up to SHORT, and those of longer ones: None where there are none."""
    known = controls.where("course_id IS NOT NULL")
    long_ = cut(known.groupBy("course_id").agg(F.count("*").alias("n")).where(F.col("n") > SHORT).select("course_id"))
    if long_.isEmpty():
        return known, None
    return known.join(long_, "course_id", "left_anti"), known.join(long_, "course_id", "left_semi")


def short_pairs(controls: DataFrame) -> DataFrame:
    """(course_id, i, j, metres): every pair of controls of courses of up to SHORT, i standing before j. Each control looks at the rows before it, so that one
    shuffle by course serves all."""
    before = Window.partitionBy("course_id").orderBy("ord").rowsBetween(1 - SHORT, -1)
    one = F.struct(F.col("ord").alias("i"), F.col("lng").alias("x"), F.col("lat").alias("y"))
    p = controls.withColumn("before", F.collect_list(one).over(before)).select("course_id", F.col("ord").alias("j"), "lng", "lat", F.explode("before").alias("p")).select("course_id", "j", "lng", "lat", "p.*")
    return p.select("course_id", "i", "j", geo.haversine(F.col("x"), F.col("y"), F.col("lng"), F.col("lat")).alias("metres"))


def course_pairs(controls: DataFrame, most: float) -> DataFrame:
    """(course_id, i, j, metres): pairs of a course's controls, by ord, nearer than so many metres. Of long courses only controls of neighbouring cells meet."""
    short, long_ = by_length(controls)
    out = short_pairs(short)
    if long_ is not None:
        a = long_.select("course_id", F.col("ord").alias("i"), "lng", "lat")
        b = long_.select(F.col("course_id").alias("other"), F.col("ord").alias("j"), "lng", "lat")
        out = out.unionByName(radius_pairs(a, b, most, key=("course_id", "other")).select("course_id", "i", "j", "metres"))
    return out.where((F.col("i") < F.col("j")) & (F.col("metres") < most))


def close_counts(controls: DataFrame, metres: float) -> DataFrame:
    """Per course how many pairs of its controls are nearer than so many metres. A long course's controls at one place are counted, not paired,
    and only its places of neighbouring cells meet, so that its pairs are never listed."""
    short, long_ = by_length(controls)
    out = short_pairs(short).where(F.col("metres") < metres).groupBy("course_id").agg(F.count("*").alias("close"))
    out = short.select("course_id").distinct().join(out, "course_id", "left").select("course_id", F.coalesce("close", F.lit(0)).alias("close"))
    return out if long_ is None else out.unionByName(_long_counts(long_, metres))


def _long_counts(controls: DataFrame, metres: float) -> DataFrame:
    spots = controls.groupBy("course_id", "lng", "lat").agg(F.count("*").alias("k"))
    same = spots.groupBy("course_id").agg(F.sum(F.when(F.col("lng").isNotNull() & F.col("lat").isNotNull(), F.col("k") * (F.col("k") - 1) / 2)).cast("long").alias("same"))
    pairs = radius_pairs(spots, spots.select(F.col("course_id").alias("other"), F.col("k").alias("j"), "lng", "lat"), metres, key=("course_id", "other")).where(F.col("metres") < metres)
    apart = pairs.where("lng < __x OR (lng = __x AND lat < __y)").groupBy("course_id").agg(F.sum(F.col("k") * F.col("j")).alias("apart"))
    return same.join(apart, "course_id", "left").select("course_id", (F.coalesce("same", F.lit(0)) + F.coalesce("apart", F.lit(0))).alias("close"))


def nearest_of_course(controls: DataFrame, metres: float) -> DataFrame:
    """Per course of two controls or more: nearest, the least distance between any two, and too_close, how many pairs are nearer than
    so many metres. Two at one place are 0 apart; else a long course's shortest leg bounds the search, and only places of
    neighbouring cells of that size meet."""
    short, long_ = by_length(controls)
    out = short_pairs(short).groupBy("course_id").agg(F.min("metres").alias("nearest"), F.count_if(F.coalesce(F.col("metres") < metres, F.lit(False))).alias("too_close"))
    return out if long_ is None else out.unionByName(_long_nearest(long_, metres))


def _long_nearest(controls: DataFrame, metres: float) -> DataFrame:
    w = Window.partitionBy("course_id").orderBy("ord")
    leg = geo.haversine(F.lag("lng").over(w), F.lag("lat").over(w), F.col("lng"), F.col("lat"))
    bound = controls.withColumn("leg", leg).groupBy("course_id").agg(F.min(F.when(F.col("leg") > 0, F.col("leg"))).alias("u"))
    spots = controls.groupBy("course_id", "lng", "lat").agg(F.count("*").alias("k")).join(bound, "course_id").withColumn("size", F.col("u") + 0.01)
    left = gridded(spots, "lng", "lat", F.col("size"), around=True).select("course_id", F.col("lng").alias("x"), F.col("lat").alias("y"), "__cx", "__cy")
    pairs = left.join(gridded(spots, "lng", "lat", F.col("size")), ["course_id", "__cx", "__cy"]).where("x < lng OR (x = lng AND y < lat)")
    apart = pairs.groupBy("course_id").agg(F.min(geo.haversine(F.col("x"), F.col("y"), F.col("lng"), F.col("lat"))).alias("m"))
    same = spots.groupBy("course_id").agg(F.max(F.when(F.col("lng").isNotNull() & F.col("lat").isNotNull(), F.col("k"))).alias("k"))
    out = same.join(apart, "course_id", "left").join(_long_counts(controls, metres), "course_id")
    return out.select("course_id", F.when(F.col("k") > 1, 0.0).otherwise(F.col("m")).alias("nearest"), F.col("close").alias("too_close"))


def nearest(left: DataFrame, right: DataFrame, radius: float, key: list[str], by: str) -> DataFrame:
    """Per left key the nearest right row within the radius (ties: smallest `by`). Places are compared once each, however many rows stand there."""
    spots = right.groupBy("lng", "lat").agg(F.min(by).alias(by))
    found = radius_pairs(left.select("lng", "lat").distinct(), spots, radius).groupBy("lng", "lat").agg(F.min(F.struct(F.round("metres", 3).alias("metres"), F.col(by))).alias("z"))
    return left.select(*key, "lng", "lat").join(found, ["lng", "lat"], "left").select(*key, F.col(f"z.{by}").alias(by), F.col("z.metres").alias("metres"))


#: Rows that are handed on together, about, and rows that a task makes of them.
CHUNK, TASK_ROWS = 1000, 20_000_000


def gathered(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, slot, value): the values of each key in arrays of about CHUNK, dealt by a hash, however many a key has."""
    n = rows.groupBy(*key).agg(F.count("*").alias("__n"))
    slot = F.pmod(F.xxhash64(value), F.ceil(F.col("__n") / CHUNK))
    return cut(rows.join(n, key).groupBy(*key, slot.alias(f"__{value}")).agg(F.collect_list(F.struct(value)).alias(value)))


def expanded(pairs: DataFrame, left: DataFrame, on: list[str], one: str, right: DataFrame, to: list[str], other: str) -> DataFrame:
    """pairs (on, to, more) with a row for each `one` of left (on, one) and each `other` of right (to, other). What is joined and moved are arrays of them; rows are
    made of a pair of arrays in the last step, so that no key's rows meet in one task, none is written, and as many tasks take part as there are rows to make."""
    pairs, a, b = cut(pairs), gathered(left, on, one), gathered(right, to, other)
    sizes = [c.groupBy(*k).agg(F.sum(F.size(v).cast("double")).alias(f"__n_{v}")) for c, k, v in ((a, on, one), (b, to, other))]
    total = pairs.join(sizes[0], on).join(sizes[1], to).agg(F.sum(F.col(f"__n_{one}") * F.col(f"__n_{other}"))).first()[0] or 0
    tasks = max(pairs.sparkSession.sparkContext.defaultParallelism, math.ceil(total / TASK_ROWS))
    met = pairs.join(a, on).join(b, to).repartition(tasks, *on, *to, f"__{one}", f"__{other}")
    more = [c for c in pairs.columns if c not in (one, other)]
    half = met.select(*more, other, F.explode(one).alias("__one")).select(*more, F.col(f"__one.{one}").alias(one), F.explode(other).alias("__other"))
    return half.select(*more, one, F.col(f"__other.{other}").alias(other))


def boxed(areas: DataFrame, ring: str = "ring") -> DataFrame:
    """areas with the box (min_lng .. max_lat) of their ring, an array of (x, y)."""
    x, y = F.col(ring)["x"], F.col(ring)["y"]  # a field of an array of structs is the array of that field
    return areas.withColumns({"min_lng": F.array_min(x), "max_lng": F.array_max(x), "min_lat": F.array_min(y), "max_lat": F.array_max(y)})


def spaced(points: DataFrame, order: list[str], box: tuple[float, float] | None = None, metres: float | None = None, by: tuple[str, ...] = (), rounds: int = 10_000) -> DataFrame:
    """(by, order, lng, lat): what a walk through the points in order keeps (of each `by` for itself) that takes a point unless one taken before is near: in
    a box (less than so many degrees apart both ways) or nearer than so many metres. Points of a null place are left out; of points at one place the first counts.

    Each round decides the first open point of every cell: it stays if no earlier open point is near, and then what is near it goes. A point meets only the
    firsts of the cells about it, so that no pairs of a dense place are listed; the first of all is decided in each round, so it ends, and by induction
    with what the walk keeps. Rounds are as many as the longest chain of points that wait for each other: few where the order is not along a line."""
    key, on = list(by), [*by, "__cx", "__cy"]

    def celled(df: DataFrame, around: bool = False) -> DataFrame:
        if metres is not None:
            return gridded(df, "lng", "lat", metres, around)
        at = {"__cx": geo.cell(F.col("lng"), box[0]), "__cy": geo.cell(F.col("lat"), box[1])}
        for c, v in at.items():
            df = df.withColumn(c, F.explode(F.array(*[v + k for k in (-1, 0, 1)])) if around else v)
        return df

    near = F.abs(F.col("lng") - F.col("__x")) < (box or (0, 0))[0]
    near = near & (F.abs(F.col("lat") - F.col("__y")) < (box or (0, 0))[1]) if metres is None else geo.haversine(F.col("lng"), F.col("lat"), F.col("__x"), F.col("__y")) < metres
    places = points.where("lng IS NOT NULL AND lat IS NOT NULL").groupBy(*key, "lng", "lat").agg(F.min(F.struct(*order)).alias("o"))
    open_ = cut(celled(places))
    kept = [open_.limit(0).select(*key, "o", "lng", "lat")]
    for _ in range(rounds):
        firsts = open_.groupBy(*on).agg(F.min(F.struct("o", "lng", "lat")).alias("f")).select(*key, "f.*")
        others = open_.select(*on, F.col("o").alias("__o"), F.col("lng").alias("__x"), F.col("lat").alias("__y"))
        waits = celled(firsts, around=True).join(others, on).where(near & (F.col("__o") < F.col("o"))).select(*key, "o").distinct()
        now = cut(firsts.join(waits, [*key, "o"], "left_anti"))
        kept.append(now)
        gone = celled(now, around=True).join(others, on).where(near).select(*key, F.col("__o").alias("o")).distinct()
        open_ = cut(open_.join(gone, [*key, "o"], "left_anti"))
        if open_.isEmpty():
            break
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out.select(*key, "o.*", "lng", "lat")


#: Least size of a cell in degrees; cells a ring's box spans each way, at least half and at most one more, for plain rings and for those of
#: over PLAIN corners.
BASE, SPAN, LONG_SPAN, PLAIN = 0.0001, 2, 16, 64


def covered(areas: DataFrame) -> DataFrame:
    """(area_id, level, cx, cy, whole, the box, ring) for the cells of size BASE * 2 ** level that an area's box meets, the level being the one at which it
    spans few: a small or a huge ring has the same bounded number of rows. A ring of many corners has finer cells, of which those that it leaves out go, and
    those that no edge of it comes near are known to lie inside (`whole`); its rows have no ring."""
    long_ = F.size("ring") > PLAIN
    boxes = boxed(areas.select("area_id", "ring").where("size(ring) > 2")).withColumn("span", F.when(long_, LONG_SPAN).otherwise(SPAN))
    extent = F.greatest(F.col("max_lng") - F.col("min_lng"), F.col("max_lat") - F.col("min_lat"))
    boxes = boxes.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent / (BASE * F.col("span")), F.lit(1.0))))).cast("int"))
    size = F.lit(BASE) * F.pow(F.lit(2.0), F.col("level"))
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / F.col("size")).cast("long"), F.floor(F.col(hi) / F.col("size")).cast("long")))
    boxes = boxes.withColumn("size", size).withColumn("cx", cells("min_lng", "max_lng")).withColumn("cy", cells("min_lat", "max_lat"))
    slack = F.col("size") * 1e-6
    x0, y0, x1, y1 = F.col("cx") * F.col("size") - slack, F.col("cy") * F.col("size") - slack, (F.col("cx") + 1) * F.col("size") + slack, (F.col("cy") + 1) * F.col("size") + slack
    edges = F.zip_with("ring", F.concat(F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    meets = F.exists(edges, lambda e: (F.least(e["p"]["x"], e["q"]["x"]) <= x1) & (F.greatest(e["p"]["x"], e["q"]["x"]) >= x0) & (F.least(e["p"]["y"], e["q"]["y"]) <= y1) & (F.greatest(e["p"]["y"], e["q"]["y"]) >= y0))
    edge = F.when(F.size("ring") > PLAIN, meets).otherwise(True)
    within = F.when(edge, F.lit(True)).otherwise(geo.in_ring((x0 + x1) / 2, (y0 + y1) / 2, F.col("ring")))
    out = boxes.withColumns({"whole": ~edge, "some": within}).where("some")
    return out.select("area_id", "level", "cx", "cy", "whole", "min_lng", "max_lng", "min_lat", "max_lat", F.when(F.size("ring") <= PLAIN, F.col("ring")).alias("ring"))


def inside(points: DataFrame, areas: DataFrame) -> DataFrame:
    """points ⋈ areas (area_id, ring: array of (x, y), closed or not) whose ring holds the point.

    Each distinct place is looked up once, however many points stand there: the cells of `covered`, whose sizes fit the areas, meet the place's cell of each
    size that occurs; the box test is part of the join, places in `whole` cells are settled, and rays are cast for what is left, where rings of many corners
    are joined to the places that need them. Points with a null place and areas with a null or empty ring are in no pair."""
    cover = cut(covered(areas))
    levels = [r.level for r in cover.select("level").distinct().collect()]  # powers of two from BASE to the globe: some twenty
    places = points.where("lng IS NOT NULL AND lat IS NOT NULL").select(F.col("lng").alias("x"), F.col("lat").alias("y")).distinct()
    places = places.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")))
    size = F.lit(BASE) * F.pow(F.lit(2.0), F.col("level"))
    places = places.withColumns({"cx": F.floor(F.col("x") / size).cast("long"), "cy": F.floor(F.col("y") / size).cast("long")})
    met = places.join(cover, ["level", "cx", "cy"]).where("x BETWEEN min_lng AND max_lng AND y BETWEEN min_lat AND max_lat")
    plain = met.where(F.col("whole") | F.col("ring").isNotNull()).where(F.col("whole") | geo.in_ring(F.col("x"), F.col("y"), F.col("ring"))).select("x", "y", "area_id")
    open_ = met.where(~F.col("whole") & F.col("ring").isNull()).select("x", "y", "area_id")
    long_ = open_.join(areas.where(F.size("ring") > PLAIN).select("area_id", "ring"), "area_id").where(geo.in_ring(F.col("x"), F.col("y"), F.col("ring"))).select("x", "y", "area_id")
    found = plain.unionByName(long_)
    out = points.join(found, (F.col("lng") == F.col("x")) & (F.col("lat") == F.col("y"))).drop("x", "y")
    return out.join(areas.drop("ring"), "area_id") if len(areas.columns) > 2 else out


def places_inside(points: DataFrame, areas: DataFrame) -> DataFrame:
    """(lng, lat, area_id, n): for each distinct place of points that some area holds, the first such area and their number. Areas of the same ring are looked up once."""
    places = points.select("lng", "lat").distinct()
    rings = cut(areas.groupBy("ring").agg(F.min("area_id").alias("area_id"), F.count("*").alias("__k")))
    return inside(places, rings).groupBy("lng", "lat").agg(F.min("area_id").alias("area_id"), F.sum("__k").alias("n"))


def in_zones(points: DataFrame, zones: DataFrame, margin: float = 0.02) -> DataFrame:
    """The distinct places (lng, lat) of points that a zone holds: a ring, or a circle (lng, lat and metres). zones: zone_id, ring,
    lng, lat, metres; of each zone either the ring or the circle is null. Zones further than `margin` degrees from the box of
    all points are left aside first."""
    box = points.agg(*[f(c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("lng", "lat")])
    cover = zones.withColumns({"zx": F.coalesce("lng", F.element_at("ring", 1)["x"]), "zy": F.coalesce("lat", F.element_at("ring", 1)["y"])})
    near = cover.join(box, F.col("zx").between(F.col("lo_lng") - margin, F.col("hi_lng") + margin) & F.col("zy").between(F.col("lo_lat") - margin, F.col("hi_lat") + margin)).select("zone_id", "ring", "lng", "lat", "metres")
    places = points.select("lng", "lat").distinct()
    held = inside(places, near.where("ring IS NOT NULL").select(F.col("zone_id").alias("area_id"), "ring")).select("lng", "lat")
    # circles of a size class share cells of that size, so that one large circle doesn't coarsen the small ones' cells
    circles = near.where("ring IS NULL").select("zone_id", F.col("lng").alias("zlng"), F.col("lat").alias("zlat"), "metres")
    size = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest("metres", F.lit(1.0)))))
    circles = cut(circles.withColumn("size", size))
    sizes = [r["size"] for r in circles.select("size").distinct().collect()]  # powers of two from a metre to the globe
    probes = gridded(places.withColumn("size", F.explode(F.array(*[F.lit(k) for k in sizes]).cast("array<double>"))), "lng", "lat", F.col("size"), around=True)
    around = probes.join(gridded(circles, "zlng", "zlat", F.col("size")), ["size", "__cx", "__cy"])
    around = around.where(geo.haversine(F.col("lng"), F.col("lat"), F.col("zlng"), F.col("zlat")) <= F.col("metres")).select("lng", "lat")
    return held.unionByName(around).distinct()


#: High-level categories of map symbols: fixed ranges.
CATEGORIES = ((101, 199, "landforms"), (201, 299, "rocks"), (301, 399, "water"), (401, 499, "vegetation"), (501, 599, "man_made"))


def category(symbol: Column) -> Column:
    out = F.lit("other")
    for lo, hi, name in CATEGORIES:
        out = F.when(symbol.between(lo, hi), name).otherwise(out)
    return out


def category_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} BETWEEN {lo} AND {hi} THEN '{name}'" for lo, hi, name in CATEGORIES) + " ELSE 'other' END"


#: Colour classes of map symbols, the first range that fits: fixed ranges.
COLOURS = ((101, 199, "brown_relief"), (201, 299, "black_detail"), (301, 399, "blue_water"), (401, 402, "yellow_open"), (403, 403, "white_forest"), (404, 407, "green_light"), (408, 420, "green_dense"), (421, 499, "green_light"), (501, 599, "black_detail"))


def colour(symbol: Column) -> Column:
    out = F.lit("white_forest")
    for lo, hi, name in reversed(COLOURS):
        out = F.when(symbol.between(lo, hi), name).otherwise(out)
    return out


def colour_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} BETWEEN {lo} AND {hi} THEN '{name}'" for lo, hi, name in COLOURS) + " ELSE 'white_forest' END"
