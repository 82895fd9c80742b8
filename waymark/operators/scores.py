"""Features and scores of courses: what stands near a control, terrain, fitness. Places are looked up once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.classes import first
from . import courses, spatial

# How good a place of each type is for a control, and what the type is called; other types and no type at all.
ATTRACTIVENESS = {"intersection": 0.90, "building_corner": 0.80, "steps": 0.95, "barrier_point": 0.80, "urban_landmark": 0.85, "urban_amenity": 0.75, "amenity": 0.75, "path": 0.60}
FEATURE_TYPES = {"intersection": "street_intersection", "building_corner": "building_corner", "steps": "steps", "barrier_point": "barrier_point", "urban_landmark": "urban_landmark", "urban_amenity": "urban_amenity", "amenity": "urban_amenity", "path": "path"}
OTHER, NOTHING = 0.5, 0.3
# Weights of a course's parts; with a model's score they count four fifths.
WEIGHTS = {"length": 0.20, "climb": 0.15, "control_distance": 0.15, "variety": 0.20, "balance": 0.15, "safety": 0.15}
FOREST = {"length": 0.18, "climb": 0.10, "td": 0.11, "angle": 0.15, "equity": 0.13, "safety": 0.08, "terrain": 0.10, "monotony": 0.08, "alternation": 0.07}
SPRINT = {"length": 0.22, "sprint_leg": 0.15, "td": 0.11, "angle": 0.17, "equity": 0.07, "safety": 0.05, "terrain": 0.10, "monotony": 0.07, "alternation": 0.06}
#: Parts that are whole numbers: of WEIGHTS, and of FOREST and SPRINT.
WHOLE, WHOLE_FITNESS = ("length", "climb", "control_distance", "balance", "safety"), ("equity", "safety", "monotony", "sprint_leg")


def looked_up(table: dict, key: Column, otherwise) -> Column:
    return first([(key == k, v) for k, v in table.items()], otherwise)


def spots(candidates: DataFrame, *more: Column) -> DataFrame:
    """One row a place (lng, lat) of candidates: `one`, its first (cand_id, ftype), and more aggregates; copies of a place are compared once."""
    return candidates.groupBy("lng", "lat").agg(F.min(F.struct("cand_id", "ftype")).alias("one"), *more)


def surroundings(places: DataFrame, candidates: DataFrame, radius: float = 75.0, paths: tuple = ("path",)) -> DataFrame:
    """Per distinct place (lng, lat): density (candidates within the radius), feature_type and attractiveness of the nearest (ties:
    smallest cand_id), path_metres to the nearest path within the radius. Places with nothing near have 0, unknown, 0.3, null."""
    here = places.select("lng", "lat").distinct()
    path = F.coalesce(F.max(F.col("ftype").isin(*paths)), F.lit(False))
    near = spatial.radius_pairs(here, spots(candidates, F.count("*").alias("k"), path.alias("path")), radius).withColumn("metres", F.round("metres", 3))
    found = near.groupBy("lng", "lat").agg(
        F.sum("k").alias("density"), F.min(F.struct("metres", "one.cand_id", "one.ftype")).alias("z"), F.min(F.when(F.col("path"), F.col("metres"))).alias("path_metres"),
    )
    kind = F.col("z.ftype")
    return here.join(found, ["lng", "lat"], "left").select(
        "lng", "lat", F.coalesce("density", F.lit(0)).alias("density"), F.when(kind.isNull(), "unknown").otherwise(looked_up(FEATURE_TYPES, kind, "unknown")).alias("feature_type"),
        F.when(kind.isNull(), NOTHING).otherwise(looked_up(ATTRACTIVENESS, kind, OTHER)).alias("attractiveness"), "path_metres",
    )


def nearest_any(places: DataFrame, targets: DataFrame, by: str, base: float = 50.0, levels: int = 12) -> DataFrame:
    """Per distinct place (lng, lat) the nearest target at any distance: `by` (ties: smallest) and metres.

    Grids of doubling size (base * 2 ** level metres) hold one target of each cell. The nearest of those in the 3 x 3 cells about a place, over all sizes,
    bounds the distance; all targets of the cells of the least size that is no smaller are compared then. Beyond the coarsest size's neighbouring cells
    nothing is found. Cells are as wide as their latitude asks, up to the poles and across 180 degrees."""
    spots = targets.where("lng IS NOT NULL AND lat IS NOT NULL").groupBy(F.col("lng").alias("x"), F.col("lat").alias("y")).agg(F.min(by).alias(by))
    here = places.where("lng IS NOT NULL AND lat IS NOT NULL").select("lng", "lat").distinct()
    metres = F.lit(base) * F.pow(F.lit(2.0), F.col("level"))
    far = geo.haversine(F.col("lng"), F.col("lat"), F.col("x"), F.col("y"))
    cells = spatial.gridded(spots.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels + 4)))), "x", "y", metres)
    one = cells.where(F.col("level") <= levels).groupBy("level", "__cx", "__cy").agg(F.min(F.struct("x", "y")).alias("z")).select("level", "__cx", "__cy", "z.x", "z.y")
    seen = spatial.gridded(here.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))), "lng", "lat", metres, around=True).join(one, ["level", "__cx", "__cy"])
    bound = seen.groupBy("lng", "lat").agg(F.min(far).alias("m"))
    level = F.greatest(F.lit(0), F.least(F.lit(levels + 4), F.ceil(F.log2(F.greatest("m", F.lit(1e-3)) / base * 1.000001)).cast("int")))
    pairs = spatial.gridded(bound.select("lng", "lat", level.alias("level")), "lng", "lat", metres, around=True).join(cells, ["level", "__cx", "__cy"]).withColumn("metres", far)
    return pairs.groupBy("lng", "lat").agg(F.min(F.struct(F.round("metres", 3).alias("metres"), F.col(by))).alias("z")).select("lng", "lat", F.col(f"z.{by}").alias(by), "z.metres")


def heat_lookup(places: DataFrame, heat: DataFrame, box: tuple[float, float, float, float], width: int, height: int) -> DataFrame:
    """Per distinct place (lng, lat) the score between the four cells about it (gx, gy, score; rows count from the top; absent
    cells are 0): each cell counts by how near it is, edges hold on outside. A box without extent scores 0.45 everywhere."""
    x0, y0, x1, y1 = box
    here = places.select("lng", "lat").distinct()
    if x0 == x1 or y0 == y1:
        return here.withColumn("score", F.lit(0.45))
    gx, gy = (F.col("lng") - x0) / (x1 - x0) * width, (1 - (F.col("lat") - y0) / (y1 - y0)) * height
    whole = lambda g: F.when(g < 0, F.ceil(g)).otherwise(F.floor(g))
    clamp = lambda g, n: F.greatest(F.lit(0), F.least(whole(g), F.lit(n - 1)))
    corner = lambda right, down: F.struct(
        F.lit(2 * down + right).alias("k"), F.least(clamp(gx, width) + right, F.lit(width - 1)).cast("long").alias("gx"), F.least(clamp(gy, height) + down, F.lit(height - 1)).cast("long").alias("gy"),
        (gx - whole(gx) if right else 1 - (gx - whole(gx))).alias("wx"), (gy - whole(gy) if down else 1 - (gy - whole(gy))).alias("wy"),
    )
    four = here.select("lng", "lat", F.explode(F.array(*[corner(r, d) for d in (0, 1) for r in (0, 1)])).alias("c")).select("lng", "lat", "c.*")
    value = F.coalesce("score", F.lit(0.0)) * F.col("wx") * F.col("wy")
    # added in a fixed order, so that the last digits are the same in each run
    found = four.join(heat, ["gx", "gy"], "left").groupBy("lng", "lat").agg(*[F.max(F.when(F.col("k") == k, value)).alias(f"v{k}") for k in range(4)])
    return found.select("lng", "lat", (F.col("v0") + F.col("v1") + F.col("v2") + F.col("v3")).alias("score"))


def terrain_quality(controls: DataFrame, candidates: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """Per course the mean, in percent, of its middle controls' terrain: 1 by an intersection within 60 m, 0.45 by anything else,
    0.15 by nothing; where model (lng, lat, score) has a score, that counts three fifths. Courses of fewer than three: 50. Metres are rounded to
    millimetres first, and a course's controls are added up in their order, so that the last digits are the same however the tables were joined."""
    near = spatial.radius_pairs(controls.select("lng", "lat").distinct(), spots(candidates), 60.0).withColumn("metres", F.round("metres", 3)).where("metres < 60")
    best = near.groupBy("lng", "lat").agg(F.min(F.struct("metres", "one.cand_id", "one.ftype")).alias("z")).select("lng", "lat", F.when(F.col("z.ftype") == "intersection", 1.0).otherwise(0.45).alias("att"))
    c = controls.join(best, ["lng", "lat"], "left").withColumn("att", F.coalesce("att", F.lit(0.15)))
    if model is not None:
        c = c.join(model.withColumnRenamed("score", "ml"), ["lng", "lat"], "left").withColumn("att", F.when(F.col("ml").isNull(), F.col("att")).otherwise(F.col("att") * 0.4 + F.col("ml") * 0.6))
    c = c.withColumns({"rn": F.row_number().over(courses.by_order()), "n": F.count("*").over(courses.whole())})
    middle, so_far = F.when((F.col("rn") > 1) & (F.col("rn") < F.col("n")), F.col("att")), courses.by_order().rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumns({"total": F.sum(middle).over(so_far), "k": F.count(middle).over(so_far)}).where("rn = n")
    return c.select("course_id", (F.when(F.col("k") > 0, F.col("total") / F.col("k")).otherwise(0.5) * 100).alias("terrain"))


def shape(controls: DataFrame, interior: float = 60.0) -> DataFrame:
    """Per course what only plain coordinates give: variety (variance of unwrapped turns), balance (cv of straight lengths in
    degrees), sharp (interior angles below a threshold); null where a course is too short."""
    w = courses.by_order()
    c = controls.withColumns({"px": F.lag("lng").over(w), "py": F.lag("lat").over(w), "nx": F.lead("lng").over(w), "ny": F.lead("lat").over(w)})
    x, y = F.col("lng"), F.col("lat")
    ax, ay, bx, by = F.col("px") - x, F.col("py") - y, F.col("nx") - x, F.col("ny") - y
    norms = F.hypot(ax, ay) * F.hypot(bx, by)
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / norms))))
    turn = F.abs(F.atan2(by, bx) - F.atan2(y - F.col("py"), x - F.col("px")))
    sharp = (F.hypot(ax, ay) >= 1e-10) & (F.hypot(bx, by) >= 1e-10) & (angle < interior)
    d = F.hypot(ax, ay)
    return c.groupBy("course_id").agg(
        F.var_pop(F.when(F.col("px").isNotNull() & F.col("nx").isNotNull(), turn)).alias("variety"),
        (F.stddev_pop(d) / F.when(F.avg(d) > 0, F.avg(d))).alias("cv"), F.count_if(F.coalesce(sharp, F.lit(False))).alias("sharp"),
    )


def target_length(ratio: Column) -> Column:
    """100 within 15 % of the target; further off it falls by 2 a percent, without a floor."""
    return F.when(ratio.between(0.85, 1.15), 100.0).otherwise(100.0 - (F.abs(ratio - 1) - 0.15) * 200)


def climb_share(ratio: Column) -> Column:
    return first([(ratio <= 0.04, 100.0)], F.when(ratio <= 0.06, 60.0 - (ratio - 0.04) * 1500).otherwise(F.greatest(F.lit(0.0), 30.0 - (ratio - 0.06) * 1000)))


def leg_spread(cv: Column) -> Column:
    return F.when(cv.between(0.2, 0.5), 100.0).when(cv < 0.2, 40.0 + cv * 300).otherwise(F.greatest(F.lit(0.0), 100.0 - (cv - 0.5) * 150))


def half_away(value: Column, digits: int) -> Column:
    """value rounded as the SQL does it: times a power of ten, to the nearest whole number, halves away from zero, and divided again. F.round goes by the shortest
    decimal notation instead, which differs where value lies next to the middle of two results, as sums of fixed parts do."""
    return F.round(value * 10.0**digits, 0) / 10.0**digits


def weighted(weights: dict[str, float], whole: tuple[str, ...] = ()) -> Column:
    """The parts times their weights, added in order. Parts that are whole numbers are weighed in hundredths, which is exact, and divided once they
    meet another: as the SQL's decimals do, where 3 times 0.07 is 0.21."""
    total, exact = None, None
    for name, w in weights.items():
        if name not in whole:
            term = F.col(name) * w
        elif total is None:
            exact = F.col(name) * round(w * 100) if exact is None else exact + F.col(name) * round(w * 100)
            continue
        else:
            term = F.col(name) * round(w * 100) / 100.0
        total = (term if exact is None else exact / 100.0 + term) if total is None else total + term
    return exact / 100.0 if total is None else total


def clusters(controls: DataFrame, radius: float, size: int) -> DataFrame:
    """Per course the groups of controls that disorient: in order, a control that is in no group yet opens one if `size` controls,
    itself included, stand within the radius and are in none; the first `size` of them are in it. A course is folded as one
    array: courses are short."""
    at = F.array_sort(F.collect_list(F.struct("ord", "lng", "lat")))
    near = lambda p, a, i: F.concat(F.array(i), F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda j: (j != i) & ~F.array_contains(a, j) & (geo.haversine(F.get(p, i)["lng"], F.get(p, i)["lat"], F.get(p, j)["lng"], F.get(p, j)["lat"]) <= radius)))

    def step(a: Column, i: Column) -> Column:
        group = F.transform(F.array(near(F.col("p"), a["used"], i)), lambda g: F.when(~F.array_contains(a["used"], i) & (F.size(g) >= size), F.struct(F.concat(a["used"], F.slice(g, 1, size)).alias("used"), (a["n"] + 1).alias("n"))).otherwise(a))
        return F.element_at(group, 1)

    start = F.struct(F.array().cast("array<int>").alias("used"), F.lit(0).alias("n"))
    return controls.groupBy("course_id").agg(at.alias("p")).select("course_id", F.aggregate(F.sequence(F.lit(0), F.size("p") - 1), start, step, lambda a: a["n"]).alias("clusters"))


def fitness_parts(controls: DataFrame, candidates: DataFrame, target: float, climb: float, count: int, dogleg: float, separation: float, longest: float, model: DataFrame | None = None) -> DataFrame:
    """Per course the criteria of the default fitness, 0 to 100 each (length may fall below)."""
    s = courses.summary(controls)
    w = courses.by_order()
    c = controls.withColumns({"px": F.lag("lng").over(w), "py": F.lag("lat").over(w), "nx": F.lead("lng").over(w), "ny": F.lead("lat").over(w)})
    turn = F.pmod(F.abs(F.degrees(F.atan2(F.col("ny") - F.col("lat"), F.col("nx") - F.col("lng")) - F.atan2(F.col("lat") - F.col("py"), F.col("lng") - F.col("px")))), F.lit(360.0))
    turn = F.least(turn, 360 - turn)
    plain = c.groupBy("course_id").agg(F.count_if(F.coalesce(turn.between(30, 150), F.lit(False))).alias("good"), F.count_if(F.coalesce(turn < dogleg, F.lit(False))).alias("straight"))
    over = courses.legs(controls).groupBy("course_id").agg(F.count_if(F.col("leg_in") > longest).alias("over"))
    out = s.join(plain, "course_id").join(over, "course_id").join(spatial.close_counts(controls, separation), "course_id").join(terrain_quality(controls, candidates, model), "course_id")
    runs, turns = courses.longest_run_plain(controls), courses.alternation(controls)
    out = out.join(runs.select("course_id", F.col("score").alias("monotony")), "course_id").join(turns.select("course_id", F.col("score").alias("alternation")), "course_id")
    cv, n = F.col("std_leg") / F.when(F.col("mean_leg") > 0, F.col("mean_leg")), F.col("n")
    return out.where("n >= 2").select(
        "course_id", F.when(F.col("length") > 0, target_length(F.col("length") / target)).otherwise(75.0).alias("length"),
        F.when(F.col("length") > 0, climb_share(climb / F.col("length"))).otherwise(75.0).alias("climb"), F.coalesce(leg_spread(cv), F.lit(50.0)).alias("td"),
        F.when(n >= 3, 100.0 * F.col("good") / (n - 2)).otherwise(50.0).alias("angle"), F.greatest(F.lit(0.0), 100.0 - F.col("straight") * 15 - F.col("close") * 20).alias("equity"),
        F.greatest(F.lit(0.0), 100.0 - F.abs(n - count) * 10).alias("safety"), "terrain", "monotony", "alternation", F.greatest(F.lit(0.0), 100.0 - F.col("over") * 25).alias("sprint_leg"),
    )


def score(parts: DataFrame, fitness: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """(course_id, fitness) from criteria (fitness_parts, or any columns beside course_id): by the forest weights, or as a function of the user's says. It gets the
    criteria and returns a column expression, which stays in the plan; null counts as 0."""
    value = weighted(FOREST, WHOLE_FITNESS) if fitness is None else fitness(parts)
    return parts.select("course_id", F.coalesce(value.cast("double"), F.lit(0.0)).alias("fitness"))
