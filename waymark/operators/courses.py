"""Leg, turn and rule metrics over ordered course controls. One shuffle by course serves all of an operator's windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import geo

DOGLEG, TURN_CLOSE, PARALLEL = 20.0, 60.0, 20.0


# Windows are made when asked for: they need a session, which importing must not.
def by_order() -> WindowSpec:
    return Window.partitionBy("course_id").orderBy("ord")


def whole() -> WindowSpec:
    return Window.partitionBy("course_id")


def legs(controls: DataFrame, crs: str = "wgs84") -> DataFrame:
    """controls with n, leg_in, leg_out, bearing_in, bearing_out, turn (0 is straight on), back (angle between the way in
    and the way out reversed: 0 is a dog-leg), position_ratio. Rows with a null place have null measures."""
    x, y = F.col("lng"), F.col("lat")
    px, py, nx, ny = F.lag(x).over(by_order()), F.lag(y).over(by_order()), F.lead(x).over(by_order()), F.lead(y).over(by_order())
    one = controls.withColumns({"px": px, "py": py, "nx": nx, "ny": ny, "n": F.count("*").over(whole()), "rn": F.row_number().over(by_order())})
    p, n = (F.col("px"), F.col("py"), x, y), (x, y, F.col("nx"), F.col("ny"))
    two = one.withColumns({"leg_in": geo.distance(*p, crs), "leg_out": geo.distance(*n, crs), "bearing_in": geo.bearing(*p), "bearing_out": geo.bearing(*n)})
    return two.withColumns({
        "turn": geo.between(F.col("bearing_in"), F.col("bearing_out")),
        "back": geo.between(F.col("bearing_in"), F.pmod(F.col("bearing_out") + 180, F.lit(360.0))),
        "position_ratio": (F.col("rn") - 1) / F.greatest(F.lit(1), F.col("n") - 1),
    }).withColumns({
        # ends and legs of no length have no direction to compare
        "turn": F.when(F.col("leg_in").isNotNull() & F.col("leg_out").isNotNull(), F.col("turn")),
        "back": F.when(F.col("leg_in").isNotNull() & F.col("leg_out").isNotNull(), F.col("back")),
    }).drop("px", "py", "nx", "ny")


def point_type(rn: str = "rn", n: str = "n") -> Column:
    return F.when(F.col(rn) == 1, "start").when(F.col(rn) == F.col(n), "finish").otherwise("control")


def grade_td(longest: Column) -> Column:
    return F.when(longest.isNull() | (longest <= 200), 1).when(longest <= 350, 2).when(longest <= 700, 3).when(longest <= 1500, 4).otherwise(5)


def grade_pd(climb: Column, length: Column) -> Column:
    r = climb / F.when(length > 0, length)
    return F.when(r.isNull() | (r < 0.01), 1).when(r < 0.02, 2).when(r < 0.04, 3).when(r < 0.06, 4).otherwise(5)


def climb(controls: DataFrame) -> DataFrame:
    """Per course climb and descent against the last elevation that isn't null."""
    before = F.last("ele", ignorenulls=True).over(by_order().rowsBetween(Window.unboundedPreceding, -1))
    step = controls.withColumn("step", F.col("ele") - before)
    return step.groupBy("course_id").agg(
        F.coalesce(F.sum(F.greatest("step", F.lit(0.0))), F.lit(0.0)).alias("climb"), F.coalesce(F.sum(F.greatest(-F.col("step"), F.lit(0.0))), F.lit(0.0)).alias("descent"), F.count("ele").alias("n_ele"),
    )


def summary(controls: DataFrame) -> DataFrame:
    """One row per course: what length, balance, turns and closeness come to."""
    has = lambda c: F.count_if(c)
    t, d = F.col("turn"), F.col("leg_in")
    agg = legs(controls).groupBy("course_id").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("leg_in"), F.lit(0.0)).alias("length"), F.max("leg_in").alias("longest"), F.min("leg_in").alias("shortest"), F.avg("leg_in").alias("mean_leg"),
        F.coalesce(F.stddev_pop("leg_in"), F.lit(0.0)).alias("std_leg"), has(t.between(30, 150)).alias("good_turns"), F.count("turn").alias("turns"),
        has(t < 25).alias("straight25"), has(t < 15).alias("straight15"), has(F.col("back") < DOGLEG).alias("doglegs20"), has(F.col("back") < 25).alias("doglegs25"),
        has(d < 15).alias("under15"), has(d < 20).alias("under20"), has(d < 30).alias("under30"), has(d < 60).alias("under60"), has(d > 400).alias("over400"),
        has(t < PARALLEL).alias("parallel"),
    )
    return agg.join(climb(controls), "course_id")


def quality_xml(s: DataFrame, min_leg: int = 60) -> Column:
    """Balance and turns in percent, less capped penalties; 50 for fewer than three controls."""
    cv = F.col("std_leg") / F.when(F.col("mean_leg") > 0, F.col("mean_leg"))
    balance = F.greatest(F.lit(0.0), 100 - cv * 200)
    variety = F.col("good_turns") / F.greatest(F.lit(1), F.col("n") - 2) * 100
    fine = F.least(F.lit(40), F.col("straight25") * 10) + F.least(F.lit(30), F.col(f"under{min_leg}") * 15)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), balance * 0.4 + variety * 0.6 - fine))
    return F.when((F.col("n") < 3) | (F.col("mean_leg") == 0), 50.0).otherwise(score)


def quality_gpx() -> Column:
    """The other form, 0 to 1: uncapped penalties; 0.5 for fewer than three controls."""
    cv = F.col("std_leg") / F.greatest("mean_leg", F.lit(1.0))
    variety = F.col("good_turns") / F.greatest(F.lit(1), F.col("n") - 2)
    score = (F.greatest(F.lit(0.0), 1 - cv) * 0.4 + variety * 0.6) * 100 - F.col("straight15") * 8 - F.col("under15") * 10
    return F.when(F.col("n") < 3, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)) / 100)


def compliance(climb_ratio: Column) -> Column:
    fine = F.when(climb_ratio > 0.06, 30).when(climb_ratio > 0.04, 20).otherwise(0)
    return fine + F.least(F.lit(40), F.col("doglegs25") * 10) + F.least(F.lit(30), F.col("under60") * 15)


def issues(controls: DataFrame, least: int = 12, most: int = 28, target: tuple[float, float] = (12.0, 15.0), speed: float = 3.5, max_climb: float = 3.0) -> DataFrame:
    """Rule findings, one row each: course_id, code, severity, ord (-1: the whole course). Legs are told by the control
    that they lead to, triples by their middle. Courses of fewer than two controls have C00 alone."""
    l = legs(controls)  # noqa: E741
    rule = lambda when, code, severity, at: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), at.alias("ord")))
    at = F.col("ord")
    by_leg = l.where("n >= 2").select("course_id", F.explode(F.array_compact(F.array(
        rule(F.col("back") < DOGLEG, "C01", "ERROR", at), rule(F.col("leg_in") < 30, "C02", "ERROR", at), rule(F.col("leg_in") > 400, "C03", "WARNING", at),
        rule(F.col("leg_in") < 30, "C04", "WARNING", at), rule(F.col("turn") < PARALLEL, "C12", "WARNING", at),
    ))).alias("i")).select("course_id", "i.*")
    whole, s = F.lit(-1), summary(controls)
    count, minutes = F.greatest(F.col("n") - 2, F.lit(0)), F.col("length") / speed / 60
    pct = F.col("climb") / F.when(F.col("length") > 0, F.col("length")) * 100
    by_course = s.select("course_id", F.explode(F.array_compact(F.array(
        rule(F.col("n") < 2, "C00", "ERROR", whole), rule((F.col("n") >= 2) & ((count < least) | (count > most)), "C05", "WARNING", whole),
        rule((F.col("n") >= 2) & ((minutes < target[0] * 0.8) | (minutes > target[1] * 1.2)), "C06", "WARNING", whole),
        rule((F.col("n") >= 2) & (F.col("n_ele") >= 2) & (pct > max_climb), "C07", "WARNING", whole),
    ))).alias("i")).select("course_id", "i.*")
    return by_leg.unionByName(by_course)


def report(controls: DataFrame, *more: DataFrame) -> DataFrame:
    """Per course: errors, warnings, score 100 - 15 errors - 5 warnings (not below 0), compliant; clean courses too. `more` are findings of other rules
    (course_id, severity), such as those of forbidden ground, of features and of route choice."""
    rows = issues(controls).select("course_id", "severity")
    for m in more:
        rows = rows.unionByName(m.select("course_id", "severity"))
    found = rows.groupBy("course_id").agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARNING").alias("warnings"))
    out = controls.select("course_id").distinct().join(found, "course_id", "left").fillna(0, ["errors", "warnings"])
    return out.withColumn("score", F.greatest(F.lit(0), 100 - 15 * F.col("errors") - 5 * F.col("warnings"))).withColumn("compliant", F.col("errors") == 0)


def longest_run(controls: DataFrame, angle: float = 60.0) -> DataFrame:
    """Longest run of successive legs that turn by less than an angle, and its score."""
    l = legs(controls).where("leg_out IS NOT NULL")  # noqa: E741
    cut = l.withColumn("run", F.sum(F.when(F.col("turn") < angle, 0).otherwise(1)).over(by_order()))
    runs = cut.groupBy("course_id", "n", "run").count().groupBy("course_id", "n").agg(F.max("count").alias("longest_run"))
    r = F.col("longest_run")
    score = F.when(F.col("n") < 4, 75.0).when(r <= 2, 100.0).when(r == 3, 70.0).when(r == 4, 40.0).otherwise(F.greatest(F.lit(0.0), 40.0 - (r - 4) * 15.0))
    return runs.select("course_id", "longest_run", score.alias("score"))


def longest_run_plain(controls: DataFrame, angle: float = 60.0) -> DataFrame:
    """As longest_run, with bearings of plain coordinates: what the default fitness uses."""
    w = by_order()
    b = F.pmod(F.degrees(F.atan2(F.lead("lng").over(w) - F.col("lng"), F.lead("lat").over(w) - F.col("lat"))), F.lit(360.0))
    l = controls.withColumns({"n": F.count("*").over(whole()), "b": b}).where("b IS NOT NULL")  # noqa: E741
    turn = geo.between(F.lag("b").over(w), F.col("b"))
    runs = l.withColumn("brk", F.when(turn < angle, 0).otherwise(1)).withColumn("run", F.sum("brk").over(w)).groupBy("course_id", "n", "run").count().groupBy("course_id", "n").agg(F.max("count").alias("r"))
    r = F.col("r")
    score = F.when(F.col("n") < 4, 75.0).when(r <= 2, 100.0).when(r == 3, 70.0).when(r == 4, 40.0).otherwise(F.greatest(F.lit(0.0), 40.0 - (r - 4) * 15.0))
    found = runs.select("course_id", score.alias("score"))
    return controls.select("course_id").distinct().join(found, "course_id", "left").select("course_id", F.coalesce("score", F.lit(75.0)).alias("score"))


def alternation(controls: DataFrame) -> DataFrame:
    """Share of changes between short and long among the legs that are neither near the mean."""
    l = legs(controls).where("leg_in IS NOT NULL").withColumn("mean", F.avg("leg_in").over(whole()))  # noqa: E741
    kind = F.when(F.col("leg_in") < F.col("mean") * 0.8, "C").when(F.col("leg_in") > F.col("mean") * 1.2, "L")
    k = l.withColumn("kind", kind).where("kind IS NOT NULL AND n >= 4").withColumn("last", F.lag("kind").over(by_order()))
    out = k.groupBy("course_id").agg((F.count_if(F.col("last") != F.col("kind")) / F.when(F.count("*") > 1, F.count("*") - 1) * 100.0).alias("s"))
    return controls.select("course_id").distinct().join(out, "course_id", "left").select("course_id", F.coalesce("s", F.lit(75.0)).alias("score"))
