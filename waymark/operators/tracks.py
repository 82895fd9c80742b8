"""GPS tracks: speeds, snapping to controls, thinning, cells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import geo
from .folds import SLICE, Out, Row, State, fold
from .spatial import radius_pairs
from .tables import cut


def by_seq() -> WindowSpec:
    return Window.partitionBy("track_id").orderBy("seq")


def steps(points: DataFrame) -> DataFrame:
    """points with metres and seconds since the point before."""
    px, py, pt = (F.lag(c).over(by_seq()) for c in ("lng", "lat", "t_s"))
    one = points.withColumns({"px": px, "py": py, "pt": pt})
    return one.withColumn("metres", geo.haversine(F.col("px"), F.col("py"), F.col("lng"), F.col("lat"))).withColumn("seconds", F.col("t_s") - F.col("pt")).drop("px", "py", "pt")


def valid_speed(metres: str = "metres", seconds: str = "seconds", least: float = 5.0):
    speed = F.col(metres) / F.when(F.col(seconds) > 0, F.col(seconds)) * 60
    return F.when((F.col(metres) >= least) & speed.between(50, 400), speed)


#: Points of a slice of a track, about, in snap.
SNAP_SLICE = 65_536


def snap(points: DataFrame, controls: DataFrame, radius: float, size: int = SNAP_SLICE) -> DataFrame:
    """Per track and control the nearest point at or after the one before's (first of equals); tracks that miss a control
    by more than the radius are left out. Controls are the few of one course: one round each.

    Only points within the radius of a control can be its own. They lie in slices of `size` numbers of a track; each slice gives its best point per
    control, and a round hands on one position a track: the best of the later slices, and of the position's own slice the points from there on. No
    row or task holds a track; a long one's slices are joined apart."""
    near = radius_pairs(points.select("track_id", "seq", "lng", "lat"), controls.select("ord", "lng", "lat"), radius)
    hits = cut(near.select("track_id", "ord", "seq", "metres", F.floor(F.col("seq") / size).cast("long").alias("slice")))
    best = F.min(F.struct("metres", "seq"))
    slices = cut(hits.groupBy("track_id", "ord", "slice").agg(best.alias("b")))
    rounds: list[DataFrame] = []
    for ord_ in [r.ord for r in controls.select("ord").distinct().orderBy("ord").collect()]:
        here, there = hits.where(F.col("ord") == ord_), slices.where(F.col("ord") == ord_)
        if rounds:
            at = rounds[-1].select("track_id", F.floor(F.col("seq") / size).cast("long").alias("s"), F.col("seq").alias("from"))
            here = here.join(at.withColumnRenamed("s", "slice"), ["track_id", "slice"]).where("seq >= from").select("track_id", F.struct("metres", "seq").alias("b"))
            there = there.join(at, "track_id").where("slice > s").select("track_id", "b")
            there = here.unionByName(there)
        rounds.append(cut(there.groupBy("track_id").agg(F.min("b").alias("b")).select("track_id", F.lit(ord_).cast("int").alias("ord"), F.col("b.seq").cast("int").alias("seq"), "b.metres")))
    if not rounds:
        return hits.limit(0).select("track_id", F.col("ord").cast("int"), F.col("seq").cast("int"), "metres")
    whole = rounds[-1].select("track_id")
    out = rounds[-1]
    for r in rounds[:-1]:
        out = out.unionByName(r.join(whole, "track_id", "left_semi"))
    return out


def leg_runs(points: DataFrame, snapped: DataFrame) -> DataFrame:
    """Per track and leg the metres run and the seconds between two snapped points."""
    w = Window.partitionBy("track_id").orderBy("ord")
    ends = snapped.select("track_id", "ord", F.lag("seq").over(w).alias("i"), F.col("seq").alias("j")).where("i IS NOT NULL")
    run = steps(points).join(ends, "track_id").where("seq > i AND seq <= j")
    return run.groupBy("track_id", F.col("ord").alias("leg")).agg(F.sum("metres").alias("metres"), F.sum("seconds").alias("seconds"))


def _metres(x1: float, y1: float, x2: float, y2: float) -> float:
    """geo.haversine of four numbers."""
    a = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * geo.EARTH_M * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def _bearing(x1: float, y1: float, x2: float, y2: float) -> float:
    """geo.bearing of four numbers."""
    dx, a, b = math.radians(x2 - x1), math.radians(y1), math.radians(y2)
    return math.degrees(math.atan2(math.sin(dx) * math.cos(b), math.cos(a) * math.sin(b) - math.sin(a) * math.cos(b) * math.cos(dx))) % 360


#: Marks of a fold's rows: kept, and among the first of their track.
KEPT, EARLY = 1, 0


def _with_ends(points: DataFrame, picked: DataFrame, few: int, fields: list[str]) -> DataFrame:
    """Rows that a fold kept, the last of each track, and all rows of tracks of up to `few`. A fold marks the first few rows of a track that it doesn't
    keep as EARLY; so each side of the join has a bounded number of rows a track."""
    ends = points.groupBy("track_id").agg(F.count("*").alias("n"), F.max(F.struct("seq", *fields)).alias("z"))
    early = picked.where(F.col("mark") == EARLY).join(ends.where(F.col("n") <= few).select("track_id"), "track_id", "left_semi")
    rows = picked.where(F.col("mark") == KEPT).unionByName(early).select("track_id", F.col("seq").cast("int").alias("seq"), *fields)
    last = ends.select("track_id", F.col("z.seq").cast("int").alias("seq"), *[F.col(f"z.{f}").cast("double").alias(f) for f in fields])
    return rows.unionByName(last).groupBy("track_id", "seq").agg(*[F.first(f).alias(f) for f in fields])


def thin(points: DataFrame, metres: float = 50.0, few: int = 15, size: int = SLICE) -> DataFrame:
    """Points at least so far from the last one kept; the first and last always; short tracks stay whole. A fold in slices: the state is the last
    point kept and how many points of the track were seen, up to `few`."""

    def start(row: Row) -> tuple[State, Out]:
        return (row[1][0], row[1][1], 1.0), [(row, KEPT)]

    def step(state: State, row: Row) -> tuple[State, Out]:
        x, y, seen = state
        now = min(seen + 1, few + 1.0)
        if _metres(x, y, row[1][0], row[1][1]) >= metres:
            return (row[1][0], row[1][1], now), [(row, KEPT)]
        return (x, y, now), [(row, EARLY)] if now <= few else []

    fields = ["lng", "lat", "t_s"]
    return _with_ends(points, fold(points, "track_id", "seq", fields, start, step, size), few, fields)


def key_points(points: DataFrame, most: int = 15, metres: float = 80.0, turn: float = 25.0, size: int = SLICE) -> DataFrame:
    """Up to `most` points of each track: the first, then those at least so far from the last one kept where the way there and the
    way on differ by more than an angle, and always the last point; tracks of no more points stay whole. A fold in slices: the state is the last
    point kept, how many were kept, how many seen (up to `most`), and the point whose way on isn't known yet."""

    def start(row: Row) -> tuple[State, Out]:
        x, y = row[1]
        return (x, y, 1.0, 1.0, math.nan, math.nan, 0.0), [(row, KEPT)]

    def step(state: State, row: Row) -> tuple[State, Out]:
        x, y, kept, seen, px, py, at = state
        out: Out = []
        if kept < most and px == px and _metres(x, y, px, py) >= metres:
            d = abs(_bearing(x, y, px, py) - _bearing(px, py, *row[1])) % 360
            if min(d, 360 - d) > turn:
                x, y, kept = px, py, kept + 1
                out.append(((int(at), (px, py)), KEPT))
        if kept >= most:
            x, y = 0.0, 0.0  # nothing hangs on them any more
        now = min(seen + 1, most + 1.0)
        if now <= most:
            out.append((row, EARLY))
        return (x, y, kept, now, *row[1], float(row[0])), out

    fields = ["lng", "lat"]
    return _with_ends(points, fold(points, "track_id", "seq", fields, start, step, size), most, fields)


def cells(points: DataFrame, step: float) -> DataFrame:
    return points.withColumns({"gx": F.bround(F.col("lng") / step, 0).cast("long"), "gy": F.bround(F.col("lat") / step, 0).cast("long")})
