"""Street graphs as tables of edges (area_id, src, dst, weight); nodes are columns of one type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, the lightest of parallel ones, without loops."""
    e = edges.where("src <> dst").select("area_id", "src", "dst", "weight")
    return e.unionByName(e.select("area_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("area_id", "src", "dst").agg(F.min("weight").alias("weight"))


def distances(edges: DataFrame, sources: DataFrame, rounds: int = 1000, both: bool = True) -> DataFrame:
    """(area_id, source, node, metres): the shortest way from each source (area_id, source) to each node it reaches, for all
    sources at once. Each round extends only labels that the round before improved; it ends when none improves. Nodes that
    can't be reached have no row. Without `both`, edges are taken as they are, in one direction each."""
    e = (cut(both_ways(edges)) if both else edges).select("area_id", F.col("src").alias("node"), F.col("dst").alias("y"), "weight")
    key = ["area_id", "source", "node"]
    front = cut(sources.select("area_id", "source", F.col("source").alias("node"), F.lit(0.0).alias("metres")).distinct())

    def hop(labels: DataFrame) -> DataFrame:
        on = labels.join(e, ["area_id", "node"]).groupBy("area_id", "source", F.col("y").alias("node"))
        return on.agg(F.min(F.col("metres") + F.col("weight")).alias("metres"))

    return _settled(front, key, hop, rounds)


#: Tables of labels that are looked through before they are merged.
LEVELS = 8


def _merged(levels: list[DataFrame], key: list[str]) -> DataFrame:
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.groupBy(*key).agg(F.min("metres").alias("metres"))


def _settled(front: DataFrame, key: list[str], hop: Callable[[DataFrame], DataFrame], rounds: int) -> DataFrame:
    """The least metres of each key that hops from the front reach. A round makes two hops from the labels that the round before improved, and writes those
    that improve on what is known; what is known is these tables, a few at a time, for they are merged now and then."""
    levels = [front.select(*key, "metres")]
    rest = [F.first(c).alias(c) for c in front.columns if c not in (*key, "metres", "most")] + [F.min(c).alias(c) for c in front.columns if c == "most"]
    for _ in range(rounds):
        one = hop(front)
        step = one.unionByName(hop(one)).groupBy(*key).agg(F.min("metres").alias("metres"), *rest)
        known = levels[0]
        for level in levels[1:]:
            known = known.unionByName(level)
        known = known.select(*[F.col(c).alias(f"k_{c}") for c in (*key, "metres")])
        front = cut(step.join(known, [*[F.col(c) == F.col(f"k_{c}") for c in key], F.col("k_metres") <= F.col("metres") + 1e-9], "left_anti"))
        if front.isEmpty():
            return _merged(levels, key)
        levels.append(front.select(*key, "metres"))
        if len(levels) > LEVELS:
            levels = [cut(_merged(levels, key))]
    raise RuntimeError("ways did not settle")


#: Landmarks of an area.
LANDMARKS = 4


def landmarks(ways: DataFrame, count: int = LANDMARKS) -> DataFrame:
    """(area_id, node, far): each node's distances to the same few nodes of its area, drawn by hash; null for one that it can't reach, as all are in a part of
    the graph that holds none. By the triangle rule two nodes are at least as far apart as any of their distances differ, and at most as any two add up to."""
    drawn = [F.min(F.struct(F.xxhash64(F.lit(k), "src").alias("h"), F.col("src").alias("node")))["node"] for k in range(count)]
    picked = cut(ways.groupBy("area_id").agg(F.array(*drawn).alias("m")).select("area_id", F.posexplode("m").alias("k", "source")))
    d = distances(ways, picked.select("area_id", "source").distinct(), both=False).join(picked, ["area_id", "source"])
    far = d.groupBy("area_id", "node").agg(*[F.min(F.when(F.col("k") == k, F.col("metres"))).alias(f"d{k}") for k in range(count)])
    every = ways.select("area_id", F.col("src").alias("node")).distinct().join(far, ["area_id", "node"], "left")
    return cut(every.select("area_id", "node", F.array(*[f"d{k}" for k in range(count)]).alias("far")))


def at_least(one: Column, two: Column) -> Column:
    """Metres between two nodes at least, by their distances to landmarks."""
    return F.aggregate(F.zip_with(one, two, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, d: F.greatest(acc, F.coalesce(d, F.lit(0.0))))


LEG = ["area_id", "src", "dst"]


def corridors(edges: DataFrame, legs: DataFrame, rounds: int = 1000, slack: float = 1e-6) -> DataFrame:
    """(area_id, src, dst, node, metres): of each distinct leg, shortest ways from src to the nodes that a shortest route to dst may pass; all nodes that one does
    pass are among them, dst too where it can be reached. A label lives while what it has and what landmarks say is left don't exceed what is known of the
    whole: a way over a landmark at first, then the best way found. So a leg keeps the nodes of its corridor, not those of its area."""
    ways = cut(both_ways(edges))
    marks = landmarks(ways)
    e = cut(ways.select("area_id", F.col("src").alias("x"), F.col("dst").alias("y"), "weight").join(marks.select("area_id", F.col("node").alias("y"), "far"), ["area_id", "y"]))
    pairs = legs.select(*LEG).distinct().where("src <> dst")
    pairs = pairs.join(marks.select("area_id", F.col("node").alias("src"), F.col("far").alias("f")), ["area_id", "src"]).join(marks.select("area_id", F.col("node").alias("dst"), F.col("far").alias("goal")), ["area_id", "dst"])
    over = F.array_min(F.zip_with("f", "goal", lambda a, b: a + b))  # null where no landmark reaches both
    apart = F.exists(F.zip_with("f", "goal", lambda a, b: a.isNull() != b.isNull()), lambda x: x)
    front = cut(pairs.where(~apart).select(*LEG, F.col("src").alias("node"), F.lit(0.0).alias("metres"), F.coalesce(over, F.lit(float("inf"))).alias("most"), "goal"))
    new = F.col("metres") + F.col("weight")

    def hop(labels: DataFrame) -> DataFrame:
        open_ = labels.where("node <> dst").withColumnRenamed("node", "x")
        step = open_.join(e, ["area_id", "x"]).where(new + at_least(F.col("far"), F.col("goal")) <= F.col("most") + slack)
        step = step.groupBy(*LEG, F.col("y").alias("node")).agg(F.min(new).alias("metres"), F.min("most").alias("most"), F.first("goal").alias("goal"))
        # who has reached the end knows the whole
        w = Window.partitionBy(*LEG)
        return step.withColumn("most", F.least("most", F.coalesce(F.min(F.when(F.col("node") == F.col("dst"), F.col("metres"))).over(w), F.col("most"))))

    return _settled(front, [*LEG, "node"], hop, rounds)


def routes(edges: DataFrame, legs: DataFrame) -> DataFrame:
    """legs (area_id, src, dst) with metres of the shortest route, null where there is none or both ends are one node."""
    found = corridors(edges, legs).where("node = dst").drop("node")
    return legs.join(found, LEG, "left")


def on_route(edges: DataFrame, legs: DataFrame, slack: float = 1e-6) -> DataFrame:
    """(area_id, src, dst, node): the nodes on a shortest route of each distinct leg: those whose distances to both ends add up to
    the route's. Legs are searched from both ends at once."""
    pairs = legs.select(*LEG).distinct().where("src <> dst")
    back = pairs.select("area_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    d = cut(corridors(edges, pairs.unionByName(back)))
    whole = pairs.join(d.where("node = dst").select(*LEG, F.col("metres").alias("m")), LEG)
    a = d.withColumnRenamed("metres", "ma")
    b = d.select("area_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "node", F.col("metres").alias("mb"))
    return whole.join(a, LEG).join(b, [*LEG, "node"]).where(F.col("ma") + F.col("mb") <= F.col("m") + slack).select(*LEG, "node")


def k_routes(edges: DataFrame, legs: DataFrame, k: int = 3, stretch: float = 1.3, hops: int = 12) -> DataFrame:
    """(area_id, src, dst, place, metres, path): the k shortest routes without a node twice of each distinct leg, among those of at
    most `stretch` times the shortest and `hops` edges (ties: the path in order). Paths grow edge by edge; one is dropped as
    soon as what it has and the distance still to go exceed the stretch, so each leg's routes are complete within it."""
    pairs = legs.select("area_id", "src", "dst").distinct().where("src <> dst")
    e = cut(both_ways(edges))
    to = cut(distances(edges, pairs.select("area_id", F.col("dst").alias("source")).distinct())).select("area_id", F.col("source").alias("dst"), F.col("node").alias("at"), F.col("metres").alias("left"))
    most = pairs.join(to, ["area_id", "dst"]).where("at = src").select("area_id", "src", "dst", (F.col("left") * stretch + 1e-6).alias("most"))
    open_ = cut(most.select("area_id", "src", "dst", "most", F.array("src").alias("path"), F.lit(0.0).alias("metres")))
    done = open_.where("false")
    for _ in range(hops):
        longer = open_.withColumn("x", F.element_at("path", -1)).join(e.select("area_id", F.col("src").alias("x"), F.col("dst").alias("y"), "weight"), ["area_id", "x"]).where(~F.array_contains("path", F.col("y")))
        longer = longer.select("area_id", "src", "dst", "most", F.array_append("path", F.col("y")).alias("path"), (F.col("metres") + F.col("weight")).alias("metres"))
        longer = cut(longer.withColumn("at", F.element_at("path", -1)).join(to, ["area_id", "dst", "at"]).where(F.col("metres") + F.col("left") <= F.col("most")).drop("at", "left"))
        done = done.unionByName(longer.where(F.element_at("path", -1) == F.col("dst")))
        open_ = longer.where(F.element_at("path", -1) != F.col("dst"))
        if open_.isEmpty():
            break
    w = Window.partitionBy("area_id", "src", "dst").orderBy(F.round("metres", 6), "path")
    return done.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("area_id", "src", "dst", "place", "metres", "path")


#: A route's metres are added up in whole micrometres, so that equal routes are equal whatever the order of their edges.
MICRO = 1e6


def k_shortest(edges: DataFrame, legs: DataFrame, k: int = 3, rounds: int = 1000) -> DataFrame:
    """(area_id, src, dst, place, metres, path): the k shortest routes without a node twice of each distinct leg, however long and of however many edges
    (ties: the path in order); fewer where there are fewer, no row where a leg can't be run or both ends are one node.

    By spurs, for all legs at once: each route taken is left at each of its nodes, from where it left its own parent on, by a shortest way to the
    end that uses no node before and no edge by which a taken route with the same start goes on; the least of all found
    so far is the next. What a search still has to go is bounded by landmarks, and the whole by the candidates that the leg has already.
    Edges without a weight don't count, one of no length counts as a micrometre. A leg has at most k routes and its routes' spurs; a search without an end
    passes the nodes of its area once."""
    whole = edges.where("weight IS NOT NULL").withColumn("weight", F.greatest(F.round(F.col("weight") * MICRO), F.lit(1.0)))
    ways = cut(both_ways(whole))
    marks = landmarks(ways)
    e = cut(ways.select("area_id", F.col("src").alias("x"), F.col("dst").alias("y"), "weight").join(marks.select("area_id", F.col("node").alias("y"), "far"), ["area_id", "y"]))
    pairs = legs.select(*LEG).distinct().where("src <> dst")
    pairs = pairs.join(marks.select("area_id", F.col("node").alias("src"), F.col("far").alias("f")), ["area_id", "src"]).join(marks.select("area_id", F.col("node").alias("dst"), F.col("far").alias("goal")), ["area_id", "dst"])
    pairs = cut(pairs.where(~F.exists(F.zip_with("f", "goal", lambda a, b: a.isNull() != b.isNull()), lambda x: x)).select(*LEG, "goal", F.array_min(F.zip_with("f", "goal", lambda a, b: a + b)).alias("over")))
    nowhere = F.lit(float("inf"))
    start = pairs.select(*LEG, F.lit(0).alias("spur"), F.lit(0.0).alias("units"), F.array("src").alias("path"), F.array(F.lit(0.0)).alias("along"), F.array("src").alias("shut"), F.coalesce("over", nowhere).alias("most"), "goal")
    open_ = _ends(start, e, rounds)
    taken = open_.where("false").withColumn("place", F.lit(0))
    best = Window.partitionBy(*LEG).orderBy("units", "path")
    for place in range(1, k + 1):
        ranked = cut(open_.withColumn("n", F.row_number().over(best)))
        new = ranked.where("n = 1").drop("n").withColumn("place", F.lit(place))
        open_, taken = ranked.where("n > 1").drop("n"), taken.unionByName(new)
        if place == k or new.isEmpty():
            break
        # the candidate that would be the last to be taken bounds what is worth finding
        most = ranked.where(F.col("n") == k - place + 1).select(*LEG, F.col("units").alias("most"))
        spurs = new.select(*LEG, "path", "along", F.explode(F.sequence("spur", F.size("path") - 2)).alias("spur"))
        spurs = spurs.select(*LEG, "spur", F.element_at("along", F.col("spur") + 1).alias("units"), F.slice("path", F.lit(1), F.col("spur") + 1).alias("path"), F.slice("along", F.lit(1), F.col("spur") + 1).alias("along"))
        others = taken.groupBy(*LEG).agg(F.collect_list("path").alias("others"))  # k at most
        with_start = lambda: F.filter("others", lambda o: F.slice(o, F.lit(1), F.col("spur") + 1) == F.col("path"))
        shut = F.transform(with_start(), lambda o: F.get(o, F.col("spur") + 1))
        spurs = spurs.join(others, LEG).withColumn("shut", shut).drop("others").join(most, LEG, "left").withColumn("most", F.coalesce("most", nowhere)).join(pairs.drop("over"), LEG)
        open_ = cut(open_.unionByName(_ends(spurs, e, rounds)))
    return taken.select(*LEG, "place", (F.col("units") / MICRO).alias("metres"), "path")


def _ends(front: DataFrame, e: DataFrame, rounds: int) -> DataFrame:
    """The shortest way on to the end of each search (a leg and its spur): (area_id, src, dst, spur, units, path, along), along being the units at each node of the path."""
    key = [*LEG, "spur", "node"]
    front = cut(front.withColumn("node", F.element_at("path", -1)))
    known = front.select(*key, "units", "path", "along")
    units = F.col("units") + F.col("weight")
    first = F.size("path") == F.col("spur") + 1
    w = Window.partitionBy(*LEG, "spur")
    for n in range(rounds):
        step = front.where("node <> dst").withColumnRenamed("node", "x").join(e, ["area_id", "x"])
        step = step.where(~F.array_contains("path", F.col("y")) & ~(first & F.array_contains("shut", F.col("y"))) & (units + at_least(F.col("far"), F.col("goal")) <= F.col("most")))
        label = F.struct(units.alias("units"), F.array_append("path", F.col("y")).alias("path"), F.array_append("along", units).alias("along"))
        step = step.groupBy(*LEG, "spur", F.col("y").alias("node")).agg(F.min(label).alias("l"), F.first("shut").alias("shut"), F.min("most").alias("most"), F.first("goal").alias("goal"))
        step = step.select(*key, "l.units", "l.path", "l.along", "shut", "most", "goal")
        step = step.withColumn("most", F.least("most", F.coalesce(F.min(F.when(F.col("node") == F.col("dst"), F.col("units"))).over(w), F.col("most"))))
        before = known.select(*[F.col(c).alias(f"k_{c}") for c in (*key, "units", "path")])
        no_better = F.struct("k_units", "k_path") <= F.struct("units", "path")
        front = cut(step.join(before, [*[F.col(c) == F.col(f"k_{c}") for c in key], no_better], "left_anti"))
        if front.isEmpty():
            out = known.where("node = dst").groupBy(*LEG, "spur").agg(F.min(F.struct("units", "path", "along")).alias("l"))
            return cut(out.select(*LEG, "spur", "l.*"))
        known = known.unionByName(front.select(*key, "units", "path", "along"))
        if n % LEVELS == LEVELS - 1:
            known = cut(known.groupBy(*key).agg(F.min(F.struct("units", "path", "along")).alias("l")).select(*key, "l.*"))
    raise RuntimeError("ways did not settle")


def diversity(found: DataFrame) -> DataFrame:
    """(area_id, src, dst, diversity): the mean over pairs of a leg's routes of 1 less the share of edges they have in common; 0 with
    one route. Pairs are added up in their order."""
    at = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.concat_ws("|", F.least(F.element_at("path", i), F.element_at("path", i + 1)), F.greatest(F.element_at("path", i), F.element_at("path", i + 1))))
    r = found.select("area_id", "src", "dst", "place", at.alias("es"))
    gap = 1 - F.size(F.array_intersect("a.es", "b.es")) / F.size(F.array_union("a.es", "b.es"))
    on = F.expr("a.area_id = b.area_id AND a.src = b.src AND a.dst = b.dst AND a.place < b.place")
    pairs = r.alias("a").join(r.alias("b"), on).groupBy(F.col("a.area_id").alias("area_id"), F.col("a.src").alias("src"), F.col("a.dst").alias("dst")).agg(F.array_sort(F.collect_list(F.struct(F.col("a.place").alias("p"), F.col("b.place").alias("q"), gap.alias("gap")))).alias("d"))
    pairs = pairs.withColumn("d", F.aggregate("d", F.lit(0.0), lambda acc, p: acc + p["gap"]) / F.size("d"))
    return found.select("area_id", "src", "dst").distinct().join(pairs, ["area_id", "src", "dst"], "left").select("area_id", "src", "dst", F.coalesce("d", F.lit(0.0)).alias("diversity"))
