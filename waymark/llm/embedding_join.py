"""Near duplicates among embeddings: a subspace pigeonhole join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, cut

COSINE, SEED = 0.95, 7
#: Dimensions of a block, and how many of them (the first) the block's grid uses.
BLOCK, GRID = 8, 6
_ODD = np.uint64(0x9E3779B97F4A7C15)


def rotation(dim: int) -> np.ndarray:
    """A random rotation of so many dimensions, the same for each run."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cells(units: DataFrame, cosine: float) -> DataFrame:
    """(block, cell, rep, probe, c0..c7) of vectors (rep, unit vector v): for each block of rotated dimensions its home
    cell, and the cells above it that a vector within the block's share of the squared distance may have as its home.
    A cell's side is twice that distance, so a vector is near one side of its cell in each dimension."""
    whole = 2 - 2 * cosine

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["v"].map(len)
            for dim in sizes.unique():
                part = batch[sizes == dim]
                for at in range(0, len(part), 1000):
                    rows = part[at : at + 1000]
                    x = np.stack(rows["v"].to_numpy()) @ rotation(dim)
                    rep = rows["rep"].to_numpy()
                    for block, low in enumerate(range(0, dim, BLOCK)):
                        y = x[:, low : low + BLOCK]
                        g = min(GRID, y.shape[1])
                        r = math.sqrt(whole * y.shape[1] / dim) * (1 + 1e-6) + 1e-6
                        scaled = y[:, :g] / (2 * r)
                        home = np.floor(scaled).astype(np.int64)
                        up = scaled - home >= 0.5
                        gap = np.where(up, 1 - (scaled - home), scaled - home) * 2  # in radii
                        subsets = (np.arange(1 << g)[:, None] >> np.arange(g)) & 1
                        first = subsets.argmax(1)
                        ok = (gap**2 @ subsets.T <= 1) & (up[:, first] | (subsets.sum(1) == 0))
                        i, s = np.nonzero(ok)
                        cell = home[i] + np.where(up[i], 1, -1) * subsets[s]
                        key = np.full(len(i), dim * 1000 + block, np.uint64)
                        with np.errstate(over="ignore"):
                            for j in range(g):
                                key = (key ^ (key >> np.uint64(29))) * _ODD + cell[:, j].astype(np.uint64)
                        out = {"block": np.int32(block), "cell": key.view(np.int64), "rep": rep[i], "probe": s > 0}
                        pad = np.zeros((len(i), BLOCK), np.float32)
                        pad[:, : y.shape[1]] = y[i]
                        yield pd.DataFrame(out | {f"c{j}": pad[:, j] for j in range(BLOCK)} | {"budget": np.float32(r * r)})

    coords = ", ".join(f"c{j} float" for j in range(BLOCK))
    return units.select("rep", "v").mapInPandas(run, f"block int, cell long, rep long, probe boolean, {coords}, budget float")


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Per row: key, n_links (other rows linked directly), component_id (smallest key reachable), kept.

    Rows link when the cosine of their vectors in double precision is at least `cosine`. Null, empty and zero vectors, and
    such with a null or non-finite component link with nothing, nor do rows with a null key or vectors of different
    length. A key names one vector; rows that repeat it count as rows of their own.

    1. Rows with the same vector are one class, and count as such.
    2. The smallest class of each home cell is a leader; classes within half the angle of one belong to its ball (the
       smallest leader's). Two vectors of a ball are within the whole angle, so they link and need no check, however many
       they are.
    3. For pairs from different balls: if the squared distance of two rotated unit vectors is at most D, some block of d
       of their n dimensions has at most D * d / n of it. Each block's grid finds the pairs that do, by an equi-join on
       cells whose condition is that distance; the union of the blocks' pairs is checked exactly.
    Components come from ball membership and the pairs' links, distributed. Joins read tables that were cut, so that
    large cells and classes can be split."""
    value = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))
    rows = df.select(F.col(key).cast("long").alias("id"), value.alias("x"))
    fine = F.col("id").isNotNull() & F.coalesce(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0), F.lit(False))
    good = rows.where(fine).withColumn("h", F.xxhash64("x"))
    most = F.array_max(F.transform("x", lambda v: F.abs(v)))
    scaled = F.transform("x", lambda v: v / F.col("most"))
    classes = good.groupBy("h", "x").agg(F.min("id").alias("rep"), F.count("*").alias("m")).withColumn("most", most)
    classes = classes.withColumn("s", scaled).withColumn("norm", F.sqrt(_dot("s", "s"))).withColumn("v", F.transform("s", lambda v: v / F.col("norm")))
    classes = cut(classes.select("h", "x", "rep", "m", "v"))

    near = cut(cells(classes, cosine))
    homes = near.where("NOT probe").select("block", "cell", "rep")
    leaders = cut(homes.groupBy("block", "cell").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n"))
    half = math.sqrt((1 + cosine) / 2) + 1e-9
    led = cut(homes.join(leaders, ["block", "cell"]).where("rep <> leader").select("rep", "leader").distinct())
    vec = classes.select("rep", "v")
    led = led.join(vec, "rep").join(vec.select(F.col("rep").alias("leader"), F.col("v").alias("w")), "leader").where(_dot("v", "w") >= half)
    balls = cut(led.groupBy("rep").agg(F.min("leader").alias("ball")))
    units = classes.select("rep", "m").join(balls, "rep", "left").select("rep", "m", F.coalesce("ball", "rep").alias("ball"))
    units = cut(units)
    sizes = cut(units.groupBy("ball").agg(F.sum("m").alias("ball_m"), F.min("rep").alias("ball_rep")))

    held = cut(near.join(units.select("rep", "ball"), "rep"))
    a, b = held.alias("a"), held.where("NOT probe").alias("b")
    apart = sum(((F.col(f"a.c{j}") - F.col(f"b.c{j}")) * (F.col(f"a.c{j}") - F.col(f"b.c{j}")) for j in range(BLOCK)), F.lit(0.0))
    on = (
        (F.col("a.block") == F.col("b.block")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.ball") != F.col("b.ball"))
        & (F.col("a.probe") | (F.col("a.rep") < F.col("b.rep"))) & (apart <= F.col("a.budget") + 1e-6)
    )
    pairs = cut(a.join(b, on).select(F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b")).where("a <> b").distinct())
    full = pairs.join(vec.select(F.col("rep").alias("a"), F.col("v").alias("va")), "a").join(vec.select(F.col("rep").alias("b"), F.col("v").alias("vb")), "b")
    links = cut(full.where((F.size("va") == F.size("vb")) & (_dot("va", "vb") >= cosine)).select("a", "b"))

    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    outer = both.join(units.select(F.col("rep").alias("b"), "m"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("m").alias("outer"))
    inner = units.join(sizes, "ball")
    edges = inner.where("rep <> ball_rep").select(F.col("rep").alias("a"), F.col("ball_rep").alias("b")).unionByName(links)
    found = components(edges)
    per = inner.join(outer, "rep", "left").join(found, F.col("rep") == F.col("node"), "left")
    per = per.select("rep", (F.col("ball_m") - 1 + F.coalesce("outer", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    per = cut(classes.select("h", "x", "rep").join(per, "rep"))
    out = rows.withColumn("hash", F.when(fine, F.xxhash64("x"))).alias("r").join(per.alias("p"), (F.col("r.hash") == F.col("p.h")) & (F.col("r.x") == F.col("p.x")) & F.col("r.id").isNotNull(), "left")
    component = F.coalesce("p.component_id", "r.id")
    return out.select(F.col("r.id").alias(key), F.coalesce("p.n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("r.id") == component, F.lit(True)).alias("kept"))


ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
r(n, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON r.n = l.a),
c AS (SELECT n, min(c) AS component_id FROM r GROUP BY n), k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id, coalesce(component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.n = e.vec_id LEFT JOIN k ON k.a = e.vec_id"""
