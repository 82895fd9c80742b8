"""An inverted-file index of vectors: written once, searched by the lists nearest to a question; the exact scan stays beside it."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import cut
from .text import QUESTIONS, ROWS, _units, top_matches

#: Bounds of what the lists' centres are fitted on and of their number; steps of the fit. Every row is indexed.
SAMPLE, LISTS, STEPS, SEED = 20_000, 1024, 10, 4
#: Sample rows that ask for the nearest of the sample, how many, and the share of those that the lists searched must hold.
TRIED, NEAREST, SHARE = 200, 10, 0.95


@dataclass(frozen=True)
class Index:
    """centres: unit vectors, one a list. probes: lists that a search looks into. rows: (list, part, id, v), a list of many rows in parts of about ROWS.
    sizes: (list, parts)."""

    centres: np.ndarray
    probes: int
    rows: DataFrame
    sizes: DataFrame


def _centres(sample: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means: centres start at rows drawn with a seed; one that loses all its rows keeps its place."""
    at = sample[np.random.default_rng(SEED).permutation(len(sample))[:lists]].copy()
    for _ in range(STEPS):
        near = np.argmax(sample @ at.T, axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, near, sample)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        at = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), at)
    return at


def _probes(sample: np.ndarray, centres: np.ndarray) -> int:
    """How many lists hold SHARE of the NEAREST rows of the sample to some rows of it: few where vectors stand in groups, most where they don't."""
    asks = sample[:TRIED]
    near = np.argsort(-(asks @ sample.T), axis=1, kind="stable")[:, 1 : NEAREST + 1]
    if not near.size:
        return len(centres)
    place = np.argsort(np.argsort(-(asks @ centres.T), axis=1, kind="stable"), axis=1)
    of = np.argmax(sample @ centres.T, axis=1)
    return 1 + int(np.sort(np.take_along_axis(place, of[near], axis=1).ravel())[math.ceil(SHARE * near.size) - 1])


def build(corpus: DataFrame, path: str, lists: int | None = None) -> Index:
    """Index a corpus (id, v) under path. Centres are fitted on SAMPLE rows at most, drawn by a hash of the id; each row goes to the list of the centre with the
    greatest cosine. There are about as many lists as the root of the number of rows, LISTS at most. Null, empty and zero vectors, those with
    null or infinite entries and those not of the most frequent length are left out; repeated rows stay. A frequent vector's list is dealt by id into parts."""
    spark = corpus.sparkSession
    fine = corpus.where((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)).select("id", F.col("v").cast("array<double>").alias("v"))
    common = fine.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim, kind = (common["dim"] if common else 0), dict(corpus.dtypes)["id"]
    fine = fine.where(F.size("v") == dim)
    n = common["count"] if common else 0
    drawn = fine.orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(SAMPLE).select("v").collect()
    k = max(1, min(lists or math.isqrt(n), LISTS, max(1, len(drawn) // 8)))
    sample = _units([r.v for r in drawn]) if drawn else np.zeros((0, 0))
    centres = _centres(sample, k) if drawn else sample
    probes = _probes(sample, centres) if drawn else 1

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            near = np.argmax(_units(rows["v"].tolist()) @ centres.T, axis=1) if len(rows) else np.empty(0, np.int64)
            yield rows.assign(list=near.astype(np.int32))[["list", "id", "v"]]

    listed = fine.mapInPandas(assign, f"list int, id {kind}, v array<double>")
    listed.write.mode("overwrite").parquet(f"{path}/listed")
    listed = spark.read.parquet(f"{path}/listed")
    sizes = listed.groupBy("list").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("parts"))
    sizes.write.mode("overwrite").parquet(f"{path}/sizes")
    dealt = listed.join(F.broadcast(spark.read.parquet(f"{path}/sizes")), "list")  # LISTS rows at most
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select("list", "part", "id", "v")
    dealt.repartition("list", "part").sortWithinPartitions("list", "part").write.mode("overwrite").parquet(f"{path}/rows")
    spark.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(centres)], "list int, v array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    """An index that was built under path."""
    centres = sorted(spark.read.parquet(f"{path}/centres").collect(), key=lambda r: r["list"])
    return Index(np.array([r.v for r in centres]), centres[0].probes if centres else 1, spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/sizes"))


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(query_id, id, score, place): for each query (query_id, q) the k rows with the highest cosine, to six digits, ties by id, among those of the `probes` lists
    whose centres are nearest to it (the index's own number where none is given); or, if it must be exact, among all rows, by the exact scan. Queries of another length, null or zero, match nothing.

    Questions meet the parts of their lists; a group is one part and up to QUESTIONS of its questions, and gives each the best k of its rows."""
    if exact:
        return top_matches(queries, index.rows.select("id", "v"), k)
    probes = probes or index.probes
    centres, dim = index.centres, index.centres.shape[1] if len(index.centres) else 0
    types = dict(queries.dtypes)["query_id"], dict(index.rows.dtypes)["id"]
    asked = queries.where(F.col("q").isNotNull() & (F.size("q") == dim) & (F.size("q") > 0)).select("query_id", F.col("q").cast("array<double>").alias("q"))

    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            near = np.argsort(-np.nan_to_num(_units(rows["q"].tolist()) @ centres.T, nan=-9.0), axis=1, kind="stable")[:, :probes] if len(rows) else np.empty((0, 1), np.int64)
            yield rows.assign(list=near.astype(np.int32).tolist())

    asked = asked.mapInPandas(lists, f"query_id {types[0]}, q array<double>, list array<int>").withColumn("list", F.explode("list")).join(F.broadcast(index.sizes), "list")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = max(1, math.ceil(queries.count() / QUESTIONS))
    asked = cut(asked.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")))
    wanted = asked.select(*[F.col(c).alias(f"w_{c}") for c in ("list", "part", "b")]).distinct()
    rows = index.rows.join(wanted, (F.col("list") == F.col("w_list")) & (F.col("part") == F.col("w_part"))).select("list", "part", F.col("w_b").alias("b"), "id", "v")

    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({"query_id": one["query_id"][:0], "id": two["id"][:0], "score": np.empty(0)})
        two = two.sort_values("id", kind="stable")
        score = np.clip(np.round(_units(one["q"].tolist()) @ _units(two["v"].tolist()).T, 6), -1, 1)
        best = np.argsort(-np.nan_to_num(score, nan=-9.0), axis=1, kind="stable")[:, :k]
        found = pd.DataFrame({"query_id": np.repeat(one["query_id"].to_numpy(), best.shape[1]), "id": two["id"].to_numpy()[best].ravel(), "score": np.take_along_axis(score, best, 1).ravel()})
        return found[found["score"].notna()]

    key = ["list", "part", "b"]
    found = asked.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(run, f"query_id {types[0]}, id {types[1]}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact matches (query_id, id) that were found."""
    both = exact.select("query_id", "id").distinct().join(found.select("query_id", "id").distinct().withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0
