"""Whitening of embeddings: equal vectors are fitted once with their multiplicity, whitened once, and joined back to their rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, quoted

#: Whole steps of an entry and what is added to them; components that are returned at most.
STEPS, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Components of less variance than this share of the largest are none: their direction is rounding.
LEAST = 1e-12


def whole(vector: Column) -> Column:
    """A vector's entries in whole steps, as longs."""
    return F.transform(vector, lambda c: F.floor(STEPS * c.cast("double")).cast("long") + F.lit(SHIFT).cast("long"))


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows whose vector is neither null nor empty and whose entries are neither null nor infinite nor NaN. All must be of one
    length: that of most rows counts (of equally many, the larger), vectors of other lengths go like null ones."""
    rows = vectors.select(F.col(quoted(key)).alias("vec_id"), F.col(quoted(vector)).alias("v"))
    fine = rows.where((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    lengths = fine.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return fine.where(F.size("v") == (lengths["dim"] if lengths else 0)).select("vec_id", whole(F.col("v")).alias("x"))


def weighted_sums(distinct: DataFrame, x: str = "x", weight: str = "times") -> tuple[int, list]:
    """(sum of weights, weighted sum of each entry) of distinct vectors; whole numbers stay exact. As many numbers as a vector has come to the driver."""
    n = distinct.agg(F.sum(weight)).first()[0]
    sums = distinct.select(F.posexplode(x).alias("at", "c"), weight).groupBy("at").agg(F.sum(F.col("c") * F.col(weight)).alias("s"))
    return n or 0, [r["s"] for r in sorted(sums.collect(), key=lambda r: r["at"])]


def weighted_covariance(distinct: DataFrame, n: int, sums: list, x: str = "x", weight: str = "times") -> np.ndarray:
    """Covariance with divisor n of vectors that stand `weight` times each: every task multiplies its centred vectors, weighted, with themselves;
    the products are summed entry by entry. As many numbers as a matrix has come to the driver."""
    dim, exact = len(sums), all(isinstance(s, int) for s in sums)
    at = np.array(sums, np.int64 if exact else float)

    def products(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                times = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
                # whole numbers are centred by their exact mean's whole part first, so that nothing is lost to their size
                centred = (rows - at // n) - (at % n) / n if exact else rows - at / n
                total += (centred * times[:, None]).T @ centred
        i, j = np.divmod(np.arange(dim * dim), dim)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "v"])

    found = distinct.select(x, weight).mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((dim, dim))
    for r in found:
        out[r["i"], r["j"]] = r["v"] / n
    return (out + out.T) / 2


@dataclass(frozen=True)
class Whitener:
    """What a vector's whitening needs: n and the sums (their mean is the centre), unit eigenvectors as columns by falling eigenvalue, the eigenvalues, and the trace."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def useful(self) -> np.ndarray:
        """Whether a component has variance."""
        return self.values > LEAST * max(float(self.values.max(initial=0.0)), 0.0)


def multiplicities(rows: DataFrame) -> DataFrame:
    """(x, times): each distinct vector and how many rows have it. Copies are counted before they are moved."""
    return rows.groupBy("x").agg(F.count("*").alias("times"))


def fit(distinct: DataFrame, once: bool = False) -> Whitener:
    """Components of the vectors' covariance: each distinct vector weighs as many times as it stands, or one (`once`). An axis points to where its
    largest entry is positive."""
    weighed = distinct.withColumn("times", F.lit(1).cast("long")) if once else distinct
    n, sums = weighted_sums(weighed)
    if not n:
        return Whitener(0, (), np.empty((0, 0)), np.empty(0), 0.0)
    values, axes = np.linalg.eigh(weighted_covariance(weighed, n, sums))
    values, axes = values[::-1], axes[:, ::-1]
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(values))])
    return Whitener(n, tuple(sums), axes * signs, values, float(values.sum()))


def whiten(distinct: DataFrame, model: Whitener, components: int = COMPONENTS) -> DataFrame:
    """distinct with `whitened`, the vector's centred projections on the first components over their standard deviations; null where a component has no
    variance. One narrow pass."""
    k = min(components, len(model.values))
    dim, at, useful = len(model.sums), np.array(model.sums, np.int64), model.useful[:k]
    scale = model.axes[:, :k] / np.sqrt(np.where(useful, model.values[:k], 1.0))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            got = ((rows - at // model.n) - (at % model.n) / model.n) @ scale
            flat = pa.array(got.ravel(), mask=np.tile(~useful, len(rows)))
            offsets = pa.array(np.arange(0, len(rows) * k + 1, k, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, flat)], names=["x", "times", "whitened"])

    return distinct.select("x", "times").mapInArrow(run, "x array<long>, times long, whitened array<double>")


def identity_error(whitened: DataFrame, useful: np.ndarray) -> float:
    """The largest absolute entry of the covariance of the whitened fit list less the identity, over components with variance; null without any."""
    picked = whitened.select(F.filter("whitened", lambda c: c.isNotNull()).alias("x"), "times")
    k = int(useful.sum())
    if not k:
        return float("nan")
    n, sums = weighted_sums(picked)
    return float(np.abs(weighted_covariance(picked, n, [float(s) for s in sums]) - np.eye(k)).max())


def whitening(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per usable row of vectors and component (up to `components`): vec_id, component from 1, n, deviation (sum of the squared exact n * x - S, an error
    beyond a long), whitened, explained (share of the variance) and identity_error.

    Rows that `usable` leaves out are not returned; null and repeated keys, repeated rows and extra columns are: each row has its components. Without
    variance (one vector, or all the same) whitened and explained are null and so is identity_error; an empty table gives an empty one.
    Distinct vectors are written with what they whiten to; rows meet them by a join of two written tables, so that the rows of a frequent vector are split."""
    rows = cut(usable(vectors, key, vector))
    distinct = cut(multiplicities(rows))
    model = fit(distinct)
    if not model.n:
        return rows.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double").limit(0)
    done = cut(whiten(distinct, model, components).withColumn("deviation", deviation(F.col("x"), model)).drop("times"))
    error = identity_error(whiten(distinct, model, components), model.useful[: min(components, len(model.values))])
    both = rows.join(done, "x")
    k = min(components, len(model.values))
    shares = F.array(*[F.lit(float(v / model.trace) if model.trace > 0 else None).cast("double") for v in np.maximum(model.values[:k], 0.0)])
    return both.select(
        "vec_id", F.posexplode("whitened").alias("at", "whitened"), "deviation", shares.alias("shares"),
    ).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.col("shares")[F.col("at")].alias("explained"), F.lit(None if np.isnan(error) else error).cast("double").alias("identity_error"),
    )


def deviation(x: Column, model: Whitener) -> Column:
    """Sum over a vector's entries of (n * x - S) squared, in whole numbers."""
    sums = F.array(*[F.lit(s).cast("long") for s in model.sums])
    apart = F.zip_with(x, sums, lambda c, s: (F.lit(model.n).cast("long") * c - s))
    return F.aggregate(apart, F.lit(0).cast("long"), lambda acc, d: acc + d * d)
