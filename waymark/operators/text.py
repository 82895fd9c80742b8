"""Chunking, cleaning and vector retrieval of documents."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean(text: Column) -> Column:
    """Runs of blanks and tabs become one blank, three or more line ends two; ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def windows(df: DataFrame, size: int = 800, overlap: int = 200, least: int = 100, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, what else to keep, ord, chunk): characters in windows that overlap; chunks under `least` characters go."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(size - overlap))
    names = ["doc_id", *(keep or [])]
    cut = df.where("text IS NOT NULL").select(*names, "text", F.posexplode(starts).alias("ord", "at"))
    return cut.select(*names, "ord", F.trim(F.substring("text", F.col("at") + 1, F.lit(size))).alias("chunk")).where(F.length("chunk") >= least)


#: Questions of a block, and corpus rows of a block: what one task multiplies at once.
QUESTIONS, ROWS = 1024, 4096


def _units(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.full_like(x, np.nan), where=norm > 0)


def top_matches(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, place): the k rows of the corpus (id, v) with the highest cosine for each query (query_id, q), scores
    to six digits between -1 and 1, ties by id. Null and zero vectors match nothing, nor do vectors of different lengths.

    Both sides are dealt by hash into blocks; each pair of blocks is one group, whose vectors are made unit vectors once and
    multiplied as matrices, and gives the best k of its rows for each of its questions; then the best of all groups count. A
    group holds two blocks and their products, whatever the tables' sizes; work is questions times rows, as the search is
    exact."""
    queries, corpus = queries.where("q IS NOT NULL").select("query_id", "q"), corpus.where("v IS NOT NULL").select("id", "v")
    some, many = max(1, math.ceil(queries.count() / QUESTIONS)), max(1, math.ceil(corpus.count() / ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = queries.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(some))).withColumn("c", every(many))
    rows = corpus.withColumn("c", F.pmod(F.xxhash64("id"), F.lit(many))).withColumn("b", every(some))

    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": one["query_id"][:0], "id": two["id"][:0], "score": np.empty(0)})]
        sizes, dims = one["q"].map(len), two["v"].map(len)
        for dim in sorted(set(sizes) & set(dims)):
            q, v = one[sizes == dim], two[dims == dim].sort_values("id", kind="stable")
            score = np.clip(np.round(_units(q["q"].tolist()) @ _units(v["v"].tolist()).T, 6), -1, 1)
            best = np.argsort(-np.nan_to_num(score, nan=-9.0), axis=1, kind="stable")[:, :k]
            found = pd.DataFrame({"query_id": np.repeat(q["query_id"].to_numpy(), best.shape[1]), "id": v["id"].to_numpy()[best].ravel(), "score": np.take_along_axis(score, best, 1).ravel()})
            out.append(found[found["score"].notna()])
        return pd.concat(out)

    types = dict(queries.dtypes)["query_id"], dict(corpus.dtypes)["id"]
    found = asked.groupBy("b", "c").cogroup(rows.groupBy("b", "c")).applyInPandas(run, f"query_id {types[0]}, id {types[1]}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def paragraphs(df: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(doc_id, ord, chunk): paragraphs of the cleaned text packed into chunks of at most `size` characters; a longer
    paragraph is cut into pieces that overlap. Null and blank texts have no chunk."""
    blank = lambda c: F.regexp_replace(c, r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    parts = F.filter(F.transform(F.split(clean(F.col("text")), "\n\n"), blank), lambda p: F.length(p) > 0)
    state = lambda done, now: F.struct(done.alias("done"), now.alias("now"))
    held = lambda s: F.when(F.length(s["now"]) > 0, F.array_append(s["done"], s["now"])).otherwise(s["done"])

    def step(s: Column, p: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.length(p) - 1, F.lit(size - overlap)), lambda i: F.substring(p, i + 1, F.lit(size)))
        joined = F.when(F.length(s["now"]) > 0, F.concat(s["now"], F.lit("\n\n"), p)).otherwise(p)
        full = F.length(s["now"]) + F.length(p) > size
        return F.when(F.length(p) > size, state(F.concat(held(s), pieces), F.lit(""))).when(full, state(held(s), p)).otherwise(state(s["done"], joined))

    empty = F.array().cast("array<string>")
    chunks = F.aggregate(parts, state(empty, F.lit("")), step, held)
    return df.where("text IS NOT NULL").select("doc_id", F.posexplode(chunks).alias("ord", "chunk"))
