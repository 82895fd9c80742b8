"""Identifiers for pieces of text that were compared byte by byte."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_id(chunk: Column, seed: int) -> Column:
    """Two independent 64-bit hashes."""
    return F.struct(F.xxhash64(F.lit(2 * seed), chunk).alias("h1"), F.xxhash64(F.lit(2 * seed + 1), chunk).alias("h2"))


def verified_seed(chunks: DataFrame, tries: int = 8) -> int:
    """A seed under which no two different texts of the column `chunk` share an identifier.

    Distinct texts meet once per task before they move; texts with one identifier then stand side by side and are
    compared as bytes by the grouping. Only whether any pair clashes comes to the driver."""
    texts = chunks.select("chunk").distinct()
    for seed in range(tries):
        clash = texts.select(chunk_id(F.col("chunk"), seed).alias("id")).groupBy("id").count().where("count > 1")
        if clash.limit(1).isEmpty():
            return seed
    raise RuntimeError("no seed keeps different chunks apart")
