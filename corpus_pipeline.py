"""From raw documents to packed training sequences: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import exact_dedup, mixing, ngram_join, packing, quality
from waymark.llm.shared import cut, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. It learns from the labelled rows of the given documents."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each group of equal texts."""
    return exact_dedup.drop_exact(docs.select(*COLUMNS))


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first, of each group of near copies: five-word shingles, Jaccard similarity 0.8 or more."""
    return ngram_join.drop_near(docs.select(*COLUMNS), n=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix; those of a task stand in the order of their shards. Each stands whole, once for each pass over its source that takes the
    block with its first word; those of empty or null text stand with the block at their place. Documents of a source
    without words go. Rows are numbered once, since keys may be null or repeated; an empty table gives an empty one."""
    rows = cut(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("__row")))
    places = cut(mixing.stands(mixing.mix(rows, row="__row")))
    both = rows.join(places, F.col("__row") == F.col("row")).sortWithinPartitions("shard", "position", "start")
    return both.select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, each with its sequence and place."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", good),
    ("exact dedup", distinct),
    ("n-gram Jaccard join", apart),
    ("mixing to target weights", mixed),
    ("packing", packed),
]

#: SQL can't express the trained classifier; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
