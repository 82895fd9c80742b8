"""Exact duplicates by content-defined chunk recipes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import chunk_id, verified_seed
from .shared import LAST, SPACE, cut, quoted

#: A chunk ends where a word ends and the next one starts with two such letters: that depends on nothing but the text
#: there. Chunks have 200 characters at least (but for the last) and 2000 at most.
CHUNK = r"(?s).{200,2000}?(?<=\x20)(?=[b-fB-Fà-è][a-m])|.{1,2000}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def chunked(text: Column) -> Column:
    """The chunks of a text, in order; together they are the text. Empty texts have none."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, keep_id (smallest key of the rows with an equal text), group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became one space; null counts as empty, and all
    empty texts form one group. A text becomes the ordered list of its chunks' identifiers; an identifier stands for one
    chunk text only (verified_seed), so equal lists mean equal texts, and only lists are compared. Each distinct chunk
    moves once. A null key sorts last: it's kept only if its group has no other; repeated rows with the smallest key
    stay all. Groups are counted before they move, and the join back can be split where one group is large."""
    docs = df.select(F.col(quoted(key)).cast("long").alias("doc_id"), normalised(F.col(quoted(text))).alias("norm"))
    seed = verified_seed(docs.select(F.explode(chunked(F.col("norm"))).alias("chunk")))
    ids = F.transform(chunked(F.col("norm")), lambda c: chunk_id(c, seed))
    recipes = cut(docs.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), ids.alias("recipe")))
    at = F.coalesce("doc_id", F.lit(LAST))
    groups = cut(recipes.groupBy("recipe").agg(F.min(at).alias("keep_at"), F.count("*").alias("group_size")))
    groups = groups.withColumn("short", F.xxhash64("recipe"))
    joined = recipes.withColumn("short", F.xxhash64("recipe")).join(groups, ["short", "recipe"])
    return joined.select(
        F.col("doc_id").alias(key), F.when(F.col("keep_at") < LAST, F.col("keep_at")).alias("keep_id"), "group_size",
        (at == F.col("keep_at")).alias("kept"), "text_sha256",
    )


def drop_exact(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df without the rows that exact_groups drops; all columns, whatever their names, stay as they were. Rows go by key and
    text, so that rows which share a key, null or not, are decided one by one; rows that repeat both stay or go together.
    Null and empty texts are equal to one another; an empty table gives an empty one."""
    out = exact_groups(df, key, text).where("NOT kept").select(F.col(quoted(key)).alias("key"), F.col("text_sha256").alias("sha"))
    row, gone = "__row", "__gone"
    same = F.col(f"{row}.{quoted(key)}").cast("long").eqNullSafe(F.col(f"{gone}.key")) & (F.sha2(normalised(F.col(f"{row}.{quoted(text)}")), 256) == F.col(f"{gone}.sha"))
    return df.alias(row).join(out.alias(gone), same, "left_anti")


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)"""
