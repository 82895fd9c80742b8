"""Repeated passages of lines, in content-defined line chunks. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import chunk_id, verified_seed
from .shared import LAST, WORD, cut, quoted

#: A single line of more words than these is a passage by itself.
WORDS = 50
#: A letter or digit of any script.
SIGN = r"[\p{L}\p{N}_]"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f's own lambdas use it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def line_units(text: Column) -> Column:
    """A text's lines, each with the lines after it that hold no letter or digit; joined by line ends they are the text."""
    return F.split(text, rf"\n(?=[^\n]*{SIGN})", -1)


def first_line(unit: Column) -> Column:
    return F.substring_index(unit, "\n", 1)


def windows(text: Column, seed: int, words: int) -> Column:
    """Array of (at, w, a, b): rolling hashes over the line hashes of a text, for each two lines that stand side by side (w 2), and
    for each line of more than `words` words (w 1)."""
    line = lambda u: F.struct(
        chunk_id(first_line(u), seed).alias("id"), u.rlike(SIGN).alias("worded"),
        ((F.length(first_line(u)) > 2 * words) & (F.regexp_count(first_line(u), F.lit(WORD)) > words)).alias("long"),
    )
    mark = lambda i, w, a, b: F.struct((i + 1).alias("at"), F.lit(w).alias("w"), a["id"].alias("a"), b["id"].alias("b"))
    both = lambda us: F.transform(us, lambda x, i: F.array(
        F.when(x["worded"] & F.get(us, i + 1).isNotNull(), mark(i, 2, x, F.get(us, i + 1))), F.when(x["long"], mark(i, 1, x, x))
    ))
    return let(F.transform(line_units(text), line), lambda us: F.filter(F.flatten(both(us)), lambda m: m.isNotNull()))


def drop_repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Per row: key, text without its repeated chunks, n_lines, n_chunks, removed_chunks, removed_lines.

    A text's chunks are its longest stretches of lines that are repeated, or that aren't: the rolling hash of two lines side by
    side chooses the boundaries, by whether it stood anywhere before, so that lines put in before a passage move its
    boundaries with it, and passages of two lines are found as well as long ones. A line goes where it and the line before or after it have stood
    together before, or where it has more than `words` words and has stood before; other single lines stay. Lines without a letter
    or digit, of any script, belong to the line before them and go with it; they count for nothing else.

    Before is: with a smaller key, a null key being the last; of rows that share a key, with the smaller hash of the text; then earlier in
    the text. So each line stays where it occurs first. Rows that repeat key and text are one occurrence. Lines are compared as
    bytes: identifiers stand for one line only (verified_seed), and a pair of lines is its two identifiers.
    Null text stays null, with counts 0; empty text has one empty line. Windows meet once per task before they move; the join of
    windows with repeated ones can be split where one is frequent, and only decisions meet the texts."""
    docs = df.select(F.col(quoted(key)).alias("doc_id"), F.col(quoted(text)).alias("text"), F.xxhash64(F.col(quoted(text))).alias("th"))
    seed = verified_seed(docs.select(F.explode(F.transform(line_units(F.col("text")), first_line)).alias("chunk")))
    who = [F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.col("doc_id").isNull().alias("none"), "th"]
    marks = cut(docs.select(*who, F.explode(windows(F.col("text"), seed, words)).alias("m")).select("d", "none", "th", "m.at", "m.w", *[F.col(f"m.{x}.{h}").alias(f"{x}{h}") for x in "ab" for h in ("h1", "h2")]))
    same = ["w", "ah1", "ah2", "bh1", "bh2"]
    place = F.struct("none", "d", "th", "at")
    found = cut(marks.groupBy(*same).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last"))
    gone = marks.join(found, same).where(place != F.col("first"))
    gone = gone.groupBy("d", "none", F.col("th").alias("g_th")).agg(F.collect_set(F.struct("at", "w")).alias("gone"))
    at = docs.join(gone, (F.coalesce("doc_id", F.lit(LAST)) == F.col("d")) & (F.col("doc_id").isNull() == F.col("none")) & (F.col("th") == F.col("g_th")), "left")
    lost = F.array_distinct(F.flatten(F.transform("gone", lambda g: F.sequence(g["at"], g["at"] + g["w"] - 1))))
    at = at.select("doc_id", "text", F.coalesce(lost, F.array().cast("array<int>")).alias("gone"))
    touched = F.size("gone") > 0
    at = at.withColumn("units", F.when(touched, line_units(F.col("text"))))
    at = at.withColumn("stay", F.when(touched, F.array_except(F.sequence(F.lit(1), F.greatest(F.size("units"), F.lit(1))), "gone")))  # by a set, not one by one
    stretches = lambda c: F.size(F.array_except(c, F.transform(c, lambda i: i + 1))).cast("long")
    lines = lambda c: (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1).cast("long")
    pick = lambda c: F.array_join(F.transform(c, lambda i: F.element_at("units", i)), "\n")
    none = F.lit(0).cast("long")
    return at.select(
        F.col("doc_id").alias(key), F.when(touched, pick(F.col("stay"))).otherwise(F.col("text")).alias("text"), F.coalesce(lines(F.col("text")), none).alias("n_lines"),
        F.when(touched, stretches(F.col("stay")) + stretches(F.col("gone"))).otherwise(F.col("text").isNotNull().cast("long")).alias("n_chunks"),
        stretches(F.col("gone")).alias("removed_chunks"), F.when(touched, lines(pick(F.col("gone")))).otherwise(none).alias("removed_lines"),
    )


ORACLE = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
h AS (SELECT doc_id, i, l[i] AS line, regexp_matches(l[i], '{SIGN}') AS worded FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
n AS (SELECT *, sum(CAST(worded OR i = 1 AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM h),
s AS (SELECT doc_id, u, arg_min(line, i) AS line, bool_or(worded) AS worded, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS body FROM n GROUP BY doc_id, u),
m AS (SELECT doc_id, u, 2 AS w, line AS a, lead(line) OVER (PARTITION BY doc_id ORDER BY u) AS b, worded FROM s UNION ALL
      SELECT doc_id, u, 1, line, line, true FROM s WHERE len(regexp_extract_all(line, '{WORD}')) > {WORDS}),
k AS (SELECT doc_id, u, w, row_number() OVER (PARTITION BY w, a, b ORDER BY doc_id, u) > 1 AS gone FROM m WHERE worded AND b IS NOT NULL),
g AS (SELECT doc_id, u FROM k WHERE gone UNION SELECT doc_id, u + 1 FROM k WHERE gone AND w = 2),
x AS (SELECT s.*, g.u IS NOT NULL AS gone FROM s LEFT JOIN g USING (doc_id, u)),
c AS (SELECT *, gone IS DISTINCT FROM lag(gone) OVER (PARTITION BY doc_id ORDER BY u) AS starts FROM x),
o AS (SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY u) FILTER (NOT gone), '') AS text, sum(lines) AS n_lines, count(*) FILTER (starts) AS n_chunks,
      count(*) FILTER (starts AND gone) AS removed_chunks, sum(lines) FILTER (gone) AS removed_lines FROM c GROUP BY doc_id)
SELECT doc_id, CASE WHEN d.text IS NOT NULL THEN o.text END AS text, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, coalesce(n_chunks, 0) AS n_chunks,
  coalesce(removed_chunks, 0) AS removed_chunks, CAST(coalesce(removed_lines, 0) AS BIGINT) AS removed_lines FROM d LEFT JOIN o USING (doc_id)"""
