"""URL rules found through their rarest literal token; only fetched rules run their regular expression."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import quoted

#: Rules given as a list on the driver; more must come as a DataFrame of rule_rows()' columns.
MOST_LISTED = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as written; both empty for null or where `://` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def tokens(target: Column) -> Column:
    """Distinct lower-case runs of letters and digits, and the empty token, which stands for rules without a literal."""
    return F.array_distinct(F.concat(F.split(F.translate(target, UPPER, LOWER), "[^a-z0-9]+", -1), F.array(F.lit(""))))


def rule_rows(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str, str, int, list[str]]]:
    """(rule, verdict, pattern, length, literals) of (verdict, "host/path") rules. A rule's host also stands for its
    subdomains, its path for every path that starts with it; so a last token that nothing ends is no literal."""
    if len(rules) > MOST_LISTED:
        raise ValueError(f"{len(rules)} rules in a list; give a DataFrame")
    out = []
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        text = host.lower() + slash + path
        found = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", text.lower())
        out.append((text, verdict, r"^(?:[^/]*\.)?" + re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", text), len(text), found or [""]))
    return out


def judge(df: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule and verdict: those of the longest rule that fits (ties: the smallest text), else null and
    `default`. Null and odd urls have empty host and path and meet only rules without a literal. Columns of df with the
    four names are replaced; repeated rows stay.

    How often each rule token occurs over all distinct urls is counted first; each rule then waits under its rarest one.
    Urls' tokens meet those in an equi-join (Spark broadcasts the rules where they are small enough, else shuffles), and
    a rule's expression runs on the urls that fetched it. Verdicts are made once for each distinct url."""
    spark = df.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rule_rows(rules), "rule string, verdict string, pattern string, length int, literals array<string>")
    host, path = host_path(F.col("__url"))
    urls = df.select(F.col(quoted(url)).alias("__url")).where("__url IS NOT NULL").distinct()
    urls = urls.select("__url", F.concat(host, path).alias("target")).withColumn("token", F.explode(tokens(F.col("target"))))
    literals = rules.select("rule", F.explode("literals").alias("token"))
    counts = urls.join(literals.select("token").distinct(), "token").groupBy("token").count()
    rarest = literals.join(counts, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("r"))
    index = rules.join(rarest.select("rule", F.col("r.token").alias("token")), "rule").select("token", "rule", "verdict", "pattern", "length")
    hits = urls.join(index, "token").where("regexp_like(target, pattern)")
    best = hits.groupBy(F.col("__url")).agg(F.min(F.struct((-F.col("length")).alias("l"), "rule", "verdict")).alias("b"))
    keep = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    row = df.select(F.struct(*[F.col(quoted(c)) for c in keep]).alias("row"), F.col(quoted(url)).alias("u"))
    out = row.join(best, F.col("u") == F.col("__url"), "left")
    host, path = host_path(F.col("u"))
    return out.select(*[F.col(f"row.{quoted(c)}").alias(c) for c in keep], host.alias("host"), path.alias("path"), F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))


#: The rules of the query.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

ORACLE = f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS t FROM pages),
h AS (SELECT page_id, translate(regexp_extract(t, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(t, length(regexp_extract(t, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM r),
x(verdict, rh, rp) AS (VALUES {', '.join(f"('{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)}),
b AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict FROM h JOIN x ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN b USING (page_id)"""
