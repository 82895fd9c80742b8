"""Queries over documents, pages, conversations and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import retrieval
from ..operators import text as X
from ..operators.tables import fresh
from ..registry import query
from ..sources.derived import raw

_CLEAN = r"trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ')"


@query("F26_clean", f"SELECT doc_id, length({_CLEAN}) AS n, md5({_CLEAN}) AS digest FROM documents")
def f26(s, d):
    c = X.clean(F.col("text"))
    return raw(s, d, "documents").select("doc_id", F.length(c).cast("long").alias("n"), F.md5(c).alias("digest"))


@query("R02_windows", """WITH w AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 600)) AS p FROM documents WHERE text IS NOT NULL),
  c AS (SELECT doc_id, CAST(p // 600 AS INT) AS ord, trim(substr(text, p + 1, 800), ' ') AS chunk FROM w) SELECT doc_id, ord, length(chunk) AS n, md5(chunk) AS digest FROM c WHERE length(chunk) >= 100""")  # fmt: skip
def r02(s, d):
    return X.windows(raw(s, d, "documents")).select("doc_id", "ord", F.length("chunk").cast("long").alias("n"), F.md5("chunk").alias("digest"))


@query("R03_instruction", "SELECT doc_id, source || ': ' || replace(substr(text, 1, 80), chr(10), ' ') AS instruction FROM documents")
def r03(s, d):
    """A label of a chunk: its source and first 80 characters."""
    return raw(s, d, "documents").select("doc_id", F.concat(F.col("source"), F.lit(": "), F.replace(F.substring("text", 1, 80), F.lit("\n"), F.lit(" "))).alias("instruction"))


@query("F25_content_hash", "SELECT doc_id, sha256(text) AS sha, substr(md5(text), 1, 16) AS short_id FROM documents")
def f25(s, d):
    return raw(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.substring(F.md5("text"), 1, 16).alias("short_id"))


@query("J12_new_by_hash", """WITH h AS (SELECT doc_id, sha256(text) AS sha FROM documents), k AS (SELECT DISTINCT sha FROM h WHERE doc_id % 3 = 0)
  SELECT doc_id FROM h WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.sha = h.sha)""")  # fmt: skip
def j12(s, d):
    """Documents whose content isn't stored yet; every third document stands for the store."""
    h = raw(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return h.join(h.where("doc_id % 3 = 0").select("sha").distinct(), "sha", "left_anti").select("doc_id")


@query("U02_distinct_by_key", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(text)")
def u02(s, d):
    return raw(s, d, "documents").groupBy(F.md5("text")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("W18_last_messages", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 20")
def w18(s, d):
    """The last 20 messages of each conversation: the limit is the operator's."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return raw(s, d, "conversations").select("conv_id", "turn", "role").withColumn("rn", F.row_number().over(w)).where("rn <= 20").drop("rn")


#: Scripts and styles go with what they hold, to the page's end where they have none; a tag has no other within it. So no search runs in vain to the page's end.
_HIDDEN, _TAG, _WHITE = r"(?is)<script(?:\s[^<>]*)?>.*?(?:</script>|\z)|<style(?:\s[^<>]*)?>.*?(?:</style>|\z)", r"<[^<>]*>", r"[ \t\r\n]+"


@query("S22_page_fields", rf"""WITH t AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '{_HIDDEN}', ' ', 'g'), '{_TAG}', ' ', 'g') AS plain FROM pages)
  SELECT page_id, trim(regexp_extract(html, '(?is)<title[^<>]*>([^<]*)', 1), ' ') AS title, len(regexp_extract_all(html, '(?i)<a\s[^<>]*href')) AS links, trim(regexp_replace(plain, '{_WHITE}', ' ', 'g'), ' ') AS text, length(plain) AS text_chars FROM t""")  # fmt: skip
def s22(s, d):
    """Title, number of links and readable text of each page."""
    h = F.col("html")
    text = F.regexp_replace(F.regexp_replace(h, _HIDDEN, " "), _TAG, " ")
    links = F.size(F.regexp_extract_all(h, F.lit(r"(?i)<a\s[^<>]*href"), F.lit(0))).cast("long")
    plain = F.trim(F.regexp_replace(text, _WHITE, " ")).alias("text")
    return raw(s, d, "pages").select("page_id", F.trim(F.regexp_extract(h, r"(?is)<title[^<>]*>([^<]*)", 1)).alias("title"), links.alias("links"), plain, F.length(text).cast("long").alias("text_chars"))


@query("F35_keyword_tags", "SELECT doc_id, list_filter(['the', 'tion', 'und', 'les', 'que'], lambda k: contains(lower(text), k)) AS tags FROM documents")
def f35(s, d):
    words = F.array(*[F.lit(w) for w in ("the", "tion", "und", "les", "que")])
    return raw(s, d, "documents").select("doc_id", F.filter(words, lambda k: F.contains(F.lower("text"), k)).alias("tags"))


@query("A41_index_stats", "SELECT source, lang, count(*) AS n, sum(length(text)) AS chars FROM documents GROUP BY ROLLUP (source, lang)")
def a41(s, d):
    return raw(s, d, "documents").rollup("source", "lang").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))


@query("T04_page", "SELECT doc_id, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY doc_id LIMIT 20 OFFSET 40")
def t04(s, d):
    """Rows 41 to 60 and the number of all: the limit is the operator's."""
    docs = raw(s, d, "documents").select("doc_id")
    return docs.orderBy("doc_id").offset(40).limit(20).join(docs.agg(F.count("*").alias("total")), F.lit(True))


_TOP = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, b.label, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a, v b WHERE a.vec_id % 50 = 0),
  t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM p)"""


def _top(s, d, k):
    v = raw(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")
    return X.top_matches(v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")), v, k), v


@query("R04_top_matches", _TOP + " SELECT query_id, id, round(score, 4) AS score FROM t WHERE place <= 5")
def r04(s, d):
    """Every 50th vector asks; each is answered by its five nearest."""
    return _top(s, d, 5)[0].select("query_id", "id", F.round("score", 4).alias("score"))


@query("R05_filtered_search", _TOP + """, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS q FROM t WHERE place <= 15 AND score >= 0.2 AND label IN (0, 3, 7))
  SELECT query_id, id, CAST(q AS INT) AS place FROM f WHERE q <= 5""")  # fmt: skip
def r05(s, d):
    """Fifteen are fetched, then filtered by score and type, then cut to five."""
    top, v = _top(s, d, 15)
    w = Window.partitionBy("query_id").orderBy("place")
    held = top.join(v.select("id", "label"), "id").where("score >= 0.2 AND label IN (0, 3, 7)")
    return held.withColumn("q", F.row_number().over(w)).where("q <= 5").select("query_id", "id", F.col("q").alias("place"))


@query("R06_confidence", _TOP + " SELECT query_id, CASE WHEN score >= 0.65 THEN 'exact' WHEN score >= 0.35 THEN 'context' ELSE 'none' END AS route FROM t WHERE place = 2")
def r06(s, d):
    """By the best answer other than the question itself."""
    score = F.col("score")
    return _top(s, d, 2)[0].where("place = 2").select("query_id", F.when(score >= 0.65, "exact").when(score >= 0.35, "context").otherwise("none").alias("route"))


@query("R04_R07_index_search")
def r04_index(s, d):
    """The five nearest of every 50th vector by an index of lists: built, written, read again and searched in as many lists as its sample asks for. No SQL twin, since some matches may be missed: tests hold
    its recall against the exact scan at 0.9 or more."""
    v = raw(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    at = fresh(s, "index")
    retrieval.build(v, at)
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return retrieval.search(retrieval.load(s, at), q, 5).select("query_id", "id", F.round("score", 4).alias("score"))
