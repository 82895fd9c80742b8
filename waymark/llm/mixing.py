"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree. DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, cut, quoted

SEED = 17
#: Words of a block at most; blocks of a source at least (as far as it has words); blocks of an output shard.
BLOCK_WORDS, LEAST_BLOCKS, SHARD_BLOCKS = 1024, 1024, 256
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Rows of a slice of a hash order, about; blocks that one task makes at once.
SLICE, PART = 1024, 4096


def words(text: Column) -> Column:
    """Number of runs of characters that aren't ASCII white space; null has 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source_key: source_size, weight, target. Sources in order take the weights in turn and share `share` times all
    words; a target stops at `most` times its source's size and the excess is shared by weight again. The level at which
    no target is above is the largest of (rest of the words) / (rest of the weights) over the sources by size / weight.
    Works on one row for each source, which are few beside documents."""
    per = sizes.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))).withColumn("most", F.col("source_size") * most)
    by = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    whole = Window.partitionBy()
    before = F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most")
    rest = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (share * F.sum("source_size").over(whole) - before) / rest)
    return per.withColumn("target", F.least("most", F.max("level").over(whole) * F.col("weight"))).drop("level", "most")


def _uniform(*parts: Column) -> Column:
    """A number between 0 and 1 by md5, on which SQL engines agree."""
    h = F.md5(F.concat_ws(":", F.lit(str(SEED)), *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Marked ones among `drawn` of `total`, of which `marked` are marked: the distribution function is inverted at u.
    Its terms come from their ratio, from ten standard deviations (and ten) below the mode to as many above."""
    low, high = F.greatest(F.lit(0), drawn - (total - marked)), F.least(drawn, marked)
    n = F.greatest(total, F.lit(1))
    mode = F.least(high, F.greatest(low, F.floor((drawn + 1) * ((marked + 1) / (total + 2)))))
    sd = F.sqrt(F.greatest(F.lit(0.0), drawn * (marked / n) * ((n - marked) / n) * ((n - drawn) / F.greatest(n - 1, F.lit(1)))))
    reach = F.ceil(10 * sd).cast("long") + 10
    run = F.sequence(F.greatest(low, mode - reach).cast("long"), F.least(high, mode + reach).cast("long"))
    ratio = lambda k: (marked - k) * ((drawn - k) / ((k + 1.0) * (total - marked - drawn + k + 1)))
    whole = F.aggregate(
        run, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s")),
        lambda a, k: F.struct((a["w"] * ratio(k)).alias("w"), (a["s"] + a["w"]).alias("s")), lambda a: a["s"],
    )
    return F.aggregate(
        run, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.element_at(run, 1).alias("x"), (whole * u).alias("at")),
        lambda a, k: F.struct((a["w"] * ratio(k)).alias("w"), (a["s"] + a["w"]).alias("s"), F.when(a["s"] <= a["at"], k).otherwise(a["x"]).alias("x"), a["at"].alias("at")),
        lambda a: a["x"],
    )


def split_quotas(quotas: DataFrame, shards: int) -> DataFrame:
    """(shard, q, first): per shard, how many blocks each stratum gives, and from which place of the stratum's order on.

    quotas: one row with q, every stratum's blocks to give, and u, its blocks to leave. A node holds several shards and an
    interval of each stratum's order, as long as what it gives and leaves there. It draws, stratum by stratum, how many of
    its blocks go to its left half, in proportion to that half's shards; what is left goes right, and the interval is cut
    accordingly. Thus quotas are met exactly, shards differ by one block at most and their intervals are disjoint. Nodes
    are spread over tasks as the tree widens."""
    start = F.struct(F.expr("total * (mid - lo) div (hi - lo)").alias("left"), F.col("total").alias("all"), F.array().cast("array<bigint>").alias("out"))

    def draw(a: Column, k: Column) -> Column:
        x = hypergeometric(a["all"], k, a["left"], _uniform(F.col("lo"), F.col("hi"), F.size(a["out"]))).cast("long")
        one = F.transform(F.array(x), lambda v: F.struct((a["left"] - v).alias("left"), (a["all"] - k).alias("all"), F.concat(a["out"], F.array(v)).alias("out")))
        return F.element_at(one, 1)

    drawn_left = F.when(F.expr("hi - lo > 1"), F.aggregate("q", start, draw, lambda a: a["out"])).alias("l")
    halves = F.expr("""explode(IF(hi - lo > 1, array(named_struct('lo', lo, 'hi', mid, 'q', l, 'u', ul, 'first', first),
        named_struct('lo', mid, 'hi', hi, 'q', zip_with(q, l, (a, b) -> a - b), 'u', zip_with(u, ul, (a, b) -> a - b), 'first', zip_with(zip_with(first, l, (a, b) -> a + b), ul, (a, b) -> a + b))),
        array(named_struct('lo', lo, 'hi', hi, 'q', q, 'u', u, 'first', first)))) AS n""")
    nodes = quotas.selectExpr("0L AS lo", f"{shards}L AS hi", "q", "u", "transform(q, x -> 0L) AS first")
    for level in range(max(0, math.ceil(math.log2(shards)))):
        if level and level % 6 == 0:
            nodes = cut(nodes.repartition("lo"))
        nodes = nodes.selectExpr("*", "(lo + hi) div 2 AS mid", "aggregate(q, 0L, (a, x) -> a + x) AS total").select("*", drawn_left, F.expr("transform(u, x -> x * (mid - lo) div (hi - lo)) AS ul"))
        nodes = nodes.select(halves).select("n.*")
    return nodes.select(F.col("lo").alias("shard"), "q", "first")


def _digits(rows: int) -> int:
    """Hexadecimal digits of a hash that part so many rows into slices."""
    return max(1, math.ceil(math.log(max(1.0, rows / SLICE), 16)))


def _before(sums: DataFrame, by: str, what: str) -> DataFrame:
    """sums (source_key, slice, what) with `before`: what stands in the source's slices before."""
    w = Window.partitionBy("source_key").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return sums.withColumn("before", F.sum(what).over(w) - F.col(what))


@dataclass
class Mix:
    """documents: doc_id, size, source_size, target, source_key, start (its place in its source's order of words), home (the
    block that holds its first word), row. blocks: shard, position in the shard, source_key, pass, block. pieces:
    source_key, start, block, doc_id, doc_from, length: what each block holds."""

    documents: DataFrame
    blocks: DataFrame
    pieces: DataFrame


def mix(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS,
    row: str | None = None, least_blocks: int = LEAST_BLOCKS,
) -> Mix:
    """Plan a mix of all rows of df; texts aren't moved.

    Each source's documents stand in the order of an md5 of key and text, so that null and repeated keys are spread too, and their words are cut into blocks of equal length (the last
    may be shorter): block_words, or fewer where the source would have under least_blocks. A source passes over its blocks
    as often as its target holds it whole, and then gives part of them; what a pass gives and leaves is a stratum. The tree
    says how many blocks of each stratum a shard gets, and from where in the order of the blocks' md5; so which blocks are
    taken, in which shard, is its decision, and no block twice in a pass. Within a shard, blocks are ordered by a hash.
    A source's words taken are its target but for less than two blocks.

    Places in an order are sums within slices of it, then over slices, so that a source with most rows is no task's burden.
    Null text has size 0, null source is a source of its own and comes last; rows with equal keys stay apart; a source
    without words gives nothing; empty input gives empty tables. Reruns agree. A column named as `row` goes along as row and
    says whose decision is whose where keys are null or repeated; else row is null. Other columns are not looked at."""
    key_, text_, source_ = (F.col(quoted(c)) for c in (key, text, source))
    order = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(key_.cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(text_), F.lit(""))))
    skey = F.coalesce(F.concat(F.lit("s"), source_), F.lit("n"))
    named = F.lit(None).cast("long") if row is None else F.col(quoted(row))
    rows = cut(df.select(key_.alias("doc_id"), source_.alias("source"), skey.alias("source_key"), words(text_).alias("size"), order.alias("h"), named.alias("row")))
    size = F.col("source_size")
    goal = targets(rows).withColumn("words", F.floor("target").cast("long"))
    goal = goal.withColumn("bw", F.greatest(F.lit(1), F.least(F.lit(block_words), F.expr(f"(source_size + {least_blocks - 1}) div {least_blocks}"))).cast("long"))
    goal = cut(goal.select("source_key", "rank", "source_size", "target", "words", "bw", F.expr("(source_size + bw - 1) div bw").alias("n")))

    passes = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / size).cast("long")))
    strata = goal.where("words > 0").withColumn("pass", passes)
    rest = F.col("words") - F.col("pass") * size
    strata = strata.withColumn("q", F.when(rest >= size, F.col("n")).otherwise(F.least("n", F.floor(rest / F.col("bw") + 0.5).cast("long")))).where("q > 0")
    strata = cut(strata.withColumn("i", F.row_number().over(Window.orderBy("rank", "pass"))).select("source_key", "pass", "n", "q", "i"))
    given, held = strata.agg(F.coalesce(F.sum("q"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(1, math.ceil(given / shard_blocks))

    rows = rows.withColumn("slice", F.substring("h", 1, _digits(rows.count())))
    sums = rows.groupBy("source_key", "slice").agg(F.sum("size").alias("s"))
    sums = cut(_before(sums, "slice", "s").select("source_key", "slice", "before").join(goal.drop("rank", "words"), "source_key"))
    inside = F.sum("size").over(Window.partitionBy("source_key", "slice").orderBy("h", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = rows.withColumn("inside", inside).join(sums, ["source_key", "slice"]).withColumn("start", F.col("before") + F.col("inside"))
    placed = placed.withColumn("home", F.when(F.col("n") > 0, F.least(F.expr("start div bw"), F.col("n") - 1)))
    placed = placed.select("doc_id", "size", "source_size", "target", "source_key", "start", "home", "row", "bw")

    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.col("home"), F.expr("(start + size - 1) div bw"))))
    a, b = F.greatest("start", F.col("block") * F.col("bw")), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("bw"))
    pieces = pieces.select("source_key", "start", "block", "doc_id", (a - F.col("start")).alias("doc_from"), (b - a).alias("length"))

    # each block's place in its source's hash order
    parts = goal.where("n > 0").select("source_key", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {PART}"))).alias("part"))
    every = F.explode(F.sequence(F.col("part") * PART, F.least(F.col("n"), (F.col("part") + 1) * PART) - 1))
    numbered = parts.repartition("source_key", "part").select("source_key", every.alias("block"))
    numbered = numbered.withColumn("h", F.md5(F.concat_ws(":", F.lit(str(SEED)), "source_key", "block"))).withColumn("slice", F.substring("h", 1, _digits(held)))
    sums = cut(_before(numbered.groupBy("source_key", "slice").count(), "slice", "count").select("source_key", "slice", "before"))
    at = F.row_number().over(Window.partitionBy("source_key", "slice").orderBy("h", "block")) - 1
    ranked = numbered.withColumn("at", at).join(sums, ["source_key", "slice"]).select("source_key", "block", (F.col("before") + F.col("at")).alias("slot"))

    quotas = strata.agg(F.array_sort(F.collect_list(F.struct("i", "n", "q"))).alias("z")).select(F.transform("z", lambda x: x["q"]).alias("q"), F.transform("z", lambda x: x["n"] - x["q"]).alias("u"))
    leaves = cut(split_quotas(quotas, shards))
    dealt = leaves.select("shard", F.posexplode(F.arrays_zip("q", "first")).alias("i", "z")).where("z.q > 0")
    dealt = dealt.select("shard", (F.col("i") + 1).alias("i"), F.explode(F.sequence(F.col("z.first"), F.col("z.first") + F.col("z.q") - 1)).alias("slot"))
    blocks = dealt.join(strata.select("i", "source_key", "pass"), "i").join(ranked, ["source_key", "slot"])
    place = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(SEED), "shard", "source_key", "pass", "block"), "source_key", "pass", "block"))
    return Mix(placed.drop("bw"), cut(blocks.select("shard", place.alias("position"), "source_key", "pass", "block")), pieces)


def drawn(m: Mix) -> DataFrame:
    """The mix: shard, position, pass, source_key, block, start, doc_id, doc_from, length; every piece of every block that
    the tree dealt. Within a shard, order by position and start. Empty where the mix is."""
    return m.blocks.join(m.pieces, ["source_key", "block"])


def stands(m: Mix) -> DataFrame:
    """Whole documents in the mix's order: row, shard, position, start, once for each pass that takes the block with the
    document's first word (of an empty one: the block at its place)."""
    return m.documents.select("row", "source_key", "start", F.col("home").alias("block")).join(m.blocks, ["source_key", "block"]).select("row", "shard", "position", "start")


def taken(m: Mix) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words of its pieces that were drawn), shard (the first that
    has one, null if none) and row. Repeated rows and null keys stay apart by their place."""
    got = drawn(m).groupBy("source_key", "start").agg(F.sum("length").alias("taken"), F.min("shard").alias("shard"))
    had = m.documents.alias("d").join(got.alias("g"), (F.col("d.source_key") == F.col("g.source_key")) & (F.col("d.start") == F.col("g.start")) & (F.col("d.size") > 0), "left")
    return had.select("d.doc_id", "d.size", "d.source_size", "d.target", F.coalesce("g.taken", F.lit(0)).cast("long").alias("taken"), "g.shard", "d.row")


def _oracle() -> str:
    let = lambda value, name, body: f"list_transform([{value}], lambda {name}: {body})[1]"
    ratio = "(e.k - it.x) * ((a.le - it.x) / ((it.x + 1.0::DOUBLE) * (a.al - e.k - a.le + it.x + 1)))"
    sd = "sqrt(greatest(0.0::DOUBLE, a.le * (e.k / n) * ((n - e.k) / n) * ((n - a.le) / greatest(n - 1, 1))))"
    run = let("greatest(a.al, 1)", "n", let("greatest(0, a.le - (a.al - e.k))", "low", let("least(a.le, e.k)", "high", let(
        "least(high, greatest(low, CAST(floor((a.le + 1) * ((e.k + 1) / (a.al + 2))) AS BIGINT)))", "mode", let(f"CAST(ceil(10 * {sd}) AS BIGINT) + 10", "reach",
        "range(greatest(low, mode - reach), least(high, mode + reach) + 1)")))))
    item = lambda k: f"{{'w': 1.0::DOUBLE, 's': 0.0::DOUBLE, 'x': {k}, 'at': 0.0::DOUBLE}}"
    step = lambda x, at: f"{{'w': b.w * ({ratio}), 's': b.s + b.w, 'x': {x}, 'at': {at}}}"
    fold = lambda at, x, out: f"list_reduce(list_transform(run, lambda k: {item('k')}), lambda b, it: {step(x, at)}, {{'w': 1.0::DOUBLE, 's': 0.0::DOUBLE, 'x': run[1], 'at': {out}}})"
    u = f"((CAST('0x' || substr(md5('{SEED}:' || lo || ':' || hi || ':' || len(a.ou)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / {1 << 52}::DOUBLE)"
    x = let(run, "run", let(fold("0.0::DOUBLE", "b.x", "0.0::DOUBLE") + ".s", "whole", fold("b.at", "CASE WHEN b.s <= b.at THEN it.x ELSE b.x END", f"whole * {u}") + ".x"))
    zero = "[]::BIGINT[]"
    draw = f"list_reduce(list_transform(q, lambda k: {{'k': k, 'le': 0::BIGINT, 'al': 0::BIGINT, 'ou': {zero}}}), lambda a, e: {let(x, 'x', "{'k': e.k, 'le': a.le - x, 'al': a.al - e.k, 'ou': list_append(a.ou, x)}")}, {{'k': 0::BIGINT, 'le': le, 'al': al, 'ou': {zero}}}).ou"
    zipped = lambda a, b, op: f"list_transform({a}, lambda v, i: v {op} {b}[i])"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS source_key, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS h FROM documents),
s AS (SELECT source, source_key, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rank FROM s),
v AS (SELECT *, CAST([3, 1, 2][(rank - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS most FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - (sum(most) OVER (ORDER BY most / weight, rank ROWS UNBOUNDED PRECEDING) - most))
  / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM v),
t AS (SELECT *, least(most, max(level) OVER () * weight) AS target, greatest(1, least({BLOCK_WORDS}, (source_size + {LEAST_BLOCKS - 1}) // {LEAST_BLOCKS})) AS bw FROM l),
g AS (SELECT *, CAST(floor(target) AS BIGINT) AS words, (source_size + bw - 1) // bw AS n FROM t),
p AS (SELECT d.*, g.source_size, g.target, g.bw, CAST(sum(size) OVER (PARTITION BY d.source_key ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start FROM d JOIN g USING (source_key)),
k AS (SELECT source_key, rank, pass, n, CASE WHEN words - pass * source_size >= source_size THEN n ELSE least(n, CAST(floor((words - pass * source_size) / bw + 0.5::DOUBLE) AS BIGINT)) END AS q
  FROM (SELECT *, unnest(range((words - 1) // source_size + 1)) AS pass FROM g WHERE words > 0)),
y AS (SELECT *, row_number() OVER (ORDER BY rank, pass) AS i FROM k WHERE q > 0),
o AS (SELECT list(q ORDER BY i) AS q, list(n - q ORDER BY i) AS u, greatest(1, CAST(ceil(sum(q) / {SHARD_BLOCKS}) AS BIGINT)) AS shards FROM y),
tree(lo, hi, q, u, f) AS (
  SELECT 0::BIGINT, shards, q, u, list_transform(q, lambda x: 0::BIGINT) FROM o WHERE q IS NOT NULL
  UNION ALL SELECT z.lo, z.hi, z.q, z.u, z.f FROM (SELECT unnest([{{'lo': lo, 'hi': mid, 'q': l, 'u': ul, 'f': f}},
      {{'lo': mid, 'hi': hi, 'q': {zipped('q', 'l', '-')}, 'u': {zipped('u', 'ul', '-')}, 'f': list_transform(f, lambda v, i: v + l[i] + ul[i])}}]) AS z
    FROM (SELECT *, {draw} AS l, list_transform(u, lambda x: x * (mid - lo) // (hi - lo)) AS ul
      FROM (SELECT *, al * (mid - lo) // (hi - lo) AS le FROM (SELECT *, (lo + hi) // 2 AS mid, CAST(list_sum(q) AS BIGINT) AS al FROM tree WHERE hi - lo > 1))))),
e AS (SELECT lo AS shard, i, q[i] AS c, f[i] AS f FROM (SELECT *, unnest(range(1, len(q) + 1)) AS i FROM tree WHERE hi - lo = 1)),
b AS (SELECT shard, source_key, pass, unnest(range(f, f + c)) AS slot FROM e JOIN y USING (i)),
r AS (SELECT source_key, block, row_number() OVER (PARTITION BY source_key ORDER BY md5('{SEED}:' || source_key || ':' || block), block) - 1 AS slot FROM (SELECT source_key, unnest(range(n)) AS block FROM g)),
x AS (SELECT source_key, block, shard FROM b JOIN r USING (source_key, slot)),
m AS (SELECT *, unnest(range(start // bw, (start + size - 1) // bw + 1)) AS block FROM p WHERE size > 0),
c AS (SELECT source_key, start, CAST(sum(least(start + size, (block + 1) * bw) - greatest(start, block * bw)) AS BIGINT) AS taken, min(shard) AS shard FROM m JOIN x USING (source_key, block) GROUP BY ALL)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, shard FROM p LEFT JOIN c ON p.source_key = c.source_key AND p.start = c.start AND size > 0"""


ORACLE = _oracle()
