"""Jaccard join on word shingles: prefixes under several global orders, intersected before verification."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import LAST, components, cut, quoted
from .shingles import mixed, shingle_sets

N, PERCENT = 4, 85
#: Sets of at least so many shingles are compared by those whose hash lies in the lowest part of the hash space only: that
#: part is so many times the distance allowed. Neighbouring classes overlap, so two similar sets share one.
CLASSES = ((0, None), (85, 3.3), (340, 2.0), (1700, 1.6), (6000, 1.35))
BITS = 48
#: Rounds in which sets meet list heads; sets that are compared with one another at once, each counted once and once more for
#: each LONG shingles.
STARS, BLOCK, LONG = 2, 256, 1000
#: Rows whose texts a task turns into strings at once.
ROWS = 500


def size_classes(percent: int, classes: tuple = CLASSES) -> list[tuple[int, int, int]]:
    """(least, most, bound): a set with least <= size < most uses its hashes under bound. Classes that would put a set into three at once, as a low
    percent does, are left out: the one before then reaches further."""
    chosen: list = []
    for one in classes:
        if len(chosen) < 2 or -(-100 * chosen[-1][0] // percent) + 1 <= one[0]:
            chosen.append(one)
    out, classes = [], tuple(chosen)
    for k, (least, times) in enumerate(classes):
        most = -(-100 * classes[k + 1][0] // percent) + 1 if k + 1 < len(classes) else 1 << 62
        share = 1.0 if times is None else min(1.0, times * (100 - percent) / 100)
        out.append((least, most, int(share * (1 << BITS))))
    return out


def _sets(batches: Iterator, n: int) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        texts = (text for at in range(0, batch.num_rows, ROWS) for text in batch.column(1).slice(at, ROWS).to_pylist())
        yield from zip(batch.column(0).to_pylist(), shingle_sets(texts, n), strict=True)


def _row(key: Column, text: Column) -> Column:
    """64 bits that name a row by its key, null or not, and its text."""
    return F.xxhash64(F.lit(7), key.cast("long"), key.isNull(), text, text.isNull())


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    k, t = F.col(quoted(key)), F.col(quoted(text))
    return df.select(_row(k, t).alias("doc"), t.alias("text"), F.coalesce(k.cast("long"), F.lit(LAST)).alias("key"))


def signatures(df: DataFrame, n: int, percent: int, classes: tuple = CLASSES) -> DataFrame:
    """(doc, key, n, s1, s2, in0, n0, in1, n1): size and 128-bit digest of each row's set; the one or two size classes it
    is in, and how many of its hashes each uses."""
    import pyarrow as pa

    bounds = size_classes(percent, classes)
    schema = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("in0", pa.int32()), ("n0", pa.int64()), ("in1", pa.int32()), ("n1", pa.int64())])

    def run(batches: Iterator) -> Iterator:
        out: list[tuple] = []
        rows = ((*row, key) for batch in batches for row, key in zip(_sets(iter([batch]), n), batch.column(2).to_pylist(), strict=True))
        for doc, s, key in rows:
            with np.errstate(over="ignore"):
                s1, s2 = (int(mixed(s * np.uint64(2 * k + 1) + np.uint64(k)).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0 for k in (1, 2))
            short = s >> np.uint64(64 - BITS)
            uses = [(k, int(np.searchsorted(short, bound))) for k, (least, most, bound) in enumerate(bounds) if least <= len(s) < most]
            uses = [*uses, (None, None)][:2]
            out.append((doc, key, len(s), s1, s2, *uses[0], *uses[1]))
            if len(out) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return df.mapInArrow(run, "doc long, key long, n long, s1 long, s2 long, in0 int, n0 long, in1 int, n1 long")


def entries(df: DataFrame, n: int, percent: int, classes: tuple = CLASSES) -> DataFrame:
    """(token, doc): the hashes each set uses in each of its size classes; a token holds its class above the hash."""
    import pyarrow as pa

    bounds = size_classes(percent, classes)

    def run(batches: Iterator) -> Iterator:
        tokens: list[np.ndarray] = []
        docs: list[int] = []
        held = 0

        def batch() -> pa.RecordBatch:
            sizes = [len(t) for t in tokens]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).astype(np.int64)), pa.array(np.repeat(np.array(docs, np.int64), sizes))], names=["token", "doc"])

        for doc, s in _sets(batches, n):
            short = s >> np.uint64(64 - BITS)
            for k, (least, most, bound) in enumerate(bounds):
                if least <= len(s) < most and len(s):
                    tokens.append(np.unique(short[: np.searchsorted(short, bound)]) | np.uint64(k << BITS))
                    docs.append(doc)
                    held += len(tokens[-1])
            if held > 200_000:
                yield batch()
                tokens, docs, held = [], [], 0
        if docs:
            yield batch()

    return df.mapInArrow(run, "token long, doc long")


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose whole sets reach the similarity."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                # a text that many pairs of a batch have is hashed once
                left, right = part.column(2).to_pylist(), part.column(3).to_pylist()
                distinct = list(dict.fromkeys([*left, *right]))
                sets = dict(zip(distinct, shingle_sets(distinct, n), strict=True))
                keep = []
                for x, y in zip(left, right, strict=True):
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    keep.append(100 * both >= percent * (len(sets[x]) + len(sets[y]) - both) and both > 0)
                if any(keep):
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep))

    one = texts.select(F.col("doc").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("doc").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two sets share, as a square matrix: products of 0/1 matrices over what several sets have."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    both = np.zeros((len(sets), len(sets)), np.int64)
    members, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    frequent = np.bincount(at, minlength=len(members)) > 1
    at, owner = (np.cumsum(frequent) - 1)[at[frequent[at]]], owner[frequent[at]]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    for low in range(0, int(frequent.sum()), 8192):
        here = slice(*np.searchsorted(at, (low, low + 8192)))
        part = np.zeros((len(sets), 8192), np.float32)  # sums of 8192 ones are exact
        part[owner[here], at[here] - low] = 1
        both += (part @ part.T).astype(np.int64)
    return both


def _spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (first, member) of each component of a symmetric matrix."""
    left, out = set(range(len(linked))), []
    while left:
        root = left.pop()
        edge = [root]
        while edge:
            near = [x for x in np.flatnonzero(linked[edge].any(0)).tolist() if x in left]
            left.difference_update(near)
            out += [(root, x) for x in near]
            edge = near
    return out


def blockwise(members: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) inside each family of members (doc, n, family, component, p1, p2, p3) that merge components: of two sets of
    different components the prefixes must meet under each of the three orders; then the whole sets are compared. A family is
    dealt by hash into blocks of about BLOCK; each pair of blocks is a task's group, thus no group grows with its family.
    Small families share groups."""
    weight = F.sum(F.lit(1) + F.expr(f"n div {LONG}"))
    sizes = cut(members.groupBy("family").agg(F.ceil(weight / BLOCK).alias("k"), F.count("*").alias("size")))
    some = max(1, math.ceil((members.agg(weight).first()[0] or 0) / BLOCK))
    here = members.join(sizes.where("size > 1"), "family").withColumn("i", F.pmod(F.xxhash64(F.lit(1), "doc"), "k"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))
    here = here.withColumn("j", others).withColumn("lo", F.least("i", "j")).withColumn("hi", F.greatest("i", "j"))
    small = F.col("k") == 1
    group = F.when(small, F.pmod(F.xxhash64("family"), F.lit(some))).otherwise(F.xxhash64("family", "lo", "hi"))
    here = here.select("doc", "component", "p1", "p2", "p3", "i", "lo", "hi", F.when(small, F.col("family")).otherwise(0).alias("family"), small.alias("small"), group.alias("g"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, part in rows.groupby("family", sort=False):
            component, i = part["component"].to_numpy(), part["i"].to_numpy()
            can = component[:, None] != component
            if (part["lo"] < part["hi"]).any():
                can &= i[:, None] != i
            for p in ("p1", "p2", "p3"):
                if can.any():
                    can &= _overlaps([np.asarray(x, np.int64) for x in part[p]]) > 0
            left = np.flatnonzero(can.any(1))
            if len(left):
                docs = part["doc"].to_numpy()[left]
                sets = list(shingle_sets(part["text"].iloc[left].tolist(), n))
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                both = _overlaps(sets)
                found = can[np.ix_(left, left)] & (both > 0) & (100 * both >= percent * (size[:, None] + size - both))
                out += [(docs[x], docs[y]) for x, y in _spanning(found)]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return here.join(texts, "doc").groupBy("small", "g").applyInPandas(run, "a long, b long")


def against_all(few: DataFrame, rows: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) of the few sets (doc, n), whatever the other: their whole sets' tokens are looked up among all sets', and
    whole texts decide."""
    reps = sets.select(F.col("rep").alias("doc"), F.col("n").alias("m"))
    tokens = entries(rows.join(reps.select("doc"), "doc", "left_semi"), n, percent, ((0, None),))
    mine = cut(tokens.join(few.select("doc"), "doc", "left_semi").select("token", F.col("doc").alias("a")))
    shared = tokens.join(mine, "token").where("doc <> a").groupBy("a", "doc").agg(F.count("*").alias("both"))
    shared = shared.join(few.select(F.col("doc").alias("a"), "n"), "a").join(reps, "doc")
    # tokens are shorter than hashes, so that a set may have a token or two less than shingles
    near = shared.where(f"100 * (both + 2) * 1.01 >= {percent} * (n + m - both)").select("a", F.col("doc").alias("b"))
    near = cut(near)
    both = near.select(F.col("a").alias("doc")).unionByName(near.select(F.col("b").alias("doc")))
    return verified(near, rows.join(both, "doc", "left_semi"), n, percent)


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT, classes: tuple = CLASSES) -> DataFrame:
    """Per row: key, n_shingles, component_id (smallest key reachable by links).

    Two rows link when 100 * shared shingles >= percent * shingles in either. Null and empty texts have no shingle and
    link with nothing; a text of fewer than n words is one shingle. Rows with equal sets are one class; a null key sorts
    last and gets a null component if its group has no other. Sets are of 64-bit hashes.

    1. Per row, size and digest of the set; classes of equal sets, each with one row as representative. Rows go by 64 bits
       of key and text, so that those with a null or a repeated key stay apart; only at the end do components get the
       smallest key of their rows.
    2. Shingles of the lowest part of the hash space (see CLASSES) are counted over all rows. A set that shares too few of
       its own with any other row can't reach the similarity and is left out, exactly: of two similar sets x and y,
       at least |x| - allowed - (shingles of x outside the part) shared ones lie in the part.
    3. Prefixes of what remains under three global orders: rarest first with ties by two different hashes, and a hash
       alone. Similar sets share a token in the prefixes under each. Posting lists of the first order propose pairs; the
       pairs whose second or third prefixes are disjoint go; the whole texts of the others decide.
    4. Lists are not expanded into all pairs. First each set meets the list head that most of its lists have, and links
       merge components; lists whose members are all in one component are done. What the others hold falls into families,
       in which lists of the first order, and lists of the third, connect all members. A family is compared block by block,
       as a whole or list by list, whichever moves fewer texts: so one in which many lists merely hang together costs no
       more than its lists, and a dense one is looked at once. In a block, too, pairs of different components must pass the
       three filters before their sets are compared, and only the edges that span the links come out.
    A set that has too few hashes in its part (odds below one in a million) is compared by its whole set with all others.
    Extra columns are left behind; an empty table gives an empty one; repeated rows each get their row."""
    null = lambda c: F.when(c < LAST, c)
    out = _groups(df, key, text, n, percent, classes)
    return out.select(null(F.col("key")).alias(key), F.col("n").alias("n_shingles"), null(F.coalesce("component", "key")).alias("component_id"))


def _groups(df: DataFrame, key: str, text: str, n: int, percent: int, classes: tuple = CLASSES) -> DataFrame:
    """Per row: doc (see _row), key, n, component; LAST stands for a null key, and rows without a shingle have no component."""
    rows = _rows(df, key, text)
    sigs = cut(signatures(rows, n, percent, classes))
    allowed = F.col("n") - F.ceil(F.col("n") * percent / 100)
    sets = cut(sigs.where("n > 0").groupBy("n", "s1", "s2", "in0", "n0", "in1", "n1").agg(F.min("doc").alias("rep"), F.min("key").alias("key")))
    poor = sets.where((F.col("n0") <= allowed) | F.coalesce(F.col("n1") <= allowed, F.lit(False))).select(F.col("rep").alias("doc"), "n")

    rows = rows.select("doc", "text")
    tokens = entries(rows, n, percent, classes)
    common = cut(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
    shared = tokens.join(common, "token")
    use = sets.select("rep", "n", F.explode(F.array(F.struct(F.col("in0").alias("c"), F.col("n0").alias("u")), F.struct(F.col("in1").alias("c"), F.col("n1").alias("u")))).alias("z"))
    use = use.where("z.c IS NOT NULL").select(F.col("rep").alias("doc"), "n", F.col("z.c").alias("c"), F.col("z.u").alias("used"))
    at = shared.withColumn("c", F.shiftright("token", BITS).cast("int")).join(use, ["doc", "c"])
    mine = Window.partitionBy("doc", "c")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("used") - F.col("known"))
    at = at.withColumn("known", F.count("*").over(mine)).withColumn("length", length).where("length > 0")
    ranks = {"r1": ("df", F.col("token")), "r2": ("df", F.xxhash64("token")), "r3": (F.xxhash64(F.lit(3), "token"),)}
    at = at.withColumns({r: F.row_number().over(mine.orderBy(*o)) for r, o in ranks.items()}).where("least(r1, r2, r3) <= length")
    prefixes = at.groupBy("doc", "c", "n").agg(*[F.collect_list(F.when(F.col(r) <= F.col("length"), F.col("token"))).alias(f"p{r[1]}") for r in ranks])
    prefixes = cut(prefixes)
    posts = prefixes.select("doc", "n", F.explode("p1").alias("token"))
    several = cut(posts.groupBy("token").count().where("count > 1").select("token"))
    posts = cut(posts.join(several, "token"))
    alive = posts.select("doc").distinct()
    texts = cut(rows.join(alive, "doc", "left_semi"))
    others = prefixes.select("doc", "c", "p2", "p3")

    def check(pairs: DataFrame) -> DataFrame:
        """Links among candidates (a, b, c): the other orders' prefixes must meet, then the sets decide."""
        one = others.select(F.col("doc").alias("a"), "c", F.col("p2").alias("a2"), F.col("p3").alias("a3"))
        two = others.select(F.col("doc").alias("b"), "c", F.col("p2").alias("b2"), F.col("p3").alias("b3"))
        left = pairs.join(one, ["a", "c"]).join(two, ["b", "c"]).where(F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3"))
        return verified(cut(left.select("a", "b").distinct()), texts, n, percent)

    def fits(x: Column, y: Column) -> Column:
        return (100 * x >= percent * y) & (100 * y >= percent * x)

    links: list[DataFrame] = []
    labels = posts.select(F.col("doc").alias("node"), F.col("doc").alias("component")).distinct()

    def merged(new: DataFrame) -> DataFrame:
        """Labels of all nodes when new links are added; new is a table that was cut."""
        if new.isEmpty():
            return labels
        links.append(new)
        found = components(functools.reduce(DataFrame.unionByName, links)).withColumnRenamed("node", "k")
        return cut(labels.select("node").join(found, F.col("node") == F.col("k"), "full").select(F.coalesce("node", "k").alias("node"), F.coalesce("component", "node").alias("component")))

    def opened(lists: DataFrame, turn: int) -> DataFrame:
        """Postings of lists that have several components, with each list's head by a hash of the turn."""
        held = cut(lists.join(labels, F.col("doc") == F.col("node")).drop("node"))
        head = F.min(F.struct(F.xxhash64(F.lit(turn), "doc").alias("h"), "doc", "n", "component")).alias("head")
        several = held.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), head).where("x <> y")
        return held.join(cut(several.select("token", "head")), "token")

    if not poor.isEmpty():
        labels = merged(cut(against_all(cut(poor), rows, sets, n, percent)))
    for turn in range(STARS):
        held = opened(posts, turn).withColumn("c", F.shiftright("token", BITS).cast("int"))
        meet = held.where((F.col("component") != F.col("head.component")) & fits(F.col("n"), F.col("head.n")))
        votes = meet.groupBy("doc", "c", F.col("head.doc").alias("head")).count()
        best = votes.groupBy("doc").agg(F.max(F.struct("count", "head", "c")).alias("z"))
        pairs = cut(best.select(F.col("z.head").alias("a"), F.col("doc").alias("b"), F.col("z.c").alias("c")))
        labels = merged(cut(check(pairs)))

    family = posts.select("doc").distinct().withColumn("family", F.lit(0).cast("long"))
    for lists in (posts, prefixes.select("doc", "n", F.explode("p3").alias("token"))):
        held = cut(opened(lists.join(family.select("doc"), "doc", "left_semi"), STARS).select("doc", F.col("head.doc").alias("head")).distinct())
        found = components(held, "head", "doc")
        family = cut(family.join(found.withColumnRenamed("node", "doc"), "doc").select("doc", F.xxhash64("family", "component").alias("family")))
    if not family.isEmpty():
        moves = lambda size: F.sum(F.col(size) * F.ceil(F.col(size) / BLOCK))
        by_list = cut(opened(posts, STARS).select("doc", "token").join(family, "doc"))
        listed = by_list.groupBy("family", "token").agg(F.count("*").alias("size")).where("size > 1").groupBy("family").agg(moves("size").alias("listed"))
        whole = family.groupBy("family").agg(F.count("*").alias("size")).withColumn("whole", F.col("size") * F.ceil(F.col("size") / BLOCK))
        ways = cut(whole.join(listed, "family", "left").select("family", F.coalesce(F.col("listed") < F.col("whole"), F.lit(True)).alias("by_list")))
        a = family.join(ways.where("NOT by_list").select("family"), "family")
        b = by_list.join(ways.where("by_list").select("family"), "family").select(F.xxhash64("family", "token").alias("family"), "doc")
        every = [F.flatten(F.collect_list(p)).alias(p) for p in ("p1", "p2", "p3")]
        held = prefixes.join(family.select("doc"), "doc", "left_semi").groupBy("doc").agg(F.max("n").alias("n"), *every)
        held = cut(held.join(labels, F.col("doc") == F.col("node")).drop("node"))
        labels = merged(cut(blockwise(cut(a.select("doc", "family").unionByName(b.select("doc", "family")).join(held, "doc")), texts, n, percent)))

    moved = cut(labels.where("node <> component").select(F.col("node").alias("rep"), "component"))
    named = cut(sets.select("n", "s1", "s2", "rep", "key").join(moved, "rep", "left").select("n", "s1", "s2", "key", F.coalesce("component", "rep").alias("at")))
    least = cut(named.groupBy("at").agg(F.min("key").alias("least"), F.count("*").alias("sets")).where("sets > 1"))
    per = cut(named.join(least, "at", "left").select("n", "s1", "s2", F.coalesce("least", "key").alias("component")))
    return sigs.select("doc", "key", "n", "s1", "s2").join(per, ["n", "s1", "s2"], "left")


def drop_near(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """df with the smallest key of each group of near copies; rows without words (null, empty, blank) and rows with a null key
    stay. Rows go by key and text, so that those which share a key are decided one by one, and rows that repeat both stay or
    go together. Columns, whatever their names, stay as they were; an empty table gives an empty one."""
    gone = _groups(df, key, text, n, percent).where((F.col("key") != F.col("component")) & (F.col("key") < LAST)).select("doc")
    row = _row(F.col(f"__row.{quoted(key)}"), F.col(f"__row.{quoted(text)}"))
    return df.alias("__row").join(gone.alias("__gone"), row == F.col("__gone.doc"), "left_anti")


ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < {N} THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + {N - 1}], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {N - 2}))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= {PERCENT} * (x.n + y.n - o)),
r(n, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.b, r.c FROM r JOIN l ON r.n = l.a),
c AS (SELECT n, min(c) AS c FROM r GROUP BY n)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.n = w.doc_id"""
