"""Maximal periodic runs of words, found with an enhanced suffix array, and texts without a run's later copies."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import SPACE, numbered, quoted

#: A run has SHORTEST words or more and COPIES times its period or more.
SHORTEST, COPIES = 6, 4
#: Words whose texts share one suffix array, and suffixes tested at once; a longer text has an array of its own.
TOGETHER, AT_ONCE = 150_000, 2_000_000
RUNS = "array<struct<start:long,length:long,period:long>>"


def suffix_ranks(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(order, ranks): the suffixes in order, and the ranks of all of them by their first 1, 2, 4, ... words. Suffixes that agree
    so far share a rank, the place of the first of them; by the last ranks all differ. Each round sorts what is still shared."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    found = ids[order]
    first = np.append(True, found[1:] != found[:-1])
    rank = np.empty(n, np.int32)
    rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
    ranks, places, width = [rank], np.arange(n), 1
    while True:
        shared = ~(first & np.append(first[1:], True))
        places = places[shared]
        if not len(places):
            return order, ranks
        at = order[places]
        after = np.where(at + width < n, rank[np.minimum(at + width, n - 1)].astype(np.int64) + 1, 0)
        key = rank[at].astype(np.int64) << 32 | after
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[places] = at
        first = np.append(True, key[1:] != key[:-1])
        rank = rank.copy()
        rank[at] = places[first][np.cumsum(first) - 1]
        ranks.append(rank)
        width *= 2


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """How many words each suffix in order shares with the one before it; the first has -1, and so has an entry after the last."""
    n = len(order)
    lcp = np.full(n + 1, -1, np.int64)
    lcp[1:n] = 0
    k = 1 + np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]])
    a, b = order[k - 1].copy(), order[k].copy()
    for level in range(len(ranks) - 2, -1, -1):
        within = np.maximum(a, b) < n
        same = within & (ranks[level][np.minimum(a, n - 1)] == ranks[level][np.minimum(b, n - 1)])
        a += same * (1 << level)
        b += same * (1 << level)
    lcp[k] = a - order[k - 1]
    return lcp


def next_below(values: np.ndarray, at: np.ndarray, or_equal: bool = False) -> np.ndarray:
    """For each place, the next whose value is below its own (or equal). The last value must be below all others. Minima of blocks
    of 2, 4, ... values are climbed until a block holds such a value, then descended."""
    levels = [values]
    while len(levels[-1]) > 1:
        low = levels[-1]
        if len(low) % 2:
            low = np.append(low, np.iinfo(low.dtype).max)
        levels.append(np.minimum(low[::2], low[1::2]))
    want = values[at] + (1 if or_equal else 0)
    index, height, open_ = at + 1, np.full(len(at), -1), np.arange(len(at))
    for level, low in enumerate(levels):
        right = open_[index[open_] % 2 == 1] if level < len(levels) - 1 else open_
        hit = low[index[right]] < want[right]
        height[right[hit]] = level
        index[right[~hit]] += 1
        open_ = open_[height[open_] < 0]
        index[open_] //= 2
    for level in range(len(levels) - 2, -1, -1):
        down = np.flatnonzero(height > level)
        index[down] *= 2
        index[down] += levels[level][index[down]] >= want[down]
    return index


def branching_squares(ids: np.ndarray, order: np.ndarray, ranks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, periods) of all squares that the next word doesn't go on. Both halves' suffixes lie in the interval of suffixes that
    share as many words as the period, and in different children of it; so one lies outside the largest child, and only such
    suffixes are tested: is the suffix a period further on, or back, in the interval too? Intervals are bounds in `order`; no tree is built."""
    n = len(ids)
    place, lcp = ranks[-1].astype(np.int64), common_prefixes(order, ranks)
    k = np.flatnonzero(lcp >= 1)
    if not len(k):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    depth, back, mirrored = lcp[k], n - k, lcp[::-1].copy()
    low, high = n - next_below(mirrored, back), next_below(lcp, k) - 1
    leads = n - next_below(mirrored, back, or_equal=True) == low
    # children: from each entry of the interval's depth to before the next that is as low, and what stands before the first
    left = np.concatenate([k, low[leads]])
    right = np.concatenate([next_below(lcp, k, or_equal=True), k[leads]]) - 1
    owner = np.concatenate([np.arange(len(k)), np.flatnonzero(leads)])
    by = np.lexsort((right - left, high[owner], low[owner]))
    left, right, owner = left[by], right[by], owner[by]
    small = np.append((low[owner][1:] == low[owner][:-1]) & (high[owner][1:] == high[owner][:-1]), False)
    left, right, owner = left[small], right[small], owner[small]
    sizes, found = right - left + 1, []
    ends = np.cumsum(sizes)
    begin = 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + AT_ONCE, "right")))
        size = sizes[begin:end]
        of = np.repeat(np.arange(begin, end), size)
        own = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + left[of]
        at, period = order[own], depth[owner[of]]
        for start, other in ((at, at + period), (at - period, at - period)):
            inside = np.flatnonzero((other >= 0) & (other < n))
            there = place[other[inside]]
            o = of[inside]
            ok = (there >= low[owner[o]]) & (there <= high[owner[o]]) & ((there < left[o]) | (there > right[o]))
            found.append(np.stack([start[inside[ok]], period[inside[ok]]]))
        begin = end
    starts, periods = np.unique(np.concatenate(found, axis=1), axis=1)
    return starts, periods


def word_runs(ids: np.ndarray, shortest: int = SHORTEST, copies: int = COPIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of each run of a sequence, by start, then period: a stretch with that smallest period, of `shortest` words
    and `copies` (2 at least) periods or more, that no neighbouring word goes on. A branching square ends its run; it is rotated
    left, by blocks of equal rank, to the run's first word. Squares of several periods at a time end with the same
    start and end as those of one, and go."""
    none = np.empty(0, np.int64)
    if len(ids) < 2:
        return none, none, none
    order, ranks = suffix_ranks(ids)
    at, period = branching_squares(ids, order, ranks)
    start = at.copy()
    for level in range(len(ranks) - 2, -1, -1):
        to = start - (1 << level)
        back = np.maximum(to, 0)
        start = np.where((to >= 0) & (ranks[level][back] == ranks[level][np.minimum(back + period, len(ids) - 1)]), to, start)
    end = at + 2 * period
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    new = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(start)]
    keep = new & (end - start >= np.maximum(shortest, copies * period))
    start, end, period = start[keep], end[keep], period[keep]
    by = np.lexsort((period, start))
    return start[by], (end - start)[by], period[by]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        return k


def _together(texts: list[list[bytes]], shortest: int, copies: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of each text, from one suffix array of all: texts share no word numbers, so that no run leaves its text."""
    parts, used = [], 0
    for words in texts:
        known = _Numbers()
        parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)) + used)
        used += len(known)
    bounds = np.cumsum([0, *map(len, texts)])
    start, length, period = word_runs(np.concatenate(parts), shortest, copies)
    cuts = np.searchsorted(start, bounds)
    return [(start[a:b] - at, length[a:b], period[a:b]) for a, b, at in zip(cuts[:-1], cuts[1:], bounds[:-1], strict=True)]


def _collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words that stand in no run after its first period, joined by blanks."""
    if len(start):
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, start + period, 1)
        np.add.at(edges, start + length, -1)
        words = list(compress(words, (np.cumsum(edges[:-1]) == 0).tolist()))
    return b" ".join(words)


def collapse(df: DataFrame, text: str = "text", shortest: int = SHORTEST, copies: int = COPIES) -> DataFrame:
    """df with `runs`, the periodic runs of each whole text's words (ASCII white space parts them; word numbers from 0; by start, then
    period), and `collapsed`, the text's words without what repeats a run's first period. Columns of those names are replaced.

    Null, empty and blank texts have no runs and an empty text; repeated rows, null keys and extra columns pass through; an empty table
    gives an empty one. One narrow pass: a task holds a text's words, a dozen numbers for each, and twice as many numbers
    as it has ranks of suffixes; texts of up to TOGETHER words share that work."""
    keep = [f for f in df.schema.fields if f.name not in ("runs", "collapsed")]
    schema = T.StructType([*keep, T.StructField("runs", T._parse_datatype_string(RUNS)), T.StructField("collapsed", T.StringType())])
    at, kept = df.columns.index(text), [j for j, f in enumerate(df.schema.fields) if f in keep]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found, texts, held = [], [], 0
            outs: list[bytes] = []

            def settle() -> None:
                nonlocal texts, held
                got = _together(texts, shortest, copies)
                outs.extend(_collapsed(w, *r) for w, r in zip(texts, got, strict=True))
                found.extend(got)
                texts, held = [], 0

            for value in batch.column(at).cast(pa.binary()):
                words = (value.as_py() or b"").split()
                if texts and held + len(words) > TOGETHER:
                    settle()
                texts.append(words)
                held += len(words)
            if texts:
                settle()
            offsets = pa.array(np.cumsum([0, *(len(r[0]) for r in found)]), pa.int32())
            values = [pa.array(np.concatenate([r[j] for r in found]) if found else np.empty(0, np.int64), pa.int64()) for j in range(3)]
            runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(values, names=["start", "length", "period"]))
            cols = [*(batch.column(j) for j in kept), runs, pa.array(outs, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    return numbered(df).mapInArrow(run, schema)


def longest(runs: Column) -> Column:
    """The run with the greatest length by period, compared without rounding; of equal ones the first; null without runs."""
    kind = RUNS.removeprefix("array<").removesuffix(">")
    return F.aggregate(runs, F.lit(None).cast(kind), lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))


def repeated_tail(text: Column, key: Column) -> Column:
    """What op11's contract makes of a text: for a tenth of the keys (h = crc32 of the key as text, h % 10 = 0; g = h // 10) the words from
    number a = g % n on repeat the p = 1 + (n - a) // (3 + g % 8) words from there. Others, and those of a null key, stay."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text, SPACE), lambda w: w != "")

    def repeat(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(ws, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # the words stand in an array of one, so that each lambda sees them without splitting the text again
    planted = F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, repeat(ws)).otherwise(F.lit("")))[0]
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)) & text.isNotNull(), planted).otherwise(text)


def digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of df: doc_id, n_runs; start, length, period and exponent_milli of the run with the greatest exponent (null without
    runs); hashes of all runs and of the collapsed text. Texts are taken as repeated_tail makes them."""
    rows = df.select(F.col(quoted(key)).alias("doc_id"), repeated_tail(F.col(quoted(text)), F.col(quoted(key))).alias("text"))
    found = collapse(rows).withColumn("best", longest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
