"""Folds over long ordered sequences, in slices: each slice is folded at once from a guessed state, and again where the guess was wrong."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut

#: Rows of a slice, about, and of a task that folds whole sequences.
SLICE, TASK = 1_000_000, 100_000
#: A fold's state, and what a row gives out: values of the fields, with a mark.
State = tuple[float, ...]
Row = tuple[int, tuple[float, ...]]
Out = list[tuple[Row, int]]


def fold(rows: DataFrame, key: str, order: str, fields: list[str], start: Callable[[Row], tuple[State, Out]], step: Callable[[State, Row], tuple[State, Out]], size: int = SLICE) -> DataFrame:
    """What a fold over the rows of each key, in order, gives out: key, order, fields (doubles) and mark. `start` makes the state from a key's first
    row, `step` goes on from there; both get (order, values) and return the state, some numbers, and rows with marks of 0 or more. Rows
    of null key or order are left out; equal orders of a key stand by their values.

    Keys of up to `size` rows are dealt by a hash, and each is folded once. The rows of longer ones are range-partitioned by key and order into slices
    of about `size`, so that a sequence lies in several. All slices are folded at once, each as if its first key began there; then those whose first key goes on from the slice before are folded again from the state
    in which that one ended, until no slice begins in another state than the one before ended in. By induction the result is that of one long
    fold. Where states forget where they came from within a slice, one such round is all; else a state moves on by one slice a round.
    A task holds one batch of rows and one state."""
    base = cut(rows.select(F.col(key).alias("key"), F.col(order).cast("long").alias("at"), *[F.col(f).cast("double").alias(f"v{i}") for i, f in enumerate(fields)]).where("key IS NOT NULL AND at IS NOT NULL"))
    values = [f"v{i}" for i in range(len(fields))]
    unknown = F.lit(None).cast("array<double>")
    kind = base.schema["key"].dataType.simpleString()
    schema = ", ".join([f"key {kind}", "at long", *[f"{v} double" for v in values], "mark int", "slice int", f"first {kind}", "exit array<double>"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = None
        slice_, last, first, state = None, None, None, None
        for batch in batches:
            types = types or [batch.schema.field("key").type, pa.int64(), *[pa.float64()] * len(values), pa.int32(), pa.int32(), batch.schema.field("key").type, pa.list_(pa.float64())]
            cols = [c.to_pylist() for c in batch.columns]
            out: list[tuple] = []
            for k, at, *v, s, entry in zip(*cols, strict=True):
                row = (at, tuple(v))
                if s != slice_:
                    if slice_ is not None:
                        out.append((last, None, *[None] * len(values), -1, slice_, first, list(state)))
                    slice_, first = s, k
                    state, got = start(row) if entry is None else step(tuple(entry), row)
                elif k != last:
                    state, got = start(row)
                else:
                    state, got = step(state, row)
                last = k
                out.extend((k, o_at, *o_v, mark, s, None, None) for (o_at, o_v), mark in got)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)], names=names)
        if slice_ is not None:
            end = (last, None, *[None] * len(values), -1, slice_, first, list(state))
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(end, types, strict=True)], names=names)

    names = ["key", "at", *values, "mark", "slice", "first", "exit"]

    def folded(some: DataFrame) -> DataFrame:
        return cut(some.select("key", "at", *values, "slice", "entry").mapInArrow(run, schema))

    def ends(out: DataFrame, number: int) -> DataFrame:
        return out.where("mark < 0").select("slice", "first", F.col("key").alias("last"), "exit", F.lit(number).alias("round"))

    found = lambda out: out.select(F.col("key").alias(key), F.col("at").alias(order), *[F.col(v).alias(f) for v, f in zip(values, fields, strict=True)], "mark")
    long = cut(base.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > size).select("key"))
    some = not long.isEmpty()
    short = base.join(long, "key", "left_anti") if some else base
    tasks = max(1, math.ceil(base.count() / min(size, TASK)))
    whole = folded(short.repartition(tasks, "key").sortWithinPartitions("key", "at", *values).withColumns({"slice": F.lit(0), "entry": unknown})).where("mark >= 0")
    if not some:
        return found(whole)

    base = cut(base.join(long, "key", "left_semi"))
    parts = max(1, math.ceil(base.count() / size))
    slices = base.repartitionByRange(parts, "key", "at", *values).sortWithinPartitions("key", "at", *values).withColumn("slice", F.spark_partition_id())
    slices = cut(slices.withColumn("entry", unknown))
    rounds = [folded(slices.repartition(parts, "slice").sortWithinPartitions("slice", "key", "at", *values))]
    state = cut(ends(rounds[0], 0).withColumn("used", F.lit(None).cast("array<double>")))
    before = Window.orderBy("slice")  # one row a slice
    while parts > 1:
        entry = F.when(F.lag("last").over(before) == F.col("first"), F.lag("exit").over(before))
        todo = cut(state.withColumn("entry", entry).where(~F.col("entry").eqNullSafe(F.col("used"))).select("slice", "entry"))
        if todo.isEmpty():
            break
        again = slices.drop("entry").join(todo, "slice").repartition(parts, "slice").sortWithinPartitions("slice", "key", "at", *values)
        rounds.append(folded(again))
        state = cut(state.join(todo, "slice", "left_anti").unionByName(ends(rounds[-1], len(rounds) - 1).join(todo.withColumnRenamed("entry", "used"), "slice")))
    out = rounds[0].where("mark >= 0")
    if len(rounds) > 1:
        latest = state.select("slice", "round")
        tagged = [r.where("mark >= 0").withColumn("round", F.lit(i)) for i, r in enumerate(rounds)]
        out = tagged[0]
        for t in tagged[1:]:
            out = out.unionByName(t)
        out = out.join(latest, ["slice", "round"])
    return found(out.select(*whole.columns).unionByName(whole))
