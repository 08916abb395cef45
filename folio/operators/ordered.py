"""Values that ordered rows of a key hand on, without a task that holds a whole key.

Rows are ordered by an integer column. They fall into blocks of it; a window runs within a block of a key, and what a block
hands on is one row of a summary, over which a second window runs. A key with a third of all rows is so many blocks.
Null orders take no part in what is handed on and get null (running_count: 0 or more, as the rows before all others).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.operators.arrow import map_rows

BLOCK = 1 << 16


def running_counts(df: DataFrame, key: str, order: str, flags: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """For each flag (out -> condition) how many rows of the key that have it come up to each row."""
    ones = {f"__f{i}": F.coalesce(c.cast("long"), F.lit(0).cast("long")) for i, c in enumerate(flags.values())}
    blocked = df.withColumn("__b", F.floor(F.col(order) / block)).withColumns(ones)
    inner = W.partitionBy(key, "__b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    sums = blocked.groupBy(key, "__b").agg(*[F.sum(f).alias(f) for f in ones])
    outer = W.partitionBy(key).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(F.col(key).alias("__k"), F.col("__b").alias("__c"), *[F.coalesce(F.sum(f).over(outer), F.lit(0)).alias(f"{f}b") for f in ones])
    same = F.col(key).eqNullSafe(F.col("__k")) & F.col("__b").eqNullSafe(F.col("__c"))
    counted = blocked.select("*", *[F.sum(f).over(inner).alias(f"{f}i") for f in ones]).join(before, same)
    return counted.select(*df.columns, *[(F.col(f"{f}i") + F.col(f"{f}b")).alias(out) for f, out in zip(ones, flags)])


def running_count(df: DataFrame, key: str, order: str, flag: str, out: str, block: int = BLOCK) -> DataFrame:
    """How many flagged rows of the key come up to each row."""
    return running_counts(df, key, order, {out: F.col(flag)}, block)


def carried_all(df: DataFrame, key: str, order: str, values: dict[str, Column], block: int = BLOCK, before: bool = False) -> DataFrame:
    """For each value (out -> column) the last one that isn't null up to each row of a key; with before, up to the row
    before it."""
    given = {f"__v{i}": c for i, c in enumerate(values.values())}
    blocked = df.withColumn("__b", F.floor(F.col(order) / block)).withColumns(given)
    inner = W.partitionBy(key, "__b").orderBy(order).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    last = blocked.groupBy(key, "__b").agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in given])
    outer = W.partitionBy(key).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    handed = last.select(F.col(key).alias("__k"), F.col("__b").alias("__c"), *[F.last(v, ignorenulls=True).over(outer).alias(f"{v}h") for v in given])
    same = F.col(key).eqNullSafe(F.col("__k")) & F.col("__b").eqNullSafe(F.col("__c"))
    found = blocked.select("*", *[F.last(v, ignorenulls=True).over(inner).alias(f"{v}i") for v in given]).join(handed, same)
    return found.select(*df.columns, *[F.coalesce(f"{v}i", f"{v}h").alias(out) for v, out in zip(given, values)])


def carried(df: DataFrame, key: str, order: str, value: Column, out: str, block: int = BLOCK, before: bool = False) -> DataFrame:
    """The last value that isn't null up to each row of a key; with before, up to the row before it."""
    return carried_all(df, key, order, {out: value}, block, before)


def automaton(events: DataFrame, key: str, order: str, request: str, states: list[str], step, start: str, ddl: str, block: int = BLOCK) -> DataFrame:
    """key, order, request and step's own columns of a machine of few states that every key runs from start.

    step(state, request) -> (state, columns...). A block of a key is a map of its states to the states it leaves them in;
    these maps are composed in order, and each block then runs from the state it is handed. Null keys are a key."""
    rows = events.select(key, order, request, F.floor(F.col(order) / block).alias("__b"))
    at = {s: i for i, s in enumerate(states)}
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, order, request)}
    placed = rows.repartition(key, "__b").sortWithinPartitions(key, "__b", order)

    def maps(batches):
        now, left, first = None, [], True
        for c in batches:
            out = []
            for k, b, r in zip(c[key], c["__b"], c[request]):
                if first or (k, b) != now:
                    if not first:
                        out.append((*now, left))
                    now, left, first = (k, b), list(range(len(states))), False
                left = [at[step(states[s], r)[0]] for s in left]
            yield out
        if not first:
            yield [(*now, left)]

    def compose(batches):
        now, state, first = None, at[start], True
        for c in batches:
            out = []
            for k, b, m in zip(c["k"], c["b"], c["m"]):
                if first or k != now:
                    now, state, first = k, at[start], False
                out.append((k, b, states[state]))
                state = m[state]
            yield out

    left = map_rows(placed, maps, f"k {kinds[key]}, b long, m array<int>")
    handed = map_rows(left.repartition("k").sortWithinPartitions("k", "b"), compose, f"__k {kinds[key]}, __c long, __state string")
    given = rows.join(handed, F.col(key).eqNullSafe(F.col("__k")) & F.col("__b").eqNullSafe(F.col("__c"))).drop("__k", "__c")

    def run(batches):
        now, state, first = None, start, True
        for c in batches:
            out = []
            for k, s, r, b, handed_on in zip(c[key], c[order], c[request], c["__b"], c["__state"]):
                if first or (k, b) != now:
                    now, state, first = (k, b), handed_on, False
                state, *more = step(state, r)
                out.append((k, s, r, *more))
            yield out

    ordered = given.repartition(key, "__b").sortWithinPartitions(key, "__b", order)
    return map_rows(ordered, run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, `{request}` {kinds[request]}, {ddl}")
