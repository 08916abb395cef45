"""Lookups of the text operators in tables whose size isn't known beforehand."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.operators.arrow import map_rows
from folio.session import cut

__all__ = ["BROADCAST_BYTES", "Found", "map_rows", "with_lookup"]

#: A lookup table is broadcast whole only if its keys and values take at most so many bytes. Of a larger one the keys
#: that texts ask for most are broadcast, as many as half of these bytes hold; the others are joined.
BROADCAST_BYTES = 48 << 20
#: Bytes a key and its value take beside the characters of the key.
ENTRY_BYTES = 120


class Found:
    """What a lookup holds for a row: the part that was broadcast, and the row's own part of the rest."""

    __slots__ = ("head", "own")

    def __init__(self, head: dict):
        self.head, self.own = head, {}

    def get(self, key, default=None):
        value = self.head.get(key)
        return self.own.get(key, default) if value is None else value

    def __getitem__(self, key):
        return self.head[key] if key in self.head else self.own[key]

    def __contains__(self, key) -> bool:
        return key in self.head or key in self.own


def _head(lookup: DataFrame, n: int, size: int, limit: int, always: tuple[str, ...]) -> dict:
    """The part of a large lookup that is broadcast: the keys always asked for, and those of the largest counts.

    A key that many texts ask for has a large count, so no key that is joined is asked for by many rows. The threshold
    comes from the counts' quantiles, and only counts above it are taken, so ties can't make the part larger."""
    rows = lookup.where(F.col("key").isin(*always)) if always else lookup.limit(0)
    most = int(limit / 2 * n / size)  # entries that half the bytes hold
    if most and isinstance(lookup.schema["value"].dataType, T.NumericType):
        least = lookup.agg(F.percentile_approx("value", 1 - most / n, 100_000)).first()[0]
        heavy = lookup.where(F.col("value") > least)
        if heavy.count() <= 2 * most:  # the quantile is approximate
            rows = rows.unionByName(heavy)
    return dict(map(tuple, rows.toLocalIterator(True)))


def with_lookup(
    df: DataFrame,
    lookup: DataFrame,
    wanted: Callable[[dict[str, list], int], Iterable[str]],
    decide: Callable[[dict[str, list], int, object], Iterable[tuple]],
    ddl: str,
    limit: int | None = None,
    state: Callable[[Found], object] | None = None,
    always: Iterable[str] = (),
) -> DataFrame:
    """Rows of df through decide(columns, i, found), found holding the lookup's values of at least the keys that
    wanted(columns, i) names and of those in always (a bounded number of constants).

    A lookup that proves to take at most limit bytes is broadcast. Of a larger one the head is broadcast: the keys in
    always and those of the largest counts. A row that asks for other keys too gets its own part of the rest: these keys
    are joined with the lookup and gathered per row (a row's keys are bounded by its text); a row that doesn't is never
    moved. The same decide runs in all cases. lookup: key STRING, value (any type). state turns found into what decide
    gets; it is made once in a worker, and what it remembers of a key must depend on values of the lookup alone.
    """
    spark = df.sparkSession
    limit = BROADCAST_BYTES if limit is None else limit
    always = tuple(sorted(set(always)))
    lookup = cut(lookup.select("key", "value"))  # measured and read: computed once
    n, chars = lookup.agg(F.count(F.lit(1)), F.sum(F.octet_length("key"))).first()
    size = n * ENTRY_BYTES + (chars or 0)
    if size <= limit:
        table = spark.sparkContext.broadcast(dict(map(tuple, lookup.toLocalIterator(True))))
    else:
        table = spark.sparkContext.broadcast(_head(lookup, n, size, limit, always))

    def run(batches):
        found = Found(table.value)
        given = state(found) if state else found
        for c in batches:
            count = len(next(iter(c.values()), []))
            parts = c.get("__found")
            out: list[tuple] = []
            for i in range(count):
                found.own = {x["key"]: x["value"] for x in parts[i]} if parts and parts[i] else {}
                out.extend(decide(c, i, given))
            yield out

    if size <= limit:
        return map_rows(df, run, ddl)

    keys_type = pa.list_(pa.string())

    def ask(batches):
        head = table.value
        for b in batches:
            c = {name: b.column(k).to_pylist() for k, name in enumerate(b.schema.names)}
            keys = pa.array([[k for k in set(wanted(c, i)) if k not in head] for i in range(b.num_rows)], type=keys_type)
            yield pa.RecordBatch.from_arrays([*b.columns, keys], names=[*b.schema.names, "__keys"])

    asked = df.mapInArrow(ask, T.StructType([*df.schema.fields, T.StructField("__keys", T.ArrayType(T.StringType()))]))
    asked = cut(asked.withColumn("__row", F.monotonically_increasing_id()))
    local = asked.where(F.size("__keys") == 0).drop("__keys", "__row")
    rest = asked.where(F.size("__keys") > 0)
    parts = rest.select("__row", F.explode("__keys").alias("key")).join(lookup, "key").groupBy("__row").agg(F.collect_list(F.struct("key", "value")).alias("__found"))
    return map_rows(local, run, ddl).unionByName(map_rows(rest.drop("__keys").join(parts, "__row", "left"), run, ddl))
