"""Row-wise Python over Arrow batches, for the sequential folds that no built-in expression holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterator[list[tuple]]], ddl: str) -> DataFrame:
    """fn over the batches of each partition: columns as lists in, lists of row tuples out."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(ddl)
    target = to_arrow_schema(schema)

    def run(batches):
        columns = ({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)} for b in batches)
        for rows in fn(columns):
            for at in range(0, len(rows), 20_000):
                part = list(zip(*rows[at : at + 20_000]))
                if part:
                    yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(part, target)], schema=target)

    return df.mapInArrow(run, schema)


def per_row(df: DataFrame, keys: list[str], text: str, fn: Callable[[str], list[tuple]], ddl: str) -> DataFrame:
    """keys and each tuple of fn(text); a null text gives no row."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for c in batches:
            out = []
            for i, t in enumerate(c[text]):
                if t is not None:
                    head = tuple(c[k][i] for k in keys)
                    out.extend((*head, *row) for row in fn(t))
            yield out

    return map_rows(df.select(*keys, text), run, f"{kinds}, {ddl}")
