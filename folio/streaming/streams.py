"""Structured Streaming forms of the event-shaped operators, and event-time windows over any event table.

Each stream gives what the batch operator gives of the same rows; watermarks bound the state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folio.operators import scoring
from folio.operators.events import PERIODS, SINGLE


def tumbling(events: DataFrame, ts: str, keys: list[str], width: str, late: str, value: str) -> DataFrame:
    """Count, sum by window and keys; rows later than `late` are dropped."""
    return (
        events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), *keys, "n", "total")
    )


def sliding(events: DataFrame, ts: str, keys: list[str], width: str, step: str, late: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, width, step), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """STR-6: sessions of a key that end when nothing comes for the gap."""
    s = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def distinct_events(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def recover(events: DataFrame, run: str, seq: str, error_class: str) -> DataFrame:
    """STR-3 on a stream: the counters of a run are its state."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts = dict(zip(PERIODS, state.get if state.exists else (0,) * len(PERIODS)))
        for pdf in batches:
            pdf, out = pdf.sort_values(seq), []
            for s, c in zip(pdf[seq], pdf[error_class]):
                if c in PERIODS:
                    period, often, last = PERIODS[c]
                    counts[c] += 1
                    act = often if counts[c] % period else last
                else:
                    if c == "GpuFallback":
                        counts = dict.fromkeys(PERIODS, 0)
                    act = SINGLE.get(c)
                out.append((key[0], s, c, act))
            yield pd.DataFrame(out, columns=[run, seq, error_class, "action"])
        state.update(tuple(counts.values()))

    kind = {f.name: f.dataType.simpleString() for f in events.schema}
    out = f"`{run}` {kind[run]}, `{seq}` {kind[seq]}, `{error_class}` string, action string"
    return events.groupBy(run).applyInPandasWithState(step, out, ", ".join(f"n{i} long" for i in range(len(PERIODS))), "append", GroupStateTimeout.NoTimeout)


def keep_scores(stream: DataFrame, path: str, result: str, checkpoint: str):
    """STR-1: after each batch of score rows the consensus of the newest books is written. The books' total order is
    book_seq, not the time of arrival.

    What is kept between batches are the distinct rows of the newest books alone, as the newest of all rows are the newest
    of these and the new ones; older rows are never read again. Everything is written under the number of its batch, so a
    repeated batch replaces itself."""

    def batch(df: DataFrame, n: int) -> None:
        spark: SparkSession = df.sparkSession
        rows = df.select("book_seq", "model_name", "category", "score", "false_positives", "hits").where("score is not null")
        if n > 0:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{path}/batch={n - 1}"))
        scoring.newest(rows.distinct()).write.mode("overwrite").parquet(f"{path}/batch={n}")
        kept = spark.read.schema(rows.schema).parquet(f"{path}/batch={n}")
        scoring.consensus(scoring.history(kept)).write.mode("overwrite").parquet(result)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
